"""List answers by map and reduce: one generated answer per document, parsed into
items, merged by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions.text import after_thinking, holds_any, looks_like_name, normalised_name
from quillgraph.functions.vocab import Profile
from quillgraph.operators.storage import durable

#: A generator answers prompts: (prompts, system prompts, most tokens) -> answers.
Generator = Callable[[list[str], list[str], int], list[str]]
UNKNOWN = "?"
MAP_TOKENS, ENOUGH = 96, 3


def step(column: Column, f: Callable[[Column], Column]) -> Column:
    """f(column), where column is worked out once however often f names it."""
    return F.get(F.transform(F.array(column), f), F.lit(0))


def item_of(line: Column, profile: Profile) -> Column:
    """TX10: struct(name, years) of an answer line "name — years", else null."""
    yes = "|".join(dict.fromkeys((profile.yes, "YES", profile.yes.capitalize())))
    parts = r"^(.+?)\s+[—–-]\s+(.+)$"
    x = F.replace(F.replace(F.trim(line), F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    x = F.trim(F.regexp_replace(x, r"^[\-*•\x{2013}\x{2014}\d]+[.)]?\s+", ""))
    x = F.trim(F.regexp_replace(x, rf"^({yes})[\s,:-]+", ""))

    def divided(x: Column) -> Column:
        both = x.rlike(parts)
        name = F.when(both, F.regexp_extract(x, parts, 1)).otherwise(x)
        years = F.when(both, F.trim(F.regexp_extract(x, parts, 2))).otherwise(UNKNOWN)
        name = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(name), r"\(.*?\)", "")), r'^[*«».,"]+|[*«».,"]+$', ""))
        return F.struct(name.alias("name"), years.alias("years"))

    def dated(years: Column) -> Column:
        span = F.trim(F.regexp_replace(F.regexp_replace(years, r"\s*год[а-я]*", ""), r"\s+", " "))
        return F.when(years.rlike(r"\d") & (span != ""), span).otherwise(UNKNOWN)

    def checked(x: Column) -> Column:
        header = x.endswith(":") & ~x.rlike(r"\d")
        refusal = F.upper(x).isin(*profile.no)
        named = step(divided(x), lambda i: F.when(F.length(i["name"]).between(4, 70) & looks_like_name(i["name"]), F.struct(i["name"].alias("name"), dated(i["years"]).alias("years"))))
        return F.when((x != "") & ~refusal & ~header, named)

    return step(x, checked)


def parsed_items(answer: Column, profile: Profile) -> Column:
    """The items of an answer's lines. Within a lambda nothing that is named twice is worked out only once, so each step has its own."""
    found = F.transform(F.split(answer, r"\r\n|\r|\n"), lambda x: item_of(x, profile))
    return F.filter(found, lambda i: i.isNotNull())


def is_negative(answer: Column, profile: Profile) -> Column:
    """PF12."""
    return holds_any(F.lower(answer), profile.negatives)


def merged_items(items: DataFrame, *, q_col: str = "q_id", name_col: str = "name", years_col: str = "years") -> DataFrame:
    """AG2: one item for each normalised name: the first; if its years are unknown, the
    first with known years in its place. ord numbers the names as first seen. Items of
    equal ord go by name and years."""
    known = F.col(years_col) != UNKNOWN
    whole = F.struct(name_col, years_col)
    best = items.withColumn("key", normalised_name(F.col(name_col))).groupBy(q_col, "key").agg(
        F.min("ord").alias("_first"), F.min_by(whole, F.struct("ord", whole)).alias("_any"), F.min_by(F.when(known, whole), F.when(known, F.struct("ord", whole))).alias("_known"))
    item = F.coalesce("_known", "_any")
    order = Window.partitionBy(q_col).orderBy("_first", "key")
    return best.select(q_col, F.row_number().over(order).alias("ord"), "key", item[name_col].alias(name_col), item[years_col].alias(years_col))


def map_documents(docs: DataFrame, generate: Generator, profile: Profile) -> DataFrame:
    """LX1: docs (q_id, ord, question, title, text, is_seed, …) with the generator's raw
    answer: seeds are asked for every fitting person, others only about their subject.
    Arrow batches; the generator is made once per task by whoever passes it."""
    seed_system = "List every person that the excerpt shows to fit the question, one per line, as: name — years. If none does, answer with the one word for no."
    own_system = "The excerpt is about %s. If that person fits the question, answer with one line: name — years. If not, answer with the one word for no."
    kinds = T.StructType([*docs.schema.fields, T.StructField("raw", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            prompts = [f"{profile.strings['question']}: {q}\n\n{t}" for q, t in zip(b["question"], b["text"], strict=True)]
            systems = [seed_system if s else own_system % t for s, t in zip(b["is_seed"], b["title"], strict=True)]
            yield b.assign(raw=generate(prompts, systems, MAP_TOKENS) if len(b) else [])

    return docs.mapInPandas(run, kinds)


def reduced(answers: DataFrame, profile: Profile) -> DataFrame:
    """LX2: the merged items of answers (q_id, ord, question, title, is_seed, raw).

    Answers that say no go. A bare yes about a subject means the subject. An answer
    about a subject that names several people keeps those sharing a word with the
    title. Names that are words of the question go."""
    raw = F.trim(after_thinking(F.col("raw")))
    rows = answers.withColumn("_raw", raw).filter(~is_negative(F.col("_raw"), profile))
    bare = ~F.col("is_seed") & (F.upper(F.regexp_replace("_raw", r"[.! ]+$", "")) == profile.yes)
    subject = F.array(F.struct(F.col("title").alias("name"), F.lit(UNKNOWN).alias("years")))
    items = F.when(bare, subject).otherwise(parsed_items(F.col("_raw"), profile))
    words = lambda c, n: F.filter(F.split(normalised_name(c), " "), lambda w: F.length(w) >= n)
    own = words(F.col("title"), 4)
    kept = step(items, lambda found: F.when(~F.col("is_seed") & (F.size(found) > 1), F.filter(found, lambda i: F.arrays_overlap(own, words(i["name"], 1)))).otherwise(found))
    # the outer form: explode infers a filter on the items' size, which is pushed below and parses each answer again
    spread = rows.select("q_id", "question", F.col("ord").alias("_doc"), F.posexplode_outer(kept).alias("_pos", "_i")).filter("_i is not null")
    key = normalised_name(F.col("_i.name"))
    fine = (F.length(key) >= 4) & ~F.array_contains(words(F.col("question"), 4), key)
    numbered = spread.filter(fine).select("q_id", F.struct("_doc", "_pos").alias("ord"), "_i.name", "_i.years")
    return merged_items(numbered)


def list_answers(docs: DataFrame, generate: Generator, profile: Profile) -> DataFrame:
    """LX1 and LX2 with the short circuit: where the dedicated list article alone gives
    ENOUGH names, the question's other documents are not asked about.

    Two stages: list articles first, then the rest by an anti join."""
    first = durable(map_documents(docs.filter("is_list_article"), generate, profile))
    got = reduced(first, profile)
    settled = got.groupBy("q_id").count().filter(F.col("count") >= ENOUGH).select("q_id")
    rest = docs.filter("not is_list_article").join(settled, "q_id", "left_anti")
    return reduced(first.unionByName(map_documents(rest, generate, profile)), profile)


def markdown_list(items: DataFrame, q_col: str = "q_id") -> DataFrame:
    """LX3: one Markdown list for each question."""
    line = F.concat(F.lit("- **"), F.col("name"), F.lit("**"), F.when(F.col("years") != UNKNOWN, F.concat(F.lit(" — "), F.col("years"))).otherwise(""))
    rows = items.groupBy(q_col).agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("_l"))
    return rows.select(q_col, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("answer"))
