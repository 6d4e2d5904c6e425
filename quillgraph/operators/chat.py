"""Conversations: coreference, titles, history and its upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import keywords, tokens
from quillgraph.functions.vocab import Profile

SHORT = 25


def needs_context(text: Column, profile: Profile) -> Column:
    """PF14: short, or with a pronoun."""
    pronouns = F.array(*map(F.lit, profile.pronouns))
    return (F.length(text) < SHORT) | F.arrays_overlap(tokens(text), pronouns)


def with_topic(text: Column, previous: Column, profile: Profile) -> Column:
    """CV1 for one row: text, and the keywords of the previous user turn that it lacks."""
    topic = F.split(keywords(previous, profile), " ")
    own = tokens(text)
    added = F.filter(topic, lambda w: (F.trim(w) != "") & ~F.array_contains(own, F.lower(w)))
    add = needs_context(text, profile) & previous.isNotNull() & (F.size(added) > 0)
    return F.when(add, F.concat(text, F.lit(" "), F.array_join(added, " "))).otherwise(text)


def resolved(turns: DataFrame, profile: Profile, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", user: str = "user") -> DataFrame:
    """CV1: user turns with resolved: the question in which its referent is named."""
    before = Window.partitionBy(conv_col).orderBy(turn_col).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(role_col) == user, F.col(text_col)), ignorenulls=True).over(before)
    rows = turns.withColumn("_before", last).filter(F.col(role_col) == user)
    return rows.withColumn("resolved", with_topic(F.col(text_col), F.col("_before"), profile)).drop("_before")


def visible(turns: DataFrame, text_col: str = "text", streaming_col: str | None = None) -> DataFrame:
    """PF17: without blank turns and those still being written."""
    out = turns.filter(F.trim(F.coalesce(text_col, F.lit(""))) != "")
    return out.filter(~F.col(streaming_col)) if streaming_col else out


def conversation_titles(turns: DataFrame, *, default: str = "New chat", conv_col: str = "conv_id", turn_col: str = "turn", user: str = "user") -> DataFrame:
    """TX21."""
    first = turns.groupBy(conv_col).agg(F.min_by("text", turn_col).alias("_any"), F.min_by(F.when(F.col("role") == user, F.col("text")), F.when(F.col("role") == user, F.col(turn_col))).alias("_t"))
    title = F.substring(F.trim(F.regexp_replace("_t", "\n", " ")), 1, 50)
    return first.select(conv_col, F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(default).alias("title"))


def history(turns: DataFrame, last: int | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """CV2: each conversation's messages as an ordered array of (role, text)."""
    rows = visible(turns)
    if last is not None:
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(conv_col).orderBy(F.desc(turn_col)))).filter(F.col("_r") <= last).drop("_r")
    listed = rows.groupBy(conv_col).agg(F.array_sort(F.collect_list(F.struct(turn_col, "role", "text"))).alias("_m"))
    return listed.select(conv_col, F.transform("_m", lambda m: F.struct(m["role"], m["text"])).alias("messages"))


def final_turn(block: Column, question: Column, profile: Profile) -> Column:
    """CV2's last message: the excerpts and the question."""
    say = profile.strings
    return F.concat(F.lit(f"=== {say['excerpts']} ===\n"), block, F.lit(f"{say['question']}: "), question)


def upserted(table: DataFrame, changes: DataFrame, *, key: str = "id", recency: str = "updated_at") -> DataFrame:
    """SK1, SO6: changes in place of the rows they share a key with; most recent first.
    Of several changes to a key the most recent counts."""
    latest = changes.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(recency)))).filter("_r = 1").drop("_r")
    return table.join(latest.select(key), key, "left_anti").unionByName(latest).orderBy(F.desc(recency), key)


def deleted(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """SK2."""
    return table.join(keys.select(key), key, "left_anti")


def turn_totals(hops: DataFrame, turn_col: str = "turn_id") -> DataFrame:
    """AG7: the sums over an answer's hops."""
    sums = [F.sum(c).alias(c) for c in ("prompt_tokens", "gen_tokens", "prefill_ms", "decode_ms")]
    return hops.groupBy(turn_col).agg(*sums)


def effective_prompt(base: Column, words: Column) -> Column:
    """PR8: the system prompt with the length wish."""
    return F.when(words > 0, F.concat(base, F.format_string("\nAnswer in about %d words.", words))).otherwise(base)


def token_budget(words: Column, per_word: int = 4, low: int = 256, high: int = 2048) -> Column:
    """PR8."""
    return F.least(F.greatest(words * per_word, F.lit(low)), F.lit(high))
