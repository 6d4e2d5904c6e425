"""Excerpts: the densest window of a text, and packing under a budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.vocab import Profile

BACK = 100


def window_stems(terms: Column, title: Column, profile: Profile) -> Column:
    """Stems to look for: terms without their last 2 characters (from 5 on), those in
    the title left out, and the groups of near words that one of them starts with."""
    low = F.lower(title)
    own = F.filter(F.transform(terms, lambda t: F.when(F.length(t) >= 5, F.substring(t, F.lit(1), F.length(t) - 2)).otherwise(t)), lambda s: ~low.contains(s) & (s != ""))
    out = own
    for triggers, more in profile.synonyms:
        near = F.exists(own, _starts(triggers))
        out = F.concat(out, F.when(near, F.array(*map(F.lit, more))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(out)


def _starts(triggers: tuple[str, ...]):
    def test(s: Column) -> Column:
        out = F.lit(False)
        for t in triggers:
            out = out | s.startswith(t)
        return out

    return test


def occurrences(text: Column, stem: Column) -> Column:
    """Positions from 0 of the stem's occurrences in text, none overlapping another."""
    parts = F.split(text, F.concat(F.lit(r"\Q"), stem, F.lit(r"\E")), -1)
    lengths = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.length(p))
    step = F.length(stem)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    return F.aggregate(lengths, start, lambda acc, n: F.struct((acc["at"] + n + step).alias("at"), F.array_append(acc["found"], acc["at"] + n).alias("found")), lambda acc: acc["found"])


def densest_start(docs: DataFrame, id_col: str, anchors_col: str, cap_col: str) -> DataFrame:
    """AG6: (id_col, start): the first anchor whose window of cap characters holds
    most anchors. Each anchor also marks where its window ends; running counts over a
    document's anchors and marks give the anchors before both, so each document may
    have a cap of its own, and one window function serves all."""
    marks = F.transform(anchors_col, lambda at: F.struct((at + F.col(cap_col)).alias("_pos"), F.lit(0).alias("_is"), at.alias("_at")))
    anchors = F.transform(anchors_col, lambda at: F.struct(at.alias("_pos"), F.lit(1).alias("_is"), at.alias("_at")))
    spread = docs.select(id_col, F.inline(F.concat(anchors, marks)))
    # a mark stands before the anchors at its place: the window does not reach them
    so_far = Window.partitionBy(id_col).orderBy("_pos", "_is").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = spread.withColumn("_n", F.sum("_is").over(so_far)).groupBy(id_col, "_at")
    held = counted.agg((F.max(F.when(F.col("_is") == 0, F.col("_n"))) - F.min(F.when(F.col("_is") == 1, F.col("_n")))).alias("_n"))
    return held.groupBy(id_col).agg(F.min_by("_at", F.struct(-F.col("_n"), F.col("_at"))).alias("start"))


def cut_window(body: Column, start: Column, cap: Column) -> Column:
    at = F.least(F.greatest(start - BACK, F.lit(0)), F.greatest(F.length(body) - cap, F.lit(0)))
    return F.substr(body, (at + 1).cast("int"), cap.cast("int"))


def relevant_chunk(docs: DataFrame, *, id_col: str, body_col: str, title_col: str, terms_col: str, cap: int, profile: Profile, out_col: str = "chunk") -> DataFrame:
    """TX4: docs with out_col: the body if it fits the cap, else the cap characters
    around the densest cluster of the terms' stems, else its beginning. id_col names
    a row. Only bodies over the cap are searched; positions, not texts, are shuffled."""
    body = F.col(body_col)
    low = F.lower(body)
    stems = window_stems(F.col(terms_col), F.col(title_col), profile)
    long = docs.filter(F.length(body_col) > cap).select(id_col, low.alias("_low"), stems.alias("_stems"))
    at = F.flatten(F.transform("_stems", lambda s: occurrences(F.col("_low"), s)))
    starts = densest_start(long.select(id_col, at.alias("_at"), F.lit(cap).alias("_cap")), id_col, "_at", "_cap")
    joined = docs.join(starts.withColumnRenamed("start", "_start"), id_col, "left")
    fits = F.length(body) <= cap
    return joined.withColumn(out_col, F.when(fits, body).when(F.col("_start").isNull(), F.substring(body, 1, cap)).otherwise(cut_window(body, F.col("_start"), F.lit(cap)))).drop("_start")


def plain_chunk(body: str, title: str, terms: list[str], cap: int, profile: Profile) -> str:
    """TX4 for one text, where the cap follows from what was packed before."""
    if len(body) <= cap:
        return body
    own = [s for s in (t[:-2] if len(t) >= 5 else t for t in terms) if s and s not in title.lower()]
    stems = dict.fromkeys(own)
    for triggers, more in profile.synonyms:
        if any(s.startswith(triggers) for s in own):
            stems |= dict.fromkeys(more)
    low, at = body.lower(), []
    for s in stems:
        i = low.find(s)
        while i >= 0:
            at.append(i)
            i = low.find(s, i + len(s))
    if not at:
        return body[:cap]
    at.sort()
    best, most, end = at[0], -1, 0
    for k, a in enumerate(at):
        while end < len(at) and at[end] < a + cap:
            end += 1
        if end - k > most:
            best, most = a, end - k
    start = min(max(best - BACK, 0), max(len(body) - cap, 0))
    return body[start : start + cap]


def packed(rows: DataFrame, profile: Profile, *, q_col: str = "q_id") -> DataFrame:
    """PR2, PR3: (q_col, block, titles, total): excerpts of each question's ranked
    articles under its budget.

    rows: (q_col, ord, title, snippet, source_tag, body, card, section, terms,
    is_list, top_k, budget); body null: the page could not be read. What an article
    may take depends on what the earlier ones took, so a question's rows (those
    within the adaptive top count, 12 at most for lists) are folded in one group.
    """
    say = profile.strings

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        first = pdf.iloc[0]
        is_list, budget, total = bool(first["is_list"]), int(first["budget"]), int(first["total"])
        count = min(12, max(int(first["top_k"]), 5, total + 2)) if is_list else int(first["top_k"])
        share = max(budget // count, 500)
        seed = max(budget * 55 // 100, 1500) if is_list else share
        blocks, titles, used = [], [], 0
        for k, r in enumerate(pdf.head(count).itertuples()):
            if r.body is None:
                continue
            left = budget - used
            if left <= 200:
                break
            cap = min(left, seed if k == 0 else share)
            section = (r.section or "")[:cap] if k == 0 and is_list else ""
            chunk = section or plain_chunk(r.body, r.title, list(r.terms), cap, profile)
            text = f"=== {r.title} ===\n"
            if r.source_tag:
                text += f"({say['found']} {r.source_tag})\n"
            if r.card:
                text += r.card + "\n"
            text += chunk + "\n\n"
            blocks.append(text)
            titles.append(r.title)
            used += len(text)
        if not blocks:
            for r in pdf.head(int(first["top_k"])).itertuples():
                blocks.append(f"=== {r.title} ===\n{r.snippet}\n\n")
                titles.append(r.title)
                if sum(map(len, blocks)) > budget:
                    break
        return pd.DataFrame({q_col: [first[q_col]], "block": ["".join(blocks)], "titles": [titles], "total": [total]})

    kind = rows.schema[q_col].dataType.simpleString()
    w = Window.partitionBy(q_col)
    bounded = rows.withColumn("total", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy("ord")))
    # beyond this rank no rule can reach a row, so a group stays small
    bounded = bounded.filter(F.col("_r") <= F.greatest(F.lit(12), F.col("top_k"))).drop("_r")
    return bounded.groupBy(q_col).applyInPandas(fold, f"{q_col} {kind}, block string, titles array<string>, total int")


def agentic_context(seed: Column, trail: Column, cap: int = 4000, room: int = 800) -> Column:
    """PR6: the seed and the end of the trail that fits."""
    left = F.greatest(F.lit(cap) - F.length(seed), F.lit(room))
    return F.concat(seed, F.substr(trail, F.greatest(F.length(trail) - left + 1, F.lit(1)), left))
