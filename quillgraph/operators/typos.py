"""Titles suggested for misspelled questions, by a deletion neighbourhood.

Strings within `most` edits of each other have a string in common that both become by deleting
`most` characters or fewer; so have their beginnings of any one length. Titles and
questions meet on the hashes of these strings, whatever character is wrong, the first one
included, and the distance verifies what meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.index import SUGGESTED, title_key

#: Characters of a beginning: of twelve, up to two deletions leave 79 strings.
BEGINNING = 12


def without_one(text: Column) -> Column:
    place = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.transform(place, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def neighbourhood(text: Column, most: int) -> Column:
    """Hashes of text and what is left of it after up to `most` deletions."""
    found = layer = F.array(text)
    for _ in range(most):
        layer = F.array_distinct(F.flatten(F.transform(layer, without_one)))
        found = F.concat(found, layer)
    return F.array_distinct(F.transform(found, lambda x: F.xxhash64(x)))


def keyed(rows: DataFrame, column: str, most: int, beginning: int) -> DataFrame:
    """(column, h): distinct values and the hashes of their neighbourhoods."""
    begun = rows.select(column).filter(F.length(column) > 0).distinct().withColumn("_b", F.substring(column, 1, beginning))
    return begun.select(column, F.explode_outer(neighbourhood(F.col("_b"), most)).alias("h"))


def suggested_by_edits(probes: DataFrame, articles: DataFrame, *, title_col: str = "title_asked", most: int = 2, beginning: int = BEGINNING) -> DataFrame:
    """SC6: probes with the nearest title within `most` edits of the normalised texts (title, path, distance), score 950.

    Ties go to the smaller title, then path. Equal normalised titles and equal questions are searched once.
    Probes that are blank once normalised, or without such a title, have no row."""
    asked = probes.withColumn("_a", title_key(F.col(title_col)))
    named = articles.select(title_key(F.col("title")).alias("_n"), "title", "path").groupBy("_n").agg(F.min(F.struct("title", "path")).alias("_t"))
    pairs = keyed(asked, "_a", most, beginning).join(keyed(named, "_n", most, beginning), "h").select("_a", "_n").distinct()
    near = pairs.withColumn("_d", F.levenshtein("_a", "_n", most)).filter(F.col("_d") >= 0)
    best = near.join(named, "_n").groupBy("_a").agg(F.min(F.struct(F.col("_d").alias("d"), F.col("_t.title").alias("title"), F.col("_t.path").alias("path"))).alias("_m"))
    return asked.join(best, "_a").select(*probes.columns, "_m.title", "_m.path", F.col("_m.d").alias("distance"), F.lit(SUGGESTED).alias("score"))
