"""Archive and model catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import archive_name, in_size_range, model_owner, parse_size

# Fixed value: a row of a directory listing.
ROW = r'(?is)<a\s+href="([^"]+\.zim)"[^>]*>[^<]+</a>\s*</td>\s*<td[^>]*>\s*([^<]+?)\s*</td>\s*<td[^>]*>\s*([^<]+?)\s*</td>'


def index_rows(pages: DataFrame, html_col: str = "html", base_url: str = "") -> DataFrame:
    """SC11: (filename, size_bytes, date, download_url, language, topic, variant) of every
    row of directory listings; rows without a size are left out."""
    row = F.lit(ROW)
    got = F.arrays_zip(*(F.regexp_extract_all(F.col(html_col), row, k).alias(n) for k, n in ((1, "name"), (2, "date"), (3, "size"))))
    rows = pages.select(F.explode(got).alias("r")).select(F.col("r.name").alias("filename"), parse_size(F.col("r.size")).alias("size_bytes"), F.col("r.date").alias("date"))
    named = rows.filter("size_bytes is not null").withColumn("n", archive_name(F.col("filename")))
    return named.select("filename", "size_bytes", "date", F.concat(F.lit(base_url), "filename").alias("download_url"), "n.language", "n.topic", "n.variant")


def catalogue_order() -> list[Column]:
    """SO5."""
    return [F.coalesce("language", F.lit("zz")), F.coalesce("topic", F.lit("zzz")), F.desc("date")]


def filtered(catalogue: DataFrame, *, language: str | None = None, variant: str | None = None, query: str | None = None) -> DataFrame:
    """PF2: filters that are set hold together; a null language never fits a set one."""
    if language is not None:
        catalogue = catalogue.filter(F.lower("language") == language.lower())
    if variant is not None:
        catalogue = catalogue.filter(F.col("variant") == variant)
    if query:
        catalogue = catalogue.filter(F.lower("filename").contains(query.lower()))
    return catalogue


def shown_of(catalogue: DataFrame, kept: Column) -> DataFrame:
    """AG9."""
    return catalogue.agg(F.count_if(kept).alias("shown"), F.count("*").alias("total"))


def models(rows: DataFrame, *, query: str = "", low: float = 0.5, high: float = 9.0, limit: int = 50) -> DataFrame:
    """SC13, PF3, PF5: models of a size in range whose id holds the query, most downloaded first."""
    hit = rows.filter(F.lower("id").contains((query.strip() or "gguf").lower()) | F.array_contains(F.transform("tags", lambda t: F.lower(t)), (query.strip() or "gguf").lower()))
    hit = hit.withColumn("o", model_owner(F.col("id"))).filter(in_size_range(F.col("o.name"), low, high))
    return hit.select("id", "o.author", "o.name", "downloads", "likes").orderBy(F.desc("downloads"), "id").limit(limit)


def model_files(rows: DataFrame, suffix: str = ".gguf") -> DataFrame:
    """PF4."""
    return rows.filter((F.col("type") == "file") & F.lower("path").endswith(suffix)).orderBy("size", "path")


def first_source(candidates: DataFrame) -> DataFrame:
    """SC3: the archive to open: downloaded before scanned before picked, then by name."""
    rank = F.when(F.col("kind") == "downloaded", 0).when(F.col("kind") == "scanned", 1).otherwise(2)
    return candidates.orderBy(rank, "name").limit(1)


def partial_sizes(files: DataFrame, partials: DataFrame) -> DataFrame:
    """JN8: files with the size of what was downloaded of them, where that is above zero."""
    return files.join(partials, "path", "left").filter(F.coalesce("partial_size", F.lit(0)) > 0)


def download_action(code: Column, have: Column) -> Column:
    """SK5's decision: what to do with a response when have bytes are there already."""
    return F.when(code == 416, "complete").when((code == 206) & (have > 0), "append").when(code.between(200, 299), "restart").otherwise("fail")
