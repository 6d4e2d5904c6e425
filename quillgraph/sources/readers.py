"""Sources: articles, JSON catalogues, chat history, logs and file listings. Schemas
are declared, JSON is read permissively, missing fields are null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.html import parse_pages
from quillgraph.functions.vocab import Profile
from quillgraph.operators import logs

ARTICLES = "path string, title string, html string, is_redirect boolean, redirect_to string"
CONVERSATIONS = "id long, title string, updated_at long, messages array<struct<role:string,text:string>>"
MODELS = "id string, modelId string, likes long, downloads long, tags array<string>, lastModified string"
FILES = "type string, path string, size long, oid string"
SELECTED = "uri string, name string, size long"


def articles(spark: SparkSession, path: str) -> DataFrame:
    """SC1: an archive as a Parquet table of ARTICLES; fails if it is missing."""
    return spark.read.schema(ARTICLES).parquet(path)


def ingested(spark: SparkSession, path: str, profile: Profile, to: str) -> DataFrame:
    """An archive's pages parsed once and written to a table, redirects included."""
    parse_pages(articles(spark, path), profile).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)


def page_rows(pages: DataFrame) -> DataFrame:
    """Raw web pages (page_id, url, html) as articles: the path is the url, the title the page's own."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.select(F.col("url").alias("path"), title.alias("title"), "html", F.lit(False).alias("is_redirect"), F.lit(None).cast("string").alias("redirect_to"))


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """SC18: a JSON array of conversations, most recent first; broken content gives no rows."""
    rows = spark.read.schema(CONVERSATIONS).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.filter("id is not null").orderBy(F.desc("updated_at"), "id")


def models(spark: SparkSession, path: str) -> DataFrame:
    """SC13's rows."""
    return spark.read.schema(MODELS).option("multiLine", True).json(path)


def model_files(spark: SparkSession, path: str) -> DataFrame:
    """SC14's rows."""
    return spark.read.schema(FILES).option("multiLine", True).json(path)


def selected_archives(spark: SparkSession, path: str) -> DataFrame:
    """SK6's rows, one for each uri."""
    return spark.read.schema(SELECTED).option("multiLine", True).json(path).groupBy("uri").agg(F.min_by(F.struct("name", "size"), "name").alias("x")).select("uri", "x.*")


def log_entries(spark: SparkSession, path: str, keep: int = logs.KEPT) -> DataFrame:
    """SC19: the last entries of a log file; other lines are left out."""
    rows = logs.parsed_lines(spark.read.text(path).withColumnRenamed("value", "line"))
    return rows.orderBy(F.desc("timestamp")).limit(keep)


def archive_files(spark: SparkSession, roots: list[str], suffix: str = "zim") -> DataFrame:
    """SC15, SC16, GR4: (path, name, size) of archives under the roots, whatever the
    case of the suffix, each path once, by name. Contents are not read."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    rows = None
    for root in roots:
        got = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
        rows = got if rows is None else rows.union(got)
    return rows.groupBy("path").agg(F.max("size").alias("size")).withColumn("name", F.substring_index("path", "/", -1)).orderBy("name", "path")


def local_models(spark: SparkSession, root: str, skip: str = "rerank") -> DataFrame:
    """SC17: model files two folders down (author/model/file), by id."""
    rows = archive_files(spark, [root], "gguf")
    part = F.split("path", "/")
    rows = rows.withColumns({"author": F.element_at(part, -3), "model": F.element_at(part, -2)})
    return rows.filter(~F.lower("name").contains(skip)).withColumn("id", F.concat_ws("/", "author", "model", "name")).orderBy("id")
