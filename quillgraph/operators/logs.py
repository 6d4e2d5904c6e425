"""Log entries: (id, timestamp in ms, level, tag, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.ordered import running_sum, running_sum_by

# The line format, the number of entries and bytes kept, the level letters and the escape.
LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) ([A-Z])/([^:]*): (.*)$"
KEPT, BYTES = 500, 256 * 1024
LEVELS = {"D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR"}
BREAK = "\u0001"


def _stamp(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS")


def formatted(entries: DataFrame, escape: bool = True) -> DataFrame:
    """TX23: entries with line; line breaks in a message are escaped in the file, not in a dump."""
    message = F.replace("message", F.lit("\n"), F.lit(BREAK)) if escape else F.col("message")
    return entries.withColumn("line", F.concat(_stamp(F.col("timestamp")), F.lit(" "), F.substring("level", 1, 1), F.lit("/"), "tag", F.lit(": "), message))


def parsed_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """SC19, TX23: (timestamp, level, tag, message) of the lines that are entries."""
    part = lambda k: F.regexp_extract(line_col, LINE, k)
    level = F.lit(None).cast("string")
    for c, name in LEVELS.items():
        level = F.when(part(2) == c, F.lit(name)).otherwise(level)
    rows = lines.filter(F.col(line_col).rlike(LINE))
    return rows.withColumns({"timestamp": F.unix_millis(F.to_timestamp(part(1), "yyyy-MM-dd HH:mm:ss.SSS")), "level": F.coalesce(level, F.lit("INFO")), "tag": part(3), "message": F.replace(part(4), F.lit(BREAK), F.lit("\n"))}).drop(line_col)


def tail(entries: DataFrame, n: int = KEPT) -> DataFrame:
    """AG8: the last n entries. A top-n, not a sort of all."""
    return entries.orderBy(F.desc("id")).limit(n)


def dumped(entries: DataFrame) -> DataFrame:
    """SK4: (n, line): the lines of all entries, numbered from 1 in the order of their ids."""
    rows = formatted(entries, escape=False).select("id", "line")
    return running_sum(rows, ["id"], F.lit(1), "n").select("n", "line")


def rotated(lines: DataFrame, order_col: str, *, by: str, size: int = BYTES) -> DataFrame:
    """SK3's rotation, for each log by: once its bytes are over size, the last lines
    within the second half of its characters stay. A log is summed over ranges of its lines, whatever its size."""
    held = running_sum_by(lines, by, [order_col], F.length("line") + 1, "_upto")
    totals = lines.groupBy(F.col(by).alias("_log")).agg(F.sum(F.octet_length("line") + 1).alias("_bytes"), F.sum(F.length("line") + 1).alias("_chars"))
    marked = held.join(totals, F.col(by).eqNullSafe(F.col("_log")))
    to_end = F.col("_chars") - F.col("_upto") + F.length("line") + 1
    return marked.filter((F.col("_bytes") <= size) | (to_end <= F.floor(F.col("_chars") / 2))).select(*lines.columns)
