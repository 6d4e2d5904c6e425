"""Generation statistics and progress, in batch form (streaming has the running forms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_second(n: Column, ms: Column) -> Column:
    """SS5: a rate; 0 where the time is unknown or zero."""
    return F.when(F.coalesce(ms, F.lit(0)) > 0, n * 1000.0 / ms).otherwise(0.0)


def generation_rates(done: DataFrame) -> DataFrame:
    return done.withColumns({"turn_rate": per_second(F.col("gen_tokens"), F.col("elapsed_ms")), "prefill_rate": per_second(F.col("prompt_tokens"), F.col("prefill_ms")), "decode_rate": per_second(F.col("gen_tokens"), F.col("decode_ms"))})


def eta_ms(first_ms: Column, now_ms: Column, n: Column, most: Column) -> Column:
    """SS4: milliseconds left at the rate so far; null before the second token."""
    rate = n / (now_ms - first_ms)
    return F.when((n > 1) & (now_ms > first_ms), F.floor((most - n) / rate).cast("long"))


def progress(tokens: DataFrame, most: int, *, by: str = "gen_id", ts_ms: str = "ts_ms") -> DataFrame:
    g = tokens.groupBy(by).agg(F.min(ts_ms).alias("first_ms"), F.max(ts_ms).alias("now_ms"), F.count("*").alias("n"))
    return g.withColumn("eta_ms", eta_ms(F.col("first_ms"), F.col("now_ms"), F.col("n"), F.lit(most)))


def debounced(events: DataFrame, *, by: str, ts_ms: str, quiet_ms: int = 400, order: tuple[str, ...] = ()) -> DataFrame:
    """SS7: events that no other follows within quiet_ms; of a key's events at one time
    the last counts, by the columns of order."""
    gap = F.lead(ts_ms).over(Window.partitionBy(by).orderBy(ts_ms, *order)) - F.col(ts_ms)
    return events.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") >= quiet_ms)).drop("_gap")


def throttled(events: DataFrame, *, by: str, ts_ms: str, every_ms: int = 200) -> DataFrame:
    """SS6: a key's first event, then each that comes over every_ms after the last one
    kept, and its last. A fold over the key's times, in the JVM."""
    times = F.array_sort(F.collect_set(ts_ms))
    kept = F.aggregate("_t", F.array().cast("array<long>"), lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) > every_ms), F.array_append(acc, t)).otherwise(acc))
    g = events.groupBy(by).agg(times.cast("array<long>").alias("_t"))
    return g.select(by, F.explode(F.array_distinct(F.array_append(kept, F.array_max("_t")))).alias(ts_ms))


def latest(events: DataFrame, *, by: str, ts: str, value: str) -> DataFrame:
    """SS9."""
    return events.groupBy(by).agg(F.max_by(value, F.struct(ts, value)).alias(value), F.max(ts).alias(ts))


def benchmark_summary(runs: DataFrame, by: str, ms: str) -> DataFrame:
    """AG10: median and mean of the timed runs."""
    return runs.groupBy(by).agg(F.percentile(ms, F.lit(0.5)).alias("median_ms"), F.avg(ms).alias("mean_ms"))


def acceptance(drafts: DataFrame, by: str, accepted: Column) -> DataFrame:
    """AG11."""
    return drafts.groupBy(by).agg((F.count_if(accepted) / F.count("*")).alias("acceptance"))


def kept_context(tokens: Column, n_ctx: int, reserve: int = 16) -> Column:
    """The last n_ctx - reserve tokens of a prompt."""
    room = n_ctx - reserve
    return F.when(F.size(tokens) > room, F.slice(tokens, F.size(tokens) - room + 1, F.lit(room))).otherwise(tokens)


def with_entry(cells: Column, key: Column, value: Column) -> Column:
    """ST-U5: a map with the key set."""
    return F.map_concat(without_key(cells, key), F.create_map(key, value))


def without_key(cells: Column, key: Column) -> Column:
    return F.map_filter(cells, lambda k, _: k != key)
