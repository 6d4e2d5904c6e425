"""Structured Streaming forms: token streams, transcripts, progress, throttles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgraph.functions.text import visible_answer

EVENTS = "gen_id long, seq int, ts timestamp, bytes binary, done boolean"
#: Groups that the generations of a token stream are dealt into.
BUCKETS = 2_048


def complete_prefix(data: bytes) -> int:
    """TX22: the length of the longest beginning that ends with a whole UTF-8 character."""
    for back in range(1, min(4, len(data)) + 1):
        b = data[-back]
        if b & 0xC0 != 0x80:
            need = 1 if b < 0x80 else 2 if b >> 5 == 6 else 3 if b >> 4 == 14 else 4 if b >> 3 == 30 else 1
            return len(data) if back >= need else len(data) - back
    return len(data)


def reassembled(chunks: DataFrame) -> DataFrame:
    """SS1, SS2: (gen_id, seq, piece) of a stream of EVENTS: each chunk's whole characters,
    bytes of a character that is cut off held back for the next chunk. What is left
    at the end of a generation (done) is dropped. Generations are dealt into BUCKETS by a hash, and a bucket is
    one group: a call for each generation would cost far more than its chunks do. State: the id and at most
    3 bytes of each generation that has some held back."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        ids = rows["gen_id"].tolist() if key[0] >= 0 else [None] * len(rows)
        out, over = [], set()
        for gen, seq, more, done in zip(ids, rows["seq"].tolist(), rows["bytes"].tolist(), rows["done"].tolist(), strict=True):
            data = bytes(held.pop(gen, b"")) + (bytes(more) if more is not None else b"")
            cut = complete_prefix(data)
            if cut < len(data):
                held[gen] = data[cut:]
            if cut:
                out.append((gen, seq, data[:cut].decode("utf-8", "replace")))
            if done:
                over.add(gen)
        for gen in over:
            held.pop(gen, None)
        if held:
            state.update((list(held), list(held.values())))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["gen_id", "seq", "piece"])

    # ids that are null are apart, since among others they would turn whole numbers into floats
    bucket = F.when(F.col("gen_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("gen_id"), F.lit(BUCKETS)).cast("int"))
    return chunks.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(run, "gen_id long, seq int, piece string", "ids array<long>, held array<binary>", "append", GroupStateTimeout.NoTimeout)


def transcripts(pieces: DataFrame) -> DataFrame:
    """SS3: each generation's answer so far, its reasoning left out. Update mode."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        so_far = state.get[0] if state.exists else ""
        rows = pd.concat(list(frames)).sort_values("seq")
        so_far += "".join(rows["piece"])
        state.update((so_far,))
        yield pd.DataFrame({"gen_id": [key[0]], "raw": [so_far]})

    told = pieces.groupBy("gen_id").applyInPandasWithState(run, "gen_id long, raw string", "raw string", "update", GroupStateTimeout.NoTimeout)
    return told.select("gen_id", visible_answer(F.col("raw")).alias("text"))


def running_progress(tokens: DataFrame, most: int, *, by: str = "gen_id", ts: str = "ts") -> DataFrame:
    """SS4: tokens so far, and milliseconds left. Update mode."""
    ms = F.unix_millis(ts)
    g = tokens.groupBy(by).agg(F.min(ms).alias("first_ms"), F.max(ms).alias("now_ms"), F.count("*").alias("n"))
    rate = F.col("n") / (F.col("now_ms") - F.col("first_ms"))
    return g.withColumn("eta_ms", F.when((F.col("n") > 1) & (F.col("now_ms") > F.col("first_ms")), F.floor((F.lit(most) - F.col("n")) / rate).cast("long")))


def running_latest(events: DataFrame, *, by: str, ts: str, value: str) -> DataFrame:
    """SS9: the latest value of each key. Update mode."""
    return events.groupBy(by).agg(F.max_by(value, F.struct(ts, value)).alias(value), F.max(ts).alias(ts))


def running_throttle(events: DataFrame, *, by: str, ts_ms: str, last: Column, every_ms: int = 200) -> DataFrame:
    """SS6: a key's first event, each over every_ms after the last one let through, and
    the one marked last. Events of a key are taken in time order within a batch."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(frames)).sort_values("ts_ms").itertuples():
            if before is None or r.ts_ms - before > every_ms or r.final:
                out.append((key[0], r.ts_ms))
                before = r.ts_ms
        state.update((before,))
        yield pd.DataFrame(out, columns=[by, ts_ms])

    kind = events.schema[by].dataType.simpleString()
    rows = events.select(by, F.col(ts_ms).alias("ts_ms"), last.alias("final"))
    return rows.groupBy(by).applyInPandasWithState(run, f"{by} {kind}, {ts_ms} long", "before long", "append", GroupStateTimeout.NoTimeout)


def running_debounce(events: DataFrame, *, by: str, ts: str, value: str, quiet_ms: int = 400, late: str = "1 second") -> DataFrame:
    """SS7: the latest value of a key once quiet_ms have passed without another, by
    event time: a session of that gap closes behind the watermark."""
    gap = F.session_window(ts, f"{quiet_ms} milliseconds")
    return events.withWatermark(ts, late).groupBy(gap, by).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts)).select(by, value, ts)


def download_events(events: DataFrame) -> DataFrame:
    """Download progress: (id, kind, done, total, ratio) of a stream of tagged rows."""
    ratio = F.when(F.col("total") > 0, F.col("done") / F.col("total")).otherwise(0.0)
    return events.filter(F.col("kind").isin("progress", "done", "failed")).withColumn("ratio", ratio)


def sampled_clock(spark, every: str = "2 seconds") -> DataFrame:
    """SS10: a tick for each interval, to join readings to."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().withWatermark("timestamp", every).groupBy(F.window("timestamp", every)).count()


def stop_all(spark) -> None:
    """SS8: cancel what runs: streams, and jobs of the current group."""
    for q in spark.streams.active:
        q.stop()
    spark.sparkContext.cancelAllJobs()
