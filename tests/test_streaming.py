import datetime

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.streaming import running


@given(st.text(max_size=30), st.lists(st.integers(0, 60), max_size=6))
def test_any_cut_reassembles(text, cuts):
    data = text.encode()
    cuts = sorted({min(c, len(data)) for c in cuts} | {0, len(data)})
    held, out = b"", ""
    for a, b in zip(cuts, cuts[1:], strict=False):
        held += data[a:b]
        n = running.complete_prefix(held)
        out, held = out + held[:n].decode(), held[n:]
    assert out == text and held == b""


def test_prefix_goldens():
    assert [running.complete_prefix(x) for x in (b"\xd0", b"\x41\xd0", b"\xd0\x96", b"")] == [0, 1, 2, 0]


def run(spark, tmp_path, rows, schema, build, mode):
    src = str(tmp_path / "in")
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{src}/b={k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = build(stream).writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    return spark.table("out").collect()


def test_tokens_to_transcript(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    data = "Жук <think>x</think>ok".encode()
    parts = [[(1, 0, t, data[:1], False)], [(1, 1, t, data[1:9], False)], [(1, 2, t, data[9:], False), (2, 0, t, b"a\xd0", True)]]
    got = run(spark, tmp_path, parts, running.EVENTS, running.reassembled, "append")
    whole = {g: "".join(r["piece"] for r in sorted(got, key=lambda r: r["seq"]) if r["gen_id"] == g) for g in (1, 2)}
    assert whole == {1: data.decode(), 2: "a"}


def test_generations_share_their_state(spark, tmp_path, monkeypatch):
    """No group for each generation: 300 of them, each cut within a character, leave 8 rows of state."""
    monkeypatch.setattr(running, "BUCKETS", 8, raising=False)
    t = datetime.datetime(2024, 1, 1)
    big = 2**60
    data = {big + k: f"Ж{k}ёж".encode() for k in range(300)}
    parts = [[(g, 0, t, d[:-3], False) for g, d in data.items()] + [(None, 0, t, b"a\xd0", False)], [(g, 1, t, d[-3:], g % 2 == 0) for g, d in data.items()] + [(None, 1, t, b"\x96", True)]]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, running.EVENTS).write.parquet(f"{src}/b={k}")
        stream = running.reassembled(spark.readStream.schema(running.EVENTS).parquet(f"{src}/*"))
        q = stream.writeStream.format("parquet").option("path", out).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.awaitTermination()
        rows.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    whole = {}
    for r in sorted(spark.read.parquet(out).collect(), key=lambda r: r["seq"]):
        whole[r["gen_id"]] = whole.get(r["gen_id"], "") + r["piece"]
    assert whole == {g: d.decode() for g, d in data.items()} | {None: "aЖ"}
    assert rows == [9, 0]


def test_progress_and_latest_match_batch(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(k % 3, t + datetime.timedelta(milliseconds=100 * k), f"v{k}") for k in range(30)]
    schema = "gen_id int, ts timestamp, v string"
    batch = spark.createDataFrame(rows, schema)
    got = run(spark, tmp_path, [rows[:10], rows[10:]], schema, lambda s: running.running_latest(s, by="gen_id", ts="ts", value="v"), "complete")
    want = batch.groupBy("gen_id").agg(F.max_by("v", "ts").alias("v")).collect()
    assert {r["gen_id"]: r["v"] for r in got} == {r["gen_id"]: r["v"] for r in want}


def test_throttle(spark, tmp_path):
    rows = [("a", 0, False), ("a", 150, False), ("a", 300, False), ("a", 350, True)]
    got = run(spark, tmp_path, [rows[:2], rows[2:]], "id string, ms long, final boolean", lambda s: running.running_throttle(s, by="id", ts_ms="ms", last=F.col("final")), "append")
    assert sorted(r["ms"] for r in got) == [0, 300, 350]


def test_debounce(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    at = lambda ms, v: ("a", t + datetime.timedelta(milliseconds=ms), v)
    rows = [[at(0, "x"), at(100, "y")], [at(1000, "z")], [at(60000, "w")], [at(120000, "v")]]
    got = run(spark, tmp_path, rows, "id string, ts timestamp, v string", lambda s: running.running_debounce(s, by="id", ts="ts", value="v"), "append")
    assert {"y", "z"} <= {r["v"] for r in got} <= {"y", "z", "w"}
