import hashlib
import inspect
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from quillgraph.llm import bpe, common, contamination, ctw, line_dedup, near_copies, pii, simhash, substring, topk, toxicity, url_filter  # noqa: E402
from quillgraph.llm.queries import tokenizer_path  # noqa: E402

RNG = random.Random(3)
WORDS = "the cat Sat on a mat and então ñandú was über there with some small dogs under old trees".split()


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


LINE = "this line stands in Several documents"
PASSAGE = prose(60)
BASE = prose(150)
TEXTS = [
    None, "", " \t\n", "one", prose(30) + "\n" + LINE, LINE + "\n" + LINE, "  " + LINE.upper() + "\t\n" + prose(5), "é" * 20 + "\nx", "é" * 20, "é" * 20 + "\n",
    PASSAGE, "intro " + PASSAGE + " end", PASSAGE + " " + PASSAGE, BASE, BASE, BASE.replace("cat", "dog", 1), "same same same " * 40, prose(3000), "a\x0bb\x1cc\u00a0d  e", "tail\n\n\n",
]
ROWS = [(k, t) for k, t in enumerate(TEXTS)] + [(None, PASSAGE), (None, LINE), (4, TEXTS[4]), (5, "again " + PASSAGE), (100, PASSAGE + "\n" + LINE)]
SCHEMA = "doc_id long, text string"


def frame(spark, rows=ROWS):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, 2.0, None) for r in rows], SCHEMA + ", key string, n_lines int, score double, id long").repartition(3)


def sha(c):
    return F.sha2(c.cast("binary"), 256)


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


def test_line_dedup(spark):
    out = line_dedup.dedup_lines(frame(spark))
    assert set(out.columns) == {"doc_id", "text", "key", "n_lines", "score", "id", "n_dropped"}
    same(out.select("doc_id", "n_lines", "n_dropped", sha(F.col("text"))).collect(), brute.lines(ROWS))


def test_fingerprints_and_groups(spark):
    got = simhash.near_groups(frame(spark))
    rows = [r for r in got.collect()]
    assert len(rows) == len(ROWS)
    unique = {k: t for k, t in ROWS if k is not None and k != 5 and k != 4}
    want = brute.groups(list(unique.items()))
    for r in rows:
        if r["doc_id"] in unique:
            assert r["fingerprint"] == want[r["doc_id"]][0]
        if r["doc_id"] is None:
            assert r["component_id"] is None
    assert {r["doc_id"]: r["component_id"] for r in rows}[14] == 13


@pytest.mark.parametrize(("radius", "bits"), [(3, 2), (1, 4), (0, 2), (5, 2)])
def test_grid_finds_every_link(spark, radius, bits):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, k, replace=False)) for b in base for k in range(1, 7)]
    fps = sorted({*(int(b) for b in base), *near})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = {frozenset((r["x"] & (2**64 - 1), r["y"] & (2**64 - 1))) for r in simhash.grid_links(df, radius, bits).collect()}
    assert got == {frozenset((a, b)) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= radius}


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components(spark, few):
    edges = [(k, k + 1) for k in range(20)] + [(30, 40), (40, 35), (50, 50)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    assert got == {**{k: 0 for k in range(21)}, 30: 30, 35: 30, 40: 30}


def edited(text, n, rng):
    w = text.split()
    for p in rng.sample(range(len(w)), n):
        w[p] = "z" + w[p]
    return " ".join(w)


def test_near_copies_at_a_similarity_of_08(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(3000)]
    bases = [" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(bases)] + [(100 + k, edited(t, 3, rng)) for k, t in enumerate(bases)] + [(200, None), (201, ""), (None, bases[0])]
    out = near_copies.one_of_each(frame(spark, rows))
    kept = [r["doc_id"] for r in out.collect()]
    assert set(range(40)) | {200, None} <= set(kept) and 201 not in kept
    assert sum(k is not None and 100 <= k < 200 for k in kept) <= 2
    assert out.columns == frame(spark, rows).columns


def test_near_copies_are_verified(spark):
    """Texts of similarity 0.65 to 0.78 stay, though many fingerprints lie within the radius; those just above 0.8 go."""
    def similarity(x, y):
        x, y = set(simhash.shingles(x.encode(), 5)), set(simhash.shingles(y.encode(), 5))
        return len(x & y) / len(x | y)

    rng = random.Random(2)
    bases = {k: " ".join(f"w{rng.randrange(3000)}" for _ in range(300)) for k in range(60)}
    far = {100 + k: edited(t, 9 if k % 2 else 12, rng) for k, t in bases.items()}
    near = {200 + k: edited(t, 5, rng) for k, t in bases.items()}
    assert all(0.6 < similarity(bases[k], far[100 + k]) < 0.8 < similarity(bases[k], near[200 + k]) for k in bases)
    kept = {r["doc_id"] for r in near_copies.one_of_each(frame(spark, list((bases | far | near).items()))).collect()}
    assert set(bases) | set(far) <= kept and len(kept & set(near)) <= 3


@pytest.mark.parametrize("n", [10_000, 250_000, 2_000_000])
def test_tables_find_pairs_at_the_limit(n):
    rng = np.random.default_rng(9)
    options = {k: v.default for k, v in inspect.signature(near_copies.near_copy_groups).parameters.items()}
    k, count = near_copies.tables(n, options["miss"], options["radius"])
    a = rng.integers(0, 2, (2000, near_copies.SEGMENTS, 2))
    flips = rng.random(a.shape) < 0.1515  # a similarity of 0.8
    same = a.sum(axis=2) == (a ^ flips).sum(axis=2)
    met = np.zeros(len(a), bool)
    for _ in range(count):
        met |= same[:, rng.choice(near_copies.SEGMENTS, k, replace=False)].all(axis=1)
    assert (met & (flips.sum(axis=(1, 2)) <= options["radius"])).mean() > 0.95


def test_cells_of_any_size_keep_their_groups():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, (3, near_copies.WORDS), dtype=np.uint64)
    fps = np.concatenate([np.repeat(c[None], 40, 0) ^ (np.uint64(1) << rng.integers(0, 64, (40, 1)).astype(np.uint64)) for c in centre])
    order = rng.permutation(120)
    a, b = near_copies.cell_links(np.zeros(120, np.int64), fps[order], order, 8)
    parent = list(range(120))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        parent = [min(parent[x], parent[y]) if p in (parent[x], parent[y]) else p for p in parent]
    assert [len({parent[k] for k in range(g * 40, g * 40 + 40)}) for g in range(3)] == [1, 1, 1] and len(set(parent)) == 3


ITEMS = [(0, PASSAGE), (1, " ".join(PASSAGE.split()[:20])), (2, "one"), (3, None), (4, ""), (5, "Small Dogs, under!"), (None, "one"), (6, PASSAGE), (7, " ".join(PASSAGE.split()[:-4] + ["x"] * 4)), (2, "one")]


def test_contamination(spark):
    items = spark.createDataFrame([(*r, "c") for r in ITEMS], "item_id long, text string, doc_id string")
    got = contamination.contained_items(frame(spark), items).collect()
    assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in got} == brute.contained(ROWS, ITEMS) and len(got) == len(brute.contained(ROWS, ITEMS))


def test_contamination_without_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.contained_items(frame(spark), none).count() == 0


def test_substrings(spark):
    got = substring.dedup_substrings(frame(spark)).select("doc_id", "n_words", "n_removed", sha(F.col("text"))).collect()
    same(got, brute.substrings(ROWS))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=6))
def test_substrings_of_two_words(spark, texts):
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = substring.dedup_substrings(spark.createDataFrame(rows, SCHEMA), window=8, levels=2)
    same(got.select("doc_id", "n_words", "n_removed", sha(F.col("text"))).collect(), brute.substrings(rows, 8))


def test_very_long_texts(spark):
    """A text of some megabytes with a word longer than a chunk, beside short ones."""
    rng = random.Random(12)
    vocabulary = [f"v{k}" for k in range(5000)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    long = " ".join([passage, *(rng.choice(vocabulary) for _ in range(400_000)), "w" * (substring.CHUNK + 5), passage, "\n" + LINE + "\n"])
    rows = [(1, passage), (2, long), (3, LINE), (4, "x\n" + LINE)]
    df = spark.createDataFrame(rows, SCHEMA)
    same(substring.dedup_substrings(df).select("doc_id", "n_words", "n_removed", sha(F.col("text"))).collect(), brute.substrings(rows))
    same(line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", sha(F.col("text"))).collect(), brute.lines(rows))
    assert {r["doc_id"]: r["fingerprint"] for r in simhash.near_groups(df).collect()} == {i: f"{brute.fingerprint(t):016x}" for i, t in rows}
    assert {r["doc_id"]: r["decoded"] for r in bpe.encode_documents(df, tokenizer_path()).collect()} == dict(rows)
    base = {i: b for i, _, _, _, _, b in brute.unigram(rows)}
    assert all(r["base_score"] == pytest.approx(base[r["doc_id"]]) and r["score"] < 0 for r in ctw.score_documents(df, depth=2).collect())
    assert {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, b"k").collect()} == dict(rows)
    assert {r["doc_id"] for r in near_copies.near_copy_groups(df).collect()} == {1, 2, 3, 4}
    items = spark.createDataFrame([(9, passage)], "item_id long, text string")
    assert {r["doc_id"] for r in contamination.contained_items(df, items).collect()} == {1, 2}


def test_word_hashes_tell_words_apart():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab\u00e9") for _ in range(rng.randrange(1, 9))) for _ in range(20_000)})
    text = " ".join(words * 2).encode()
    c = substring.Chunk([(1, text)], 5, 20)
    for which in (0, 1):
        c.at(20, which)
        h = c.hashes[which]
        assert len(set(h.tolist())) == len(words) and (h[: len(words)] == h[len(words) :]).all()


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    extra = [(200, "x<|endoftext|> y <|endoftext|>"), (201, "日本語 \u2003 emoji 😀😀 don't  \n\n 12٣"), (202, "\x1c\x85 a\u0301"), (203, "<|endoftext")]
    tok = Tokenizer.from_file(tokenizer_path())
    got = bpe.encode_documents(frame(spark, ROWS + extra), tokenizer_path()).collect()
    want = []
    for i, t in ROWS + extra:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), tok.decode(ids, skip_special_tokens=False)))
    same([(r["doc_id"], r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest(), r["decoded"]) for r in got], want)
    assert all(r["decoded"] == (t or "") for r, (_, t) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["decoded"])), sorted(ROWS + extra, key=lambda r: (r[0] is None, r[0], r[1] or "")), strict=True))


@settings(deadline=None)
@given(st.text(max_size=40))
def test_split_is_the_librarys(text):
    tok = bpe.tokenizer(tokenizer_path())
    if "<|endoftext|>" not in text:
        assert list(bpe.split(text, tokenizer_path())) == [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]


URLS = [None, "", "no scheme", "http://", "http://A.Example.com/en/7x?q", "https://example.com/en/8#y", "http://com/en/", "http://xcom/en/", "http://a.net/de/8", "http://example.net/de/8", "http://b.org/es/?x", "http://b.org?x=/es/", "x://y://z", "http://a.com:80/en/", "http://adult-x.example.org/fr/", "http://shop.example.net/de/casino", "http://h.com/EN/", "http://b.org/es/\nline"]


def test_urls(spark):
    rows = [(k, u, "h") for k, u in enumerate(URLS)] + [(None, "http://q.com/en/1", "r"), (3, "http://", "again"), (3, "http://", "again")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, rule string")).collect()
    assert len(got) == len(rows)
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    import re

    def judged(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        words = set(re.split(r"[^a-z0-9]+", (host + path).lower()))
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if words & {"adult", "casino"} else "allow"

    same(got, [(i, *judged(u)) for i, u, _ in rows])


def test_tokens_are_read_off_patterns():
    tokens = url_filter.pattern_tokens
    assert tokens(r"/wp-login\.php$") == ("wp", "login", "php") and tokens(r"^ads\.") == ("ads",) and tokens("ads") == () and tokens(r"/ads") == ()
    assert tokens(r"/a(?:b|c)d/") == () and tokens(r"(?:^|/)x1(/)y(?:[^a-zA-Z0-9]|$)") == ("x1", "y") and tokens(r"/a\W") == () and tokens(r"/ab?/") == ()
    assert tokens(r"/Foo[/.]bar[^/]") == ("foo",) and tokens(r"[a-z]ads/") == () and tokens(r"\bads\b") == () and tokens(r"-ads[-_]+x/") == ("ads", "x")


def test_hundreds_of_url_rules(spark):
    import re

    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ad", "track", "shop", "news", "img", "x") for b in range(8)]
    forms = [lambda a, b: rf"(?:^|\.){a}\.", lambda a, b: rf"/{a}/{b}/", lambda a, b: rf"/{a}[-_]{b}(?:[^a-zA-Z0-9]|$)", lambda a, b: rf"{a}{b}", lambda a, b: rf"/{a}(?:{b}|y)/", lambda a, b: rf"^{a}\.[a-z]+/"]
    rules = tuple(url_filter.pattern_rule(rng.choice(forms)(rng.choice(words), rng.choice(words)), rng.choice(["block", "allow"])) for _ in range(400))
    assert sum(bool(r.tokens) for r in rules) > 200
    urls = [(k, "http://" + ".".join(rng.choice(words) for _ in range(2)) + ".com/" + "".join(rng.choice(words) + rng.choice("/-_.") for _ in range(rng.randrange(5)))) for k in range(300)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), listed=(), patterns=rules).collect()}
    for i, u in urls:
        fits = [(len(r.text), -k, r.verdict) for k, r in enumerate(rules) if re.search(r.regex, u.removeprefix("http://"))]
        assert got[i] == (max(fits)[2] if fits else "allow")


def test_url_rules_without_tokens(spark):
    every = url_filter.Rule("all", "block", "^.*$", ())
    df = spark.createDataFrame([(1, "http://a/"), (2, None)], "page_id long, url string")
    got = url_filter.judge_urls(df, listed=(every, every), patterns=()).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in got) == [(1, "block"), (2, "block")]


def vectors(n=300, d=6):
    rng = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(n, d)))]
    rows += [(20, None), (40, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1000, [float("nan")] * d), (1001, [float("inf")] * d), (None, [0.0] * d), (2000, [0.0] * d), (2020, [1.0, 2.0]), (2021, [3.0, 4.0]), (2040, []), (2041, [])]
    rows += [(5000 + k, rows[7][1]) for k in range(30)]
    return [r for k, r in enumerate(rows) if k not in (20, 40)]  # their other rows take no part


@pytest.mark.parametrize(("shard", "block"), [(16384, 2048), (50, 4)])
def test_top(spark, shard, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    wide = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {tuple(r) for r in topk.top_inner(df, shard=shard, block=block).collect()}
    assert got == brute.top(wide)


def test_threshold_stops_early():
    matrix = np.zeros((10000, 3), np.int64)
    matrix[:, 0] = np.arange(10000)
    lists = topk.Lists(matrix, np.arange(10000), 5)
    assert lists.best(np.array([5, 0, 0]), -1, 3) == [(49995, 9999), (49990, 9998), (49985, 9997)]
    assert lists.scored == topk.FIRST


@pytest.mark.parametrize("seed", range(4))
def test_only_shown_rows_are_scored(seed):
    """Rows of few large components: the bound is beaten long before the lists end."""
    rng = np.random.default_rng(seed)
    matrix = (rng.pareto(1.2, (8000, 4)) * 20).astype(np.int64) * rng.choice([-1, 1], (8000, 4))
    lists = topk.Lists(matrix, np.arange(8000), 100)
    for _ in range(20):
        query = rng.integers(-50, 50, 4)
        want = sorted(((int(s), -k) for k, s in enumerate(matrix @ query)), reverse=True)[:5]
        assert lists.best(query, -1, 5) == [(s, -k) for s, k in want]
    assert lists.scored < 20 * 8000 / 4


def test_top_of_any_finite_components(spark):
    big = [(0, [3e5, 0.0]), (1, [4e5, 1.0]), (2, [-4e5, 2.0]), (3, [1e300, 1.0]), (4, [1.7e308, 0.5]), (5, [-1.7e308, 0.5]), (6, [0.5, 0.25]), (20, [1e300, -1e300]), (40, [1.7e308, 1.0]), (60, [0.0, 0.0]), (7, [3e15, 1 / 64]), (80, [1 / 64, 3e15])]
    got = {tuple(r) for r in topk.top_inner(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()}
    assert got == brute.top(big) and (0, 2, 40, (1 << 63) - 1) in got


def test_unlike_queries_of_one_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])]
    got = sorted(tuple(r) for r in topk.top_inner(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 1, 1, 8192), (0, 1, 2, 12288), (0, 2, 1, 4096), (0, 2, 2, 4096)]


def test_lm_scores(spark):
    rows = ROWS + [(300 + k, prose(20)) for k in range(20)]
    got = ctw.score_documents(frame(spark, rows), depth=3).collect()
    key = lambda r: (r[0] is None, r[0], r[2], round(r[5], 6))
    mine = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    for a, b in zip(mine, sorted(brute.unigram(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
    order = lambda r: (r[0] is None, r[0], r[1])
    for a, b in zip(sorted(((r["doc_id"], r["score"]) for r in got), key=order), sorted(brute.context_tree(rows, 3), key=order), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-9)


def test_lm_without_training_text(spark):
    rows = [(i, "a b") for i in range(200) if brute.held(i, 10) == 0]
    got = ctw.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["train_tokens"] == 0 and r["bits_per_byte"] == pytest.approx(8) for r in got) and len(got) == len(rows)


TOXIC = [(k, prose(40) + (" you utter dumbhead" if k % 3 == 0 else "")) for k in range(400)]


def model(spark):
    docs = spark.createDataFrame([(i, f"{t} n{i} m{i * 7}") for i, t in TOXIC], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in TOXIC] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, toxicity.fit(docs, labels)


def test_toxicity(spark):
    docs, m = model(spark)
    assert "dumbhead" in m.terms
    rows = [(1, "a dumbhead"), (2, "a dumbheed here"), (3, "a dumbxxxd"), (4, None), (5, ""), (6, "a d0mbh3ad"), (7, prose(50))]
    out = toxicity.score_documents(frame(spark, rows), m)
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i: r["predicted"] for i, r in got.items() if i in (1, 3, 4, 5, 7)} == {1: 1, 3: 0, 4: 0, 5: 0, 7: 0}
    assert got[1]["score"] > got[2]["score"] > got[3]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    held = toxicity.score_documents(docs.filter(common.crc_fold(F.col("doc_id"), 4) == 2), m).collect()
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) / len(held) > 0.95


def test_toxicity_keeps_the_class_mix_of_the_labels(spark):
    """A tenth is toxic, and no word tells it: a capped sample scores as the whole does."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, " ".join(rng.choice(WORDS) for _ in range(12))) for k in range(800)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(800)], "doc_id long, toxic int")
    plain = docs.sparkSession.createDataFrame([(1, "the cat")], "doc_id long, text string")
    whole, capped = (toxicity.score_documents(plain, toxicity.fit(docs, labels, fit_rows=n)).head() for n in (40_000, 100))
    assert abs(whole["score"] - 0.1) < 0.05 and abs(capped["score"] - 0.1) < 0.05
    assert whole["predicted"] == capped["predicted"] == 0


def test_scores_are_those_of_a_plain_scorer(spark):
    docs, m = model(spark)
    rng = random.Random(3)
    words = [*(t.rstrip("*") for t in m.terms), "dumbheed", "dumbhed", "d0mbh3ad", "the", "he", "said", '"', "ut", "utterly"]
    m = toxicity.Model(m.terms | {"utter*": 3.5, "dumb*": 2.0}, frozenset({"dumbheads"}), (-2.0, 1.1, 0.4, 0.6, 0.25, 0.2, 0.3, 0.7))
    rows = [(k, " ".join(rng.choice(words) + rng.choice(["", "", "s", "x"]) for _ in range(rng.randrange(14)))) for k in range(300)]
    got = {r["doc_id"]: r for r in toxicity.score_documents(spark.createDataFrame(rows, SCHEMA), m).collect()}
    for i, t in rows:
        want = brute.toxicity(t, m, toxicity.QUOTES, toxicity.REPORTING, toxicity.LEET, toxicity.TOKEN)
        assert got[i]["score"] == pytest.approx(want) and got[i]["predicted"] == int(want >= 0.3)


def test_windows_reach_misspelled_hits(spark):
    _, m = model(spark)
    scorer = toxicity.Scorer(m)
    for direct, told in (("you dumbhad you", "he said dumbheed to me"), ("you dumbhead you", "he said dumbhead to me"), ("so dumbhad", 'so "dumbhad"'), ("so dumbhead", "«so dumbhead»")):
        assert scorer.score(direct) > scorer.score(told)
    told = scorer.features("he said dumbheed, a dumbhead, to me")[0]
    assert dict(zip(toxicity.FEATURES, told > 0, strict=True)) == {x: x in ("bias", "quoted", "fuzzy_quoted") for x in toxicity.FEATURES}


def test_fit_equals_a_plain_one(spark):
    """The lexicon by plain loops over whole texts; at the weights no step lowers the penalised loss."""
    rng = random.Random(12)
    stock = [f"v{k}" for k in range(60)]
    rows = []
    for k in range(600):
        toxic = int(k % 4 == 0)
        own = [rng.choice(stock) for _ in range(12)] + [f"id{k}"]
        own += rng.sample(["dumbhead", "grobian", "insultare", "insultado", "insultos", "insultante"], 2) if toxic and k % 8 else []
        own += ["dumbhead"] if k % 97 == 1 else []
        own += ["grobion"] if not toxic and k % 31 == 0 else []
        rng.shuffle(own)
        rows.append((k, " ".join(own), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], SCHEMA)
    m = toxicity.fit(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"))
    learnt = [(t, y) for i, t, y in rows if brute.held(i, 4) != 2]
    want = brute.lexicon(learnt, toxicity.TOKEN)
    assert m.terms == pytest.approx(want) and "insul*" in m.terms or "insu*" in m.terms
    assert "grobion" in m.exceptions
    x = np.array([toxicity.Scorer(m).features(t)[0] for t, _ in learnt])
    y, w = np.array([y for _, y in learnt]), np.array(m.weights)

    def loss(w):
        z = x @ w
        penalty = np.full(len(w), 1.0)
        penalty[0] = 1e-3
        return (np.log1p(np.exp(z)) - y * z).sum() + (penalty * (w - toxicity.PRIOR) ** 2).sum() / 2

    assert all(loss(w + step) >= loss(w) - 1e-9 for k in range(len(w)) for step in (np.eye(len(w))[k] * 1e-3, -np.eye(len(w))[k] * 1e-3))


def test_repeated_documents_do_not_change_the_terms(spark):
    docs, m = model(spark)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    twice = toxicity.fit(docs.union(docs), labels.union(labels))
    assert "dumbhead" in twice.terms and toxicity.score_documents(docs.union(docs), twice).count() == 2 * docs.count()


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame(TOXIC[:5], SCHEMA)
    m = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score_documents(docs, m).collect()} == {0}


@given(st.text("abc", max_size=7), st.lists(st.text("abc", min_size=5, max_size=7), min_size=1, max_size=4))
def test_automaton_accepts_one_edit(word, terms):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    found = toxicity.Automaton(dict.fromkeys(terms, 1.0)).match(word)
    least = min(distance(word, t) for t in terms)
    assert (found is not None) == (least <= 1)
    assert found is None or (found[0] == "word") == (least == 0)


VALUES = ["4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "2024-02-29", "31/12/1999", "12/31/1999", "078-05-1120", "+1 (017) 555-7713", "10.0.0.1", "a.B9@x.example.com", "5 March 2021", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"]


def test_pseudonyms(spark):
    texts = [f"see {v}, and {v} again" for v in VALUES] + ["4111111111111112 2024-02-30 999.1.1.1", "", None, "no value"]
    df = frame(spark, list(enumerate(texts)))
    out = pii.pseudonymise(df, b"k")
    got = {r["doc_id"]: r for r in out.collect()}
    for k, v in enumerate(VALUES):
        assert got[k]["n_replaced"] == 2 and v not in got[k]["text"]
        a, b = got[k]["text"].removeprefix("see ").removesuffix(" again").split(", and ")
        shape = lambda s: "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in s)
        assert a == b and (k in (7, 9, 10) or shape(a) == shape(v))
    assert [got[k]["text"] for k in range(len(VALUES), len(texts))] == texts[len(VALUES) :]
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(out, b"k", backwards=True).collect()}
    assert back == dict(enumerate(texts))


def test_values_beside_other_numbers():
    card, iban = "4111111111111111", "GB82 WEST 1234 5698 7654 32"
    texts = [f"pay {card} 12/27", "pay 4111 1111 1111 1111 123", f"7 {card}", f"123456 789 {card} 12", f"{card} 378282246310005 1234", f"to {iban} BIC", f"XY12 {iban} AB", f"{iban} {iban}"]
    for k in range(40):
        f = pii.Feistel(b"%d" % k)
        for text in texts:
            new, kinds = pii.pseudonymised(text, f)
            assert kinds and card not in new and "4111 1111 1111 1111" not in new and iban not in new
            assert pii.pseudonymised(new, f, backwards=True) == (text, kinds)
    assert pii.pseudonymised("4111111111111112 12", f) == ("4111111111111112 12", [])


def test_values_in_other_digits_are_left_alone(spark):
    texts = ["pay \u0664111 1111 1111 1111 now", "\u0662\u0660\u0662\u0664-01-05", "5 March \u0662\u0660\u0662\u0661", "\u0661\u0662\u0663-45-6789", "x" * 3_000_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, None)]
    out = pii.pseudonymise(frame(spark, rows), b"k")
    assert Counter((r["doc_id"], r["text"], r["n_replaced"], r["n_lines"]) for r in out.collect()) == Counter((i, t, 0, 1) for i, t in rows)


def test_a_date_has_one_pseudonym():
    import datetime

    months = "January February March April May June July August September October November December".split()
    for k in range(30):
        f = pii.Feistel(b"%d" % k)
        for d in (datetime.date(2024, 1, 5), datetime.date(2024, 2, 29), datetime.date(1999, 12, 31), datetime.date(2021, 5, 11), datetime.date(1900, 1, 13)):
            name = months[d.month - 1]
            ways = [f"{d:%Y-%m-%d}", f"{d:%Y/%m/%d}", f"{d.day}/{d.month}/{d.year}", f"{d:%d.%m.%Y}", f"{d.day} {name} {d.year}", f"{d:%d} {name.upper()} {d.year}", f"{name} {d.day}, {d.year}", f"{name[:3].lower()} {d.day} {d.year}"]
            if d.day > 12:
                ways += [f"{d:%m/%d/%Y}"]
            new = [pii.pseudonymised(f"on {w}.", f) for w in ways]
            assert all(kinds for _, kinds in new) and [pii.pseudonymised(t, f, True)[0] for t, _ in new] == [f"on {w}." for w in ways]
            image = datetime.date.fromisoformat(new[0][0][3:-1])
            assert new[2][0] == f"on {image.day}/{image.month}/{image.year}." and new[3][0] == f"on {image:%d.%m.%Y}."
            assert new[4][0] == f"on {image.day} {months[image.month - 1]} {image.year}." and new[6][0] == f"on {months[image.month - 1]} {image.day}, {image.year}."


def test_dates_are_permuted():
    import datetime

    f = pii.Feistel(b"z")
    start = datetime.date(1999, 1, 1)
    days = [start + datetime.timedelta(k) for k in range(1500)]
    image = [pii.moved(f, d.year, d.month, d.day, False) for d in days]
    assert len(set(image)) == len(days) and [pii.moved(f, d.year, d.month, d.day, True) for d in image] == days


@settings(deadline=None)
@given(st.integers(2, 500), st.sampled_from(["a", "b"]))
def test_feistel_permutes(size, tweak):
    f = pii.Feistel(b"key")
    image = [f.run(x, size, tweak) for x in range(size)]
    assert sorted(image) == list(range(size)) and [f.run(y, size, tweak, True) for y in image] == list(range(size))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert line_dedup.dedup_lines(none).count() == 0
    assert simhash.near_groups(none).count() == 0
    assert near_copies.one_of_each(none).count() == 0
    assert contamination.contained_items(none, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert substring.dedup_substrings(none).count() == 0
    assert bpe.encode_documents(none, tokenizer_path()).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert topk.top_inner(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert ctw.score_documents(none).count() == 0
    assert pii.pseudonymise(none, b"k").count() == 0
    assert toxicity.score_documents(none, toxicity.Model({}, frozenset(), tuple([0.0] * len(toxicity.FEATURES)))).count() == 0
