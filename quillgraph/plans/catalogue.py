"""The registered queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import html, text, vectors
from quillgraph.functions.vocab import EN, RU
from quillgraph.operators import archives, blockmax, candidates, chat, excerpts, extraction, graph, index, logs, metrics, ordered, storage
from quillgraph.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

PUNCT = text.PUNCT.replace("'", "''")
STOP = ", ".join(f"'{w}'" for w in EN.stop_words)
def terms_sql(column: str) -> str:
    """DuckDB: index terms of a text column."""
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({column}), '{PUNCT}', ' ', 'g'), '\\s+'), lambda t: length(t) >= 3)"


def keywords_sql(column: str) -> str:
    return f"list_filter({terms_sql(column)}, lambda t: t NOT IN ({STOP}))"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from quillgraph.plans import catalogue_more  # adds its own

    assert catalogue_more.query is query
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- text --------------------------------------------------------------------

@query(f"""
SELECT doc_id, CASE WHEN k = '' THEN trim(text) ELSE k END AS keywords
FROM (SELECT doc_id, text, array_to_string({keywords_sql('text')}, ' ') AS k FROM documents)""")
def keyword_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.keywords(F.col("text"), EN).alias("keywords"))


_LIST = " OR ".join(f"contains(lower(text), '{m}')" for m in EN.list_markers)
_ENUM = " OR ".join(f"contains(lower(text), '{m}')" for m in EN.enumeration_markers)
_ROLE = " ".join(f"WHEN contains(lower(text), '{s}') THEN '{x}'" for s, x in EN.roles)
_NOT_INSTRUCTION = " AND ".join(f"NOT starts_with(lower(t), '{s}')" for s in EN.instruction_stems)
_ROLE_WORDS = ", ".join(f"'{w}'" for w in EN.role_words)


@query(f"""
SELECT conv_id, turn, ({_LIST}) AS is_list, ({_ENUM}) AS wants_enumeration, CASE {_ROLE} ELSE NULL END AS role
FROM conversations""")
def question_intents(spark, sf):
    q = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", text.is_list_question(q, EN).alias("is_list"), text.wants_enumeration(q, EN).alias("wants_enumeration"), text.role(q, EN).alias("role"))


@query(f"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '{PUNCT}', ' ', 'g'), '\\s+'),
    lambda t: length(t) >= 4 AND regexp_matches(t, '^\\p{{Lu}}') AND t NOT IN ({_ROLE_WORDS}) AND {_NOT_INSTRUCTION}) AS l FROM documents)
SELECT doc_id, l[list_position(list_transform(l, lambda x: length(x)), list_max(list_transform(l, lambda x: length(x))))] AS entity FROM t""")
def main_entity(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.entity(F.col("text"), EN).alias("entity"))


@query("""
SELECT page_id, trim(regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
  '&[a-zA-Z]+;', ' ', 'g'), '[\\s\\x{00A0}]+', ' ', 'g')) AS text FROM pages""")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS raw FROM pages)
SELECT page_id, raw, trim(regexp_replace(url_decode(regexp_replace(regexp_replace(regexp_replace(trim(raw), '^\\./', ''), '^\\.\\./', ''), '(?s)#.*$', '')), '^A/', '')) AS path, count(*) AS n
FROM l GROUP BY ALL""")
def page_links(spark, sf):
    raw = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("raw"))
    return raw.select("page_id", "raw", text.href_path(F.col("raw")).alias("path")).groupBy("page_id", "raw", "path").agg(F.count("*").alias("n"))


@query("""
SELECT doc_id,
  CASE WHEN n_chars <= 0 THEN '—' WHEN n_chars < 1024 THEN printf('%d B', n_chars) WHEN n_chars < 1048576 THEN printf('%.1f KB', round(n_chars / 1024.0, 1))
    ELSE printf('%.1f MB', round(n_chars / 1048576.0, 1)) END AS size,
  CASE WHEN n_chars >= 1000000 THEN (n_chars // 1000000) || 'M' WHEN n_chars >= 1000 THEN (n_chars // 1000) || 'k' ELSE n_chars::VARCHAR END AS count
FROM documents""")
def human_sizes(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", text.human_bytes(n).alias("size"), text.human_count(n).alias("count"))


@query("""
SELECT doc_id, pos - 1 AS pos, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '^#{1,3} ') THEN 'heading'
  WHEN regexp_matches(trim(line), '^[-*] ') THEN 'bullet' WHEN regexp_matches(trim(line), '^[0-9]{1,3}[.)][\\x09-\\x0D ]') THEN 'numbered' ELSE 'para' END AS kind, length(trim(line)) AS chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)""")
def markdown_kinds(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    one = F.get(text.markdown_lines(F.col("line")), F.lit(0))
    return rows.select("doc_id", "pos", one["kind"].alias("kind"), F.length(F.trim("line")).alias("chars"))


# --- full text and titles -----------------------------------------------------

_BM25 = f"""
WITH d AS (SELECT doc_id, {terms_sql('text')} AS t FROM documents),
l AS (SELECT doc_id, len(t) AS dl, t FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM l) GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS q_id, unnest({terms_sql('text')}) AS term FROM benchmark),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS (SELECT q_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY q_id, doc_id)
SELECT * FROM (SELECT q_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r) WHERE rank <= 20"""


@query(_BM25)
def bm25_topk(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("query"))
    return index.bm25_search(table(spark, sf, "documents"), asked)


@query(_BM25)
def bm25_block_max(spark, sf):
    """The same search over an index written beforehand."""
    path = storage.shared_folder(spark, "blockmax")
    blockmax.build(table(spark, sf, "documents"), path)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("query"))
    return blockmax.search(spark, path, asked)


@query(f"""
SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(t) AS term, len(t) AS dl FROM (SELECT doc_id, {terms_sql('text')} AS t FROM documents)) GROUP BY doc_id, term""")
def postings(spark, sf):
    rows = blockmax.counted_terms(table(spark, sf, "documents"), "doc_id", "text")
    return blockmax.exploded(rows, "doc_id", "dl").select("doc_id", "term", "tf", "dl")


_TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"


@query(f"""
WITH a AS (SELECT url AS path, {_TITLE} AS title FROM pages)
SELECT x.path AS asked, a.title, a.path, 1000 AS score FROM a JOIN a x ON a.title = x.title""")
def title_exact_lookup(spark, sf):
    pages = storage.durable(readers.page_rows(table(spark, sf, "pages")).drop("html"))
    probes = pages.select(F.col("path").alias("asked"), F.col("title").alias("title_asked"))
    return index.exact_titles(probes, pages).select("asked", "title", "path", "score")


@query("SELECT p_name, 800 AS score FROM (SELECT DISTINCT p_name FROM part WHERE starts_with(lower(p_name), 'small') ORDER BY p_name LIMIT 5)")
def title_prefix_scan(spark, sf):
    return index.titles_by_prefix(table(spark, sf, "part").select("p_name").distinct(), "SMALL", 5, title_col="p_name")


# --- candidates ---------------------------------------------------------------

_LANES_SQL = """
lane1 AS (SELECT o_custkey AS q_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS ord, o_orderpriority AS path, 1000 AS score FROM orders WHERE o_orderstatus = 'F'),
lane2 AS (SELECT o_custkey AS q_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS ord, o_orderpriority AS path, 50 AS score FROM orders WHERE o_orderstatus <> 'F')"""


def _lanes(spark, sf):
    orders = table(spark, sf, "orders")
    ord_ = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    lane = lambda c, s: orders.filter(c).select(F.col("o_custkey").alias("q_id"), ord_.alias("ord"), F.col("o_orderpriority").alias("path"), F.lit(s).alias("score"))
    return lane("o_orderstatus = 'F'", 1000), lane("o_orderstatus <> 'F'", 50)


@query(f"""
WITH {_LANES_SQL}, u AS (SELECT *, 0 AS lane FROM lane1 UNION ALL SELECT *, 1 FROM lane2),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id, path ORDER BY lane, ord) AS r FROM u) WHERE r = 1)
SELECT q_id, path, score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY lane, ord) AS INTEGER) AS ord FROM f""")
def lane_union_first_wins(spark, sf):
    return candidates.union_first(list(_lanes(spark, sf))).select("q_id", "path", "score", "ord")


@query(f"""
WITH {_LANES_SQL}, n AS (SELECT * FROM lane2 WHERE NOT EXISTS (SELECT 1 FROM lane1 WHERE lane1.q_id = lane2.q_id AND lane1.path = lane2.path)),
b AS (SELECT *, 0 AS s FROM lane1 UNION ALL SELECT *, 1 FROM n)
SELECT q_id, path, score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY s, ord) AS INTEGER) AS ord FROM b""")
def append_missing_candidates(spark, sf):
    return candidates.append_missing(*_lanes(spark, sf)).select("q_id", "path", "score", "ord")


@query("""
WITH h AS (SELECT l_orderkey AS q_id, l_linenumber AS ord, l_partkey, CAST(l_quantity * 20 AS INTEGER) AS score FROM lineitem)
SELECT q_id, ord, l_partkey, score FROM (SELECT *, max(score) OVER (PARTITION BY q_id) AS m FROM h) WHERE score >= 800 OR m < 800""")
def high_conf_with_fallback(spark, sf):
    hits = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("q_id"), F.col("l_linenumber").alias("ord"), "l_partkey", (F.col("l_quantity") * 20).cast("int").alias("score"))
    return candidates.confident_or_all(hits)


@query("""
SELECT o_custkey AS q_id, o_orderkey, o_orderpriority AS title FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderpriority = o.o_orderpriority AND x.o_orderstatus = 'P')""")
def exclude_titles(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("q_id"), "o_orderkey", F.col("o_orderpriority").alias("title"), "o_orderstatus")
    return candidates.without_titles(rows, rows.filter("o_orderstatus = 'P'")).select("q_id", "o_orderkey", "title")


@query(f"""
WITH h AS (SELECT page_id, lower({_TITLE}) AS low, {_TITLE} AS title, list_slice(list_filter(regexp_split_to_array(lower({_TITLE}), '\\s+'), lambda t: length(t) >= 3), 1, 2) AS terms, page_id % 10 AS q_id, CAST(page_id % 97 AS INTEGER) AS score FROM pages),
k AS (SELECT *, score + CASE WHEN list_contains(terms, low) THEN 100 ELSE 0 END + CASE WHEN len(list_filter(terms, lambda t: starts_with(low, t))) > 0 THEN 20 ELSE 0 END
  + CASE WHEN len(list_filter(terms, lambda t: contains(low, t))) > 0 THEN 10 ELSE 0 END - length(title) // 20 AS key FROM h)
SELECT q_id, page_id, score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY CASE WHEN len(terms) > 0 THEN key END DESC NULLS LAST, page_id) AS INTEGER) AS ord FROM k""")
def title_boost_topk(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))
    low = F.slice(F.filter(F.split(F.lower("title"), r"\s+"), lambda t: F.length(t) >= 3), 1, 2)
    hits = rows.select((F.col("page_id") % 10).alias("q_id"), F.col("page_id").alias("ord"), "page_id", "title", (F.col("page_id") % 97).cast("int").alias("score"), low.alias("terms"))
    return candidates.title_boosted(hits).select("q_id", "page_id", "score", "ord")


_COS = "list_sum([CAST(a[1] AS DOUBLE) * CAST(a[2] AS DOUBLE) FOR a IN list_zip(q.embedding, v.embedding)])"


@query(f"""
SELECT q_id, vec_id, rank, cosine FROM (
  SELECT q.vec_id AS q_id, v.vec_id, round({_COS}, 6) AS cosine,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 6) DESC, v.vec_id) AS INTEGER) AS rank
  FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id) WHERE rank <= 5""")
def cosine_topk(spark, sf):
    """Brute force over a question's candidates: here the vectors of its label."""
    v = table(spark, sf, "embeddings")
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"), "label")
    pairs = asked.join(v, "label").filter("vec_id <> q_id").select("q_id", "vec_id", F.round(vectors.dot(F.col("q"), F.col("embedding")), 6).alias("cosine"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("cosine"), "vec_id"))).filter("rank <= 5")


@query("""
SELECT vec_id, round(sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])), 6) AS norm FROM embeddings""")
def vector_norms(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


_HITS_SQL = """
h AS (SELECT label AS q_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS ord, vec_id,
  CASE WHEN vec_id % 7 = 0 THEN 900 ELSE CAST(vec_id % 100 AS INTEGER) END AS score, round(CAST(embedding[1] AS DOUBLE), 3) AS sim FROM embeddings)"""


@query(f"""
WITH {_HITS_SQL},
t AS (SELECT *, score < 500 AS tail, row_number() OVER (PARTITION BY q_id, score < 500 ORDER BY ord) - 1 AS i,
  row_number() OVER (PARTITION BY q_id, score < 500 ORDER BY sim DESC, ord) - 1 AS r, count(*) OVER (PARTITION BY q_id) AS n, count(*) FILTER (score < 500) OVER (PARTITION BY q_id) AS nt FROM h),
s AS (SELECT *, n >= 3 AND nt >= 3 AS fuse, CASE WHEN tail THEN CAST(CAST(1 AS FLOAT) / CAST(60 + i AS FLOAT) AS FLOAT) + CAST(CAST(1 AS FLOAT) / CAST(60 + r AS FLOAT) AS FLOAT) END AS rrf FROM t)
SELECT q_id, vec_id, CAST(CASE WHEN fuse THEN row_number() OVER (PARTITION BY q_id ORDER BY tail, CAST(rrf AS FLOAT) DESC NULLS LAST, ord) ELSE ord END AS INTEGER) AS ord FROM s""")
def rrf_fusion(spark, sf):
    v = table(spark, sf, "embeddings")
    rows = v.select(F.col("label").alias("q_id"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("ord"), "vec_id", F.when(F.col("vec_id") % 7 == 0, 900).otherwise((F.col("vec_id") % 100).cast("int")).alias("score"), F.round(F.col("embedding")[0].cast("double"), 3).alias("sim"))
    return candidates.fused(rows, F.col("sim")).select("q_id", "vec_id", "ord")


@query("""
WITH o AS (SELECT o_custkey AS q_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT q_id, o_orderkey FROM o WHERE r <= CASE WHEN q_id % 2 = 0 THEN least(12, greatest(4, 5, n + 2)) ELSE 4 END""")
def adaptive_topk(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("q_id"), "o_orderkey", F.col("o_orderkey").alias("ord"))
    o = o.withColumn("k", candidates.top_count(F.lit(4), F.count("*").over(Window.partitionBy("q_id")), F.col("q_id") % 2 == 0))
    return candidates.take_top(o, "k").select("q_id", "o_orderkey")


# --- graph ---------------------------------------------------------------------

_EDGES = """
e AS (SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst, 'P6' AS prop, n_nationkey AS ord FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'P1365', s_suppkey FROM supplier)"""


def _edges(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src_path"), F.lit("P6").alias("prop"), F.col("n_name").alias("text"), F.concat(F.lit("n"), "n_nationkey").alias("dst_path"), F.col("n_nationkey").cast("int").alias("ord"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src_path"), F.lit("P1365").alias("prop"), F.col("s_name").alias("text"), F.concat(F.lit("s"), "s_suppkey").alias("dst_path"), F.col("s_suppkey").cast("int").alias("ord"))
    return n.union(s)


@query(f"""
WITH {_EDGES}, l1 AS (SELECT CAST(substr(src, 2) AS BIGINT) AS q_id, dst AS path, 1 AS depth, prop AS via_prop, src AS from_path, CAST(row_number() OVER (PARTITION BY src ORDER BY ord) AS INTEGER) AS ord FROM e WHERE src LIKE 'r%'),
l2 AS (SELECT l1.q_id, e.dst AS path, 2 AS depth, e.prop AS via_prop, e.src AS from_path, CAST((SELECT count(*) FROM l1 x WHERE x.q_id = l1.q_id) + row_number() OVER (PARTITION BY l1.q_id ORDER BY l1.ord, e.ord) AS INTEGER) AS ord
  FROM l1 JOIN e ON e.src = l1.path)
SELECT * FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) WHERE ord <= 12""")
def bounded_bfs(spark, sf):
    seeds = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("q_id"), F.concat(F.lit("r"), "r_regionkey").alias("path"))
    return graph.bounded_walk(seeds, _edges(spark, sf)).select("q_id", "path", "depth", "via_prop", "from_path", "ord")


@query("""
WITH o AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders),
s AS (SELECT o_orderkey AS q_id, o_orderkey AS name FROM orders),
c1 AS (SELECT q_id, before AS name FROM s JOIN o ON o.o_orderkey = s.name WHERE before IS NOT NULL),
c2 AS (SELECT q_id, before AS name FROM c1 JOIN o ON o.o_orderkey = c1.name WHERE before IS NOT NULL),
c3 AS (SELECT q_id, before AS name FROM c2 JOIN o ON o.o_orderkey = c2.name WHERE before IS NOT NULL)
SELECT q_id, 0 AS step, 'order ' || name AS name FROM s UNION ALL SELECT q_id, 1, 'order ' || name FROM c1 UNION ALL SELECT q_id, 2, 'order ' || name FROM c2 UNION ALL SELECT q_id, 3, 'order ' || name FROM c3""")
def predecessor_chain(spark, sf):
    o = table(spark, sf, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    name = lambda c: F.concat(F.lit("order "), c.cast("string"))
    pairs = o.withColumn("b", before).filter("b is not null").select(name(F.col("o_orderkey")).alias("name_key"), F.concat(name(F.col("b")), F.lit(" (date)")).alias("before"))
    starts = o.select(F.col("o_orderkey").alias("q_id"), name(F.col("o_orderkey")).alias("name"))
    return graph.predecessor_chain(starts, pairs)


# --- excerpts, lists -------------------------------------------------------------

@query("""
WITH d AS (SELECT doc_id, text, string_split(lower(text), 'tion') AS p FROM documents WHERE length(text) > 900),
a AS (SELECT doc_id, CAST(p0 AS INTEGER) AS p0 FROM (SELECT doc_id, unnest([list_sum([length(x) FOR x IN p[1:k]]) + 4 * (k - 1) FOR k IN range(1, len(p))]) AS p0 FROM d)),
n AS (SELECT doc_id, p0, count(*) OVER (PARTITION BY doc_id ORDER BY p0 RANGE BETWEEN CURRENT ROW AND 899 FOLLOWING) AS c FROM a),
s AS (SELECT doc_id, arg_max(p0, struct_pack(c := c, m := -p0)) AS start FROM n GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(text) <= 900 THEN text WHEN start IS NULL THEN substr(text, 1, 900)
  ELSE substr(text, least(greatest(start - 100, 0), greatest(length(text) - 900, 0)) + 1, 900) END AS chunk FROM documents LEFT JOIN s USING (doc_id)""")
def densest_window(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumns({"title": F.lit(""), "terms": F.array(F.lit("tion"))})
    return excerpts.relevant_chunk(docs, id_col="doc_id", body_col="text", title_col="title", terms_col="terms", cap=900, profile=EN).select("doc_id", "chunk")


@query()
def budget_pack(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.select((F.col("doc_id") / 10).cast("long").alias("q_id"), (F.col("doc_id") % 10).cast("int").alias("ord"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.lit("").alias("snippet"), F.lit(None).cast("string").alias("source_tag"), F.col("text").alias("body"), F.lit("").alias("card"), F.lit("").alias("section"), F.array(F.lit("tion"), F.lit("ment")).alias("terms"), (F.col("doc_id") % 20 < 10).alias("is_list"), F.lit(4).alias("top_k"), F.lit(4500).alias("budget"))
    return excerpts.packed(rows, EN)


@query("""
WITH r AS (SELECT l_suppkey AS q_id, l_orderkey * 10 + l_linenumber AS ord, 'part ' || chr(CAST(97 + l_partkey % 26 AS INTEGER)) || chr(CAST(97 + l_partkey // 26 % 26 AS INTEGER)) AS name, CASE WHEN l_returnflag = 'N' THEN '?' ELSE strftime(l_shipdate, '%Y') END AS years FROM lineitem),
g AS (SELECT q_id, name, min(ord) AS first, arg_min(years, struct_pack(o := ord, y := years)) AS any_y, arg_min(years, struct_pack(o := ord, y := years)) FILTER (years <> '?') AS known FROM r GROUP BY q_id, name)
SELECT q_id, name, coalesce(known, any_y) AS years, CAST(row_number() OVER (PARTITION BY q_id ORDER BY first, name) AS INTEGER) AS ord FROM g""")
def keyed_merge_upgrade(spark, sf):
    letter = lambda c: F.chr((F.lit(97) + c).cast("long"))
    name = F.concat(F.lit("part "), letter(F.col("l_partkey") % 26), letter(F.floor(F.col("l_partkey") / 26) % 26))
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("q_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), name.alias("name"), F.when(F.col("l_returnflag") == "N", "?").otherwise(F.date_format("l_shipdate", "yyyy")).alias("years"))
    return extraction.merged_items(rows).select("q_id", "name", "years", "ord")


#: Answer lines in five forms, from the orders.
_ANSWER_LINE = """CASE o_orderkey % 5 WHEN 0 THEN o_orderkey || '. Иван ' || o_orderpriority || ' — ' || year(o_orderdate) || ' год – ' || (year(o_orderdate) + o_orderkey % 7) || ' год'
  WHEN 1 THEN '- **Пётр ' || o_orderpriority || '** — ?' WHEN 2 THEN 'НЕТ' WHEN 3 THEN '**Clerks ' || o_orderstatus || ':**' ELSE 'ДА, Борис ' || o_orderstatus || ' (b. 1949) - с ' || year(o_orderdate) || ' года' END"""


@query(f"""
WITH o AS (SELECT * REPLACE (trim(regexp_replace(o_orderpriority, '[0-9-]', '', 'g')) AS o_orderpriority) FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Иван ' || o_orderpriority WHEN 1 THEN 'Пётр ' || o_orderpriority ELSE 'Борис ' || o_orderstatus END AS name,
  CASE o_orderkey % 5 WHEN 0 THEN year(o_orderdate) || ' – ' || (year(o_orderdate) + o_orderkey % 7) WHEN 1 THEN '?' ELSE 'с ' || year(o_orderdate) END AS years
FROM o WHERE o_orderkey % 5 IN (0, 1, 4)""")
def list_line_parse(spark, sf):
    """TX10: a line for each order; refusals and headings are no items."""
    rows = table(spark, sf, "orders").withColumn("o_orderpriority", F.trim(F.regexp_replace("o_orderpriority", "[0-9-]", "")))
    lines = rows.select("o_orderkey", F.expr(_ANSWER_LINE).alias("line"))
    return lines.withColumn("i", extraction.item_of(F.col("line"), RU)).filter("i is not null").select("o_orderkey", "i.name", "i.years")


# --- chat ------------------------------------------------------------------------

_PRONOUNS = ", ".join(f"'{p}'" for p in EN.pronouns)


@query(f"""
WITH c AS (SELECT conv_id, turn, text, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM conversations),
u AS (SELECT conv_id, turn, text, prev, regexp_split_to_array(regexp_replace(lower(text), '{PUNCT}', ' ', 'g'), '\\s+') AS own, {keywords_sql('prev')} AS k FROM c WHERE role = 'user'),
t AS (SELECT *, list_filter(CASE WHEN len(k) > 0 THEN k ELSE string_split(trim(prev), ' ') END, lambda w: trim(w) <> '') AS topic FROM u),
a AS (SELECT conv_id, turn, text, prev, own, list_filter(topic, lambda w: NOT list_contains(own, lower(w))) AS added FROM t)
SELECT conv_id, turn, CASE WHEN (length(text) < 25 OR list_has_any(own, [{_PRONOUNS}])) AND prev IS NOT NULL AND len(added) > 0 THEN text || ' ' || array_to_string(added, ' ') ELSE text END AS resolved FROM a""")
def coreference(spark, sf):
    return chat.resolved(table(spark, sf, "conversations"), EN).select("conv_id", "turn", "resolved")


@query("""
WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN coalesce(substr(trim(replace(t, chr(10), ' ')), 1, 50), '') <> '' THEN substr(trim(replace(t, chr(10), ' ')), 1, 50) ELSE 'New chat' END AS title FROM f""")
def conversation_titles(spark, sf):
    return chat.conversation_titles(table(spark, sf, "conversations"))


@query("""
WITH o AS (SELECT o_custkey AS id, max(o_orderkey) AS updated_at, 'old' AS title FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
n AS (SELECT o_custkey AS id, max(o_orderkey) AS updated_at, 'new' AS title FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)""")
def history_upsert(spark, sf):
    o = table(spark, sf, "orders")
    side = lambda c, t: o.filter(c).select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("updated_at"), F.lit(t).alias("title"))
    old = side("o_orderstatus = 'F'", "old").groupBy("id", "title").agg(F.max("updated_at").alias("updated_at")).select("id", "updated_at", "title")
    return chat.upserted(old, side("o_orderstatus <> 'F'", "new"))


@query("""
SELECT conv_id, array_to_string(list(role || ': ' || text ORDER BY turn), chr(10)) AS transcript FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def conversation_history(spark, sf):
    h = chat.history(table(spark, sf, "conversations"))
    return h.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("transcript"))


# --- catalogues --------------------------------------------------------------------

#: A listing's row for each part: name, date and size of a file.
_FILE = "'wikipedia_' || CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'ru' WHEN 2 THEN 'fr' ELSE 'EN' END || '_' || split_part(p_name, ' ', 1) || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '_maxi' WHEN 1 THEN '_MINI' ELSE '' END || '_2024-05.zim'"
_DAY = "'2024-05-' || (10 + p_partkey % 20) || ' 10:23'"
_SIZE = "CASE p_partkey % 5 WHEN 0 THEN p_size || 'G' WHEN 1 THEN p_size || '.5M' WHEN 2 THEN p_size || 'K' WHEN 3 THEN CAST(p_size AS VARCHAR(9)) ELSE '-' END"
_CATALOGUE = f"""(SELECT {_FILE} AS filename, CASE p_partkey % 5 WHEN 0 THEN p_size * 1073741824::BIGINT WHEN 1 THEN CAST((p_size + 0.5) * 1048576 AS BIGINT) WHEN 2 THEN p_size * 1024::BIGINT ELSE p_size::BIGINT END AS size_bytes, {_DAY} AS date,
  CASE WHEN p_partkey % 3 < 2 THEN ['en', 'ru', 'fr', 'EN'][p_partkey % 4 + 1] END AS language, CASE WHEN p_partkey % 3 < 2 THEN split_part(p_name, ' ', 1) || p_partkey END AS topic, CASE p_partkey % 3 WHEN 0 THEN 'maxi' WHEN 1 THEN 'mini' END AS variant
  FROM part WHERE p_partkey % 5 < 4)"""


def _listing(spark, sf):
    """Directory listings of a hundred files each."""
    cells = F.expr(f"""'<tr><td><a href="' || {_FILE} || '">' || {_FILE} || '</a></td><td align="right">' || {_DAY} || '  </td><td align="right">' || {_SIZE} || '</td></tr>'""")
    rows = table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("page")).agg(F.concat(F.lit("<table>"), F.array_join(F.collect_list(cells), "\n"), F.lit("</table>")).alias("html"))
    return archives.index_rows(rows)


@query(f"SELECT filename, size_bytes, date, language, topic, variant FROM {_CATALOGUE}")
def catalog_parse(spark, sf):
    return _listing(spark, sf).drop("download_url")


@query(f"SELECT filename, row_number() OVER (ORDER BY coalesce(language, 'zz'), coalesce(topic, 'zzz'), date DESC, filename) AS pos FROM {_CATALOGUE} WHERE lower(language) = 'en' AND contains(lower(filename), 'wiki')")
def catalog_filter_sort(spark, sf):
    rows = archives.filtered(_listing(spark, sf), language="EN", query="Wiki").select("filename", "language", "topic", "date")
    return ordered.running_sum(rows, [*archives.catalogue_order(), "filename"], F.lit(1), "pos").select("filename", "pos")


_MODEL = "p_name || CASE p_partkey % 3 WHEN 0 THEN '-' || p_size || 'B-chat' WHEN 1 THEN '-0.' || p_size || 'b' ELSE '-8x' || p_size || 'b' END"


@query(f"SELECT p_partkey, {_MODEL} AS name, CASE p_partkey % 3 WHEN 0 THEN p_size BETWEEN 1 AND 9 WHEN 1 THEN CAST('0.' || p_size AS DOUBLE) >= 0.5 ELSE false END AS fits FROM part")
def size_range_filter(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.expr(_MODEL).alias("name"))
    return rows.withColumn("fits", text.in_size_range(F.col("name"), 0.5, 9.0))


_ENTRIES = "(SELECT event_id AS id, epoch_us(ts) // 1000 AS timestamp, ['DEBUG', 'INFO', 'WARN', 'ERROR'][event_id % 4 + 1] AS level, event_type AS tag, props AS message FROM events)"


def _entries(spark, sf):
    level = F.element_at(F.array(*map(F.lit, ("DEBUG", "INFO", "WARN", "ERROR"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), level.alias("level"), F.col("event_type").alias("tag"), F.col("props").alias("message"))


@query(f"""
SELECT id, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d %H:%M:%S.%g') || ' ' || level[1] || '/' || tag || ': ' || replace(message, chr(10), chr(1)) AS line
FROM (SELECT * FROM {_ENTRIES} ORDER BY id DESC LIMIT 500)""")
def log_format_tail(spark, sf):
    return logs.formatted(logs.tail(_entries(spark, sf))).select("id", "line")


@query(f"SELECT id, timestamp, level, tag, message FROM {_ENTRIES}")
def log_parse(spark, sf):
    return logs.parsed_lines(logs.formatted(_entries(spark, sf)).select("id", "line")).select("id", "timestamp", "level", "tag", "message")


@query("""
SELECT event_id, CASE WHEN ms > 0 THEN n * 1000.0 / ms ELSE 0 END AS turn_rate, 0.0::DOUBLE AS prefill_rate, CASE WHEN ms > 0 THEN n * 1000.0 / ms ELSE 0 END AS decode_rate
FROM (SELECT event_id, event_id % 50 AS n, event_id % 3 * 1000 AS ms FROM events)""")
def gen_stats(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.col("event_id") % 50).alias("gen_tokens"), (F.col("event_id") % 3 * 1000).alias("elapsed_ms"), F.lit(10).alias("prompt_tokens"), F.lit(None).cast("long").alias("prefill_ms"), (F.col("event_id") % 3 * 1000).alias("decode_ms"))
    return metrics.generation_rates(rows).select("event_id", *[F.col(c).cast("double").alias(c) for c in ("turn_rate", "prefill_rate", "decode_rate")])


_MS = "(epoch_us(ts) // 1000)"


@query(f"""
WITH g AS (SELECT user_id, min({_MS}) AS first_ms, max({_MS}) AS now_ms, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, n, CASE WHEN n > 1 AND now_ms > first_ms THEN CAST(floor((10000 - n) / (n / (now_ms - first_ms))) AS BIGINT) END AS eta_ms FROM g""")
def progress_eta(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return metrics.progress(rows, 10000, by="user_id").select("user_id", "n", "eta_ms")


@query(f"SELECT event_id FROM (SELECT event_id, lead({_MS}) OVER (PARTITION BY user_id ORDER BY {_MS}, event_id) - {_MS} AS gap FROM events) WHERE gap IS NULL OR gap >= 3600000")
def debounce(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return metrics.debounced(rows, by="user_id", ts_ms="ms", quiet_ms=3_600_000, order=("event_id",)).select("event_id")


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT user_id, {_MS} AS ms FROM events),
k AS (SELECT user_id, min(ms) AS ms FROM e GROUP BY user_id UNION ALL
  SELECT k.user_id, (SELECT min(e.ms) FROM e WHERE e.user_id = k.user_id AND e.ms > k.ms + 86400000) AS ms FROM k WHERE k.ms IS NOT NULL)
SELECT DISTINCT user_id, ms AS ts_ms FROM (SELECT user_id, ms FROM k WHERE ms IS NOT NULL UNION ALL SELECT user_id, max(ms) FROM e GROUP BY user_id)""")
def throttle(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return metrics.throttled(rows, by="user_id", ts_ms="ts_ms", every_ms=86_400_000)


@query("SELECT user_id, arg_max(event_type, struct_pack(ts := ts, t := event_type)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_per_key(spark, sf):
    return metrics.latest(table(spark, sf, "events"), by="user_id", ts="ts", value="event_type")


@query("""
SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS median_ms, round(avg(l_quantity), 6) AS mean_ms FROM lineitem GROUP BY l_returnflag""")
def benchmark_summary(spark, sf):
    got = metrics.benchmark_summary(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")
    return got.select("l_returnflag", F.round("median_ms", 6).alias("median_ms"), F.round("mean_ms", 6).alias("mean_ms"))


@query("SELECT l_shipdate_year, acceptance FROM (SELECT year(l_shipdate) AS l_shipdate_year, count(*) FILTER (l_returnflag = 'R') / count(*) AS acceptance FROM lineitem GROUP BY 1)")
def acceptance_ratio(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("l_shipdate_year", F.year("l_shipdate").cast("long"))
    return metrics.acceptance(rows, "l_shipdate_year", F.col("l_returnflag") == "R")


# --- pages with cards: one for each supplier (the given pages have none) ------------------

_CARD_PAGE = """'<table class="infobox"><tr><th>Глава</th><td><span data-wikidata-property-id="P6"><a href="./%D0%90' || (s_suppkey + 1) || '">Мэр ' || (s_suppkey + 1) || '.</a>[1]</span></td></tr><tr><th>Население</th><td>↗ ' || s_nationkey || '&nbsp;000</td></tr><tr><th>Флаг</th><td>x</td></tr></table>
<p>Вводный текст.</p><h2>Городская власть</h2><p>' || s_name || '.</p><h3>Мэры</h3><ul><li>Имя ' || s_suppkey || '</li></ul><h2>Экономика</h2><p>Завод.</p>'"""


def card_pages(spark, sf):
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("city"), "s_suppkey").alias("path"), F.col("s_name").alias("title"), F.expr(_CARD_PAGE).alias("html"), F.lit(False).alias("is_redirect"), F.lit(None).cast("string").alias("redirect_to"))
    return html.parse_pages(rows, RU)


@query("SELECT 'city' || s_suppkey AS path, 'Карточка:' || chr(10) || 'Глава/мэр: Мэр ' || (s_suppkey + 1) || '.' || chr(10) || 'Население: ' || s_nationkey || ' 000' AS card, 'Мэр ' || (s_suppkey + 1) || '.' AS head FROM supplier")
def infobox_cards(spark, sf):
    return card_pages(spark, sf).select("path", html.card_block(F.col("card"), RU).alias("card"), html.card_field(F.col("card"), "глава/Мэр").alias("head"))


@query("SELECT 'city' || s_suppkey AS path, '[Городская власть] ' || s_name || '. [Мэры] Имя ' || s_suppkey AS section, '' AS missing FROM supplier")
def sections_by_anchor(spark, sf):
    want = F.array(F.lit("городская власть"), F.lit("мэры"))
    return card_pages(spark, sf).select("path", html.sections_text(F.col("sections"), want).alias("section"), html.sections_text(F.col("sections"), F.array(F.lit("награды"))).alias("missing"))


@query("SELECT 'city' || s_suppkey AS path, 'P6' AS prop, 'Мэр ' || (s_suppkey + 1) || '.' AS text, 'А' || (s_suppkey + 1) AS href FROM supplier")
def infobox_links(spark, sf):
    return card_pages(spark, sf).select("path", F.explode(html.links_of(F.col("links"), F.array(F.lit("P6"), F.lit("P1365")))).alias("l")).select("path", "l.*")


@query(r"""
WITH shown AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '<head(\s[^>]*)?>.*?</head>|<script(\s[^>]*)?>.*?</script>|<style(\s[^>]*)?>.*?</style>', ' ', 'gis') AS h FROM pages),
bare AS (SELECT page_id, h, regexp_replace(regexp_replace(h, '</?(a|b|i|em|strong|span)(\s[^>]*)?>', '', 'gi'), '<[/!]?[a-zA-Z][^>]*>', ' ', 'g') AS t FROM shown),
read AS (SELECT page_id, h, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&nbsp;?', ' ', 'g'), '&amp;?', '&', 'g') AS t FROM bare)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '\[\s*\d+\s*\]', ' ', 'g'), '[←-⇿]', ' ', 'g'), '[\s\x{A0}]+', ' ', 'g')) AS body,
CAST(len(regexp_extract_all(h, '(?i)<h[23](?:\s[^>]*)?>\s*[^<\s]')) AS INTEGER) AS n_sections FROM read""")
def page_bodies(spark, sf):
    """HX4 over the driver's pages. The SQL takes the markup away by patterns, without a tree:
    these pages hold no card or chrome classes."""
    rows = table(spark, sf, "pages").select("page_id", html.parsed(F.col("html"), EN).alias("p"))
    return rows.select("page_id", "p.body", F.size("p.sections").alias("n_sections"))
