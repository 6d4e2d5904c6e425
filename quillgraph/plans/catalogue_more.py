"""More registered queries: scalar functions, lookups, logs, catalogues and whole plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import html, text, vectors
from quillgraph.functions.vocab import EN, RU
from quillgraph.operators import archives, candidates, chat, dictionaries, excerpts, extraction, graph, index, logs, metrics, sorted_titles, typos
from quillgraph.operators.storage import durable, shared_folder
from quillgraph.plans import answers
from quillgraph.plans.catalogue import _ENTRIES, PUNCT, _entries, query, table
from quillgraph.sources import readers, sinks
from quillgraph.streaming import running


# --- scalar functions --------------------------------------------------------------

@query(f"""
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^а-яёa-z ]', ' ', 'g'), '\\s+', ' ', 'g')) AS name,
  trim(regexp_replace(regexp_replace(lower(text), '{PUNCT}', ' ', 'g'), '\\s+', ' ', 'g')) AS query FROM conversations""")
def normalised_texts(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", text.normalised_name(t).alias("name"), text.normalised_query(t).alias("query"))


@query("""
SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS snippet FROM pages""")
def snippets(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("snippet"))


@query("""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\[\\s*\\d+\\s*\\]', ' ', 'g'), '[\\x{2190}-\\x{21FF}]', ' ', 'g'), '[\\s\\x{00A0}]+', ' ', 'g')) AS cleaned FROM documents""")
def cleaned_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


_SAID = """CASE event_id % 4 WHEN 0 THEN '**ПОИСК:** Уткин ' || user_id WHEN 1 THEN 'ответ без поиска ' || event_type WHEN 2 THEN event_type || chr(10) || '> ПОИСК — «Сухих ' || event_id || '»' ELSE 'поиск: ' END"""


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' Уткин ' || user_id WHEN 2 THEN 'Сухих ' || event_id END AS directive FROM events")
def search_directives(spark, sf):
    """TX14, PF16: a line for each event."""
    return table(spark, sf, "events").select("event_id", text.search_directive(F.expr(_SAID), RU).alias("directive"))


_THOUGHT = "CASE turn % 3 WHEN 0 THEN '<think>' || text || '</think> b' || conv_id WHEN 1 THEN '<think>a</think>b' || conv_id || '<think>' || text ELSE text END"


@query("""
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'b' || conv_id WHEN 1 THEN 'b' || conv_id || '<think>' || text ELSE text END AS final,
  CASE turn % 3 WHEN 2 THEN text ELSE 'b' || conv_id END AS running FROM conversations WHERE text = trim(text, E' \n\t\r')""")
def reasoning_removed(spark, sf):
    """TX13: conversations with reasoning around their texts."""
    rows = table(spark, sf, "conversations").filter("text = trim(BOTH ' \n\t\r' FROM text)")
    return rows.select("conv_id", "turn", text.after_thinking(F.expr(_THOUGHT)).alias("final"), text.visible_answer(F.expr(_THOUGHT)).alias("running"))


_RAW_SIZE = "CASE p_partkey % 7 WHEN 0 THEN p_size || '.5M' WHEN 1 THEN p_size || 'G' WHEN 2 THEN p_size || 'K' WHEN 3 THEN CAST(p_size AS VARCHAR(9)) WHEN 4 THEN '-' WHEN 5 THEN p_size || 't' ELSE p_name END"


@query(f"""
SELECT p_partkey, {_RAW_SIZE} AS raw, CASE p_partkey % 7 WHEN 0 THEN CAST((p_size + 0.5) * 1048576 AS BIGINT) WHEN 1 THEN p_size * 1073741824::BIGINT WHEN 2 THEN p_size * 1024::BIGINT
  WHEN 3 THEN p_size::BIGINT WHEN 5 THEN p_size * 1099511627776::BIGINT END AS bytes FROM part""")
def sizes_parsed(spark, sf):
    """TX16."""
    return table(spark, sf, "part").select("p_partkey", F.expr(_RAW_SIZE).alias("raw")).withColumn("bytes", text.parse_size(F.col("raw")))


@query("SELECT doc_id, least(greatest(n_chars // 6 * 4, 256), 2048) AS budget FROM documents")
def token_budgets(spark, sf):
    words = F.floor(F.col("n_chars") / 6)
    return table(spark, sf, "documents").select("doc_id", chat.token_budget(words).alias("budget"))


@query("""
WITH n AS (SELECT n_nationkey, n_name AS e FROM nation)
SELECT n_nationkey, CAST(pos - 1 AS INTEGER) AS pos, t AS title FROM (
  SELECT n_nationkey, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM (SELECT n_nationkey, ['Mayors of ' || e, 'List of mayors of ' || e, 'Mayors of ' || e || ' by year', 'Heads of ' || e, 'History of ' || e, 'Timeline of ' || e] AS l FROM n))""")
def title_probes(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", F.posexplode(text.title_templates(F.lit("Mayors"), F.col("n_name"), EN)).alias("pos", "title"))
    return rows


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n, any_value(CASE WHEN l_quantity > 0 THEN l_tax / l_quantity ELSE 0 END) AS ratio,
  any_value(CASE WHEN floor(l_quantity) = l_quantity THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END) AS shown
FROM lineitem GROUP BY l_orderkey, l_linenumber, l_quantity, l_tax""")
def safe_ratios(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_quantity", "l_tax").agg(F.count("*").alias("n"))
    return rows.select("l_orderkey", "l_linenumber", "n", text.safe_ratio(F.col("l_tax"), F.col("l_quantity")).alias("ratio"), text.plain_number(F.col("l_quantity")).alias("shown"))


@query("SELECT vec_id, 1.0::DOUBLE AS norm FROM embeddings")
def unit_vectors(spark, sf):
    """Norms of the vectors scaled to norm 1."""
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm(vectors.normalised(F.col("embedding"))), 4).alias("norm"))


# --- lookups ------------------------------------------------------------------------

#: An article for each customer; of four, the second to the fourth lead to the one before, so that three hops lead to the first.
_PATH, _NAMED = "'c' || c_custkey", "'Customer ' || c_custkey"


def _articles(spark, sf):
    return table(spark, sf, "customer").select(F.expr(_PATH).alias("path"), F.expr(_NAMED).alias("title"), F.lit("").alias("html"), (F.col("c_custkey") % 4 > 0).alias("is_redirect"), F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("c"), F.col("c_custkey") - 1)).alias("redirect_to"))


@query("""
WITH c AS (SELECT c_custkey AS k, (SELECT min(c_custkey) FROM customer) AS low FROM customer)
SELECT 'Customer ' || k AS title_asked, 'Customer ' || greatest(k - k % 4, low) AS title, 'c' || greatest(k - k % 4, low) AS path, 1000 AS score FROM c""")
def title_lookup_with_redirects(spark, sf):
    """SC5, JN2: all titles looked up, through up to three redirects."""
    articles = _articles(spark, sf)
    return index.lookup_titles(articles.select(F.col("title").alias("title_asked")), articles).select("title_asked", "title", "path", "score")


@query(f"""
WITH n AS (SELECT DISTINCT p_name AS title, trim(regexp_replace(regexp_replace(lower(p_name), '{PUNCT}', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM part),
a AS (SELECT DISTINCT lower(substr(n, 1, k)) AS asked FROM n, range(1, 15) r(k)),
q AS (SELECT asked, trim(regexp_replace(regexp_replace(asked, '{PUNCT}', ' ', 'g'), '\\s+', ' ', 'g')) AS a FROM a),
c AS (SELECT asked, title, starts_with(n, a) AS on_, levenshtein(n, a) AS d, length(a) AS l FROM q JOIN n ON substr(n, 1, 3) = substr(a, 1, 3) OR length(a) < 3 AND starts_with(n, a) WHERE a <> '')
SELECT asked, arg_min(title, struct_pack(o := NOT on_, d := d, t := title)) AS title, 950 AS score FROM c WHERE on_ OR d <= l / 3 GROUP BY asked""")
def title_suggestions(spark, sf):
    """SC6: beginnings of one character and more."""
    named = table(spark, sf, "part").select(F.col("p_name").alias("title"), F.col("p_name").alias("path")).distinct()
    asked = named.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(14)), lambda n: F.substring(index.title_key(F.col("title")), F.lit(1), n))).alias("title_asked")).distinct()
    return index.suggested_titles(asked, named).select(F.col("title_asked").alias("asked"), "title", "score")


@query("""
WITH n AS (SELECT DISTINCT p_name AS title FROM part), a AS (SELECT DISTINCT p_name AS name, k, lower(substr(p_name, 1, k)) AS prefix FROM part, range(0, 12) r(k))
SELECT name, k, title, 800 AS score FROM (SELECT a.name, a.k, n.title, row_number() OVER (PARTITION BY a.name, a.k ORDER BY n.title) AS r FROM a JOIN n ON starts_with(lower(n.title), a.prefix)) WHERE r <= 3""")
def title_prefix_lengths(spark, sf):
    """Prefixes of every length, the empty one included; three titles of each."""
    named = table(spark, sf, "part").select(F.col("p_name").alias("title"), F.col("p_name").alias("path")).distinct()
    probes = named.select(F.col("title").alias("name"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    probes = probes.withColumn("prefix", F.expr("upper(substring(name, 1, k))"))
    return index.prefix_matches(probes, named, 3).select("name", F.col("k").cast("long").alias("k"), "title", "score")


#: A part's name with one or two errors, or none; also in its first characters.
_EDITED = """CASE p_partkey % 6 WHEN 0 THEN 'x' || substr(p_name, 2) WHEN 1 THEN substr(p_name, 2) WHEN 2 THEN substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(p_name, 3)
  WHEN 3 THEN 'Q' || p_name || 'z' WHEN 4 THEN substr(p_name, 3) ELSE upper(p_name) END"""


@query(f"""
WITH n AS (SELECT DISTINCT p_name AS title FROM part), q AS (SELECT p_partkey, {_EDITED} AS asked FROM part),
d AS (SELECT asked, title, levenshtein(lower(asked), title) AS d FROM (SELECT DISTINCT asked FROM q), n)
SELECT p_partkey, asked, m.title AS title, m.d AS distance, 950 AS score
FROM q JOIN (SELECT asked, min(struct_pack(d := d, title := title)) AS m FROM d WHERE d <= 2 GROUP BY asked) USING (asked)""")
def title_typos(spark, sf):
    """SC6: titles misspelled anywhere, by a deletion neighbourhood; the SQL compares all pairs."""
    part = table(spark, sf, "part")
    asked = part.select("p_partkey", F.expr(_EDITED).alias("asked"))
    named = part.select(F.col("p_name").alias("title"), F.col("p_name").alias("path"))
    return typos.suggested_by_edits(asked, named, title_col="asked").select("p_partkey", "asked", "title", F.col("distance").cast("long").alias("distance"), "score")


@query("""
WITH n AS (SELECT DISTINCT c_name AS title FROM customer), a AS (SELECT c_custkey, k, lower(substr(c_name, 1, k)) AS prefix FROM customer, range(0, 20, 3) r(k)),
p AS (SELECT prefix, title, row_number() OVER (PARTITION BY prefix ORDER BY title) AS r FROM (SELECT DISTINCT prefix FROM a) JOIN n ON starts_with(lower(title), prefix))
SELECT c_custkey, k, title, 800 AS score FROM a JOIN p USING (prefix) WHERE r <= 3""")
def title_ranges(spark, sf):
    """SC8, SO9: beginnings of all customers' names in sorted blocks written beforehand."""
    named = table(spark, sf, "customer").select(F.col("c_name").alias("title"), F.col("c_name").alias("path")).distinct()
    path = shared_folder(spark, "titles")
    sorted_titles.build(named, path)
    asked = table(spark, sf, "customer").select("c_custkey", "c_name", F.explode(F.sequence(F.lit(0), F.lit(19), F.lit(3))).alias("k")).withColumn("prefix", F.expr("upper(substring(c_name, 1, k))"))
    return sorted_titles.by_prefix(spark, path, asked, 3).select("c_custkey", F.col("k").cast("long").alias("k"), "title", "score")


_PHRASES = """SELECT lower(w[i] || ' ' || w[i + 1]) AS entry, min(item_id * 100000 + i) AS place FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i
  FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS w FROM benchmark)) GROUP BY 1"""


@query(f"""
WITH e AS ({_PHRASES}), t AS (SELECT 'd' || doc_id AS id, lower(text) AS text FROM documents UNION ALL SELECT 'c' || conv_id || ':' || turn, lower(text) FROM conversations)
SELECT id, min(struct_pack(place := place, entry := e.entry)).entry AS entry, min(place) AS place, count(place) AS n_entries FROM t LEFT JOIN e ON contains(text, e.entry) GROUP BY id""")
def dictionary_entries(spark, sf):
    """JN5, JN6, PF1: pairs of words of all benchmark items, in list order, looked for in documents and conversations."""
    split = table(spark, sf, "benchmark").select("item_id", F.filter(F.split("text", "[ \n]+"), lambda w: w != "").alias("w"))
    pairs = split.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i")).select(F.lower(F.concat_ws(" ", F.get("w", F.col("i") - 1), F.get("w", "i"))).alias("entry"), (F.col("item_id") * 100000 + F.col("i")).alias("place"))
    texts = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").union(table(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn"), "text"))
    return dictionaries.found_entries(texts, pairs, id_col="id")


@query("SELECT p.p_partkey AS asked, n.title, 800 AS score FROM (SELECT DISTINCT p_name AS title FROM part) n JOIN part p ON starts_with(lower(n.title), lower(p.p_name))")
def title_prefix_batch(spark, sf):
    part = table(spark, sf, "part")
    named = part.select(F.col("p_name").alias("title"), F.col("p_name").alias("path")).distinct()
    probes = part.select(F.col("p_partkey").alias("asked"), F.col("p_name").alias("prefix"))
    return index.prefix_matches(probes, named, 100, key_chars=4).select("asked", "title", "score")


@query("SELECT a.url AS path, b.html IS NULL AS missing, length(b.html) AS chars FROM (SELECT url FROM pages UNION ALL SELECT 'none') a LEFT JOIN pages b ON a.url = b.url")
def article_reads(spark, sf):
    pages = readers.page_rows(table(spark, sf, "pages"))
    asked = pages.select("path").union(spark.createDataFrame([("none",)], "path string"))
    return index.article_html(asked, pages).select("path", F.col("html").isNull().alias("missing"), F.length("html").alias("chars"))


@query("""
WITH h AS (SELECT o_custkey AS q_id, o_orderkey AS ord, o_orderpriority AS title FROM orders),
s AS (SELECT *, len(list_intersect(['high', 'specified'], regexp_split_to_array(lower(title), '[\\s,.-]+'))) AS n FROM h)
SELECT q_id, ord, title FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY n DESC, ord) AS r FROM s) WHERE r = 1""")
def best_name_match(spark, sf):
    hits = table(spark, sf, "orders").select(F.col("o_custkey").alias("q_id"), F.col("o_orderkey").alias("ord"), F.regexp_replace("o_orderpriority", "-", " ").alias("title"), F.col("o_orderpriority").alias("shown"))
    return candidates.best_name_match(hits, F.lit("high specified")).select("q_id", "ord", F.col("shown").alias("title"))


@query("SELECT q_id, ord, title, body_len, 2000 AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY ord) AS r FROM (SELECT o_custkey AS q_id, o_orderkey AS ord, o_orderpriority AS title, CAST(floor(o_totalprice) AS INTEGER) AS body_len FROM orders WHERE o_orderstatus <> 'P' AND CAST(floor(o_totalprice) AS INTEGER) >= 400)) WHERE r = 1")
def list_article_choice(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("q_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("title"), F.floor("o_totalprice").cast("int").alias("body_len"), (F.col("o_orderstatus") == "P").alias("is_redirect"))
    return candidates.list_article(rows).select("q_id", "ord", "title", "body_len", "score")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5")
def last_events(spark, sf):
    return candidates.last_n(table(spark, sf, "events").select("user_id", "event_id"), 5, "event_id", by="user_id")


# --- chat, logs, statistics ------------------------------------------------------------

@query("SELECT conv_id, turn, text FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def visible_turns(spark, sf):
    return chat.visible(table(spark, sf, "conversations")).select("conv_id", "turn", "text")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def history_delete(spark, sf):
    kept = chat.deleted(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")))
    return kept


@query("SELECT l_orderkey AS turn_id, sum(l_partkey)::BIGINT AS prompt_tokens, sum(l_suppkey)::BIGINT AS gen_tokens, sum(l_linenumber)::BIGINT AS prefill_ms, count(*) AS decode_ms FROM lineitem GROUP BY 1")
def turn_totals(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("turn_id"), F.col("l_partkey").alias("prompt_tokens"), F.col("l_suppkey").alias("gen_tokens"), F.col("l_linenumber").alias("prefill_ms"), F.lit(1).alias("decode_ms"))
    return chat.turn_totals(rows)


@query(f"""
SELECT row_number() OVER (ORDER BY id) AS n, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d %H:%M:%S.%g') || ' ' || level[1] || '/' || tag || ': ' || message AS line FROM {_ENTRIES}""")
def log_dump(spark, sf):
    return logs.dumped(_entries(spark, sf))


@query(f"""
WITH l AS (SELECT id, tag, length(message) + 1 AS n FROM {_ENTRIES}),
s AS (SELECT *, sum(n) OVER (PARTITION BY tag) AS whole, sum(n) OVER (PARTITION BY tag ORDER BY id DESC) AS upto FROM l)
SELECT id, tag FROM s WHERE whole <= 4096 OR upto <= whole // 2""")
def log_rotation(spark, sf):
    lines = _entries(spark, sf).select("id", "tag", F.col("message").alias("line"))
    return logs.rotated(lines, "id", by="tag", size=4096).select("id", "tag")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'complete' WHEN event_id % 4 = 1 AND value > 0 THEN 'append' WHEN event_id % 4 < 3 THEN 'restart' ELSE 'fail' END AS action FROM events")
def download_decisions(spark, sf):
    code = F.element_at(F.array(*map(F.lit, (416, 206, 200, 500))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", archives.download_action(code, F.col("value")).alias("action"))


@query("SELECT s_suppkey AS path, count(*) AS partial_size FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1")
def partial_sizes(spark, sf):
    files = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("path"))
    parts = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("path")).agg(F.count("*").alias("partial_size"))
    return archives.partial_sizes(files, parts)


@query("SELECT DISTINCT c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def listing_difference(spark, sf):
    return sinks.missing_only(table(spark, sf, "customer").select(F.col("c_custkey").alias("name")), table(spark, sf, "orders").select(F.col("o_custkey").alias("name")))


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS shown, count(*) AS total FROM orders")
def shown_of_total(spark, sf):
    return archives.shown_of(table(spark, sf, "orders"), F.col("o_orderstatus") == "F")


@query("SELECT doc_id, length(text) AS n, CASE WHEN len(string_split(text, ' ')) > 100 THEN string_split(text, ' ')[-84:] ELSE string_split(text, ' ') END AS kept FROM documents")
def kept_context(spark, sf):
    t = F.split("text", " ")
    return table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"), F.when(F.size(t) > 100, metrics.kept_context(t, 100)).otherwise(t).alias("kept"))


# --- catalogues and models ----------------------------------------------------------------

_MODEL_ID = "replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '-') || '-' || p_size || CASE WHEN p_partkey % 3 = 0 THEN 'B-GGUF' ELSE 'B' END"


@query(f"""
SELECT id, split_part(id, '/', 1) AS author, split_part(id, '/', 2) AS name, downloads, likes FROM (
  SELECT {_MODEL_ID} AS id, p_partkey::BIGINT AS downloads, p_size::BIGINT AS likes FROM part WHERE p_size BETWEEN 1 AND 9 AND (p_partkey % 3 = 0 OR p_partkey % 5 = 0)) ORDER BY downloads DESC, id LIMIT 50""")
def model_search(spark, sf):
    """SC13, PF3, PF5: a top fifty, as the reference's page of results is."""
    tags = F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("Gguf"))).otherwise(F.array(F.lit("onnx")))
    rows = table(spark, sf, "part").select(F.expr(_MODEL_ID).alias("id"), F.expr(_MODEL_ID).alias("modelId"), F.col("p_size").cast("long").alias("likes"), F.col("p_partkey").cast("long").alias("downloads"), tags.alias("tags"), F.lit(None).cast("string").alias("lastModified"))
    return archives.models(rows)


_FILE_PATH = "p_name || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.gguf' WHEN 1 THEN '.GGUF' ELSE '.txt' END"


@query(f"SELECT {_FILE_PATH} AS path, p_size::BIGINT AS size FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 7 > 0")
def model_file_list(spark, sf):
    """SC14, PF4."""
    rows = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 7 == 0, "directory").otherwise("file").alias("type"), F.expr(_FILE_PATH).alias("path"), F.col("p_size").cast("long").alias("size"), F.lit("x").alias("oid"))
    return archives.model_files(rows).select("path", "size")


_KIND = "CASE WHEN s_nationkey < 5 THEN 'picked' WHEN s_acctbal < 0 THEN 'downloaded' ELSE 'scanned' END"


@query(f"SELECT kind, name FROM (SELECT {_KIND} AS kind, s_name AS name FROM supplier) ORDER BY CASE kind WHEN 'downloaded' THEN 0 WHEN 'scanned' THEN 1 ELSE 2 END, name LIMIT 1")
def archive_choice(spark, sf):
    """SC3."""
    return archives.first_source(table(spark, sf, "supplier").select(F.expr(_KIND).alias("kind"), F.col("s_name").alias("name")))


# --- plans over an archive of the suppliers' cards -----------------------------------------------

_SURNAME = "'С' || translate(CAST({k} AS VARCHAR(9)), '0123456789', 'абвгдежзик')"


def _surname(k: str) -> str:
    return _SURNAME.format(k=k)


def _officers(spark, sf):
    """A page for each supplier; of four in a row, all but the first name the one before."""
    before = F.expr(f"""CASE WHEN s_suppkey % 4 > 0 THEN '<tr><th>Предшественник</th><td><a href="o' || (s_suppkey - 1) || '">Илья ' || {_surname("s_suppkey - 1")} || '</a></td></tr>' ELSE '' END""")
    page = F.concat(F.lit("<table class=infobox>"), before, F.lit("<tr><th>Место</th><td>x</td></tr></table><p>Мэр.</p>"))
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("o"), "s_suppkey").alias("path"), F.expr(f"{_surname('s_suppkey')} || ', Илья'").alias("title"), page.alias("html"), F.lit(False).alias("is_redirect"), F.lit(None).cast("string").alias("redirect_to"))
    return durable(html.parse_pages(rows, RU))


@query(f"SELECT s_suppkey AS q_id, CAST(i AS INTEGER) AS step, 'Илья ' || {_surname('s_suppkey - i')} AS name FROM supplier, range(4) t(i) WHERE i <= s_suppkey % 4")
def card_predecessors(spark, sf):
    """GR3: the chain of predecessors of every officer."""
    starts = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("q_id"), F.expr(f"'Илья ' || {_surname('s_suppkey')}").alias("name"))
    return answers.predecessors(starts, _officers(spark, sf), RU).select("q_id", "step", "name")


@query("""
SELECT s.s_suppkey AS q_id, 'o' || (s.s_suppkey - i) AS path, CASE i WHEN 0 THEN 1000 ELSE 900 - i END AS score
FROM supplier s, range(4) t(i) WHERE i <= s.s_suppkey % 4 AND (i = 0 OR s.s_suppkey - i IN (SELECT s_suppkey FROM supplier))""")
def walk_candidates(spark, sf):
    """GR1, GR2, TX9: what a walk from every officer's page reaches."""
    pages = _officers(spark, sf)
    seeds = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("q_id"), F.concat(F.lit("o"), "s_suppkey").alias("path"), F.expr(f"{_surname('s_suppkey')} || ', Илья'").alias("title"), F.lit(1000).alias("score"))
    walked = graph.bounded_walk(seeds, answers.link_edges(pages), max_nodes=6, max_depth=4)
    return graph.walk_hits(walked, seeds, RU).select("q_id", "path", "score")


@query("SELECT o_orderkey AS q_id, name, years FROM orders, (VALUES (0), (1)) t(i), LATERAL (SELECT CASE i WHEN 0 THEN 'Иван Петров' ELSE 'Пётр Сидоров' END AS name, CASE i WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE '?' END AS years)")
def answer_reduction(spark, sf):
    """LX2, PF9 to PF12: three answers to each order's question."""
    said = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("Иван Петров").alias("title"), F.concat(F.lit("Иван Петров — "), F.year("o_orderdate"), F.lit("\nДругой Человек — 1999")).alias("raw")),
        F.struct(F.lit(1).alias("ord"), F.lit("Пётр Сидоров").alias("title"), F.lit("ДА.").alias("raw")),
        F.struct(F.lit(2).alias("ord"), F.lit("Х").alias("title"), F.lit("Он не является мэром").alias("raw")))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("q_id"), F.explode(said).alias("s"))
    return extraction.reduced(rows.select("q_id", "s.ord", F.lit("кто мэр").alias("question"), "s.title", F.lit(False).alias("is_seed"), "s.raw"), RU).select("q_id", "name", "years")


@query("SELECT doc_id, lang || right(text, 800 - length(lang)) AS context FROM documents")
def agentic_context(spark, sf):
    """PR6: the end of each document behind a short seed."""
    return table(spark, sf, "documents").select("doc_id", excerpts.agentic_context(F.col("lang"), F.col("text"), 800, 100).alias("context"))


# --- further functions over the driver's tables --------------------------------------

@query("""
SELECT page_id, array_to_string([replace(replace(url_encode(x), '~', '%7E'), '%2A', '*') FOR x IN string_split(url, '/')], '/') AS encoded FROM pages""")
def encoded_paths(spark, sf):
    """TX24."""
    return table(spark, sf, "pages").select("page_id", text.encoded_path(F.col("url")).alias("encoded"))


@query("""
WITH m AS (SELECT conv_id, turn, lower(coalesce(text, '')) || CASE WHEN turn % 3 = 0 THEN ' rc: -' || conv_id ELSE '' END AS m FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(m, 'memory|alloc|oom') THEN 'memory' WHEN regexp_matches(m, 'context|n_ctx|too long') THEN 'context'
  WHEN regexp_matches(m, 'cancel|stop') THEN 'stopped' WHEN regexp_extract(m, '(?:error|code|rc)\\s*[=: ]\\s*(-?[0-9]+)', 1) <> '' THEN 'code ' || regexp_extract(m, '(?:error|code|rc)\\s*[=: ]\\s*(-?[0-9]+)', 1)
  ELSE 'other' END AS kind FROM m""")
def error_kinds(spark, sf):
    """TX25."""
    message = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" rc: -"), F.col("conv_id").cast("string"))).otherwise(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.error_kind(message).alias("kind"))


@query("""
SELECT event_id, printf('%.1f tok/s · %d tok · %d s', event_id % 50 + 0.5, event_id % 1000, (event_id % 9000 + 500) // 1000) AS line FROM events""")
def stats_lines(spark, sf):
    """TX28."""
    n = F.col("event_id")
    return table(spark, sf, "events").select("event_id", text.stats_line((n % 50 + 0.5).cast("double"), n % 1000, n % 9000).alias("line"))


@query("""
WITH t AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'page ' || page_id END AS title FROM pages)
SELECT page_id, CASE WHEN trim(coalesce(title, '')) = '' THEN url ELSE title END AS shown, 'model ' || page_id || CASE WHEN page_id % 2 = 0 THEN '' ELSE '.bin' END AS file FROM t""")
def display_names(spark, sf):
    """TX29."""
    n = F.col("page_id")
    title = F.when(n % 3 == 1, "  ").when(n % 3 == 2, F.concat(F.lit("page "), n.cast("string")))
    file = F.concat(F.lit("model "), n.cast("string"), F.when(n % 2 == 0, ".GGUF").otherwise(".bin"))
    return table(spark, sf, "pages").select("page_id", text.or_path(title, F.col("url")).alias("shown"), text.display_name(file).alias("file"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 7 ELSE 0 END AS code FROM events")
def event_codes(spark, sf):
    """TX30."""
    return table(spark, sf, "events").select("event_id", text.code_of(F.col("event_type"), {"view": 1, "click": 2, "error": 7}, 0).alias("code"))


@query("""
SELECT event_id, list_sort(list_transform(map_entries(map_from_entries(CASE WHEN event_type = 'click' THEN [('kind', event_type)] ELSE [('kind', event_type), ('user', 'u' || user_id)] END)), lambda e: e.key || '=' || e.value)) AS cells FROM events""")
def map_cells(spark, sf):
    """ST-U5: a cell set, and one taken out."""
    cells = metrics.with_entry(F.create_map(F.lit("kind"), F.lit("old"), F.lit("user"), F.concat(F.lit("u"), F.col("user_id").cast("string"))), F.lit("kind"), F.col("event_type"))
    left = F.when(F.col("event_type") == "click", metrics.without_key(cells, F.lit("user"))).otherwise(cells)
    return table(spark, sf, "events").select("event_id", F.array_sort(F.transform(F.map_entries(left), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("cells"))


_PAGE_TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"


@query(f"""
WITH a AS (SELECT url AS path, {_PAGE_TITLE} AS title, length(html) AS n FROM pages), t AS (SELECT DISTINCT title FROM a UNION ALL SELECT 'no such title')
SELECT a.title, a.path, n AS body_len FROM t JOIN a USING (title)""")
def raw_title_probe(spark, sf):
    """SC7 over all pages."""
    pages = readers.page_rows(table(spark, sf, "pages"))
    probes = pages.select(F.col("title").alias("title_asked")).distinct().union(spark.createDataFrame([("no such title",)], "title_asked string"))
    return index.raw_titles(probes, pages, body_col="html").select("title", "path", F.col("body_len").alias("body_len"))


@query(f"""
SELECT page_id, substr({_PAGE_TITLE} || '. ' || trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 600) AS passage FROM pages""")
def passages(spark, sf):
    """VE4."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return table(spark, sf, "pages").select("page_id", vectors.passage(title, F.col("html")).alias("passage"))


@query("SELECT doc_id, [CAST(length('query: ' || trim(text)) AS FLOAT), CAST(strlen('query: ' || trim(text)) AS FLOAT)] AS vector FROM documents")
def embedded_queries(spark, sf):
    """VE1 by a model that counts characters and bytes."""
    def model(texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(len(t.encode()))] for t in texts]

    return table(spark, sf, "documents").select("doc_id", vectors.embed(F.col("text"), model, "query").alias("vector"))


@query("""
WITH h AS (SELECT label AS q_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS ord, vec_id, CASE WHEN vec_id % 7 = 0 THEN 900 ELSE CAST(vec_id % 100 AS INTEGER) END AS score, embedding FROM embeddings),
q AS (SELECT label AS q_id, arg_min(embedding, vec_id) AS query_vec FROM embeddings GROUP BY label),
c AS (SELECT h.*, CASE WHEN vec_id % 11 <> 0 THEN CAST(list_sum([CAST(a[1] AS DOUBLE) * CAST(a[2] AS DOUBLE) FOR a IN list_zip(query_vec, embedding)]) AS FLOAT) ELSE -1 END AS sim FROM h JOIN q USING (q_id)),
t AS (SELECT *, score < 500 AS tail, row_number() OVER (PARTITION BY q_id, score < 500 ORDER BY ord) - 1 AS i,
  row_number() OVER (PARTITION BY q_id, score < 500 ORDER BY sim DESC, ord) - 1 AS r, count(*) OVER (PARTITION BY q_id) AS n, count(*) FILTER (score < 500) OVER (PARTITION BY q_id) AS nt FROM c),
s AS (SELECT *, n >= 3 AND nt >= 3 AS fuse, CASE WHEN tail THEN CAST(CAST(1 AS FLOAT) / CAST(60 + i AS FLOAT) AS FLOAT) + CAST(CAST(1 AS FLOAT) / CAST(60 + r AS FLOAT) AS FLOAT) END AS rrf FROM t)
SELECT q_id, vec_id, CAST(CASE WHEN fuse THEN row_number() OVER (PARTITION BY q_id ORDER BY tail, CAST(rrf AS FLOAT) DESC NULLS LAST, ord) ELSE ord END AS INTEGER) AS ord FROM s""")
def semantic_rerank(spark, sf):
    """SO3, VE5: hits fused with the similarity of their vectors to the question's; one hit in eleven has none."""
    v = table(spark, sf, "embeddings")
    hits = v.select(F.col("label").alias("q_id"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("ord"), "vec_id", F.when(F.col("vec_id") % 7 == 0, 900).otherwise((F.col("vec_id") % 100).cast("int")).alias("score"))
    asked = v.groupBy(F.col("label").alias("q_id")).agg(F.min_by("embedding", "vec_id").alias("query_vec"))
    known = v.filter("vec_id % 11 <> 0").select(F.col("label").alias("q_id"), "vec_id", F.col("embedding").alias("passage_vec"))
    return candidates.reranked(hits, asked, known, key="vec_id").select("q_id", "vec_id", "ord")


_UNMARKED = "translate(text, '*`' || chr(10) || chr(13), '    ')"


@query(f"""
SELECT conv_id, turn, 'plain:' || replace(replace(t, ' the ', ' |bold:the|plain: '), ', ', ',|code:x,|plain: ') AS spans
FROM (SELECT conv_id, turn, {_UNMARKED} AS t FROM conversations) WHERE t <> ''""")
def markdown_spans(spark, sf):
    """TX20: bold and code put into every conversation's texts, and read off again."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.expr(_UNMARKED).alias("t")).filter("t <> ''")
    marked = F.replace(F.replace("t", F.lit(" the "), F.lit(" **the** ")), F.lit(", "), F.lit(",`x,` "))
    return rows.select("conv_id", "turn", F.array_join(F.transform(text.inline_spans(marked), lambda s: F.concat(s["style"], F.lit(":"), s["text"])), "|").alias("spans"))


@query("SELECT conv_id * 1000 + turn AS gen_id, text FROM conversations WHERE text <> ''")
def streamed_transcripts(spark, sf):
    """SS1, SS2: each turn's bytes come in pieces of seven, characters cut through, over
    two runs of a stream that starts again from its checkpoint; the pieces are put together."""
    at = shared_folder(spark, "transcripts")
    turns = table(spark, sf, "conversations").filter("text <> ''").select((F.col("conv_id") * 1000 + F.col("turn")).alias("gen_id"), F.encode("text", "UTF-8").alias("b"))
    seq = F.sequence(F.lit(0), F.floor((F.length("b") - 1) / 7).cast("int"))
    cut = turns.withColumn("last", F.element_at(seq, -1)).select("gen_id", "b", "last", F.explode(seq).alias("seq"))
    chunks = cut.select("gen_id", "seq", F.timestamp_millis(F.col("seq").cast("long")).alias("ts"), F.expr("substring(b, seq * 7 + 1, 7)").alias("bytes"), (F.col("seq") == F.col("last")).alias("done"), "last")
    for part in (chunks.filter("2 * seq <= last"), chunks.filter("2 * seq > last")):
        part.drop("last").write.mode("append").parquet(f"{at}/chunks")
        stream = running.reassembled(spark.readStream.schema(running.EVENTS).parquet(f"{at}/chunks"))
        stream.writeStream.format("parquet").option("path", f"{at}/pieces").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"])
    return spark.read.parquet(f"{at}/pieces").groupBy("gen_id").agg(F.array_join(pieces, "").alias("text"))


@query(f"""
WITH l AS (SELECT tag, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d %H:%M:%S.%g') || ' ' || level[1] || '/' || tag || ': ' || replace(message, chr(10), chr(1)) AS line FROM {_ENTRIES}),
c AS (SELECT line, sum(length(line) + 1) OVER (ORDER BY line DESC ROWS UNBOUNDED PRECEDING) AS to_end, sum(length(line) + 1) OVER () AS chars, sum(strlen(line) + 1) OVER () AS bytes FROM l)
SELECT line FROM c WHERE bytes <= 8192 OR to_end <= floor(chars / 2)""")
def log_sink(spark, sf):
    """SK3: a log that is written, rotated within the sink, and read again."""
    at = shared_folder(spark, "log")
    sinks.append_log(_entries(spark, sf), at, size=8192)
    return spark.read.text(at).select(F.col("value").alias("line"))
