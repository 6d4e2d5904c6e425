"""Whole question lifecycles over batches of questions.

questions: (q_id, text). articles: parsed pages (path, title, is_redirect,
redirect_to, card, links, body, sections), from readers.ingested."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import html, text
from quillgraph.functions.vocab import Profile
from quillgraph.operators import candidates, excerpts, extraction, graph, index
from quillgraph.operators.storage import durable



def analysed(questions: DataFrame, profile: Profile) -> DataFrame:
    """Every property of the questions that later steps ask for, worked out once."""
    q = F.col("text")
    rows = questions.withColumns({"query": text.keywords(q, profile), "terms": text.keyword_list(q, profile), "is_list": text.is_list_question(q, profile), "entity": text.entity(q, profile), "role": text.role(q, profile), "anchors": text.section_anchors(q, profile), "props": text.chain_properties(q, profile)})
    return rows


def _shaped(hits: DataFrame, tag: bool = False) -> DataFrame:
    return hits.select("q_id", F.col("ord").cast("int").alias("ord"), "title", "path", F.lit("").alias("snippet"), F.col("score").cast("int").alias("score"), F.col("source_tag") if tag else F.lit(None).cast("string").alias("source_tag"))


def list_probes(asked: DataFrame, articles: DataFrame, profile: Profile) -> DataFrame:
    """RT1: the dedicated list article, then exact and suggested titles, then category pages."""
    asking = asked.filter("is_list and entity is not null")
    names = asking.select("q_id", F.posexplode(text.list_titles(F.col("role"), F.col("entity"), profile)).alias("ord", "title_asked"))
    tier0 = candidates.list_article(index.raw_titles(names, articles)).select("q_id", F.lit(0).alias("ord"), "title", "path", "score")
    every = asking.select("q_id", F.posexplode(text.title_templates(F.col("role"), F.col("entity"), profile)).alias("ord", "title_asked"))
    tier_a = index.lookup_titles(every, articles).select("q_id", "ord", "title", "path", "score")
    prefixes = asking.filter("role is not null").select("q_id", F.lit(0).alias("ord"), text.filled(profile.category_prefix, F.col("role"), F.col("entity")).alias("prefix"))
    tier_b = index.prefix_matches(prefixes, articles, 3).select("q_id", F.row_number().over(Window.partitionBy("q_id").orderBy("title", "path")).alias("ord"), "title", "path", "score")
    return candidates.union_first([_shaped(tier0), _shaped(tier_a), _shaped(tier_b)])


def link_edges(articles: DataFrame) -> DataFrame:
    rows = articles.select(F.col("path").alias("src_path"), F.posexplode("links").alias("ord", "l"))
    return rows.select("src_path", F.col("l.prop").alias("prop"), F.col("l.text").alias("text"), F.col("l.href").alias("dst_path"), "ord")


def walker_probes(asked: DataFrame, articles: DataFrame, profile: Profile, max_nodes: int = 6, max_depth: int = 4) -> DataFrame:
    """GR2 for every question with an entity."""
    probes = asked.filter("entity is not null").select("q_id", F.col("entity").alias("title_asked"))
    seeds = index.lookup_titles(probes, articles).select("q_id", "path", "title", "score")
    props = asked.select("q_id", F.posexplode("props").alias("prop_ord", "prop"))
    walked = graph.bounded_walk(seeds, link_edges(articles), properties=props, max_nodes=max_nodes, max_depth=max_depth)
    return graph.walk_hits(walked, seeds, profile)


def searched(asked: DataFrame, articles: DataFrame, query_col: str, k: int) -> DataFrame:
    """The full-text lane."""
    found = index.bm25_search(articles.filter(~F.col("is_redirect")), asked, id_col="path", text_col="body", query_col=query_col, k=k)
    found = durable(found)
    named = found.join(index.only(articles, found, "path").select("path", "title", F.substring("body", 1, 300).alias("snippet")), "path")
    return named.select("q_id", F.col("rank").alias("ord"), "title", "path", "snippet", F.least(F.round("score"), F.lit(100.0)).cast("int").alias("score"), F.lit(None).cast("string").alias("source_tag"))


def gathered(questions: DataFrame, articles: DataFrame, profile: Profile, *, limit: int = 20, excluded: DataFrame | None = None, query_vectors: DataFrame | None = None, passage_vectors: DataFrame | None = None) -> DataFrame:
    """RT2: ranked candidates of each question, with its terms and flags.

    Lanes: list probes, the link walk, full text; of equal paths the first lane's row
    stays. The longest keyword, from four characters on, is searched as well where it is not the whole query,
    and its new paths follow: that is also the second try of a question without hits.
    Then the title boost, exclusion and, with vectors, rank fusion. Lanes and result are
    checkpointed: each is a table of a few rows for a question that several later steps read."""
    asked = durable(analysed(questions, profile))
    lanes = [_shaped(list_probes(asked, articles, profile)), _shaped(walker_probes(asked, articles, profile), True), searched(asked, articles, "query", limit)]
    hits = durable(candidates.union_first([durable(lane) for lane in lanes]))
    alone = asked.withColumn("longest", text.longest(F.col("terms"))).filter("length(longest) >= 4 and longest <> query")
    hits = candidates.append_missing(hits, searched(alone, articles, "longest", limit))
    hits = candidates.title_boosted(hits.join(asked.select("q_id", "terms", "is_list", F.col("text").alias("question"), "anchors"), "q_id"))
    if excluded is not None:
        hits = candidates.without_titles(hits, excluded)
    if query_vectors is not None and passage_vectors is not None:
        hits = candidates.reranked(hits, query_vectors, passage_vectors)
    return durable(hits)


def opened(hits: DataFrame, articles: DataFrame, profile: Profile) -> DataFrame:
    """JN1: hits with their article's card block, body and the sections the question asks for."""
    own = index.only(articles, hits, "path").select("path", html.card_block(F.col("card"), profile).alias("card"), "body", "sections")
    return hits.join(own, "path", "left").withColumn("section", html.sections_text(F.col("sections"), F.col("anchors"), 1 << 20)).drop("sections")


def excerpt_blocks(hits: DataFrame, articles: DataFrame, profile: Profile, *, top_k: int = 4, budget: int = 4500, list_budget: int = 9000) -> DataFrame:
    """PR2: only rows that may be packed are joined to their articles."""
    w = Window.partitionBy("q_id")
    near = hits.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy("ord"))).filter(F.col("_r") <= max(12, top_k))
    rows = opened(near, articles, profile).withColumn("top_k", F.lit(top_k)).withColumn("budget", F.when(F.col("is_list"), F.greatest(F.lit(budget), F.lit(list_budget))).otherwise(F.lit(budget)))
    return excerpts.packed(rows.drop("_r", "_n"), profile)


def prompts(questions: DataFrame, articles: DataFrame, profile: Profile, **options) -> DataFrame:
    """PR5: (q_id, prompt, titles, total) for every question, also those without hits."""
    say = profile.strings
    blocks = excerpt_blocks(gathered(questions, articles, profile), articles, profile, **options)
    rows = questions.join(blocks, "q_id", "left")
    with_hits = F.concat(F.lit(f"=== {say['excerpts']} ===\n"), F.col("block"), F.lit(f"===\n\n{say['question']}: "), F.col("text"))
    bare = F.concat(F.lit(f"{say['question']}: "), F.col("text"))
    return rows.select("q_id", F.when(F.coalesce("block", F.lit("")) != "", with_hits).otherwise(bare).alias("prompt"), F.coalesce("titles", F.array().cast("array<string>")).alias("titles"), F.coalesce("total", F.lit(0)).alias("total"))


def document_excerpts(hits: DataFrame, articles: DataFrame, profile: Profile, *, top_k: int = 6, chars: int = 900) -> DataFrame:
    """PR1, PR4: one excerpt for each of a question's first articles: for list questions
    only confident ones; a list article gets 6 times the characters, a seed's
    leadership section 3 times."""
    sure = candidates.confident_or_all(hits.filter("is_list")).unionByName(hits.filter("not is_list"))
    near = sure.withColumn("_r", F.row_number().over(Window.partitionBy("q_id").orderBy("ord"))).filter(F.col("_r") <= top_k)
    rows = opened(near, articles, profile).filter("body is not null")
    seed = (F.col("_r") == 1) & F.col("is_list")
    article = seed & (F.col("score") >= candidates.LIST_ARTICLE)
    rows = rows.withColumns({"is_seed": seed, "is_list_article": article, "_id": F.concat_ws("\u0001", F.col("q_id").cast("string"), "path")})
    out = None
    for cap, fits in ((chars * 6, article), (chars * 3, seed & ~article), (chars, ~seed)):
        part = excerpts.relevant_chunk(rows.filter(fits), id_col="_id", body_col="body", title_col="title", terms_col="terms", cap=cap, profile=profile)
        part = part.withColumn("chunk", F.when(F.col("is_seed") & ~F.col("is_list_article") & (F.col("section") != ""), F.substring("section", 1, cap)).otherwise(F.col("chunk")))
        out = part if out is None else out.unionByName(part)
    body = F.concat(F.lit("=== "), "title", F.lit(" ===\n"), F.when(F.col("card") != "", F.concat("card", F.lit("\n"))).otherwise(""), "chunk")
    return out.select("q_id", F.col("_r").alias("ord"), "question", "title", "path", body.alias("text"), "source_tag", "is_seed", "is_list_article")


def list_answers(questions: DataFrame, articles: DataFrame, profile: Profile, generate: extraction.Generator) -> DataFrame:
    """LX1 to LX3 for list questions."""
    docs = document_excerpts(gathered(questions, articles, profile), articles, profile)
    return extraction.markdown_list(extraction.list_answers(docs, generate, profile))


def predecessors(starts: DataFrame, articles: DataFrame, profile: Profile, steps: int = 3) -> DataFrame:
    """GR3 over the cards of the archive. A title "Surname, Name" also answers to "Name Surname"."""
    rows = articles.select("title", html.card_field(F.col("card"), profile.predecessor).alias("before")).filter("before is not null")
    turned = F.regexp_replace("title", r"^([^,]+), (.+)$", "$2 $1")
    both = rows.select(text.normalised_query(F.col("title")).alias("name_key"), "before").union(rows.select(text.normalised_query(turned).alias("name_key"), "before"))
    return graph.predecessor_chain(starts, both.groupBy("name_key").agg(F.min("before").alias("before")), steps=steps)


def office_chains(questions: DataFrame, articles: DataFrame, profile: Profile, generate: extraction.Generator, steps: int = 3) -> DataFrame:
    """(q_id, chain, answer) of questions that want an enumeration and whose entity's card
    names an office holder: the holder and the names before, put into words by the generator."""
    asked = analysed(questions.filter(text.wants_enumeration(F.col("text"), profile)), profile).filter("entity is not null")
    seeds = index.lookup_titles(asked.select("q_id", F.col("entity").alias("title_asked")), articles).join(articles.select("path", "card"), "path")
    holder = text.office_holder(html.card_block(F.col("card"), profile), profile)
    starts = seeds.select("q_id", holder.alias("name")).filter("name is not null")
    names = predecessors(starts, articles, profile, steps).groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("step", "name"))).alias("l"))
    chains = names.select("q_id", F.transform("l", lambda x: x["name"]).alias("chain")).join(questions, "q_id")
    listed = F.array_join(F.transform("chain", lambda n: F.concat(F.lit("- "), n)), "\n")
    rows = chains.select("q_id", "chain", F.col("text").alias("question"), F.lit("").alias("title"), listed.alias("text"), F.lit(True).alias("is_seed"))
    return extraction.map_documents(rows, generate, profile).select("q_id", "chain", text.after_thinking(F.col("raw")).alias("answer"))


def agentic(questions: DataFrame, articles: DataFrame, profile: Profile, generate: extraction.Generator, *, hops: int = 3) -> DataFrame:
    """AGN1: (q_id, answer, hops): each question's context grows by searches that the
    generator asks for, hops times at most; a repeated query costs its hop. Questions
    that office_chains answers go that way first.

    One plan for all open questions at each hop; what is settled leaves the loop."""
    say = profile.strings
    chained = durable(office_chains(questions, articles, profile, generate).select("q_id", "answer", F.lit(0).alias("hops")))
    questions = questions.join(chained, "q_id", "left_anti")
    first = excerpt_blocks(gathered(questions, articles, profile), articles, profile, top_k=4, budget=3500, list_budget=3500)
    state = questions.join(first, "q_id", "left").select("q_id", "text", F.coalesce("block", F.lit("")).alias("seed"), F.lit("").alias("trail"), F.coalesce("titles", F.array().cast("array<string>")).alias("seen"), F.array().cast("array<string>").alias("asked"))
    done = chained
    for hop in range(hops + 1):
        final = hop == hops
        prompt = F.concat(F.lit(f"{say['question']}: "), "text", F.lit("\n\n"), excerpts.agentic_context(F.col("seed"), F.col("trail")), F.lit(f"\n\n{'final' if final else profile.directive}"))
        asking = state.withColumns({"question": prompt, "title": F.lit(""), "is_seed": F.lit(True)}).withColumn("text0", F.col("text")).withColumn("text", F.lit(""))
        told = durable(extraction.map_documents(asking, generate, profile).withColumn("text", F.col("text0")))
        told = told.withColumn("next", text.search_directive(text.after_thinking(F.col("raw")), profile))
        settled = told.filter(F.col("next").isNull() | F.lit(final)).select("q_id", text.without_directives(text.after_thinking(F.col("raw")), profile).alias("answer"), F.lit(hop).alias("hops"))
        done = done.unionByName(settled)
        if final:
            break
        more = told.filter("next is not null").withColumn("repeat", F.array_contains("asked", text.normalised_query(F.col("next"))))
        excluded = more.select("q_id", F.explode("seen").alias("title"))
        found = excerpt_blocks(gathered(more.filter("not repeat").select("q_id", F.col("next").alias("text")), articles, profile, excluded=excluded), articles, profile, top_k=2, budget=1800, list_budget=1800)
        state = more.join(found.select("q_id", F.col("block").alias("b"), F.col("titles").alias("t")), "q_id", "left").select("q_id", "text", "seed", F.concat("trail", F.coalesce("b", F.lit(""))).alias("trail"), F.array_union("seen", F.coalesce("t", F.array().cast("array<string>"))).alias("seen"), F.array_append("asked", text.normalised_query(F.col("next"))).alias("asked"))
        state = durable(state)
    return done
