from cards import FIXTURE
from pyspark.sql import functions as F

from quillgraph.functions import html
from quillgraph.functions.vocab import RU
from quillgraph.plans import answers
from quillgraph.sources import readers, sinks

BODY = "<p>" + "Мэр Иван Петров правил городом Тольятти. " * 20 + "</p>"
PAGES = [
    ("city", "Тольятти", FIXTURE.replace("./%D0%90%D0%B1%D0%B2", "./m3"), False, None),
    ("m3", "Сухих, Илья", "<table class=infobox><tr><th>Предшественник</th><td><a href='m2'>Николай Уткин</a></td></tr></table><p>Мэр Тольятти.</p>", False, None),
    ("m2", "Уткин, Николай", "<table class=infobox><tr><th>Предшественник</th><td>Сергей Жилкин (1996)</td></tr></table><p>Был мэром.</p>", False, None),
    ("list", "Мэры Тольятти", BODY, False, None),
    ("r", "Тольятти (город)", "", True, "city"),
]


def archive(spark):
    return html.parse_pages(spark.createDataFrame(PAGES, readers.ARTICLES), RU).cache()


def asked(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "q_id long, text string")


def test_candidates_of_a_list_question(spark):
    got = answers.gathered(asked(spark, "Перечисли всех мэров Тольятти", "ничего такого"), archive(spark), RU)
    rows = got.filter("q_id = 0").orderBy("ord").collect()
    assert rows[0]["path"] == "list" and rows[0]["score"] == 2000
    assert [r["path"] for r in rows if r["source_tag"]] == ["m3", "m2"]
    assert len({r["path"] for r in rows}) == len(rows)


def test_prompts_cover_questions_without_hits(spark):
    got = {r["q_id"]: r for r in answers.prompts(asked(spark, "кто мэр Тольятти", "zzz qqq"), archive(spark), RU).collect()}
    assert "=== Тольятти ===" in got[0]["prompt"] and got[0]["total"] >= 2
    assert got[1]["titles"] == [] and got[1]["prompt"].endswith("zzz qqq")


def list_stub():
    return lambda prompts, systems, most: ["Сергей Жилкин — 1996–2000\nНиколай Уткин — ?\nИлья Сухих — с 2012 года" if "Мэры Тольятти" in p else "ДА" for p in prompts]


def test_list_answer_stops_at_the_list_article(spark):
    got = answers.list_answers(asked(spark, "Перечисли всех мэров Тольятти"), archive(spark), RU, list_stub()).head()
    assert got["answer"] == "- **Сергей Жилкин** — 1996–2000\n- **Николай Уткин**\n- **Илья Сухих** — с 2012"


def agent_stub():
    return lambda prompts, systems, most: ["Ответ: Илья Сухих" if "Сухих, Илья" in p or "final" in p else "ПОИСК: Сухих, Илья" for p in prompts]


def test_agentic_loop(spark):
    got = answers.agentic(asked(spark, "кто построил завод"), archive(spark), RU, agent_stub()).collect()
    assert len(got) == 1 and got[0]["answer"] == "Ответ: Илья Сухих"


def test_excerpts_mark_the_seed_and_the_list(spark):
    pages = archive(spark)
    hits = answers.gathered(asked(spark, "Перечисли всех мэров Тольятти"), pages, RU)
    got = {r["title"]: (r["is_seed"], r["is_list_article"]) for r in answers.document_excerpts(hits, pages, RU).collect()}
    assert got["Мэры Тольятти"] == (True, True) and set(got) >= {"Тольятти", "Абв Г.", "Николай Уткин"}
    assert {got[t] for t in ("Тольятти", "Абв Г.", "Николай Уткин")} == {(False, False)}


def test_office_chain(spark):
    def generate(prompts, systems, most):
        return [", ".join(x[2:] for x in p.split("\n") if x.startswith("- ")) for p in prompts]

    pages = spark.createDataFrame([("city", "Тольятти", PAGES[0][2].replace("Абв Г.", "Илья Сухих"), False, None), *PAGES[1:4]], readers.ARTICLES)
    rows = answers.office_chains(asked(spark, "назови мэров Тольятти по годам"), html.parse_pages(pages, RU), RU, generate)
    got = rows.select(F.array_join("chain", " > ").alias("chain"), "answer").head()
    assert tuple(got) == ("Илья Сухих > Николай Уткин > Сергей Жилкин", "Илья Сухих, Николай Уткин, Сергей Жилкин")


def test_predecessors_of_cards(spark):
    starts = spark.createDataFrame([(1, "Илья Сухих")], "q_id long, name string")
    got = answers.predecessors(starts, archive(spark), RU).orderBy("step").collect()
    assert [r["name"] for r in got] == ["Илья Сухих", "Николай Уткин", "Сергей Жилкин"]


def test_history_round_trip(spark, tmp_path):
    path = str(tmp_path / "chats")
    chats = lambda *rows: spark.createDataFrame([(i, t, u, [("user", "x")]) for i, t, u in rows], readers.CONVERSATIONS)
    sinks.store_conversations(spark, path, chats((1, "a", 1), (2, "b", 2)))
    sinks.store_conversations(spark, path, chats((1, "c", 3)))
    assert [(r["id"], r["title"]) for r in sinks.history_table(spark, path).orderBy("id").collect()] == [(1, "c"), (2, "b")]
    sinks.forget_conversations(spark, path, spark.createDataFrame([(1,)], "id long"))
    assert sinks.history_table(spark, path).count() == 1


def test_file_sources(spark, tmp_path):
    (tmp_path / "a" / "m").mkdir(parents=True)
    for name in ("x.zim", "Y.ZIM", "z.txt", "a/m/q.gguf", "a/m/rerank.gguf"):
        (tmp_path / name).write_bytes(b"1234")
    assert [r["name"] for r in readers.archive_files(spark, [str(tmp_path)] * 2).collect()] == ["Y.ZIM", "x.zim"]
    assert [r["id"] for r in readers.local_models(spark, str(tmp_path)).collect()] == ["a/m/q.gguf"]
    (tmp_path / "h.json").write_text('[{"id": 1, "title": "t", "updated_at": 5, "messages": [{"role": "user", "text": "x"}], "new": 1}, {"id": 2, "title": "u", "updated_at": 9}]')
    assert [r["id"] for r in readers.conversations(spark, str(tmp_path / "h.json")).collect()] == [2, 1]
    (tmp_path / "log.txt").write_text("2024-01-02 03:04:05.678 W/TAG: msg\nrubbish\n")
    assert [r["message"] for r in readers.log_entries(spark, str(tmp_path / "log.txt")).collect()] == ["msg"]
