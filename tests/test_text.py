import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions.vocab import RU
from quillgraph.operators import chat, extraction

L = F.lit
LIST = "Перечисли всех мэров Тольятти за последние 30 лет"
GOLDEN = [
    (lambda: X.keywords(L(LIST), RU), "мэров тольятти"),
    (lambda: X.keywords(L("а ты?"), RU), "а ты?"),
    (lambda: X.is_list_question(L(LIST), RU), True),
    (lambda: X.is_list_question(L("кто отец Жилкина?"), RU), False),
    (lambda: X.entity(L(LIST), RU), "Тольятти"),
    (lambda: X.entity(L("кто отец Жилкина?"), RU), "Жилкина"),
    (lambda: X.entity(L("кто там"), RU), None),
    (lambda: X.role(L(LIST), RU), "Мэры"),
    (lambda: X.role(L("вице-президент США"), RU), "Президенты"),
    (lambda: X.role(L("кто отец Жилкина?"), RU), None),
    (lambda: X.chain_properties(L("кто отец Жилкина?"), RU), ["P26", "P22", "P25", "P40", "P3373", "P1365", "P1366"]),
    (lambda: F.size(X.chain_properties(L("что это"), RU)), 22),
    (lambda: X.section_anchors(L("лауреаты премии"), RU), ["награды", "лауреаты", "обладатели"]),
    (lambda: X.href_path(L("./%D0%A1%D1%83%D1%85%D0%B8%D1%85#bio")), "Сухих"),
    (lambda: X.href_path(L("../A/X")), "X"),
    (lambda: X.href_path(L("A/Y")), "Y"),
    (lambda: X.href_path(L("%ZZ")), "%ZZ"),
    (lambda: X.href_path(L("#top")), ""),
    (lambda: X.href_path(L("C++")), "C"),
    (lambda: X.href_title(L("A/Сухих,_Илья")), "Сухих, Илья"),
    (lambda: X.search_directive(L("**ПОИСК:** Уткин Николай"), RU), " Уткин Николай"),
    (lambda: X.search_directive(L("ответ"), RU), None),
    (lambda: X.parse_size(L("5.2M")), 5452595),
    (lambda: X.parse_size(L("110G")), 118111600640),
    (lambda: X.parse_size(L("850K")), 870400),
    (lambda: X.parse_size(L("1024")), 1024),
    (lambda: X.parse_size(L("-")), None),
    (lambda: X.parse_size(L("")), None),
    (lambda: X.human_bytes(L(0)), "—"),
    (lambda: X.human_bytes(L(1536)), "1.5 KB"),
    (lambda: X.human_count(L(999)), "999"),
    (lambda: X.human_count(L(1500)), "1k"),
    (lambda: X.human_count(L(1999999)), "1M"),
    (lambda: X.html_to_text(L("a&amp;lt;b<script>x</script>&#1078;&foo;")), "a<b ж"),
    (lambda: X.html_to_text(L("x&#128512;&nbsp;y &#0; z")), "x😀 y &#0; z"),
    (lambda: X.clean(L("a [ 1 ] ↗ b")), "a b"),
    (lambda: X.strip_html(L("<b>a</b>  c")), "a c"),
    (lambda: X.after_thinking(L("<think>a</think> b")), "b"),
    (lambda: X.visible_answer(L("<think>a</think>b<think>c")), "b"),
    (lambda: X.office_holder(L("Карточка:\nмэр: Илья Сухих"), RU), "Илья Сухих"),
    (lambda: X.normalised_name(L("Уткин, Николай")), "уткин николай"),
    (lambda: X.positive_number(L("1,5")), 1.5),
    (lambda: X.positive_number(L("-1")), None),
    (lambda: X.positive_number(L("x")), None),
    (lambda: X.display_name(L("m.GGUF")), "m"),
    (lambda: X.or_path(L(" "), L("p")), "p"),
    (lambda: X.rounded_seconds(L(1500)), 2),
    (lambda: X.safe_ratio(L(1), L(0)), 0.0),
    (lambda: X.encoded_path(L("a b/c")), "a%20b/c"),
    (lambda: X.wants_enumeration(L("назови их"), RU), True),
    (lambda: chat.token_budget(L(50)), 256),
    (lambda: chat.token_budget(L(200)), 800),
    (lambda: chat.token_budget(L(600)), 2048),
    (lambda: chat.with_topic(L("Какой автозавод там расположен?"), L("Расскажи про Тольятти"), RU), "Какой автозавод там расположен? тольятти"),
    (lambda: chat.with_topic(L("Перечисли мэров города Самара"), L("Расскажи про Тольятти"), RU), "Перечисли мэров города Самара"),
    (lambda: chat.with_topic(L("а где?"), L(None).cast("string"), RU), "а где?"),
]


@pytest.mark.parametrize("k", range(len(GOLDEN)))
def test_golden(one, k):
    column, want = GOLDEN[k]
    assert one(column()) == want


def item(one, line):
    got = one(extraction.item_of(L(line), RU))
    return got and tuple(got)


def test_answer_lines(one):
    assert item(one, "**Исполнительная власть:**") is None
    assert item(one, "1. Уткин, Николай Дмитриевич (род.1949) — 1992 год – 1994 год") == ("Уткин, Николай Дмитриевич", "1992 – 1994")
    assert item(one, "Сергей Жилкин — 1996–2000") == ("Сергей Жилкин", "1996–2000")
    assert item(one, "Илья Сухих — ?") == ("Илья Сухих", "?")
    assert item(one, "НЕТ") is None
    assert item(one, "- ДА, Пётр Иванов - с 2001 года") == ("Пётр Иванов", "с 2001")


def test_archive_names(one):
    assert tuple(one(X.archive_name(L("wikipedia_en_all_maxi_2024-05.zim")))) == ("en", "all", "maxi")
    assert tuple(one(X.archive_name(L("wikipedia_ru_all_2024-05.zim")))) == (None, None, None)


def test_model_names(one):
    assert tuple(one(X.model_owner(L("a/b/c")))) == ("a", "b/c")
    assert tuple(one(X.model_owner(L("b")))) == ("unknown", "b")


def test_markdown(one):
    got = [tuple(x) for x in one(X.markdown_lines(L("# T\n\n- a\n2) b\ntext")))]
    assert got == [("heading", 1, None, "T"), ("blank", None, None, ""), ("bullet", None, None, "a"), ("numbered", None, "2)", "b"), ("para", None, None, "text")]
    assert [tuple(x) for x in one(X.inline_spans(L("a **b** `c` **d")))] == [("plain", "a "), ("bold", "b"), ("plain", " "), ("code", "c"), ("plain", " **d")]


def test_null_inputs_give_null_or_default(one):
    none = L(None).cast("string")
    for f in (X.clean, X.href_path, X.parse_size, X.html_to_text, X.after_thinking):
        assert one(f(none)) is None
    assert one(X.human_bytes(L(None).cast("long"))) == "—"
