"""Scalar text functions as Column builders: they stay inside the JVM's generated code.

Lengths count code points. Punctuation is PUNCT everywhere; case folding is Unicode."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.vocab import Profile

#: ASCII punctuation, typographic quotes, dashes and the ellipsis, for Java's and RE2's regex engines alike.
PUNCT = r"[!-/:-@\[-`{-~«»“”„…—–]"
SPACE = r"[\s\x{00A0}]+"


def words_of(values: Iterable[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def holds_any(text: Column, parts: Iterable[str]) -> Column:
    """PF1, PF12, PF15: text holds one of the parts."""
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


# --- questions -------------------------------------------------------------

def tokens(question: Column) -> Column:
    """Lower-cased words without punctuation; empty ones may stand at the ends."""
    return F.split(F.regexp_replace(F.lower(question), PUNCT, " "), r"\s+")


def keyword_list(question: Column, profile: Profile) -> Column:
    stop = set(profile.stop_words)
    return F.filter(tokens(question), lambda t: (F.length(t) >= 3) & ~t.isin(*sorted(stop)) if stop else F.length(t) >= 3)


def keywords(question: Column, profile: Profile) -> Column:
    """TX1: the question's keywords in order; without any, the trimmed question."""
    found = F.array_join(keyword_list(question, profile), " ")
    return F.when(found == "", F.trim(question)).otherwise(found)


def is_list_question(question: Column, profile: Profile) -> Column:
    return holds_any(F.lower(question), profile.list_markers)


def wants_enumeration(question: Column, profile: Profile) -> Column:
    return holds_any(F.lower(question), profile.enumeration_markers)


def longest(values: Column) -> Column:
    """AG5: the longest element, the first of equals; null for an empty array."""
    return F.aggregate(values, F.lit(None).cast("string"), lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best))


def entity(question: Column, profile: Profile) -> Column:
    """TX2: the longest capitalised word that names neither a role nor an instruction."""
    first = lambda t: F.substring(t, 1, 1)
    parts = F.split(F.regexp_replace(question, PUNCT, " "), r"\s+")

    def fits(t: Column) -> Column:
        ok = (F.length(t) >= 4) & first(t).rlike(r"^\p{Lu}")
        if profile.role_words:
            ok = ok & ~t.isin(*profile.role_words)
        for stem in profile.instruction_stems:
            ok = ok & ~F.lower(t).startswith(stem)
        return ok

    return longest(F.filter(parts, fits))


def role(question: Column, profile: Profile) -> Column:
    """TX3: the label of the first stem, in the table's order, that the question holds."""
    q = F.lower(question)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for stem, label in profile.roles:
        out = out.when(q.contains(stem), F.lit(label))
    return out


def _first_profile(question: Column, table, default: tuple[str, ...]) -> Column:
    q = F.lower(question)
    out = F.when(F.lit(False), words_of(()))
    for triggers, values in table:
        out = out.when(holds_any(q, triggers), words_of(values))
    return out.otherwise(words_of(default))


def section_anchors(question: Column, profile: Profile) -> Column:
    return _first_profile(question, profile.anchors, ())


def chain_properties(question: Column, profile: Profile) -> Column:
    return _first_profile(question, profile.properties, profile.all_properties)


def filled(template: str, role_: Column, entity_: Column) -> Column:
    """template with {role}, {low} and {entity} replaced; null if one it names is null."""
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), {"role": role_, "low": F.lower(role_), "entity": entity_}[name]]
    return F.concat(*parts, F.lit(rest))


def title_templates(role_: Column, entity_: Column, profile: Profile) -> Column:
    """TX7: titles to look up, in order, without repeats."""
    every = [filled(t, role_, entity_) for t in (*profile.role_templates, *profile.templates)]
    return F.array_distinct(F.filter(F.array(*every), lambda t: t.isNotNull()))


def list_titles(role_: Column, entity_: Column, profile: Profile) -> Column:
    every = [filled(t, role_, entity_) for t in (*profile.role_templates[:2], *profile.list_templates)]
    return F.array_distinct(F.filter(F.array(*every), lambda t: t.isNotNull()))


# --- markup ----------------------------------------------------------------

def html_to_text(html: Column) -> Column:
    """ST1: scripts, styles and tags become spaces, five named entities and #39 are
    decoded one after another (so text encoded twice is decoded twice), then decimal
    entities; other named entities become spaces, white space is squeezed."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for name, to in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        t = F.replace(t, F.lit(name), F.lit(to))
    t = decimal_entities(t)
    return squeeze(F.regexp_replace(t, r"&[a-zA-Z]+;", " "))


def decimal_entities(text: Column) -> Column:
    """&#n; to the character n, for 1 <= n <= 0x10FFFF, by UTF-32 bytes: still no UDF."""
    code = F.regexp_extract_all(text, F.lit(r"&#(\d{1,7});"), 1)

    def fold(acc: Column, n: Column) -> Column:
        value = F.try_to_number(n, F.lit("9999999")).cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
        return F.when(value.between(1, 0x10FFFF) & ~value.between(0xD800, 0xDFFF), F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), char)).otherwise(acc)

    return F.aggregate(F.array_distinct(code), text, fold)


def strip_html(text: Column) -> Column:
    """ST2."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " "))


def clean(text: Column) -> Column:
    """ST3: without "[ n ]" references and arrows, white space squeezed."""
    return squeeze(F.regexp_replace(F.regexp_replace(text, r"\[\s*\d+\s*\]", " "), r"[\x{2190}-\x{21FF}]", " "))


def href_path(href: Column) -> Column:
    """TX8: a link's path: one "./", then one "../" and the fragment go, percent
    signs are decoded (if they can be), a leading "A/" goes."""
    h = F.trim(href)
    h = F.regexp_replace(F.regexp_replace(h, r"^\./", ""), r"^\.\./", "")
    h = F.regexp_replace(h, r"(?s)#.*$", "")
    h = F.coalesce(F.try_url_decode(h), h)
    return F.trim(F.regexp_replace(h, "^A/", ""))


def href_title(href: Column) -> Column:
    """TX9."""
    tail = F.substring_index(href, "/", -1)
    return F.translate(F.coalesce(F.try_url_decode(tail), tail), "_", " ")


# --- answers ---------------------------------------------------------------

def normalised_name(name: Column) -> Column:
    """TX11."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^а-яёa-z ]", " "), r"\s+", " "))


def normalised_query(query: Column) -> Column:
    """TX12."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(query), PUNCT, " "), r"\s+", " "))


def looks_like_name(name: Column) -> Column:
    """PF9: a capitalised word of letters (Cyrillic or Latin-1) is there."""
    return F.coalesce(name.rlike("[А-ЯЁ][а-яё]+"), F.lit(False))


def after_thinking(text: Column) -> Column:
    """TX13, batch form: what follows the last closing tag; if blank, what precedes the first opening one."""
    after = F.when(text.contains("</think>"), F.substring_index(text, "</think>", -1)).otherwise(text)
    before = F.substring_index(text, "<think>", 1)
    tagged = text.contains("<think>") | text.contains("</think>")
    return F.when(~tagged, text).otherwise(F.trim(F.when(F.trim(after) == "", before).otherwise(after)))


def visible_answer(text: Column) -> Column:
    """TX13, running form: closed blocks go, an open one cuts the text."""
    closed = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.regexp_replace(F.substring_index(closed, "<think>", 1), r"^\s+", "")


def _bare(line: Column) -> Column:
    return F.regexp_replace(F.trim(line), r'^[*#>` "]+|[*#>` "]+$', "")


def is_directive(line: Column, profile: Profile) -> Column:
    """PF16."""
    bare = _bare(line)
    return F.lower(bare).startswith(profile.directive) & bare.rlike(rf"(?iu){profile.directive}\s*[:：．.\-—]\s*.+")


def search_directive(text: Column, profile: Profile) -> Column:
    """TX14: the query of the first directive line with one, 80 characters at most; else null."""
    def query(line: Column) -> Column:
        got = F.regexp_extract(_bare(line), rf"(?iu){profile.directive}\s*[:：．.\-—]\s*(.+)", 1)
        cut = F.substring(F.regexp_replace(F.trim(got), '^[«»"*`_]+|[«»"*`_]+$', ""), 1, 80)
        return F.when(is_directive(line, profile) & (F.trim(cut) != ""), cut)

    found = F.filter(F.transform(F.split(text, "\n"), query), lambda q: q.isNotNull())
    return F.get(found, F.lit(0))


def without_directives(text: Column, profile: Profile) -> Column:
    return F.trim(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~is_directive(x, profile)), "\n"))


def office_holder(card: Column, profile: Profile) -> Column:
    """TX15."""
    found = F.trim(F.regexp_extract(card, "(?imu)^(?:" + "|".join(profile.office_labels) + r")\s*:\s*(.+)$", 1))
    return F.when(found != "", found)


# --- sizes, names, numbers --------------------------------------------------

def parse_size(text: Column) -> Column:
    """TX16: 5.2M, 110G, 850K, 1024; null for empty, "-" and other text. Fractions are cut."""
    t = F.upper(F.trim(text))
    unit = F.regexp_extract(t, "([KMGT]?)$", 1)
    number = F.trim(F.regexp_replace(t, "[KMGT]$", "")).try_cast("double")
    factor = F.when(unit == "K", 2.0**10).when(unit == "M", 2.0**20).when(unit == "G", 2.0**30).when(unit == "T", 2.0**40).otherwise(1.0)
    return (number * factor).cast("long")


# Fixed value: the archives' file name format.
ARCHIVE = r"(?i)^wikipedia_([a-z]{2,3})_([a-z][a-z0-9]*)_(maxi|mini|nopic)_(\d{4}-\d{2})\.zim$"


def archive_name(name: Column) -> Column:
    """TX17: struct(language, topic, variant), all null for another pattern."""
    part = lambda k: F.nullif(F.regexp_extract(name, ARCHIVE, k), F.lit(""))
    return F.struct(part(1).alias("language"), part(2).alias("topic"), F.lower(part(3)).alias("variant"))


def human_bytes(n: Column, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB")) -> Column:
    """TX18: one decimal, factor 1024, a dash for nothing. Without "TB" among the units it stops at GB."""
    out = F.when(n.isNull() | (n <= 0), F.lit("—"))
    for k, unit in enumerate(units):
        last = k == len(units) - 1
        size = n / F.lit(float(1024**k))
        text = F.format_string(f"%d {unit}", n.cast("long")) if k == 0 else F.format_string(f"%.1f {unit}", size)
        out = out.otherwise(text) if last else out.when(n < 1024 ** (k + 1), text)
    return out


def human_count(n: Column) -> Column:
    """TX19."""
    whole = lambda d: F.floor(n / d).cast("string")
    return F.when(n >= 1_000_000, F.concat(whole(1_000_000), F.lit("M"))).when(n >= 1000, F.concat(whole(1000), F.lit("k"))).otherwise(n.cast("string"))


def percent(ratio: Column) -> Column:
    return F.floor(ratio * 100).cast("int")


def safe_ratio(part: Column, total: Column) -> Column:
    """TX27."""
    return F.when(total > 0, part / total).otherwise(F.lit(0.0))


def positive_number(text: Column) -> Column:
    """TX26: a decimal with comma or point, above zero; else null."""
    v = F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("float")
    return F.when(v > 0, v)


def plain_number(v: Column) -> Column:
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def in_size_range(name: Column, low: float, high: float) -> Column:
    """PF3: a parameter count such as 1.5B in the name lies in [low, high]."""
    found = F.regexp_extract_all(name, F.lit(r"(?i)(?<![a-z0-9.])(\d+(?:\.\d+)?)\s*b(?![a-z])"), 1)
    return F.exists(found, lambda x: x.cast("float").between(low, high))


def model_owner(model_id: Column) -> Column:
    """PF5: struct(author, name)."""
    has = model_id.contains("/")
    return F.struct(F.when(has, F.substring_index(model_id, "/", 1)).otherwise(F.lit("unknown")).alias("author"), F.when(has, F.regexp_replace(model_id, "^[^/]*/", "")).otherwise(model_id).alias("name"))


def rounded_seconds(ms: Column) -> Column:
    """TX28."""
    return F.floor((ms + 500) / 1000).cast("long")


def stats_line(rate: Column, tokens_: Column, ms: Column) -> Column:
    return F.format_string("%.1f tok/s · %d tok · %d s", rate, tokens_, rounded_seconds(ms))


def or_path(title: Column, path: Column) -> Column:
    """TX29: a blank title gives way to the path."""
    return F.when(F.trim(F.coalesce(title, F.lit(""))) == "", path).otherwise(title)


def display_name(file: Column) -> Column:
    return F.regexp_replace(file, r"(?i)\.gguf$", "")


def code_of(value: Column, codes: dict[str, int], default: int) -> Column:
    """TX30."""
    out = F.lit(default)
    for name, code in codes.items():
        out = F.when(value == name, F.lit(code)).otherwise(out)
    return out


def error_kind(message: Column) -> Column:
    """TX25: what a generation error is about."""
    m = F.lower(F.coalesce(message, F.lit("")))
    code = F.regexp_extract(m, r"(?:error|code|rc)\s*[=: ]\s*(-?\d+)", 1)
    return F.when(m.rlike("memory|alloc|oom"), "memory").when(m.rlike("context|n_ctx|too long"), "context").when(m.rlike("cancel|stop"), "stopped").when(code != "", F.concat(F.lit("code "), code)).otherwise("other")


def encoded_path(path: Column) -> Column:
    """TX24: each segment percent-encoded, slashes kept."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")


# --- Markdown ----------------------------------------------------------------

def markdown_lines(text: Column) -> Column:
    """TX20: structs (kind, level, num, text) of the text's lines; inline_spans gives a line's parts."""
    def parsed(raw: Column) -> Column:
        x = F.trim(raw)
        num = r"(?s)^(\d{1,3}[.)])\s+(.*)"

        def made(kind: str, text: Column, level: int | None = None, number: Column | None = None) -> Column:
            return F.struct(F.lit(kind).alias("kind"), F.lit(level).cast("int").alias("level"), (F.lit(None).cast("string") if number is None else number).alias("num"), text.alias("text"))

        out = F.when(x == "", made("blank", F.lit("")))
        for level in (3, 2, 1):
            out = out.when(x.startswith("#" * level + " "), made("heading", F.substr(x, F.lit(level + 2)), level))
        out = out.when(x.startswith("- ") | x.startswith("* "), made("bullet", F.substr(x, F.lit(3))))
        out = out.when(x.rlike(num), made("numbered", F.regexp_extract(x, num, 2), None, F.regexp_extract(x, num, 1)))
        return out.otherwise(made("para", x))

    return F.transform(F.split(text, "\n"), parsed)


def inline_spans(text: Column) -> Column:
    """Bold, code and plain parts of a line, in order; an unclosed mark is plain text."""
    parts = F.regexp_extract_all(text, F.lit(r"(\*\*.+?\*\*|`.*?`|(?:(?!\*\*.+?\*\*)(?!`.*?`).)+)"), 1)

    def styled(p: Column) -> Column:
        bold, code = p.rlike(r"^\*\*.+\*\*$"), p.rlike("^`.*`$")
        return F.struct(F.when(bold, "bold").when(code, "code").otherwise("plain").alias("style"), F.when(bold, F.substr(p, F.lit(3), F.length(p) - 4)).when(code, F.substr(p, F.lit(2), F.length(p) - 2)).otherwise(p).alias("text"))

    return F.transform(parts, styled)
