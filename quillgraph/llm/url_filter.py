"""URL filters: each rule is filed under its rarest literal token, a URL's tokens
fetch candidate rules, and only those run their regular expression."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants, _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import quoted

TOKEN = r"[a-z0-9]+"
#: A rule table of up to so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_RULES = 50_000


ALNUM = frozenset(map(ord, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
#: What stands for an item of a pattern in edges(): it only fits where a token ends, or it may fit anything.
EDGE, ANY = "edge", "any"


@dataclass(frozen=True)
class Rule:
    """A host-and-path rule ("net/de/") or a pattern, both by a regex on host + path.

    tokens: lower-case alphanumeric tokens, of which every URL that the rule fits
    has all, each as a whole token."""

    text: str
    verdict: str
    regex: str | None = None
    tokens: tuple[str, ...] = ()


def host_rule(text: str, verdict: str) -> Rule:
    """A path's last token may go on in the URL, so it counts only before a "/"."""
    host, slash, path = text.partition("/")
    whole = host.lower() + slash + path[: path.rfind("/") + 1]
    regex = r"^(?:[^/?#]*\.)?" + re.escape(host.lower()) + (re.escape(slash + path) if slash else "(?=/|$)")
    return Rule(text, verdict, regex, tuple(re.findall(TOKEN, whole.lower())))


def edges(items) -> list:
    """For each item of a parsed pattern: the character it stands for, EDGE or ANY."""
    out = []
    for kind, value in items:
        if kind is _constants.LITERAL:
            out.append(value)
        elif kind is _constants.AT:
            out.append(EDGE if value in (_constants.AT_BEGINNING, _constants.AT_BEGINNING_STRING, _constants.AT_END, _constants.AT_END_STRING) else ANY)
        elif kind is _constants.IN:
            out.append(EDGE if never_alnum(value) else ANY)
        elif kind is _constants.SUBPATTERN:
            out += edges(value[3])
        elif kind is _constants.BRANCH:
            each = [edges(x) for x in value[1]]
            out.append(EDGE if all(len(x) == 1 and (x[0] is EDGE or x[0] is not ANY and x[0] not in ALNUM) for x in each) else ANY)
        elif kind is _constants.MAX_REPEAT and value[0] >= 1 and len(once := edges(value[2])) == 1 and (once[0] is EDGE or once[0] is not ANY and once[0] not in ALNUM):
            out.append(EDGE)
        else:
            out.append(ANY)
    return out


def never_alnum(members) -> bool:
    """Whether a character class has no alphanumeric member."""
    negated = bool(members) and members[0][0] is _constants.NEGATE
    held: set[int] = set()
    for kind, value in members[negated:]:
        if kind is _constants.LITERAL:
            held.add(value)
        elif kind is _constants.RANGE:
            held.update(ALNUM.intersection(range(value[0], value[1] + 1)))
        elif not negated:  # a category: it may hold anything
            return False
    return held >= ALNUM if negated else not held & ALNUM


def pattern_tokens(regex: str) -> tuple[str, ...]:
    """The whole tokens that any text has in which the pattern is found: runs of
    alphanumeric characters outside any choice, between characters or positions where
    a token ends. None is named that could be missing."""
    tree = _parser.parse(regex)
    found, run, fresh = [], "", False
    for x in [*edges(tree), ANY]:
        if x is not EDGE and x is not ANY and x in ALNUM:
            run += chr(x).lower()
            continue
        ends = x is not ANY
        if run and fresh and ends:
            found.append(run)
        run, fresh = "", ends
    return tuple(dict.fromkeys(found))


def pattern_rule(regex: str, verdict: str = "block") -> Rule:
    """A regular expression to be found in host + path. It is read by Java; its tokens
    are read off it here. Without case ("(?i)"), classes must name both cases to end a token."""
    return Rule(f"pattern:{regex}", verdict, regex, pattern_tokens(regex))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """word as a whole label or word anywhere in host or path."""
    return pattern_rule(rf"(?:^|[^a-zA-Z0-9])(?i:{re.escape(word)})(?:[^a-zA-Z0-9]|$)", verdict)


#: Host-and-path rules of the registered query.
LISTED = (host_rule("com/en/", "block"), host_rule("example.com/en/7", "allow"), host_rule("net/de/", "allow"), host_rule("example.net/de/8", "block"), host_rule("org/es/", "block"))
#: What marks unwanted pages where no host-and-path rule fits: words, and patterns of hosts and paths.
WORDS = ("adult", "casino", "porn", "sex", "xxx", "gambling", "malware", "phishing", "warez", "ads", "tracker")
FORMS = (r"^[0-9]+(?:\.[0-9]+){3}(?:[:/]|$)", r"(?:^|\.)xn--[a-z0-9-]+\.", r"/wp-login\.php$", r"/cgi-bin/[^/]*\.(?:exe|pl)$", r"\.(?:apk|exe|msi|scr)$", r"/banners?/[0-9]+x[0-9]+/", r"[.-]doubleclick\.")
PATTERNS = (*(word_rule(x) for x in WORDS), *(pattern_rule(x) for x in FORMS))


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """A row for each rule and token; tokens null: the rule is a candidate everywhere."""
    if any(x.regex is None for x in rules):
        raise ValueError("a rule needs a regex; use host_rule, pattern_rule or word_rule")
    rows = [(k, x.text, x.verdict, x.regex, len(x.text), x.text.startswith("pattern:"), t) for k, x in enumerate(rules) for t in (dict.fromkeys(x.tokens) or [None])]
    return spark.createDataFrame(rows, "no int, rule string, verdict string, regex string, size int, pattern boolean, token string")


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", listed: tuple[Rule, ...] = LISTED, patterns: tuple[Rule, ...] = PATTERNS, default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) for each row of pages.

    Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased.
    Path: from there to "?", "#" or the end. Both are empty for a null url or one
    without "://". The longest listed rule that fits decides (ties: the first in
    the list) and is named; else rule is null and a fitting pattern rule decides,
    and without one the default. Repeated rows come back as often; null ids stay null.

    One pass counts how often the URLs hold each rule token, which picks the token
    a rule is filed under; one shuffle brings a URL's candidates together, after
    Spark has combined them on the map side to a row for each page.
    """
    spark = pages.sparkSession
    rules = rule_table(spark, (*listed, *patterns))
    small = len(listed) + len(patterns) <= BROADCAST_RULES
    put = F.broadcast if small else (lambda x: x)
    urls = pages.select(quoted(id_col).alias("id"), quoted(url_col).cast("string").alias("url")).select("id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    urls = urls.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("path", F.coalesce("path", F.lit("")))
    lower = F.translate(F.concat("host", "path"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = F.array_distinct(F.regexp_extract_all(lower, F.lit(f"({TOKEN})"), 1))

    known = rules.select("token").distinct()
    df = urls.select(F.explode(tokens).alias("token")).join(put(known), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    rarest = rules.join(put(df), "token", "left").groupBy("no").agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0).cast("long")), F.col("token"))).alias("token"))
    index = rules.drop("token").distinct().join(rarest, "no").withColumn("key", F.coalesce("token", F.lit("")))

    # the empty token stands for the rules without one and makes each URL occur
    asked = urls.select("id", "url", "host", "path", F.explode(F.concat(F.array(F.lit("")), tokens)).alias("key"))
    fits = F.expr("rlike(concat(host, path), regex)")
    rank = F.struct((~F.col("pattern")).cast("int"), F.col("size"), -F.col("no"))
    hits = asked.join(put(index), "key", "left").withColumn("rank", F.when(fits, rank))
    best = hits.groupBy("id", "url", "host", "path").agg(
        F.max(F.struct("rank", F.when(F.col("rank").isNotNull() & ~F.col("pattern"), F.col("rule")).alias("rule"), F.when(F.col("rank").isNotNull(), F.col("verdict")).alias("verdict"))).alias("best"),
        F.count_if((F.col("key") == "") & (F.col("no").isNull() | (F.col("no") == first_without_token((*listed, *patterns))))).alias("copies"))
    out = best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")


def first_without_token(rules: tuple[Rule, ...]) -> int:
    """The one rule filed under the empty token that stands for a URL's row; -1: none is."""
    return next((k for k, x in enumerate(rules) if not x.tokens), -1)


__all__ = ["LISTED", "PATTERNS", "Rule", "host_rule", "judge_urls", "pattern_rule", "pattern_tokens", "word_rule"]
