"""One pass over a page: card, typed links, body text and sections.

A page is parsed once, by the standard library's parser, in a pandas UDF; the
columns that come out are plain structs, and everything after stays in the JVM.
Text of an element is its text nodes with block elements set off by spaces, white
space squeezed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.vocab import Profile

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s small span strong sub sup u var wbr".split())
CLOSED_BY = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
SCOPE = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "p": {"div", "td", "li", "article", "section"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CARD_CLASSES = ("infobox", "infobox-vcard", "infobox-mw", "cards")
CHROME = frozenset("reference mw-editsection noprint navbox metadata".split())
#: Rows and bytes of an Arrow batch of pages.
BATCH_ROWS, BATCH_BYTES = 256, 32 << 20
SCHEMA = (
    "struct<card:array<struct<label:string,value:string>>,links:array<struct<prop:string,text:string,href:string>>,"
    "body:string,sections:array<struct<heading:string,level:int,text:string>>>"
)


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    kids: list = field(default_factory=list)
    parent: Node | None = None

    @property
    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            now = todo.pop()
            yield now
            todo += [k for k in reversed(now.kids) if isinstance(k, Node)]

    def find(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n is not self and n.tag == tag), None)

    def text(self, without=None) -> str:
        parts: list[str] = []
        todo: list = [self]
        while todo:
            now = todo.pop()
            if isinstance(now, str):
                parts.append(now)
            elif without is None or not without(now):
                edge = [] if now.tag in INLINE else [" "]
                todo += [*edge, *reversed(now.kids), *edge]
        return " ".join("".join(parts).split())


class Tree(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root")
        self.feed(source)
        self.close()
        for n in self.root.walk():  # without cycles a tree goes with its page, and not when the collector comes round
            n.parent = None

    def handle_starttag(self, tag, attrs):
        closes, scope = CLOSED_BY.get(tag, set()), SCOPE.get(tag, set())
        if tag in BLOCKS:
            closes, scope = closes | {"p"}, scope | SCOPE["p"]
        now = self.at
        while closes and now.parent is not None and now.tag not in scope:
            if now.tag in closes:
                self.at = now.parent
            now = now.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, [], self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        now = self.at
        while now.parent is not None and now.tag != tag:
            now = now.parent
        if now.parent is not None:
            self.at = now.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def clean(text: str) -> str:
    return " ".join(re.sub("[←-⇿]", " ", re.sub(r"\[\s*\d+\s*\]", " ", text)).replace("\xa0", " ").split())


def href_path(raw: str) -> str:
    h = raw.strip()
    h = h[2:] if h.startswith("./") else h
    h = h[3:] if h.startswith("../") else h
    h = h.partition("#")[0]
    if not re.search("%(?![0-9A-Fa-f]{2})", h):
        h = unquote_plus(h)
    return (h[2:] if h.startswith("A/") else h).strip()


class Page:
    def __init__(self, source: str | None, profile: Profile):
        self.root, self.profile = Tree(source or "").root, profile

    def infobox(self, wide: bool) -> Node | None:
        """The first card: links look at table.infobox alone, cards at its variants too."""
        for n in self.root.walk():
            own = n.classes
            if n.tag == "table" and "infobox" in own or wide and ("infobox" in own or n.tag == "table" and own & set(CARD_CLASSES)):
                return n
        return None

    def rows(self, box: Node) -> Iterator[tuple[str, Node]]:
        for tr in (n for n in box.walk() if n.tag == "tr"):
            th, td = tr.find("th"), tr.find("td")
            if th and td:
                yield clean(th.text()), td

    def card(self, value_chars: int = 140, lines: int = 12) -> list[dict]:
        """HX1: listed properties first, then labelled rows. A label or a value that
        has been shown, whatever its case, is not shown again."""
        box = self.infobox(True)
        if box is None:
            return []
        tagged: dict[str, Node] = {}
        for n in box.walk():
            if n is not box and "data-wikidata-property-id" in n.attrs:
                tagged.setdefault(n.attrs["data-wikidata-property-id"], n)
        cells = [(label, tagged[prop]) for prop, label in self.profile.card if prop in tagged]
        cells += [(label, td) for label, td in self.rows(box) if 1 <= len(label) <= 40 and not any(b in label.lower() for b in self.profile.card_block)]
        lines_: list[dict] = []
        for label, cell in cells:
            line = {"label": label, "value": clean(cell.text())[:value_chars].strip()}
            told = line["label"].strip() and line["value"]
            # a line that shares its label or its value with one above, whatever the case, is left out
            if told and not any(line[k].lower() == x[k].lower() for x in lines_ for k in line):
                lines_.append(line)
        return lines_[:lines]

    def property_of(self, label: str) -> str | None:
        """JN5: the label's own entry, else the first entry that it holds."""
        table = self.profile.label_property
        return next((p for k, p in table if k == label), next((p for k, p in table if k in label), None))

    def links(self) -> list[dict]:
        """HX3 for every property: tagged elements in property order, then labelled rows."""
        box = self.infobox(False)
        if box is None:
            return []
        out: dict[tuple[str, str], dict] = {}

        def offer(prop: str, a: Node) -> None:
            raw = a.attrs["href"].strip()
            href = "" if raw.startswith("http") else href_path(raw)
            if href:
                out.setdefault((prop, href), {"prop": prop, "text": clean(a.text()), "href": href})

        tagged: dict[str, list[Node]] = {}
        for n in box.walk():
            if n is not box and "data-wikidata-property-id" in n.attrs:
                tagged.setdefault(n.attrs["data-wikidata-property-id"], []).append(n)
        known = [p for p in self.profile.all_properties if p in tagged]
        for prop in (*known, *(p for p in tagged if p not in known)):
            for cell in tagged[prop]:
                own = [cell] if cell.tag == "a" and "href" in cell.attrs else [n for n in cell.walk() if n is not cell and n.tag == "a" and "href" in n.attrs]
                for a in own:
                    offer(prop, a)
        for label, td in self.rows(box):
            prop = label and self.property_of(label.lower())
            for a in (n for n in td.walk() if n.tag == "a" and "href" in n.attrs) if prop else ():
                offer(prop, a)
        return list(out.values())

    @staticmethod
    def chrome(n: Node) -> bool:
        own = n.classes
        return n.tag in ("script", "style", "head", "title") or n.tag == "table" and "infobox" in own or bool(own & CHROME)

    def body(self) -> str:
        """HX4."""
        return clean(self.root.text(self.chrome))

    def sections(self) -> list[dict]:
        """HX5: every h2 and h3 with the text of what follows it up to the next of either."""
        out = []

        def visit(n: Node) -> None:
            kids = [k for k in n.kids if isinstance(k, Node) and not self.chrome(k)]
            for k, head in enumerate(kids):
                if head.tag in ("h2", "h3"):
                    parts = []
                    for later in kids[k + 1 :]:
                        if later.tag in ("h2", "h3"):
                            break
                        if t := clean(later.text(self.chrome)):
                            parts.append(t)
                    if title := clean(head.text(self.chrome)):
                        out.append({"heading": title, "level": int(head.tag[1]), "text": " ".join(parts)})
                visit(head)

        visit(self.root)
        return out


def parsed(html: Column, profile: Profile) -> Column:
    """struct(card, links, body, sections); a null page is an empty one. One tree stands at a time, and
    Arrow batches are small; Spark reads their bounds when a plan runs, so they stay set in the session."""
    conf = SparkSession.active().conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [(p.card(), p.links(), p.body(), p.sections()) for p in (Page(x, profile) for x in s)]
            yield pd.DataFrame(rows, columns=["card", "links", "body", "sections"])

    return run(html)


def parse_pages(articles: DataFrame, profile: Profile, html_col: str = "html") -> DataFrame:
    """articles with card, links, body and sections; done once, at ingest."""
    page = parsed(F.col(html_col), profile)
    return articles.withColumn("page", page).select(*[c for c in articles.columns if c != html_col], "page.card", "page.links", "page.body", "page.sections")


def card_block(card: Column, profile: Profile) -> Column:
    """HX2."""
    lines = F.array_join(F.transform(card, lambda x: F.concat(x["label"], F.lit(": "), x["value"])), "\n")
    return F.when(F.size(card) > 0, F.concat(F.lit(profile.card_heading + "\n"), lines)).otherwise(F.lit(""))


def card_field(card: Column, label: str) -> Column:
    """The value of the first line with this label, whatever its case; null if blank or absent."""
    hit = F.get(F.filter(card, lambda x: F.lower(F.trim(x["label"])) == label.lower()), F.lit(0))["value"]
    return F.when(F.trim(hit) != "", F.trim(hit))


def links_of(links: Column, properties: Column) -> Column:
    """Links of the wanted properties, in the order of the properties."""
    per = F.transform(properties, lambda p: F.filter(links, lambda x: x["prop"] == p))
    return F.flatten(per)


def sections_text(sections: Column, anchors: Column, cap: Column | int = 4000) -> Column:
    """"[heading] text" of sections whose heading holds an anchor, in page order, cap characters at most."""
    hit = F.filter(sections, lambda s: F.exists(anchors, lambda a: F.lower(s["heading"]).contains(F.lower(a))))
    text = F.array_join(F.transform(hit, lambda s: F.trim(F.concat(F.lit("["), s["heading"], F.lit("] "), s["text"]))), " ")
    return F.substring(text, F.lit(1), F.lit(cap) if isinstance(cap, int) else cap)
