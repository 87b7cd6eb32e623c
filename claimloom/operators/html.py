"""Pages -> visible text blocks and links: a stdlib tokenizer with an explicit stack, Arrow batches in and out."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as T

#: Elements without content, without visible text, and of page furniture.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INVISIBLE = {"script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "head"}
FURNITURE = {"nav", "footer", "aside"}
FURNITURE_ROLES = {"navigation", "contentinfo", "complementary", "search"}
BLOCKS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "paragraph", "li": "list_item", "tr": "table_row", "dt": "definition", "dd": "definition", "blockquote": "quote", "pre": "preformatted"}
#: An element of the key's kind ends at the start of one of these.
IMPLIED_END = {"p": {*BLOCKS, "ul", "ol", "dl", "div", "table", "section", "article", "main", "hr"} - {"tr", "dt", "dd", "li"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0+)?\s*(?:;|$)", re.I)
_HIDDEN_RULE = re.compile(r"([.#][\w-]+(?:\s*,\s*[.#][\w-]+)*)\s*\{[^}]*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_BLANK = re.compile(r"[\s\x00-\x1f\x7f]+")


def _clean(parts: list[str]) -> str:
    return _BLANK.sub(" ", "".join(parts)).strip()


class _Reader(HTMLParser):
    """Open elements are on a list, as (tag, hidden, furniture); text goes to the innermost open block."""

    def __init__(self, url: str, hidden: set[str]):
        super().__init__(convert_charrefs=True)
        self.url, self.hidden = url, hidden
        self.open: list[tuple[str, bool, bool]] = []
        self.blocks: list[tuple[str, int | None, list[str]]] = []
        self.at: list[int | None] = []
        self.links: list[tuple[str, list[str]]] = []
        self.anchor: int | None = None
        self.title: list[str] = []

    def _state(self) -> tuple[bool, bool]:
        return (self.open[-1][1], self.open[-1][2]) if self.open else (False, False)

    def _close_last(self) -> None:
        tag, _, _ = self.open.pop()
        self.at.pop()
        if tag == "a":
            self.anchor = None

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        while self.open and tag in IMPLIED_END.get(self.open[-1][0], ()):
            self._close_last()
        if tag == "br":
            self.handle_data("\n")
        if tag in VOID:
            return
        hidden, furniture = self._state()
        names = {"." + c for c in given.get("class", "").split()} | ({"#" + given["id"]} if given.get("id") else set())
        hidden |= tag in INVISIBLE or "hidden" in given or given.get("aria-hidden") == "true" or bool(_HIDDEN_STYLE.search(given.get("style", ""))) or bool(names & self.hidden) or ".sr-only" in names
        furniture |= tag in FURNITURE or given.get("role") in FURNITURE_ROLES
        self.open.append((tag, hidden, furniture))
        at = self.at[-1] if self.at else None
        if tag in BLOCKS and not hidden and not furniture:
            self.blocks.append((BLOCKS[tag], int(tag[1]) if BLOCKS[tag] == "heading" else None, []))
            at = len(self.blocks) - 1
        elif tag in ("td", "th") and at is not None and self.blocks[at][2]:
            self.blocks[at][2].append(" | ")
        self.at.append(at)
        if tag == "a" and given.get("href") and not hidden:
            self.links.append((given["href"].strip(), []))
            self.anchor = len(self.links) - 1

    def handle_endtag(self, tag):
        if any(name == tag for name, _, _ in self.open):
            while self.open[-1][0] != tag:
                self._close_last()
            self._close_last()

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "title":
            self.title.append(data)
        hidden, furniture = self._state()
        if hidden:
            return
        if self.anchor is not None:
            self.links[self.anchor][1].append(data)
        if not furniture and self.at and self.at[-1] is not None:
            self.blocks[self.at[-1]][2].append(data)


def read_page(url: str, html: str) -> tuple[str, list[dict], list[dict]]:
    """Title, blocks and links of a page; hidden parts give neither, page furniture gives links only."""
    hidden = {s.strip() for rule in _HIDDEN_RULE.findall(html) for s in rule.split(",")}
    reader = _Reader(url, hidden)
    reader.feed(html)
    reader.close()
    blocks = [{"kind": k, "heading_level": h, "text": t} for k, h, parts in reader.blocks if (t := _clean(parts))]
    links, origin = {}, urlsplit(url)[:2]
    for order, (href, parts) in enumerate(reader.links):
        try:
            target = urljoin(url, href).split("#")[0]
        except ValueError:
            continue
        if target.startswith(("http://", "https://")):
            text = _clean(parts)[:500]
            links[(target, text)] = {"document_order": order, "url": target, "text": text, "same_origin": urlsplit(target)[:2] == origin}
    title = _clean(reader.title) or next((b["text"] for b in blocks if b["heading_level"] == 1), "") or urlsplit(url).netloc
    return title[:240], blocks, list(links.values())[:500]


PAGE_SCHEMA = "page_id string, url string, title string, blocks array<struct<kind: string, heading_level: int, text: string>>, links array<struct<document_order: int, url: string, text: string, same_origin: boolean>>"


MOST_BYTES = 1_500_000


def page_status(pages: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``(page_id, url, n_bytes, status)`` of every page: ``no_url``, ``no_html`` or ``too_large``, else ``read`` by ``parse_pages``."""
    url, n = T.canonical_url(F.col("url")), F.octet_length("html")
    status = F.when(url.isNull(), "no_url").when(n.isNull(), "no_html").when(n > most_bytes, "too_large").otherwise("read")
    return pages.select(T.stable_page_id(url).alias("page_id"), url.alias("url"), n.cast("long").alias("n_bytes"), status.alias("status"))


def parse_pages(pages: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row for each page that ``page_status`` calls ``read``: its id, title, blocks and links."""
    chosen = pages.filter((F.octet_length("html") <= most_bytes) & F.col("url").isNotNull()).select(T.canonical_url(F.col("url")).alias("url"), "html").withColumn("page_id", T.stable_page_id(F.col("url")))

    def run(frames):
        import pandas as pd

        for pdf in frames:
            read = [read_page(u, h) for u, h in zip(pdf.url, pdf.html, strict=True)]
            yield pd.DataFrame({"page_id": pdf.page_id, "url": pdf.url, "title": [r[0] for r in read], "blocks": [r[1] for r in read], "links": [r[2] for r in read]})

    return chosen.mapInPandas(run, PAGE_SCHEMA)


def first_prose(blocks: DataFrame) -> DataFrame:
    """Drops a paragraph or quote of 32 characters or more that a page has shown before, whatever its case."""
    prose = F.col("kind").isin("paragraph", "quote") & (F.length("text") >= 32)
    seen = F.row_number().over(Window.partitionBy("page_id", prose, F.when(prose, F.lower("text")).otherwise(F.col("block_index").cast("string"))).orderBy("block_index"))
    return blocks.withColumn("seen", seen).filter("seen = 1").drop("seen")


def cap_characters(blocks: DataFrame, most: int = 200_000) -> DataFrame:
    """Keeps blocks while their running length, one separator between, stays within ``most``; the block that crosses is cut and ends the page."""
    order = Window.partitionBy("page_id").orderBy("block_index")
    end = F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    room = F.lit(most) - (F.col("end") - F.length("text"))
    cut = F.when(F.col("end") <= most, F.col("text")).otherwise(F.rtrim(F.substring(F.col("text"), F.lit(1), room.cast("int"))))
    return blocks.withColumn("end", end).filter(room > 0).withColumn("text", cut).filter("text <> ''").drop("end")


def page_blocks(pages: DataFrame, most: int = 200_000) -> DataFrame:
    """``(page_id, block_index, kind, heading_level, text)`` in document order."""
    opened = parse_pages(pages).select("page_id", F.posexplode("blocks").alias("block_index", "b")).select("page_id", "block_index", "b.*")
    return cap_characters(first_prose(opened), most)


def page_links(pages: DataFrame) -> DataFrame:
    return parse_pages(pages).select("page_id", F.explode("links").alias("l")).select("page_id", "l.*")
