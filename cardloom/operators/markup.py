"""Values out of pages of markup: prices of table cells, and rows of listings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import CODES, parse_condition, parse_price

#: What is priced, and the names of its cell, the first that has a price counts.
PRICE_CELLS = {
    "raw": ("used_price",), "psa7": ("complete_price", "cib_price"), "psa8": ("new_price",), "psa9": ("graded_price",), "psa95": ("box_only_price",), "psa10": ("manual_only_price",)}


def cells(html: Column) -> Column:
    """Table cells of a page in order, each with the text of its opening tag and of what is in it. A cell ends at its closing tag,
    or, where that is missing, where the next one opens; so no cell reads on into another."""
    opened = F.slice(F.split(html, r"(?i)<td(?=[\s>])"), 2, 1_000_000)
    return F.transform(opened, lambda c: F.struct(
        F.regexp_extract(c, r"^([^>]*)>", 1).alias("tag"), F.split(F.regexp_replace(c, r"^[^>]*>", ""), r"(?i)</td|</tr|</table")[0].alias("inner")))


def cell_price(cells: Column, name: str) -> Column:
    """The price in dollars in the first cell of this id or class; null where it has none."""
    own = rf"""(?i)\s(?:id=["']{name}["']|class=["'][^"']*(?<![A-Za-z0-9_]){name}(?![A-Za-z0-9_])[^"']*["'])"""
    first = F.get(F.filter(cells, lambda c: c["tag"].rlike(own)), 0)["inner"]
    text = F.regexp_extract(first, r"""(?i)<span[^>]+class=["'][^"']*price[^"']*["'][^>]*>\s*\$([0-9,.]+)""", 1)
    value = F.replace(text, F.lit(","), F.lit("")).try_cast("double")
    return F.when(value > 0, value)


def price_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key`` and the prices of a page: raw and of each grade, null where its cell is missing or blank."""
    c = F.col("_c")
    read = pages.select(key, cells(F.coalesce(html, F.lit(""))).alias("_c"))
    return read.select(key, *(F.coalesce(*(cell_price(c, n) for n in names)).alias(k) for k, names in PRICE_CELLS.items()))


class _Element:
    __slots__ = ("tag", "attrs", "parts", "inside")

    def __init__(self, tag: str, attrs: dict[str, str], inside: "_Element | None"):
        self.tag, self.attrs, self.inside, self.parts = tag, attrs, inside, []

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def below(self) -> Iterator["_Element"]:
        todo = [p for p in reversed(self.parts) if isinstance(p, _Element)]
        while todo:
            e = todo.pop()
            yield e
            todo += [p for p in reversed(e.parts) if isinstance(p, _Element)]

    def strings(self) -> Iterator[str]:
        todo = list(reversed(self.parts))
        while todo:
            p = todo.pop()
            if isinstance(p, str):
                yield p
            else:
                todo += reversed(p.parts)

    def text(self) -> str:
        return " ".join(x for x in map(str.strip, self.strings()) if x)


class _Page(HTMLParser):
    """A page as elements. A closing tag closes the nearest open element of its name and all left open in it; one without any is passed over."""

    EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.open = _Element("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = _Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.open)
        self.open.parts.append(e)
        if tag not in self.EMPTY:
            self.open = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open.parts.append(_Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.open))

    def handle_endtag(self, tag: str) -> None:
        e = self.open
        while e.inside is not None and e.tag != tag:
            e = e.inside
        if e.inside is not None:
            self.open = e.inside

    def handle_data(self, data: str) -> None:
        self.open.parts.append(data)


#: Plain markup: a tag whose attributes are quoted and hold no markup, or text without references. Elements whose content is no markup.
_NAME = r"[A-Za-z][A-Za-z0-9]*"
_VALUE = r"""(?:"[^"<>&]*"|'[^'<>&]*')"""
_PLAIN = re.compile(rf"<({_NAME})((?:[ \n]+[A-Za-z][A-Za-z0-9-]*={_VALUE})*)>|</({_NAME})>|([^<&]+)")
_ATTRS = re.compile(rf"([A-Za-z][A-Za-z0-9-]*)=({_VALUE})")
_RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())


@lru_cache(4096)
def _attrs(text: str) -> dict[str, str]:
    """Attributes of a tag, the first of a name; shared, so not to be changed."""
    return {k.lower(): v[1:-1] for k, v in reversed(_ATTRS.findall(text))}


def _plain(html: str) -> "_Element | None":
    """The elements of a page of plain markup, as ``_Page`` reads them; none where anything else is in it."""
    if _PLAIN.sub("", html):
        return None
    root = now = _Element("", {}, None)
    empty = _Page.EMPTY
    for tag, attrs, closed, text in _PLAIN.findall(html):
        if text:
            now.parts.append(text)
        elif tag:
            tag = tag.lower()
            if tag in _RAW:
                return None
            e = _Element(tag, _attrs(attrs) if attrs else {}, now)
            now.parts.append(e)
            if tag not in empty:
                now = e
        else:
            closed, e = closed.lower(), now
            while e.inside is not None and e.tag != closed:
                e = e.inside
            if e.inside is not None:
                now = e.inside
    return root


def _read(html: str) -> _Element:
    plain = _plain(html)
    return _Page(html).root if plain is None else plain


def _is_row(e: _Element) -> bool:
    if not e.attrs:
        return False
    own, classes = e.attrs.get("id", ""), e.classes() if e.tag == "div" else ()
    return "data-article-id" in e.attrs or (e.tag == "div" and ("article-row" in classes or own.startswith("articleRow") or {"row", "no-gutters"} <= classes and own.startswith("article"))) or (
        e.tag == "tr" and own.startswith("article"))


#: Texts that certainly name a price, also where an amount in euros is asked for, or a condition, whatever follows them: nothing behind them counts.
_AMOUNT = r"(?=[^1-9]*[1-9])[ \n]*(?:[0-9]{1,3}(?:\.[0-9]{3})+,[0-9]{2}|[0-9]{1,15}[.,][0-9]{2})[ \n]*"
_SURE_PRICE, _SURE_EUROS = re.compile(rf"{_AMOUNT}€?[ \n]*|(?=[^1-9]*[1-9])[0-9]{{1,15}}(?:[.,][0-9]{{1,9}})?"), re.compile(rf"{_AMOUNT}€[ \n]*")
_NO_WORD = r"[\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]"
_SURE_CONDITION = re.compile(rf"(?:^|{_NO_WORD})(?:{'|'.join(CODES)})(?:\Z|{_NO_WORD})")


def _row(e: _Element) -> tuple[str, list[str], list[str], str]:
    """What a row says: its id, texts that may hold its price and its condition, in order, up to one that certainly does, and the seller.

    A row that is left unclosed holds all that follow; it is read on only as far as something is not known yet."""
    ids = lambda x: x.attrs.get("data-article-id") or x.attrs.get("data-id-article")
    named = e.attrs.get("id", "").removeprefix("articleRow").removeprefix("article-")
    article = ids(e) or named or next(filter(None, map(ids, e.below())), "")
    prices, conditions, seller, sure = [], [], "unknown", False
    for x in e.below():
        if not x.attrs:
            continue
        classes = x.classes() if "class" in x.attrs else ()
        if not prices and ("price-container" in classes or (x.tag == "span" and "price" in classes) or "data-price" in x.attrs):
            prices.append(x.attrs.get("data-price") or x.text())
        if not sure and ("title" in x.attrs or "data-original-title" in x.attrs or "aria-label" in x.attrs or "condition" in classes):
            conditions.append(" ".join(filter(None, [*(x.attrs.get(k, "") for k in ("title", "data-original-title", "aria-label")), x.text()])))
            sure = _SURE_CONDITION.search(conditions[-1]) is not None
        if seller == "unknown" and (x.tag == "span" and "seller-name" in classes or x.tag == "a" and "/Users/" in x.attrs.get("href", "")):
            seller = x.text()
        if prices and sure and seller != "unknown":
            break
    if not (prices and _SURE_PRICE.fullmatch(prices[0])):
        for s in e.strings():
            if "€" in s:
                prices.append(s)
                if _SURE_EUROS.fullmatch(s):
                    break
    if not sure:
        conditions.append(e.text())
    return article, prices, conditions, seller


def listing_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Rows of listings of each page: ``key``, ``place``, ``article_id``, ``price``, ``condition``, ``seller``.

    A row's price is that of its price element, or of the first text with an amount in euros; its condition the first that a label
    names, or its whole text, or EX. Rows without an id or a price are left out, and of rows of one id the first stays. Rows may hold
    rows and be left unclosed; null and empty pages have none."""
    kind, texts = pages.schema[key].dataType.simpleString(), pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for n, page in enumerate(batch.column(1).to_pylist()):
                found = [(i, *_row(e)) for i, e in enumerate(x for x in _read(page).below() if _is_row(x))]
                at += [n] * len(found)
                out += found
            i, article, prices, conditions, seller = zip(*out, strict=True) if out else ((),) * 5
            # of one text each, as of most rows, no list is made
            one = lambda lists: pa.array([x[0] if len(x) == 1 else None for x in lists], pa.string())
            more = lambda lists: pa.array([None if len(x) == 1 else x for x in lists], texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array(i, pa.int32()), pa.array(article, pa.string()), one(prices), more(prices), one(conditions), more(conditions), pa.array(seller, pa.string())],
                names=["k", "i", "article_id", "price", "prices", "condition", "conditions", "seller"])

    read = pages.where(F.col(html).isNotNull()).select(F.col(key).alias("k"), F.col(html).alias("h")).mapInArrow(
        run, f"k {kind}, i int, article_id string, price string, prices array<string>, condition string, conditions array<string>, seller string")
    amounts = F.transform("prices", lambda t, j: F.when((j == 0) | t.rlike(r"[0-9]+[.,][0-9]{2}\s*€"), parse_price(t)))
    first = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull()), 0)
    price = F.when(F.col("price").isNotNull(), parse_price(F.col("price"))).otherwise(first(amounts))
    condition = F.when(F.col("condition").isNotNull(), parse_condition(F.col("condition"))).otherwise(first(F.transform("conditions", parse_condition)))
    rows = read.where("article_id <> ''").select(F.col("k").alias(key), "i", "article_id", price.alias("price"), F.coalesce(condition, F.lit("EX")).alias("condition"), "seller").where("price is not null")
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "article_id").orderBy("i"))).where("_n = 1")
    place = F.row_number().over(Window.partitionBy(key).orderBy("i"))
    return once.select(key, place.alias("place"), "article_id", "price", "condition", "seller")
