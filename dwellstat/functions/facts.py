"""Facts-and-features HTML of a listing as flat rows.

Listing HTML is rarely well formed, so Spark's XPath functions cannot read it. This is the one
place where a tag-level reader runs inside Arrow batches; everything after it is plain Spark.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

FACT_ROWS = "array<struct<category:string,subsection:string,label:string,value:string>>"
# executors get the reader with the task, so it works without this package installed on them
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags and text that every reader takes alike. A document of nothing else needs no tolerant reader;
#: elements whose content is no markup, and whatever is written otherwise, are left to that.
_ATTRIBUTE = r"""[ \n]+[a-zA-Z][-a-zA-Z0-9]*="[^"<>&]*\""""
_TOKENS = re.compile(
    r"<(?:/([a-zA-Z][a-zA-Z0-9]*+)|(?!(?i:script|style|title|textarea|iframe|no|plaintext|xmp|svg|math))"
    rf"([a-zA-Z][a-zA-Z0-9]*+)((?:{_ATTRIBUTE})*+)[ \n]*+/?+)>|([^<]++)"
)
_PLAIN = re.compile(f"(?:{_TOKENS.pattern})*+")
_NAME_AND_VALUE = re.compile(r"""([^ \n=]+)="([^"]*)\"""")


class _Outline(HTMLParser):
    """Collects headings and list items below each marked group, in document order."""

    def __init__(self, group_mark, category_tag, section_tag, item_tag):
        super().__init__(convert_charrefs=True)
        self.group_mark = group_mark
        self.tags = {category_tag, section_tag, item_tag}
        self.open: list[tuple[str, list | None, bool]] = []
        self.groups: list[list[tuple[str, list[str]]]] = []
        self.active: list[list[tuple[str, list[str]]]] = []
        if group_mark is None:
            self.groups.append([])
            self.active.append(self.groups[0])

    def handle_starttag(self, tag, attrs):
        starts_group = self.group_mark is not None and self.group_mark in attrs
        texts = [] if tag in self.tags else None
        if texts is not None:
            for group in self.active:
                group.append((tag, texts))
        if starts_group:
            self.groups.append([])
        if tag in VOID_TAGS:
            return
        if starts_group:
            self.active.append(self.groups[-1])
        self.open.append((tag, texts, starts_group))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if not (self.open and self.open[-1][0] == tag) and not any(name == tag for name, _, _ in self.open):
            return
        while self.open:
            name, _, starts_group = self.open.pop()
            if starts_group:
                self.active.pop()
            if name == tag:
                return

    def read(self, html):
        if not _PLAIN.fullmatch(html):
            self.feed(html)
            self.close()
            return
        for end, start, attrs, data in _TOKENS.findall(html):
            if data:
                self.handle_data(unescape(data) if "&" in data else data)
            elif start:
                self.handle_starttag(start.lower(), [(name.lower(), value) for name, value in _NAME_AND_VALUE.findall(attrs)] if attrs else [])
            else:
                self.handle_endtag(end.lower())

    def handle_data(self, data):
        text = data.strip()
        if not text:
            return
        holders = []
        for name, texts, _ in self.open:
            if name in ("script", "style"):
                return
            if texts is not None:
                holders.append(texts)
        for texts in holders:
            texts.append(text)


def _facts(html, group_mark, category_tag, section_tag, item_tag) -> list[tuple]:
    if html is None or "<" not in html:
        return []
    outline = _Outline(group_mark, category_tag, section_tag, item_tag)
    outline.read(html)
    labelled: dict[tuple, str | None] = {}
    bare: list[tuple] = []
    order: list[tuple] = []
    for group in outline.groups:
        titles = ["".join(texts) for tag, texts in group if tag == category_tag]
        category = titles[0] if titles else "_uncategorised"
        section = None
        for tag, texts in group:
            if tag == section_tag:
                section = "".join(texts)
            elif tag == item_tag:
                section = "_general" if section is None else section
                text = " ".join(texts)
                label, colon, value = text.partition(":")
                if colon:
                    key = (category, section, label.strip())
                    if key not in labelled:
                        order.append(key)
                    labelled[key] = value.strip()
                elif text:
                    order.append((category, section, "_bare", len(bare)))
                    bare.append((category, section, text))
    rows = []
    for key in order:
        value = bare[key[3]][2] if len(key) == 4 else labelled[key]
        rows.append((key[0], key[1], key[2], value))
    return rows


def facts_rows(html, group_mark=("data-testid", "category-group"), category_tag: str = "h3",
               section_tag: str = "h6", item_tag: str = "li") -> Column:
    """Array of (category, subsection, label, value); unlabelled bullets carry the label ``_bare``.

    A label repeated in one subsection keeps its last value. ``group_mark=None`` treats the whole
    document as one group.
    """

    def read(batch: pa.Array) -> pa.Array:
        rows, ends = [], [0]
        for html in batch.to_pylist():
            rows += _facts(html, group_mark, category_tag, section_tag, item_tag)
            ends.append(len(rows))
        columns = [pa.array([row[i] for row in rows], pa.string()) for i in range(4)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["category", "subsection", "label", "value"]))

    column = html if isinstance(html, Column) else F.col(html)
    return _arrow_udf(read)(column)


def _arrow_udf(read: Callable[[pa.Array], pa.Array]):
    read.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, FACT_ROWS)


def nested_facts(rows) -> Column:
    """Labelled facts as category → subsection → label → value."""
    rows = rows if isinstance(rows, Column) else F.col(rows)
    labelled = F.filter(rows, lambda r: r["label"] != "_bare")

    def below(items: Column, field: str, inner: Callable[[Column], Column]) -> Column:
        names = F.array_distinct(F.transform(items, lambda r: r[field]))
        return F.map_from_entries(
            F.transform(names, lambda n: F.struct(n, inner(F.filter(items, lambda r: r[field] == n))))
        )

    def leaf(items: Column) -> Column:
        return F.map_from_entries(F.transform(items, lambda r: F.struct(r["label"], r["value"])))

    return below(labelled, "category", lambda cat: below(cat, "subsection", leaf))


def bare_facts(rows) -> Column:
    """Unlabelled facts as (category, subsection) → list of texts."""
    rows = rows if isinstance(rows, Column) else F.col(rows)
    bare = F.filter(rows, lambda r: r["label"] == "_bare")
    places = F.array_distinct(F.transform(bare, lambda r: F.struct(r["category"], r["subsection"])))
    return F.transform(
        places,
        lambda p: F.struct(
            p["category"].alias("category"),
            p["subsection"].alias("subsection"),
            F.transform(
                F.filter(bare, lambda r: (r["category"] == p["category"]) & (r["subsection"] == p["subsection"])),
                lambda r: r["value"],
            ).alias("texts"),
        ),
    )
