"""S19 with configured selectors: attributes of pages whose HTML is at hand.

A selector is a list of steps set apart by blanks, each inside the one before
(at any depth); a step is a tag name, ``#id``, ``.class`` and ``[attr]`` or
``[attr=value]`` in any combination, or ``*``. Tags are read as a stream with a
stack of open elements: an element ends with its end tag, with that of an
element around it, or with the page. Only the matching runs in Python, page by page; defaults, required attributes, tags and bigrams are
column expressions.

Defined cases: a null or empty page matches nothing; an end tag without start
is ignored; text inside ``script`` and ``style`` is theirs alone.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_PART = re.compile(r"([#.]?)([\w-]+|\*)|\[([\w:-]+)(?:=([^\]]*))?\]")
_BLANK = re.compile(r"[ \t\n\v\f\r]+")


@dataclass(frozen=True)
class Attribute:
    """``take`` names an attribute of the matching element, or is None for its text."""
    name: str
    selector: str
    take: str | None = None
    default: str | None = None
    required: bool = False


def parse_step(step: str) -> tuple:
    """(tag or None, ((attribute, value or None, whether a class), ...))."""
    tag, wanted, at = None, [], 0
    while at < len(step):
        m = _PART.match(step, at)
        if m is None or m.group(2) and not m.group(1) and at:
            raise ValueError(f"cannot read the selector step {step!r}")
        mark, name, attr, value = m.groups()
        if attr:
            wanted.append((attr.lower(), value.strip("\"'") if value is not None else None, False))
        elif mark:
            wanted.append(("id" if mark == "#" else "class", name, mark == "."))
        elif name != "*":
            tag = name.lower()
        at = m.end()
    return tag, tuple(wanted)


def _fits(step: tuple, tag: str, attrs: dict) -> bool:
    return step[0] in (None, tag) and all(
        name in attrs and (value is None or (value in attrs[name].split() if is_class else attrs[name] == value))
        for name, value, is_class in step[1])


class _Matcher(HTMLParser):
    """Texts or attribute values of the elements that match each selector."""

    def __init__(self, selectors: list[tuple[list[tuple], str | None]]):
        super().__init__(convert_charrefs=True)
        self.selectors = selectors
        self.found: list[list[list[str]]] = [[] for _ in selectors]
        # Open elements: tag, steps matched so far by selector, the texts they collect.
        self.stack: list[tuple[str, list[int], list[list[str]]]] = []
        self.open_texts: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in reversed(attrs)}  # of equal names the first counts
        matched = list(self.stack[-1][1]) if self.stack else [0] * len(self.selectors)
        texts = []
        for k, (steps, take) in enumerate(self.selectors):
            if matched[k] >= len(steps) - 1 and _fits(steps[-1], tag, attrs):
                value: list[str] = []
                if take is None:
                    texts.append(value)
                elif take in attrs:
                    value.append(attrs[take])
                self.found[k].append(value)
            if matched[k] < len(steps) - 1 and _fits(steps[matched[k]], tag, attrs):
                matched[k] += 1
        if tag not in VOID:
            self.stack.append((tag, matched, texts))
            self.open_texts += texts

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.stack):
            while True:
                name, _, texts = self.stack.pop()
                if texts:
                    del self.open_texts[len(self.open_texts) - len(texts):]
                if name == tag:
                    return

    def handle_data(self, data):
        for text in self.open_texts:
            text.append(data)


def matches(html: Column, attributes: Sequence[Attribute]) -> Column:
    """By attribute, the stripped values of all elements that match its selector."""
    selectors = [([parse_step(s) for s in a.selector.split()], a.take) for a in attributes]

    # Rows come a hundred at a time without Arrow, whose batches hold thousands of whole pages.
    @F.udf("array<array<string>>", useArrow=False)
    def run(page):
        m = _Matcher(selectors)
        m.feed(page or "")
        m.close()
        return [[_BLANK.sub(" ", "".join(v)).strip(" ") for v in values] for values in m.found]

    return run(html)


def extract_attributes(pages: DataFrame, attributes: Sequence[Attribute], tags: Attribute | None = None, title: str | None = None,
                       id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """(ok, failed). ok: page_id, url, baseurl (protocol://host/path), the first
    match of every attribute (its default where blank or missing), ``tags``
    (lower-cased texts of the tag selector's elements; one element's attribute
    is split by comma) and ``bigrams`` of neighbouring tags that occur in the
    attribute ``title``. failed: page_id, url and the required attributes that
    are missing, comma-joined in the order configured."""
    every = [*attributes, *([tags] if tags else [])]
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), matches(F.col(html_col), every).alias("_m"))

    def first(k: int, a: Attribute) -> Column:
        value = F.get(F.get("_m", F.lit(k)), F.lit(0))
        return F.coalesce(F.when(value != "", value), F.lit(a.default)).alias(a.name)

    listed = F.array().cast("array<string>")
    if tags:
        listed = F.get("_m", F.lit(len(attributes)))
        if tags.take:
            listed = F.split(F.get(listed, F.lit(0)), ",")
        listed = F.coalesce(F.filter(F.transform(listed, lambda x: F.lower(F.trim(x))), lambda x: x != ""),
                            F.array().cast("array<string>"))
    baseurl = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]*[^?#]*)", 1)
    df = df.select("page_id", "url", F.when(baseurl != "", baseurl).alias("baseurl"),
                   *[first(k, a) for k, a in enumerate(attributes)], listed.alias("tags"))
    pairs = F.zip_with(F.slice("tags", 1, F.greatest(F.size("tags") - 1, F.lit(0))),
                       F.slice("tags", 2, F.greatest(F.size("tags") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    df = df.withColumn("bigrams", F.filter(pairs, lambda b: F.contains(F.lower(F.col(title)), b)) if title
                       else F.array().cast("array<string>"))
    required = [F.when(F.col(a.name).isNull(), F.lit(a.name)) for a in attributes if a.required]
    df = df.withColumn("_missing", F.concat_ws(",", *required) if required else F.lit(""))
    return (df.filter("_missing = ''").drop("_missing"),
            df.filter("_missing <> ''").select("page_id", "url", F.col("_missing").alias("failed")))
