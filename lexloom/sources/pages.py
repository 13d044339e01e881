"""Text and links of crawled HTML pages.

Main text follows the document tree: chrome tags and classes go with everything below
them, and the main region reaches to its own closing tag. Pages pass a small parser in
Arrow batches; choice and cleaning of the text are column functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_contains, clean_text, let, lit_or_col, strip
from ..rules import domain as D

#: Elements without content or closing tag (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Regions(HTMLParser):
    """Text nodes of a page with the regions each lies in.

    ``regions`` are tests on (tag, attributes), best first; of each only the first
    element counts. The body, or the whole page without one, comes last.
    """

    def __init__(self, drop_tags, drop_classes, main_classes: str):
        super().__init__()
        self.drop_tags, self.drop_classes = frozenset(drop_tags), tuple(drop_classes)
        main = re.compile(main_classes)
        self.tests = (
            lambda t, a: t == "main", lambda t, a: a.get("id") == "main-content",
            lambda t, a: bool(main.search(a.get("class") or "")), lambda t, a: t == "article", lambda t, a: t == "body",
        )
        self.open: list[tuple[str, bool, list[int]]] = []  # tag, dropped, regions that start here
        self.dropped, self.inside, self.found = 0, set(), set()
        self.nodes: list[tuple[str, frozenset]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        a = dict(attrs)
        gone = tag in self.drop_tags or any(re.search(c, a.get("class") or "") for c in self.drop_classes)
        starts = [] if gone or self.dropped else [i for i, test in enumerate(self.tests) if i not in self.found and test(tag, a)]
        self.found.update(starts)
        self.inside.update(starts)
        self.dropped += gone
        self.open.append((tag, gone, starts))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _, _ in self.open):
            return
        while self.open:
            t, gone, starts = self.open.pop()
            self.dropped -= gone
            self.inside.difference_update(starts)
            if t == tag:
                return

    def handle_data(self, data):
        if not self.dropped:
            self.nodes.append((data, frozenset(self.inside)))

    def texts(self) -> tuple[list[str], list[str]]:
        """Nodes of the best region that has text, and of the body."""
        body = [n for n, r in self.nodes if 4 in r] if 4 in self.found else [n for n, _ in self.nodes]
        for i in range(4):
            own = [n for n, r in self.nodes if i in r]
            if any(n.strip() for n in own):
                return own, body
        return body, body


def _nodes(c: Column) -> Column:
    """Stripped text nodes joined by line breaks."""
    return F.array_join(F.filter(F.transform(c, strip), lambda s: s != ""), "\n")


def page_text(c, tags=D.REMOVED_TAGS, classes=D.REMOVED_CLASSES, main_classes: str = D.MAIN_CLASSES,
              min_chars: int = 50) -> Column:
    """Main text of a page; the body where the main region is too short, else ''. Null html gives ''."""
    tags, classes = tuple(tags), tuple(classes)

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for html in batches:
            rows = []
            for h in html:
                p = _Regions(tags, classes, main_classes)
                p.feed(h or "")
                p.close()
                rows.append(p.texts())
            yield pd.DataFrame(rows, columns=["main", "body"])

    parsed = F.pandas_udf(read, "main array<string>, body array<string>")(lit_or_col(c))
    return let(
        parsed,
        lambda r: let(
            F.struct(clean_text(_nodes(r["main"])).alias("main"), clean_text(_nodes(r["body"])).alias("body")),
            lambda t: F.when(F.length(t["main"]) >= min_chars, t["main"])
            .when(F.length(t["body"]) >= min_chars, t["body"]).otherwise(F.lit("")),
        ),
    )


def links(pages: DataFrame, any_of=(), all_of=(), cut_suffix: bool = False, limit: int | None = None,
          html: str = "html") -> DataFrame:
    """Distinct link targets that contain one of ``any_of`` and all of ``all_of``.

    ``limit`` is the crawl budget of the news job: the first so many in URL order.
    """
    href = F.explode(F.regexp_extract_all(F.col(html), F.lit(r'(?i)<a\b[^>]*\bhref\s*=\s*"([^"]+)"'), F.lit(1)))
    found = pages.select(href.alias("url"))
    if any_of:
        found = found.where(any_contains("url", any_of))
    for part in all_of:
        found = found.where(F.col("url").contains(part))
    if cut_suffix:
        found = found.select(F.regexp_replace("url", r"[#?].*$", "").alias("url"))
    found = found.distinct()
    return found.orderBy("url").limit(limit) if limit else found
