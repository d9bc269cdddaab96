"""Tables inside HTML pages stored in a column."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


class _Tables(HTMLParser):
    """Collects the cell texts of every <table> (nested tables count on their own)."""

    def __init__(self, css_class: str | None):
        super().__init__(convert_charrefs=True)
        self.css_class, self.count, self.stack, self.rows = css_class, 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            names = (dict(attrs).get("class") or "").split()
            keep = self.css_class is None or self.css_class in names
            self.stack.append({"no": self.count if keep else None, "row": None, "cell": None, "rows": 0})
            self.count += keep
        elif self.stack and tag == "tr":
            self._end_row()
            self.stack[-1]["row"] = []
        elif self.stack and tag in ("td", "th"):
            self._end_cell()
            if self.stack[-1]["row"] is None:
                self.stack[-1]["row"] = []
            self.stack[-1]["cell"] = []

    def handle_endtag(self, tag):
        if not self.stack:
            return
        if tag in ("td", "th"):
            self._end_cell()
        elif tag == "tr":
            self._end_row()
        elif tag == "table":
            self._end_row()
            self.stack.pop()

    def handle_data(self, data):
        if self.stack and self.stack[-1]["cell"] is not None:
            self.stack[-1]["cell"].append(data)

    def _end_cell(self):
        top = self.stack[-1]
        if top["cell"] is not None:
            top["row"].append(" ".join("".join(top["cell"]).split()))
            top["cell"] = None

    def _end_row(self):
        self._end_cell()
        top = self.stack[-1]
        if top["row"]:
            if top["no"] is not None:
                self.rows.append((top["no"], top["rows"], top["row"]))
            top["rows"] += 1
        top["row"] = None


def parse_tables(html: str, css_class: str | None = None) -> list[tuple[int, int, list[str]]]:
    """``(table_no, row_no, cells)`` of one page."""
    p = _Tables(css_class)
    p.feed(html or "")
    p.close()
    while p.stack:
        p.handle_endtag("table")
    return p.rows


def html_tables(df: DataFrame, key: str, html: str = "html", table_no: int | None = None,
                css_class: str | None = None) -> DataFrame:
    """Rows of all (or the n-th) tables of every page: ``(key, table_no, row_no, cells)``."""
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(k, t, r, c) for k, h in zip(b[key], b[html]) for t, r, c in parse_tables(h, css_class)
                     if table_no is None or t == table_no]
            yield pd.DataFrame(found, columns=[key, "table_no", "row_no", "cells"])

    kind = dict(df.dtypes)[key]
    return df.select(key, html).mapInPandas(extract, f"{key} {kind}, table_no int, row_no int, cells array<string>")
