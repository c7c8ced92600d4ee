"""First table of HTML pages, as rows. Pages are parsed in parallel, one page at a time."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.functions.exprs import c

NO_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
ROWS_PER_BATCH = 5000
TABLE_SCHEMA = "page_id string, row_no int, is_header boolean, cells array<string>"

# The most columns and rows that a cell may span in HTML.
MAX_SPANS = (1000, 65_534)


class _TableEnd(Exception):
    """The first table is complete; the rest of the page need not be read."""


class _FirstTable(HTMLParser):
    """Collects the rows of the first table of a page; text of nested tables stays in its cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[bool, list[str]]] = []
        self._depth = 0
        self._row: list[str] | None = None
        self._cell: list[str] | None = None
        self._span = (1, 1)
        # Cells that reach down, by column: rows left and text, for this row and the next.
        self._down: dict[int, tuple[int, str]] = {}
        self._later: dict[int, tuple[int, str]] = {}
        self._header = False
        self._in_head = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self._depth += 1
        elif self._depth != 1:
            return
        elif tag == "thead":
            self._in_head = True
        elif tag == "tr":
            self._close_row()
            self._row, self._header = [], True
        elif tag in ("td", "th"):
            self._close_cell()
            if self._row is None:
                self._row, self._header = [], True
            self._header = self._header and (tag == "th" or self._in_head)
            spans = [dict(attrs).get(k) or "1" for k in ("colspan", "rowspan")]
            self._span = tuple(min(int(x[:9]), most) or 1 if x.isdigit() and x.isascii() else 1 for x, most in zip(spans, MAX_SPANS))
            self._cell = []

    def handle_endtag(self, tag: str) -> None:
        if not self._depth:
            return
        if tag == "table":
            self._depth -= 1
            if self._depth == 0:
                self._close_row()
                raise _TableEnd
        elif self._depth == 1:
            if tag in ("td", "th"):
                self._close_cell()
            elif tag == "tr":
                self._close_row()
            elif tag == "thead":
                self._close_row()
                self._in_head = False

    def handle_data(self, data: str) -> None:
        if self._cell is not None:
            self._cell.append(data)

    def _close_cell(self) -> None:
        if self._cell is not None and self._row is not None:
            text = " ".join("".join(self._cell).split())
            across, down = self._span
            for _ in range(across):
                self._from_above()
                if down > 1:
                    self._later[len(self._row)] = (down - 1, text)
                self._row.append(text)
        self._cell = None

    def _from_above(self) -> None:
        """Cells of earlier rows that reach down to the next places of this row."""
        while (held := self._down.pop(len(self._row), None)) is not None:
            left, text = held
            if left > 1:
                self._later[len(self._row)] = (left - 1, text)
            self._row.append(text)

    def _close_row(self) -> None:
        self._close_cell()
        if self._row is not None and (self._row or self._down):
            self._from_above()
            self.rows.append((self._header, self._row))
            self._down, self._later = self._later, {}
        self._row = None


def first_table(html: str | None) -> list[tuple[bool, list[str]]]:
    parser = _FirstTable()
    try:
        parser.feed(html or "")
        parser.close()
    except _TableEnd:
        return parser.rows
    parser._close_row()
    return parser.rows


def html_tables(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """Rows of the first table of every page (``TABLE_SCHEMA``); pages without a table give none."""
    tagged = pages.select(c(id_column).cast("string").alias("page_id"), c(html_column).alias("html"))
    columns = ["page_id", "row_no", "is_header", "cells"]
    tagged = tagged.filter(F.lower("html").contains("<table"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for page, html in zip(batch["page_id"], batch["html"]):
                rows += [(page, i, head, cells) for i, (head, cells) in enumerate(first_table(html))]
                if len(rows) >= ROWS_PER_BATCH:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return tagged.mapInPandas(parse, TABLE_SCHEMA)


def pages_without_table(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """Pages whose markup, comments and scripts aside, holds no table."""
    markup = F.regexp_replace(F.coalesce(c(html_column), F.lit("")), NO_MARKUP, "")
    return pages.filter(~F.lower(markup).contains("<table")).select(c(id_column))


def table_frame(rows: DataFrame, page_id: str | None = None) -> DataFrame:
    """The table of one page (of all rows without ``page_id``) with its header rows as column
    names (text columns)."""
    mine = rows if page_id is None else rows.filter(F.col("page_id") == page_id)
    first_body, width = mine.agg(F.min(F.when(~F.col("is_header"), F.col("row_no"))), F.max(F.size("cells"))).first()
    if width is None:
        raise ValueError("The page holds no table.")
    # All header rows above the body name the columns together.
    above = F.col("is_header") if first_body is None else F.col("row_no") < first_body
    heads = [r["cells"] for r in mine.filter(above).orderBy("row_no").collect()]
    names = []
    for i in range(width):
        parts = dict.fromkeys(h[i] for h in heads if i < len(h) and h[i])
        names.append(" ".join(parts) or str(i))
    body = mine.filter(~above)
    return body.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
