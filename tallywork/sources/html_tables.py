"""Tables out of HTML pages.

Each page is parsed inside the task that holds it; the result is one row per cell, so a page with
many or large tables never has to fit a column layout.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# executors get this module's functions with the task and need no copy of the package
register_pickle_by_value(sys.modules[__name__])

FRAME_CELLS = 4096


class _Cells(HTMLParser):
    """Collects (table, row, column, is_header, text) of every cell, tables numbered as they open.

    A cell that spans rows or columns is given for each place that it covers, as a table reader would fill it in.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple[int, int, int, bool, str]] = []
        self.tables = 0
        self.stack: list[dict] = []  # open tables, innermost last

    def _close_cell(self) -> None:
        table = self.stack[-1]
        if table["text"] is not None:
            text = " ".join("".join(table["text"]).split())
            columns, rows = table["span"]
            for col in range(table["col"], table["col"] + columns):
                table["taken"][table["row"], col] = table["header"], text
                if rows > 1:  # goes on as long as there are rows
                    table["down"][col] = table["row"] + rows - 1, table["header"], text
            table["text"] = None

    def _open_row(self) -> None:
        self._close_cell()
        table = self.stack[-1]
        table.update(row=table["row"] + 1, col=-1)
        table["down"] = {col: cell for col, cell in table["down"].items() if cell[0] >= table["row"]}
        for col, (_, header, text) in table["down"].items():
            table["taken"][table["row"], col] = header, text

    def _close_table(self) -> None:
        self._close_cell()
        table = self.stack.pop()
        self.cells += [(table["no"], row, col, *cell) for (row, col), cell in sorted(table["taken"].items())]

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "table":
            self.stack.append({"no": self.tables, "row": -1, "col": -1, "header": False, "text": None, "span": (1, 1), "taken": {}, "down": {}})
            self.tables += 1
        elif self.stack and tag == "tr":
            self._open_row()
        elif self.stack and tag in ("td", "th"):
            self._close_cell()
            table = self.stack[-1]
            row, col = max(table["row"], 0), table["col"] + 1
            while (row, col) in table["taken"]:
                col += 1
            table.update(row=row, col=col, header=tag == "th", text=[], span=(_span(attrs, "colspan", 1000), _span(attrs, "rowspan", 65534)))
        elif self.stack and tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag) -> None:
        if not self.stack:
            return
        if tag in ("td", "th", "tr"):
            self._close_cell()
        elif tag == "table":
            self._close_table()

    def handle_data(self, data) -> None:
        if self.stack and self.stack[-1]["text"] is not None:
            self.stack[-1]["text"].append(data)

    def finish(self) -> list[tuple[int, int, int, bool, str]]:
        self.close()
        while self.stack:  # broken markup: tables that never close
            self._close_table()
        return self.cells


def _span(attrs: list[tuple[str, str | None]], name: str, most: int) -> int:
    """A span attribute; broken ones are 1. The upper bounds are those of the HTML standard."""
    value = (dict(attrs).get(name) or "1").strip()
    return min(max(int(value), 1), most) if value.isascii() and value.isdigit() else 1


def _cells(html: str | None) -> list[tuple[int, int, int, bool, str]]:
    if not html:
        return []
    parser = _Cells()
    parser.feed(html)
    return parser.finish()


def html_cells(pages: DataFrame, html: str, page_id: str) -> DataFrame:
    """(page_id, table_no, row_no, col_no, is_header, text), all numbers from 0."""

    names = [page_id, "table_no", "row_no", "col_no", "is_header", "text"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            for page, source in zip(batch[page_id], batch[html], strict=True):
                held.extend((page, *cell) for cell in _cells(source))
                whole = len(held) - len(held) % FRAME_CELLS
                for at in range(0, whole, FRAME_CELLS):  # many small pages in a frame, a large one in several
                    yield pd.DataFrame(held[at:at + FRAME_CELLS], columns=names)
                del held[:whole]
        if held:
            yield pd.DataFrame(held, columns=names)

    kind = pages.schema[page_id].dataType.simpleString()
    # pages without any table never cross into Python
    candidates = pages.select(page_id, html).filter(F.lower(F.col(html)).contains("<table"))
    return candidates.mapInPandas(
        parse,
        f"`{page_id}` {kind}, table_no int, row_no int, col_no int, is_header boolean, text string",
    )


def extract_html_tables(
    pages: DataFrame, html: str, page_id: str, table_index: int, columns: list[str] | None = None
) -> DataFrame:
    """The ``table_index``-th table of every page, one output row per table row.

    With ``columns`` the cells become these columns by position (short rows end in NULL) and a
    first row of header cells is left out; without it the cells stay in a list.
    """
    cells = html_cells(pages, html, page_id).filter(F.col("table_no") == table_index)
    rows = cells.groupBy(page_id, "row_no").agg(
        F.bool_and("is_header").alias("header"),
        F.map_from_entries(F.collect_list(F.struct("col_no", "text"))).alias("by_col"),
    )
    if columns is None:
        cells_in_order = F.transform(F.array_sort(F.map_keys("by_col")), lambda c: F.col("by_col")[c])
        return rows.select(page_id, "row_no", "header", cells_in_order.alias("cells"))
    body = rows.filter(~F.col("header"))
    return body.select(
        page_id, "row_no", *[F.try_element_at("by_col", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def table_headers(pages: DataFrame, html: str, page_id: str, table_index: int) -> DataFrame:
    """(page_id, col_no, text) of the header row of the ``table_index``-th table."""
    cells = html_cells(pages, html, page_id)
    return cells.filter(
        (F.col("table_no") == table_index) & (F.col("row_no") == 0) & F.col("is_header")
    ).select(page_id, "col_no", "text")


def named_table(pages: DataFrame, html: str, page_id: str, table_index: int) -> DataFrame:
    """(page_id, row_no, entries) of the ``table_index``-th table of every page, named by its header row.

    ``entries`` maps the header's texts to the row's cells; of columns of one name the last counts, and a column without
    a name is called by its number. Tables without a header row are left out.
    """
    cells = html_cells(pages, html, page_id).filter(F.col("table_no") == table_index)
    names = cells.filter((F.col("row_no") == 0) & F.col("is_header")).groupBy(page_id).agg(  # the columns of one table
        F.map_from_entries(F.collect_list(F.struct("col_no", "text"))).alias("names"))
    rows = cells.filter(F.col("row_no") > 0).groupBy(page_id, "row_no").agg(
        F.array_sort(F.collect_list(F.struct("col_no", "text"))).alias("row"))
    named = rows.join(names, page_id)
    number = F.col("names")

    def entry(so_far, cell):
        name = F.coalesce(F.nullif(F.try_element_at(number, cell["col_no"]), F.lit("")), cell["col_no"].cast("string"))
        return F.map_concat(F.map_filter(so_far, lambda k, _: k != name), F.create_map(name, cell["text"]))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return named.select(page_id, "row_no", F.aggregate("row", empty, entry).alias("entries"))
