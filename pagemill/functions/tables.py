"""Column expressions over table cells and rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import strip_u

SEPARATOR_LINE = r"(?U)^\s*\|[\s\-:|]+\|"
SKIPPED_START = r"^(\||<|!\[|#)"


def cell_text(c: Column) -> Column:
    """A cell on one line: NULL is empty, line ends become ``<br>``."""
    return F.replace(strip_u(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit("<br>"))


def width(rows: Column) -> Column:
    """Cells of the longest row."""
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def padded(row: Column, n: Column, fill: str = "") -> Column:
    return F.concat(row, F.array_repeat(F.lit(fill), F.greatest(n - F.size(row), F.lit(0))))


def pipe_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def markdown_table(rows: Column) -> Column:
    """Rows as a pipe table, the first being its header."""
    n = width(rows)
    rule = pipe_row(F.array_repeat(F.lit("---"), n))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: pipe_row(padded(r, n)))
    return F.array_join(F.concat(F.array(pipe_row(padded(F.element_at(rows, 1), n)), rule), body), "\n")


def html_table(rows: Column) -> Column:
    """Rows as an HTML table, the first in its head."""
    n = width(rows)
    head = F.transform(padded(F.element_at(rows, 1), n), lambda c: F.concat(F.lit("      <th>"), c, F.lit("</th>")))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.concat(F.array(F.lit("    <tr>")), F.transform(padded(r, n), lambda c: F.concat(F.lit("      <td>"), c, F.lit("</td>"))), F.array(F.lit("    </tr>"))))
    lines = F.concat(F.array(*map(F.lit, ("<table>", "  <thead>", "    <tr>"))), head, F.array(*map(F.lit, ("    </tr>", "  </thead>", "  <tbody>"))), F.flatten(body), F.array(F.lit("  </tbody>"), F.lit("</table>")))
    return F.array_join(lines, "\n")


def table_markup(cells: Column) -> Column:
    """The fitting markup of a table's raw cells: HTML where it is sparse (30 % empty), ragged or a single row; '' for none."""
    rows = F.transform(F.filter(F.coalesce(cells, F.array().cast("array<array<string>>")), lambda r: F.coalesce(F.size(r), F.lit(0)) > 0), lambda r: F.transform(r, cell_text))
    flat = F.flatten(rows)
    empty = F.size(F.filter(flat, lambda c: F.length(strip_u(c)) == 0))
    loose = (empty / F.greatest(F.size(flat), F.lit(1)) >= 0.3) | (F.size(F.array_distinct(F.transform(rows, F.size))) > 1) | (F.size(rows) <= 1)
    return F.when(F.size(rows) == 0, "").when(loose, html_table(rows)).otherwise(markdown_table(rows))


def line_cells(line: Column) -> Column:
    """Cells of a text line: between tabs, empty ones kept; else between two blanks or more."""
    tabs = F.transform(F.split(line, "\t", -1), strip_u)
    gaps = F.filter(F.transform(F.split(strip_u(line), "[ 　]{2,}", -1), strip_u), lambda c: F.length(c) > 0)
    return F.when(F.contains(line, F.lit("\t")), tabs).otherwise(gaps)


def is_cell_like(token: Column) -> Column:
    """Whether a token looks like a cell: a figure, a multiple, a word of at most ten characters, a period."""
    t = strip_u(token)
    forms = (r"(?U)^-?[\d,]+\.?\d*%?$", r"(?Ui)^[\d.]+x$", r"(?U)^[一-鿿/（）\w]{1,10}$", r"(?Ui)^(?:yoy|Q[1-4]|YTD|\d{4}[EeYy]?)$")
    hit = t.rlike(forms[0])
    for f in forms[1:]:
        hit |= t.rlike(f)
    return (F.length(t) > 0) & hit


def order_is_reliable(page_text: Column, cells: Column) -> Column:
    """Whether the lines of every cell stand in the page's text in the cell's order.

    Of each cell's lines the first places in the text are compared with the last place found before; lines the text
    lacks are passed over.
    """
    texts = F.filter(F.flatten(F.transform(cells, lambda r: F.coalesce(r, F.array().cast("array<string>")))), lambda c: c.isNotNull())
    start = F.struct(F.lit(-1).alias("at"), F.lit(True).alias("ok"))

    def cell_ok(cell: Column) -> Column:
        lines = F.filter(F.transform(F.split(cell, "\n", -1), strip_u), lambda l: F.length(l) > 0)
        places = F.transform(lines, lambda l: F.instr(page_text, l) - 1)
        return F.aggregate(places, start, lambda s, p: F.struct(F.when(p >= 0, p).otherwise(s["at"]).alias("at"), (s["ok"] & ~((p >= 0) & (s["at"] >= 0) & (p < s["at"]))).alias("ok")), lambda s: s["ok"])

    return F.forall(F.coalesce(texts, F.array().cast("array<string>")), cell_ok)


def heading_level(size: Column, body: Column) -> Column:
    """Heading level of a font size against the body's: 1.8, 1.4 and 1.15 times as large are levels 1 to 3, else 0."""
    ratio = size / body
    return F.when(body <= 0, 0).when(ratio >= 1.8, 1).when(ratio >= 1.4, 2).when(ratio >= 1.15, 3).otherwise(0)
