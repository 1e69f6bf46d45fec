"""Tables in plain lines of text: finding them, and repairing pipe tables.

Both walk the lines of one text once, as a fold over an array: a page is a row and stays one, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.tables import SEPARATOR_LINE, SKIPPED_START, is_cell_like, line_cells, markdown_table, padded, pipe_row, width
from pagemill.functions.text import strip_u

#: Cells that start a table, least cells and share of cell-like ones that continue it, rows that make it one.
START_CELLS, ROW_CELLS, ROW_SHARE, TABLE_ROWS = 3, 2, 0.5, 3


def plain_tables(text: Column) -> Column:
    """``text`` with every block of three or more table-like lines turned into a pipe table.

    A line is a row (T), blank (B) or other (X). A block starts at the first line of three cells in a run of T and B
    lines that is no markup, and ends with the run; blank lines inside it are dropped with the conversion.
    """

    def classed(l: Column) -> Column:
        cells = line_cells(l)
        row = (F.size(cells) >= ROW_CELLS) & (F.size(F.filter(cells, is_cell_like)) >= F.size(cells) * ROW_SHARE)
        blank = ~row & (F.length(strip_u(l)) == 0)
        start = ~strip_u(l).rlike(SKIPPED_START) & (F.size(cells) >= START_CELLS) & (row | blank)
        return F.struct(l.alias("line"), cells.alias("cells"), row.alias("row"), blank.alias("blank"), start.alias("start"))

    nothing = F.array().cast("array<string>")
    no_rows = F.array().cast("array<array<string>>")
    state = lambda done, inside, rows, raw: F.struct(done.alias("done"), inside.alias("inside"), rows.alias("rows"), raw.alias("raw"))

    def close(s: Column) -> Column:
        return F.concat(s["done"], F.when(F.size(s["rows"]) >= TABLE_ROWS, F.array(markdown_table(s["rows"]))).otherwise(s["raw"]))

    def step(s: Column, x: Column) -> Column:
        rows = F.when(x["row"], F.array(x["cells"])).otherwise(no_rows)
        inside = s["inside"] & (x["row"] | x["blank"])
        return (
            F.when(inside, state(s["done"], F.lit(True), F.concat(s["rows"], rows), F.concat(s["raw"], F.array(x["line"]))))
            .when(s["inside"], state(F.concat(close(s), F.array(x["line"])), F.lit(False), no_rows, nothing))
            .when(x["start"], state(s["done"], F.lit(True), rows, F.array(x["line"])))
            .otherwise(state(F.concat(s["done"], F.array(x["line"])), F.lit(False), no_rows, nothing))
        )

    lines = F.transform(F.split(text, "\n", -1), classed)
    return F.aggregate(lines, state(nothing, F.lit(False), no_rows, nothing), step, lambda s: F.array_join(F.when(s["inside"], close(s)).otherwise(s["done"]), "\n"))


def pipe_cells(line: Column) -> Column:
    """Cells of a pipe table's line; all outer pipes go."""
    return F.split(F.regexp_replace(strip_u(line), r"^\|+|\|+$", ""), r"\|", -1)


def align_pipe_tables(text: Column, strict: bool = False) -> Column:
    """``text`` with every pipe table's rows padded to its widest and its rule rebuilt.

    A block begins at the first pipe line that is followed by a rule and ends with the run of pipe lines. Its second
    line is rebuilt as a rule if it begins like one, so a data row whose first cell is blank is overwritten there;
    ``strict`` asks that the whole line is a rule.
    """
    rule = SEPARATOR_LINE + (r"[\s\-:|]*$" if strict else "")
    lines = F.split(text, "\n", -1)
    numbered = F.transform(lines, lambda l, i: F.struct(l.alias("line"), F.startswith(strip_u(l), F.lit("|")).alias("pipe"), F.coalesce(F.get(lines, i + 1).rlike(rule), F.lit(False)).alias("before_rule")))
    nothing = F.array().cast("array<string>")
    state = lambda done, block: F.struct(done.alias("done"), block.alias("block"))

    def close(s: Column) -> Column:
        rows = F.transform(s["block"], pipe_cells)
        n = width(rows)
        fixed = F.transform(s["block"], lambda l, i: F.when((i == 1) & l.rlike(rule), pipe_row(F.array_repeat(F.lit("---"), n))).otherwise(pipe_row(F.transform(padded(pipe_cells(l), n), strip_u))))
        return F.concat(s["done"], F.when(F.size(s["block"]) > 0, fixed).otherwise(nothing))

    def step(s: Column, x: Column) -> Column:
        one = F.array(x["line"])
        return F.when((F.size(s["block"]) > 0) & x["pipe"], state(s["done"], F.concat(s["block"], one))).when(x["pipe"] & x["before_rule"], state(close(s), one)).otherwise(state(F.concat(close(s), one), nothing))

    return F.aggregate(numbered, state(nothing, nothing), step, lambda s: F.array_join(close(s), "\n"))
