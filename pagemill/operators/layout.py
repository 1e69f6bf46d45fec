"""Rendering pages from their layout: spans, tables and images, gathered in the page's row.

A page is folded within its row with higher-order functions; nothing is exchanged. Inputs are arrays: ``spans`` of
``block_no, line_no, span_no, text, size, flags, y0, y1``, ``tables`` of ``table_no, y0, y1, content`` and ``images``
of ``xref, rect_no, y0``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.tables import heading_level, order_is_reliable, table_markup
from pagemill.functions.text import image_placeholder, or_empty_page, rstrip_u, strip_u

PAGE = ["doc_id", "page_number"]
DEFAULT_SIZE, BOLD, TABLE_MARGIN = 11.0, 16, 2.0
_FRAGMENTS = "array<struct<y0:double,kind:int,seq:int,content:string>>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is computed once: a lambda's outer expressions are computed for every element."""
    return F.transform(F.array(value), f).getItem(0)


def ordered_spans(spans: Column | str) -> Column:
    """Spans in reading order, NULL texts empty."""
    s = F.col(spans) if isinstance(spans, str) else spans
    same = F.transform(s, lambda x: F.struct(x["block_no"].alias("block_no"), x["line_no"].alias("line_no"), x["span_no"].alias("span_no"), F.coalesce(x["text"], F.lit("")).alias("text"), x["size"].cast("double").alias("size"), x["flags"].alias("flags"), x["y0"].cast("double").alias("y0"), x["y1"].cast("double").alias("y1")))
    return F.array_sort(F.coalesce(same, F.expr("array()").cast("array<struct<block_no:int,line_no:int,span_no:int,text:string,size:double,flags:int,y0:double,y1:double>>")))


def body_size(spans: Column) -> Column:
    """Body font size of a page's ordered spans: the size (to a tenth) that most characters have, the first met on a tie; NULL without text."""
    sized = F.filter(F.transform(spans, lambda s: F.struct(F.bround(s["size"], 1).alias("s"), F.length(strip_u(s["text"])).alias("w"))), lambda s: s["w"] > 0)

    def heaviest(own: Column) -> Column:
        weights = F.transform(F.array_distinct(F.transform(own, lambda s: s["s"])), lambda size: F.struct(F.aggregate(own, F.lit(0), lambda a, s: a + F.when(s["s"] == size, s["w"]).otherwise(0)).alias("w"), size.alias("s")))
        # sizes stand in the order they were met, and only a heavier one takes over
        start = F.struct(F.lit(0).alias("w"), F.lit(None).cast("double").alias("s"))
        return F.aggregate(weights, start, lambda best, x: F.when(x["w"] > best["w"], x).otherwise(best), lambda best: best["s"])

    return let(sized, heaviest)


def reliable_tables(tables: Column | str, raw_text: Column | str) -> Column:
    """Tables with markup (``table_no, y0, y1, content``) of raw ones with ``cells``, where the page's text confirms the order of their cells."""
    raw = F.col(raw_text) if isinstance(raw_text, str) else raw_text
    kept = F.filter(F.col(tables) if isinstance(tables, str) else tables, lambda t: raw.isNull() | order_is_reliable(raw, t["cells"]))
    marked = F.transform(kept, lambda t: F.struct(t["table_no"].alias("table_no"), t["y0"].alias("y0"), t["y1"].alias("y1"), table_markup(t["cells"]).alias("content")))
    return F.filter(marked, lambda t: F.length(t["content"]) > 0)


def is_outside(y0: Column, y1: Column, tables: Column) -> Column:
    """Whether the middle of a block lies in the height of no table."""
    mid = (y0 + y1) / 2
    return ~F.exists(tables, lambda t: (mid >= t["y0"] - TABLE_MARGIN) & (mid <= t["y1"] + TABLE_MARGIN))


def span_text(text: Column, level: Column, flags: Column) -> Column:
    """A span in Markdown: bold where its flags say so and it is no heading."""
    bold = (flags.bitwiseAND(BOLD) != 0) & (level == 0) & (F.length(strip_u(text)) > 0)
    return F.when(bold, F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text)


def _line(spans: Column, body: Column) -> Column:
    """A line of spans in Markdown, '' if it is blank; its level is its spans' greatest."""
    leveled = F.transform(spans, lambda s: F.struct(s["text"].alias("text"), s["flags"].alias("flags"), F.when(F.length(strip_u(s["text"])) > 0, heading_level(s["size"], body)).otherwise(0).alias("level")))

    def shown(own: Column) -> Column:
        level = F.array_max(F.transform(own, lambda s: s["level"]))
        text = rstrip_u(F.array_join(F.transform(own, lambda s: span_text(s["text"], s["level"], s["flags"])), ""))
        heading = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.regexp_replace(text, "^[# ]+", ""))
        return F.when(F.length(strip_u(text)) == 0, "").when(level > 0, heading).otherwise(text)

    return let(leveled, shown)


def blocks_of(spans: Column) -> Column:
    """Blocks of ordered spans: ``block_no, y0, y1, spans``."""

    def block(n: Column) -> Column:
        return let(F.filter(spans, lambda s: s["block_no"] == n), lambda own: F.struct(n.alias("block_no"), F.array_min(F.transform(own, lambda s: s["y0"])).alias("y0"), F.array_max(F.transform(own, lambda s: s["y1"])).alias("y1"), own.alias("spans")))

    return F.transform(F.array_distinct(F.transform(spans, lambda s: s["block_no"])), block)


def _block_text(spans: Column, body: Column) -> Column:
    lines = F.array_distinct(F.transform(spans, lambda s: s["line_no"]))
    texts = F.transform(lines, lambda n: _line(F.filter(spans, lambda s: s["line_no"] == n), body))
    return F.array_join(F.filter(texts, lambda t: F.length(t) > 0), "\n")


def page_markdown(spans: Column | str, tables: Column | None = None, images: Column | None = None) -> Column:
    """Markdown of a page.

    Fragments are ordered by height; on a tie tables come before images before text, each in its own order. A page
    without any is the marker of an empty page.
    """
    nothing = F.array().cast(_FRAGMENTS)
    one = lambda y0, kind, seq, content: F.struct(y0.cast("double").alias("y0"), F.lit(kind).alias("kind"), seq.cast("int").alias("seq"), content.alias("content"))
    areas = F.coalesce(tables, F.array().cast("array<struct<table_no:int,y0:double,y1:double,content:string>>")) if tables is not None else None
    parts = [nothing]
    if areas is not None:
        parts.append(F.transform(areas, lambda t: one(t["y0"], 0, t["table_no"], t["content"])))
    if images is not None:
        parts.append(F.coalesce(F.transform(images, lambda i: one(i["y0"], 1, i["rect_no"], image_placeholder(i["xref"]))), nothing))

    def text_blocks(s: Column) -> Column:
        blocks = blocks_of(s)
        if areas is not None:
            blocks = F.filter(blocks, lambda b: is_outside(b["y0"], b["y1"], areas))
        return let(F.coalesce(body_size(s), F.lit(DEFAULT_SIZE)), lambda size: F.transform(blocks, lambda b: one(b["y0"], 2, b["block_no"], _block_text(b["spans"], size))))

    parts.append(F.filter(let(ordered_spans(spans), text_blocks), lambda f: F.length(f["content"]) > 0))
    ordered = F.array_sort(F.concat(*parts))
    return or_empty_page(F.array_join(F.transform(ordered, lambda f: f["content"]), "\n\n"))


def pending_images(images: DataFrame) -> DataFrame:
    """Images to be read: each once in a document, whatever its rectangles: ``doc_id, placeholder_id, image``."""
    return images.where(F.col("image").isNotNull()).withColumn("placeholder_id", F.format_string("xref-%d", "xref")).groupBy("doc_id", "placeholder_id").agg(F.min_by("image", F.struct("page_number", "rect_no")).alias("image"))
