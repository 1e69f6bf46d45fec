"""Headers and footers that repeat over a document's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.quality import is_garbled, native_candidate
from pagemill.functions.text import strip_listed, strip_u

#: Share of a page's height that is header or footer, share of pages that makes a text repeated, least pages.
HEADER_ZONE, FOOTER_ZONE, LEAST_SHARE, LEAST_PAGES = 0.15, 0.90, 0.5, 3


def repeated_texts(blocks: DataFrame, share: float = LEAST_SHARE) -> DataFrame:
    """Texts repeated in the header or the footer zone: ``doc_id, text, zone, pages``.

    A text counts once a page and zone. ``blocks``: ``doc_id, page_number, page_height, y0, y1, text``. The pages of a
    document come from ``blocks`` as well. Counting is combined on the map side in both aggregations.
    """
    mid = (F.col("y0") + F.col("y1")) / 2
    zones = F.filter(
        F.array(F.when((mid >= 0) & (mid <= F.col("page_height") * HEADER_ZONE), F.lit("header")), F.when((mid >= F.col("page_height") * FOOTER_ZONE) & (mid <= F.col("page_height")), F.lit("footer"))),
        lambda z: z.isNotNull(),
    )
    text = strip_u(F.col("text"))
    total = blocks.groupBy("doc_id").agg(F.count_distinct("page_number").alias("n")).where(F.col("n") >= LEAST_PAGES)
    once = blocks.select("doc_id", "page_number", text.alias("text"), F.explode(zones).alias("zone")).where(F.length("text") > 1).distinct()
    counted = once.groupBy("doc_id", "text", "zone").agg(F.count("*").alias("pages"))
    return counted.join(total, "doc_id").where(F.col("pages") / F.col("n") >= share).select("doc_id", "text", "zone", "pages")


def repeated_by_document(found: DataFrame) -> DataFrame:
    """Header and footer texts of each document together, sorted: ``doc_id, repeated_texts``."""
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("text")).alias("repeated_texts"))


def analyse_pages(pages: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Page analysis from ``doc_id, page_number, raw_text, table_count, image_blocks``: the columns of the analysis table."""
    raw = strip_u(F.coalesce(F.col("raw_text"), F.lit("")))
    src = pages.withColumn("raw_text", raw)
    if repeated is not None:
        src = src.join(repeated, "doc_id", "left")
    else:
        src = src.withColumn("repeated_texts", F.array().cast("array<string>"))
    tables, images = F.coalesce("table_count", F.lit(0)), F.coalesce("image_blocks", F.lit(0))
    return src.select(
        "doc_id",
        "page_number",
        F.length("raw_text").alias("raw_text_length"),
        "raw_text",
        strip_listed(F.col("raw_text"), F.col("repeated_texts")).alias("body_text"),
        (F.length("raw_text") > 0).alias("has_native_text"),
        (tables > 0).alias("has_tables"),
        tables.alias("table_count"),
        (images > 0).alias("has_images"),
        images.alias("image_blocks"),
        native_candidate("raw_text").alias("native_candidate"),
        is_garbled("raw_text").alias("garbled"),
    )
