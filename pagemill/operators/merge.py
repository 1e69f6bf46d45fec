"""From validated pages to one canonical text for each document."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import DECORATION, FAILED_IMAGE, LOGO, source_comment, strip_markers, strip_u
from pagemill.plans.storage import broadcast_if_small, estimated_bytes, materialize

#: Lines at the top of a page that may be a brand header, and the share of pages that makes one.
TOP_LINES, BRAND_SHARE = 3, 0.4
#: Bytes of a table below which ``latest`` exchanges it whole.
EXCHANGED_BYTES = 256 << 20


def document_gate(records: DataFrame) -> DataFrame:
    """``doc_id, pages, success, failed``: whether all pages are validated, and the numbers of those that aren't."""
    bad = F.filter(F.sort_array(F.collect_set(F.when(~F.coalesce("validated", F.lit(False)), F.col("page_number")))), lambda n: n.isNotNull())
    return records.groupBy("doc_id").agg(F.count_distinct("page_number").alias("pages"), F.bool_and(F.coalesce("validated", F.lit(False))).alias("success"), bad.alias("failed"))


def error_texts(gate: DataFrame) -> DataFrame:
    """One text for each document that failed: ``doc_id, errors``."""
    return gate.where("size(failed) > 0").select("doc_id", F.concat(F.lit("以下页面未通过校验："), F.array_join(F.transform("failed", lambda n: n.cast("string")), ", ")).alias("errors"))


def require_validated(records: DataFrame) -> DataFrame:
    """``records``, or an error naming a document if any page is not validated."""
    gate = document_gate(records).where("not success").limit(1).collect()
    if gate:
        raise ValueError(f"pages of {gate[0].doc_id} are not validated: {gate[0].failed}")
    return records


def missing_outputs(records: DataFrame, outputs: DataFrame) -> DataFrame:
    """Validated pages without any output."""
    return records.where("validated").join(outputs.where("content is not null").select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_anti")


def brand_lines(outputs: DataFrame, manifest: DataFrame, share: float = BRAND_SHARE) -> DataFrame:
    """Lines that stand among the first three of many pages of a document, in the order they are to be read: ``doc_id, brand``.

    A line counts once for each time it stands there. Markers of images and the document's repeated texts don't count.
    Page numbers are kept to the counts, so that a plan that also merges these outputs reads and exchanges them once.
    """
    body = strip_u(strip_markers("content"))
    lines = F.filter(F.transform(F.split(body, "\n", -1), strip_u), lambda l: F.length(l) > 0)
    total = outputs.groupBy("doc_id").agg(F.count("*").alias("n"))
    top = outputs.select("doc_id", "page_number", F.posexplode(F.slice(lines, 1, TOP_LINES)).alias("pos", "line")).where(~F.col("line").isin(LOGO, DECORATION, FAILED_IMAGE))
    listed = manifest.select("doc_id", F.explode("repeated_texts").alias("line")).distinct()
    count = top.join(listed, ["doc_id", "line"], "left_anti").groupBy("doc_id", "line").agg(F.count("page_number").alias("c"), F.min("pos").alias("pos"))
    kept = count.join(total, "doc_id").where(F.col("c") >= F.col("n") * share)
    ordered = F.sort_array(F.collect_list(F.struct("pos", (-F.col("c")).alias("c"), "line")))
    return kept.groupBy("doc_id").agg(F.transform(ordered, lambda s: s["line"]).alias("brand"))


def with_brand(content: Column, brand: Column) -> Column:
    """A page with the brand lines it lacks put in after its first line."""
    body = strip_u(strip_markers(content))
    lacking = F.filter(F.coalesce(brand, F.array().cast("array<string>")), lambda l: ~F.contains(body, l))
    at = F.instr(content, "\n")
    return F.when((at > 1) & (F.size(lacking) > 0), F.concat(F.substring(content, F.lit(1), at), F.array_join(lacking, "\n"), F.lit("\n\n"), F.substring(content, at + 1, F.length(content)))).otherwise(content)


def canonical(outputs: DataFrame, manifest: DataFrame) -> DataFrame:
    """One Markdown text for each document: ``doc_id, markdown``: a source comment, then the pages in order, a blank line between.

    Pages are brought together by document after the brand lines are known; a document's text is as large as its pages.
    """
    brand = brand_lines(outputs, manifest)
    pages = outputs.join(brand, "doc_id", "left").select("doc_id", "page_number", with_brand(F.col("content"), F.col("brand")).alias("content"))
    text = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "content"))), lambda p: p["content"]), "\n\n").alias("text"))
    head = manifest.select("doc_id", source_comment(F.coalesce("source_pdf", F.lit(""))).alias("head"))
    return head.join(text, "doc_id").select("doc_id", F.concat(strip_u(F.concat_ws("\n\n", "head", "text")), F.lit("\n")).alias("markdown"))


def latest(df: DataFrame, keys: list[str], by: str, exchanged: int | None = None) -> DataFrame:
    """The last version of each row by ``by``, one of them on a tie; rows with a NULL key are kept as they are.

    Keys alone are counted first. What comes once, nearly everything, goes through untouched; only rows whose key comes
    again are exchanged with all their columns. Which keys those are is broadcast if they are few. Below
    ``exchanged`` bytes (``EXCHANGED_BYTES``) a plain exchange of all rows is cheaper than the second look, and gives the same.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(by))
    known = reduce(and_, (F.col(k).isNotNull() for k in keys))
    last = lambda rows: rows.withColumn("__r", F.row_number().over(w)).where((F.col("__r") == 1) | ~known).drop("__r")
    if estimated_bytes(df) < (EXCHANGED_BYTES if exchanged is None else exchanged):
        return last(df)
    again = broadcast_if_small(materialize(df.where(known).groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*keys)))
    return df.join(again, keys, "left_anti").unionByName(last(df.join(again, keys, "left_semi")))


def orphan_assets(assets: DataFrame, canonical_texts: DataFrame) -> DataFrame:
    """Assets whose file name their document's canonical text does not contain: ``doc_id, asset``. ``assets``: ``doc_id, asset`` (a path)."""
    name = F.substring_index("asset", "/", -1)
    both = assets.join(canonical_texts, "doc_id", "left")
    return both.where(~F.coalesce(F.contains("markdown", name), F.lit(False))).select("doc_id", "asset")
