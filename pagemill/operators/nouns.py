"""Names of companies and funds that a document's own text layer confirms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.plans.storage import broadcast_if_small, materialize

#: Endings of names and counts that make one; fixed values.
COMPANY = "[一-鿿]{2,}(?:有限合伙）|有限公司|股份有限公司|有限责任公司)"
FUND = "[一-鿿]{2,}(?:合伙企业|投资中心|基金)"
LEAST_LENGTH, LEAST_NAMES, SHORT_FORM, LEAST_SHORT = 6, 2, 4, 5


def names(texts: DataFrame) -> DataFrame:
    """Full names found at least twice in a document: ``doc_id, noun, n``. ``texts``: ``doc_id, text``."""
    found = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (COMPANY, FUND)))
    each = texts.select("doc_id", F.explode(found).alias("noun")).where(F.length("noun") >= LEAST_LENGTH)
    return each.groupBy("doc_id", "noun").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_NAMES)


def short_forms(texts: DataFrame, full: DataFrame) -> DataFrame:
    """Four characters of a name that its document has at least five times (without overlaps) and that are no name themselves: ``doc_id, noun, n``.

    Pages are counted one by one: a short form cannot span two. The four-character pieces of a document's names are
    bounded by its names, and only documents that have any are read again.
    """
    run = F.regexp_replace("noun", "[^一-鿿]", "")
    pieces = full.where(F.length(run) >= SHORT_FORM).select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.length(run) - SHORT_FORM + 1), lambda i: F.substring(run, i, F.lit(SHORT_FORM)))).alias("noun")).distinct()
    own = broadcast_if_small(materialize(pieces.groupBy("doc_id").agg(F.collect_set("noun").alias("pieces"))))
    # counted within the page's row: only pieces that are there leave it
    times = lambda p: ((F.length("text") - F.length(F.replace(F.col("text"), p, F.lit("")))) / SHORT_FORM).cast("bigint")
    found = F.filter(F.transform("pieces", lambda p: F.struct(p.alias("noun"), times(p).alias("k"))), lambda x: x["k"] > 0)
    hits = texts.join(own, "doc_id").select("doc_id", F.explode(found).alias("h"))
    counted = hits.groupBy("doc_id", F.col("h.noun").alias("noun")).agg(F.sum("h.k").alias("n")).where(F.col("n") >= LEAST_SHORT)
    return counted.join(full.select("doc_id", "noun"), ["doc_id", "noun"], "left_anti")


def known_nouns(texts: DataFrame) -> DataFrame:
    """Names and short forms of each document, the longest first: ``doc_id, nouns``."""
    full = names(texts)
    both = full.select("doc_id", "noun").unionByName(short_forms(texts, full).select("doc_id", "noun"))
    order = F.struct((-F.length("noun")).alias("l"), "noun")
    return both.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_set(order)), lambda s: s["noun"]).alias("nouns"))
