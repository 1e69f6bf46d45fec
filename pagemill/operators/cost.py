"""Token totals and costs of model calls, and estimates before any call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.quality import native_candidate

#: Tokens a scanned page is taken to cost, and prices (USD a million tokens) of a model without a price.
PAGE_IN, PAGE_OUT, DEFAULT_IN, DEFAULT_OUT = 1200, 800, 1.0, 4.0


def usage_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost of each model: ``model, calls, prompt_tokens, completion_tokens, cost``; a model without a price costs 0."""
    total = calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"), F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"))
    cost = (F.col("prompt_tokens") * F.coalesce("input", F.lit(0.0)) + F.col("completion_tokens") * F.coalesce("output", F.lit(0.0))) / 1e6
    return total.join(F.broadcast(prices), "model", "left").select("model", "calls", "prompt_tokens", "completion_tokens", F.round(cost, 6).alias("cost"))  # a price list: one row a model


def dry_run(pages: DataFrame, key: str, price_in: float = DEFAULT_IN, price_out: float = DEFAULT_OUT) -> DataFrame:
    """Pages, scanned pages and estimated cost of each ``key`` and of all (``key`` NULL): ``key, pages, scan_pages, cost``."""
    scan = F.count_if(~native_candidate("raw_text"))
    cost = scan * F.lit((PAGE_IN * price_in + PAGE_OUT * price_out) / 1e6)
    return pages.rollup(key).agg(F.count("*").alias("pages"), scan.alias("scan_pages"), F.round(cost, 6).alias("cost"))


def batch_summary(results: DataFrame) -> DataFrame:
    """``succeeded, failed`` over documents; an unknown result is a failure."""
    ok = F.coalesce("success", F.lit(False))
    return results.agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
