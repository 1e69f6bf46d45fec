"""Mixing sources to target shares with hash-threshold histograms.

Every document has a fixed 60-bit hash. Tokens are summed by source and leading hash digits; a source's budget becomes a
threshold in that histogram, and only the bucket the threshold falls into is looked into further. Documents below the
threshold are drawn; nothing is sorted, and a larger budget draws a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.plans.storage import materialize

#: Hash digits (bits) looked at in each round, and rounds: 5 x 12 bits tell any two hashes apart.
BITS, LEVELS = 12, 5


def source_form(c: Column) -> Column:
    """Sources are compared without case and outer white space."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def draw(sizes: DataFrame, targets: DataFrame, budget: int | str | None = None) -> tuple[DataFrame, DataFrame]:
    """The drawn documents and the report.

    ``sizes``: ``doc_id, source, tokens``; ``targets``: ``source, target_share, max_repeats``. ``budget`` is the size of
    the mixture in tokens; by default the tokens of all targeted sources, once; ``"reachable"`` is the largest size at
    which every target that has documents is met, so no source holds more than its share for another's lack. A source is to give ``share * budget``
    tokens: whole rounds of all its documents and, of one round more, those below its threshold, at most ``max_repeats``
    copies of a document.

    Drawn: ``doc_id, source, tokens, copies``. Report: ``source, target_share, max_repeats, documents, available, wanted,
    drawn, actual_share`` (of all drawn tokens) ``, status``: ``met``, ``short`` (out of reach) or ``absent`` (no
    documents). Defined cases: documents without a source or of untargeted ones are never drawn, documents of 0 tokens
    follow the threshold like others; NULL shares count as 0 and NULL ``max_repeats`` as 1; a target named twice counts
    once (the greatest share); shares need not sum to 1: they are parts of their sum.
    """
    goal = {}
    for r in targets.select(source_form(F.col("source")).alias("s"), "target_share", "max_repeats").collect():  # a small fixed table
        if r.s is not None and (r.s not in goal or (r.target_share or 0) > goal[r.s][0]):
            goal[r.s] = (max(0.0, r.target_share or 0.0), max(0, 1 if r.max_repeats is None else r.max_repeats))
    names = sorted(goal)
    docs = sizes.select("doc_id", source_form(F.col("source")).alias("source"), F.coalesce("tokens", F.lit(0)).alias("tokens")).where(F.col("source").isin(names))
    docs = materialize(docs.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITS * LEVELS)))
    have = {r.source: (r.docs, r.tokens) for r in docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")).collect()}
    total_share = sum(s for s, _ in goal.values()) or 1.0
    size = sum(t for _, t in have.values()) if budget is None else budget
    if budget == "reachable":
        size = min((have[s][1] * goal[s][1] * total_share / goal[s][0] for s in names if s in have and goal[s][0] > 0), default=0)
    rounds, rest = {}, {}
    for s in names:
        share, most = goal[s]
        n = have.get(s, (0, 0))[1]
        want = share / total_share * size
        if n and most:
            full = min(most, int(want // n))
            rounds[s] = full
            if full < most:
                rest[s] = want - full * n
    threshold, low = {}, {s: 0 for s in rest}  # documents with h < threshold get one copy more
    for level in range(LEVELS):
        if not rest:
            break
        shift = BITS * (LEVELS - 1 - level)
        inside = F.lit(False)
        for s in rest:
            inside |= (F.col("source") == s) & (F.col("h") >= low[s]) & (F.col("h") < low[s] + (1 << (shift + BITS)))
        hist: dict[str, dict[int, int]] = {}
        # at most 2^BITS rows for each targeted source
        for r in docs.where(inside).groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("tokens").alias("n")).collect():
            hist.setdefault(r.source, {})[r.b] = r.n
        for s in list(rest):
            at = low[s]
            for b, n in sorted(hist.get(s, {}).items()):
                if n > rest[s]:
                    at = b << shift
                    break
                rest[s] -= n
                at = (b + 1) << shift
            else:
                threshold[s] = at
                rest.pop(s)
                continue
            low[s] = threshold[s] = at
    copies = F.lit(0)
    for s in names:
        if s in rounds:
            more = (F.col("h") < threshold[s]).cast("int") if s in threshold else F.lit(0)
            copies = F.when(F.col("source") == s, F.lit(rounds[s]) + more).otherwise(copies)
    drawn = docs.withColumn("copies", copies.cast("int")).where("copies > 0").select("doc_id", "source", "tokens", "copies")
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn"))
    spark = sizes.sparkSession
    rows = []
    for s in names:
        share, most = goal[s]
        n, tok = have.get(s, (0, 0))
        rows.append((s, share, most, n, tok, float(share / total_share * size), "absent" if not n else "short" if share / total_share * size > tok * most else "met"))
    plan = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, documents bigint, available bigint, wanted double, status string")
    every = Window.partitionBy(F.lit(0))  # the report has a row for each target, not more
    report = plan.join(F.broadcast(got), "source", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    out = report.select("source", "target_share", "max_repeats", "documents", "available", F.round("wanted", 3).alias("wanted"), "drawn", F.round(F.try_divide(F.col("drawn"), F.sum("drawn").over(every)), 6).alias("actual_share"), "status")
    return drawn, out
