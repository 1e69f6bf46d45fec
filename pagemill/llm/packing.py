"""Filling containers of fixed capacity: pattern packing by non-negative least squares.

Items are counted by size. Patterns of a few sizes that fill a container are enumerated, how often each is used is
fitted to the histogram by non-negative least squares, the counts are rounded, and what is left is packed
best-fit-decreasing, also on the histogram. It has at most as many rows as the capacity has tokens and patterns are
bounded by it, so all this is small however many items there are; the items themselves are only ranked within their
size and looked up in the plan.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.plans.storage import materialize

#: Items of an enumerated pattern, about how many patterns are enumerated, and how full one must be to be fitted.
PATTERN_ITEMS, PATTERNS, FULL = 4, 24_000, 0.95
#: Sweeps of the least squares, and the change of a count at which they end.
SWEEPS, SETTLED = 40, 0.02
#: Items of a size that one task ranks.
RANKED = 100_000


def nnls(columns: list[dict[int, int]], b: list[float], sweeps: int = SWEEPS, settled: float = SETTLED) -> list[float]:
    """Least squares ``min |A x - b|`` with ``x >= 0`` for sparse columns (row to value), by coordinate descent.

    Each step solves for one count exactly and cuts it off at 0; early columns take what they can, so the counts come out
    concentrated on few patterns and lose little when they are rounded.
    """
    x, left = [0.0] * len(columns), list(map(float, b))
    cols = [(tuple(c.items()), float(sum(v * v for v in c.values()))) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, (col, norm) in enumerate(cols):
            step = 0.0
            for i, v in col:
                step += v * left[i]
            step = max(step / norm, -x[j])
            if step > 1e-9 or step < -1e-9:
                x[j] += step
                for i, v in col:
                    left[i] -= v * step
                moved = max(moved, abs(step))
        if moved < settled:
            break
    return x


def enumerate_patterns(sizes: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Descending patterns of up to ``PATTERN_ITEMS`` of the ascending ``sizes`` that leave as little of ``capacity`` as they can.

    A size of which more than that fit into a container also has a pattern of its own, with as many as fit.
    For every first size come the second ones that nearly fill what is left and some spread over all; the rest is
    filled with the largest sizes that fit. About ``PATTERNS`` are made, and at least two for each size.
    """
    near = max(1, min(24, PATTERNS // (2 * max(1, len(sizes)))))
    out = set()

    def largest(limit: int) -> int | None:
        k = bisect_right(sizes, limit)
        return sizes[k - 1] if k else None

    def add(pattern: list[int], most: int) -> None:
        left = capacity - sum(pattern)
        while left > 0 and len(pattern) < most and (nxt := largest(min(left, pattern[-1]))) is not None:
            pattern.append(nxt)
            left -= nxt
        out.add(tuple(pattern))

    for first in sizes:
        out.add((first,))
        if (times := capacity // first) > PATTERN_ITEMS:
            add([first] * times, times + PATTERN_ITEMS - 1)
        top = bisect_right(sizes, min(first, capacity - first))
        for second in {*sizes[max(0, top - near) : top], *sizes[: top : max(1, top // near)]}:
            add([first, second], PATTERN_ITEMS)
    return sorted(out, reverse=True)


def plan_containers(hist: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``(pattern, repeats)`` that use up ``hist`` (size to items) exactly; a pattern's sizes sum to at most ``capacity``."""
    left = {s: n for s, n in hist.items() if n > 0}
    plan: Counter = Counter()
    sizes = sorted(left)
    at = {s: i for i, s in enumerate(sizes)}
    # the fullest patterns first: descent lets them take what they can
    fitted = sorted((p for p in enumerate_patterns(sizes, capacity) if sum(p) >= FULL * capacity), key=lambda p: (-sum(p), len(p), p))
    counts = nnls([{at[s]: c for s, c in Counter(p).items()} for p in fitted], [left[s] for s in sizes])
    for p, x in zip(fitted, counts):
        k = min(math.floor(x + 0.5), *(left[s] // c for s, c in Counter(p).items()))
        if k > 0:
            plan[p] += k
            for s in p:
                left[s] -= k
    for p, k in best_fit({s: n for s, n in left.items() if n > 0}, capacity):
        plan[p] += k
    return sorted(plan.items(), reverse=True)


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Residuals by best fit: a container starts with the largest size left and takes the largest that fits, again and again.

    Containers alike are made at once, as often as the classes allow, so the work follows the classes, not the items.
    """
    left, sizes, out = dict(hist), sorted(hist), []
    while sizes:
        pattern: list[int] = []
        room, taken = capacity, {}
        k = len(sizes) - 1
        while k >= 0:
            s = sizes[k]
            if s <= room and left[s] - taken.get(s, 0) > 0:
                pattern.append(s)
                taken[s] = taken.get(s, 0) + 1
                room -= s
            else:
                k = min(k - 1, bisect_right(sizes, room) - 1)
        times = min(left[s] // c for s, c in taken.items())
        out.append((tuple(pattern), times))
        for s, c in taken.items():
            left[s] -= times * c
            if not left[s]:
                sizes.remove(s)
    return out


def layout(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int]]:
    """``(size, first rank, container of the first rank)`` for every place of the plan; ranks of a size have no gaps."""
    rows, used, base = [], Counter(), 0
    for pattern, times in plan:
        for s in pattern:
            rows.append((s, used[s], base))
            used[s] += times
        base += times
    return rows


def _look_up(ranked: DataFrame, places: list[tuple[int, int, int]], most: int) -> DataFrame:
    """``ranked`` (``m``, ``rank``) with ``container``: the place whose first rank is the last not above the item's, by bisection."""
    code = np.array([s * (most + 1) + a for s, a, _ in places], dtype=np.int64)
    order = np.argsort(code)
    shift = np.array([base - a for _, a, base in places], dtype=np.int64)[order]
    # as many rows as the plan has places: bounded by the capacity and PATTERNS, not by the items
    shared = ranked.sparkSession.sparkContext.broadcast((code[order], shift))

    def run(batches):
        code, shift = shared.value
        for b in batches:
            m, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("m", "rank"))
            place = np.searchsorted(code, m * (most + 1) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank + shift[place])], names=[*b.schema.names, "container"])

    return ranked.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in ranked.schema)}, container bigint")


def pack(sizes: DataFrame, key: str, capacity: int) -> DataFrame:
    """Containers of the items of ``sizes`` (``key``, ``tokens``): ``key, part, tok_start, tok_end, tokens, container``.

    An item larger than ``capacity`` is cut into full containers and a remainder, which is packed like an item; no other
    item is split. Ranks within a size are taken in parts of about ``RANKED`` items, so a size with a third of all
    items is spread. Defined cases: items of 0 tokens (or NULL) stand in container 0, which they do not fill; a NULL key
    is an item; equal keys are items each; no items give no containers; a capacity below 1 is an error.
    """
    if capacity < 1:
        raise ValueError("a container holds at least one token")
    cut = sizes.select(F.col(key).alias("k"), F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("n"))
    parts = F.when(F.col("n") > capacity, F.ceil(F.col("n") / capacity)).otherwise(1).cast("int")
    piece = cut.select("k", "n", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).withColumn("a", F.col("part") * F.lit(capacity).cast("bigint")).withColumn("b", F.least(F.col("a") + capacity, F.col("n")))
    piece = materialize(piece.select("k", "part", "a", "b", (F.col("b") - F.col("a")).cast("int").alias("m"), F.xxhash64("k", "part").alias("salt")))
    hist = {r.m: r.n for r in piece.where("m > 0").groupBy("m").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    shards = max(1, math.ceil(max(hist.values(), default=0) / RANKED))
    full = piece.where("m > 0").withColumn("shard", F.pmod("salt", F.lit(shards)).cast("int"))
    per = full.groupBy("m", "shard").agg(F.count("*").alias("n"))
    before = per.select("m", "shard", F.coalesce(F.sum("n").over(Window.partitionBy("m").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    offsets = F.broadcast(before) if shards == 1 else before
    ranked = full.withColumn("r", F.row_number().over(Window.partitionBy("m", "shard").orderBy("salt", "k", "part")) - 1).join(offsets, ["m", "shard"]).select("k", "part", "a", "b", "m", (F.col("r") + F.col("before")).alias("rank"))
    places = layout(plan_containers(hist, capacity))
    cols = [F.col("k").alias(key), F.col("part"), F.col("a").alias("tok_start"), F.col("b").alias("tok_end"), F.col("m").alias("tokens"), "container"]
    empty = piece.where("m = 0").withColumn("container", F.lit(0).cast("bigint")).select(*cols)
    return _look_up(ranked, places, max(hist.values())).select(*cols).unionByName(empty) if places else empty


def report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: ``items, tokens, containers, least_containers, fill`` and the size of the fullest container."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("used"), F.count("*").alias("items"))
    return per.agg(
        F.sum("items").alias("items"),
        F.sum("used").alias("tokens"),
        F.count("*").alias("containers"),
        F.ceil(F.sum("used") / capacity).alias("least_containers"),
        F.round(F.try_divide(F.sum("used"), F.count("*") * F.lit(capacity)), 6).alias("fill"),
        F.max("used").alias("fullest"),
    )
