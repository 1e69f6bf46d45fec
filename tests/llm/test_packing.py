import os
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import packing as P
from pagemill.llm import tokens


def test_nnls():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, (12, 8)).astype(float) + np.eye(12, 8)
    x = np.maximum(rng.normal(size=8), 0)
    columns = [{i: v for i, v in enumerate(c) if v} for c in a.T.tolist()]
    got = np.array(P.nnls(columns, (a @ x).tolist(), sweeps=20000, settled=0))
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-4
    # against all active sets
    b = rng.normal(size=12)
    got = np.array(P.nnls(columns, b.tolist(), sweeps=20000, settled=0))
    best = min(float(np.linalg.norm(a[:, s] @ y - b)) if s else float(np.linalg.norm(b)) for k in range(9) for s in map(list, combinations(range(8), k)) for y in [np.linalg.lstsq(a[:, s], b, rcond=None)[0] if s else None] if y is None or (y >= 0).all())
    assert np.linalg.norm(a @ got - b) < best + 1e-6


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.lists(st.integers(1, 5000), max_size=60), st.integers(1, 3))
def test_every_capacity(capacity, items, times):
    hist = Counter({min(s, capacity): times * (1 + s % 7) for s in items})
    used = Counter()
    for pattern, n in P.plan_containers(dict(hist), capacity):
        assert sum(pattern) <= capacity and n > 0
        for s in pattern:
            used[s] += n
    assert used == hist


def test_least_squares_at_every_size(monkeypatch):
    """Few items go the same way as many."""
    seen = []
    real = P.nnls
    monkeypatch.setattr(P, "nnls", lambda columns, b, **k: seen.append(len(columns)) or real(columns, b, **k))
    assert P.plan_containers({600: 1, 400: 1}, 1000) == [((600, 400), 1)]
    assert P.plan_containers({334: 3_000_000, 999: 5}, 1000)[0] == ((999,), 5)
    assert P.plan_containers({3: 1_000_003}, 1000) == [((3,) * 333, 3003), ((3,) * 4, 1)]
    assert seen == [1, 1, 1]


def test_plan_uses_every_item():
    rng = random.Random(2)
    for _ in range(30):
        hist = Counter(rng.randint(1, 256) for _ in range(rng.randint(1, 3000)))
        plan = P.plan_containers(dict(hist), 256)
        used = Counter()
        for pattern, times in plan:
            assert sum(pattern) <= 256 and times > 0
            for s in pattern:
                used[s] += times
        assert used == hist


def test_fill_is_high():
    rng = random.Random(3)
    hist = Counter(min(256, max(1, int(rng.lognormvariate(4, 0.8)))) for _ in range(20000))
    n = sum(k for _, k in P.plan_containers(dict(hist), 256))
    assert sum(s * c for s, c in hist.items()) / (n * 256) > 0.99


def packed(spark, sizes, capacity):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id bigint, tokens int, part string")
    return P.pack(df, "doc_id", capacity).collect()


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED", 50)  # a class is ranked in several parts
    rng = random.Random(4)
    sizes = [0, None, 5000, 2048, 2049] + [77] * 400 + [rng.randint(1, 2500) for _ in range(600)]
    rows = packed(spark, sizes, 2048)
    load, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        load[r.container] += r.tokens
        parts[r.doc_id].append((r.tok_start, r.tok_end))
    assert max(load.values()) <= 2048 and sorted(parts) == list(range(len(sizes)))
    for i, n in enumerate(sizes):
        spans = sorted(parts[i])
        assert spans[0][0] == 0 and spans[-1][1] == (n or 0) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) == max(1, -(-(n or 0) // 2048))
    assert sum(load.values()) / (len([c for c in load.values() if c]) * 2048) > 0.97
    report = P.report(P.pack(spark.createDataFrame([(1, 5)], "doc_id bigint, tokens int"), "doc_id", 10), 10).first()
    assert report.containers == 1 and report.fill == 0.5


def test_capacity_without_round_classes(spark):
    rows = packed(spark, [1000, 999, 998, 3, 334, 334, 332, 1], 1000)
    load = defaultdict(int)
    for r in rows:
        load[r.container] += r.tokens
    assert max(load.values()) <= 1000 and sum(load.values()) == 4001 and len(load) == 5
    with pytest.raises(ValueError):
        packed(spark, [1], 0)


def test_pack_nothing(spark):
    assert packed(spark, [], 100) == []
    none = spark.createDataFrame([], "doc_id bigint, tokens int")
    assert P.report(P.pack(none, "doc_id", 10), 10).first().containers == 0
    assert [r.container for r in packed(spark, [0, 0], 100)] == [0, 0]


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")
def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "hello world <|endoftext|>", "a"), (2, None, None), (3, "", "b")], "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.source, r.tokens) for r in tokens.token_sizes(df, "doc_id", "text", "source").collect()}
    enc = tokens.encoder(tokens.VOCABULARY)
    assert got == {1: ("a", len(enc.encode_ordinary("hello world <|endoftext|>"))), 2: (None, 0), 3: ("b", 0)}


def test_other_vocabulary(spark, tmp_path):
    """A vocabulary of bytes only, from any folder: as many tokens as bytes."""
    import base64

    path = tmp_path / "bytes.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    df = spark.createDataFrame([(1, "héllo"), (2, "中")], "doc_id bigint, text string")
    assert {r.doc_id: r.tokens for r in tokens.token_sizes(df, "doc_id", "text", vocabulary=str(path)).collect()} == {1: 6, 2: 3}
