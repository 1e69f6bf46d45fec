import random

from pagemill.llm.mixing import draw

S = "doc_id bigint, source string, tokens int, copies string"
T = "source string, target_share double, max_repeats int"


def sizes(spark, n=2000):
    rng = random.Random(1)
    rows = [(i, rng.choice(["A ", "a", "b", "b", "b", "c", None, "other"]), rng.choice([0, 10, 200, None, 55]), "x") for i in range(n)]
    return spark.createDataFrame(rows, S)


def test_shares(spark):
    t = spark.createDataFrame([("a", 0.5, 4), ("B", 0.3, 1), ("c", 0.2, 1), ("gone", 0.1, 2), ("a", 0.1, 9)], T)
    drawn, report = draw(sizes(spark), t, budget=60_000)
    got = {r.source: r for r in report.collect()}
    assert got["gone"].status == "absent" and got["gone"].drawn == 0
    for s in ("a", "b"):
        assert got[s].status == "met" and 0 <= got[s].wanted - got[s].drawn <= 200
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-5
    rows = drawn.collect()
    assert {r.source for r in rows} <= {"a", "b", "c"} and max(r.copies for r in rows if r.source == "b") == 1
    assert max(r.copies for r in rows if r.source == "a") <= 4


def test_nested_and_short(spark):
    t = spark.createDataFrame([("b", 1.0, 2)], T)
    small, big = ({r.doc_id: r.copies for r in draw(sizes(spark), t, budget=b)[0].collect()} for b in (5_000, 30_000))
    assert small and set(small) < set(big) and all(big[d] >= n for d, n in small.items())
    drawn, report = draw(sizes(spark), t, budget=10**9)
    assert report.first().status == "short" and {r.copies for r in drawn.collect()} == {2}


def test_reachable(spark):
    """The scarcest source sets the size, and every share is met."""
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1), ("gone", 0.0, 2)], T)
    short = {r.source: r for r in draw(sizes(spark), t, budget=10**6)[1].collect()}
    got = {r.source: r for r in draw(sizes(spark), t, budget="reachable")[1].collect()}
    assert short["a"].status == "short" and {r.status for r in got.values()} == {"met", "absent"}
    assert all(abs(got[s].actual_share - w) < 0.02 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert any(abs(got[s].wanted - got[s].available * got[s].max_repeats) < 1 for s in "abc")


def test_edges(spark):
    none = spark.createDataFrame([], T)
    drawn, report = draw(sizes(spark, 10), none)
    assert drawn.count() == 0 and report.count() == 0
    t = spark.createDataFrame([("b", None, None), (None, 0.5, 1), ("c", 0.0, 0)], T)
    drawn, report = draw(spark.createDataFrame([], S), t)
    assert drawn.count() == 0 and {r.status for r in report.collect()} == {"absent"}
