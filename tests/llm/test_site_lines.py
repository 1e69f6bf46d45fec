import random
from collections import defaultdict

from pagemill.llm import site_lines as S

A = "page_id bigint, doc_id string, source string, body_text string, line string"
M = "doc_id string, source string, repeated_texts array<string>"


def brute(analysis, manifest):
    wide = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
    form = lambda l: "".join((l or "").split()).translate(wide).lower()
    docs, total = defaultdict(set), defaultdict(set)
    occ = []
    for d, s, listed in manifest:
        if s:
            total[s].add(d)
            for i, l in enumerate(listed or [], 1):
                if form(l):
                    docs[s, form(l)].add(d)
                    occ.append(("manifest.repeated_texts", d, i, s, form(l)))
    for p, d, s, t, _ in analysis:
        if s and t is not None:
            for i, l in enumerate(t.split("\n"), 1):
                if form(l):
                    docs[s, form(l)].add(d)
                    occ.append(("analysis.body_text", str(p), i, s, form(l)))
    return {(f, k, i) for f, k, i, s, l in occ if len(docs[s, l]) >= 3 and len(docs[s, l]) >= 0.15 * len(total[s])}


def test_against_brute_force(spark):
    rng = random.Random(5)
    lines = ["Share this!", "ＳＨＡＲＥ  this！", "分享 本页", "分享　本页", " ", ""] + [f"text {i}" for i in range(40)]
    manifest = [(f"d{i}", rng.choice(["a", "b", None]), rng.choice([None, [], [rng.choice(lines), None]])) for i in range(40)]
    manifest.append(manifest[0])
    source = {d: s for d, s, _ in manifest}
    analysis = []
    for p in range(120):
        d = f"d{rng.randrange(40)}"
        analysis.append((p, d, source[d], rng.choice([None, "", "\n".join(rng.choices(lines, k=6))]), "clash"))
    analysis.append(analysis[3])
    a, m = spark.createDataFrame(analysis, A), spark.createDataFrame(manifest, M)
    found = S.find_repeated(a, m)
    got = {(r.field, r.record_key, r.line_no) for r in found.collect()}
    assert got == brute(analysis, manifest) and got
    clean = {r.page_id: r for r in S.without_repeated(a, found).collect()}
    for p, _, _, t, _ in analysis:
        gone = {i for f, k, i in got if f == "analysis.body_text" and k == str(p)}
        assert clean[p].body_text == (None if t is None else "\n".join(l for i, l in enumerate(t.split("\n"), 1) if i not in gone))
    assert S.repeated_by_source(found).count() > 0


def test_blocks(spark):
    text = "terms of use\nall rights reserved\nbody {}\nfollow us"
    a = spark.createDataFrame([(i, f"d{i}", "s", text.format(i), "") for i in range(6)], A)
    m = spark.createDataFrame([(f"d{i}", "s", None) for i in range(6)], M)
    by = defaultdict(set)
    for r in S.find_repeated(a, m).collect():
        by[r.block].add(r.line)
    assert sorted(map(sorted, by.values())) == [["all rights reserved", "terms of use"], ["follow us"]]


def test_empty(spark):
    found = S.find_repeated(spark.createDataFrame([], A), spark.createDataFrame([], M))
    assert found.count() == 0
    few = spark.createDataFrame([(1, "d", "s", "x", "")] * 5, A)
    assert S.find_repeated(few, spark.createDataFrame([("d", "s", ["x"])], M)).count() == 0
