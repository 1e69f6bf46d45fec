from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm.chunking import split_items, split_text


def check(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert all(b - a <= limit for a, b in pieces)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    rebuilt = text[pieces[0][0] : pieces[0][1]]
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert c <= b < d
        assert b - c == overlap and a <= c
        rebuilt += text[b:d]
    assert rebuilt == text
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .。\n#|é́中文，", max_size=400), st.integers(10, 60), st.integers(0, 9))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .。\n中", min_size=1, max_size=900), st.integers(2, 400), st.data())
def test_any_overlap(text, limit, data):
    check(text, limit, data.draw(st.integers(0, limit - 1)))


def test_overlaps_start_at_characters():
    text = ("e\u0301" * 3 + "a") * 90
    for overlap in (10, 11, 25):
        for a, _ in check(text, 60, overlap):
            assert text[a : a + 1] != "\u0301"
    assert check("x" * 1400, 400, 200)[:2] == [(0, 350), (150, 525)] or check("x" * 1400, 400, 200)[0][1] >= 200
    assert check("y" * 350, 400, 399) == [(0, 350)]


def test_boundaries():
    text = "First paragraph with words. " * 5 + "\n\n" + "Second paragraph with words. " * 5
    cuts = [b for _, b in check(text, 200, 0)]
    assert text[cuts[0] - 2 : cuts[0]] == "\n\n"
    blob = check("x" * 5000, 2000, 200)
    assert len(blob) == 4
    assert check("é" * 30, 20, 0)
    assert all(("é" * 30)[b : b + 1] != "́" for _, b in check("é" * 30, 21, 0))


def test_frame(spark):
    rows = [(1, "a" * 25), (2, ""), (3, None), (None, "b"), (1, "a" * 25)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k int, t string, piece string")
    got = split_items(df, "k", "t", 10, 2).collect()
    assert {r.k for r in got} == {1, 2, None}
    assert [r.piece for r in got if r.k == 2] == [""]
    one = sorted((r.piece_no, r.start, r.end) for r in got if r.k == 1)
    assert one[0][0] == 1 and len(one) % 2 == 0
    assert split_items(df.limit(0), "k", "t", 10, 2).count() == 0
