"""Cutting oversized texts at natural boundaries by recursive bisection."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.rows import map_batches

#: Boundary patterns from strong to weak; a cut falls at the end of the match.
BOUNDARIES = (
    (7, re.compile(r"\n\s*\n(?=#|<!--)")),
    (6, re.compile(r"\n[ \t]*\n+")),
    (5, re.compile(r"\n(?=#|[-*•] |\||\s*<t)")),
    (4, re.compile(r"\n")),
    (4, re.compile(r"[。！？]+[”’」』）)]*")),
    (4, re.compile(r"[.!?…]+[\"”’)»]*[  ]+(?=[^\Wa-z\d_]|[-•\"“«¿¡(\d])")),
    (3, re.compile(r"[;；:：]\s*|[,，、]\s+|[，；、：]")),
    (2, re.compile(r"(?<=\S)[ \t 　]+")),
)

#: Share of a span, on both sides of its midpoint, in which the cut is searched.
WINDOW = 0.3


def _joined(text: str, at: int) -> bool:
    """Whether a cut before ``at`` would split one visible character (combining marks, joiners, CRLF)."""
    if at <= 0 or at >= len(text):
        return False
    c, before = text[at], text[at - 1]
    return bool(
        unicodedata.combining(c)
        or unicodedata.category(c) in ("Mn", "Me", "Mc")
        or c in "‍️︎"
        or before == "‍"
        or "\U0001f3fb" <= c <= "\U0001f3ff"
        or (before == "\r" and c == "\n")
    )


def boundaries(text: str) -> dict[int, int]:
    """Offset to strength of every natural boundary of ``text``."""
    found: dict[int, int] = {}
    for strength, pattern in BOUNDARIES:
        for m in pattern.finditer(text):
            if strength > found.get(m.end(), 0):
                found[m.end()] = strength
    return found


def cut_points(text: str, limit: int, overlap: int) -> list[int]:
    """Offsets of the cuts, 0 and the length included; every span is at most ``limit - overlap`` long, the first ``limit``.

    The first span is at least ``overlap`` long, so that the piece after it can share as much; neither a cut nor the
    start of the overlap before it falls within a visible character, unless one is longer than the window.
    """
    n = len(text)
    if n <= limit:
        return [0, n]
    room, marks, cuts = limit - overlap, boundaries(text), []
    ordered = sorted(marks)
    good = lambda p: not _joined(text, p) and not _joined(text, p - overlap)
    stack = [(0, n)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= (room if lo else limit):
            continue
        least, most = lo + 1 if lo else max(1, overlap), hi - 1
        mid, reach = max(least, (lo + hi) // 2), max(1, int((hi - lo) * WINDOW))
        span = ordered[bisect_left(ordered, max(least, mid - reach)) : bisect_right(ordered, min(most, mid + reach))]
        at = max((p for p in span if good(p)), key=lambda p: (marks[p], -abs(p - mid), -p), default=None)
        if at is None:
            at = next((p for p in range(mid, max(least, mid - reach) - 1, -1) if good(p)), None)
        if at is None:
            at = next((p for p in range(mid, min(most, mid + reach) + 1) if good(p)), mid)
        cuts.append(at)
        stack += [(lo, at), (at, hi)]
    return [0, *sorted(cuts), n]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces: at most ``limit`` characters each, consecutive ones sharing ``overlap`` characters."""
    cuts = cut_points(text, limit, overlap)
    return [(max(0, a - overlap) if k else a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def split_items(df: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """Pieces of every text of ``df``: ``(key, piece_no, n_pieces, start, end, piece)``, numbered from 1.

    Sizes are code points. A text is bisected at the strongest boundary near its midpoint, the halves again while they
    exceed ``limit - overlap`` (the first piece ``limit``), and then every piece but the first is extended to the left by ``overlap`` characters.
    Defined cases: a NULL text has no pieces; an empty one has a single empty piece; a text without any boundary is cut
    in the middle, never inside a combining sequence; a NULL key is kept; repeated rows are cut each; other columns,
    whatever they are called, are not read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and smaller than limit")

    def make():
        def fn(cols):
            out = [[], [], [], [], [], []]
            for k, t in zip(*cols):
                pieces = split_text(t, limit, overlap)
                for i, (a, b) in enumerate(pieces, 1):
                    for col, v in zip(out, (k, i, len(pieces), a, b, t[a:b])):
                        col.append(v)
            return out

        return fn

    src = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    kind = df.schema[key].dataType.simpleString()
    return map_batches(src, make, f"`{key}` {kind}, piece_no int, n_pieces int, start int, end int, piece string")
