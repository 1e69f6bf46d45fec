"""Text cut off by field limits or broken transfers.

How a value ends is read from its tail; whether its last token is a word is looked up in the corpus vocabulary, held as
a trie: a table with one row for each prefix, so that it can be larger than any memory. A value is cut if its end is
open and its last token is an unknown proper prefix of known words or breaks off a sentence, or if its length is the
limit of its source.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import residue
from pagemill.llm.furniture import is_number_line, split_header
from pagemill.llm.rows import map_batches
from pagemill.plans.storage import broadcast_if_small, materialize

#: A length is a source's limit if at least so many of its values have it and none is longer.
LIMIT_VALUES = 5
#: So many different warnings that end at the same length were cut there.
LIMIT_SHAPES = 4
#: Occurrences that make a token a known word; prefixes of words at least so frequent count.
KNOWN, KNOWN_BELOW = 3, 3

#: A token that is so many times as often the beginning of longer words as a word is taken for a beginning.
BEGINS = 20

_END = re.compile(r"[.!?。！？…；;：:»”’\"'」』）)】\]〉》|>*`~]\s*$")
_ELLIPSIS = re.compile(r"(?:�|\[(?:\.{2,}|…)\]|\((?:\.{2,}|…)\)|\.{3,}|…+)\s*$")
_LETTERS = r"A-Za-zÀ-ɏͰ-ϿЀ-ӿ"
_LAST = re.compile(rf"[{_LETTERS}]+(?:[’'][{_LETTERS}]+)*$")
_TOKENS = re.compile(rf"[{_LETTERS}]+")
_CJK_END = re.compile(r"[一-鿿぀-ヿ]$")
_SPLIT = re.compile("[-‐\u00ad¬]\n")
_CLOSE, _CJK, _FIGURES = re.compile("[。！？]"), re.compile("[一-鿿぀-ヿ]"), re.compile(r"\d+")
_OPENING = re.compile(r"[。！？\n]\s*([^\s。！？#|<>*•-][^。！？\n]{23})")
_BLOB = re.compile(r"[A-Za-z0-9+/=_-]{60,}$")
_LIST = re.compile(r"\s*(?:[-*•+]|\d{1,3}[.)])\s+")
_OPEN_BRACKET = re.compile(r"[（(【\[「『《“«][^）)】\]」』》”»]*$")


def tail(text: str, page: int | None = None) -> tuple[str, str, str]:
    """``(state, token, line)``: how ``text`` ends.

    States: ``complete``; ``marker`` (an ellipsis, or half a character, stands for what is missing); ``table`` (a row or table left open);
    ``heading`` and ``open`` (no closing mark: the token decides); ``blob`` (an unbroken run of code); ``sentence`` and
    ``figure`` (no closing mark after a character of text without spaces, or after something else). The token is what
    is looked up: the last word, a heading's last two characters (``# ``), or how the open sentence begins (``^ ``).
    """
    body = text.rstrip()
    if not residue.MARKER.sub("", body).strip() or residue.OWN_RESULTS.search(body[-12:]):
        return "complete", "", ""
    line = body[body.rfind("\n") + 1 :]
    if is_number_line(line, page) or (split_header(line) or (None, -1))[1] == page:
        return "complete", "", line
    if re.match(r"<!--", line) and not line.endswith("-->"):
        return "table", "", line
    low = body.lower()
    if "<table" in low and low.rfind("<table") > low.rfind("</table>"):
        return "table", "", line
    if line.lstrip().startswith("|"):
        if not line.rstrip().endswith("|"):
            return "table", "", line
        first = body[: len(body) - len(line)].rstrip("\n").rsplit("\n", 1)[-1]
        if first.lstrip().startswith("|") and line.count("|") < first.count("|"):
            return "table", "", line
        return "complete", "", line
    if _ELLIPSIS.search(line):
        return "marker", "", line
    if line.startswith("#"):
        m = _LAST.search(line)
        return ("heading", m.group().lower() if m else "# " + line[-2:], line)
    if _END.search(line) and not _OPEN_BRACKET.search(line[-60:-1] if line[-1] in "）)】]」』》”»" else line[-60:]):
        return "complete", "", line
    if _BLOB.search(line):
        return "blob", "", line
    if m := _LAST.search(line):
        return "open", m.group().lower(), line
    last = _CLOSE.split(line)[-1]
    return ("sentence" if _CJK_END.search(line) else "figure"), (opening(last) if _CJK.search(last) else ""), line


def opening(fragment: str) -> str:
    """How Chinese or Japanese text that nothing closes begins: its first three characters, figures as one 0; '' if it is shorter."""
    s = _FIGURES.sub("0", fragment[:24].lstrip())[:3]
    return "^ " + s if len(s) == 3 else ""


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``word, n`` over all texts, a text's last token left out; headings' last two characters come as ``# `` + them, and
    the openings of sentences without spaces as ``^ `` + them.

    Counted within each batch, then summed: a batch sends each word once.
    """

    def make():
        def fn(cols):
            count: Counter = Counter()
            for t in cols[0]:
                if not t:
                    continue
                words = _TOKENS.findall(_SPLIT.sub("", t))
                if words and t.rstrip().endswith(words[-1]):
                    words.pop()
                count.update(words)
                if _CJK.search(t):
                    count.update([opening(x) for x in _OPENING.findall(t)])
                for line in t.split("\n")[:-1]:
                    if line.startswith("#") and len(line) > 3:
                        count["# " + line[-2:]] += 1
            low: Counter = Counter()
            for w, n in count.items():
                low[w.lower()] += n
            low.pop("", None)
            return [list(low), list(low.values())]

        return fn

    return map_batches(df.select(text), make, "word string, n bigint", rows=None).groupBy("word").agg(F.sum("n").alias("n"))


def trie(words: DataFrame, least: int, asked: DataFrame | None = None) -> DataFrame:
    """The trie of ``words`` (read twice) as a table: ``prefix, below, here``: occurrences of longer words with the prefix, and of itself as a word.

    With ``asked`` (``prefix``, distinct) only those nodes are made: other prefixes are dropped before they are exchanged.
    """
    usable = words.where(F.col("n") >= least)
    inner = usable.where(F.length("word") > 1).select(F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"), "word", "n").select(F.substring("word", F.lit(1), F.col("k")).alias("prefix"), F.col("n").alias("below"), F.lit(0).cast("bigint").alias("here"))
    leaves = words.select(F.col("word").alias("prefix"), F.lit(0).cast("bigint").alias("below"), F.col("n").alias("here"))
    nodes = inner.unionByName(leaves)
    if asked is not None:
        nodes = nodes.join(broadcast_if_small(asked), "prefix", "left_semi")
    return nodes.groupBy("prefix").agg(F.sum("below").alias("below"), F.sum("here").alias("here"))


#: Prefixes of warnings are told apart by a rolling hash modulo this prime, with this base.
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def prefix_hashes(text: str) -> list[int]:
    """A hash of every non-empty prefix of ``text``, in one pass."""
    out, h = [], 0
    for c in text:
        h = (h * _BASE + ord(c) + 1) % _PRIME
        out.append(h)
    return out


def shape_trie(shapes: DataFrame) -> DataFrame:
    """``shape, below``: of every string in ``shapes`` (``shape, n``, distinct, materialised) the occurrences of longer ones it is a prefix of.

    A string sends one number for each of its prefixes, so the work is linear in its length; only those that are
    strings themselves are exchanged further.
    """

    def make(whole: bool):
        def start():
            def fn(cols):
                out: list[list] = [[], []]
                for s, n in zip(*cols):
                    h = prefix_hashes(s)
                    got = [(h[-1], s)] if whole else [(x, n) for x in h[:-1]]
                    for x, v in got:
                        out[0].append(x)
                        out[1].append(v)
                return out

            return fn

        return start

    own = materialize(map_batches(shapes.where(F.length("shape") > 0).select("shape", "n"), make(True), "h bigint, shape string"))
    longer = map_batches(shapes.select("shape", "n").where(F.length("shape") > 0), make(False), "h bigint, n bigint")
    below = longer.join(broadcast_if_small(own.select("h")), "h", "left_semi").groupBy("h").agg(F.sum("n").alias("below"))
    return own.join(below, "h", "left").select("shape", F.coalesce("below", F.lit(0)).alias("below"))


def tails(df: DataFrame, key: str, source: str, text: str, page: str) -> DataFrame:
    """``key, source, size, bytes, state, token, prose`` of every non-NULL text; residue (problem 4) whose end is open is ``complete``."""

    def make():
        def fn(cols):
            out = [[], [], [], [], [], [], []]
            for k, s, t, p in zip(*cols):
                state, token, line = tail(t, p)
                if state != "complete" and state != "blob" and residue.classify(t)[0]:
                    state = "residue"
                prose = len(_LIST.sub("", line)) >= 30 or _LIST.match(line) is not None or len(re.findall(r"\w+", line)) > 3
                for col, v in zip(out, (k, s, len(t), len(t.rstrip("�").encode()), state, token, prose)):
                    col.append(v)
            return out

        return fn

    src = df.select(F.col(key).alias("k"), F.col(source).alias("s"), F.col(text).alias("t"), F.col(page).alias("p")).where(F.col("t").isNotNull())
    return map_batches(src, make, f"`{key}` {df.schema[key].dataType.simpleString()}, source string, size int, bytes int, state string, token string, prose boolean")


def _limit(ends: DataFrame, unit: str) -> DataFrame:
    """``source, <unit>_limit`` of the sources whose greatest length is shared by ``LIMIT_VALUES`` texts, half of them with an open end.

    A limit in bytes may leave up to three bytes unused, where a character would not have fitted; half a character at
    the end (U+FFFD) does not count.
    """
    sizes = ends.where("source is not null").groupBy("source", F.col(unit).alias("n")).agg(F.count_distinct("page_id").alias("values"), F.avg((F.col("state") != "complete").cast("int")).alias("open"))
    top = sizes.groupBy("source").agg(F.max("n").alias(f"{unit}_limit"))
    near = F.col("n") == F.col(f"{unit}_limit") if unit == "size" else F.col("n") >= F.col(f"{unit}_limit") - 3
    return materialize(sizes.join(top, "source").where(near).groupBy("source", f"{unit}_limit").agg(F.sum("values").alias("values"), (F.sum(F.col("values") * F.col("open")) / F.sum("values")).alias("open")).where((F.col("values") >= LIMIT_VALUES) & (F.col("open") >= 0.5)).select("source", f"{unit}_limit"))


def cut_texts(pages: DataFrame) -> DataFrame:
    """``page_id, source, reason`` of the ``markdown`` values that were cut before their end.

    Reasons: ``limit`` (the source's field limit in characters or bytes: at least ``LIMIT_VALUES`` values of that length, none longer),
    ``marker``, ``table``, ``word`` (last token an unknown proper prefix of known words), ``sentence`` (prose without an
    end). Defined cases: NULL, empty and blank texts, complete headings, list items, tables and page numbers, and pages
    of problem 4 are not cut; rows without a source have no limit evidence; repeated rows count once for a limit.
    """
    ends = materialize(tails(pages, "page_id", "source", "markdown", "page_number"))
    limits = [_limit(ends, unit) for unit in ("size", "bytes")]
    asked = ends.where("state not in ('complete', 'residue') and token <> ''").select(F.col("token").alias("prefix")).distinct()
    known = trie(materialize(word_counts(pages, "markdown")), KNOWN_BELOW, asked)
    heads = F.col("state") == "heading"
    latin_token = F.col("token").rlike(rf"^[{_LETTERS}’']+$")
    look = ends.join(broadcast_if_small(limits[0]), "source", "left").join(broadcast_if_small(limits[1]), "source", "left").withColumn("prefix", F.col("token")).join(known, "prefix", "left")
    unknown = F.coalesce("here", F.lit(0)) < KNOWN
    partial = unknown & (F.coalesce("below", F.lit(0)) >= KNOWN_BELOW)
    reason = (
        F.when((F.col("size") == F.col("size_limit")) | ((F.col("bytes") >= F.col("bytes_limit") - 3) & ~F.col("state").isin("complete", "blob")) | ((F.col("bytes") == F.col("bytes_limit")) & (F.col("state") == "blob")), F.when(F.col("state") != "residue", "limit"))
        .when(F.col("state").isin("marker", "table"), F.col("state"))
        .when((F.col("state") == "open") & (partial | (F.coalesce("below", F.lit(0)) >= BEGINS * F.greatest("here", F.lit(1)))), "word")
        .when(F.col("state").isin("open", "sentence", "figure") & F.col("prose"), "sentence")
        .when(F.col("state").isin("sentence", "figure") & F.startswith("token", F.lit("^ ")) & ~unknown, "sentence")
        .when(heads & latin_token & partial, "word")
        .when(heads & ~latin_token & unknown, "sentence")
    )
    return look.withColumn("reason", reason).where("reason is not null").select("page_id", "source", "reason")


def cut_warnings(records: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """``page_id, warning, reason`` of the warnings that were cut short.

    Warnings are compared with their figures replaced, as strings of a trie. Reasons: ``limit`` (as long as the longest
    warning of its source, which ``LIMIT_VALUES`` records reach, in as many shapes as ``LIMIT_SHAPES`` or half of them
    plainly cut: mid-word, or the beginning of longer ones and found in no other source); ``prefix`` (a proper prefix of at least half as many other warnings, those at their source's limit not
    counted as whole); ``word`` (ends in an unknown proper prefix of a word used in warnings); ``marker`` (ends in an
    ellipsis). One that other sources have too, and nothing continues, is whole at any length. ``owners`` (``doc_id, source``, one row a document) tells the source of ``records``' ``doc_id``; without it,
    or for a document without one, there is no length evidence. NULL and empty warnings are not cut.
    """
    said = records.select("page_id", *(["doc_id"] if owners is not None else []), F.explode("warnings").alias("warning")).where(F.length("warning") > 0).distinct()
    said = said.join(owners.select("doc_id", "source"), "doc_id", "left").drop("doc_id") if owners is not None else said.withColumn("source", F.lit(None).cast("string"))
    each = materialize(said.withColumn("shape", F.regexp_replace(F.regexp_replace("warning", r"\d+", "9"), r"\s+$", "")).withColumns({"token": F.lower(F.regexp_extract("shape", rf"([{_LETTERS}]+)$", 1)), "size": F.length("warning")}))
    shapes = materialize(each.groupBy("shape").agg(F.count("*").alias("n")))
    nodes = shape_trie(shapes)
    words = shapes.select(F.explode(F.regexp_extract_all(F.lower(F.regexp_replace("shape", rf"[{_LETTERS}]+$", "")), F.lit(rf"([{_LETTERS}]+)"), F.lit(1))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    asked = each.where("token <> ''").select(F.col("token").alias("prefix")).distinct()
    tokens = trie(words, KNOWN_BELOW, asked).select(F.col("prefix").alias("token"), F.col("below").alias("t_below"), F.col("here").alias("t_here"))
    look = each.join(nodes, "shape", "left").join(tokens, "token", "left")
    half_word = (F.length("token") > 0) & (F.coalesce("t_here", F.lit(0)) == 0) & (F.col("t_below") >= KNOWN_BELOW)
    marked = F.col("shape").rlike(r"(\.{3}|…|\[\.\.\.\]|�)$")
    look = materialize(look.withColumns({"below": F.coalesce("below", F.lit(0)), "half": half_word, "marked": marked}))
    own = materialize(look.where("source is not null").groupBy("source", "shape").agg(F.count("*").alias("n_own")).join(shapes, "shape").select("source", "shape", (F.col("n") > F.col("n_own")).alias("elsewhere")))
    # a form that other sources have as well is whole, whatever begins with it
    by_size = look.join(own, ["source", "shape"]).groupBy("source", "size").agg(F.count_distinct("page_id").alias("values"), F.count_distinct("shape").alias("kinds"), F.avg((F.col("half") | F.col("marked") | (F.col("below") > 0) & ~F.col("elsewhere")).cast("int")).alias("open"))
    top = by_size.groupBy("source").agg(F.max_by(F.struct("values", "kinds", "open"), "size").alias("t"), F.max("size").alias("size_limit"))
    limits = materialize(top.where((F.col("t.values") >= LIMIT_VALUES) & ((F.col("t.kinds") >= LIMIT_SHAPES) | (F.col("t.open") >= 0.5))).select("source", "size_limit"))
    whole = (F.col("below") == 0) & F.coalesce("elsewhere", F.lit(True))
    look = look.join(broadcast_if_small(limits), "source", "left").join(broadcast_if_small(own), ["source", "shape"], "left").withColumn("at_limit", F.coalesce((F.col("size") == F.col("size_limit")) & ~whole, F.lit(False)))
    here = look.where("not at_limit").groupBy("shape").agg(F.count("*").alias("here"))
    look = look.join(here, "shape", "left")
    prefix = (F.col("below") > 0) & (F.col("below") * 2 >= F.coalesce("here", F.lit(0)))
    reason = F.when(F.col("at_limit"), "limit").when(prefix, "prefix").when(F.col("half"), "word").when(F.col("marked"), "marker")
    return look.withColumn("reason", reason).where("reason is not null").select("page_id", "warning", "reason")


def share_by_source(keys: DataFrame, cut: DataFrame) -> DataFrame:
    """Per source the number of records, of cut ones and their share: ``source, records, cut, share``.

    ``keys`` has ``page_id`` and ``source`` of the records in question, ``cut`` the ``page_id`` of the cut ones; both are
    made distinct. A NULL source is a group of its own.
    """
    flagged = keys.distinct().join(cut.select("page_id").distinct().withColumn("hit", F.lit(1)), "page_id", "left")
    return flagged.groupBy("source").agg(F.count("*").alias("records"), F.count("hit").alias("cut"), F.round(F.count("hit") / F.count("*"), 6).alias("share"))
