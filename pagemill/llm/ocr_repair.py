"""Repairing text read from scanned pages.

Words of the whole corpus are counted. For every rare word all frequent words within Levenshtein distance 2 are
retrieved by intersecting its Levenshtein automaton with a trie of the vocabulary; a pair stays if what differs is a
confusion the corpus itself shows again and again (or a classic one). Chinese and Japanese text has no words: there a
character is compared with the one that usually stands between its two neighbours. Page furniture is taken out and words
split over line ends are joined; then each page asks for the corrections of what it holds, candidates are ranked by the
words beside them and on their page, and lines are reflowed.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pagemill.llm.furniture import form, header_form, is_header_line, is_number_line, split_header
from pagemill.llm.rows import map_batches
from pagemill.plans.storage import broadcast_if_small, materialize

#: A word or context is suspicious if a confusable one is at least so many times as frequent, and has so many occurrences.
RATIO, LEAST = 20, 12
#: Different words (or contexts) in which a confusion must be seen before it is believed.
SUPPORT = 3
#: Greatest Levenshtein distance of a candidate, and least length of a word that is corrected.
DISTANCE, SHORTEST = 2, 4
#: Pages of a report on which a text must stand beside the page's own number to be its running header.
HEADER_PAGES = 2
#: Longest line that may be furniture.
LINE = 160
#: Bits of the sieve that tells which units may have a correction: so many for each, at most (8 MB), and how many each sets.
SIEVE_BITS, SIEVE_MOST, SIEVE_PLACES = 64, 1 << 26, 4
#: Words that ask, and words of the vocabulary, that one task takes of a pigeonhole key.
ASKING, VOCABULARY = 50_000, 50_000
#: Nats by which a candidate gains if it stands on the page, and loses for a second misreading.
HERE, AGAIN = 2.0, 3.0

#: Confusions known of any recogniser, read to meant; fixed values.
CLASSIC = (
    ("rn", "m"), ("m", "rn"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("h", "li"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("@", "a"), ("9", "g"), ("6", "b"), ("8", "b"),
)

_L = "A-Za-zÀ-ɏЀ-ӿ"
#: A letter and what follows it of letters and marks read for letters, or such a mark before three letters. As in ``_NOISE``, all characters it may begin with come first, so that texts are scanned for these alone.
_WORD = re.compile(rf"[{_L}0-9@|!$](?:(?<=[{_L}])[{_L}0-9@|!$]*|(?<=[0-9@|!$])(?<![0-9{_L}.,].)[{_L}]{{3,}})")
_COMPOUND = re.compile(rf"(?<![-{_L}])[{_L}]{{2,}}-[{_L}]{{2,}}(?![-{_L}])")
#: A word split by a hyphen mark over a line end; paragraph breaks may stand between in Markdown.
_SPLIT = re.compile(rf"(?<![{_L}-])([{_L}]{{1,}})([-‐­¬⁃])[ \t]*\n+[ \t]*([a-zß-öø-ÿа-яё][{_L}]*|(?<=[A-ZÀ-ÞА-Я][-‐­¬⁃]\n)[A-ZÀ-ÞА-Я]{{2,}})")
_WIDE = re.compile(r"[一-鿿぀-ヿ]")
#: By code point, whether a character is a figure of any script.
_DIGIT = np.array([chr(i).isdecimal() for i in range(0x110000)])
#: Traces of a wrong encoding; the tokens that hold them teach no confusions and are not searched for them.
_NOISE = re.compile("[\x80-\x9f�ÃÂĂĹ√Γ├┬╨╤âÄ‚Г](?:(?<=[\x80-\x9f�])|(?<=[ÃÂĂĹ√Γ├┬╨╤])[^\x00-\x7f]|(?<=[âÄ‚Г])[\x80-\x9f€™…†‡ƒÄÇÖæ∂╗║╝░▒▓⌐½¼\xa0-¿])")
#: A number with look-alike letters in it: figures on one side, letters that look like figures on the other.
_FIGURE = re.compile(r"(?<![A-Za-z0-9+/=_@#.-])(?:[A-Z]-)?(?=[0-9OoIlSZBbgq|.,]*[0-9])(?=[0-9.,]*[OoIlSZBbgq|])[0-9OoIlSZBbgq|]{2,}(?:[.,][0-9OoIlSZBbgq|]+)*(?![A-Za-z0-9+/=_])|(?<![A-Za-z0-9+/=_@#.-])[0-9]{1,3}(?:,[0-9OoIlSZBbgq|]{3})*[.,][0-9OoIlSZBbgq|]*[OoIlSZBbgq|][0-9OoIlSZBbgq|]*(?![A-Za-z0-9+/=_])|(?<=[^\x00-\x7f])[OolISZBb](?=[0-9][0-9OoIlSZBbgq|.,]*(?![A-Za-z0-9+/=_])|[年月日%])")
_LIKE = str.maketrans("OoIlSZBbgq|", "00115286991")
#: What every such number holds, and what every split word does.
_NEAR_FIGURE, _MAY_SPLIT = re.compile(r"[0-9][.,]?[OoIlSZBbgq|]|[OoIlSZBbgq|][.,]?[0-9年月日%]"), re.compile("[-‐\u00ad¬⁃][ \t]*\n")
#: Letters that stand so only in wrongly decoded text.
_ODD_CASE = re.compile("[a-zß-ÿ][À-Þ]|[À-Þ]{2}[a-zß-ÿ]|[\x80-ɏ]{3}|[а-яё][А-ЯЁ]|[ЂЃѓЉЊЌЎўЏђљњќћџҐґЄєЇїІіЈјЅѕ]")
_MARK = re.compile(r"<!--.*?-->")
_STRUCTURE = re.compile(r"\s*(?:#{1,6}\s|[-*•+]\s|\||<|```|\d{1,3}[.)]\s|>)")
_CLOSED = re.compile(r"[.!?。！？:：;；”’»\")）」』…]\s*$")
#: A gap as between columns, in a line without blanks around; how a list item begins.
_GAP, _ITEM = re.compile(r"\s(?:\s|(?<=\t))"), re.compile(r"[-*•+]\s|\d{1,3}[.)]\s")
_BLOB = re.compile(r"[A-Za-z0-9+/=]{60,}")


def noisy_spans(text: str) -> list[tuple[int, int]]:
    """Tokens with traces of a wrong encoding; Chinese text, which has no blanks, is left at its first sound character."""
    if text.isascii():
        return []
    out: list[tuple[int, int]] = []
    for m in _NOISE.finditer(text):
        a, b = m.span()
        if out and a < out[-1][1]:
            continue
        while a and not text[a - 1].isspace() and not _WIDE.match(text[a - 1]):
            a -= 1
        while b < len(text) and not text[b].isspace() and not _WIDE.match(text[b]):
            b += 1
        out.append((a, b))
    return out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], "�"]
        at = b
    return "".join(out) + text[at:] if spans else text


def _plain(text: str) -> str:
    """What is counted of a text: no markers, no code, split words joined."""
    text = _BLOB.sub(" ", _MARK.sub(" ", text)) if "<!--" in text or "/" in text or "+" in text else text
    return _SPLIT.sub(lambda m: m.group(1) + m.group(3), text) if _MAY_SPLIT.search(text) else text


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Han characters between their neighbours (a run of figures as one 0) over some texts, as codes of 21 bits a character, and how often each is seen."""
    a = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    digit = _DIGIT[a]
    a = np.where(digit, 0x30, a)[~(digit & np.append(False, digit[:-1]))]
    l, m, r = a[:-2], a[1:-1], a[2:]
    keep = (m >= 0x4E00) & (m <= 0x9FFF) & (l > 0) & (r > 0) & (l != 0xFFFD) & (r != 0xFFFD)
    return np.unique((l[keep] << 42) | (m[keep] << 21) | r[keep], return_counts=True)


def unit_counts(texts: DataFrame) -> DataFrame:
    """``kind, unit, n`` over all texts (``doc_id, page_number, text``), summed within each batch first.

    Kinds: ``w`` words in lower case; ``h`` hyphenated compounds within a line; ``s`` compounds that a line end would
    break at their hyphen; ``c`` a Han character between its neighbours (figures as 0); ``f`` the form of a text beside
    the page's own number, with its document and page.
    """

    def make():
        def fn(cols):
            words, compounds, splits, forms = Counter(), Counter(), Counter(), set()
            codes, counts, wide = [], [], []

            def flush():
                if wide:
                    for x, y in zip((codes, counts), _trigrams(wide)):
                        x.append(y)
                    wide.clear()

            for doc, page, t in zip(*cols):
                if doc is not None and page is not None:
                    forms.update((doc, page, f) for l in t.split("\n") if 0 < len(l) <= LINE and _may_be_furniture(l) and (f := header_form(l, page)))
                t = _without(t, noisy_spans(t))
                for m in _SPLIT.finditer(t) if "-\n" in t else ():
                    if m.group(2) == "-":
                        splits[f"{m.group(1)}-{m.group(3)}".lower()] += 1
                p = _plain(t)
                if "-" in p:
                    compounds.update(_COMPOUND.findall(p))
                found = _WORD.findall(p)
                if found and p.rstrip().endswith(found[-1]):
                    found.pop()  # it may be cut off
                words.update(found)
                if not p.isascii() and _WIDE.search(p):
                    wide.append(p)
                    if len(wide) == 500:
                        flush()
            flush()
            low: Counter = Counter()
            for w, n in words.items():
                low[w.lower()] += n
            out = [("w", w, n) for w, n in low.items() if len(w) >= SHORTEST]
            low = Counter()
            for w, n in compounds.items():
                low[w.lower()] += n
            out += [("h", w, n) for w, n in low.items()] + [("s", w, n) for w, n in splits.items()]
            out += [("f", f"{d}\x1f{f}\x1f{p}", 1) for d, p, f in forms]
            if codes:
                units, at = np.unique(np.concatenate(codes), return_inverse=True)
                n = np.bincount(at, np.concatenate(counts)).astype(np.int64)
                out += [("c", chr(u >> 42) + chr(u >> 21 & 0x1FFFFF) + chr(u & 0x1FFFFF), k) for u, k in zip(units.tolist(), n.tolist()) if not (0xD800 <= u >> 42 <= 0xDFFF or 0xD800 <= (u & 0x1FFFFF) <= 0xDFFF)]
            return [[x[0] for x in out], [x[1] for x in out], [x[2] for x in out]]

        return fn

    return map_batches(texts.select("doc_id", "page_number", "text"), make, "kind string, unit string, n bigint", rows=None).groupBy("kind", "unit").agg(F.sum("n").alias("n"))


# Candidate retrieval ------------------------------------------------------------------------------------------------


def build_trie(words) -> dict:
    """Nested dictionaries by character; the empty string holds the word that ends at a node."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


def intersect(trie: dict, word: str, k: int = DISTANCE) -> list[str]:
    """All words of ``trie`` within Levenshtein distance ``k`` of ``word``.

    The automaton of ``word`` is run along the trie: for each number of errors a bit vector of the positions it may be in.
    A branch is left as soon as no state is alive.
    """
    n = len(word)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(word):
        masks[c] |= 1 << i
    final, found = 1 << n, []
    start = tuple((1 << (e + 1)) - 1 for e in range(k + 1))
    stack = [(trie, start)]
    while stack:
        node, state = stack.pop()
        for c, child in node.items():
            if not c:
                if state[k] & final:
                    found.append(child)
                continue
            m, new = masks.get(c, 0), []
            for e, r in enumerate(state):
                s = (r & m) << 1
                if e:
                    s |= state[e - 1] | (state[e - 1] << 1) | (new[e - 1] << 1)
                new.append(s & ((final << 1) - 1))
            if new[k]:
                stack.append((child, tuple(new)))
    return found


def operations(read: str, meant: str) -> list[tuple[str, str]] | None:
    """What was misread to turn ``meant`` into ``read``, as pairs of at most two characters; None if it isn't that simple.

    Accents alone, letters only added or only lost are no misreadings.
    """
    if len(read) == len(meant):
        out = [(a, b) for a, b in zip(read, meant) if a != b]
        if 0 < len(out) <= 2 and not any(_base(a) == _base(b) for a, b in out):
            return out
    i = 0
    while i < min(len(read), len(meant)) and read[i] == meant[i]:
        i += 1
    j = 0
    while j < min(len(read), len(meant)) - i and read[-1 - j] == meant[-1 - j]:
        j += 1
    a, b = read[i : len(read) - j], meant[i : len(meant) - j]
    # a merged or split letter may share one of its halves with its neighbour
    if (not a or not b) and i and len(a) + len(b) == 1:
        a, b = read[i - 1] + a, meant[i - 1] + b
    if not a or not b or len(a) > 2 or len(b) > 2 or _base(a) == _base(b) or len(a) == len(b):
        return None
    if a in b or b in a:
        return None
    return [(a, b)]


def _base(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def keys_of(word: str, known: bool) -> list[str]:
    """Pigeonhole keys, each with the length of the misread form.

    Two letters misread for two others leave one of three pieces unharmed. A misreading that changes the length leaves
    the first half, the second half, or what follows the middle; a known word gives these for the lengths beside its own.
    So every pair that ``operations`` explains meets.
    """
    n = len(word)
    out = {f"{n}{i}{word[i * n // 3 : (i + 1) * n // 3]}" for i in range(3)}
    for n in (len(word) - 1, len(word) + 1) if known else (len(word),):
        h = n // 2
        out |= {f"{n}p{word[:h]}", f"{n}s{word[len(word) - (n - h) :]}", f"{n}s{word[len(word) - (n - h - 1) :]}"}
    return sorted(out)


def candidates(words: DataFrame) -> DataFrame:
    """``read, meant, n_read, n_meant, ops``: for each word the words ``RATIO`` times as frequent that explain it.

    Both sides are brought together by pigeonhole keys, sorted, and streamed: of a key first the vocabulary, as a trie,
    then the words that ask. A key with more than ``ASKING`` words that ask, or ``VOCABULARY`` that may answer, is cut
    into parts, every part of the one meeting every part of the other; nothing is broadcast but which keys those are.
    """

    def make_keys():
        def fn(cols):
            out = [[], [], [], []]
            for w, n in zip(*cols):
                plain = w.isalpha()
                if plain and n >= LEAST:
                    for k in keys_of(w, True):
                        for c, v in zip(out, (k, 0, w, n)):
                            c.append(v)
                for k in keys_of(w, False):
                    for c, v in zip(out, (k, 1, w, n)):
                        c.append(v)
            return out

        return fn

    keyed = materialize(map_batches(words.select("unit", "n"), make_keys, "key string, side int, word string, n bigint"))

    def make_pairs():
        state: dict = {"key": None, "trie": {}, "n": {}}

        def fn(cols):
            out: list[list] = [[], [], [], [], []]
            for *key, side, w, n in zip(*cols):
                if key != state["key"]:
                    state.update(key=key, trie={}, n={})
                if side == 0:
                    node = state["trie"]
                    for c in w:
                        node = node.setdefault(c, {})
                    node[""] = w
                    state["n"][w] = n
                elif state["n"]:
                    for v in intersect(state["trie"], w):
                        m = state["n"][v]
                        if v != w and m >= RATIO * n and (ops := operations(w, v)):
                            for c, x in zip(out, (w, v, n, m, ["\t".join(o) for o in ops])):
                                c.append(x)
            return out

        return fn

    # only keys with a frequent word and a word that asks matter
    load = materialize(keyed.groupBy("key").agg(F.count_if(F.col("side") == 1).alias("asking"), F.count_if(F.col("side") == 0).alias("known")).where("known > 0"))
    parts = load.where((F.col("asking") > ASKING) | (F.col("known") > VOCABULARY)).select("key", F.ceil(F.col("asking") / ASKING).cast("int").alias("a"), F.ceil(F.col("known") / VOCABULARY).cast("int").alias("v"))
    cut = keyed.join(load.select("key"), "key", "left_semi").join(broadcast_if_small(parts), "key", "left").withColumns({"a": F.greatest(F.coalesce("a", F.lit(1)), F.lit(1)), "v": F.greatest(F.coalesce("v", F.lit(1)), F.lit(1)), "h": F.xxhash64("word")})
    asks = F.col("side") == 1
    own = F.pmod("h", F.when(asks, F.col("a")).otherwise(F.col("v"))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.when(asks, F.col("v")).otherwise(F.col("a")) - 1))
    spread = cut.select("key", "side", "word", "n", own.alias("own"), every.alias("other"))
    streamed = spread.select("key", F.when(asks, F.col("own")).otherwise(F.col("other")).alias("a"), F.when(asks, F.col("other")).otherwise(F.col("own")).alias("v"), "side", "word", "n").repartition("key", "a", "v").sortWithinPartitions("key", "a", "v", "side")
    return map_batches(streamed, make_pairs, "read string, meant string, n_read bigint, n_meant bigint, ops array<string>").dropDuplicates(["read", "meant"])


def word_fixes(words: DataFrame) -> DataFrame:
    """``kind, read, meant``: accepted corrections: of each word its candidates with a weight, the log of how often they are seen, less for two misreadings.

    A candidate that is itself taken for a misreading stands back where another one is not.
    """
    pairs = materialize(candidates(words))
    seen = pairs.where("size(ops) = 1").select("read", F.explode("ops").alias("op")).groupBy("op").agg(F.count_distinct("read").alias("support")).where(F.col("support") >= SUPPORT)
    classic = pairs.sparkSession.createDataFrame([("\t".join(c),) for c in CLASSIC], "op string")
    believed = F.broadcast(seen.select("op").unionByName(classic).distinct())  # at most pairs of two characters each
    each = pairs.select("read", "meant", "n_meant", F.size("ops").alias("k"), F.explode("ops").alias("op"))
    good = each.join(believed, "op").groupBy("read", "meant", "n_meant", "k").agg(F.count("*").alias("hits")).where(F.col("hits") >= F.col("k"))
    wrong = good.select(F.col("read").alias("meant")).distinct().withColumn("wrong", F.lit(True))
    weight = F.log(F.col("n_meant").cast("double")) - AGAIN * (F.col("k") - 1)
    ranked = good.join(wrong, "meant", "left").groupBy("read").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("wrong", F.lit(False)).alias("wrong"), (-weight).alias("w"), "meant", F.col("n_meant").alias("n")))).alias("c"))
    sound = F.filter("c", lambda s: ~s["wrong"])
    best = F.when(F.size(sound) > 0, sound).otherwise(F.col("c"))
    return ranked.select(F.lit("w").alias("kind"), "read", F.transform(best, lambda s: F.struct(s["meant"].alias("meant"), (-s["w"]).alias("weight"), s["n"].alias("n"))).alias("meant"))


def _one(meant: Column) -> Column:
    return F.array(F.struct(meant.alias("meant"), F.lit(0.0).alias("weight"), F.lit(1).cast("bigint").alias("n")))


def character_fixes(chars: DataFrame) -> DataFrame:
    """``read, meant`` for characters in context: ``read`` is the character with its neighbours.

    Between two neighbours one character usually stands; another there, ``RATIO`` times rarer, is a misreading unless it
    is at home beside one of the two neighbours elsewhere, and if the same confusion is seen ``LEAST`` times between
    ``SUPPORT`` different neighbours (or, three times as often, between one pair fewer) and explains at least half of
    that character's odd occurrences: the glyphs of a broken font stand for many characters and are left alone.
    """
    c = chars.select(F.substring("unit", 1, 1).alias("l"), F.substring("unit", 2, 1).alias("y"), F.substring("unit", 3, 1).alias("r"), "unit", "n")
    # between two figures, or beside letters, nearly any character may stand
    c = c.where(~(F.col("l").isin("0") & F.col("r").isin("0")) & ~F.col("l").rlike("[A-Za-z]") & ~F.col("r").rlike("[A-Za-z]"))
    top = c.groupBy("l", "r").agg(F.max_by("y", "n").alias("x"), F.max("n").alias("top"))
    each = materialize(c.join(top, ["l", "r"]))
    rare = (F.col("top") >= LEAST) & (F.col("y") != F.col("x")) & (F.col("n") * RATIO <= F.col("top"))
    each = each.withColumn("odd", F.coalesce(rare, F.lit(False)))
    at_home = F.sum(F.when(F.col("odd"), -F.col("n")).otherwise(F.col("n"))) > 0
    right = each.groupBy("y", "r").agg(at_home.alias("h")).where("h")
    left = each.groupBy("l", "y").agg(at_home.alias("h")).where("h")
    odd = each.where("odd").join(right, ["y", "r"], "left_anti").join(left, ["l", "y"], "left_anti").select("unit", "y", "x", "n")
    pair = odd.groupBy("y", "x").agg(F.count("*").alias("support"), F.sum("n").alias("n"))
    of_y = pair.groupBy("y").agg(F.sum("n").alias("all"))
    seen = (F.col("support") >= SUPPORT) & (F.col("n") >= LEAST) | (F.col("support") >= SUPPORT - 1) & (F.col("n") >= 3 * LEAST)
    ok = pair.join(of_y, "y").where(seen & (F.col("n") * 2 >= F.col("all")))
    return odd.join(ok.select("y", "x"), ["y", "x"]).select(F.lit("c").alias("kind"), F.col("unit").alias("read"), _one(F.col("x")).alias("meant"))


def compound_splits(units: DataFrame) -> DataFrame:
    """Hyphenated compounds that stand split at their hyphen: no words split by a hyphen mark."""
    known = units.where(f"kind = 'h' and n >= {SUPPORT}").select("unit")
    return units.where("kind = 's'").join(known, "unit", "left_semi").select(F.lit("h").alias("kind"), F.col("unit").alias("read"), _one(F.lit("")).alias("meant"))


# A page --------------------------------------------------------------------------------------------------------------


def _may_be_furniture(line: str) -> bool:
    return line[-1].isdigit() or line[-1] in "]）)】页頁-–—·•* \t" or line[:1].isdigit()


class Sieve:
    """Which units may have a correction: every one that has passes, and the more bits there are the fewer others do."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size
        self.seen: dict[str, bool] = {}

    def __getstate__(self):
        return {"bits": self.bits, "size": self.size, "seen": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def __call__(self, unit: str) -> bool:
        hit = self.seen.get(unit)
        if hit is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            hit = self.seen[unit] = all(int(self.bits[at >> 6]) >> (at & 63) & 1 for at in places(unit, self.size))
        return hit


def places(unit: str, size: int) -> list[int]:
    """Bits that a unit sets in a sieve."""
    h = xxh64_intdigest(unit.encode("utf-8", "surrogatepass"))
    return [((h & 0xFFFFFFFF) + i * (h >> 32)) % size for i in range(SIEVE_PLACES)]


def sieve(units: DataFrame, unit: str) -> Sieve:
    """The sieve of the strings in ``unit``: set bits are gathered by word, so at most ``SIEVE_MOST / 64`` rows reach the driver."""
    n = units.count()
    size = min(SIEVE_MOST, 1 << max(10, (SIEVE_BITS * n).bit_length()))

    def make():
        def fn(cols):
            words: dict[int, int] = defaultdict(int)
            for u in cols[0]:
                for at in places(u, size):
                    words[at >> 6] |= 1 << (at & 63)
            return [list(words), [w - (1 << 64) if w >> 63 else w for w in words.values()]]

        return fn

    bits = np.zeros(size >> 6, np.uint64)
    for r in map_batches(units.select(unit), make, "word bigint, bits bigint", rows=None).groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        bits[r.word] = np.uint64(r.bits & 0xFFFFFFFFFFFFFFFF)
    return Sieve(bits, size)


def split_words(text: str, spans: list[tuple[int, int]], compound=lambda unit: False) -> tuple[str, int]:
    """Words split over a line end joined, but for those ``compound`` holds to be split at their own hyphen; the rest of the second line moves up with its word."""
    if not _MAY_SPLIT.search(text):
        return text, 0
    n = 0

    def join(m):
        nonlocal n
        a, mark, b = m.groups()
        if mark == "-" and compound(f"{a}-{b}".lower()):
            return m.group()
        if mark in "\u00ad¬" and (_ODD_CASE.search(a + b) or any(x < m.end() and m.start() < y for x, y in spans)):
            return m.group()  # a stray byte of a wrong encoding
        n += 1
        return a + b

    return _SPLIT.sub(join, text), n


def read_figures(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """Numbers with look-alike letters for some of their figures put right, long ones without a mark (codes) excepted."""
    if not _NEAR_FIGURE.search(text):
        return text, 0
    n = 0

    def figure(m):
        nonlocal n
        s = m.group()
        if len(s) > 7 and not re.search("[.,]", s) or any(x < m.end() and m.start() < y for x, y in spans):
            return s
        n += 1
        head = s[:2] if s[1:2] == "-" and s[0].isalpha() else ""
        return head + s[len(head) :].translate(_LIKE)

    return _FIGURE.sub(figure, text), n


class Marks(dict):
    """By word, as it stands in a text: 1 if it may have a correction, and 2 if it is among rivals."""

    def __init__(self, known: Sieve, rivals: Sieve):
        super().__init__()
        self.known, self.rivals = known, rivals

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        low = word.lower()
        self[word] = mark = (len(low) >= SHORTEST and self.known("w" + low)) + 2 * self.rivals(low)
        return mark


class Asker:
    """First half of a repair: furniture out, split words joined, and what the text asks for.

    Compounds that may be split at their own hyphen stay as they are until the answer is known.
    """

    def __init__(self, known: Sieve, rivals: Sieve, odd: frozenset[str]):
        self.known, self.marks = known, Marks(known, rivals)
        self.odd = re.compile("[" + "".join(map(re.escape, sorted(odd))) + "]") if odd else None

    def prepare(self, text: str, page: int | None, heads=()) -> tuple[str, int, int, list[str], list[tuple], list[tuple]]:
        """The text, the width of its lines, words joined, furniture, asked units ``(kind, unit, left, right)``, and pairs of neighbours of words that are rivals."""
        heads = frozenset(heads or ())
        lines = text.split("\n")
        furniture = [l for l in lines if 0 < len(l) <= LINE and (heads or _may_be_furniture(l)) and (is_number_line(l, page) or is_header(l, page, heads))]
        if furniture:
            gone = set(furniture)
            text = "\n".join(l for l in lines if l not in gone)
        spans, width = noisy_spans(text), line_width(text)
        asks: set[tuple] = set()

        def compound(unit: str) -> bool:
            if self.known("h" + unit):
                asks.add(("h", unit, "", ""))
                return True
            return False

        text, joined = split_words(text, spans, compound)
        spans = noisy_spans(text) if joined else spans
        known = self.known
        # words are asked for as they stand, and as they will if no compound is one
        for t in (text, split_words(text, spans)[0]) if asks else (text,):
            beside = []
            words = _WORD.findall(t)
            marks = list(map(self.marks.__getitem__, words))
            if not any(marks):
                continue
            low = [w.lower() for w in words]
            for i, (w, mark) in enumerate(zip(low, marks)):
                if mark & 1:
                    asks.add(("w", w, low[i - 1] if i else "", low[i + 1] if i + 1 < len(low) else ""))
            if max(marks) > 1:
                beside = [(low[i], low[i + 1]) for i in range(len(low) - 1) if (marks[i] | marks[i + 1]) & 2]
        if self.odd and self.odd.search(text):
            read = read_figures(text, spans)[0]  # a misread figure beside a character would hide it
            for m in self.odd.finditer(read):
                if known("c" + (u := around(read, m.start()))):
                    asks.add(("c", u, "", ""))
        return text, width, joined, furniture, sorted(asks), beside


def around(text: str, i: int) -> str:
    """The character at ``i`` between its neighbours, figures as 0; shorter at an end of the text."""
    return "".join("0" if c.isdigit() and k != 1 else c for k, c in enumerate(text[i - 1 : i + 2])) if i else ""


def is_header(line: str, page: int | None, heads: frozenset[str]) -> bool:
    return is_header_line(line, page, heads) or bool(heads) and (page or 0) > 1 and form(line) in heads


class Fixer:
    """Second half: the answers to what a text asked are put in."""

    def __init__(self, answers):
        """``answers``: ``(kind, unit, left, right, [(meant, weight)])``."""
        self.words: dict = {}
        self.chars: dict[str, str] = {}
        self.compounds: set[str] = set()
        for kind, unit, left, right, meant in answers or ():
            if kind == "w":
                self.words[unit, left, right] = meant
                self.words[unit] = meant
            elif kind == "c":
                self.chars[unit] = meant[0][0]
            else:
                self.compounds.add(unit)

    def misread(self, text: str) -> tuple[str, int]:
        """Misread words, figures and characters put right; tokens that were wrongly decoded are left alone."""
        n = 0
        near = _NEAR_FIGURE.search(text)
        if not near and not self.words and not self.chars:
            return text, 0
        spans = noisy_spans(text)
        apart = lambda a, b: not any(x < b and a < y for x, y in spans)
        if self.words:
            low = [w.lower() for w in _WORD.findall(text)]
            here, k, end = set(low), -1, len(text.rstrip())

            def word(m):
                nonlocal n, k
                k += 1
                w = m.group()
                if low[k] not in self.words or m.end() == end or not apart(*m.span()):
                    return w
                choice = self.words.get((low[k], low[k - 1] if k else "", low[k + 1] if k + 1 < len(low) else ""), self.words[low[k]])
                n += 1
                v = max(choice, key=lambda c: (c[1] + HERE * (c[0] in here), c[0]))[0]
                return v.upper() if w.isupper() and len(w) > 1 else v[0].upper() + v[1:] if w[0].isupper() else v

            text = _WORD.sub(word, text)
            spans = noisy_spans(text)

        if near:
            text, figures = read_figures(text, spans)
            n += figures
            spans = noisy_spans(text) if figures else spans
        if self.chars:
            chars = list(text)
            read = {u[1:2] for u in self.chars}
            for i in [i for i, c in enumerate(text) if c in read]:
                if 0 < i < len(text) - 1 and (u := around(text, i)) in self.chars and apart(i, i + 1):
                    chars[i] = self.chars[u]
                    n += 1
            text = "".join(chars)
        return text, n

    def finish(self, text: str, page: int | None, heads=(), width: int | None = None) -> tuple[str, int, int, list[str]]:
        """The repaired text, words joined, misreadings, and headers known only now that their misreadings are put right."""
        late: list[str] = []
        joined = 0
        if self.words or self.chars:
            known = frozenset(heads or ())
            for l in text.split("\n"):
                cut = split_header(l) if 0 < len(l) <= LINE and _may_be_furniture(l) else None
                if cut and (page is None or cut[1] == page) and (fixed := self.misread(l)[0]) != l and is_header_line(fixed, page, known):
                    late.append(l)
            if late:
                gone = set(late)
                text = "\n".join(l for l in text.split("\n") if l not in gone)
        if _MAY_SPLIT.search(text):
            text, joined = split_words(text, noisy_spans(text), self.compounds.__contains__)
        text, wrong = self.misread(text)
        return reflow(text, width), joined, wrong, late


def line_width(text: str) -> int:
    """Length of the longest line of running text."""
    most = 0
    for l in text.split("\n"):
        if len(l) > most and not _STRUCTURE.match(l):
            most = len(l)
    return most


def reflow(text: str, width: int | None = None) -> str:
    """Lines of running text joined to paragraphs; headings, lists, tables, code and markers keep their lines.

    ``width`` is that of the lines as they were set, before split words were joined and lines grew with them.
    """
    lines = text.split("\n")
    width = line_width(text) if width is None else width
    out: list[str] = []
    open_ = False
    code = False
    for line in lines:
        s = line.strip()
        if s.startswith("```"):
            code = not code
        if not s:
            open_ = False
            if out and out[-1]:
                out.append("")
            continue
        if code or _STRUCTURE.match(line) or _GAP.search(s):
            if out and out[-1] and open_:
                out.append("")
            out.append(line.rstrip() if code else s)
            open_ = bool(_ITEM.match(s)) and not _CLOSED.search(s)
            continue
        if open_:
            last = out[-1]
            wide = bool(_WIDE.match(s[0]) or s[0] in "，。；：、）》」』】！？") or bool(_WIDE.search(last[-1]) or last[-1] in "，。；：、（《「『【")
            # Chinese and Japanese lines end anywhere, within numbers too; only Latin words keep apart
            wide = wide or not (last[-1].isalpha() and s[0].isalpha()) and bool(_WIDE.search(last) and _WIDE.search(s))
            out[-1] = last + ("" if wide else " ") + s
        else:
            if out and out[-1]:
                out.append("")
            out.append(s)
        # a paragraph goes on unless its line was closed well before the margin, or was a title
        short = len(s) < 0.75 * width
        open_ = not (short and (_CLOSED.search(s) or len(s) < 0.5 * width))
    return "\n".join(out).strip("\n")


# The corpus ----------------------------------------------------------------------------------------------------------

def page_texts(analysis: DataFrame, pages: DataFrame) -> DataFrame:
    """Both texts of all pages: ``field, page_id, doc_id, page_number, text``; NULL texts are left out."""
    one = lambda df, field, c: df.select(F.lit(field).alias("field"), "page_id", "doc_id", F.col("page_number").cast("int").alias("page_number"), F.col(c).alias("text")).where(F.length("text") > 0)
    return one(analysis, "analysis.raw_text", "raw_text").unionByName(one(pages, "pages.markdown", "markdown"))


def running_headers(units: DataFrame) -> DataFrame:
    """``doc_id, heads``: forms of the texts that stand beside the page's own number on ``HEADER_PAGES`` pages of a report or more."""
    part = lambda k: F.split_part("unit", F.lit("\x1f"), F.lit(k)).alias
    seen = units.where("kind = 'f'").select(part(1)("doc_id"), part(2)("form"))
    often = seen.groupBy("doc_id", "form").agg(F.count("*").alias("n")).where(F.col("n") >= HEADER_PAGES)
    return often.groupBy("doc_id").agg(F.collect_list("form").alias("heads"))


def corrections(units: DataFrame) -> DataFrame:
    """All corrections of the corpus: ``kind, read, meant``; materialised."""
    return materialize(word_fixes(units.where("kind = 'w'")).unionByName(character_fixes(units.where("kind = 'c'"))).unionByName(compound_splits(units)))


ASKED = "array<struct<kind:string,unit:string,left:string,right:string>>"
PREPARED = f"row bigint, field string, page_id bigint, page_number int, text string, heads array<string>, listed array<string>, width int, joined int, furniture array<string>, asks {ASKED}, beside array<struct<a:string,b:string>>"
RESULT = "row bigint, field string, page_id bigint, text string, joined int, misread int, furniture int"


def answers(asked: DataFrame, fixes: DataFrame, beside: DataFrame) -> DataFrame:
    """``row, answers``: for what each text asked (``row, kind, unit, left, right``) the candidates with their weights.

    Of several candidates each gains by how often the corpus has it after the word on the left and before the one on the
    right (``beside``: ``a, b``, a row for each time): log of its frequency and of the two words' given it.
    """
    got = asked.join(broadcast_if_small(fixes.withColumnRenamed("read", "unit")), ["kind", "unit"])
    lone, many = got.where("size(meant) = 1"), got.where("size(meant) > 1")
    plain = lambda m: F.transform(m, lambda s: F.struct(s["meant"].alias("meant"), s["weight"].alias("weight")))
    key = ["row", "kind", "unit", "left", "right"]
    count = beside.groupBy("a", "b").agg(F.count("*").alias("n"))
    each = many.select(*key, F.explode("meant").alias("m")).select(*key, "m.*")
    for side, other in (("left", "a"), ("right", "b")):
        own = "b" if other == "a" else "a"
        near = count.select(F.col(other).alias(side), F.col(own).alias("meant"), F.col("n").alias(f"n_{side}"))
        each = each.join(near, [side, "meant"], "left")
    given = lambda c: F.log((F.coalesce(c, F.lit(0)) + 0.1) / (F.col("n") + 1.0))
    ranked = each.groupBy(*key).agg(F.collect_list(F.struct("meant", (F.col("weight") + given("n_left") + given("n_right")).alias("weight"))).alias("meant"))
    both = lone.select(*key, plain(F.col("meant")).alias("meant")).unionByName(ranked)
    return both.groupBy("row").agg(F.collect_list(F.struct("kind", "unit", "left", "right", "meant")).alias("answers"))


def repair(analysis: DataFrame, pages: DataFrame, manifest: DataFrame, once: bool = False) -> DataFrame:
    """Every page's two texts repaired: ``row, field, page_id, text, joined, misread, furniture``.

    ``furniture`` counts page numbers and running headers taken out, lines listed in the report's own
    ``repeated_texts`` excepted (they go too, but are no noise). ``row`` tells rows apart. Defined cases: NULL and empty
    texts have no row; a page that comes twice has two, or one if ``once``; without a page number only forms that are unmistakable count; a
    header is known by a year or by standing on several pages of its report, misreadings put right (one that never
    carries a number, or stands on page 1 without it, is taken for a title and stays); wrongly decoded tokens are not
    searched for misreadings; an empty corpus gives no rows.

    A text asks only for units that pass a sieve of bounded size; these meet the corrections in an equi-join, and come
    back to the texts that asked. A larger corpus with more corrections than the sieve tells apart asks more, for the
    same answers.
    """
    texts = page_texts(analysis, pages)
    units = materialize(unit_counts(texts))
    fixes = corrections(units)
    context = texts.sparkSession.sparkContext
    several = fixes.where("kind = 'w' and size(meant) > 1").select(F.explode("meant").alias("m")).select(F.col("m.meant").alias("u")).distinct()
    known, rivals = sieve(fixes.select(F.concat("kind", "read").alias("u")), "u"), sieve(several, "u")
    odd = frozenset(r.y for r in fixes.where("kind = 'c'").select(F.substring("read", 2, 1).alias("y")).distinct().collect())  # characters of Unicode
    asker = context.broadcast((known, rivals, odd))
    listed = manifest.where("repeated_texts is not null").select("doc_id", F.explode("repeated_texts").alias("line")).groupBy("doc_id").agg(F.collect_set("line").alias("listed"))
    of_doc = broadcast_if_small(materialize(running_headers(units).join(listed, "doc_id", "full")))

    def make_asker():
        ask = Asker(*asker.value)

        def fn(cols):
            row, field, page_id, number, text, heads, listed = cols
            done = [ask.prepare(t, p, h) for t, p, h in zip(text, number, heads)]
            new, width, joined, furniture, asks, beside = zip(*done)
            return [row, field, page_id, number, list(new), heads, listed, list(width), list(joined), list(furniture), [[dict(zip(("kind", "unit", "left", "right"), a)) for a in x] for x in asks], [[dict(zip("ab", x)) for x in b] for b in beside]]

        return fn

    source = texts.join(of_doc, "doc_id", "left").select(F.monotonically_increasing_id().alias("row"), "field", "page_id", "page_number", "text", "heads", "listed")
    prepared = materialize(map_batches(source, make_asker, PREPARED))
    if once:
        first = prepared.groupBy("field", "page_id").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        again = prepared.select("row", "field", "page_id").join(first, ["field", "page_id"]).where("row > first").select("row")
        prepared = prepared.join(broadcast_if_small(materialize(again)), "row", "left_anti")
    asked = prepared.where("size(asks) > 0").select("row", F.explode("asks").alias("q")).select("row", "q.*")
    got = answers(asked, fixes, prepared.select(F.explode("beside").alias("p")).select("p.*"))
    keep = ["row", "field", "page_id", "page_number", "text", "heads", "listed", "width", "joined", "furniture"]

    def make_fixer():
        nothing = Fixer(())

        def fn(cols):
            row, field, page_id, number, text, heads, listed, width, joined, furniture, found = cols
            out = [[], [], [], []]
            for t, p, h, l, wide, j, f, a in zip(text, number, heads, listed, width, joined, furniture, found):
                fixer = Fixer([(x["kind"], x["unit"], x["left"], x["right"], [(m["meant"], m["weight"]) for m in x["meant"]]) for x in a]) if a else nothing
                new, more, wrong, late = fixer.finish(t, p, h, wide)
                for c, v in zip(out, (new, j + more, wrong, len(set(f + late) - set(l or ())))):
                    c.append(v)
            return [row, field, page_id, *out]

        return fn

    # only the texts that asked meet their answers
    quiet = prepared.where("size(asks) = 0").select(*keep, F.lit(None).cast("array<struct<kind:string,unit:string,left:string,right:string,meant:array<struct<meant:string,weight:double>>>>").alias("answers"))
    asking = prepared.where("size(asks) > 0").select(*keep).join(got, "row", "left")
    return map_batches(quiet.unionByName(asking), make_fixer, RESULT)


def noisy(repaired: DataFrame) -> DataFrame:
    """The rows in which something was repaired."""
    return repaired.where("joined + misread + furniture > 0")
