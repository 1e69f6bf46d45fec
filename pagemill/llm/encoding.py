"""Text decoded with the wrong character encoding: finding the spans and restoring them.

Characters are mapped back to the bytes of a legacy encoding; an automaton over those bytes finds the maximal spans that
are well formed in the true encoding; only these spans are decoded. For one-byte legacy encodings the automaton is
written over characters (a class for each range of bytes), so it runs as one compiled expression over the text; for
two-byte ones the text is encoded first. Where nearly any bytes are well formed (Chinese read as Big5, Russian of one
encoding as another) the automaton's states are the readings: the path of greatest likelihood under the corpus's own
characters, each change of reading having its price, gives the spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.rows import map_batches

#: One-byte encodings, and how many multibyte characters in a row (or accented letters in all) a text needs before all its spans are believed; with fewer each is weighed.
SINGLE = (("latin", 1), ("cp1251", 3), ("cp1250", 3), ("koi8_r", 3), ("cp866", 3), ("cp437", 3), ("cp850", 3), ("mac_roman", 3))
#: Two-byte encodings in which UTF-8 was read, and those taken for each other: in which the bytes were read, and what they were.
UTF8_IN = ("gb18030", "cp950", "cp949", "cp932")
DOUBLE = (("cp950", "gb18030"), ("cp949", "gb18030"), ("cp932", "gb18030"), ("gb18030", "cp950"), ("gb18030", "cp932"), ("gb18030", "cp949"))
#: Rise of the mean log frequency of a span's characters that a decoding must bring, and the least span.
GAIN, LEAST_RUN = 2.0, 3
#: Nats that entering and leaving another reading cost, and least total gain and characters of a span read so.
ENTER, LEAVE, LEAST_GAIN, LEAST_SPAN = 8.0, 2.0, 10.0, 2


def _esc(chars) -> str:
    return "".join(re.escape(c) for c in sorted(set(chars)))


@lru_cache(maxsize=None)
def _byte_map(codec: str) -> dict[str, int]:
    """Character to byte, for the bytes from 0x80. ``latin`` joins ISO 8859-1 and Windows-1252."""
    out = {}
    for b in range(0x80, 0x100):
        for c in ("latin-1", "cp1252") if codec == "latin" else (codec,):
            try:
                out[bytes([b]).decode(c)] = b
            except UnicodeDecodeError:
                pass
    return out


@lru_cache(maxsize=None)
def _utf8_spans(codec: str) -> tuple[re.Pattern, re.Pattern]:
    """Automaton for well-formed UTF-8 over the characters of ``codec``; a line end may stand inside a sequence. With one sequence of it."""
    back = _byte_map(codec)
    cls = lambda lo, hi: "[" + _esc(c for c, b in back.items() if lo <= b <= hi) + "]"
    tail = r"\n?" + cls(0x80, 0xBF)
    seq = f"(?:{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}(?:{tail}){{2}}|{cls(0xF0, 0xF4)}(?:{tail}){{3}})"
    return re.compile(f"{seq}(?:\\n?{seq})*"), re.compile(seq)


#: Characters that wrongly decoded text may have held: Latin, Cyrillic, Greek, punctuation, currency, CJK, kana, Hangul, full-width forms, emoji.
_PLAUSIBLE = re.compile(r"[\n -ſΑ-ωЁА-яё‐-⁄₠-₿℀-™⅐-⋿■-➿　-ヿ一-鿿가-힣＀-￯\U0001f300-\U0001faff️]+")
#: GB2312 read as a one-byte western encoding: pairs of bytes from 0xA1, at least three in a row, or two beside Chinese.
_PAIR = r"[\xa1-\xf7]\n?[\xa1-\xfe]"
_GB_LATIN = re.compile(rf"{_PAIR}(?:\n?{_PAIR}){{2,}}|(?<=[一-鿿]){_PAIR}\n?{_PAIR}(?![\xa1-\xfe])|(?<![\xa1-\xfe]){_PAIR}\n?{_PAIR}(?=[一-鿿])")
_UTF8_IN_GB = re.compile(rb"(?:[\xe2-\xe9\xef]\n?[\x80-\xbf]\n?[\x80-\xbf]\n?|[\xc2-\xdf]\n?[\x80-\xbf]\n?){3,}")
#: Characters that two-byte encodings yield, a line end between them allowed.
_WIDE = r"[ˇ-˙‐-⟿⺀-鿿가-힣豈-﫿︰-￯\ue000-\uf8ff]"
_WIDE_RUN = re.compile(rf"{_WIDE}(?:\n?{_WIDE})+")
_HIGH = re.compile("[À-ÿ]+")
_KANA = re.compile("[぀-ヿ]")
#: Cyrillic one-byte encodings taken for each other or for a western one: in which the bytes were read, and what they were.
CYRILLIC = tuple((read, true) for read in ("latin", "cp1251", "koi8_r", "cp866") for true in ("cp1251", "koi8_r", "cp866", "iso8859_5") if read != true)
#: Text that may be Cyrillic, rightly read or not, and its words.
_MAY_BE_CYRILLIC, _LETTER_RUN = re.compile("[Ѐ-ӿ╔-▟]|[À-ÿ]{4}"), re.compile("[^\x00-\x7f]+")
#: What a capital after a small letter within a word costs, and a character that a reading has none for.
ODD_CASE, NO_READING = 4.0, 12.0
#: Words whose readings a task keeps; beyond it the table starts anew.
MEMORY = 100_000
#: Characters by which UTF-8 read as Shift JIS is known; fixed values (the lead bytes E3 and E4 to E9).
_SJIS_SIGNS = re.compile("[縺繧繝縲譁蟷蜑邨驟髢]")
_FAR = re.compile("[　-ヿ一-鿿＀-￯]")
_CJK, _ALPHABETIC = re.compile("[一-鿿぀-ヿ]"), re.compile("[А-яЁёÀ-ÿ‐-‧«»\n]+")
#: A UTF-8 punctuation mark or sign (E2 80 xx, E2 82 AC, E2 84 xx) seen through a one-byte encoding; nothing natural looks like it.
_MARKS = re.compile("[‐-‧‰-›€№™]")
_LOST = re.compile("�")
_CONTROL = re.compile(r"[\x80-\x9f]")
#: Text with none of these has nothing to look for.
_ANY = re.compile(r"[^\x00-\x7f]")


def _line_ends_kept(span: str, decoded: str) -> str:
    """``decoded`` with the line ends of ``span`` put back at the same share of its length."""
    if "\n" not in span:
        return decoded
    out, size = list(decoded), len(span)
    for k, m in enumerate(re.finditer("\n", span)):
        out.insert(min(len(out), round(m.start() / size * len(decoded)) + k), "\n")
    return "".join(out)


def _single(text: str, codec: str, least: int, believed) -> tuple[str, int, int]:
    """Decode UTF-8 spans seen through a one-byte encoding: the text, the spans, the characters they covered.

    A text with few of them keeps those that ``believed`` (of the text, start, end and decoded span) holds to be right.
    """
    spans, seq = _utf8_spans(codec)
    if not spans.search(text):
        return text, 0, 0
    back, good, longest, accents, marks = _byte_map(codec), [], 0, 0, 0
    deeper = _byte_map("latin")
    for m in spans.finditer(text):
        raw = m.group()
        try:
            dec = bytes(back[c] for c in raw if c != "\n").decode("utf-8")
        except UnicodeDecodeError:  # overlong forms or surrogates
            continue
        if not all(c in deeper or _PLAUSIBLE.match(c) for c in dec):
            continue
        if len(dec) == 1 and not (dec < "Ā" or _MARKS.match(dec) or dec in "ŒœŠšŸŽž€™") and (codec == "latin") and not _CONTROL.search(raw):
            if not (_FAR.match(dec) and (_FAR.match(text[m.start() - 1 : m.start()]) or _FAR.match(text[m.end() : m.end() + 2].lstrip("\n")[:1]))):
                continue
        longest = max(longest, len(dec))
        accents += sum(c < "Ā" for c in dec)
        marks += len(_MARKS.findall(dec)) if codec != "cp866" else 0
        good.append((m.start(), m.end(), _line_ends_kept(raw, dec)))
    if longest < least and accents < least and not marks:
        good = [g for g in good if believed(text, *g)]
    out, at = [], 0
    for a, b, dec in good:
        out += [text[at:a], dec]
        at = b
    return "".join(out) + text[at:], len(good), sum(b - a for a, b, _ in good)


def _gb_latin(text: str) -> tuple[str, int, int]:
    """Decode GB2312 seen through a one-byte western encoding."""
    n = covered = 0

    def dec(m):
        nonlocal n, covered
        raw = m.group().replace("\n", "")
        if len(raw) > 5 and _HIGH.fullmatch(raw):
            return m.group()  # letters only: Cyrillic looks like this, Chinese hardly ever
        try:
            out = raw.encode("latin-1").decode("gb2312")
        except UnicodeError:
            try:
                out = raw.encode("latin-1").decode("gb18030")
            except UnicodeError:
                return m.group()
        if len(_KANA.findall(out)) * 5 >= len(out):  # kana stand in the same rows of EUC-JP, the rest does not
            try:
                out = raw.encode("latin-1").decode("euc_jp")
            except UnicodeError:
                pass
        n += 1
        covered += len(raw)
        return _line_ends_kept(m.group(), out)

    return _GB_LATIN.sub(dec, text), n, covered


def _script(c: str) -> str:
    """Script of a letter, roughly."""
    return "latin" if c < "Ͱ" else "greek" if c < "Ѐ" else "cyrillic" if c < "԰" else "wide"


@lru_cache(maxsize=1)
def _sjis_spans() -> re.Pattern:
    """Shift JIS seen through a one-byte western encoding: three pairs or more; a second byte may be an ASCII letter."""
    back = _byte_map("latin")
    lead = "[" + _esc(c for c, b in back.items() if 0x81 <= b <= 0x9F or 0xE0 <= b <= 0xEF) + "]"
    tail = "[@-~" + _esc(c for c, b in back.items() if 0x80 <= b <= 0xFC) + "]"
    return re.compile(rf"{lead}\n?{tail}(?:\n?{lead}\n?{tail}){{2,}}")


def _sjis_latin(text: str) -> tuple[str, int, int]:
    """Decode Shift JIS seen through a one-byte western encoding; half of what comes out must be kana or Chinese characters."""
    back, n, covered = _byte_map("latin"), 0, 0

    def dec(m):
        nonlocal n, covered
        raw = m.group().replace("\n", "")
        try:
            out = bytes(back.get(c, ord(c) & 0xFF) for c in raw).decode("cp932")
        except UnicodeError:
            return m.group()
        if len(_CJK.findall(out)) * 2 < len(out) or not _KANA.search(out):
            return m.group()
        n += 1
        covered += len(raw)
        return _line_ends_kept(m.group(), out)

    return _sjis_spans().sub(dec, text), n, covered


@lru_cache(maxsize=1)
def _any_pair() -> re.Pattern:
    """A lead and a continuation byte of UTF-8 through any one-byte encoding, or two GB2312 pairs through a western one."""
    pairs = []
    for codec, _ in SINGLE:
        cls = lambda lo, hi: "[" + _esc(c for c, b in _byte_map(codec).items() if lo <= b <= hi) + "]"  # noqa: B023, E731
        pairs.append(cls(0xC2, 0xF4) + r"\n?" + cls(0x80, 0xBF))
    return re.compile("|".join([*pairs, rf"{_PAIR}\n?{_PAIR}"]))


def _one_byte(text: str, believed) -> tuple[str, int]:
    """The one-byte reading that explains most characters; by chance others may fit a few."""
    if not _any_pair().search(text) and not _sjis_spans().search(text):
        return text, 0
    tries = [_single(text, codec, least, believed) for codec, least in SINGLE] + [_gb_latin(text), _sjis_latin(text)]
    out, n, covered = max(tries, key=lambda t: t[2])
    return (out, n) if covered else (text, 0)


def _utf8_gb(text: str, codec: str = "gb18030") -> tuple[str, int]:
    """Decode UTF-8 seen through a two-byte encoding; a byte that was lost at the end of a span becomes U+FFFD."""
    n = 0

    def dec(m):
        nonlocal n
        run = m.group()
        try:
            data = run.encode(codec)
        except UnicodeEncodeError:
            return run
        if not _UTF8_IN_GB.search(data):
            return run
        parts = [c.encode(codec) for c in run]
        starts, at = {}, 0
        for k, p in enumerate(parts):
            starts[at] = k
            at += len(p)
        starts[at] = len(parts)
        out, k, pos = [], 0, 0
        while k < len(parts):
            span = _UTF8_IN_GB.match(data, pos)
            if span:
                end = span.end()
                while end not in starts:
                    end += 1
                raw = data[pos:end]
                good = raw.replace(b"\n", b"").decode("utf-8", "replace")
                if len(_CJK.findall(good)) * 2 >= len(good) or len(good) > 3 and _ALPHABETIC.fullmatch(good):
                    n += 1
                    out.append(_line_ends_kept(raw.decode("latin-1"), good))
                    k, pos = starts[end], end
                    continue
            out.append(run[k])
            pos += len(parts[k])
            k += 1
        return "".join(out)

    return (_WIDE_RUN.sub(dec, text), n) if _UTF8_IN_GB.search(text.encode(codec, "replace")) else (text, 0)


def _utf8_sjis(text: str) -> tuple[str, int]:
    """Decode UTF-8 seen through Shift JIS."""
    return _utf8_gb(text, "cp932") if _SJIS_SIGNS.search(text) else (text, 0)


@lru_cache(maxsize=None)
def _swap(read: str, true: str) -> dict[str, str]:
    """Character to character, for one-byte encodings taken for each other."""
    out = {}
    for c, b in _byte_map(read).items():
        try:
            out[c] = bytes([b]).decode(true)
        except UnicodeDecodeError:
            pass
    return out


class _Pairs(dict):
    """Character to character (or None), for two-byte encodings taken for each other; filled as characters are met."""

    def __init__(self, read: str, true: str):
        self.read, self.true = read, true

    def __missing__(self, c: str) -> str | None:
        try:
            raw = c.encode(self.read)
            out = raw.decode(self.true) if len(raw) == 2 else ""
        except UnicodeError:
            out = ""
        self[c] = out if len(out) == 1 and out != c and _PLAUSIBLE.fullmatch(out) else None
        return self[c]


def _best_readings(scores: list[list[float]]) -> list[int]:
    """The likeliest reading of each unit (0: as it stands), for its score under every reading; spans of too little gain are left."""
    k = len(scores[0])
    best, back = [0.0] + [-ENTER] * (k - 1), []
    for row in scores:
        out = max(range(1, k), key=best.__getitem__)
        leave, enter = best[out] - LEAVE, best[0] - ENTER
        step = [0 if best[0] >= leave else out] + [x if best[x] >= enter else 0 for x in range(1, k)]
        best = [max(best[0], leave) + row[0]] + [max(best[x], enter) + row[x] for x in range(1, k)]
        back.append(step)
    at = max(range(k), key=best.__getitem__)
    path = []
    for step in reversed(back):
        path.append(at)
        at = step[at]
    path.reverse()
    a = 0
    while a < len(path):
        b = a
        while b < len(path) and path[b] == path[a]:
            b += 1
        if path[a] and sum(scores[i][path[a]] - scores[i][0] for i in range(a, b)) < LEAST_GAIN:
            path[a:b] = [0] * (b - a)
        a = b
    return path


class Restorer:
    """Finds and decodes wrongly decoded spans; ``freq`` holds the corpus's characters, and pairs of letters, with their natural log frequency."""

    def __init__(self, freq: dict[str, float]):
        self.pairs = {c: v for c, v in freq.items() if len(c) == 2}
        freq = {c: v for c, v in freq.items() if len(c) == 1}
        self.freq = freq
        self.floor = min(freq.values(), default=-16.0) - 1.0
        self.pair_floor = min(self.pairs.values(), default=-14.0) - 1.0
        #: What a character of sound text scores on average.
        self.typical = sum(math.exp(v) * v for v in freq.values()) if freq else 0.0
        common = _esc(c for c, v in freq.items() if v > self.typical - 2.5)
        #: A character that makes a run worth scoring: text of common characters only was read rightly.
        self.rare = re.compile(f"(?![{common}]){_WIDE}" if common else _WIDE)
        self.tables = [_Pairs(*p) for p in DOUBLE]
        self.words: dict[str, list[float]] = {}

    def score(self, s: str) -> float:
        get, floor = self.freq.get, self.floor
        wide = [c for c in s if c > "\x7f" and c != "\n"]
        return sum(get(c, floor) for c in wide) / len(wide) if wide else floor

    def _believed(self, text: str, a: int, b: int, dec: str) -> bool:
        """Whether a short span through a one-byte encoding, ``dec`` when decoded, was wrongly decoded.

        Its letters must be of the script of the letters beside it. A sign, or a capital after a small letter, within a
        word of small letters is believed at once; anything else must become likelier by ``GAIN``.
        """
        raw, plain = text[a:b], dec.replace("\n", "")
        before, after = text[a - 1 : a], text[b : b + 1]
        beside = [c for c in (before, after) if c.isalpha()]
        if any(_script(c) != _script(d) for c, d in ((before, plain[0]), (after, plain[-1])) if c.isalpha() and d.isalpha() and _script(d) != "wide"):
            return False
        if (before.islower() or after.islower() and not raw.isalpha()) and all(c.islower() and _script(c) == "latin" for c in plain) and not (raw.isalpha() and raw.islower()):
            return True
        if any(c.isalpha() and _script(c) != "wide" for c in beside) and not all(c.isalpha() for c in plain):
            return False  # a sign within a word
        return self.score(plain) - self.score(raw) >= GAIN

    def _utf8_double(self, text: str) -> tuple[str, int]:
        """Decode runs of UTF-8 that were read in a two-byte encoding, where that makes them far likelier."""
        n = 0

        def dec(m):
            nonlocal n
            run = m.group()
            if len(run) < LEAST_RUN or not self.rare.search(run):
                return run
            best, kept, plain = self.score(run) + GAIN, None, run.replace("\n", "")
            for read in UTF8_IN:
                try:
                    out = plain.encode(read).decode("utf-8")
                except UnicodeError:
                    continue
                if _PLAUSIBLE.fullmatch(out) and (s := self.score(out)) > best:
                    best, kept = s, out
            if kept is None:
                return run
            n += 1
            return _line_ends_kept(run, kept)

        return (_WIDE_RUN.sub(lambda m: self._parts(m, dec), text), n) if self.rare.search(text) else (text, 0)

    def _double(self, text: str) -> tuple[str, int]:
        """Decode spans of two-byte encodings that were taken for each other: within a run, the likeliest reading of each character."""
        n = 0

        def dec(m):
            nonlocal n
            run = m.group()
            if not self.rare.search(run):
                return run
            plain = [c for c in run if c != "\n"]
            get, floor = self.freq.get, self.floor
            read = [[None if (o := t[c]) is None else o for t in self.tables] for c in plain]
            path = _best_readings([[get(c, floor), *(2 * floor if o is None else get(o, floor) for o in os)] for c, os in zip(plain, read)])
            # one character alone proves nothing
            path = [p if p and (i and path[i - 1] == p or i + 1 < len(path) and path[i + 1] == p) else 0 for i, p in enumerate(path)]
            if not any(path):
                return run
            n += sum(p > 0 and (i == 0 or path[i - 1] != p) for i, p in enumerate(path))
            new = iter(c if not p else os[p - 1] for c, os, p in zip(plain, read, path))
            return "".join(c if c == "\n" else next(new) for c in run)

        return (_WIDE_RUN.sub(dec, text), n) if self.rare.search(text) else (text, 0)

    def _word(self, word: str) -> float:
        """Log likelihood of a word by its pairs of letters, capitals counted as small ones."""
        low, get, floor = word.lower(), self.pairs.get, self.pair_floor
        odd = sum(a.islower() and b.isupper() for a, b in zip(word, word[1:]))
        return get("^" + low[0], floor) + sum(get(low[i : i + 2], floor) for i in range(len(low) - 1)) + get(low[-1] + "$", floor) - ODD_CASE * odd

    def _readings(self, word: str) -> list[float]:
        """Score of a word under each Cyrillic reading, as it stands first."""
        if word not in self.words:
            if len(self.words) > MEMORY:
                self.words.clear()
            out = [self._word(word)]
            for pair in CYRILLIC:
                table = _swap(*pair)
                read = "".join(table.get(c, c) for c in word)
                out.append(self._word(read) - NO_READING * sum(c not in table for c in word))
            self.words[word] = out
        return self.words[word]

    def _cyrillic(self, text: str) -> tuple[str, int]:
        """Decode Cyrillic spans of one-byte encodings that were taken for each other: the likeliest reading of each word, then of parts of words."""
        if not self.pairs or not _MAY_BE_CYRILLIC.search(text):
            return text, 0
        words = list(_LETTER_RUN.finditer(text))
        scores = [self._readings(m.group()) for m in words]
        if all(max(s) < s[0] + GAIN for s in scores):
            return text, 0
        path = _best_readings(scores)
        out, at, n = [], 0, 0
        for m, p, s in zip(words, path, scores):
            w = m.group()
            if p:
                new = "".join(_swap(*CYRILLIC[p - 1]).get(c, c) for c in w)
            else:
                new = self._part_of_word(w) if len(w) > 3 and s[0] < len(w) * self.pair_floor * 0.6 else w
            if new != w:
                n += 1
                out += [text[at : m.start()], new]
                at = m.end()
        return ("".join(out) + text[at:], n) if n else (text, 0)

    def _part_of_word(self, word: str) -> str:
        """A word whose beginning or end was read in another encoding than the rest."""
        best, kept = self._word(word) + LEAST_GAIN, word
        for pair in CYRILLIC:
            table = _swap(*pair)
            other = "".join(table.get(c, c) for c in word)
            for i in range(1, len(word) - 1):
                for new in (word[:i] + other[i:], other[: i + 1] + word[i + 1 :]):
                    if (v := self._word(new)) > best:
                        best, kept = v, new
        return kept

    @staticmethod
    def _parts(m, dec):
        """A run is tried whole, then between characters that were lost."""
        run = m.group()
        return re.sub("[^�]+", dec, run) if "�" in run else dec(m)

    def restore(self, text: str) -> tuple[str, int, int]:
        """The text with its spans decoded, how many there were, and how many characters are lost for good."""
        if not _ANY.search(text):
            return text, 0, 0
        spans, seen = 0, set()
        while text not in seen:  # encodings may have been stacked, and several may stand side by side
            seen.add(text)
            for step in (lambda t: _one_byte(t, self._believed), _utf8_gb, _utf8_sjis, self._utf8_double, self._double, self._cyrillic):
                text, k = step(text)
                spans += k
        return text, spans, len(_LOST.findall(text)) + len(_CONTROL.findall(text))


#: Runs whose pairs of letters are counted: letters of Latin beyond ASCII and of Cyrillic, and marks that stand beside them.
_ALPHABETIC_RUN = re.compile("[\x80-ԯ‐-‧№]+")


def units(texts) -> Counter:
    """Characters of some texts, and pairs of letters (small, with ``^`` and ``$`` for the ends of a run) of accented and Cyrillic ones."""
    count: Counter = Counter()
    runs: Counter = Counter()
    for t in texts:
        if t:
            count.update(t)
            if not t.isascii():
                runs.update(_ALPHABETIC_RUN.findall(t))
    count = Counter({c: n for c, n in count.items() if not "\ud800" <= c <= "\udfff"})
    for run, n in runs.items():
        low = run.lower()
        for a, b in zip("^" + low, low + "$"):
            count[a + b] += n
    return count


def character_counts(df: DataFrame, text: str) -> DataFrame:
    """``ch, n``: the ``units`` of all texts, counted within each batch, then summed.

    At most a row for each Unicode character and for each pair of a few hundred letters.
    """

    def make():
        def fn(cols):
            count = units(cols[0])
            return [list(count), list(count.values())]

        return fn

    return map_batches(df.select(text), make, "ch string, n bigint", rows=None).groupBy("ch").agg(F.sum("n").alias("n"))


def log_frequencies(counts: DataFrame) -> dict[str, float]:
    """Natural log share of every non-ASCII character, and of every pair of letters. Bounded by the size of Unicode (about 150 000 assigned characters)."""
    return shares({r.ch: r.n for r in counts.where((F.col("ch") > "\x7f") | (F.length("ch") == 2)).collect()})


def shares(count: dict[str, int]) -> dict[str, float]:
    """Natural log of each unit's share among the characters, or among the pairs."""
    total = {k: sum(n for c, n in count.items() if len(c) == k) or 1 for k in (1, 2)}
    return {c: math.log(n / total[len(c)]) for c, n in count.items()}


def restore_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, restored, spans, lost`` for every row of ``df``.

    ``spans`` counts decoded stretches, ``lost`` characters that cannot be recovered (replacement characters, stray
    control characters of the upper half). Defined cases: a NULL text gives a NULL text with 0 and 0, an empty one
    itself; text without damage comes back unchanged; repeated rows are treated each; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(log_frequencies(character_counts(df, text)))

    def make():
        fix = Restorer(shared.value).restore

        def fn(cols):
            keys, texts = cols
            done = [(None, 0, 0) if t is None else fix(t) for t in texts]
            return [keys, *map(list, zip(*done))]

        return fn

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(F.col(key).alias("k"), F.col(text).alias("t")), make, f"`{key}` {kind}, restored string, spans int, lost int")
