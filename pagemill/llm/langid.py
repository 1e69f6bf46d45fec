"""Languages of documents and of their segments by multilingual mixture inference.

Character n-gram models are fitted to the texts whose label is usable. A document is a mixture: expectation-maximisation
over its sentences' n-gram likelihoods estimates the share of each language, and languages are dropped one by one while
the penalised likelihood (BIC) rises. Sentences then take the language of the greatest posterior; neighbours of the same
language make a segment.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.rows import map_batches
from pagemill.plans.storage import materialize

#: Labelled texts to which the models are fitted, about so many of each language (those of the least hash).
SAMPLE = 4000
#: n-gram orders (with word boundaries) and buckets they are hashed to: the model is languages x BUCKETS floats, whatever the corpus.
ORDERS, BUCKETS = (1, 2, 3, 4), 1 << 16
#: Rounds of expectation-maximisation, and nats that one more language must earn besides BIC.
ROUNDS, EARN = 12, 6.0
#: Weight of a log likelihood (which is per n-gram that covers a letter) in a confidence: with it, windows of one to four
#: units of held-out texts have a mean confidence equal to the share that is judged rightly (0.963 on sf0.1).
TEMPER = 1.8
#: Units whose likelihoods a task keeps; beyond it the table starts anew.
MEMORY = 200_000
#: Characters of the texts that are read at once.
TOGETHER = 100_000
#: A sentence counts as whole from so many letters (of scripts without spaces, characters) on.
LEAST_LETTERS, LEAST_WIDE = 12, 6
#: Nats by which a sentence's language must beat the document's main one before it makes a document mixed.
MARGIN = 6.0

_MARKER = re.compile(r"<!--.*?-->|```|\*\*|^#+\s*|^\s*[-*•]\s+", re.M)
#: A mark, then what may follow it; the marks come first, so that the text is scanned for them alone.
_CUT = re.compile(r"[。！？.!?…\n](?:(?<=[。！？])[”」』）]*|(?<=[.!?…])[\"”’»)]*\s+(?=[^\sa-zà-öø-ÿа-яё\x01])|(?<=\n)\n*)")
#: What every marker of the text's layout holds one of, or a dash before a blank.
_LAYOUT, _DASH = ("<!--", "```", "#", "*", "•"), re.compile(r"-\s")
_RUN = re.compile(r"[A-Za-zÀ-ɏͰ-ϿЀ-ӿ]+|[一-鿿぀-ヿ々ー가-힣]+")
_NEAR, _FAR, _KANA = "[A-Za-zÀ-ɏͰ-ϿЀ-ӿ]", "[一-鿿぀-ヿ々ー가-힣]", re.compile("[぀-ゟ゠-ヺー]")
#: By code point, whether a character belongs to a run without spaces, or to a word (all are of the basic plane).
_IS_FAR, _IS_NEAR = (np.array([re.match(p, chr(i)) is not None for i in range(0x10000)]) for p in (_FAR, _NEAR))
#: What texts are joined by, to be read at once.
_SEP = "\x01"


def grams(run: str) -> list[int]:
    """Buckets of a word's n-grams; words keep their boundaries, runs without spaces have none."""
    if run.isascii():  # a character is a byte
        b = f"_{run.lower()}_".encode()
        return [crc32(b[i : i + 1]) % BUCKETS for i in range(1, len(b) - 1)] + [crc32(b[i : i + n]) % BUCKETS for n in ORDERS[1:] for i in range(len(b) - n + 1)]
    wide = run[0] >= "⺀"
    s = run if wide else f"_{run.lower()}_"
    return [crc32(s[i : i + n].encode()) % BUCKETS for n in (ORDERS[:2] if wide else ORDERS) for i in range(len(s) - n + 1) if s[i : i + n] != "_"]


def plain(text: str) -> str:
    """``text`` with blanks for the markers of its layout, character for character."""
    marked = any(x in text for x in _LAYOUT) or _DASH.search(text)
    return (_MARKER.sub(lambda m: " " * len(m.group()), text) if marked else text).replace(_SEP, " ")


def together(texts: Iterable[str]) -> Iterator[list[str]]:
    """``texts`` in order, in lists of about ``TOGETHER`` characters; a longer text has one of its own."""
    out, size = [], 0
    for t in texts:
        if out and size + len(t) > TOGETHER:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


class Joined:
    """Texts joined by separators, each followed by one: their characters, and which of these belong to words and to runs without spaces."""

    def __init__(self, texts: list[str]):
        self.text = _SEP.join(texts) + _SEP
        self.chars = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kept = np.minimum(self.chars, 0xFFFF)
        self.far, self.near = _IS_FAR[kept], _IS_NEAR[kept]
        self.ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where pairs of characters of runs without spaces begin, and their codes; a single character is itself."""
        far, c = self.far, self.chars
        after, before = np.append(far[1:], False), np.append(False, far[:-1])
        at = np.flatnonzero(far & (after | ~before))
        code = c[at].astype(np.int64)
        return at, np.where(after[at], code << 21 | c[np.minimum(at + 1, len(c) - 1)], code)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end."""
        near = self.near
        return np.flatnonzero(near & ~np.append(False, near[:-1])), np.flatnonzero(near & ~np.append(near[1:], False)) + 1

    def parts(self, start: np.ndarray, end: np.ndarray) -> list[str]:
        return list(map(self.text.__getitem__, map(slice, start.tolist(), end.tolist())))


class Units:
    """What is counted of texts, numbered as it is met: words in lower case, and of runs without spaces their pairs of characters."""

    def __init__(self):
        self.names: list[str] = []
        self.numbers: dict[str, int] = {}
        self.codes: dict[int, int] = {}
        #: The numbers of the codes that were last seen at a place each: most are found here, the others in ``codes``.
        self.held, self.at = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def number(self, name: str) -> int:
        k = self.numbers.get(name)
        if k is None:
            k = self.numbers[name] = len(self.names)
            self.names.append(name)
        return k

    def of_words(self, words: list[str]) -> np.ndarray:
        ids = list(map(self.numbers.get, words))
        if None in ids:
            for w in dict.fromkeys(w for w, k in zip(words, ids) if k is None):
                self.numbers[w] = self.number(w.lower())
            ids = [self.numbers[w] for w in words]
        return np.array(ids, np.int64)

    def of_codes(self, codes: np.ndarray) -> np.ndarray:
        place = ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
        ids = self.at[place]
        miss = np.flatnonzero(self.held[place] != codes)
        if len(miss):
            others = codes[miss].tolist()
            for x in dict.fromkeys(others):
                if x not in self.codes:
                    self.codes[x] = self.number((chr(x >> 21) if x >> 21 else "") + chr(x & 0x1FFFFF))
            ids[miss] = [self.codes[x] for x in others]
            self.held[place[miss]], self.at[place[miss]] = codes[miss], ids[miss]
        return ids


class Tally:
    """In how many of some texts, markers blanked, each of ``units`` stands, and how often."""

    def __init__(self, units: Units):
        self.units, self.texts, self.times = units, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, texts: Iterable[str]) -> None:
        for some in together(texts):
            joined = Joined(some)
            (at, codes), (start, end) = joined.pairs(), joined.words()
            ids = np.concatenate((self.units.of_codes(codes), self.units.of_words(joined.parts(start, end))))
            text = np.searchsorted(joined.ends, np.concatenate((at, start)), "right")
            of_text, n = np.unique(text << 32 | ids, return_counts=True)
            size = len(self.units.names)
            seen = of_text & 0xFFFFFFFF
            self.texts = np.bincount(seen, minlength=size) + np.pad(self.texts, (0, size - len(self.texts)))
            self.times = np.bincount(seen, n, minlength=size).astype(np.int64) + np.pad(self.times, (0, size - len(self.times)))

    def rows(self) -> Iterator[tuple[str, int, int]]:
        """``unit, texts, n`` of the units met."""
        for k in np.flatnonzero(self.times).tolist():
            yield self.units.names[k], int(self.texts[k]), int(self.times[k])


def unit_counts(df: DataFrame, lang: str, text: str) -> DataFrame:
    """``lang, unit, texts, n``: in how many texts of a language a unit stands, and how often; summed within each batch first."""

    def make():
        def fn(cols):
            own: dict[str, list[str]] = {}
            for l, t in zip(*cols):
                own.setdefault(l, []).append(t)
            units, out = Units(), []
            for l, some in own.items():
                tally = Tally(units)
                tally.add(map(plain, some))
                out.extend((l, *row) for row in tally.rows())
            return [[x[i] for x in out] for i in range(4)]

        return fn

    return map_batches(df.select(lang, text), make, "lang string, unit string, texts bigint, n bigint", rows=None).groupBy("lang", "unit").agg(F.sum("texts").alias("texts"), F.sum("n").alias("n"))


def gram_vectors(counts: DataFrame) -> DataFrame:
    """``lang, grams``: dense n-gram counts of the units, one row for each language and task."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for l, u, n in zip(*(c.to_pylist() for c in batch.columns)):
                # a word that returns in every text says little more than once
                np.add.at(total.setdefault(l, np.zeros(BUCKETS)), grams(u), 1.0 + math.log(n))
        for l, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([l]), pa.array([v.tolist()], type=pa.list_(pa.float64()))], names=["lang", "grams"])

    return counts.select("lang", "unit", "n").coalesce(4).mapInArrow(run, "lang string, grams array<double>")


class Model:
    """n-gram log probabilities of every language."""

    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.05):
        self.langs = langs
        c = counts + smooth
        self.logp = np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32) if len(langs) else np.zeros((0, BUCKETS), np.float32)
        self.at = {l: i for i, l in enumerate(langs)}
        self._clear()

    def _clear(self) -> None:
        self.units = Units()
        #: For each unit the log likelihoods per n-gram that covers a letter; so many are filled in.
        self.table, self.filled = np.zeros((4096, len(self.langs))), 0

    def __getstate__(self):
        return {"langs": self.langs, "logp": self.logp, "at": self.at}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._clear()

    def _fill(self) -> None:
        """Units not met before are added together: one look into the model for all their n-grams."""
        k, n = self.filled, len(self.units.names)
        if k == n:
            return
        while n > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        new = self.units.names[k:]
        own = [grams(u) for u in new]
        starts = np.cumsum([0, *map(len, own[:-1])])
        v = np.add.reduceat(self.logp[:, [g for gs in own for g in gs]], starts, axis=1).T
        for u, row in zip(new, v):
            wide = u[0] >= "⺀"
            row /= 3.0 if wide else 4.0
            if wide and "ja" in self.at and "zh" in self.at and (kana := len(_KANA.findall(u))):
                row[self.at["zh"]] -= 4.0 * kana  # Chinese has no kana
        self.table[k:n], self.filled = v, n

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the sentences of ``texts`` that have letters: text, ``(start, end)`` in it, log likelihoods, letters, and whether it is a whole sentence.

        Sentences are cut at closing marks and line ends. In Chinese or Japanese ones foreign names and terms don't count:
        such a sentence has its pairs of characters only, one with more than three times as many other letters its words only.
        """
        if len(self.units.names) > MEMORY:
            self._clear()
        joined = Joined(texts)
        begins = np.concatenate(([0], joined.ends[:-1]))
        cut = np.zeros(len(joined.chars), bool)
        cut[begins] = cut[[m.end() for m in _CUT.finditer(joined.text)]] = True
        starts = np.flatnonzero(cut)
        n, sentence = len(starts), np.cumsum(cut) - 1
        wide, other = (np.add.reduceat(x, starts, dtype=np.int64) for x in (joined.far, joined.near))
        by_pairs = (wide > 0) & (wide * 3 >= other)
        ll, units = np.zeros((n, len(self.langs))), np.zeros(n, np.int64)

        def add(of: np.ndarray, ids: np.ndarray) -> None:
            if len(of):
                self._fill()
                first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                ll[of[first]] = np.add.reduceat(self.table.take(ids, axis=0), first, axis=0)
                units[of[first]] = np.diff(np.append(first, len(of)))

        if by_pairs.any():
            at, codes = joined.pairs()
            keep = by_pairs[sentence[at]]
            add(sentence[at[keep]], self.units.of_codes(codes[keep]))
        if ((other > 0) & ~by_pairs).any():
            start, end = joined.words()
            keep = ~by_pairs[sentence[start]]
            add(sentence[start[keep]], self.units.of_words(joined.parts(start[keep], end[keep])))
        whole = (other >= LEAST_LETTERS) & (units > 3) | (wide >= LEAST_WIDE)
        have = np.flatnonzero(wide + other)
        text = np.searchsorted(joined.ends, starts[have], "right")
        end = np.minimum(np.append(starts[1:], len(joined.chars))[have], joined.ends[text] - 1)
        return text, np.stack([starts[have], end], axis=1) - begins[text, None], ll[have], (wide + other)[have], whole[have]


def mixture(ll: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages and posteriors of the sentences, for log likelihoods (sentences x languages).

    All languages that are best somewhere start with equal shares; EM; then the language whose loss costs least is left
    out while the penalised likelihood does not fall.
    """
    n, k = ll.shape

    def fit_active(active: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        a = ll[:, active]
        w = np.full(len(active), 1.0 / len(active))
        for _ in range(ROUNDS):
            z = a + np.log(w)
            top = z.max(axis=1, keepdims=True)
            p = np.exp(z - top)
            tot = p.sum(axis=1, keepdims=True)
            p /= tot
            new = p.mean(axis=0)
            if np.abs(new - w).max() < 1e-4:
                w = new
                break
            w = np.maximum(new, 1e-12)
        value = float((np.log(tot[:, 0]) + top[:, 0]).sum())
        return value - len(active) * (0.5 * math.log(n + 1) + EARN), w, p

    active = sorted(set(np.argmax(ll, axis=1).tolist()))
    if len(active) == 1:  # no sentence prefers another language: it has all of the mixture
        shares, post = np.zeros(k), np.zeros((n, k))
        shares[active], post[:, active] = 1.0, 1.0
        return shares, post
    best, w, p = fit_active(active)
    while len(active) > 1:
        tries = [(fit_active([x for x in active if x != out]), out) for out in active]
        (value, w2, p2), out = max(tries, key=lambda t: t[0][0])
        if value < best:
            break
        best, w, p = value, w2, p2
        active.remove(out)
    shares, post = np.zeros(k), np.zeros((n, k))
    shares[active], post[:, active] = w, p
    return shares, post


def certainty(ll: np.ndarray, lang: int) -> float:
    """Posterior of ``lang`` among all languages, equally likely before, for sentences (rows) that are in one language."""
    return float(certainties(ll.sum(axis=0)[None], np.array([lang]))[0])


def certainties(total: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """The same for summed log likelihoods, each row for a language."""
    z = TEMPER * total
    return 1.0 / np.exp(np.minimum(z - z[np.arange(len(z)), lang][:, None], 700.0)).sum(axis=1)


def analyse(model: Model, text: str | None) -> dict | None:
    """Language, confidence, languages with a whole sentence, and segments of a text; None if it has no letters.

    The language is the one most letters are in. A confidence is the posterior, among all languages, of the one named,
    given the sentences found to be in it (a segment's, or all of the text's): near 1 / languages where nothing tells.
    """
    return analyse_all(model, [text])[0]


def analyse_all(model: Model, texts: list[str | None]) -> list[dict | None]:
    """``analyse`` of each text; many are read at once."""
    if not model.langs:
        return [None] * len(texts)
    out: list[dict | None] = []
    for some in together(t or "" for t in texts):
        out.extend(_analyse(model, some))
    return out


def _analyse(model: Model, texts: list[str]) -> list[dict | None]:
    out: list[dict | None] = [None] * len(texts)
    text, cuts, ll, letters, full = model.sentences(list(map(plain, texts)))
    if not len(text):
        return out
    # headings and table rows are no sentences
    spans, whole, of = cuts.tolist(), full.tolist(), text.tolist()
    for i in np.flatnonzero(full).tolist():
        a = spans[i][0]
        whole[i] = not texts[of[i]][a : a + 2].lstrip().startswith(("#", "|", "<"))
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    last = np.append(first[1:], len(text))
    best = ll.argmax(axis=1)
    main = best[first]
    one = np.minimum.reduceat(best, first) == np.maximum.reduceat(best, first)
    sure = certainties(np.add.reduceat(ll, first, axis=0), main).tolist()
    for i, j, m, alone, p in zip(first.tolist(), last.tolist(), main.tolist(), one.tolist(), sure):
        if alone:  # no sentence prefers another language: the text is all in one
            n, lang = sum(whole[i:j]), model.langs[m]
            out[of[i]] = {"lang": lang, "confidence": round(p, 4), "whole": {lang: n} if n else {}, "segments": [(spans[i][0], spans[j - 1][1], lang, round(p, 4))]}
        else:
            out[of[i]] = _mixed(model.langs, spans[i:j], ll[i:j], letters[i:j], whole[i:j])
    return out


def _mixed(langs: list[str], spans: list[list[int]], ll: np.ndarray, letters: np.ndarray, whole: list[bool]) -> dict:
    """The same for a text whose sentences may be in several languages."""
    post = mixture(ll)[1]
    pick = post.argmax(axis=1)
    weight = np.zeros(len(langs))
    np.add.at(weight, pick, letters)
    main = int(weight.argmax())
    found: Counter = Counter()
    segments: list[list] = []
    for i, ((a, b), l) in enumerate(zip(spans, pick.tolist())):
        if whole[i] and (l == main or ll[i, l] - ll[i, main] >= MARGIN):
            found[l] += 1
        if segments and segments[-1][2] == l:
            segments[-1][1], segments[-1][4] = b, i + 1
        else:
            segments.append([a, b, l, i, i + 1])
    return {
        "lang": langs[main],
        "confidence": round(certainty(ll[pick == main], main), 4),
        "whole": {langs[l]: n for l, n in found.items()},
        "segments": [(a, b, langs[l], round(certainty(ll[i:j], l), 4)) for a, b, l, i, j in segments],
    }


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` with ``label_lang``: the code of an accepted label, else NULL. ``labels`` is a small fixed table."""
    codes = labels.select(F.col("label").alias("__label"), F.col("lang").alias("label_lang")).where("__label is not null").dropDuplicates(["__label"])
    return documents.join(F.broadcast(codes), documents["lang"] == F.col("__label"), "left").drop("__label")


def sampled(known: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` rows of each ``label_lang``, those of the least hash of ``doc_id``; all where there are fewer.

    A language's rows are counted, which gives the hash below which a row is taken: a filter, so no text is exchanged.
    """
    size = known.groupBy("label_lang").agg(F.count("*").alias("n"))  # a row for each language
    at = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    return known.join(F.broadcast(size), "label_lang").where(at * F.col("n") < sample).drop("n")


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """n-gram models from about ``sample`` labelled texts of each language, those of the least hash of their id.

    Labels are partly wrong, and a rare language's texts may be mostly another's. A unit is therefore counted for a
    language only if the share of its texts with the unit is at least half the greatest such share: English words in the
    few texts wrongly labelled German are left out of German, words two languages share stay in both. What reaches the
    driver is one vector of ``BUCKETS`` numbers for each language and task.
    """
    known = labelled(documents, labels).where("label_lang is not null and length(text) > 40").select("doc_id", "label_lang", "text")
    chosen = materialize(sampled(known, sample).select("label_lang", "text"))
    size = F.broadcast(chosen.groupBy(F.col("label_lang").alias("lang")).agg(F.count("*").alias("size")))
    rate = unit_counts(chosen, "label_lang", "text").join(size, "lang").withColumn("rate", F.col("texts") / F.col("size"))
    kept = rate.withColumn("top", F.max("rate").over(Window.partitionBy("unit"))).where("rate >= 0.5 * top")

    def build(counts: DataFrame) -> Model:
        total: dict[str, np.ndarray] = {}
        for r in gram_vectors(counts).toLocalIterator():
            total[r.lang] = total.get(r.lang, 0) + np.asarray(r.grams)
        langs = sorted(total)
        return Model(langs, np.array([total[l] for l in langs]) if langs else np.zeros((0, BUCKETS)))

    shared = chosen.sparkSession.sparkContext.broadcast(build(kept))

    def make():
        m = shared.value

        def fn(cols):
            own: dict[str, list[str]] = {}
            for t, got in zip(cols[0], analyse_all(m, cols[0])):
                for a, b, l, p in (got or {"segments": ()})["segments"]:
                    if p > 0.9:
                        own.setdefault(l, []).append(plain(t[a:b]))
            units, out = Units(), []
            for l, some in own.items():
                tally = Tally(units)
                tally.add(some)
                out.extend((l, u, n) for u, _, n in tally.rows())
            return [[x[i] for x in out] for i in range(3)]

        return fn

    # one more step of expectation-maximisation over the sample: every segment teaches the language it was found to be in
    return build(map_batches(chosen.select("text"), make, "lang string, unit string, n bigint", rows=None).groupBy("lang", "unit").agg(F.sum("n").alias("n")))


def map_array(at: list[int], keys: list[str], items: list[int]) -> pa.Array:
    """``map<string,int>`` of the rows that end at ``at``."""
    return pa.MapArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys, pa.string()), pa.array(items, pa.int32())).cast(pa.map_(pa.string(), pa.int32()))


def segment_array(at: list[int], start: list[int], end: list[int], lang: list[str], sure: list[float]) -> pa.Array:
    """``array<struct<start,end,lang,confidence>>`` of the rows that end at ``at``."""
    fields = [("start", pa.array(start, pa.int32())), ("end", pa.array(end, pa.int32())), ("lang", pa.array(lang, pa.string())), ("confidence", pa.array(sure, pa.float64()))]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([a for _, a in fields], names=[n for n, _ in fields]))


RESULT = "doc_id bigint, label string, label_lang string, lang string, confidence double, whole map<string,int>, segments array<struct<start:int,end:int,lang:string,confidence:double>>"


def identify(documents: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row for each document: its label, what the label means, the language found with a confidence, and segments.

    ``whole`` counts the whole sentences of each language; ``segments`` are half-open offsets into ``text``. Defined
    cases: a NULL, empty or letterless text has a NULL language and no segments; an unknown label has a NULL
    ``label_lang``; documents that come twice are treated twice; with no usable label at all nothing can be fitted and
    every language is NULL; extra columns are not read.
    """
    model = model or fit(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def fn(cols):
            docs, labels, codes, texts = cols
            langs, sure = [], []
            whole, whole_at = ([], []), [0]
            parts, parts_at = ([], [], [], []), [0]
            for got in analyse_all(m, texts):
                got = got or {"lang": None, "confidence": None, "whole": {}, "segments": []}
                langs.append(got["lang"])
                sure.append(got["confidence"])
                whole[0].extend(got["whole"])
                whole[1].extend(got["whole"].values())
                for segment in got["segments"]:
                    for col, v in zip(parts, segment):
                        col.append(v)
                whole_at.append(len(whole[0]))
                parts_at.append(len(parts[0]))
            return [docs, labels, codes, langs, sure, map_array(whole_at, *whole), segment_array(parts_at, *parts)]

        return fn

    src = labelled(documents.select("doc_id", "lang", "text"), labels).select("doc_id", F.col("lang").alias("label"), "label_lang", "text")
    return map_batches(src, make, RESULT)


def label_issues(found: DataFrame) -> DataFrame:
    """``doc_id, issue``: ``missing``, ``wrong`` and ``mixed`` labels of ``identify``'s rows; texts without letters have none."""
    has = F.col("lang").isNotNull()
    missing = has & F.col("label_lang").isNull()
    wrong = has & F.col("label_lang").isNotNull() & F.when(F.size(F.map_keys("whole")) > 0, ~F.array_contains(F.map_keys("whole"), F.col("label_lang"))).otherwise(F.col("lang") != F.col("label_lang"))
    mixed = F.size(F.map_keys("whole")) > 1
    issues = F.filter(F.array(F.when(missing, F.lit("missing")), F.when(wrong, F.lit("wrong")), F.when(mixed, F.lit("mixed"))), lambda x: x.isNotNull())
    return found.select("doc_id", F.explode(issues).alias("issue"))
