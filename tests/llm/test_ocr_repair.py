import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pagemill.llm import furniture as N
from pagemill.llm import ocr_repair as O

WORDS = "management revenue partners distribution segment within precision optics business thousand amounted explained opening level energy storage compared reported quarterly custodian balance".split()


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_automaton_against_brute_force():
    rng = random.Random(1)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(200)}
    trie = O.build_trie(words)
    for _ in range(200):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
        assert sorted(O.intersect(trie, w)) == sorted(v for v in words if distance(v, w) <= 2)


def test_operations():
    assert O.operations("gcstor", "gestor") == [("c", "e")]
    assert O.operations("assinararn", "assinaram") == [("rn", "m")]
    assert O.operations("reveniie", "revenue") == [("ii", "u")]
    assert O.operations("feclio", "fecho") == [("li", "h")]
    assert O.operations("empresas", "empresa") is None
    assert O.operations("area", "área") is None


def test_keys_meet():
    rng = random.Random(3)
    for word in WORDS:
        for _ in range(20):
            i = rng.randrange(len(word))
            bad = word[:i] + rng.choice(["x", "rn", "ii"]) + word[i + 1 :]
            if len(bad) >= 5:
                assert set(O.keys_of(bad, False)) & set(O.keys_of(word, True)), (word, bad)


def test_keys_meet_for_two_letters():
    rng = random.Random(4)
    for word in [*WORDS, "four", "fives"]:
        for i in range(len(word)):
            for j in range(i):
                bad = "".join("@" if k in (i, j) else c for k, c in enumerate(word))
                assert O.operations(bad, word) and set(O.keys_of(bad, False)) & set(O.keys_of(word, True)), (word, bad)
        at = rng.randrange(len(word) - 1)
        for bad in (word[:at] + "0" + word[at + 2 :], word[:at] + "00" + word[at + 1 :]):
            if len(bad) >= O.SHORTEST:
                assert set(O.keys_of(bad, False)) & set(O.keys_of(word, True)), (word, bad)


def test_all_candidates_are_kept(spark):
    meant = {"elile": 900, "ciile": 800, "cllle": 700, "clilc": 600, "dile": 500, "chle": 400, "cliie": 300}
    words = spark.createDataFrame([("w", w, n) for w, n in {**meant, "clile": 1}.items()], "kind string, unit string, n bigint")
    row = O.word_fixes(words).where("read = 'clile'").first()
    assert sorted(m.meant for m in row.meant) == sorted(meant)
    fixer = O.Fixer([("w", "clile", "the", "and", [(m.meant, m.weight) for m in row.meant])])
    assert fixer.misread("the clile and the cliie of it")[0] == "the cliie and the cliie of it"


def two_errors(rng, word):
    """``word`` with two confusions anywhere in it."""
    i, j = sorted(rng.sample(range(len(word)), 2))
    return "".join(rng.choice("1ec0o5qx") if k in (i, j) else c for k, c in enumerate(word))


def test_retrieval_is_complete(spark, monkeypatch):
    """Every pair that brute force finds, whatever its two errors, in one part of a key or many."""
    rng = random.Random(6)
    known = {w: 1000 for w in [*WORDS, "investment", "four", "note", "notes", "annual"]}
    asking = {b: 1 for w in known for b in {two_errors(rng, w) for _ in range(25)} | {"invcstmcnt", "lnvestmenf", "ihvestmeht"} if b not in known}
    words = spark.createDataFrame([*known.items(), *asking.items()], "unit string, n bigint")
    want = {(a, w) for a in asking if len(a) >= O.SHORTEST for w in known if distance(a, w) <= O.DISTANCE and O.operations(a, w)}
    assert {("invcstmcnt", "investment"), ("lnvestmenf", "investment"), ("ihvestmeht", "investment")} <= want and len(want) > 400
    assert {(r.read, r.meant) for r in O.candidates(words).collect()} == want
    monkeypatch.setattr(O, "ASKING", 3)
    monkeypatch.setattr(O, "VOCABULARY", 2)
    assert {(r.read, r.meant) for r in O.candidates(words).collect()} == want


def test_context_ranks(spark):
    """Of two words that explain a misreading, the one that stands between such neighbours elsewhere is taken."""
    texts = ["they sent mail by post."] * 80 + ["they built the mall in town."] * 120
    texts += ["they sent ma1l by post.", "they built the ma1l in town.", "ma1l is what the mail is for."]
    a = spark.createDataFrame([(i, "d", 1, t) for i, t in enumerate(texts)], "page_id bigint, doc_id string, page_number int, raw_text string").withColumn("markdown", F.lit(None).cast("string"))
    m = spark.createDataFrame([], "doc_id string, repeated_texts array<string>")
    got = {r.page_id: r.text for r in O.repair(a, a.limit(0), m).collect()}
    assert [got[i] for i in (200, 201, 202)] == ["they sent mail by post.", "they built the mall in town.", "mail is what the mail is for."]


def test_misread_misreadings_are_no_words(spark):
    """A misreading seen often is a candidate only where nothing else is."""
    words = spark.createDataFrame([("w", "business", 90_000), ("w", "busincss", 40), ("w", "buslncss", 1)], "kind string, unit string, n bigint")
    got = {r.read: [m.meant for m in r.meant] for r in O.word_fixes(words).collect()}
    assert got == {"busincss": ["business"], "buslncss": ["business"]}


def test_trigrams():
    texts = ["甲乙丙乙丙", "", "a乙0丙x", "丙\ud800丙乙"]
    units, n = O._trigrams(texts)
    got = {chr(u >> 42) + chr(u >> 21 & 0x1FFFFF) + chr(u & 0x1FFFFF): k for u, k in zip(units.tolist(), n.tolist())}
    want = Counter(t[i : i + 3] for t in texts for i in range(len(t) - 2) if "一" <= t[i + 1] <= "鿿")
    assert got == want


def test_trigrams_take_runs_of_figures_as_one():
    units, n = O._trigrams(["第2018年", "第٣年", "第12", "3年"])
    assert [(chr(u >> 42) + chr(u >> 21 & 0x1FFFFF) + chr(u & 0x1FFFFF), k) for u, k in zip(units.tolist(), n.tolist())] == []
    units, n = O._trigrams(["1第20", "22第3", "5", "7第", "第8"])
    assert [(chr(u >> 42) + chr(u >> 21 & 0x1FFFFF) + chr(u & 0x1FFFFF), k) for u, k in zip(units.tolist(), n.tolist())] == [("0第0", 2)]


def test_sieves_are_asked_once_for_a_word():
    """However often a word stands in the texts; what is asked for is the same as before."""
    calls: Counter = Counter()

    class Counted(O.Sieve):
        def __call__(self, unit):
            calls[unit] += 1
            return unit in self.bits

    ask = O.Asker(Counted({"wreveniie", "hshort-term"}, 0), Counted({"fund", "found"}, 0), frozenset())
    text = "The Fund reveniie rose. The fund reveniie fell in a short-\nterm view, the FUND said. " * 20
    got = ask.prepare(text, 1)
    assert set(got[4]) == {("h", "short-term", "", ""), ("w", "reveniie", "fund", "rose"), ("w", "reveniie", "fund", "fell")}
    assert Counter(got[5]) == {("the", "fund"): 60, ("fund", "reveniie"): 40, ("fund", "said"): 20}
    words = Counter({u: k for u, k in calls.items() if u[0] != "h"})
    assert max(words.values()) <= 3, words  # once for each way it is written: fund, Fund, FUND


def test_patterns_scanned_by_their_first_characters():
    rng = random.Random(6)
    letters = O._L
    word = re.compile(rf"[{letters}]+(?:[0-9@|!$][{letters}]*)*|(?<![0-9{letters}.,])[0-9@|!$][{letters}]{{3,}}")
    noise = re.compile("[\x80-\x9f\ufffd]|[ÃÂĂĹ√Γ├┬╨╤][^\x00-\x7f]|[âÄ‚Г][\x80-\x9f€™…†‡ƒÄÇÖæ∂╗║╝░▒▓⌐½¼\xa0-¿]")
    for _ in range(3000):
        t = "".join(rng.choices("abAÀяЯ中0@|!$., \n19OlÃÂâ‚Г\x85\ufffd€½年%é√\xa0", k=40))
        assert [m.span() for m in O._WORD.finditer(t)] == [m.span() for m in word.finditer(t)]
        assert [m.span() for m in O._NOISE.finditer(t)] == [m.span() for m in noise.finditer(t)]


def test_figures():
    read = lambda t: O.read_figures(t, [])[0]
    assert read("计O年、b3万元、I2月") == "计0年、63万元、12月" and read("1O,5S4 and 2O18") == "10,554 and 2018"
    assert read("请求号：b99d80e5fa") == "请求号：b99d80e5fa" and read("编号：S3cret") == "编号：S3cret"


def test_sieve(spark):
    units = [f"w{i}" for i in range(3000)]
    s = O.sieve(spark.createDataFrame([(u,) for u in units], "u string"), "u")
    assert all(map(s, units)) and sum(s(f"x{i}") for i in range(3000)) < 10
    assert not O.sieve(spark.createDataFrame([], "u string"), "u")("w")


def test_numbers():
    for t in ("- 9 -", "p. 9", "[9]", "Page 9", "第 9 页", "— 9 —", "9 / 12", "·9·", "第9页 共12页", "Página 9 / 12"):
        assert N.is_number_line(t, 9), t
    assert N.is_number_line("9", 9) and not N.is_number_line("9", 8) and not N.is_number_line("2019 was good", 9)
    assert N.is_header_line("Brin SA Relatório anual 2017 · 5", 5, set()) and N.is_header_line("X LTD ANNUAL REPORT 2018\t6", 6, set())
    assert N.is_header_line("某公司2022年度报告  - 2 -", 2, set())
    for t in ("净利润  19,388    45.4%", "as explained in note 5", "Harl Capital · 2019", "revenue  12  5", "| a | 5"):
        assert not N.is_header_line(t, 5, set()), t


def corpus(spark, extra):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        text = " ".join(rng.choices(WORDS, k=40)) + ".\n投资组合的净利润较期初略有上升，相关款项已于5月到账，账面成本为3万元。"
        rows.append((i, f"d{i}", 1, text))
    for t in ("mana9ement", "manaqement", "managcment", "rcvenue", "thoiisand", "pr0gress"):
        rows.append((500 + len(rows), "d0", 1, f"within {t} segment business level."))
    first = 10_000
    rows += [(first + i, "d0", p, t) for i, (p, t) in enumerate(extra)]
    analysis = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, doc_id string, page_number int, raw_text string, text string")
    pages = analysis.withColumnRenamed("raw_text", "markdown").limit(0)
    manifest = spark.createDataFrame([("d0", ["第 3 页", "页眉"])], "doc_id string, repeated_texts array<string>")
    return {r.page_id - first: r for r in O.repair(analysis, pages, manifest).collect() if r.page_id >= first}


CASES = [
    (1, "within the seg-\nment business level."),
    (1, "within the segment busincss level."),
    (4, "within the segment business level.\n- 4 -"),
    (3, "within the segment business level.\n第 3 页"),
    (1, "within the segment business level."),
    (1, ""),
    (1, None),
    (None, "amounted to 1O,5S4 thousand\nin 2O18."),
    (1, "投资组合的净利润较期初略冇上升，相关款项已干5月到账，账面成本为3万兀。"),
    (1, "Reference 77087922b2 within the segment."),
    (1, "Gegen\u0102\u013dber 2020, prime\u00ad\nr\u0102\u013d within the segment business level."),
    (2, "Long text within the segment business level " * 3000 + "."),
    (1, "Gegen\u0102\u013dber within the seg\u00ad\nment busincss level."),
    (1, "В сегм\u00ad\nенте и по дан¬\nным управляющего."),
]


def test_repair(spark, monkeypatch):
    # confusions of characters must be seen between several neighbours before they are believed
    shown = [(1, f"投资组合的净利润较期初略冇上升，账面成本为{i}万兀，相关款项已干{i}月到账。") for i in range(2)]
    got = corpus(spark, CASES + shown)
    assert got[0].joined == 1 and got[0].text.startswith("within the segment")
    assert got[1].misread == 1 and "business" in got[1].text
    assert got[2].furniture == 1 and "4" not in got[2].text
    assert got[3].furniture == 0 and "第 3 页" not in got[3].text
    assert (got[4].joined, got[4].misread, got[4].furniture) == (0, 0, 0)
    assert 5 not in got and 6 not in got
    assert got[7].misread == 2 and "10,554 thousand in 2018" in got[7].text
    assert got[9].misread == got[10].misread == got[10].joined == got[11].misread == 0
    # wrongly decoded tokens are left alone, the rest of their page is not
    assert (got[12].joined, got[12].misread, got[12].text) == (1, 1, "Gegen\u0102\u013dber within the segment business level.")
    assert (got[13].joined, got[13].text) == (2, "В сегменте и по данным управляющего.")
    # a sieve that lets nearly everything pass changes nothing
    text = lambda rows: {k: (r.text, r.joined, r.misread, r.furniture) for k, r in rows.items()}
    monkeypatch.setattr(O, "SIEVE_MOST", 64)
    assert text(corpus(spark, CASES + shown)) == text(got)


def test_running_headers(spark):
    cases = [(p, f"within the segment business level.\n{h}") for p, h in [(2, "ACME LTD ANNUAL REPORT 20L9 | 2"), (3, "Operating review of Acme · 3"), (4, "Operating review of Acme · 4"), (5, "Operating review of Acme"), (6, "Operating revicw of Acme | 6"), (7, "busincss 2018 outlook · 7"), (8, "Operating review of Acme - 9"), (9, "Risk outlook · 9"), (10, "Operating review of Acme · lO"), (1, "Operating review of Acme")]]
    got = corpus(spark, cases)
    assert [got[i].furniture for i in range(10)] == [1, 1, 1, 1, 0, 1, 0, 0, 1, 0]
    assert all(got[i].text == "within the segment business level." for i in (0, 1, 2, 3, 5, 8)) and "Acme" in got[9].text
    assert N.is_header_line("某公司20LB年度报告 | 1 / 5", 1, set()) and not N.is_header_line("Zoll · 5", 5, set())


def test_reflow():
    text = "A first line of running text that goes on\nand ends here.\nA second paragraph starts here and goes\non to its end.\n\n- item\n| a | b |\n| --- | --- |"
    assert O.reflow(text).split("\n\n")[0] == "A first line of running text that goes on and ends here."
    assert "| a | b |\n| --- | --- |" in O.reflow(text)
    assert O.reflow("") == ""
    assert O.reflow("投资合计39.2\n4万元，占认缴规模的57\n.08%，其中17,\n775万元由Annual\nReport列示，截至201\n8年度末。") == "投资合计39.24万元，占认缴规模的57.08%，其中17,775万元由Annual Report列示，截至2018年度末。"
    assert O.reflow("Revenue of the fund in\n2018 grew by 5\npercent.") == "Revenue of the fund in 2018 grew by 5 percent."
    # a line that grew with a joined word does not make titles of the others
    grown = "Words of the first line and of the second that moved up with its begin\nning of the third\nline as they were set."
    assert O.reflow(grown, 30).count("\n\n") == 0 and O.line_width("# a long heading is no measure\nshort line") == 10
    assert O.reflow("本期共计三十万\n元，同比增长。") == "本期共计三十万元，同比增长。"


def test_empty(spark):
    a = spark.createDataFrame([], "page_id bigint, doc_id string, page_number int, raw_text string, markdown string")
    m = spark.createDataFrame([], "doc_id string, repeated_texts array<string>")
    assert O.repair(a, a, m).count() == 0
