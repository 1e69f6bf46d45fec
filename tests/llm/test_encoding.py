import math
from collections import Counter

import pytest

from pagemill.llm.encoding import CYRILLIC, Restorer, restore_text, shares, units

ZH = "根据管理人提供的资料，基金持有医疗科技股份有限公司的股权，账面成本为一千万元，较期初略有上升。投资组合的净利润同比增长，相关款项已于五月到账，差异已在附注中说明。"
COUNT = Counter(ZH * 900 + "éàçãõ’–“”·龘")
FREQ = {c: math.log(n / sum(COUNT.values())) for c, n in COUNT.items() if c > "\x7f"}
R = Restorer(FREQ)


@pytest.mark.parametrize("codec", ["latin-1", "cp1251", "gb18030", "cp437", "koi8_r", "cp866"])
def test_chinese_utf8(codec):
    bad = ZH.encode().decode(codec, "replace")
    out, spans, lost = R.restore("前文。\n" + bad)
    assert spans > 0
    if "�" not in bad:
        assert out == "前文。\n" + ZH and lost == 0


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1250", "mac_roman", "cp850"])
def test_french_utf8(codec):
    text = "Après examen du gérant, l’année écoulée a été précisée – comme prévu."
    try:
        bad = text.encode().decode(codec)
    except UnicodeDecodeError:
        pytest.skip("bytes the codec has no characters for")
    assert R.restore(bad)[0] == text


@pytest.mark.parametrize("codec, text", [("cp1250", "L'Activité de 2013."), ("mac_roman", "o exercício de 2013"), ("cp437", "a manqué de 1,6"), ("cp850", "el año 2013"), ("cp1251", "el año 2013"), ("mac_roman", "a évolué à peine")])
def test_one_or_two_accents(codec, text):
    assert R.restore(text.encode().decode(codec))[0] == text


@pytest.mark.parametrize("text", ["— «État»", "—À la une", "АО «СССР» и ГРУПП»", "MÓ» ÁREA – É", "├── été", "все её лицё", "société»”"])
def test_short_runs_that_are_sound(text):
    model = Restorer({c: math.log(n / 5000) for c, n in Counter((RU + "État à é") * 20).items() if c > "\x7f"})
    assert R.restore(text) == model.restore(text) == (text, 0, 0)


def test_gb_as_latin_and_twice():
    assert R.restore(ZH.encode("gb18030").decode("latin-1"))[0] == ZH
    twice = ZH.encode().decode("latin-1").encode().decode("latin-1")
    assert R.restore(twice)[0] == ZH
    assert R.restore("As participaÃƒÂ§ÃƒÂµes")[0] == "As participações"


def test_short_stretch_beside_chinese():
    assert R.restore("职业教育贡" + "献了".encode("gb18030").decode("latin-1") + "54.0%")[0] == "职业教育贡献了54.0%"
    assert R.restore("«Él ¿ªº?»") == ("«Él ¿ªº?»", 0, 0)


RU = "Примечания: компания открыла дочерние общества, что немного выше начального уровня."
JA = "ファンドの売上高は予算を下回りましたので、詳しくは注記をご覧ください。"


RUSSIAN = Restorer(shares({c: n for c, n in units([RU] * 40 + [RU.upper(), "В 2017 году показатель «выручка» вырос на 44,04 %. " * 20, "État à é"]).items() if len(c) == 2 or c > "\x7f"}))


@pytest.mark.parametrize("read, true", CYRILLIC)
def test_cyrillic(read, true):
    bad = RU.encode(true).decode("cp1252" if read == "latin" else read, "replace")
    out, spans, _ = RUSSIAN.restore(bad)
    # through a western encoding, bytes from 0x80 to 0xBF look like Chinese too: found, and read as that first
    assert spans and ((read, true) in (("latin", "cp866"), ("latin", "iso8859_5")) or sum(a == b for a, b in zip(out, RU)) >= 0.97 * (len(RU) - bad.count("�")))
    assert RUSSIAN.restore(RU) == (RU, 0, 0) and RUSSIAN.restore(RU.upper()) == (RU.upper(), 0, 0)


def test_cyrillic_spans_only():
    swap = lambda t: t.encode("koi8_r").decode("cp1251")
    mixed = RU + " " + swap("открыла дочерние общества, что") + " немного выше. " + RU
    assert RUSSIAN.restore(mixed)[0] == RU + " открыла дочерние общества, что немного выше. " + RU
    assert RUSSIAN.restore("компания открыла доч" + swap("ерние") + " общества")[0] == "компания открыла дочерние общества"
    assert RUSSIAN.restore("«ТАШСУНА» ГОДОВОЙ ОТЧЁТ 2016 · 2")[1] == 0


@pytest.mark.parametrize("layers", [1, 2, 5, 7, 9])
def test_any_number_of_layers(layers):
    text = "As participações"
    for _ in range(layers):
        text = text.encode().decode("latin-1")
    assert R.restore(text)[0] == "As participações"


def test_short_spans():
    assert R.restore("Fees were Γé¼41 per unit.")[0] == "Fees were €41 per unit."
    assert R.restore("El ├ímbito de")[0] == "El ámbito de"
    assert R.restore("医疗光电å®ž\n现收益政策ã€‚\n投资")[0] == "医疗光电实\n现收益政策。\n投资"


@pytest.mark.parametrize("read", ["cp950", "cp949"])
def test_gb_span_within_chinese(read):
    """The span's ends are found within one unbroken run."""
    rare = Restorer(shares({**{c: n for c, n in COUNT.items() if c > "\x7f"}, **dict.fromkeys("瞳薹蚕惆", 1)}))
    before, span, after = "基金持有医疗科技的", "净利润同比增长相关款项", "已于五月到账"
    bad = before + span.encode("gb18030").decode(read, "replace") + after
    out, spans, _ = rare.restore(bad)
    assert spans and ("�" in bad or out == before + span + after)


def test_japanese():
    assert R.restore("前" + JA.encode("cp932").decode("cp1252", "replace"))[1] > 0
    part = "となりました"
    assert R.restore("粗利率は90万円" + part.encode().decode("cp932", "replace") + "。")[1] > 0
    assert R.restore(JA.encode("euc_jp").decode("latin-1"))[0] == JA
    assert R.restore(JA) == (JA, 0, 0)


def test_gb_as_big5():
    run = "投资组合的净利润同比增长"
    bad = run.encode("gb18030").decode("cp950", "replace")
    out, spans, _ = R.restore(bad)
    assert spans and ("�" in bad or out == run)


def test_lost():
    assert R.restore("Activit� de la soci�t�") == ("Activit� de la soci�t�", 0, 3)


@pytest.mark.parametrize("text", ["", "plain", ZH, "PREVISÃO DA Lda – « Été » à 5 %", "В 2017 году показатель «выручка» вырос на 44,04 %.", "睡睢督睤睥睦睧睨" * 4, "ＦＵＬＬ　ｗｉｄｔｈ", "年度报告 · 2020", "«“thé”»"])
def test_untouched(text):
    assert R.restore(text) == (text, 0, 0)


def test_line_ends():
    bad = ZH.encode().decode("latin-1")
    broken = bad[:40] + "\n" + bad[40:]
    assert R.restore(broken)[0].replace("\n", "") == ZH


def test_frame(spark):
    rows = [(1, ZH.encode().decode("latin-1")), (2, ZH), (3, None), (4, ""), (None, ZH), (1, ZH.encode().decode("latin-1")), (5, ZH * 500)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id bigint, raw_text string, lost int")
    got = sorted(((r.page_id, r.restored, r.spans > 0) for r in restore_text(df, "page_id", "raw_text").collect()), key=str)
    assert got == sorted([(1, ZH, True), (1, ZH, True), (2, ZH, False), (3, None, False), (4, "", False), (None, ZH, False), (5, ZH * 500, False)], key=str)
    assert restore_text(df.limit(0), "page_id", "raw_text").count() == 0
