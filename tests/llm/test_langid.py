import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import langid as L

SENTENCES = {
    "en": ["The fund reported revenue of {} thousand in the year.", "Within the energy segment, the partners approved the exit plan {}.", "Management fees accrued quarterly amounted to {} thousand."],
    "fr": ["Le fonds a enregistré un chiffre d’affaires de {} milliers d’euros.", "Dans le secteur de l’énergie, les associés ont approuvé le plan de cession {}.", "Les frais de gestion du trimestre ont atteint {} milliers d’euros."],
    "pt": ["O fundo registou receitas de {} milhares de euros no exercício.", "Na área de energia, os sócios aprovaram o plano de saída {}.", "As comissões de gestão do trimestre somaram {} milhares de euros."],
    "es": ["El fondo registró ingresos por {} miles de euros en el ejercicio.", "En el ámbito de energía, los socios aprobaron el plan de salida {}.", "Las comisiones de gestión del trimestre sumaron {} miles de euros."],
    "zh": ["基金本年度实现营业收入{}万元，同比增长。", "就能源板块而言，合伙人会议审议通过了第{}号退出方案。", "管理费按季度计提，本期共计{}万元。"],
    "ja": ["ファンドの当期の売上高は{}万円となりました。", "エネルギーの分野では、組合員の会議で第{}号の計画が承認されました。", "管理報酬は四半期ごとに計上し、当期は{}万円です。"],
    "ru": ["Фонд получил выручку {} тыс. рублей за год.", "В сегменте энергетики участники одобрили план выхода {}.", "Плата за управление за квартал составила {} тыс. рублей."],
}
LABELS = [(c, c) for c in SENTENCES] + [("English", "en")]


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    say = lambda l: rng.choice(SENTENCES[l]).format(rng.randint(1, 9999))
    out = []
    for i in range(n * len(SENTENCES)):
        lang = list(SENTENCES)[i % len(SENTENCES)]
        label = lang if rng.random() > 0.1 else rng.choice(list(SENTENCES))
        out.append((i, label, lang, " ".join(say(lang) for _ in range(rng.randint(2, 6)))))
    return out, say


@pytest.fixture(scope="module")
def fitted(spark):
    docs, say = corpus()
    df = spark.createDataFrame([(i, l, t) for i, l, _, t in docs], "doc_id bigint, lang string, text string")
    labels = spark.createDataFrame(LABELS, "label string, lang string")
    return L.fit(df, labels), labels, say


def test_held_out(fitted):
    model, _, _ = fitted
    docs, _ = corpus(20, seed=9)
    hits = [L.analyse(model, t)["lang"] == lang for _, _, lang, t in docs]
    assert np.mean(hits) >= 0.99


def test_mixed(fitted):
    model, _, say = fitted
    for a, b in (("en", "zh"), ("es", "pt"), ("fr", "en"), ("zh", "ja"), ("ru", "en")):
        text = " ".join(say(a) for _ in range(4)) + "\n\n" + say(b)
        got = L.analyse(model, text)
        assert set(got["whole"]) == {a, b} and got["lang"] == a, (a, b, got)
        assert [s[2] for s in got["segments"]] == [a, b]
        assert all(0 < s[3] <= 1 for s in got["segments"])


def test_texts_read_at_once_are_as_alone(fitted):
    """What stands in one text, a separator or an open marker included, changes nothing in its neighbours."""
    model, _, say = fitted
    texts = [None, "", say("en") + "\n\n ", "\x01", say("zh") + "<!-- ", "中", say("ru") + "\x01" + say("ja"), "# " + say("es") + "\n- " + say("pt"), "12,5 | x\x01", say("fr") + " " + say("zh") + "。” "]
    texts += [say(l) * k for l in SENTENCES for k in (1, 3)]
    at_once = L.analyse_all(model, texts)
    assert at_once == [L.analyse(model, t) for t in texts]
    assert at_once[2]["segments"][-1][1] == len(texts[2]) - 1 and at_once[0] is at_once[1] is at_once[3] is None
    few = max(map(len, filter(None, texts))) + 1
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(L, "TOGETHER", few)
        assert L.analyse_all(model, texts) == at_once


def test_units_are_counted_by_text_and_by_occurrence():
    units = L.Units()
    units.held[:] = -1  # every place is another code's at first
    tally = L.Tally(units)
    tally.add(map(L.plain, ["The the FUND", "**fund** 基金基金 a中b", "基金<!-- the -->", ""]))
    assert sorted(tally.rows()) == [("a", 1, 1), ("b", 1, 1), ("fund", 2, 2), ("the", 1, 2), ("中", 1, 1), ("基金", 2, 3), ("金基", 1, 1)]


def test_terms_do_not_mix(fitted):
    model, _, say = fitted
    assert set(L.analyse(model, say("zh") + "该指标（Adjusted Cash Yield）未经审计。")["whole"]) == {"zh"}
    assert L.analyse(model, "12,5 % | 2020") is None and L.analyse(model, None) is None


def test_issues(spark, fitted, rows):
    model, labels, say = fitted
    two = say("en") + " " + say("en") + "\n" + say("fr")
    data = [(1, "en", say("en")), (2, "fr", say("en")), (3, None, say("en")), (4, " ", say("fr")), (5, "und", say("pt")), (6, "English", two), (7, None, ""), (8, None, None), (9, "xx", "123 456"), (10, "pt", two), (1, "en", say("en"))]
    df = spark.createDataFrame([(*d, "x") for d in data], "doc_id bigint, lang string, text string, confidence string")
    found = L.identify(df, labels, model)
    assert rows(L.label_issues(found)) == sorted([(2, "wrong"), (3, "missing"), (4, "missing"), (5, "missing"), (6, "mixed"), (10, "mixed"), (10, "wrong")], key=repr)


def test_confidence(fitted):
    model, _, say = fitted
    k = len(model.langs)
    tie = np.full((1, k), -10.0) - 0.001 * np.arange(k)
    assert abs(L.certainty(tie, 0) - 1 / k) < 0.01 and abs(L.certainty(np.array([[-10.0, -10.0, -90.0]]), 0) - 0.5) < 0.01
    assert L.certainty(np.array([[-10.0, -1000.0], [0.0, -5.0]]), 1) >= 0.0
    # what two languages share leaves both open, and more text settles it
    short = L.analyse(model, "plan")["confidence"]
    assert short < 0.9 < L.analyse(model, say("pt"))["confidence"] <= 1.0


def test_confidence_is_calibrated(fitted):
    """Words of held-out texts: those given about the same confidence are right about as often."""
    model, _, _ = fitted
    docs, _ = corpus(40, seed=11)
    got = [(r["confidence"], r["lang"] == lang) for _, _, lang, t in docs for w in set(L._RUN.findall(t)) if (r := L.analyse(model, w))]
    sure, right = (np.array(x, float) for x in zip(*got))
    apart = sum(abs(sure[m].mean() - right[m].mean()) * m.mean() for lo in np.arange(0, 1, 0.1) for m in [(sure > lo) & (sure <= lo + 0.1)] if m.any())
    assert apart < 0.1 and abs(sure.mean() - right.mean()) < 0.1, (apart, sure.mean(), right.mean())


def test_sample_without_exchange(spark):
    rows = [(i, "en" if i % 50 else "fr", "x") for i in range(6000)] + [(i, "de", "x") for i in range(6000, 6030)]
    known = spark.createDataFrame(rows, "doc_id bigint, label_lang string, text string")
    got = {r.label_lang: r.n for r in L.sampled(known, 300).groupBy("label_lang").agg(F.count("*").alias("n")).collect()}
    assert got["de"] == 30 and got["fr"] == 120 and 240 < got["en"] < 360
    assert "Exchange hashpartitioning" not in L.sampled(known, 300).select("text")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_mixture():
    ll = np.log(np.array([[0.9, 0.1], [0.8, 0.2], [0.85, 0.15]])) * 50
    shares, post = L.mixture(ll)
    assert shares.tolist() == [1.0, 0.0] and post[:, 0].min() == 1.0
    ll[2] = ll[2][::-1]
    shares, post = L.mixture(ll)
    assert abs(shares[1] - 1 / 3) < 0.05 and post[2, 1] > 0.99


def test_nothing_to_fit(spark):
    df = spark.createDataFrame([(1, None, "some text of no known language label at all, long enough")], "doc_id bigint, lang string, text string")
    labels = spark.createDataFrame(LABELS, "label string, lang string")
    assert L.identify(df, labels).first().lang is None
    assert L.identify(df.limit(0), labels).count() == 0
