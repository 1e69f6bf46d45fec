from pyspark.sql import functions as F

from pagemill.functions import quality as Q
from pagemill.functions import tables as TB
from pagemill.functions import text as TX
from pagemill.operators.line_tables import align_pipe_tables, plain_tables


def one(spark, expr, **values):
    cols = [F.lit(v).alias(k) if not isinstance(v, list) else F.lit(None).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(expr.alias("x")).first().x


def cells(spark, data, expr):
    return spark.createDataFrame([(data,)], "c array<array<string>>").select(expr(F.col("c")).alias("x")).first().x


def test_markers(spark):
    t = "前言\n<!-- page:12 method:native-coords -->\n一、概述\n<!-- page:13 -->\n<!-- not a page:14 -->末行"
    out = one(spark, TX.strip_markers("t"), t=t)
    assert out == "前言\n一、概述\n<!-- not a page:14 -->末行" == one(spark, TX.strip_markers("t"), t=out)
    made = one(spark, TX.page_marker(F.lit(1024), F.lit("native-fallback")))
    assert made == "<!-- page:1024 method:native-fallback -->" and one(spark, TX.strip_markers("t"), t=made + "\nx") == "x"
    assert one(spark, TX.page_file(F.lit(41))) == "041.md" and one(spark, TX.page_file(F.lit(1205))) == "1205.md"
    assert one(spark, TX.embedded_image_name(F.lit(3), F.lit(11), F.lit("jpeg"))) == "page-003-img-11.jpeg"
    assert one(spark, TX.embedded_image_name(F.lit(3), F.lit(1), F.lit(None).cast("string"))) == "page-003-img-01.png"
    assert one(spark, TX.debug_name(F.lit(8), F.lit("native.md"))) == "page-008.native.md"


def test_garbled(spark):
    f = Q.is_garbled("t")
    # eight characters make up more than two fifths of the Chinese ones, and there are no figures
    assert one(spark, f, t="风云山海" * 12 + "投资组合") is True
    assert one(spark, f, t="风云山海" * 12 + "投资组合" + "31415926") is False
    assert one(spark, f, t="储能电站全年发电三百万度，较去年多出一成，运行平稳，未见停机，检修按季进行，备件充足，人员到位。") is False
    assert one(spark, f, t="风云山海风云") is False  # too short to tell
    assert [one(spark, f, t="睡" * n + "plain english text with no figure at all") for n in (4, 5)] == [False, True]
    assert spark.sql("select cast(null as string) t").select(f.alias("x")).first().x is False


def test_heading_levels(spark):
    level = lambda size, body: one(spark, TB.heading_level(F.lit(float(size)), F.lit(float(body))))
    # at the borders of each level, for two body sizes
    assert [level(s, 10) for s in (18.0, 17.9, 14.0, 13.9, 11.5, 11.4)] == [1, 2, 2, 3, 3, 0]
    assert [level(s, 8.5) for s in (40, 12, 10, 8.5, 1)] == [1, 2, 3, 0, 0]
    assert level(30, 0) == level(30, -1) == 0


def test_table_markup(spark):
    md = cells(spark, [["季度", "收入", "成本"], ["一", "71", "38"], ["二", "82", "41"]], TB.table_markup)
    assert md.split("\n") == ["| 季度 | 收入 | 成本 |", "| --- | --- | --- |", "| 一 | 71 | 38 |", "| 二 | 82 | 41 |"]
    # three of ten cells empty are too many for pipes, two of nine are not
    sparse = [["指标", "本年"], ["毛利率", None], ["净利率", " "], ["周转率", ""], ["负债率", "4%"]]
    assert cells(spark, sparse, TB.table_markup).count("<td></td>") == 3
    assert cells(spark, [["指标", "本年", "上年"], ["毛利率", None, " "], ["净利率", "9%", "8%"]], TB.table_markup).startswith("| 指标 |")
    assert cells(spark, [["独", "行"]], TB.table_markup).split("\n")[3:5] == ["      <th>独</th>", "      <th>行</th>"]
    assert cells(spark, [], TB.table_markup) == cells(spark, [[], []], TB.table_markup) == ""
    ragged = cells(spark, [["p", "q", "r"], ["s"], ["t", "u"]], TB.table_markup)
    assert ragged.count("<td>") == 6 and ragged.endswith("  </tbody>\n</table>")
    assert cells(spark, [["x\ny", " z\t"], ["1", "2"]], TB.table_markup).startswith("| x<br>y | z |")


def test_cells(spark):
    f = lambda l: one(spark, TB.line_cells(F.col("l")), l=l)
    assert f("a\t\tb ") == ["a", "", "b"]
    assert f("  a  b　　c d ") == ["a", "b", "c d"]
    assert f("") == []
    like = lambda t: one(spark, TB.is_cell_like(F.col("t")), t=t)
    assert all(map(like, ("3.3x", "Q1", "-1,234.5%", "abcdefghij", "净利润", "2024E")))
    assert not any(map(like, ("", "  ", "abcdefghijk", "two words")))


def test_plain_tables(spark):
    f = lambda t: one(spark, plain_tables(F.col("t")), t=t)
    two = "项目  本期  上期\n利润  1  2"
    assert f(two) == two
    three = "前言\n" + two + "\n\n收入  3  4\n后记"
    assert f(three) == "前言\n| 项目 | 本期 | 上期 |\n| --- | --- | --- |\n| 利润 | 1 | 2 |\n| 收入 | 3 | 4 |\n后记"
    assert f("# a  b  c\n" + two) == "# a  b  c\n" + two
    assert f("a  b  c\nd  e\nf  g  h").split("\n")[2] == "| d | e |  |"
    assert f("") == ""


def test_pipe_tables(spark):
    f = lambda t, **k: one(spark, align_pipe_tables(F.col("t"), **k), t=t)
    assert f("| a | b |\n|---|---|\n| 1 | 2 | 3 |") == "| a | b |  |\n| --- | --- | --- |\n| 1 | 2 | 3 |"
    assert f("| a ||\n|---|\n| 1 |") == "| a |\n| --- |\n| 1 |"
    assert f("| x |\n| a | b |\n|---|---|\n| 1 |").split("\n")[0] == "| x |"
    overwritten = "| a | b |\n|  | x |\n| 1 | 2 |"
    assert f(overwritten).split("\n")[1] == "| --- | --- |"
    assert f(overwritten, strict=True) == overwritten
    done = f("| a | b |\n|---|---|\n| 1 | 2 | 3 |")
    assert f(done) == done


def test_years(spark):
    f = lambda t: one(spark, TX.mark_cut_years("t"), t=t)
    assert f("（201 年 5 月）") == "（201? 年 5 月）"
    assert f("于201 年 5 月") == "于201 年 5 月"
    assert f("2019 年 5 月") == "2019 年 5 月"


def test_conversion_warnings(spark):
    def f(source, result):
        return spark.createDataFrame([(source, result)], "s string, r string").select(Q.conversion_warnings(F.col("s"), F.col("r")).alias("w")).first().w

    mark = "<!-- page:7 method:vision -->\n"
    # just below and at three tenths of 210 characters; the marker is not counted
    assert f(mark + "文" * 210, "字" * 62) == ["输出长度(62)不足源文本(210)的30%，可能有大量内容丢失"]
    assert f(mark + "文" * 210, "字" * 63) == f("文" * 200, "字") == f("", "") == []
    assert f("  " + "w " * 300, "\n") == ["输出长度(0)不足源文本(599)的30%，可能有大量内容丢失"]
    assert [f("", "睢" * n) for n in (5, 6)] == [[], ["输出中检测到 6 个疑似乱码字符"]]
    assert len(f("文" * 400, "睥" * 9)) == 2


def test_page_warnings(spark):
    def f(md, method, tables=False, body=None, raw=""):
        df = spark.createDataFrame([(md, method, tables, body, raw)], "m string, k string, t boolean, b string, r string")
        return df.select(Q.page_warnings(F.col("m"), F.col("k"), F.col("t"), F.col("b"), F.col("r")).alias("w")).first().w

    shell = "<table><thead><tr><th>a</th></tr></thead><tbody>\n</tbody></table>"
    assert any("表格" in w for w in f(shell, "native", True))
    assert f(shell, "vision", True) == []
    assert f(None, "native") == [Q.EMPTY_OUTPUT] == f("<!-- page:1 method:native -->\n  ", "vision")
    assert f("\n".join("短行%d" % i for i in range(9)), "native") == [Q.SHORT_LINES]
    assert f("\n".join("|短行%d" % i for i in range(9)), "native") == []
    assert f("x", "vision", body="", raw="长" * 300)[0].startswith("输出长度(1)不足源文本(300)")


def test_listed(spark):
    def f(expr, t, raw, listed):
        return spark.createDataFrame([(t, raw, listed)], "t string, raw string, l array<string>").select(expr.alias("x")).first().x

    strip = TX.strip_listed(F.col("t"), F.col("l"))
    assert f(strip, "页眉甲\n正文\n页眉", "", ["页眉", "页眉甲"]) == "正文"
    assert f(strip, " a ", "", None) == "a"
    back = TX.reinsert_listed(F.col("t"), F.col("raw"), F.col("l"))
    assert f(back, "正文", "头 脚部", ["头", "脚部", "无"]) == "头\n\n脚部\n\n正文"


def test_images_and_urls(spark):
    df = spark.createDataFrame([("a <!-- IMG_OCR:xref-1 --> <!-- IMG_OCR:xref-12 -->", {"xref-1": "one", "xref-12": None})], "m string, i map<string,string>")
    assert df.select(TX.fill_images(F.col("m"), F.col("i")).alias("x")).first().x == "a one [图片识别失败]"
    assert one(spark, TX.asset_refs("t"), t="![](a.png) [x](y) ![b](c/d.png)") == ["a.png", "c/d.png"]
    url = spark.createDataFrame([(bytearray(b"x" * 200),)], "b binary").select(TX.data_url(F.col("b")).alias("u"))
    assert "\n" not in url.first().u
    assert bytes(url.select(TX.data_url_bytes(F.col("u")).alias("b")).first().b) == b"x" * 200


def test_order_of_cells(spark):
    def f(text, table):
        return spark.createDataFrame([(text, table)], "t string, c array<array<string>>").select(TB.order_is_reliable(F.col("t"), F.col("c")).alias("x")).first().x

    assert f("甲 乙 丙", [["甲\n乙"]]) is True
    assert f("甲 乙 丙", [["乙\n甲"]]) is False
    assert f("甲 乙 丙", [["无\n甲"], ["甲"], [None]]) is True
    assert f("甲 乙 丙", [["乙\n无\n甲"]]) is False
