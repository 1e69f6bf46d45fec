from pagemill.llm import truncation as T

P = "page_id bigint, source string, page_number int, markdown string, reason string"
M = "<!-- page:1 method:native -->\n"


def test_tails():
    state = lambda t, p=None: T.tail(M + t, p)[:2]
    assert state("Ends well.") == ("complete", "")
    assert state("Ends mid sen") == ("open", "sen")
    assert state("经营现金") == ("sentence", "^ 经营现") and state("他们") == ("sentence", "")
    assert state("cut …")[0] == state("cut [...]")[0] == state("字符被切�")[0] == "marker"
    assert state("| a | b |\n| --- | --- |\n| 1 | 2 |")[0] == "complete"
    assert state("| a | b |\n| --- | --- |\n| 1 | ")[0] == "table"
    assert state("<table><tr><td>1</td></tr></table>")[0] == "complete"
    assert state("<table><tr><td>1</td></tr>")[0] == "table"
    assert state("text\n7", 7)[0] == "complete" and state("text\n7", 8)[0] == "figure"
    assert state("[空白页]")[0] == state("")[0] == "complete"
    assert state("X9" * 50)[0] == "blob"
    assert state("# Heading wor") == ("heading", "wor")


def pages(spark, rows):
    return spark.createDataFrame([(i, s, 1, t, "x") for i, (s, t) in enumerate(rows)], P)


def test_cut_texts(spark):
    words = "The management of the company reported revenue and distributions to its partners in the year. "
    rows = [("a", M + words * (3 + i % 4)) for i in range(40)]
    rows += [("a", M + words + "The partners approved the distrib"), ("a", None), ("a", ""), (None, M + words + "The manag"), ("a", M + words + "\n# Revenue and distributions"), ("a", M + words + "\n# Revenue and distribu")]
    limit = (M + words * 9)[:480]
    rows += [("b", limit)] * 6 + [("b", M + words)] * 3
    got = {r.page_id: r.reason for r in T.cut_texts(pages(spark, rows)).collect()}
    assert got == {40: "word", 43: "word", 45: "word", **{i: "limit" for i in range(46, 52)}}
    share = {r.source: (r.records, r.cut) for r in T.share_by_source(pages(spark, rows).select("page_id", "source"), T.cut_texts(pages(spark, rows))).collect()}
    assert share["b"] == (9, 6) and share[None] == (1, 1)
    assert T.cut_texts(pages(spark, [])).count() == 0


def test_cut_warnings(spark):
    full = "page {}: output has {} chars, content may be missing"
    rows = [(i, [full.format(i, i * 7)]) for i in range(20)] + [(30, ["page 4: output has 5 cha", None]), (31, None), (32, []), (33, [""]), (34, ["图片识别失败，已保留占位标记。"]), (35, ["图片识别失败，已保"])]
    df = spark.createDataFrame(rows, "page_id bigint, warnings array<string>")
    assert sorted(r.page_id for r in T.cut_warnings(df).collect()) == [30, 35]


def test_cut_warnings_at_a_limit(spark):
    """One source cuts its warnings at 24 characters; no other evidence is there, and its cut forms outnumber the whole ones."""
    full = ["转换后的页面没有任何内容，请检查原始文件是否损坏并重新转换第{}页", "表格列数不一致，已按最宽的一行补齐空白单元格，请人工核对第{}页表格", "图片识别失败，已保留占位标记，请在稍后重新运行第{}页的图片识别步骤", "检测到疑似乱码字符，建议改用图像识别方式重新处理第{}页的全部文字"]
    rows = [(i, "a", [full[i % 4].format(1)[:24]]) for i in range(60)] + [(100 + i, "b", [full[i].format(2)]) for i in range(3)]
    rows += [(200 + i, "c", ["页面输出为空"]) for i in range(9)] + [(300, None, ["页面输出为空"]), (301, "zz", None)]
    # whole, and as long as the limit
    rows += [(500, "a", ["这一条是有二十四个字的完整警告信息，没有被截断的"]), (501, "b", ["这一条是有二十四个字的完整警告信息，没有被截断的"])]
    # whole, though longer ones begin with it
    rows += [(400 + i, "d", ["页面输出为空，已重试两次"]) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id bigint, doc_id string, warnings array<string>")
    owners = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s3")], "doc_id string, source string")
    got = {r.page_id: r.reason for r in T.cut_warnings(df, owners).collect()}
    assert got == dict.fromkeys(range(60), "limit")


def test_limits_of_any_size(spark):
    """A field of 40 characters is a limit like one of 4000."""
    words = "Revenue of the fund grew in the year. "
    for size in (40, 4000):
        rows = [("b", (words * 200)[:size])] * 6 + [("b", words[:30])] * 3 + [("c", "[空白页]")] * 8
        assert {r.page_id: r.reason for r in T.cut_texts(pages(spark, rows)).collect() if r.source == "b" and r.page_id < 6} == dict.fromkeys(range(6), "limit")
        assert not [r for r in T.cut_texts(pages(spark, rows)).collect() if r.source == "c"]


def test_shape_trie(spark, rows):
    shapes = [("ab", 2), ("abc", 3), ("abcd", 5), ("x" * 3000, 1), ("x" * 2999, 1), ("页", 1)]
    got = {r.shape: r.below for r in T.shape_trie(spark.createDataFrame(shapes, "shape string, n bigint")).collect()}
    assert got == {s: sum(n for t, n in shapes if t != s and t.startswith(s)) for s, _ in shapes}
    asked = spark.createDataFrame([("a",), ("abc",), ("q",)], "prefix string")
    t = T.trie(spark.createDataFrame([("ab", 5), ("abc", 2), ("x", 1)], "word string, n bigint"), 2, asked)
    assert rows(t) == [("a", 7, 0), ("abc", 0, 2)]


def test_trie(spark, rows):
    t = T.trie(spark.createDataFrame([("ab", 5), ("abc", 2), ("x", 1)], "word string, n bigint"), 2)
    assert rows(t) == [("a", 7, 0), ("ab", 2, 5), ("abc", 0, 2), ("x", 0, 1)]
