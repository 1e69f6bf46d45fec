import re

import pytest

from pagemill.llm.residue import MESSAGES, PLACEHOLDERS, _may_hold, classify, find_residue, without_residue

M = "<!-- page:1 method:native -->\n"
REPORT = "Revenue of the fund reached USD 1,234 thousand in 2021, as explained in note 4."


@pytest.mark.parametrize(
    "text",
    ["{{ company_name }}", "{%- note -%}", "${report.year}", "#{issuer.code}", "$fund_code$", "%FUND_NAME%", "@@manager@@", "__NAV_VALUE__", "<%= title %>", "<<client>>", "<客户名称>".join("<>"), "[[INSERT DATE]]", "[TBD: amount]", "[Company Name]", "[待补充]", "【请填写基金名称】", "［插入图表］", "{0}", "[object Object]", "XXXX有限公司", "____年__月__日", "<!-- IMG_OCR:xref-9 -->"],
)
def test_placeholders(text):
    assert classify(f"{M}{REPORT} The fund {text} grew.")[0] == "placeholder"


@pytest.mark.parametrize("line", ["Manager: ________", "托管机构：[ ]", "基金名称：请输入", "Inception date: <enter value>", "Fund name: $b", "Custodian: [fill in]", "成立日期：N/A（待填）", "认缴规模：＿＿＿＿"])
def test_form_fields(line):
    assert classify(f"{M}{line}\n{REPORT}")[0] == "placeholder"


@pytest.mark.parametrize(
    "kind, text",
    [
        ("error", "# 404 Not Found\n\nThe file you asked for is no longer on this server."),
        ("error", "Internal error while rendering page\n\n```\nRenderError: null at frame 71\n```"),
        ("error", "您没有访问该文件的权限，请重新登录。"),
        ("error", "Page introuvable"),
        ("script", "Please enable JavaScript to view this document."),
        ("script", "您的浏览器版本过低，请升级并允许脚本运行。"),
        ("script", "<noscript>You need to allow scripts for this page.</noscript>"),
        ("filler", "Lorem ipsum dolor sit amet, consectetur."),
        ("filler", "test test test\n\ntest test test"),
        ("filler", "正文内容待录入。\n正文内容待录入。"),
        ("filler", "一二三四五六七八九十\n\n一二三四五六七八九十"),
    ],
)
def test_kinds(kind, text):
    assert classify(M + text)[0] == kind


@pytest.mark.parametrize(
    "text",
    [
        None,
        "",
        "   ",
        M + "[空白页]",
        M + "[图片识别失败]",
        M + REPORT + " The portal logged 41 page-not-found errors in the year, all of them resolved.",
        M + "门户网站全年共出现305次404错误，均已在当日恢复。",
        M + "Account ****3289 was settled in full. " + REPORT,
        M + "Its product turns JavaScript forms into printed statements for 12 clients.",
        M + "The set {A, B, C} of share classes was reduced to {A, B} by resolution 21.",
        M + "该公司的低代码平台支持以花括号标记变量，目前服务878家客户。",
        M + "In the template syntax a variable such as {{ name }} is written in curly braces.",
        M + "```\n{{ name }}\n```\n" + REPORT,
        M + "| a | b |\n| --- | --- |\n| 1 | 2 |\n\n[4] see note [5]",
        M + "AX4/TBD+XXX" * 20,
        M + "其中储能材料贡献了19.03%，占认缴规模的302%。",
    ],
)
def test_no_residue(text):
    assert classify(text)[0] is None


JAVA = "java.lang.IllegalStateException: no page 41\n" + "\n".join(f"    at com.example.render.Page.step{i}(Page.java:{i})" for i in range(60))
PYTHON = "Traceback (most recent call last):\n" + "\n".join(f'  File "/srv/render/page_{i}.py", line {i}, in render\n    render_the_page(document, number={i}, width=595, height=842)' for i in range(20)) + "\nValueError: no page"
SERVER = "# 502 Bad Gateway\n\n" + "\n\n".join(["The upstream connection failed before it gave any answer.", "The service is temporarily unavailable.", "Please try again later, or ask those who keep the site."] * 5)
BROWSER = "This document is shown by scripts, and your browser has JavaScript disabled, so nothing of it can be seen here at all. Please enable JavaScript in the settings of your browser and load the page again. Cookies must be enabled too."


@pytest.mark.parametrize("kind, text", [("error", JAVA), ("error", PYTHON), ("error", SERVER), ("script", BROWSER), ("script", BROWSER * 4)])
def test_long_messages(kind, text):
    assert classify(M + text)[0] == kind


@pytest.mark.parametrize("text", [REPORT * 9 + "\n" + JAVA[:300], "The company builds portals for clients and keeps them running. " * 6 + "Something went wrong once.", "\n".join([REPORT] * 9) + "\n404 Not Found"])
def test_messages_beside_a_report(text):
    assert classify(M + text)[0] is None


@pytest.mark.parametrize(
    "text, first",
    [
        ("Dear {{name}}, for example your fund gained.", "{{name}}"),
        ("{{ " + "the name of the company " * 9 + "}} grew.", None),
        ("{{ company\nname }} grew.", None),
        ("[fill in " + "the name and the seat of the manager " * 8 + "]", None),
        ("<% " + "x" * 300 + " %>", None),
        ("Dear {{name}}. The set of share classes was reduced, for instance to {{n}} classes.", "{{name}}"),
    ],
)
def test_placeholders_of_any_length(text, first):
    kind, found = classify(f"{M}{REPORT} {text}")
    assert kind == "placeholder" and (first is None or any(f"{M}{REPORT} {text}"[a:b] == first for _, a, b in found))


@pytest.mark.parametrize("text", ["A variable is written {{ name }} there.", "Variables such as `{{ name }}` or {{ x }} are filled later.", "占位符形如{{ name }}，会被替换。", "{{ open\n\nclosed }} elsewhere", "(your attention is drawn to note 4. It says more)"])
def test_text_about_placeholders(text):
    assert classify(f"{M}{REPORT}\n\n{text}")[0] is None


def test_density_not_length():
    page = "HTTP Error 503 Service Unavailable. The upstream gateway did not answer in time. Please try again later. "
    notes = "Ask those who keep the site. "
    for n in (1, 4, 9, 40):
        assert classify(M + page * n + notes * n)[0] == "error"
        assert classify(M + "\n".join([page, *[REPORT] * n]))[0] is None
        assert classify(M + page + notes * 12 * n)[0] is None
        assert classify(M + "Sample text of the heading goes here and is replaced by the editors. " * n)[0] == "filler"
        assert classify(M + "Sample text. " + "The partners met and approved the plan of the manager. " * n)[0] is None
    assert classify(M + "The portal counted 41 page not found errors.")[0] is None and classify(M + "Page not found. Reference 41ab77c0de. Retry in 30 seconds.")[0] == "error"


def _samples(tree):
    """Strings of a parsed pattern: every alternative and every character of a class stands in one of them."""
    parts = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            some = [chr(arg)]
        elif name == "IN":
            classes = {"CATEGORY_DIGIT": "1", "CATEGORY_WORD": "x", "CATEGORY_SPACE": " "}
            some = ["x"] if str(arg[0][0]) == "NEGATE" else [chr(a) if str(o) == "LITERAL" else chr(a[0]) if str(o) == "RANGE" else classes[str(a)] for o, a in arg]
        elif name == "BRANCH":
            some = [x for b in arg[1] for x in _samples(b)]
        elif name == "SUBPATTERN":
            some = _samples(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            one = _samples(arg[2])
            some = [x * max(arg[0], 1) for x in one] + ([""] if arg[0] == 0 else [])
        elif name == "ASSERT":
            some = _samples(arg[1])
        else:
            some = ["" if name in ("AT", "ASSERT_NOT") else "x"]
        parts.append(some)
    least = [min(p, key=len) for p in parts]
    full = [p[0] for p in parts]
    return list({"".join([*base[:i], v, *base[i + 1 :]]) for base in (least, full) for i, p in enumerate(parts) for v in p})


@pytest.mark.parametrize("name, pattern, may", PLACEHOLDERS)
def test_quick_look_passes_every_alternative(name, pattern, may):
    made = {t for s in _samples(re._parser.parse(pattern.pattern, pattern.flags)) for t in (s, s.upper(), s.lower()) if pattern.search(t)}
    assert made and [s for s in made if not _may_hold(s)] == []


@pytest.mark.parametrize("message", MESSAGES)
def test_signs_pass_every_alternative(message):
    made = {t for s in _samples(re._parser.parse(message.pattern.pattern, message.pattern.flags)) for t in (s, s.upper(), s.lower()) if message.pattern.search(t)}
    assert len(made) > 50 and [s for s in made if not message.search(s)] == []


@pytest.mark.parametrize("text", ["[入力してください]", "【入力してください】", "【在此签名】", "[\u3000TBD]", "（\n在此签名）", "基金名称：NA（por completar）"])
def test_prompts_without_a_colon(text):
    assert classify(f"{M}{REPORT} {text}")[0] == "placeholder"


def test_frame(spark):
    rows = [(1, M + "{{a}}"), (2, REPORT), (3, None), (None, "{{a}}"), (1, M + "{{a}}"), (4, REPORT * 2000 + " {{b}}")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, markdown string, kind string")
    got = [(r.page_id, r.kind, r.first) for r in find_residue(df, "page_id", "markdown").collect()]
    assert sorted(got, key=str) == sorted([(1, "placeholder", "{{a}}")] * 2 + [(None, "placeholder", "{{a}}"), (4, "placeholder", "{{b}}")], key=str)
    assert sorted((r.page_id for r in without_residue(df, "page_id", "markdown").collect()), key=str) == [2, 3, None]
    assert find_residue(df.limit(0), "page_id", "markdown").count() == 0
