"""Column expressions that judge page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import strip_markers, strip_u

#: Characters that a broken font map is known to yield: U+7761 to U+776F; thresholds are fixed values.
BROKEN_GLYPHS = "".join(chr(c) for c in range(0x7761, 0x7770))
LEAST_TEXT, FALLBACK_TEXT = 30, 500
#: Figures as Python's isdigit counts them.
FIGURES = "[\\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐]"

#: Warnings of the page format; fixed values.
EMPTY_OUTPUT = "页面输出为空"
EMPTY_TABLE = "页面表格只有空表壳，疑似表体提取失败"
SHORT_LINES = "页面大量短行，疑似无框线表格未能还原"
FELL_BACK = "vision 输出不足，已回退至 native 原始文本"


def broken_glyphs(c: Column | str) -> Column:
    """How many characters of ``c`` come from a broken font map."""
    c = F.col(c) if isinstance(c, str) else c
    return F.length(c) - F.length(F.translate(c, BROKEN_GLYPHS, ""))


def top_share(c: Column, k: int = 8) -> Column:
    """Share of the ``k`` most frequent Chinese characters among all of them.

    The characters are sorted and runs of equal ones measured, so a text costs n log n without leaving its row.
    """
    han = F.regexp_replace(c, "[^一-鿿]", "")
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(han, "")), ""), F.lit("(.)\\1*"), F.lit(0))
    top = F.slice(F.sort_array(F.transform(runs, F.length), asc=False), 1, k)
    return F.aggregate(top, F.lit(0), lambda a, n: a + n) / F.greatest(F.length(han), F.lit(1))


def is_garbled(c: Column | str) -> Column:
    """Whether a text layer is garbled: five known broken glyphs, or few characters that repeat and hardly a figure."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    figures = (F.length(c) - F.length(F.regexp_replace(c, FIGURES, ""))) / F.greatest(F.length(c), F.lit(1))
    han = F.length(F.regexp_replace(c, "[^一-鿿]", ""))
    return F.when(F.length(c) < 30, False).when(broken_glyphs(c) >= 5, True).when(han < 10, False).otherwise((top_share(c) > 0.4) & (figures < 0.02))


def native_candidate(raw: Column | str) -> Column:
    """Whether the text layer is worth trying: long enough and not garbled."""
    raw = F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit(""))
    return (F.length(raw) >= LEAST_TEXT) & ~is_garbled(raw)


def conversion_warnings(source: Column, result: Column) -> Column:
    """Warnings of a conversion: far shorter than its source, or more than five broken glyphs."""
    n, m = F.length(strip_u(strip_markers(source))), F.length(strip_u(result))
    short = F.format_string("输出长度(%d)不足源文本(%d)的30%%，可能有大量内容丢失", m, n)
    glyphs = broken_glyphs(result)
    found = F.array(F.when((n > 200) & (m < n * 0.3), short), F.when(glyphs > 5, F.format_string("输出中检测到 %d 个疑似乱码字符", glyphs)))
    return F.filter(found, lambda w: w.isNotNull())


def short_line_page(body: Column) -> Column:
    """More than eight lines, of which over 60 % have at most 15 characters."""
    lines = F.filter(F.transform(F.split(body, "\n", -1), strip_u), lambda l: F.length(l) > 0)
    few = F.filter(lines, lambda l: F.length(l) <= 15)
    return (F.size(lines) > 8) & (F.size(few) / F.greatest(F.size(lines), F.lit(1)) > 0.6)


def page_warnings(markdown: Column, method: Column, has_tables: Column, body_text: Column, raw_text: Column) -> Column:
    """All warnings of a page's Markdown, for its method and its analysis."""
    body = strip_u(strip_markers(F.coalesce(markdown, F.lit(""))))
    native = F.array(
        F.when(F.coalesce(has_tables, F.lit(False)) & body.rlike(r"(?s)<tbody>\s*</tbody>"), EMPTY_TABLE),
        F.when(~F.contains(body, F.lit("|")) & short_line_page(body), SHORT_LINES),
    )
    native = F.when(method == "native", F.filter(native, lambda w: w.isNotNull())).otherwise(F.array().cast("array<string>"))
    source = F.coalesce(F.nullif(body_text, F.lit("")), raw_text, F.lit(""))
    against = F.when(F.length(source) > 0, conversion_warnings(source, body)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(body) == 0, F.array(F.lit(EMPTY_OUTPUT))).otherwise(F.concat(native, against))


def wants_coordinates(warnings: Column) -> Column:
    """Whether rebuilding the page's table from coordinates may help."""
    return F.exists(warnings, lambda w: w.rlike("短行|表格"))


def wants_fallback(warnings: Column, raw_text: Column) -> Column:
    """Whether a transcription is so short that the text layer is kept instead."""
    return F.exists(warnings, lambda w: F.contains(w, F.lit("不足源文本"))) & (F.length(F.coalesce(raw_text, F.lit(""))) > FALLBACK_TEXT)
