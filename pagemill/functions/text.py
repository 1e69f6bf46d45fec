"""Column expressions over page text: markers, names, placeholders, trimming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Literals of the page format; fixed values.
EMPTY_PAGE, FAILED_IMAGE, LOGO, DECORATION = "[空白页]", "[图片识别失败]", "[logo]", "[装饰图片]"
MARKER_PATTERN = r"(?U)<!-- page:\d+(?: method:[\w-]+)? -->\n?"
#: A year that lost its last figure, before a month.
CUT_YEAR_PATTERN = r"(?U)\b(20[012])\s+年\s+(\d+\s+月)"


def strip_u(c: Column | str) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip_u(c: Column | str) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def strip_markers(c: Column | str) -> Column:
    """Text without page markers."""
    return F.regexp_replace(c, MARKER_PATTERN, "")


def page_marker(number: Column, method: Column) -> Column:
    return F.format_string("<!-- page:%d method:%s -->", number, method)


def source_comment(path: Column) -> Column:
    return F.format_string("<!-- source: %s -->", path)


def page_file(number: Column) -> Column:
    """Name of a page's file, three digits at least."""
    return F.format_string("%03d.md", number)


def debug_name(number: Column, suffix: Column) -> Column:
    return F.format_string("page-%03d.%s", number, suffix)


def page_image_name(number: Column) -> Column:
    return F.format_string("page-%03d-full.png", number)


def embedded_image_name(number: Column, image: Column, ext: Column) -> Column:
    return F.format_string("page-%03d-img-%02d.%s", number, image, F.coalesce(ext, F.lit("png")))


def image_placeholder(xref: Column) -> Column:
    return F.format_string("<!-- IMG_OCR:xref-%d -->", xref)


def fill_images(markdown: Column, texts: Column) -> Column:
    """Image placeholders replaced by the texts of a map from placeholder id; ids are taken in their order."""
    entries = F.array_sort(F.map_entries(texts))
    return F.aggregate(entries, markdown, lambda acc, e: F.replace(acc, F.concat(F.lit("<!-- IMG_OCR:"), e["key"], F.lit(" -->")), F.coalesce(e["value"], F.lit(FAILED_IMAGE))))


def or_empty_page(c: Column) -> Column:
    """``c``, or the marker of an empty page where nothing but white space is left."""
    return F.when(F.length(strip_u(F.coalesce(c, F.lit("")))) > 0, c).otherwise(EMPTY_PAGE)


def asset_refs(markdown: Column | str) -> Column:
    """Targets of image links, in order."""
    return F.regexp_extract_all(markdown, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))


def phrases(c: Column | str, least: int = 2) -> Column:
    """Runs of at least ``least`` Chinese characters, in order."""
    return F.regexp_extract_all(c, F.lit(f"[一-鿿]{{{least},}}"), F.lit(0))


def mark_cut_years(c: Column | str) -> Column:
    """A year that lost its last figure gets a question mark: it cannot be known."""
    return F.regexp_replace(c, CUT_YEAR_PATTERN, "$1? 年 $2")


def letters(c: Column) -> Column:
    """Letters in ``c``, Chinese characters included."""
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def data_url(image: Column) -> Column:
    """PNG bytes as a data URL; Spark may break base64 into lines, so the breaks are taken out."""
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(image), r"\s", ""))


def data_url_bytes(url: Column) -> Column:
    return F.unbase64(F.split_part(url, F.lit(","), F.lit(2)))


def block_text(lines: Column) -> Column:
    """Text of a block: spans of a line joined, blank lines dropped, lines joined. ``lines`` is array<array<string>>."""
    joined = F.transform(lines, lambda spans: rstrip_u(F.array_join(spans, "")))
    return strip_u(F.array_join(F.filter(joined, lambda l: F.length(strip_u(l)) > 0), "\n"))


def strip_listed(text: Column, listed: Column) -> Column:
    """``text`` without the listed strings, the longest first (equal lengths in text order), trimmed."""
    ordered = F.array_sort(F.coalesce(listed, F.array().cast("array<string>")), _longest_first)
    return strip_u(F.aggregate(ordered, text, lambda acc, r: F.when(F.length(r) > 0, F.replace(acc, r, F.lit(""))).otherwise(acc)))


def reinsert_listed(text: Column, raw: Column, listed: Column) -> Column:
    """Listed strings that the page's text layer has and ``text`` lacks, put in front one by one, the longest first."""
    ordered = F.array_sort(F.coalesce(listed, F.array().cast("array<string>")), _longest_first)
    return F.aggregate(ordered, text, lambda acc, r: F.when(~F.contains(acc, r) & F.contains(raw, r), F.concat(r, F.lit("\n\n"), acc)).otherwise(acc))


def _longest_first(a: Column, b: Column) -> Column:
    return F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
