"""Page furniture: page numbers and running headers, by form and by the number they carry."""

from __future__ import annotations

import re

_N = r"(\d{1,4})"
_WORD = r"(?:p(?:age|ágina|agina|ág|ag|g)?\.?|seite|s\.|стр(?:аница|\.)?|第|ページ)"
_OF = r"(?:\s*(?:/|of|de|sur|von|из|\||共|，共|,)\s*(?:共)?\s*(\d{1,4})\s*(?:页|頁|ページ)?)?"
#: A page number's forms: bare, with a word before or a counter after it, between dashes, dots or brackets, with a total.
NUMBER = re.compile(
    rf"(?:{_WORD}\s*{_N}\s*(?:页|頁|ページ)?{_OF}|{_N}\s*(?:页|頁|ページ){_OF}|{_N}\s*/\s*(\d{{1,4}})|[-–—−~·•*]+\s*{_N}\s*[-–—−~·•*]+|[\[(（【〔]\s*{_N}\s*[\])）】〕]|{_N})",
    re.I,
)
#: What separates a running header from its page number.
SEPARATOR = re.compile(r"(?:\s*[·•|｜—–]\s*|\t\s*|\s{2,}| - )")
_YEAR = re.compile(r"(?:19|20)\d\d")
#: A year with letters read for some of its figures, and letters read for figures anywhere.
_ODD_YEAR = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z|]*\d)(?:[1lI|L][9gq]|[2Z][0Oo])[0-9OoIlLSZBbgq|]{2}(?![A-Za-z0-9])")
_LIKE = str.maketrans("OoIlLSZBbgq|", "001115286991")
_LIKE_ANY = re.compile(r"[\doilszbgq|]")
#: A misread number at the end of a line.
_ODD_TAIL = re.compile(r"(?<=[\s·•|｜—–])[0-9OoIlSZBbgq]{1,3}$")


def page_number(line: str) -> int | None:
    """The number a line that is nothing but a page number carries, or None."""
    m = NUMBER.fullmatch(line.strip())
    return int(next(g for g in m.groups() if g)) if m else None


def is_number_line(line: str, page: int | None) -> bool:
    """Whether ``line`` is a page number. A bare figure counts only if it is the page's own number."""
    s = line.strip()
    if not s or len(s) > 24:
        return False
    n = page_number(s)
    if n is None:
        return False
    return n == page if s.isdigit() else True


def split_header(line: str) -> tuple[str, int] | None:
    """Text and number of a line ``text <separator> page number``, or ``page number <separator> text``."""
    s = line.strip()
    if len(s) > 160 or not s or not (s[-1].isdigit() or s[0].isdigit() or s[-1] in "页頁])）】〕-–—·"):
        return None
    at = [m for m in SEPARATOR.finditer(s) if 0 < m.start() and m.end() < len(s)]
    for m in at:  # from the left, so that "text  - 2 -" keeps the dashes with the number
        if (n := page_number(s[m.end() :])) is not None:
            return s[: m.start()], n
    for m in reversed(at):
        if (n := page_number(s[: m.start()])) is not None:
            return s[m.end() :], n
    return None


def form(text: str) -> str:
    """What header texts are compared by: without white space, figures and letters that look like them folded."""
    return _LIKE_ANY.sub("0", "".join(text.split()).casefold().replace("@", "a"))


def header_form(line: str, page: int | None) -> str | None:
    """Form of the text of a line that carries the page's own number, if it may be a running header."""
    cut = split_header(line)
    if cut is None or page is None or cut[1] != page or cut[0].startswith("|") or not re.search(r"[^\W\d_]", cut[0]) or len(cut[0]) < 4:
        return None
    return form(cut[0])


def is_header_line(line: str, page: int | None, listed: frozenset[str] | set[str]) -> bool:
    """Whether ``line`` is a running header with its page number.

    The number must be the page's own, and the text's form one of ``listed`` (those of the report's own headers), or one
    that names a year, as titles of periodical reports do; table rows have more than one figure column and are none.
    Letters read for figures count as figures in years, and in the number of a listed text.
    """
    cut = split_header(line)
    if listed and page is not None and (cut is None or cut[1] != page) and (m := _ODD_TAIL.search(line.rstrip())) and m.group().translate(_LIKE) == str(page):
        cut = split_header(line.rstrip()[: m.start()] + str(page))
        return cut is not None and cut[1] == page and form(cut[0]) in listed
    if cut is None:
        return False
    text, n = cut
    if page is not None and n != page:
        return False
    if form(text) in listed:
        return True
    text = _ODD_YEAR.sub(lambda m: m.group().translate(_LIKE), text)
    years = _YEAR.findall(text)
    return bool(years) and len(re.findall(r"\d+", text)) == len(years) and "|" not in text and not re.search(r"\s{2,}|\t", text) and len(text) > 6
