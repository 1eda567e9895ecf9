"""Text of a page by reading its markup character by character.

A small state machine: outside tags, inside a tag (where a quoted attribute may
hold ``>``), inside a comment or declaration, and inside elements whose content is
raw (``script``, ``style``) or text without tags (``title``, ``textarea``).
Character references are read in text only, numeric ones in both bases and named
ones by Python's table of HTML5, the longest name first.  HTML lets numbers and old
names stand without their semicolon; where ``bare`` is false, as in XHTML, such a
reference is text.

``page_text`` applies it to a column in Arrow batches; a page is one value, so a
batch is bounded by Arrow's number of records.

Defined cases: NULL gives NULL; a ``<`` that begins no tag is text; a tag, comment or
raw element that never ends takes the rest of the page; NUL and references to it,
to surrogates or beyond Unicode give U+FFFD.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements that begin and end a line, and those whose content is no text.
BLOCKS = frozenset("p div section article li br h1 h2 h3 h4 h5 h6 tr".split())
RAW = frozenset(("script", "style"))
PLAIN = frozenset(("title", "textarea"))

_LONGEST_NAME = max(map(len, html5))
_BLANKS = " \t\n\r\f"
_COMMENT_END = re.compile("--!?>")


def _reference(page: str, at: int, bare: bool) -> tuple[str, int]:
    """The characters a reference at ``&`` stands for, and where the text goes on."""
    end = len(page)
    if page.startswith("#", at + 1):
        base, first = (16, at + 3) if page[at + 2 : at + 3] in ("x", "X") else (10, at + 2)
        digits = "0123456789abcdefABCDEF" if base == 16 else "0123456789"
        stop = first
        while stop < end and page[stop] in digits:
            stop += 1
        if stop == first or not (bare or page.startswith(";", stop)):
            return "&", at + 1
        # eight digits say more than any code point
        code = int(page[first:stop].lstrip("0")[:8] or "0", base)
        after = stop + 1 if page.startswith(";", stop) else stop
        if 0x80 <= code <= 0x9F:  # pages mean the Windows code page there
            return bytes((code,)).decode("cp1252", "replace"), after
        bad = code == 0 or 0xD800 <= code <= 0xDFFF or code > 0x10FFFF
        return ("�" if bad else chr(code)), after
    stop = at + 1
    while stop < end and stop - at <= _LONGEST_NAME and page[stop].isascii() and page[stop].isalnum():
        stop += 1
    if page.startswith(";", stop) and page[at + 1 : stop + 1] in html5:
        return html5[page[at + 1 : stop + 1]], stop + 1
    for cut in range(stop if bare else 0, at + 1, -1):  # old names may stand without the semicolon
        if page[at + 1 : cut] in html5:
            return html5[page[at + 1 : cut]], cut
    return "&", at + 1


def _tag_end(page: str, at: int) -> tuple[int, bool]:
    """Behind the ``>`` that closes the tag opened before ``at``, and whether it closes itself.

    Quotes count only where a value begins: a stray one is part of a name.
    """
    end, i, value_next = len(page), at, False
    while i < end:
        c = page[i]
        if c == ">":
            return i + 1, page[i - 1] == "/" and not value_next
        if value_next and c in "\"'":
            i = page.find(c, i + 1)
            if i < 0:
                return end, False
            value_next = False
        elif c == "=":
            value_next = True
        elif c not in _BLANKS:
            if value_next:  # a value without quotes ends at a blank or >
                while i < end and page[i] not in _BLANKS and page[i] != ">":
                    i += 1
                value_next = False
                if i < end and page[i] == ">":
                    return i + 1, False
                continue
        i += 1
    return end, False


def _comment_end(page: str, at: int) -> int:
    """Behind the comment whose ``<!--`` ends at ``at``."""
    if page.startswith(">", at):
        return at + 1
    if page.startswith("->", at):
        return at + 2
    hit = _COMMENT_END.search(page, at)
    return hit.end() if hit else len(page)


def _closing(page: str, name: str, at: int) -> int:
    """Where the end tag of a raw element begins; the end of the page if nowhere."""
    hit = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE | re.ASCII).search(page, at)
    return hit.start() if hit else len(page)


def _plain(page: str, at: int, end: int, out: list[str], bare: bool) -> None:
    """Text without tags: only references mean anything."""
    while at < end:
        mark = page.find("&", at, end)
        if mark < 0:
            out.append(page[at:end])
            return
        out.append(page[at:mark])
        chars, after = _reference(page, mark, bare)
        out.append(chars)
        at = min(after, end)


def read(page: str, bare: bool = True) -> str:
    """The text of a page, a line break at each edge of a block element."""
    out: list[str] = []
    i, end = 0, len(page)
    while i < end:
        mark = page.find("<", i)
        mark = end if mark < 0 else mark
        _plain(page, i, mark, out, bare)
        if mark == end:
            break
        follows = page[mark + 1 : mark + 2]
        if page.startswith("<!--", mark):
            i = _comment_end(page, mark + 4)
        elif follows in ("!", "?"):
            close = page.find(">", mark)
            i = end if close < 0 else close + 1
        elif follows == "/" and not (page[mark + 2 : mark + 3].isascii() and page[mark + 2 : mark + 3].isalpha()):
            if mark + 2 >= end:  # "</" as the last thing is text
                out.append("</")
                break
            close = page.find(">", mark)
            i = end if close < 0 else close + 1
        elif follows == "/" or (follows.isascii() and follows.isalpha()):
            first = mark + (2 if follows == "/" else 1)
            stop = first
            while stop < end and page[stop] not in _BLANKS and page[stop] not in "/>":
                stop += 1
            name = page[first:stop].lower()
            i, closed = _tag_end(page, stop)
            if name in BLOCKS:
                out.append("\n\n" if closed and follows != "/" else "\n")
            elif follows != "/" and name in RAW:
                i = _closing(page, name, i)
            elif follows != "/" and name in PLAIN:
                close = _closing(page, name, i)
                _plain(page, i, close, out, bare)
                i = close
        else:
            out.append("<")
            i = mark + 1
    text = "".join(out).replace("\x00", "�").replace("\xa0", " ")
    text = re.sub(r"[ \t\r\f\x0b]+", " ", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip(" \t\n\r\f\x0b")


def page_text(html: Column, bare: bool = True) -> Column:
    """Exact text of a page; ``functions.text.html_text`` is the form with built-ins for simple markup."""

    @F.pandas_udf(StringType())
    def read_pages(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in pages:
            yield part.map(lambda page: read(page, bare), na_action="ignore")

    return read_pages(html)
