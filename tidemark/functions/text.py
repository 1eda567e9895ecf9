"""Text expressions for the evidence tables."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

_CJK = "[㐀-鿿]+"
_WORD = "[a-zA-Z0-9_]+"
_BLOCK = "p|div|section|article|li|br|h1|h2|h3|h4|h5|h6|tr"


def clean_page_text(text: Column) -> Column:
    """Drop control characters, squeeze blanks, keep at most one empty line."""
    text = F.regexp_replace(text, "[\\x00-\\x08\\x0B-\\x1F]", "")
    text = F.regexp_replace(text, "[ \\t]+", " ")
    text = F.regexp_replace(text, "\\n{3,}", "\n\n")
    return strip(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one blank."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def grams(run: Column, sizes: tuple[int, ...]) -> Column:
    """All character n-grams of one run, shortest size first."""

    def of_size(n: int) -> Column:
        last = F.length(run) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(run, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>")
        )

    return F.concat(*[of_size(n) for n in sizes])


def cjk_grams(text: Column, sizes: tuple[int, ...]) -> Column:
    runs = F.regexp_extract_all(text, F.lit(_CJK), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: grams(r, sizes)))


def _words(text: Column) -> Column:
    """ASCII words, lower case; only A-Z is folded, as words hold nothing else."""
    return F.regexp_extract_all(F.translate(text, ascii_uppercase, ascii_lowercase), F.lit(_WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased words plus 1-, 2- and 3-grams of each CJK run."""
    return F.concat(_words(text), cjk_grams(text, (1, 2, 3)))


def token_count(text: Column) -> Column:
    """``size(tokens(text))`` without building the grams."""
    runs = F.regexp_extract_all(text, F.lit(_CJK), F.lit(0))
    per_run = lambda r: F.length(r) + F.greatest(F.length(r) - 1, F.lit(0)) + F.greatest(F.length(r) - 2, F.lit(0))
    return F.size(_words(text)) + F.aggregate(runs, F.lit(0), lambda acc, r: acc + per_run(r))


def key_text(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]", "")


def title_entities(title: Column) -> Column:
    """Names inside a title; one ending in the word for "pattern" also counts without it."""
    parts = F.transform(F.split(title, "[与和、，,（）()]+"), key_text)
    short = F.transform(
        F.filter(parts, lambda p: p.endswith("形态") & (F.length(p) > 2)), lambda p: F.regexp_replace(p, "形态$", "")
    )
    return F.concat(F.filter(parts, lambda p: F.length(p) >= 2), short)


def html_text(html: Column) -> Column:
    """Tag stripping with built-ins, for markup without oddities."""
    x = F.regexp_replace(html, "(?is)<(script|style)\\b[^>]*>.*?</\\1\\s*>", "")
    x = F.regexp_replace(x, "(?is)<!--.*?-->|<![^>]*>", "")
    # a self-closing tag counts as an opening and a closing one
    x = F.regexp_replace(x, f"(?i)<({_BLOCK})\\b[^>]*/>", "\n\n")
    x = F.regexp_replace(x, f"(?i)</?({_BLOCK})\\b[^>]*>", "\n")
    x = F.regexp_replace(x, "(?s)<[/a-zA-Z][^>]*>", "")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(value))
    x = F.regexp_replace(x, "[ \\t\\r\\f\\x0B]+", " ")
    return strip(F.regexp_replace(x, "\\n{3,}", "\n\n"))


def first_line(text: Column, width: int = 120) -> Column:
    return F.substring(F.substring_index(text, "\n", 1), 1, width)
