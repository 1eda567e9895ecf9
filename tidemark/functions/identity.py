"""Content identities.

The text that is hashed is our own canonical form, not JSON: fields in name
order, doubles as fixed decimals, NULL as the empty string after ``name=``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a symbol has six digits.
SYMBOL = "^[0-9]{6}$"
from pyspark.sql import types as T


def canonical_text(df: DataFrame, fields: list[str]) -> Column:
    parts = []
    for name in sorted(fields):
        kind = df.schema[name].dataType
        col = F.col(name)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            col = col.cast("decimal(28,8)")
        parts.append(F.concat(F.lit(name + "="), F.coalesce(col.cast("string"), F.lit(""))))
    return F.concat_ws("|", *parts)


def row_identity(df: DataFrame, fields: list[str]) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_text(df, fields), 256))


def short_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` plus the first 24 hex digits of the parts' SHA-256."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 24))


def padded_symbol(symbol: Column) -> Column:
    """Zeros in front up to six characters; longer text stays as it is."""
    text = F.trim(symbol.cast("string"))
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def strict_symbol(symbol: Column) -> Column:
    """Padded, and anything that isn't six digits then fails the job."""
    padded = padded_symbol(symbol)
    bad = F.concat(F.lit("not a symbol: "), F.coalesce(symbol.cast("string"), F.lit("NULL")))
    return F.when(padded.rlike(SYMBOL), padded).otherwise(F.raise_error(bad).cast("string"))
