"""Fields of the canonical domains."""

from __future__ import annotations

from pyspark.sql import DataFrame

_PIT = (
    "source_record_id string, published_at timestamp, available_at timestamp, effective_session date, revision_id string, "
    "content_hash string, ingested_at timestamp, symbol_mapping_version string"
)
# The exact fields of each domain, as Spark DDL.
DOMAINS: dict[str, str] = {
    "market": "symbol string, session date, open double, high double, low double, close double, volume double",
    "fundamentals": f"symbol string, value_name string, value double, {_PIT}",
    "announcements": f"symbol string, event_type string, {_PIT}",
    "news": f"symbol string, title string, content string, {_PIT}",
    "index_constituents": "index_symbol string, constituent_symbol string, effective_from date, effective_to date",
    "tradability": "symbol string, session date, is_st boolean, is_suspended boolean, is_limit_up boolean, is_limit_down boolean, can_buy boolean, can_sell boolean",
}


def conform(df: DataFrame, domain: str, mapping: dict[str, str]) -> DataFrame:
    """Map source columns onto a domain; other source columns are left behind."""
    wanted = dict(field.split() for field in DOMAINS[domain].split(", "))
    missing = [name for name in wanted if name not in mapping] + [c for c in mapping.values() if c not in df.columns]
    if missing:
        raise ValueError(f"mapping or columns missing: {sorted(missing)}")
    return df.select(*[df[mapping[name]].try_cast(kind).alias(name) for name, kind in wanted.items()])
