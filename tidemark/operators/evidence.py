"""Evidence tables: pages, regions, spans, assets, card references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import stage

# Leading bytes of the supported media types, in hex.
SIGNATURES = {
    "application/pdf": ("255044462D",),
    "image/png": ("89504E470D0A1A0A",),
    "image/jpeg": ("FFD8FF",),
    "application/epub+zip": ("504B0304",),
    "image/tiff": ("49492A00", "4D4D002A"),
}
CARD_STATES = ("drafts", "rejected", "published")


def page_statistics(pages: DataFrame, text: str = "text") -> DataFrame:
    return pages.agg(
        F.count(F.lit(1)).alias("pages_total"),
        F.count_if(F.coalesce(F.length(text) > 0, F.lit(False))).alias("pages_with_text"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters"),
    )


def media_issue(media_type: Column, content: Column) -> Column:
    """NULL when the leading bytes fit the declared type."""
    head = F.hex(F.substring(content, 1, 8))
    fits = F.lit(False)
    for kind, marks in SIGNATURES.items():
        for mark in marks:
            fits = fits | ((media_type == kind) & F.startswith(head, F.lit(mark)))
    return F.when(F.length(content) == 0, "empty_file").when(~fits, "signature_mismatch")


def first_copies(assets: DataFrame, content: Column, order: str, keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns of the earliest row of each content, and its copies.

    Copies of one content may be most of the table: they fold in the map tasks
    by digest, and the content itself is not shuffled.
    """
    hashed = assets.select(*keep, F.col(order).alias("__order"), F.sha2(content, 256).alias("sha256"))
    first = F.min_by(F.struct(*keep), "__order")
    return hashed.groupBy("sha256").agg(first.alias("r"), F.count(F.lit(1)).alias("copies")).select("sha256", "r.*", "copies")


def spans(regions: DataFrame) -> DataFrame:
    """Union box and mean of the known confidences per span.

    ``regions``: span_id, x0, y0, x1, y1, confidence.
    """
    return regions.groupBy("span_id").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("regions"),
    )


def box_issue() -> Column:
    inside = (F.col("x0") >= 0) & (F.col("x0") < F.col("x1")) & (F.col("x1") <= 1) & (F.col("y0") >= 0) & (F.col("y0") < F.col("y1")) & (F.col("y1") <= 1)
    return F.when(~F.coalesce(inside, F.lit(False)), "invalid_bbox")


def revisions(chain: DataFrame) -> DataFrame:
    """Revision of each span: one more than the one it supersedes.

    ``chain``: span_id, supersedes_id.  Pointer doubling: each round joins every
    unfinished span to the span its pointer names and adds the distances, so a
    chain of length L ends after log2(L) rounds; what is left after log2 of all
    spans can only be a cycle, which is an error.  A round writes the unfinished
    spans alone.  Joins only, so a long chain is never gathered in one task.
    """
    state = chain.select("span_id", F.col("supersedes_id").alias("next"), F.lit(1).cast("long").alias("revision"))
    done, pending = state.where("next is null"), stage(state.where("next is not null"), "revisions")
    left = pending.count()
    for _ in range(max(1, left).bit_length() + 1):
        if not left:
            break
        target = done.unionByName(pending).select(F.col("span_id").alias("__id"), F.col("next").alias("__next"), F.col("revision").alias("__r"))
        moved = pending.join(target, F.col("next") == F.col("__id"), "left").select(
            "span_id", F.col("__next").alias("next"), (F.col("revision") + F.coalesce("__r", F.lit(0))).alias("revision")
        )
        moved = stage(moved, "revisions")
        done, pending = done.unionByName(moved.where("next is null")), moved.where("next is not null")
        left = pending.count()
    if left:
        raise ValueError(f"{left} spans supersede each other in a cycle")
    return done.select("span_id", "revision")


# The wording of a citation.
def citation_labels(spans_: DataFrame, pages: DataFrame, editions: DataFrame) -> DataFrame:
    """Citation text of each span.

    ``spans_``: span_id, page_id, revision; ``pages``: page_id, edition_id,
    printed_label, physical_number; ``editions``: edition_id, title, edition_label.
    """
    rows = spans_.join(pages, "page_id").join(editions, "edition_id")
    edition = F.when(F.coalesce(F.col("edition_label"), F.lit("")) != "", F.concat(F.lit("，"), "edition_label")).otherwise("")
    label = F.concat(
        F.lit("["), "title", edition, F.lit("，书内第 "), F.coalesce("printed_label", F.lit("未标印刷页")), F.lit(" 页（文件第 "),
        F.col("physical_number").cast("string"), F.lit(" 页），证据 revision "), F.col("revision").cast("string"), F.lit("]"),
    )
    return rows.select("span_id", label.alias("citation"))


def locator_issues(cards: DataFrame, locators: DataFrame) -> DataFrame:
    """References of the cards that hit no existing page or chapter with text.

    ``locators``: kind, manifest, locator, text.
    """
    refs = cards.select("card_id", F.explode("evidence_refs").alias("ref")).select("card_id", "ref.kind", "ref.manifest", "ref.locator")
    known = locators.select("kind", "manifest", "locator", F.lit(True).alias("__known"), (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).alias("__text"))
    out = refs.join(known, ["kind", "manifest", "locator"], "left")
    reason = F.when(F.col("__known").isNull(), "locator_missing").when((F.col("kind") == "pdf_page") & ~F.col("__text"), "page_without_text")
    return out.select("card_id", "kind", "manifest", "locator", reason.alias("reason")).where(F.col("reason").isNotNull())


def current_cards(cards: DataFrame) -> DataFrame:
    """One row per card id: published over rejected over draft."""
    place = F.array_position(F.array(*[F.lit(s) for s in CARD_STATES]), F.col("folder"))
    rest = [c for c in cards.columns if c != "card_id"]
    return cards.groupBy("card_id").agg(F.max_by(F.struct(*rest), place).alias("r")).select("card_id", "r.*")
