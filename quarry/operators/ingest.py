"""Uploads, stage transitions, page ranges, enrichment and deletion."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx

# Accepted types and user-facing messages.
PDF_TYPES = ["application/pdf", "application/x-pdf"]
GENERIC_TYPES = ["application/octet-stream", "binary/octet-stream", ""]
UNSUPPORTED_FILE = "Only PDF files can be uploaded. Please choose a .pdf file."
UNSUPPORTED_TYPE = "This file type isn't supported. Please upload a PDF."
PASSWORD_PROTECTED = "This PDF is password-protected. Remove the password and upload it again."
NO_TEXT = "No readable text was found in this PDF (it may be empty or a low-quality scan)."
UNREADABLE_PDF = "This file couldn't be read as a PDF (it may be corrupted or password-protected)."
SERVICE_UNAVAILABLE = "The document processing service is temporarily unavailable. Please try again later."
STRUCTURING_FAILED = "We couldn't process this document's contents. Please try again later."
EMBEDDING_FAILED = "We couldn't index this document for search. Please try again later."
SERVICE_ERRORS = ["SeamTransientError", "SeamNotConfigured", "TimeoutError"]
STAGES = {"parsing": ["uploaded", "parsing"], "structuring": ["structuring"], "embedding": ["embedding"]}
PAGE_MARKER = r"(?md)^#{1,6}[ \t]*Page[ \t]+(\d+)[ \t]*$"
HAS_PAGE_MARKER = r"(^|\n)#{1,6} *Page +[0-9]+ *(\n|\z)"
SECTION_CHARS = 6000


# ---- uploads ---------------------------------------------------------------------------


def supported_upload(filename: Column, mime_type: Column) -> Column:
    mime = F.lower(tx.strip(F.substring_index(mime_type, ";", 1)))
    return mime.isin(PDF_TYPES) | (mime.isin(GENERIC_TYPES) & F.lower(filename).endswith(".pdf"))


def split_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted uploads, and rejects with a reason."""
    ok = supported_upload(F.col("filename"), F.col("mime_type"))
    return uploads.filter(ok), uploads.filter(~ok).withColumn("reason", F.lit(UNSUPPORTED_FILE))


def dedupe(uploads: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Map every upload to the document that keeps its content.

    ``uploads``: org_id, upload_id, content. The first upload (lowest id) of a checksum within
    an organisation creates the document; stored documents (``org_id, checksum, document_id``)
    win over new ones. Copies are counted map-side; a content that fills a third of the table makes
    a skewed partition of the mapping join, which adaptive execution splits.
    """
    hashed = uploads.select("org_id", "upload_id", F.sha2("content", 256).alias("checksum"))
    first = hashed.groupBy("org_id", "checksum").agg(F.min("upload_id").alias("first_id"))
    owners = first.withColumn("stored_id", F.lit(None).cast(first.schema["first_id"].dataType))
    if existing is not None:
        owners = first.join(existing.select("org_id", "checksum", F.col("document_id").alias("stored_id")), ["org_id", "checksum"], "left")
    out = hashed.join(owners, ["org_id", "checksum"])
    return out.select(
        "org_id", "upload_id", "checksum", F.coalesce("stored_id", "first_id").alias("document_id"),
        (F.col("stored_id").isNull() & (F.col("upload_id") == F.col("first_id"))).alias("created"),
    )


def begin_stage(docs: DataFrame, stage: str) -> DataFrame:
    """Add ``eligible`` and the state after the stage starts; other rows are unchanged."""
    ok = F.col("status").isin(STAGES[stage]) | ((F.col("status") == "failed") & (F.coalesce(F.col("failed_stage"), F.lit("")) == stage))
    return docs.withColumn("eligible", ok).withColumns({
        "status": F.when(ok, F.lit(stage)).otherwise(F.col("status")),
        "failed_stage": F.when(~ok, F.col("failed_stage")),
        "error_detail": F.when(~ok, F.col("error_detail")),
    })


def failure_message(stage: Column, error_type: Column, error: Column) -> Column:
    """Short user-readable message for a failed stage."""
    e = F.lower(error)
    parsing = (
        F.when(e.contains("pdf only") | (e.contains("unsupported") & e.contains("mime")), F.lit(UNSUPPORTED_TYPE))
        .when(e.contains("encrypted") | e.contains("password"), F.lit(PASSWORD_PROTECTED))
        .when(e.contains("negligible text"), F.lit(NO_TEXT))
        .otherwise(F.lit(UNREADABLE_PDF))
    )
    return (
        F.when(error_type.isin(SERVICE_ERRORS), F.lit(SERVICE_UNAVAILABLE)).when(stage == "parsing", parsing)
        .when(stage == "embedding", F.lit(EMBEDDING_FAILED)).otherwise(F.lit(STRUCTURING_FAILED))
    )


def mark_failed(docs: DataFrame) -> DataFrame:
    """``doc_id, stage, error_type, error`` to failure rows; nothing is dropped."""
    return docs.select(
        "doc_id", F.lit("failed").alias("status"), F.col("stage").alias("failed_stage"),
        failure_message(F.col("stage"), F.col("error_type"), F.col("error")).alias("error_detail"))


# ---- page ranges -----------------------------------------------------------------------


def page_range(content: Column, preceding: Column, page_start: Column, page_end: Column, max_page: Column) -> tuple[Column, Column]:
    """Start and end page of a chunk. ``preceding``: the last page marker before it, if any.

    A marker at its very start, else the last marker before it, else the page before its first
    inner marker; without any marker the section's range, unless that is the whole document.
    """
    inside = F.regexp_extract_all(content, F.lit(PAGE_MARKER), F.lit(1))
    first, last = F.try_element_at(inside, F.lit(1)).cast("int"), F.try_element_at(inside, F.lit(-1)).cast("int")
    at_start = content.rlike(f"(?mdU)\\A{tx.BLANK}*^#{{1,6}}[ \\t]*Page[ \\t]+\\d+[ \\t]*$")
    start = F.coalesce(F.when(at_start, first), preceding, F.when(first.isNotNull(), F.greatest(first - 1, F.lit(1))))
    whole = (page_start == 1) & (page_end > 1) & (page_end >= max_page)
    derived = start.isNotNull()
    hidden = F.coalesce(whole, F.lit(False))
    return (
        F.when(derived, start).when(~hidden, page_start),
        F.when(derived, F.greatest(F.coalesce(last, start), start)).when(~hidden, page_end),
    )


def chunk_pages(chunk_rows: DataFrame, sections: DataFrame) -> DataFrame:
    """``chunk_id, doc_id, page_start, page_end`` for every chunk."""
    markers = F.regexp_extract_all("content", F.lit(PAGE_MARKER), F.lit(1))
    own = F.when(F.col("content").rlike(HAS_PAGE_MARKER), F.try_element_at(markers, F.lit(-1)).cast("int"))
    earlier = Window.partitionBy("doc_id").orderBy("char_start").rowsBetween(Window.unboundedPreceding, -1)
    rows = chunk_rows.select("chunk_id", "doc_id", "section_id", "content", F.last(own, ignorenulls=True).over(earlier).alias("preceding"))
    limits = sections.groupBy("doc_id").agg(F.max("page_end").alias("max_page"))
    ranged = rows.join(sections.select("doc_id", "section_id", "page_start", "page_end"), ["doc_id", "section_id"], "left").join(limits, "doc_id", "left")
    start, end = page_range(F.col("content"), F.col("preceding"), F.col("page_start"), F.col("page_end"), F.col("max_page"))
    return ranged.select("chunk_id", "doc_id", start.alias("page_start"), end.alias("page_end"))


# ---- enrichment ------------------------------------------------------------------------


def enrichment_prompts(docs: DataFrame, sections: DataFrame, limit: int = SECTION_CHARS) -> DataFrame:
    """``section_id, doc_id, prompt``: section heading and its trimmed text, blank ones skipped."""
    rows = docs.select("doc_id", "text").join(sections.select("doc_id", "section_id", "heading", "char_start", "char_end"), "doc_id")
    segment = F.substring(tx.strip(F.expr("substring(text, char_start + 1, char_end - char_start)")), 1, limit)
    rows = rows.select("section_id", "doc_id", F.when(F.col("heading") == "", None).otherwise(F.col("heading")).alias("heading"), segment.alias("segment"))
    return rows.filter("segment <> ''").select(
        "section_id", "doc_id",
        F.concat(F.lit("Section heading: "), F.coalesce("heading", F.lit("(untitled)")), F.lit("\n\nSection text:\n"), F.col("segment")).alias("prompt"))


def parse_enrichment(response: str | Column) -> Column:
    """``(summary, topics)`` from a model's JSON object; null when it cannot be parsed."""
    def without_fence(raw: Column) -> Column:
        opened = tx.strip(F.regexp_replace(F.regexp_replace(raw, "^`+", ""), "^[json]+", ""))
        return F.when(raw.startswith("```"), tx.strip(F.regexp_replace(opened, "`+\\z", ""))).otherwise(raw)

    def read(json: Column) -> Column:
        field = lambda name, t: F.try_variant_get(json, f"$.{name}", t)
        summary = F.when(F.schema_of_variant(field("summary", "variant")) == "STRING", field("summary", "string"))
        given = F.slice(F.coalesce(field("topics", "array<string>"), F.array().cast("array<string>")), 1, 5)
        topics = F.filter(given, lambda t: t.isNotNull() & (t != ""))
        return F.when(
            F.schema_of_variant(json).startswith("OBJECT"),
            F.struct(
                F.substring(tx.strip(F.coalesce(summary, F.lit(""))), 1, 2000).alias("summary"),
                F.transform(topics, lambda t: F.substring(tx.strip(t), 1, 80)).alias("topics"),
            ),
        )

    return tx.bind(tx.strict_json(tx.bind(tx.strip(response), without_fence)), read)


def split_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``section_id, summary, topics`` of usable responses, and the failed rows with a reason."""
    rows = responses.withColumn("e", parse_enrichment("response"))
    reason = F.when(F.col("e").isNull(), F.lit("unparsable")).when(F.col("e.summary") == "", F.lit("empty_summary"))
    rows = rows.withColumn("reason", reason)
    good = rows.filter("reason is null").select("section_id", "e.summary", "e.topics")
    return good, rows.filter("reason is not null").select("section_id", "response", "reason")


def apply_enrichment(sections: DataFrame, enriched: DataFrame) -> DataFrame:
    """Sections with new summaries and topics where given."""
    new = enriched.select("section_id", F.col("summary").alias("_s"), F.col("topics").alias("_t"))
    return sections.join(new, "section_id", "left").withColumns(
        {"summary": F.coalesce("_s", "summary"), "topics": F.coalesce("_t", "topics")}).drop("_s", "_t")


def contextual_texts(chunk_rows: DataFrame, enriched: DataFrame) -> DataFrame:
    """Chunks of enriched sections with their summary in front, ready to be embedded again."""
    joined = chunk_rows.join(enriched.select("section_id", "summary"), "section_id")
    return joined.select(F.col("chunk_id").alias("owner_id"), F.concat_ws("\n\n", "summary", "content").alias("text"))


def backfill_counts(docs: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: documents enriched, skipped (not ready) and failed."""
    bad = docs.join(failed.select("doc_id").distinct().withColumn("_f", F.lit(True)), "doc_id", "left")
    ready, broke = F.col("status") == "ready", F.coalesce("_f", F.lit(False))
    return bad.agg(
        F.count(F.when(ready & ~broke, 1)).alias("enriched"), F.count(F.when(~ready, 1)).alias("skipped"),
        F.count(F.when(ready & broke, 1)).alias("failed"))


def delete_documents(tables: Mapping[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted documents."""
    ids = doomed.select("doc_id").distinct()
    return {name: df.join(ids, "doc_id", "left_anti") for name, df in tables.items()}
