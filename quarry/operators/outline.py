"""From parsed text to sections and chunks.

Everything here is per document. The text is laid out by ``doc_id`` once; outline windows,
tree building and the join back to the text reuse that layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx

CHUNK_CHARS = 1000
MIN_CHARS_PER_PAGE = 20
WINDOW_CHARS = 24_000
WINDOW_OVERLAP = 500
MARK = "\ufdd0"  # a Unicode noncharacter, reserved for process-internal use
_S = tx.BLANK

# Heading lines and headings that carry no structure.
HEADING_LINE = f"(?mdU)^(#{{1,6}}){_S}+(.+?){_S}*$"
GENERIC_HEADINGS = ["metadata", "contents"]


# ---- pages -----------------------------------------------------------------------------


def assemble_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, page, body`` rows to marked text and one outline node per page.

    Body length excludes the markers, so an empty scan is still recognized.
    """
    body = tx.strip("body")
    pieces = pages.select(
        "doc_id", "page", F.length(body).alias("body_chars"),
        F.concat(F.lit("### Page "), F.col("page").cast("string"), F.lit("\n"), body, F.lit("\n\n")).alias("piece"),
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "piece"))), lambda s: s["piece"])
    text = pieces.groupBy("doc_id").agg(
        F.array_join(parts, "").alias("text"), F.count(F.lit(1)).cast("int").alias("page_count"),
        F.sum("body_chars").alias("body_chars"),
    )
    running = Window.partitionBy("doc_id").orderBy("page")
    end = F.sum(F.length("piece")).over(running).cast("int")
    outline = pieces.select(
        "doc_id", F.row_number().over(running).alias("idx"), F.concat(F.lit("Page "), F.col("page").cast("string")).alias("heading"),
        F.lit(3).alias("level"), (end - F.length("piece")).alias("char_start"), end.alias("char_end"),
        F.col("page").cast("int").alias("page_start"), F.col("page").cast("int").alias("page_end"),
    )
    return text, outline


def negligible_text(text: str | Column, page_count: str | Column, minimum: int = MIN_CHARS_PER_PAGE) -> Column:
    """Too few characters per page to be a real text layer."""
    pages = F.col(page_count) if isinstance(page_count, str) else page_count
    return F.length(tx.strip(text)) / F.greatest(pages, F.lit(1)) < minimum


# ---- outline ---------------------------------------------------------------------------


def heading_ranges(nodes: DataFrame) -> DataFrame:
    """Add ``char_end``: the start of the next node at the same or a shallower level."""
    later = Window.partitionBy("doc_id").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.lit(None).cast("int")
    for level in range(1, 7):
        nearest = F.min(F.when(F.col("level") <= level, F.col("char_start"))).over(later)
        ends = F.when(F.col("level") == level, nearest).otherwise(ends)
    return nodes.withColumn("char_end", F.coalesce(ends, F.col("text_len")))


def markdown_outline(docs: DataFrame) -> DataFrame:
    """Heading lines of ``doc_id, text, page_count`` with level and character range.

    Each heading start is marked, then the text is cut at the marks: offsets are running
    lengths of the pieces, and a bare ``##`` takes the next non-blank line as in the pattern.
    """
    pieces = docs.select(
        "doc_id", F.length("text").alias("text_len"), F.greatest("page_count", F.lit(1)).cast("int").alias("page_end"),
        F.posexplode(F.split(F.regexp_replace("text", HEADING_LINE, MARK + "$0"), MARK)).alias("idx", "piece"),
    )
    before = Window.partitionBy("doc_id").orderBy("idx")
    placed = pieces.withColumn("char_start", (F.sum(F.length("piece")).over(before) - F.length("piece")).cast("int"))
    nodes = placed.filter("idx > 0").select(
        "doc_id", "idx", tx.strip(F.regexp_extract("piece", HEADING_LINE, 2)).alias("heading"),
        F.length(F.regexp_extract("piece", HEADING_LINE, 1)).alias("level"), "char_start", "text_len",
        F.lit(1).alias("page_start"), "page_end",
    )
    return heading_ranges(nodes).select("doc_id", "idx", "heading", "level", "char_start", "char_end", "page_start", "page_end")


def is_generic(heading: str | Column) -> Column:
    """Empty, a page marker, a generic wrapper or a file name."""
    h = tx.strip(F.coalesce(F.col(heading) if isinstance(heading, str) else heading, F.lit("")))
    return (
        (h == "") | h.rlike(f"(?iU)^page{_S}+\\d+$") | F.lower(h).isin(GENERIC_HEADINGS) | h.rlike(r"(?U)\.\w{2,5}$")
    )


def degenerate(docs: DataFrame, outline: DataFrame) -> DataFrame:
    """``doc_id, degenerate``: no outline, or nothing but generic headings."""
    flags = outline.groupBy("doc_id").agg(F.bool_and(is_generic("heading")).alias("d"))
    return docs.select("doc_id").join(flags, "doc_id", "left").select("doc_id", F.coalesce("d", F.lit(True)).alias("degenerate"))


# ---- section tree ----------------------------------------------------------------------


def section_tree(docs: DataFrame, outline: DataFrame) -> DataFrame:
    """Nested sections from a flat outline: parent, ordinal among siblings, depth and path.

    An earlier node is an open ancestor when no node after it has an equal or smaller level;
    one running window per level finds them all without joins. A document without outline
    gets one root over its whole text.
    """
    order = Window.partitionBy("doc_id").orderBy("idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last_at = [F.max(F.when(F.col("level") == n, F.col("idx"))).over(before) for n in range(1, 7)]
    seen = outline.select("*", *[c.alias(f"_l{n}") for n, c in enumerate(last_at, 1)])
    parent = F.greatest(*[F.when(F.col("level") > n, F.col(f"_l{n}")) for n in range(1, 7)])
    nodes = seen.withColumn("parent_idx", parent)
    siblings = Window.partitionBy("doc_id", "parent_idx").orderBy("idx")
    nodes = nodes.withColumn("ordinal", F.row_number().over(siblings) - 1)
    through = order.rowsBetween(Window.unboundedPreceding, 0)
    at = [F.max(F.when(F.col("level") == n, F.struct("idx", "ordinal"))).over(through) for n in range(1, 7)]
    nodes = nodes.select("*", *[c.alias(f"_n{n}") for n, c in enumerate(at, 1)])
    steps = []
    for n in range(1, 7):
        here = F.col(f"_n{n}")
        shallower = [F.coalesce(F.col(f"_n{m}")["idx"], F.lit(-1)) for m in range(1, n)]
        is_open = (here["idx"] > F.greatest(*shallower, F.lit(-1))) if shallower else here.isNotNull()
        steps.append(F.when((F.col("level") >= n) & is_open, (here["ordinal"] + 1).cast("string")))
    open_steps = F.filter(F.array(*steps), lambda x: x.isNotNull())
    next_level = F.lead("level").over(order)
    tree = nodes.select(
        "doc_id", "idx", "parent_idx", F.col("ordinal").cast("int").alias("ordinal"), F.size(open_steps).alias("depth"),
        F.array_join(open_steps, ".").alias("path"), "heading", "page_start", "page_end", "char_start", "char_end",
        F.coalesce(next_level <= F.col("level"), F.lit(True)).alias("is_leaf"),
    )
    bare = docs.join(outline.select("doc_id").distinct(), "doc_id", "left_anti")
    roots = bare.select(
        "doc_id", F.lit(1).alias("idx"), F.lit(None).cast("int").alias("parent_idx"), F.lit(0).alias("ordinal"), F.lit(0).alias("depth"),
        F.lit("1").alias("path"), F.lit(None).cast("string").alias("heading"), F.lit(1).alias("page_start"),
        F.greatest("page_count", F.lit(1)).cast("int").alias("page_end"), F.lit(0).alias("char_start"),
        F.length("text").alias("char_end"), F.lit(True).alias("is_leaf"),
    )
    every = tree.unionByName(roots)
    parent_path = F.when(F.instr("path", ".") > 0, F.regexp_replace("path", r"\.\d+$", ""))
    key = lambda p: F.concat_ws("/", F.col("doc_id").cast("string"), p)
    return every.select(
        key(F.col("path")).alias("section_id"), F.when(parent_path.isNotNull(), key(parent_path)).alias("parent_section_id"), "*"
    ).drop("parent_idx")


def leaves(sections: DataFrame) -> DataFrame:
    """Only leaves are chunked; text before a parent's first child yields no chunk."""
    return sections.filter("is_leaf")


# ---- chunks ----------------------------------------------------------------------------


def text_windows(segment: str, target: int = CHUNK_CHARS) -> Column:
    """Array of ``(s, e)`` windows of at most ``target`` characters, cut after the last space.

    Two neighbouring windows always cover more than ``target`` characters, which bounds the
    number of fold steps.
    """
    return F.expr(
        f"""aggregate(
        sequence(1, 2 * cast(ceil(length({segment}) / {target}.0) AS int) + 2),
        named_struct('pos', 0, 'out', cast(array() AS array<struct<s:int,e:int>>)),
        (a, i) -> CASE WHEN a.pos >= length({segment}) THEN a ELSE
          element_at(transform(
            transform(array(substring({segment}, a.pos + 1, {target})), w ->
              a.pos + CASE WHEN a.pos + {target} < length({segment}) AND length(w) - locate(' ', reverse(w)) + 1 >= 2
                           AND locate(' ', reverse(w)) > 0
                      THEN length(w) - locate(' ', reverse(w)) + 1 ELSE length(w) END),
            e -> named_struct('pos', e, 'out', concat(a.out, array(named_struct('s', a.pos, 'e', e))))), 1) END,
        a -> a.out)"""
    )


def chunk_id(doc_id: Column, ordinal: Column, content: Column) -> Column:
    """UUID made of the first 16 bytes of the SHA-256 of document, ordinal and content."""
    h = F.sha2(F.concat_ws("|", doc_id.cast("string"), ordinal.cast("string"), content), 256)
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def chunks(docs: DataFrame, sections: DataFrame, target: int = CHUNK_CHARS) -> DataFrame:
    """Chunks of every leaf section in document order, numbered per document."""
    leaf = leaves(sections).select("doc_id", "section_id", "idx", "char_start", "char_end")
    cut = docs.select("doc_id", "text").join(leaf, "doc_id")
    cut = cut.select("doc_id", "section_id", "idx", "char_start",
                     F.expr("substring(text, char_start + 1, char_end - char_start)").alias("segment"))
    rows = cut.select("doc_id", "section_id", "idx", "char_start", "segment", F.inline(text_windows("segment", target)))
    rows = rows.select(
        "doc_id", "section_id", "idx", (F.col("char_start") + F.col("s")).alias("char_start"), (F.col("char_start") + F.col("e")).alias("char_end"),
        F.expr("substring(segment, s + 1, e - s)").alias("content"),
    ).filter(tx.strip("content") != "")
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx", "char_start")) - 1
    return rows.withColumn("ordinal", ordinal).select(
        chunk_id(F.col("doc_id"), F.col("ordinal"), F.col("content")).alias("chunk_id"), "doc_id", "section_id", "ordinal", "content",
        F.greatest(F.floor(F.length("content") / 4).cast("int"), F.lit(1)).alias("token_count"), "char_start", "char_end",
    )


def structure(docs: DataFrame, outline: DataFrame | None = None, target: int = CHUNK_CHARS) -> tuple[DataFrame, DataFrame]:
    """Sections and chunks of ``doc_id, text, page_count``."""
    docs = docs.repartition("doc_id")
    outline = markdown_outline(docs) if outline is None else outline
    sections = section_tree(docs, outline)
    return sections, chunks(docs, sections, target)


def replace_documents(stored: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of touched documents leave together with entering their new rows."""
    return stored.join(touched.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh)


def tiling_report(sections: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """Gaps, overlaps and bad ends of each leaf's chunks: section_id, issue, at."""
    w = Window.partitionBy("section_id").orderBy("char_start")
    leaf = leaves(sections).select("section_id", F.col("char_start").alias("from"), F.col("char_end").alias("to"))
    rows = chunk_rows.select("section_id", "char_start", "char_end").withColumns({
        "prev": F.lag("char_end").over(w), "next": F.lead("char_start").over(w)}).join(leaf, "section_id")
    issue = (
        F.when(F.col("prev").isNull() & (F.col("char_start") != F.col("from")), F.lit("bad_start"))
        .when(F.col("char_start") > F.col("prev"), F.lit("gap"))
        .when(F.col("char_start") < F.col("prev"), F.lit("overlap"))
    )
    found = rows.select("section_id", issue.alias("issue"), F.col("char_start").alias("at")).filter("issue is not null")
    ends = rows.filter(F.col("next").isNull() & (F.col("char_end") != F.col("to"))).select(
        "section_id", F.lit("bad_end").alias("issue"), F.col("char_end").alias("at"))
    empty = leaf.filter(F.col("to") > F.col("from")).join(chunk_rows.select("section_id").distinct(), "section_id", "left_anti").select(
        "section_id", F.lit("empty").alias("issue"), F.col("from").alias("at"))
    return found.unionByName(ends).unionByName(empty)


# ---- headings proposed by a model -------------------------------------------------------


def extractor_windows(docs: DataFrame, size: int = WINDOW_CHARS) -> DataFrame:
    """``doc_id, window, segment``: consecutive windows that overlap by min(500, size // 4)."""
    overlap = min(WINDOW_OVERLAP, size // 4)
    n = F.greatest(F.lit(0), F.ceil((F.length("text") - overlap) / F.lit(size - overlap)) - 1)
    starts = F.sequence(F.lit(0), n.cast("int"))
    rows = docs.filter(F.length("text") > 0).select("doc_id", "text", F.explode(starts).alias("window"))
    return rows.select("doc_id", "window", F.substring("text", F.col("window") * (size - overlap) + 1, F.lit(size)).alias("segment"))


def parse_headings(response: str | Column) -> Column:
    """Array of ``(heading, level)`` from a model's JSON; null when it is not a JSON array."""
    def without_fence(raw: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(raw, r"^```[^\n]*\n", ""), "```\\z", "")
        return F.when(raw.startswith("```"), inner).otherwise(raw)

    kind = lambda x, f: F.coalesce(F.schema_of_variant(F.try_variant_get(x, f, "variant")), F.lit(""))

    def item(x: Column) -> Column:
        return F.struct(
            tx.strip(F.try_variant_get(x, "$.heading", "string")).alias("heading"),
            F.greatest(F.lit(1), F.least(F.lit(6), F.try_variant_get(x, "$.level", "int"))).alias("level"),
            ((kind(x, "$.heading") == "STRING") & (kind(x, "$.level") == "BIGINT")).alias("typed"),
        )

    def read(json: Column) -> Column:
        items = F.when(F.schema_of_variant(json).startswith("ARRAY"), json.try_cast("array<variant>"))
        usable = F.filter(F.transform(items, item), lambda x: x["typed"] & (x["heading"] != "") & (F.length(x["heading"]) <= 300))
        return F.transform(usable, lambda x: F.struct(x["heading"].alias("heading"), x["level"].alias("level")))

    return tx.bind(tx.strict_json(tx.bind(tx.strip(response), without_fence)), read)


def locate_headings(docs: DataFrame, responses: DataFrame) -> DataFrame:
    """Outline nodes for proposed headings, located by exact search with a forward cursor.

    ``responses``: doc_id, window, response. Generic headings and a repeat of the previous one
    from the neighbouring window are dropped; a heading that is not found is skipped.
    """
    rows = responses.select("doc_id", "window", F.posexplode(parse_headings("response")).alias("pos", "h"))
    rows = rows.select("doc_id", "window", "pos", F.col("h.heading").alias("heading"), F.col("h.level").alias("level"))
    rows = rows.filter(~is_generic("heading"))
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("window", "pos", "heading", "level"))).alias("hs"))
    joined = docs.join(listed, "doc_id")
    folded = joined.select(
        "doc_id", F.length("text").alias("text_len"), F.greatest("page_count", F.lit(1)).cast("int").alias("page_end"),
        F.expr(
            """aggregate(hs,
            named_struct('cursor', 0, 'prev', cast(null AS string), 'pw', -9, 'out', cast(array() AS array<struct<heading:string,level:int,char_start:int>>)),
            (a, h) -> CASE WHEN a.prev IS NOT NULL AND h.heading = a.prev AND a.pw = h.window - 1 THEN a
              ELSE element_at(transform(array(locate(h.heading, text, a.cursor + 1)), at ->
                CASE WHEN at = 0 THEN named_struct('cursor', a.cursor, 'prev', h.heading, 'pw', h.window, 'out', a.out)
                ELSE named_struct('cursor', at - 1 + length(h.heading), 'prev', h.heading, 'pw', h.window,
                  'out', concat(a.out, array(named_struct('heading', h.heading, 'level', h.level, 'char_start', at - 1)))) END), 1) END,
            a -> a.out)"""
        ).alias("nodes"),
    )
    nodes = folded.select("doc_id", "text_len", "page_end", F.posexplode("nodes").alias("idx", "n")).select(
        "doc_id", (F.col("idx") + 1).alias("idx"), F.col("n.heading").alias("heading"), F.col("n.level").alias("level"),
        F.col("n.char_start").alias("char_start"), "text_len", F.lit(1).alias("page_start"), "page_end")
    return heading_ranges(nodes).drop("text_len")
