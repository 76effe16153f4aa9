"""Jobs over document pages: text layer, prompts, clauses, offsets, chunks, content hashes.

A document may hold any number of pages, so no job here gathers a whole
document. Running totals go through page blocks, and long results come as
numbered parts of bounded length that concatenate to the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.functions.display import fill
from noticeworks.functions.text import SPACE, visible_length

# Readable-page threshold, prompt marks, clause header.
MIN_CHARS_PER_PAGE = 20
PROMPT_OPEN = "<PLIEGO>"
PROMPT_CLOSE = "</PLIEGO>"
PROMPT_NEUTRAL = "[marca eliminada]"
PROMPT_PAGE = "===== PÁGINA {page} =====\n{text}"
CLAUSE_HEADER = r"Cl[aá]usula\s+(\d+(?:\.\d+)*)\s*[.\-:]?\s*(.+)"
CHUNK_SIZE = 500

BLOCK_PAGES = 4096
# Prompts and clauses come in parts of so many pages, whatever their length.
PART_PAGES = 4


def text_layer(pages: DataFrame) -> DataFrame:
    """Whether the pages of a document carry readable text on average."""
    per_page = F.sum(visible_length(F.col("text"))) / F.count("*")
    return (
        pages.groupBy("doc_id")
        .agg(F.count("*").alias("pages"), F.round(per_page, 6).alias("chars_per_page"))
        .withColumn("has_text_layer", F.col("chars_per_page") >= MIN_CHARS_PER_PAGE)
    )


def content_hash(rows: DataFrame, content: str) -> DataFrame:
    return rows.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256))


def running_before(
    rows: DataFrame,
    sums: dict[str, Column],
    latest: dict[str, Column] | None = None,
    block: int = BLOCK_PAGES,
) -> DataFrame:
    """Adds, per document, sums and maxima over all earlier pages.

    Two levels: totals per block of pages, a window over those totals, and a
    window inside each block. A document with very many pages is thereby spread
    over many tasks; only one row per block meets in one place.
    """
    latest = latest or {}
    blocked = rows.withColumn("block", F.floor(F.col("page") / block))
    totals = blocked.groupBy("doc_id", "block").agg(
        *[F.sum(c).alias(f"block_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"block_{n}") for n, c in latest.items()],
    )
    earlier_blocks = (
        Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = totals.select(
        "doc_id",
        "block",
        *[F.sum(f"block_{n}").over(earlier_blocks).alias(f"block_{n}") for n in sums],
        *[F.max(f"block_{n}").over(earlier_blocks).alias(f"block_{n}") for n in latest],
    )
    earlier_pages = (
        Window.partitionBy("doc_id", "block")
        .orderBy("page")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0)
    both = blocked.join(before, ["doc_id", "block"])
    for name, column in sums.items():
        inside = F.coalesce(F.sum(column).over(earlier_pages), zero)
        both = both.withColumn(name, F.coalesce(F.col(f"block_{name}"), zero) + inside)
    for name, column in latest.items():
        both = both.withColumn(
            name, F.coalesce(F.max(column).over(earlier_pages), F.col(f"block_{name}"))
        )
    return both.drop("block", *[f"block_{n}" for n in (*sums, *latest)])


def page_offsets(pages: DataFrame) -> DataFrame:
    """Character offset of every page in the text of its document, one line end per page."""
    sized = pages.select("doc_id", "page", (F.length("text") + 1).alias("size"))
    return running_before(sized, {"start_offset": F.col("size")})


def fixed_chunks(pages: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Blind windows of `size` characters over the text of a document.

    Each page is cut at the window borders it meets; a window then joins at most
    `size` pieces, since every piece has at least one character.
    """
    placed = running_before(
        pages.select("doc_id", "page", F.concat("text", F.lit("\n")).alias("text")),
        {"start": F.length("text")},
    )
    end = F.col("start") + F.length("text")
    windows = F.sequence(F.floor(F.col("start") / size), F.floor((end - 1) / size))
    pieces = placed.withColumn("chunk", F.explode(windows))
    low = F.greatest(F.col("chunk") * size, F.col("start"))
    high = F.least((F.col("chunk") + 1) * size, end)
    piece = F.substr(
        "text", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")
    )
    return _joined_in_order(
        pieces.withColumn("piece", piece), ["doc_id", "chunk"], "page", "piece", ""
    )


def _joined_in_order(
    rows: DataFrame, keys: list[str], order: str, text: str, separator: str, *extra: Column
) -> DataFrame:
    """Concatenates the texts of a group that is bounded by its keys."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    joined = F.array_join(F.transform(ordered, lambda e: e["t"]), separator)
    return rows.groupBy(*keys).agg(joined.alias("text"), *extra)


def doc_prompt(pages: DataFrame, part_pages: int = PART_PAGES) -> DataFrame:
    """The labelled text of a document between two marks: one row per `part_pages` pages.

    The parts of a document concatenate to its whole prompt in the order of `part`.
    """
    neutral = F.replace(
        F.replace(F.col("text"), F.lit(PROMPT_CLOSE), F.lit(PROMPT_NEUTRAL)),
        F.lit(PROMPT_OPEN),
        F.lit(PROMPT_NEUTRAL),
    )
    labelled = pages.select(
        "doc_id",
        "page",
        F.floor((F.col("page") - 1) / part_pages).alias("part"),
        fill(PROMPT_PAGE, page=F.col("page").cast("string"), text=neutral).alias("block"),
    )
    parts = _joined_in_order(labelled, ["doc_id", "part"], "page", "block", "\n\n")
    number = F.floor((F.col("page") - 1) / part_pages)
    last = pages.groupBy("doc_id").agg(F.min(number).alias("first_part"), F.max(number).alias("last_part"))
    opening = F.when(F.col("part") == F.col("first_part"), F.lit(PROMPT_OPEN + "\n")).otherwise("")
    closing = F.when(F.col("part") == F.col("last_part"), F.lit("\n" + PROMPT_CLOSE)).otherwise(
        "\n\n"
    )
    return parts.join(last, "doc_id").select(
        "doc_id", "part", F.concat(opening, F.col("text"), closing).alias("prompt")
    )


_FLAGS = "(?iumdU)"


def clause_chunks(pages: DataFrame, part_pages: int = PART_PAGES) -> DataFrame:
    """Clauses, each from its header to the next one, with the page it starts on.

    Text before the first header of a document is dropped. Every page splits
    into pieces by itself; the number of headers on earlier pages tells which
    clause a piece belongs to. A clause comes in numbered parts, one for each
    `part_pages` pages from the one it starts on.
    """
    starts = F.col("text").rlike(rf"(?iudU)\A{CLAUSE_HEADER}")
    split = pages.select(
        "doc_id",
        "page",
        F.split(F.concat("text", F.lit("\n")), rf"{_FLAGS}(?=^{CLAUSE_HEADER})").alias("pieces"),
        starts.alias("starts"),
    ).withColumn("headers", F.size("pieces") - F.when(F.col("starts"), 0).otherwise(1))
    placed = running_before(
        split,
        {"clauses_before": F.col("headers")},
        {"open_since": F.when(F.col("headers") > 0, F.col("page"))},
    )
    pieces = placed.select(
        "doc_id",
        "page",
        "starts",
        "clauses_before",
        "open_since",
        F.posexplode("pieces").alias("index", "piece"),
    )
    is_header = F.col("starts") | (F.col("index") > 0)
    numbered = (
        pieces.withColumn(
            "clause_index",
            F.col("clauses_before") + F.col("index") + F.when(F.col("starts"), 1).otherwise(0),
        )
        .filter(F.col("clause_index") > 0)
        .withColumn("start_page", F.when(is_header, F.col("page")).otherwise(F.col("open_since")))
        .withColumn("part", F.floor((F.col("page") - F.col("start_page")) / part_pages))
        .withColumn("header", F.when(is_header, F.col("piece")))
    )
    header = F.max("header").alias("header")
    clause = Window.partitionBy("doc_id", "clause_index")
    joined = (
        _joined_in_order(
            numbered, ["doc_id", "clause_index", "start_page", "part"], "page", "piece", "", header
        )
        .withColumn("header", F.max("header").over(clause))
        .withColumn("last_part", F.max("part").over(clause))
    )
    trimmed = F.regexp_replace("text", rf"{SPACE}+\z", "")
    at_start = rf"(?iudU)\A{CLAUSE_HEADER}"
    strip = lambda c: F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")
    return joined.select(
        "doc_id",
        "clause_index",
        "part",
        F.regexp_extract("header", at_start, 1).alias("number"),
        strip(F.regexp_extract("header", at_start, 2)).alias("title"),
        F.col("start_page").alias("page"),
        F.when(F.col("part") < F.col("last_part"), F.col("text")).otherwise(trimmed).alias("text"),
    )


SETTLED = ("completed", "not_analyzable")


def hash_reuse(analyses: DataFrame) -> DataFrame:
    """For every analysis the settled analysis of the same content under another key.

    The donor is the smallest such key. The two smallest settled keys per hash
    are enough to leave out one's own, so equal documents never meet pairwise,
    and the rank limit cuts a very common hash down inside each task.
    """
    settled = analyses.filter(F.col("status").isin(*SETTLED) & F.col("pdf_hash").isNotNull())
    order = Window.partitionBy("pdf_hash").orderBy("expediente")
    ranked = (
        settled.select("pdf_hash", "expediente", F.col("status").alias("donor_status"))
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= 2)
    )
    at = lambda n, c: F.max(F.when(F.col("position") == n, F.col(c)))
    donors = ranked.groupBy("pdf_hash").agg(
        at(1, "expediente").alias("first"),
        at(2, "expediente").alias("second"),
        at(1, "donor_status").alias("first_status"),
        at(2, "donor_status").alias("second_status"),
    )
    own = F.col("first") == F.col("expediente")
    rows = analyses.select("expediente", "pdf_hash", "status")
    found = rows.filter(F.col("pdf_hash").isNotNull()).join(donors, "pdf_hash", "left").select(
        "expediente",
        "pdf_hash",
        "status",
        F.when(own, F.col("second")).otherwise(F.col("first")).alias("donor"),
        F.when(own, F.col("second_status")).otherwise(F.col("first_status")).alias("donor_status"),
    )
    # Without a hash there is no donor, and no reason for such rows to meet in one place.
    without = rows.filter(F.col("pdf_hash").isNull())
    return found.unionByName(without, allowMissingColumns=True)


# What an analysis takes over from its donor, besides the status.
COPIED = ("extraction", "citation_faithfulness", "error_message")


def copy_from_donor(analyses: DataFrame) -> DataFrame:
    """Unsettled analyses take over the result of their donor, if there is one; `reused` marks them."""
    reuse = hash_reuse(analyses).filter(~F.col("status").isin(*SETTLED) & F.col("donor").isNotNull())
    given = analyses.select(
        F.col("expediente").alias("donor"), *[F.col(c).alias(f"donor_{c}") for c in COPIED]
    )
    copies = reuse.join(given, "donor").drop("pdf_hash", "status", "donor")
    taken = F.col("donor_status").isNotNull()
    chosen = {c: F.when(taken, F.col(f"donor_{c}")).otherwise(F.col(c)) for c in ("status", *COPIED)}
    return (
        analyses.join(copies, "expediente", "left")
        .withColumns(chosen | {"reused": taken})
        .drop(*[f"donor_{c}" for c in ("status", *COPIED)])
    )

