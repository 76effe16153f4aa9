"""Feed pages and monthly archives of notices, parsed into tender rows and rejects."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from noticeworks import schemas
from noticeworks.functions import codes, dates
from noticeworks.operators.merge import latest_version
from noticeworks.sources import archives, cuts
from noticeworks.sources.members import unpacked

XML_OPTIONS = {
    "ignoreNamespace": "true",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt_record",
}
# The engine holds a value of at most this many bytes; where archives can't be read by range, larger ones are refused by name.
MAX_VALUE_BYTES = (1 << 31) - 1


def _entry_schema() -> T.StructType:
    return T.StructType([*schemas.ENTRY.fields, T.StructField("_corrupt_record", T.StringType())])


def _entries(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    return reader.format("xml").options(**XML_OPTIONS, rowTag="entry", encoding="UTF-8").schema(_entry_schema()).load(path)


def _entry_pieces(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """The text of every entry of feed files; finding them costs a small part of their parse."""
    cut = reader.format("text").option("lineSep", cuts.CUT).load(path)
    place = ("_metadata.file_path", "_metadata.file_block_start")
    found = cut.select(*place, F.col("value").cast("binary")).mapInArrow(cuts.entries, "piece binary")
    return found.select(F.col("piece").cast("string").alias("piece"))


def scan_entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries of the feed pages below a path."""
    return _entries(spark.read, path)


def stream_entries(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Entries as they land.

    A packed file is read by one task. Where batches are of so many files, entries are therefore
    only found by the tasks that read, then dealt out and parsed by all.
    """
    if max_files is None:
        return _entries(spark.readStream, path)
    pieces = _entry_pieces(spark.readStream.option("maxFilesPerTrigger", max_files), path)
    return _read_pieces(pieces.repartition(F.xxhash64("piece")))


def parse_page(text: Column) -> Column:
    """A feed page given as text: its links and its entries."""
    return F.from_xml(text, schemas.FEED, {"ignoreNamespace": "true"})


def next_link(links: Column) -> Column:
    """Address of the following page; null on the last one."""
    return F.get(F.filter(links, lambda x: x["_rel"] == "next"), F.lit(0))["_href"]


def elements(path: str, *more: str) -> Column:
    """All elements at a path below the entry, in the order of the document."""
    head, *steps = (*path.split("."), *more)
    return reduce(
        lambda found, name: F.flatten(
            F.transform(found, lambda one: F.coalesce(one[name], F.array()))
        ),
        steps,
        F.coalesce(F.col(head), F.array()),
    )


def first(path: str) -> Column:
    """The first element at a path; null if there is none."""
    return F.get(elements(path), F.lit(0))


def _fragments(text: Column) -> Column:
    """The entries of a page, and what follows the last one if the page breaks off there."""
    whole = F.regexp_extract_all(text, F.lit(r"(?s)<entry[\s>].*?</entry\s*>"), F.lit(0))
    rest = F.regexp_replace(text, r"(?s)\A.*</entry\s*>", "")
    broken = rest.rlike(r"<entry[\s>]") | ~text.rlike(r"</feed\s*>\s*\z")
    return F.concat(whole, F.when(broken, F.array(rest)).otherwise(F.array()))


def page_entries(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row per entry of page texts; the other columns are kept.

    A page that breaks off gives its whole entries and one corrupt record with the rest; a
    page with an `error` instead of a text gives one corrupt record with the error.
    """
    kept = [c for c in pages.columns if c not in (text, "error")]
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    pieces = F.when(error.isNull() & F.col(text).isNotNull(), _fragments(F.col(text)))
    pieces = F.coalesce(pieces, F.array(F.coalesce(error, F.lit("page without text"))))
    return _read_pieces(pages.select(*kept, F.explode(pieces).alias("piece")))


def _read_pieces(pieces: DataFrame) -> DataFrame:
    """The fields of entries given as text in `piece`; the other columns are kept."""
    kept = [c for c in pieces.columns if c != "piece"]
    # From the start of an entry to its end, which is the last thing that ends.
    last = F.substring_index("piece", "</", -1)
    whole = F.col("piece").rlike(r"\A<([\w.-]+:)?entry[\s>]") & last.rlike(r"\A([\w.-]+:)?entry\s*>\z")
    whole = whole & F.contains("piece", F.lit("</")) & F.is_valid_utf8("piece")
    corrupt = F.when(~whole, F.make_valid_utf8("piece"))
    # As rows of a generator, so that conditions on the fields don't parse an entry again for each field.
    parsed = F.inline(F.array(F.from_xml("piece", _entry_schema(), XML_OPTIONS)))
    return pieces.select(*kept, "piece", parsed).select(
        *kept,
        *schemas.ENTRY.fieldNames(),
        F.coalesce("_corrupt_record", corrupt).alias("_corrupt_record"),
    )


def scan_archive_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Archives as (path, content); one that the engine can't hold has an error instead of content."""
    files = spark.read.format("binaryFile").load(paths)
    none = F.lit(None)
    held = files.filter(F.col("length") <= MAX_VALUE_BYTES).select("path", "content", none.cast("string").alias("error"))
    larger = files.filter(F.col("length") > MAX_VALUE_BYTES).select(
        "path", none.cast("binary").alias("content"), F.lit("archive too large").alias("error")
    )
    return held.unionByName(larger)


_MEMBER = "path string, member string, method int, crc bigint, packed binary, error string"


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The feed pages of archives as they are packed, found through the archive's directory."""
    names = [column.split()[0] for column in _MEMBER.split(", ")]
    for batch in batches:
        for path, content, error in zip(batch["path"], batch["content"], batch["error"]):
            rows = []
            try:
                if error is not None:
                    raise zipfile.BadZipFile(error)
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for info in archive.infolist():
                        if info.filename.endswith(".atom"):
                            lengths = struct.unpack_from("<HH", content, info.header_offset + 26)
                            start = info.header_offset + 30 + sum(lengths)
                            packed = content[start : start + info.compress_size]
                            fault = "member encrypted" if info.flag_bits & 1 else None
                            rows.append((path, info.filename, info.compress_type, info.CRC, packed, fault))
            except (zipfile.BadZipFile, struct.error) as fault:
                rows.append((path, None, None, None, None, error or f"archive unreadable: {fault}"))
            for row in rows:
                frame = pd.DataFrame([row], columns=names)
                yield frame.astype({"method": "Int32", "crc": "Int64"})


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, errors = [], []
        for packed, method, crc, error in zip(batch["packed"], batch["method"], batch["crc"], batch["error"]):
            text = None
            if error is None:
                try:
                    text = unpacked(packed, int(method), int(crc))
                except ValueError as fault:
                    error = str(fault)
            texts.append(text)
            errors.append(error)
        yield pd.DataFrame({"path": batch["path"], "member": batch["member"], "text": texts, "error": errors})


def archive_pages(archives: DataFrame) -> DataFrame:
    """Every feed page packed in the archives: path, member and its text, or an error.

    A task that holds an archive only cuts it into its packed members; these are dealt out,
    then unpacked, checked and decoded, so one archive keeps many tasks busy.
    """
    error = F.col("error") if "error" in archives.columns else F.lit(None).cast("string")
    members = archives.select("path", "content", error.alias("error")).mapInPandas(_members, _MEMBER)
    return members.repartition("path", "member").mapInPandas(
        _pages, "path string, member string, text string, error string"
    )


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every feed page packed in archive files: path, member and its text, or an error.

    Archives are read by range, of any size and with several tasks each. In a store that only
    Spark's own readers know, each is read as one value and cut by one task, and one larger
    than the engine can hold as a value gives an error.
    """
    if all(map(archives.readable, paths)):
        return archives.read_archives(spark, paths)
    return archive_pages(scan_archive_files(spark, paths))


def archive_paths(base: str, reference: str, count: int, spark: SparkSession) -> list[str]:
    """Load paths of the monthly archives up to a date, oldest first."""
    months = dates.recent_months(F.lit(reference).cast("date"), count)
    row = spark.range(1).select(F.transform(months, dates.month_label).alias("m")).first()
    return [f"{base.rstrip('/')}/notices_{label}.zip" for label in row["m"]]


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def parse_entries(entries: DataFrame, *extra: str) -> DataFrame:
    """Entries as tender rows with the reasons, if any, for which a row is refused.

    Nothing fails: a missing required field, an unknown code, or a malformed
    number, date or time leaves its reason in `reasons`.
    """
    status = "ContractFolderStatus"
    project = f"{status}.ProcurementProject"
    process = f"{status}.TenderingProcess"
    period = f"{process}.TenderSubmissionDeadlinePeriod"
    budget = f"{project}.BudgetAmount"
    uri = "Attachment.ExternalReference.URI"
    issued = "AdditionalPublicationStatus.AdditionalPublicationDocumentReference.IssueDate"
    given = lambda x: x.isNotNull() & (x != "")
    raw = entries.select(
        *extra,
        *(["_corrupt_record"] if "_corrupt_record" in entries.columns else []),
        first(f"{status}.ContractFolderID").alias("expediente"),
        first(f"{status}.LocatedContractingParty.Party.PartyName.Name").alias("contracting_body"),
        first(f"{project}.Name").alias("title"),
        F.filter(
            elements(f"{project}.RequiredCommodityClassification.ItemClassificationCode"), given
        ).alias("codes"),
        first(f"{budget}.TotalAmount").alias("with_vat"),
        first(f"{budget}.TaxExclusiveAmount").alias("without_vat"),
        first(f"{budget}.EstimatedOverallContractAmount").alias("estimated"),
        first(f"{project}.TypeCode").alias("type_code"),
        first(f"{process}.ProcedureCode").alias("procedure_code"),
        first(f"{status}.ContractFolderStatusCode").alias("status_code"),
        first(f"{period}.EndDate").alias("end_date"),
        first(f"{period}.EndTime").alias("end_time"),
        first(f"{project}.RealizedLocation.CountrySubentity").alias("location"),
        first(f"{status}.LegalDocumentReference.{uri}").alias("pcap_url"),
        first(f"{status}.TechnicalDocumentReference.{uri}").alias("ppt_url"),
        F.get(F.col("link"), F.lit(0))["_href"].alias("platform_url"),
        F.filter(elements(f"{status}.ValidNoticeInfo.{issued}"), given).alias("issue_dates"),
        first("updated").alias("updated_text"),
    )
    money = lambda c: F.col(c).try_cast(schemas.MONEY)
    typed = (
        raw.withColumn("budget_with_vat", money("with_vat"))
        .withColumn("budget_without_vat", money("without_vat"))
        .withColumn("estimated_value", money("estimated"))
        .withColumn("contract_type", codes.label_of(F.col("type_code"), codes.CONTRACT_TYPES))
        .withColumn("procedure_type", codes.label_of(F.col("procedure_code"), codes.PROCEDURES))
        .withColumn("status", codes.label_of(F.col("status_code"), codes.STATUSES))
        .withColumn(
            "submission_deadline", dates.parse_deadline(F.col("end_date"), F.col("end_time"))
        )
        .withColumn("updated_at_source", dates.parse_updated(F.col("updated_text")))
        .withColumn("cpv_codes", F.coalesce("codes", F.array().cast("array<string>")))
        .withColumn(
            "published_at", dates.published_at(F.col("issue_dates"), F.col("updated_at_source"))
        )
    )
    bad_number = lambda text, value: F.col(text).isNotNull() & F.col(value).isNull()
    bad_date = F.exists("issue_dates", lambda d: dates.parse_date(d).isNull())
    rules = {
        "expediente missing": _blank(F.col("expediente")),
        "contracting_body missing": _blank(F.col("contracting_body")),
        "title missing": _blank(F.col("title")),
        "contract_type unknown": F.col("contract_type").isNull(),
        "procedure_type unknown": F.col("procedure_type").isNull(),
        "status unknown": F.col("status").isNull(),
        "budget_with_vat malformed": bad_number("with_vat", "budget_with_vat"),
        "budget_without_vat malformed": bad_number("without_vat", "budget_without_vat"),
        "estimated_value malformed": bad_number("estimated", "estimated_value"),
        "submission_deadline malformed": bad_number("end_date", "submission_deadline"),
        "published_at malformed": F.coalesce(bad_date, F.lit(False)),
        "updated missing or malformed": F.col("updated_at_source").isNull(),
    }
    if "_corrupt_record" in raw.columns:
        rules["entry malformed"] = F.col("_corrupt_record").isNotNull()
    reasons = F.array_compact(
        F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()])
    )
    # Likewise here: a condition on the reasons doesn't work them out a second time.
    row = F.struct(*extra, *schemas.TENDER_COLUMNS, "updated_text", reasons.alias("reasons"))
    return typed.select(row.alias("row")).select(F.inline(F.array("row")))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.size("reasons") == 0).drop("reasons", "updated_text")


def rejects(parsed: DataFrame) -> DataFrame:
    """Refused rows with their reasons, and where they came from if that is known."""
    place = [c for c in ("path", "member") if c in parsed.columns]
    return parsed.filter(F.size("reasons") > 0).select(
        *place, "expediente", F.col("updated_text").alias("updated"), "reasons"
    )


def ingest(parsed: DataFrame, high_water_mark: Column | None = None) -> DataFrame:
    """Accepted notices of the IT division that are not older than the mark, newest version each.

    Entries exactly at the mark are read again: merging them twice is harmless,
    while skipping them would lose one that arrived late with the same time.
    """
    rows = accepted(parsed)
    if high_water_mark is not None:
        rows = rows.filter(F.col("updated_at_source") >= high_water_mark)
    in_scope = rows.filter(codes.in_it_division(F.col("cpv_codes")))
    return latest_version(in_scope, "expediente", "updated_at_source", "title", "status")
