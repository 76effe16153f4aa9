"""Feed entries, pages and archives written from the derived tenders, with faulty entries among them."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks import schemas
from noticeworks.operators.reshape import to_text
from noticeworks.plans import views
from noticeworks.session import shared_dir
from noticeworks.sources import archives as source
from noticeworks.sources import feed
from noticeworks.sources.tables import read_table

# A page holds the entries of one month whose keys fall into one range of this width.
PAGE_WIDTH = 4000
# Folders that this application has written for a table directory.
_WRITTEN: dict[tuple[str, ...], str] = {}
# Namespace names of the public notice format.
_NAMESPACES = (
    'xmlns="http://www.w3.org/2005/Atom" '
    'xmlns:cbc="urn:dgpe:names:draft:codice:schema:xsd:CommonBasicComponents-2" '
    'xmlns:cac="urn:dgpe:names:draft:codice:schema:xsd:CommonAggregateComponents-2" '
    'xmlns:cbcx="urn:dgpe:names:draft:codice-place-ext:schema:xsd:CommonBasicComponents-2" '
    'xmlns:cacx="urn:dgpe:names:draft:codice-place-ext:schema:xsd:CommonAggregateComponents-2"'
)
# What a page begins with, up to the name of the next one.
_OPENING = f'<feed {_NAMESPACES}><link rel="self" href="p"/><link rel="next" href="p'


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _element(name: str, *content: Column, attributes: str = "") -> Column:
    """An element around its content. A single missing content leaves no element."""
    opening = F.lit(f"<{name} {attributes}>" if attributes else f"<{name}>")
    inner = content if len(content) == 1 else [F.coalesce(c, F.lit("")) for c in content]
    return F.concat(opening, *inner, F.lit(f"</{name}>"))


def _money(value: Column) -> Column:
    return value.cast("string")


def entry_texts(spark: SparkSession, sf: str) -> DataFrame:
    """One XML entry per tender. Faults: blank title, unknown status, bad amount, no update time."""
    return _with_entry(views.notices_coded(spark, sf), "order_key", "expediente", "updated_at_source")


def _with_entry(coded: DataFrame, *kept: str) -> DataFrame:
    """The kept columns of coded notices and the entry of each; names of namespaces stand at the document's root."""
    key = F.col("order_key")
    title = F.when(key % 23 == 0, F.lit(" ")).otherwise(_escaped(F.col("title")))
    status = F.when(key % 29 == 0, F.lit("XXX")).otherwise(F.col("status_code"))
    amount = F.when(key % 31 == 0, F.lit("a lot")).otherwise(_money(F.col("budget_with_vat")))
    listed = F.array_join(
        F.transform(
            "cpv_codes",
            lambda c: F.concat(
                F.lit(
                    "<cac:RequiredCommodityClassification>"
                    '<cbc:ItemClassificationCode listURI="cpv">'
                ),
                c,
                F.lit("</cbc:ItemClassificationCode></cac:RequiredCommodityClassification>"),
            ),
        ),
        "",
    )
    empty_code = F.when(
        key % 37 == 0,
        F.lit(
            "<cac:RequiredCommodityClassification><cbc:ItemClassificationCode/>"
            "</cac:RequiredCommodityClassification>"
        ),
    )
    date = lambda c: F.date_format(c, "yyyy-MM-dd")
    end = F.col("submission_deadline")
    notice = lambda day: F.concat(
        F.lit("<cacx:AdditionalPublicationDocumentReference><cbc:IssueDate>"),
        day,
        F.lit("</cbc:IssueDate></cacx:AdditionalPublicationDocumentReference>"),
    )
    document = lambda name, url: _element(
        f"cac:{name}",
        _element("cac:Attachment", _element("cac:ExternalReference", _element("cbc:URI", url))),
    )
    updated = F.date_format(F.col("updated_at_source"), "yyyy-MM-dd'T'HH:mm:ss'.000+00:00'")
    folder = _element(
        "cacx:ContractFolderStatus",
        _element("cbc:ContractFolderID", F.col("expediente")),
        _element("cbcx:ContractFolderStatusCode", status, attributes='listURI="status"'),
        _element(
            "cacx:LocatedContractingParty",
            _element(
                "cac:Party",
                _element("cac:PartyName", _element("cbc:Name", _escaped(F.col("contracting_body")))),
            ),
        ),
        _element(
            "cac:ProcurementProject",
            _element("cbc:Name", title),
            _element("cbc:TypeCode", F.col("type_code")),
            _element(
                "cac:BudgetAmount",
                _element(
                    "cbc:EstimatedOverallContractAmount",
                    _money(F.col("estimated_value")),
                    attributes='currencyID="EUR"',
                ),
                _element("cbc:TotalAmount", amount, attributes='currencyID="EUR"'),
                _element("cbc:TaxExclusiveAmount", _money(F.col("budget_without_vat"))),
            ),
            listed,
            empty_code,
            _element(
                "cac:RealizedLocation", _element("cbc:CountrySubentity", F.col("location"))
            ),
        ),
        _element(
            "cac:TenderingProcess",
            _element("cbc:ProcedureCode", F.col("procedure_code")),
            _element(
                "cac:TenderSubmissionDeadlinePeriod",
                _element("cbc:EndDate", date(end)),
                _element("cbc:EndTime", F.when(end.isNotNull() & (key % 3 == 0), F.lit("14:30:00"))),
            ),
        ),
        document("LegalDocumentReference", F.col("pcap_url")),
        # Repeated elements: the first counts.
        F.when(
            (key % 3 == 0) & F.col("pcap_url").isNotNull(),
            document("LegalDocumentReference", F.lit("https://example.org/annex")),
        ),
        document("TechnicalDocumentReference", F.col("ppt_url")),
        F.when(
            key % 4 != 0,
            F.concat(
                F.lit("<cacx:ValidNoticeInfo><cacx:AdditionalPublicationStatus>"),
                notice(date(F.col("published_at") + F.expr("interval 3 days"))),
                notice(date(F.col("published_at"))),
                F.lit("</cacx:AdditionalPublicationStatus></cacx:ValidNoticeInfo>"),
            ),
        ),
    )
    entry = F.concat(
        F.lit("<entry><id>"),
        F.col("platform_url"),
        F.lit('</id><link href="'),
        F.col("platform_url"),
        F.lit('"/>'),
        F.coalesce(_element("updated", F.when(key % 41 != 0, updated)), F.lit("")),
        folder,
        F.lit("</entry>"),
    )
    return coded.select(*kept, entry.alias("entry"))


def _by_page(spark: SparkSession, sf: str) -> DataFrame:
    """Coded notices with the month and the page of each: narrow rows, to be moved before there are texts."""
    page = F.floor(F.col("order_key") / PAGE_WIDTH)
    return views.notices_coded(spark, sf).withColumns(
        {"month": F.date_format("updated_at_source", "yyyyMM"), "page": page}
    )


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Feed pages of a month: the entries whose keys fall into one range of fixed width."""
    body = F.array_join(F.sort_array(F.collect_list("entry")), "")
    opening = F.concat(F.lit(_OPENING), F.col("page").cast("string"), F.lit('"/>'))
    return (
        _with_entry(_by_page(spark, sf).repartition("month", "page"), "month", "page")
        .groupBy("month", "page")
        .agg(body.alias("body"))
        .select("month", "page", F.concat(opening, "body", F.lit("</feed>")).alias("text"))
    )


def _pack(rows: Iterator[tuple], system, inside: str) -> Iterator[pd.DataFrame]:
    """Writes an archive for each month of (month, page, entry) rows, which come in this order; at most one page is held.

    Every fifth page breaks off within one more entry; a member that is no page follows the pages.
    """
    for month, of_month in groupby(rows, key=lambda row: row[0]):
        name = f"notices_{month}.zip"
        with (
            system.open_output_stream(f"{inside}/{name}") as file,
            zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive,
        ):
            for page, of_page in groupby(of_month, key=lambda row: row[1]):
                end = "<entry><id>broken" if page % 5 == 2 else "</feed>"
                archive.writestr(f"page{page}.atom", "".join([f'{_OPENING}{page}"/>', *(row[2] for row in of_page), end]))
            archive.writestr("readme.txt", "<feed><entry/></feed>")
        yield pd.DataFrame({"path": [name]})


def archive_folder(spark: SparkSession, sf: str) -> str:
    """Folder with the archives of all months as files, written once by the tasks that pack them, page by page."""
    key = (spark.sparkContext.applicationId, sf, "archives")
    if key not in _WRITTEN:
        folder = shared_dir(spark, "archives")

        def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            system, inside = source.opened(folder)
            system.create_dir(inside)
            rows = (row for batch in batches for row in zip(batch["month"], batch["page"], batch["entry"]))
            yield from _pack(rows, system, inside)

        dealt = _by_page(spark, sf).repartition("month").sortWithinPartitions("month", "page", "order_key")
        _with_entry(dealt, "month", "page").mapInPandas(write, "path string").count()
        _WRITTEN[key] = folder
    return _WRITTEN[key]


def archive_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The pages in those archives, each under its archive's name."""
    pages = feed.read_archives(spark, [archive_folder(spark, sf)])
    return pages.withColumn("path", F.element_at(F.split("path", "/"), -1))


def _as_document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield pd.DataFrame({"value": [f"<feed {_NAMESPACES}>"]})
    for batch in batches:
        yield pd.DataFrame({"value": batch["entry"]})
    yield pd.DataFrame({"value": ["</feed>"]})


def feed_directory(spark: SparkSession, sf: str) -> str:
    """Folder with all entries as feed files, one document per partition, written once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _WRITTEN:
        path = shared_dir(spark, "feed")
        land(entry_texts(spark, sf), path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def land(entries: DataFrame, folder: str) -> None:
    """Lands entries in a folder as packed feed files, one document per partition: markup takes a tenth of its room."""
    documents = entries.select("entry").mapInPandas(_as_document, "value string")
    documents.write.mode("append").option("compression", "gzip").text(folder)


def republished_directory(spark: SparkSession, sf: str) -> str:
    """Folder with all entries as feed files, half of them a second time."""
    folder, entries = shared_dir(spark, "republished"), entry_texts(spark, sf)
    land(entries, folder)
    land(entries.where(F.col("order_key") % 2 == 0), folder)
    return folder


def corrected_entries(spark: SparkSession, sf: str) -> DataFrame:
    """A second version of every entry: newer for odd keys, older for even ones, with another body's name."""
    days = F.when(F.col("order_key") % 2 == 1, 1).otherwise(-1)
    moved = F.date_format(F.timestamp_add("DAY", days, F.col("updated_at_source")), "yyyy-MM-dd'T'HH:mm:ss'.000+00:00'")
    again = F.regexp_replace("entry", F.lit("<updated>[^<]*"), F.concat(F.lit("<updated>"), moved))
    named = F.replace(again, F.lit("<cac:PartyName><cbc:Name>"), F.lit("<cac:PartyName><cbc:Name>Nueva "))
    return entry_texts(spark, sf).withColumn("entry", named)


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Each order line as one publication of its notice."""
    return read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("expediente"),
        F.col("l_shipdate").cast("timestamp").alias("updated_at_source"),
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
    )


def stored_tenders(spark: SparkSession, sf: str) -> DataFrame:
    """Tenders published before 1999 as a stored snapshot with vectors."""
    vectors = views.tender_vectors(spark, sf)
    return (
        views.tenders(spark, sf)
        .filter(F.col("published_at") < F.lit("1999-01-01").cast("timestamp"))
        .select(*schemas.TENDER_COLUMNS)
        .withColumn("created_at", F.col("published_at"))
        .withColumn("updated_at", F.col("updated_at_source"))
        .join(vectors, "expediente", "left")
    )


def incoming_tenders(spark: SparkSession, sf: str) -> DataFrame:
    """Tenders published from 1997 on, some with a new title, some older than what is stored."""
    key = F.col("order_key")
    days = views.key_case(key, 6, {0: F.lit(-1), 1: F.lit(0)}, F.lit(2))
    return (
        views.tenders(spark, sf)
        .filter(F.col("published_at") >= F.lit("1997-01-01").cast("timestamp"))
        .withColumn(
            "title",
            F.when(key % 5 == 0, F.concat("title", F.lit(" (rectificado)"))).otherwise(F.col("title")),
        )
        .withColumn("status", F.when(key % 3 == 0, "cancelled").otherwise(F.col("status")))
        .withColumn("budget_with_vat", F.when(key % 4 != 0, F.col("budget_with_vat")))
        .withColumn("updated_at_source", F.col("updated_at_source") + F.make_dt_interval(days))
        .select(*schemas.TENDER_COLUMNS)
    )


def extraction_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Stored extractions as JSON; some cut off, some with an unknown, some with a missing key."""
    key = F.col("order_key")
    text = to_text(F.col("extraction"))
    cut = F.substring(text, 1, 120)
    unknown = F.concat(F.lit('{"extra":1,'), F.substr(text, F.lit(2)))
    missing = F.replace(text, F.lit('"can_bid_partial_lots":null,'), F.lit(""))
    return (
        views.analyses(spark, sf)
        .filter(F.col("extraction").isNotNull())
        .select(
            "order_key",
            "expediente",
            F.when(key % 17 == 0, cut)
            .when(key % 19 == 0, unknown)
            .when(key % 12 == 0, missing)
            .otherwise(text)
            .alias("extraction_json"),
        )
    )


def stored_extractions(spark: SparkSession, sf: str) -> DataFrame:
    """Stored extractions, the even keys in the older shape."""
    key = F.col("order_key")
    e = F.col("extraction")
    same = [
        e[n].alias(n)
        for n in schemas.EXTRACTION.fieldNames()
        if n not in ("certifications", "execution_deadline")
    ]
    certifications = F.col("extraction.certifications")
    old = F.struct(
        *same,
        F.transform(certifications, lambda c: c["name"]).alias("certifications"),
        F.get(F.transform(certifications, lambda c: c["citation"]), F.lit(0)).alias(
            "certifications_citation"
        ),
        F.struct(
            e["execution_deadline"]["description"].alias("description"),
            e["execution_deadline"]["citation"].alias("citation"),
        ).alias("execution_deadline"),
    )
    return (
        views.analyses(spark, sf)
        .filter(e.isNotNull())
        .select(
            "order_key",
            "expediente",
            F.when(key % 2 == 0, to_text(old)).otherwise(to_text(e)).alias("extraction_json"),
        )
    )
