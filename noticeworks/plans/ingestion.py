"""Registered queries over feed entries, archives, merges and stored JSON."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from noticeworks import schemas
from noticeworks.functions import codes, dates
from noticeworks.operators import merge, pages, reshape
from noticeworks.plans import feed_views, views
from noticeworks.plans.oracle_views import VIEWS, sql_case
from noticeworks.plans.registry import query, stamp
from noticeworks.session import shared_dir
from noticeworks.sources import feed
from noticeworks.sources.tables import read_table
from noticeworks.streaming import ingest

_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_UTC = "(({}) AT TIME ZONE 'Europe/Madrid') AT TIME ZONE 'UTC'"

VIEWS["entries_v"] = f"""
SELECT *, CASE WHEN order_key % 41 <> 0 THEN updated_at_source END AS updated,
  {_UTC.format("CAST(CAST(submission_deadline AS DATE) AS TIMESTAMP) + CASE WHEN order_key % 3 = 0 THEN INTERVAL 870 MINUTE ELSE INTERVAL 0 MINUTE END")} AS deadline_utc,
  CASE WHEN order_key % 4 <> 0 THEN {_UTC.format("CAST(CAST(published_at AS DATE) AS TIMESTAMP)")}
       ELSE updated_at_source END AS published_utc,
  list_filter([CASE WHEN order_key % 23 = 0 OR trim(title) = '' THEN 'title missing' END,
    CASE WHEN order_key % 29 = 0 THEN 'status unknown' END,
    CASE WHEN order_key % 31 = 0 THEN 'budget_with_vat malformed' END,
    CASE WHEN order_key % 41 = 0 THEN 'updated missing or malformed' END], lambda x: x IS NOT NULL) AS reasons
FROM tenders_v"""


@query(
    "recent_months",
    """
SELECT expediente, array_to_string(list_transform(range(2, -1, -1),
         lambda x: strftime(date_trunc('month', published_at) - to_months(CAST(x AS INT)), '%Y%m')), ',') AS months
FROM tenders_v""",
)
def recent_months(spark, sf):
    months = dates.recent_months(F.col("o_orderdate").cast("date"), 3)
    return read_table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("expediente"),
        F.array_join(F.transform(months, dates.month_label), ",").alias("months"),
    )


@query(
    "parse_deadline",
    f"""
SELECT expediente, {_STAMP.format('t')} AS deadline FROM (
  SELECT expediente, CASE WHEN order_key % 7 = 5 THEN NULL WHEN order_key % 7 = 6 THEN NULL ELSE
    {_UTC.format("CAST(CAST(submission_deadline AS DATE) AS TIMESTAMP) + CASE WHEN order_key % 7 IN (0, 1, 2) THEN INTERVAL 0 MINUTE ELSE INTERVAL 870 MINUTE END")} END AS t
  FROM tenders_v)""",
)
def parse_deadline(spark, sf):
    key = F.col("order_key")
    day = F.date_format("submission_deadline", "yyyy-MM-dd")
    end_date = F.when(key % 7 == 5, F.concat(F.lit("x"), day)).otherwise(day)
    end_time = views.key_case(
        key,
        7,
        {
            0: F.lit(None).cast("string"),
            1: F.lit(""),
            2: F.lit("00:00"),
            3: F.lit("14:30:00+02:00"),
            6: F.lit("25 h"),
        },
        F.lit("14:30:00"),
    )
    parsed = views.tenders(spark, sf).withColumn("deadline", dates.parse_deadline(end_date, end_time))
    return parsed.select("expediente", stamp("deadline"))


@query(
    "published_at",
    f"""
SELECT expediente, {_STAMP.format('t')} AS published FROM (
  SELECT expediente, CASE WHEN order_key % 4 = 0 THEN updated_at_source
         ELSE {_UTC.format("CAST(CAST(published_at AS DATE) AS TIMESTAMP)")} END AS t FROM tenders_v)""",
)
def published_at(spark, sf):
    key = F.col("order_key")
    day = F.date_format("published_at", "yyyy-MM-dd")
    later = F.date_format(F.col("published_at") + F.expr("interval 9 days"), "yyyy-MM-dd")
    issued = F.when(key % 4 != 0, F.array(later, day))
    published = dates.published_at(issued, F.col("updated_at_source"))
    return views.tenders(spark, sf).withColumn("published", published).select(
        "expediente", stamp("published")
    )


@query(
    "code_lookup",
    f"""
SELECT expediente, priority_code, {sql_case('priority_code', codes.CONTRACT_TYPES)} AS label,
       {sql_case('priority_code', codes.CONTRACT_TYPES)} IS NULL AS rejected FROM tenders_v""",
)
def code_lookup(spark, sf):
    rows = views.notices_coded(spark, sf).select("expediente", "priority_code")
    return merge.code_lookup(rows, merge.code_list_table(spark), "contract_type", "priority_code")


@query(
    "latest_version",
    f"""
SELECT CAST(l_orderkey AS VARCHAR) AS expediente, {_STAMP.format('l_shipdate')} AS updated_at_source,
       l_linenumber, l_partkey, l_extendedprice
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1""",
)
def latest_version(spark, sf):
    latest = merge.latest_version(
        feed_views.versions(spark, sf),
        "expediente",
        "updated_at_source",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
    )
    return latest.withColumn("updated_at_source", stamp("updated_at_source"))


@query(
    "newest_per_key",
    """
SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
)
def newest_per_key(spark, sf):
    events = read_table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return merge.newest_per_key(events, "user_id", "ts", "event_id").select(
        "user_id", "event_id", "event_type"
    )


@query(
    "republish_counts",
    "SELECT CAST(l_orderkey AS VARCHAR) AS expediente, count(*) AS versions FROM lineitem GROUP BY l_orderkey",
)
def republish_counts(spark, sf):
    return merge.republish_counts(feed_views.versions(spark, sf), "expediente")


# The two sides keep their own prefixes in one flat row.
_MERGE_SQL = f"""
SELECT coalesce(o_key, n_key) AS expediente, CASE WHEN wins THEN n_title ELSE o_title END AS title,
       CASE WHEN wins THEN n_status ELSE o_status END AS status,
       CAST(CASE WHEN wins THEN n_budget ELSE o_budget END AS DOUBLE) AS budget_with_vat,
       {_STAMP.format('CASE WHEN wins THEN n_updated ELSE o_updated END')} AS updated_at_source,
       {_STAMP.format("coalesce(created, TIMESTAMP '2002-01-01')")} AS created_at,
       {_STAMP.format("CASE WHEN wins THEN TIMESTAMP '2002-01-01' ELSE o_updated END")} AS updated_at,
       coalesce(CASE WHEN NOT wins OR o_title = n_title THEN has_vector END, false) AS has_vector
FROM (SELECT *, n_key IS NOT NULL AND (o_key IS NULL OR n_updated >= o_updated) AS wins
  FROM (SELECT t.expediente AS o_key, title AS o_title, status AS o_status, budget_with_vat AS o_budget,
               updated_at_source AS o_updated, published_at AS created, v.embedding IS NOT NULL AS has_vector
        FROM tenders_v t LEFT JOIN tender_vectors_v v ON t.expediente = v.expediente
        WHERE published_at < TIMESTAMP '1999-01-01')
  FULL JOIN (SELECT expediente AS n_key,
                    CASE WHEN order_key % 5 = 0 THEN title || ' (rectificado)' ELSE title END AS n_title,
                    CASE WHEN order_key % 3 = 0 THEN 'cancelled' ELSE status END AS n_status,
                    CASE WHEN order_key % 4 <> 0 THEN budget_with_vat END AS n_budget,
                    updated_at_source + to_days(CAST(CASE order_key % 6 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 2 END AS INT)) AS n_updated
             FROM tenders_v WHERE published_at >= TIMESTAMP '1997-01-01') ON o_key = n_key)"""


@query("upsert_tenders", _MERGE_SQL)
def upsert_tenders(spark, sf):
    merged = merge.upsert_tenders(
        feed_views.stored_tenders(spark, sf),
        feed_views.incoming_tenders(spark, sf),
        F.lit("2002-01-01").cast("timestamp"),
    )
    return merged.select(
        "expediente",
        "title",
        "status",
        F.col("budget_with_vat").cast("double").alias("budget_with_vat"),
        stamp("updated_at_source"),
        stamp("created_at"),
        stamp("updated_at"),
        F.col("embedding").isNotNull().alias("has_vector"),
    )


@query(
    "upsert_providers",
    """
SELECT p.provider_id, CASE WHEN s_nationkey < 15 THEN p.description || ' y nube' ELSE p.description END AS description,
       CAST(CASE WHEN s_nationkey >= 15 THEN p.annual_revenue END AS DOUBLE) AS annual_revenue,
       array_to_string(p.certifications, ',') AS certifications
FROM providers_v p JOIN supplier ON p.supplier_key = s_suppkey""",
)
def upsert_providers(spark, sf):
    """Profiles of some nations arrive again with a longer description and no revenue."""
    wanted = schemas.PROVIDER.fieldNames()
    everyone = views.providers(spark, sf)
    nations = read_table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("supplier_key"), "s_nationkey"
    )
    known = everyone.join(nations, "supplier_key")
    snapshot = known.filter(F.col("s_nationkey") >= 5).select(*wanted)
    batch = (
        known.filter(F.col("s_nationkey") < 15)
        .withColumn("description", F.concat("description", F.lit(" y nube")))
        .withColumn("annual_revenue", F.lit(None).cast(schemas.MONEY))
        .select(*wanted)
    )
    return merge.upsert_providers(snapshot, batch).select(
        "provider_id",
        "description",
        F.col("annual_revenue").cast("double").alias("annual_revenue"),
        F.array_join("certifications", ",").alias("certifications"),
    )


_TENDER_SQL = f"""expediente, contracting_body, title, array_to_string(cpv_codes, ',') AS cpv_codes,
       CAST(budget_with_vat AS DOUBLE) AS budget_with_vat, CAST(budget_without_vat AS DOUBLE) AS budget_without_vat,
       CAST(estimated_value AS DOUBLE) AS estimated_value, contract_type, procedure_type, status, location,
       pcap_url, ppt_url, platform_url, {_STAMP.format('deadline_utc')} AS submission_deadline,
       {_STAMP.format('published_utc')} AS published_at, {_STAMP.format('updated')} AS updated_at_source"""


def _tender_columns():
    money = ("budget_with_vat", "budget_without_vat", "estimated_value")
    times = ("submission_deadline", "published_at", "updated_at_source")
    plain = [c for c in schemas.TENDER_COLUMNS if c not in (*money, *times, "cpv_codes")]
    return (
        *plain,
        F.array_join("cpv_codes", ",").alias("cpv_codes"),
        *[F.col(c).cast("double").alias(c) for c in money],
        *[stamp(c) for c in times],
    )


@query(
    "scan_entries",
    f"""
SELECT platform_url AS id, expediente, CASE WHEN order_key % 23 = 0 THEN '' ELSE trim(title) END AS title,
       strftime(updated, '%Y-%m-%dT%H:%M:%S.000+00:00') AS updated, len(cpv_codes) + CASE WHEN order_key % 37 = 0 THEN 1 ELSE 0 END AS n_codes
FROM entries_v""",
)
def scan_entries(spark, sf):
    entries = feed.scan_entries(spark, feed_views.feed_directory(spark, sf))
    project = "ContractFolderStatus.ProcurementProject"
    classified = F.size(feed.elements(f"{project}.RequiredCommodityClassification"))
    return entries.select(
        "id",
        feed.first("ContractFolderStatus.ContractFolderID").alias("expediente"),
        F.trim(F.coalesce(feed.first(f"{project}.Name"), F.lit(""))).alias("title"),
        feed.first("updated").alias("updated"),
        classified.cast("bigint").alias("n_codes"),
    )


@query(
    "scan_pages",
    """
SELECT strftime(updated_at_source, '%Y%m') AS month, order_key // 4000 AS page, count(*) AS entries,
       'p' || (order_key // 4000) AS next_page
FROM entries_v GROUP BY 1, 2""",
)
def scan_pages(spark, sf):
    parsed = feed_views.page_texts(spark, sf).select(
        "month", "page", feed.parse_page(F.col("text")).alias("feed")
    )
    return parsed.select(
        "month",
        "page",
        F.size("feed.entry").cast("bigint").alias("entries"),
        feed.next_link(F.col("feed.link")).alias("next_page"),
    )


@query(
    "page_order",
    """
SELECT 'p' || number AS page, 'p' || first_value(number) OVER (PARTITION BY chain ORDER BY number) AS first,
       row_number() OVER (PARTITION BY chain ORDER BY number) - 1 AS position,
       CASE WHEN found THEN NULL ELSE 'p' || (number + 1) END AS missing
FROM (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (ORDER BY number) AS chain
  FROM (SELECT number, lag(number) OVER (ORDER BY number) = number - 1 AS goes_on,
               lead(number) OVER (ORDER BY number) = number + 1 AS found
        FROM (SELECT DISTINCT order_key // 4 AS number FROM entries_v WHERE order_key // 4 % 11 <> 5)))""",
)
def page_order(spark, sf):
    """Pages by their links, where every eleventh page has not landed."""
    number = F.floor(F.col("order_key") / 4)
    landed = feed_views.entry_texts(spark, sf).select(number.alias("number")).distinct().where("number % 11 <> 5")
    named = lambda n: F.concat(F.lit("p"), n.cast("string"))
    links = landed.select(named(F.col("number")).alias("page"), named(F.col("number") + 1).alias("next_page"))
    return pages.page_order(links)


_ARCHIVED = """(SELECT *, order_key // 4000 AS page, 'page' || (order_key // 4000) || '.atom' AS member,
       'notices_' || strftime(updated_at_source, '%Y%m') || '.zip' AS path FROM entries_v)"""


@query(
    "scan_archives",
    f"""
SELECT path, member, expediente, false AS corrupt FROM {_ARCHIVED}
UNION ALL SELECT DISTINCT path, member, NULL, true FROM {_ARCHIVED} WHERE page % 5 = 2""",
)
def scan_archives(spark, sf):
    pages = feed_views.archive_texts(spark, sf)
    return feed.page_entries(pages).select(
        "path",
        "member",
        feed.first("ContractFolderStatus.ContractFolderID").alias("expediente"),
        F.col("_corrupt_record").isNotNull().alias("corrupt"),
    )


@query(
    "archive_rejects",
    f"""
SELECT path, member, expediente, array_to_string(reasons, '; ') AS reasons FROM {_ARCHIVED} WHERE len(reasons) > 0
UNION ALL SELECT DISTINCT path, member, NULL, 'entry malformed' FROM {_ARCHIVED} WHERE page % 5 = 2""",
)
def archive_rejects(spark, sf):
    """What is refused from the archives, and where it lies; of a broken page's rest only that it is malformed."""
    pages = feed_views.archive_texts(spark, sf)
    parsed = feed.parse_entries(feed.page_entries(pages), "path", "member")
    malformed = F.array_contains("reasons", "entry malformed")
    reasons = F.when(malformed, F.lit("entry malformed")).otherwise(F.array_join("reasons", "; "))
    return feed.rejects(parsed).select("path", "member", "expediente", reasons.alias("reasons"))


def _parsed(spark, sf):
    entries = feed.scan_entries(spark, feed_views.feed_directory(spark, sf))
    return feed.parse_entries(entries)


@query("parse_entries", f"SELECT {_TENDER_SQL} FROM entries_v WHERE len(reasons) = 0")
def parse_entries(spark, sf):
    return feed.accepted(_parsed(spark, sf)).select(*_tender_columns())


@query(
    "parse_rejects",
    """
SELECT expediente, array_to_string(reasons, '; ') AS reasons, strftime(updated, '%Y-%m-%dT%H:%M:%S.000+00:00') AS updated
FROM entries_v WHERE len(reasons) > 0""",
)
def parse_rejects(spark, sf):
    return feed.rejects(_parsed(spark, sf)).withColumn("reasons", F.array_join("reasons", "; "))


_IN_SCOPE = "len(reasons) = 0 AND len(list_filter(norm_codes, lambda x: starts_with(x, '72'))) > 0"


@query(
    "backfill",
    f"SELECT strftime(updated_at_source, '%Y%m') AS month, {_TENDER_SQL} FROM entries_v WHERE {_IN_SCOPE}",
)
def backfill(spark, sf):
    """All monthly archives: unpack, parse, refuse, keep the division, newest version per key."""
    entries = feed.page_entries(feed_views.archive_texts(spark, sf))
    loaded = feed.ingest(feed.parse_entries(entries))
    return loaded.select(
        F.date_format("updated_at_source", "yyyyMM").alias("month"), *_tender_columns()
    )


_SINCE = f"SELECT {_TENDER_SQL} FROM entries_v WHERE {_IN_SCOPE} AND updated >= TIMESTAMP '1998-01-01'"


@query("ingest_batch", _SINCE)
def ingest_batch(spark, sf):
    """The incremental rule as one batch job."""
    mark = F.lit("1998-01-01").cast("timestamp")
    return feed.ingest(_parsed(spark, sf), mark).select(*_tender_columns())


@query("ingest_incremental", _SINCE)
def ingest_incremental(spark, sf):
    """The stream from a mark left by an earlier run, read back from the table that it merged into."""
    paths = ingest.IngestPaths.below(feed_views.feed_directory(spark, sf), shared_dir(spark, "ingest"))
    ingest.set_mark(spark, paths, datetime(1998, 1, 1, tzinfo=timezone.utc))
    ingest.run_ingest(spark, paths, buckets=8)
    return ingest.read_tenders(spark, paths).select(*_tender_columns())


@query(
    "ingest_counts",
    """
SELECT count(*) AS entries, count_if(len(reasons) > 0) AS refused,
       strftime(max(updated) FILTER (len(reasons) = 0), '%Y-%m-%d %H:%M:%S') AS mark FROM entries_v""",
)
def ingest_counts(spark, sf):
    """What a first run of the stream reports, and the mark that it leaves."""
    paths = ingest.IngestPaths.below(feed_views.feed_directory(spark, sf), shared_dir(spark, "ingest"))
    counts = ingest.run_ingest(spark, paths, buckets=8)
    told = [F.lit(counts[name]).cast("bigint").alias(name) for name in ("entries", "refused")]
    return ingest.marks(spark, paths).select(*told, stamp("high_water_mark", "mark"))


_COUNTED_SQL = "SELECT count(*) AS entries, count_if(len(reasons) > 0) AS refused FROM entries_v"


def _numbers(spark, counts, *names):
    """A row of numbers that a run reports."""
    return spark.range(1).select(*[F.lit(counts[name]).cast("bigint").alias(name) for name in names])


@query("ingest_republished", _COUNTED_SQL)
def ingest_republished(spark, sf):
    """Half of the entries come twice: what a run with bounded duplicate state writes."""
    source = feed_views.republished_directory(spark, sf)
    paths = ingest.IngestPaths.below(source, shared_dir(spark, "ingest"))
    counts = ingest.run_ingest(spark, paths, buckets=8, repeated_within="1 hour")
    return _numbers(spark, counts, "entries", "refused")


@query("ingest_progress", _COUNTED_SQL)
def ingest_progress(spark, sf):
    """The numbers that a running stream tells batch by batch, summed."""
    paths = ingest.IngestPaths.below(feed_views.feed_directory(spark, sf), shared_dir(spark, "ingest"))
    told = []
    ingest.run_ingest(spark, paths, buckets=8, max_files=1, tell=told.append)
    counts = {name: sum(batch[name] for batch in told) for name in ("entries", "refused")}
    return _numbers(spark, counts, "entries", "refused")


@query(
    "ingest_restart",
    f"""
SELECT expediente, CASE WHEN order_key % 2 = 1 THEN 'Nueva ' ELSE '' END || contracting_body AS contracting_body,
       {_STAMP.format("updated + to_days(CAST(CASE WHEN order_key % 2 = 1 THEN 1 ELSE 0 END AS INT))")} AS updated_at_source
FROM entries_v WHERE {_IN_SCOPE}""",
)
def ingest_restart(spark, sf):
    """A stream that is started twice: late older versions change nothing, newer ones replace."""
    source = shared_dir(spark, "landing")
    paths = ingest.IngestPaths.below(source, shared_dir(spark, "ingest"))
    # No mark holds the second run back: its late rows have to reach the merge.
    for entries in (feed_views.entry_texts(spark, sf), feed_views.corrected_entries(spark, sf)):
        feed_views.land(entries, source)
        ingest.start_ingest(spark, paths, buckets=8).awaitTermination()
    return ingest.read_tenders(spark, paths).select("expediente", "contracting_body", stamp("updated_at_source"))


@query(
    "parse_extraction",
    """
SELECT expediente, refusal, CASE WHEN refusal IS NULL THEN turnover END AS turnover,
       CASE WHEN refusal IS NULL THEN total_points END AS total_points,
       CASE WHEN refusal IS NULL THEN array_to_string(CASE order_key % 6 WHEN 0 THEN ['ISO 27001'] WHEN 1 THEN ['Responsable técnico']
         WHEN 2 THEN ['ISO 9001'] WHEN 3 THEN ['ENS categoría media', 'DEUC'] ELSE CAST([] AS VARCHAR[]) END, ',') END AS names,
       CASE WHEN refusal IS NULL THEN extensions_allowed END AS extensions_allowed, refusal IS NULL AS same_text
FROM (SELECT *, CASE WHEN order_key % 17 = 0 THEN 'malformed' WHEN order_key % 19 = 0 THEN 'keys'
                     WHEN order_key % 12 = 0 THEN 'keys' END AS refusal FROM analyses_v WHERE has_extraction)""",
)
def parse_extraction(spark, sf):
    parsed = reshape.parse_extraction(feed_views.extraction_texts(spark, sf))
    again = reshape.to_text(F.col("extraction")) == F.col("extraction_json")
    return parsed.select(
        "expediente",
        "refusal",
        F.col("extraction.economic_solvency.minimum_annual_turnover_eur").alias("turnover"),
        F.col("extraction.award_criteria.total_points").alias("total_points"),
        F.array_join(F.transform("extraction.certifications", lambda c: c["name"]), ",").alias("names"),
        F.col("extraction.execution_deadline.extensions_allowed").alias("extensions_allowed"),
        F.coalesce(again, F.lit(False)).alias("same_text"),
    )


_OLD = "order_key % 2 = 0"
_NAMES = """CASE order_key % 6 WHEN 0 THEN ['ISO 27001'] WHEN 1 THEN ['Responsable técnico']
  WHEN 2 THEN ['ISO 9001'] WHEN 3 THEN ['ENS categoría media', 'DEUC'] ELSE CAST([] AS VARCHAR[]) END"""


@query(
    "reshape_json",
    f"""
SELECT expediente, array_to_string({_NAMES}, ',') AS names,
       array_to_string(CASE WHEN len({_NAMES}) = 0 THEN CAST([] AS VARCHAR[])
         WHEN {_OLD} OR order_key % 6 = 1 THEN ['required_to_bid']
         ELSE ['required_to_bid', 'administrative_paperwork'] END, ',') AS roles,
       CASE WHEN len({_NAMES}) > 0 AND (order_key + 8) % 5 <> 1 THEN cite_page END AS first_page,
       CASE WHEN order_key % 6 = 3 AND (order_key + 9) % 5 <> 1 THEN cite_page END AS second_page,
       CASE WHEN NOT ({_OLD}) THEN extensions_allowed END AS extensions_allowed,
       true AS has_extension_key, false AS has_shared_citation
FROM analyses_v WHERE has_extraction""",
)
def reshape_json(spark, sf):
    stored = feed_views.stored_extractions(spark, sf)
    return _reshaped(reshape.reshape_up(reshape.reshape_up(stored)))


def _reshaped(rows):
    text = F.col("extraction_json")
    e = F.from_json(text, schemas.EXTRACTION)
    keys = F.json_object_keys(text)
    deadline_keys = F.json_object_keys(F.get_json_object(text, "$.execution_deadline"))
    page = lambda n: F.get(F.col("e.certifications"), F.lit(n))["citation"]["page"]
    return (
        rows.withColumn("e", e)
        .select(
            "expediente",
            F.array_join(F.transform("e.certifications", lambda c: c["name"]), ",").alias("names"),
            F.array_join(F.transform("e.certifications", lambda c: c["role"]), ",").alias("roles"),
            page(0).alias("first_page"),
            page(1).alias("second_page"),
            F.col("e.execution_deadline.extensions_allowed").alias("extensions_allowed"),
            F.array_contains(deadline_keys, "extensions_allowed").alias("has_extension_key"),
            F.array_contains(keys, "certifications_citation").alias("has_shared_citation"),
        )
    )


@query(
    "reshape_json_down",
    f"""
SELECT expediente, array_to_string({_NAMES}, ',') AS names,
       CASE WHEN len({_NAMES}) > 0 AND (order_key + 8) % 5 <> 1 THEN cite_page END AS shared_page,
       false AS has_extension_key, true AS has_shared_citation
FROM analyses_v WHERE has_extraction""",
)
def reshape_json_down(spark, sf):
    down = reshape.reshape_down(reshape.reshape_up(feed_views.stored_extractions(spark, sf)))
    text = F.col("extraction_json")
    old = F.from_json(text, schemas.EXTRACTION_OLD)
    deadline_keys = F.json_object_keys(F.get_json_object(text, "$.execution_deadline"))
    return down.withColumn("e", old).select(
        "expediente",
        F.array_join("e.certifications", ",").alias("names"),
        F.col("e.certifications_citation.page").alias("shared_page"),
        F.array_contains(deadline_keys, "extensions_allowed").alias("has_extension_key"),
        F.array_contains(F.json_object_keys(text), "certifications_citation").alias(
            "has_shared_citation"
        ),
    )
