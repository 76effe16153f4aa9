"""Feed parsing, archives and the two streams."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeworks.operators import merge
from noticeworks.plans import catalog, feed_views
from noticeworks.sources import archives, feed
from noticeworks.streaming import ingest, snapshot, stale
from noticeworks.streaming.snapshot import Snapshot

NAMESPACES = (
    'xmlns="http://www.w3.org/2005/Atom" xmlns:cbc="urn:b" xmlns:cac="urn:a" '
    'xmlns:cbcx="urn:bx" xmlns:cacx="urn:ax"'
)


def entry(key="X-1", updated="2026-08-19T10:00:00.000+02:00", title="Portal web", status="PUB",
          amount="121.005", codes=("72000000", ""), notices=("2026-08-10", "2026-08-01"), end_time="14:00:00"):
    listed = "".join(
        f"<cac:RequiredCommodityClassification><cbc:ItemClassificationCode listURI='x'>{c}"
        "</cbc:ItemClassificationCode></cac:RequiredCommodityClassification>"
        for c in codes
    )
    issued = "".join(
        "<cacx:ValidNoticeInfo><cacx:AdditionalPublicationStatus><cacx:AdditionalPublicationDocumentReference>"
        f"<cbc:IssueDate>{d}</cbc:IssueDate></cacx:AdditionalPublicationDocumentReference>"
        "</cacx:AdditionalPublicationStatus></cacx:ValidNoticeInfo>"
        for d in notices
    )
    updated_tag = f"<updated>{updated}</updated>" if updated else ""
    return (
        f"<entry><id>{key}</id><link href='https://example.org/{key}'/>{updated_tag}<cacx:ContractFolderStatus>"
        f"<cbc:ContractFolderID>{key}</cbc:ContractFolderID>"
        f"<cbcx:ContractFolderStatusCode languageID='es'>{status}</cbcx:ContractFolderStatusCode>"
        "<cacx:LocatedContractingParty><cac:Party><cac:PartyName><cbc:Name>Ayuntamiento</cbc:Name>"
        "</cac:PartyName></cac:Party></cacx:LocatedContractingParty>"
        f"<cac:ProcurementProject><cbc:Name>{title}</cbc:Name><cbc:TypeCode>2</cbc:TypeCode><cac:BudgetAmount>"
        f"<cbc:TotalAmount currencyID='EUR'>{amount}</cbc:TotalAmount></cac:BudgetAmount>{listed}"
        "<cac:RealizedLocation><cbc:CountrySubentity>Asturias</cbc:CountrySubentity></cac:RealizedLocation>"
        "</cac:ProcurementProject><cac:TenderingProcess><cbc:ProcedureCode>9</cbc:ProcedureCode>"
        "<cac:TenderSubmissionDeadlinePeriod><cbc:EndDate>2026-09-01</cbc:EndDate>"
        f"<cbc:EndTime>{end_time}</cbc:EndTime></cac:TenderSubmissionDeadlinePeriod></cac:TenderingProcess>"
        "<cac:LegalDocumentReference><cac:Attachment><cac:ExternalReference><cbc:URI>https://example.org/pcap"
        "</cbc:URI></cac:ExternalReference></cac:Attachment></cac:LegalDocumentReference>"
        f"{issued}</cacx:ContractFolderStatus></entry>"
    )


def page(*entries, following=None):
    link = f"<link rel='next' href='{following}'/>" if following else ""
    return f"<feed {NAMESPACES}><link rel='self' href='me'/>{link}{''.join(entries)}</feed>"


def parsed(spark, *entries):
    frame = spark.createDataFrame([(page(*entries),)], "text string")
    return feed.parse_entries(feed.page_entries(frame))


def test_all_fields_of_one_entry(spark):
    row = feed.accepted(parsed(spark, entry())).first()
    assert row["expediente"] == "X-1" and row["contracting_body"] == "Ayuntamiento"
    assert row["cpv_codes"] == ["72000000"]
    assert str(row["budget_with_vat"]) == "121.01" and row["budget_without_vat"] is None
    assert (row["contract_type"], row["procedure_type"], row["status"]) == (
        "services", "Abierto simplificado", "open_for_submission")
    assert row["pcap_url"] == "https://example.org/pcap" and row["ppt_url"] is None
    assert row["platform_url"] == "https://example.org/X-1" and row["location"] == "Asturias"
    times = parsed(spark, entry()).select(
        *[F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in ("submission_deadline", "published_at", "updated_at_source")]
    ).first()
    assert tuple(times) == ("2026-09-01 12:00", "2026-07-31 22:00", "2026-08-19 08:00")


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"title": " "}, "title missing"),
        ({"status": "???"}, "status unknown"),
        ({"amount": "much"}, "budget_with_vat malformed"),
        ({"amount": ""}, "budget_with_vat malformed"),
        ({"end_time": "noon"}, "submission_deadline malformed"),
        ({"notices": ("soon",)}, "published_at malformed"),
        ({"updated": None}, "updated missing or malformed"),
        ({"key": ""}, "expediente missing"),
    ],
)
def test_bad_entries_are_refused_with_a_reason(spark, change, reason):
    rows = parsed(spark, entry(**change), entry(key="good"))
    assert feed.rejects(rows).first()["reasons"] == [reason]
    assert [r["expediente"] for r in feed.accepted(rows).collect()] == ["good"]


def test_publication_falls_back_to_update(spark):
    row = parsed(spark, entry(notices=())).first()
    assert row["published_at"] == row["updated_at_source"]


def test_next_link(spark):
    frame = spark.createDataFrame([(page(following="p2"),), (page(),)], "text string")
    links = frame.select(feed.next_link(feed.parse_page(F.col("text")).getField("link")).alias("n"))
    assert [r["n"] for r in links.collect()] == ["p2", None]


def test_archives_skip_other_members(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("a.atom", page(entry("A"), entry("B", codes=("48000000",))))
        archive.writestr("b.atom", page(entry("C", status="bad"), entry("A", updated="2026-08-20T00:00:00+00:00", title="Nuevo")))
        archive.writestr("notes.txt", page(entry("D")))
    path = tmp_path / "notices_202608.zip"
    path.write_bytes(buffer.getvalue())
    pages = feed.archive_pages(feed.scan_archive_files(spark, [str(path)]))
    rows = feed.ingest(feed.parse_entries(feed.page_entries(pages))).collect()
    assert [(r["expediente"], r["title"]) for r in rows] == [("A", "Nuevo")]


def test_archive_paths(spark):
    assert feed.archive_paths("/in", "2026-01-15", 2, spark) == [
        "/in/notices_202512.zip", "/in/notices_202601.zip"]


def test_mark_reads_ties_again(spark):
    rows = parsed(spark, *[entry(f"K{h}", updated=f"2026-08-19T{h}:00:00+00:00") for h in (12, 11, 10)])
    mark = F.lit("2026-08-19 11:00:00").cast("timestamp")
    assert sorted(r["expediente"] for r in feed.ingest(rows, mark).collect()) == ["K11", "K12"]


def land(folder, name, *entries):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.atom").write_text(page(*entries), encoding="utf-8")


def test_stream_merges_restarts_and_matches_the_batch_job(spark, tmp_path):
    source = tmp_path / "feed"
    paths = ingest.IngestPaths.below(str(source), str(tmp_path / "store"))
    at = lambda day: f"2026-08-{day:02d}T00:00:00+00:00"
    land(source, "p1", entry("A", at(3)), entry("B", at(2)), entry("bad", at(2), status="?"))
    land(source, "p2", entry("A", at(1), title="Viejo"), entry("C", at(1), codes=("48000000",)))
    counts = ingest.run_ingest(spark, paths, max_files=1, buckets=4)
    assert counts == {"entries": 5, "refused": 1}
    first = {r["expediente"]: r for r in ingest.read_tenders(spark, paths).collect()}
    assert {k: r["title"] for k, r in first.items()} == {"A": "Portal web", "B": "Portal web"}
    assert ingest.marks(spark, paths).first()["high_water_mark"] == dt.datetime(2026, 8, 3)

    land(source, "p3", entry("A", at(5), title="Corregido", status="ANUL"), entry("D", at(5)), entry("late", at(2)))
    assert ingest.run_ingest(spark, paths, buckets=4)["entries"] == 3
    second = {r["expediente"]: r for r in ingest.read_tenders(spark, paths).collect()}
    assert {k: r["title"] for k, r in second.items()} == {"A": "Corregido", "B": "Portal web", "D": "Portal web"}
    assert second["A"]["status"] == "cancelled"
    assert second["A"]["created_at"] == first["A"]["created_at"]
    assert second["B"]["updated_at"] == first["B"]["updated_at"]
    assert [r["expediente"] for r in ingest.read_rejects(spark, paths).collect()] == ["bad"]

    assert ingest.run_ingest(spark, paths, buckets=4)["entries"] == 0
    batch = feed.ingest(feed.parse_entries(feed.scan_entries(spark, str(source)))).collect()
    assert {r["expediente"]: r["title"] for r in batch if r["expediente"] != "late"} == {
        k: r["title"] for k, r in second.items()}


def stored(spark, paths):
    keep = [c for c in ingest.STORED.fieldNames() if c != "updated_at"]
    return sorted(map(str, ingest.read_tenders(spark, paths).select(*keep).collect()))


def test_repeated_batch_changes_nothing(spark, tmp_path):
    source = tmp_path / "feed"
    paths = ingest.IngestPaths.below(str(source), str(tmp_path / "store"))
    batch = parsed(spark, entry("A"), entry("bad", title=" "))
    ingest.write_batch(batch, "b0", paths, None, 4)
    once = stored(spark, paths)
    ingest.write_batch(batch, "b0", paths, None, 4)
    assert stored(spark, paths) == once and len(once) == 1
    assert ingest.read_rejects(spark, paths).count() == 1


@pytest.mark.parametrize("dies_in", ["parquet of delta", "commit", "counts"])
def test_a_batch_that_died_leaves_a_whole_table_and_can_be_repeated(spark, tmp_path, monkeypatch, dies_in):
    paths = ingest.IngestPaths.below(str(tmp_path / "feed"), str(tmp_path / "store"))
    ingest.write_batch(parsed(spark, entry("A"), entry("B")), "b0", paths, None, 2)
    before = stored(spark, paths)
    batch = parsed(spark, entry("C"), entry("A", updated="2026-08-30T00:00:00+00:00", title="Nuevo"))

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        if dies_in == "commit":
            patched.setattr(Snapshot, "_commit", die)
        elif dies_in == "counts":
            patched.setattr(ingest, "COUNTED", "no schema")
        else:
            patched.setattr(feed, "ingest", die)
        with pytest.raises(Exception):
            ingest.write_batch(batch, "b1", paths, None, 2)
    if dies_in != "counts":
        assert stored(spark, paths) == before
    ingest.write_batch(batch, "b1", paths, None, 2)
    found = {r["expediente"]: r["title"] for r in ingest.read_tenders(spark, paths).collect()}
    assert found == {"A": "Nuevo", "B": "Portal web", "C": "Portal web"}
    assert ingest.read_or_empty(spark, paths.counts, ingest.COUNTS).agg(F.sum("entries")).first()[0] == 4


def test_readers_see_one_whole_version_whatever_a_compaction_does(spark, tmp_path, monkeypatch):
    paths = ingest.IngestPaths.below(str(tmp_path / "feed"), str(tmp_path / "store"))
    table = ingest.tender_table(spark, paths, 4)
    for number in range(3):
        rows = [entry(f"K{i}", updated=f"2026-08-{10 + number}T00:00:00+00:00", title=f"T{number}") for i in range(number, 6)]
        ingest.write_batch(parsed(spark, *rows), f"b{number}", paths, None, 4)
    old, whole = table.read(), stored(spark, paths)
    version = table.current()
    assert (version.version, len(version.deltas), version.base) == (3, 3, {})

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(Snapshot, "_commit", die)
        with pytest.raises(RuntimeError):
            table.compact()
    assert stored(spark, paths) == whole and table.current() == version
    table.compact()
    assert stored(spark, paths) == whole
    after = table.current()
    assert (after.version, after.deltas) == (4, []) and set(after.base) <= set(range(4))
    # A reader that began before goes on, until old folders are given back.
    assert old.count() == 6 and sorted(r["title"] for r in old.collect()) == ["T0", "T1", "T2", "T2", "T2", "T2"]
    ingest.write_batch(parsed(spark, entry("Z")), "b9", paths, None, 4)
    table.compact()
    again = table.current()
    changed = [bucket for bucket in again.base if again.base[bucket] != after.base.get(bucket)]
    assert len(changed) == 1 and stored(spark, paths) != whole
    assert table.expire() > 0 and table.read().count() == 7


def test_deltas_merge_like_one_upsert_after_another(spark, tmp_path, monkeypatch):
    """Titles, creation times and vectors come out as if every batch had been merged at once."""
    monkeypatch.setattr(snapshot, "DELTAS", 3)
    paths = ingest.IngestPaths.below(str(tmp_path / "feed"), str(tmp_path / "store"))
    table = ingest.tender_table(spark, paths, 2)
    plain = spark.createDataFrame([], T.StructType(ingest.STORED.fields[:-1]))
    for number in range(5):
        rows = [
            entry(f"K{i}", updated=f"2026-08-{10 + (7 * number + i) % 9}T00:00:00+00:00", title=f"T{(number + i) % 3 // 2}")
            for i in range(number % 2, 6 + number)
        ]
        fresh = feed.ingest(parsed(spark, *rows))
        now = F.lit(f"2026-09-0{number + 1}").cast("timestamp")
        table.add(fresh, f"b{number}", now)
        # The rows are taken out and put in again, so that the plan stays short.
        merged = merge.upsert_tenders(plain, fresh, now).collect()
        plain = spark.createDataFrame(merged, plain.schema)
        columns = plain.columns
        assert sorted(map(str, table.read().select(*columns).collect())) == sorted(map(str, merged))
    assert table.current().version == 6 and table.current().buckets == 2


def test_two_writers_of_one_version_are_told(spark, tmp_path):
    paths = ingest.IngestPaths.below(str(tmp_path / "feed"), str(tmp_path / "store"))
    table = ingest.tender_table(spark, paths, 2)
    fresh = feed.ingest(parsed(spark, entry("A")))
    table.add(fresh, "b0", F.current_timestamp())
    with pytest.raises(RuntimeError, match="two writers"):
        table._commit(table.current())


def test_progress_is_told_while_the_stream_runs(spark, tmp_path):
    paths = ingest.IngestPaths.below(str(tmp_path / "feed"), str(tmp_path / "store"))
    for number in range(3):
        land(tmp_path / "feed", f"p{number}", entry(f"K{number}"), entry(f"L{number}"), entry(f"bad{number}", status="?"))
    told = []
    counts = ingest.run_ingest(spark, paths, max_files=1, buckets=2, tell=told.append)
    assert counts == {"entries": 9, "refused": 3}
    assert [(t["batch"], t["entries"], t["refused"]) for t in sorted(told, key=lambda t: t["batch"])] == [(i, 3, 1) for i in range(3)]


def test_repeated_entries_are_dropped_within_a_time_and_late_versions_are_not(spark, tmp_path):
    paths = ingest.IngestPaths.below(str(tmp_path / "feed"), str(tmp_path / "store"))
    at = lambda day: f"2026-08-{day:02d}T00:00:00+00:00"
    land(tmp_path / "feed", "p1", entry("A", at(9)), entry("B", at(9)), entry("bad", at(9), status="?"))
    run = lambda: ingest.run_ingest(spark, paths, buckets=2, repeated_within="1 hour", max_files=1)
    assert run() == {"entries": 3, "refused": 1}
    land(tmp_path / "feed", "p2", entry("A", at(9)), entry("B", at(9)), entry("B", at(9), title="Otro"), entry("bad", at(9), status="?"))
    land(tmp_path / "feed", "p3", entry("A", at(10), title="Nuevo"), entry("A", at(1), title="Viejo"), entry("C", at(9)))
    assert run() == {"entries": 4, "refused": 0}
    found = {r["expediente"]: r["title"] for r in ingest.read_tenders(spark, paths).collect()}
    assert found["A"] == "Nuevo" and set(found) == {"A", "B", "C"}


def test_archives_merge_into_the_same_table(spark, tmp_path):
    paths = ingest.IngestPaths.below(str(tmp_path / "feed"), str(tmp_path / "store"))
    ingest.write_batch(parsed(spark, entry("A"), entry("B")), "b0", paths, None, 4)
    archive = tmp_path / "notices_202608.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        packed.writestr("x.atom", page(entry("A", updated="2026-08-30T00:00:00+00:00", title="Nuevo"), entry("C")))
    for _ in range(2):
        ingest.load_archives(spark, [str(archive)], paths, label="2026-08", buckets=4)
    found = {r["expediente"]: r["title"] for r in ingest.read_tenders(spark, paths).collect()}
    assert found == {"A": "Nuevo", "B": "Portal web", "C": "Portal web"}


def test_archive_loads_leave_no_mark(spark, tmp_path):
    """A refused notice of the far future in an archive, then a feed page: nothing is lost."""
    paths = ingest.IngestPaths.below(str(tmp_path / "feed"), str(tmp_path / "store"))
    archive = tmp_path / "notices_202608.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        packed.writestr("x.atom", page(entry("far", updated="2099-01-01T00:00:00+00:00", status="?"), entry("A")))
    ingest.load_archives(spark, [str(archive)], paths, label="x", buckets=2)
    land(tmp_path / "feed", "p1", entry("B", updated="2026-09-05T00:00:00+00:00"),
         entry("C", updated="2098-01-01T00:00:00+00:00", title=" "))
    ingest.run_ingest(spark, paths, buckets=2)
    assert ingest.marks(spark, paths).first()["high_water_mark"] == dt.datetime(2026, 9, 5)
    land(tmp_path / "feed", "p2", entry("D", updated="2026-09-06T00:00:00+00:00"))
    ingest.run_ingest(spark, paths, buckets=2)
    assert sorted(r["expediente"] for r in ingest.read_tenders(spark, paths).collect()) == ["A", "B", "D"]
    assert sorted(r["expediente"] for r in ingest.read_rejects(spark, paths).collect()) == ["C", "far"]


def test_counts_of_more_batches_than_the_progress_history(spark, tmp_path):
    paths = ingest.IngestPaths.below(str(tmp_path / "feed"), str(tmp_path / "store"))
    for number in range(4):
        land(tmp_path / "feed", f"p{number}", entry(f"K{number}"), entry(f"bad{number}", status="?"))
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        assert ingest.run_ingest(spark, paths, max_files=1, buckets=2) == {"entries": 8, "refused": 4}
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)


def test_a_month_that_was_loaded_is_not_loaded_again(spark, tmp_path, monkeypatch):
    paths = ingest.IngestPaths.below(str(tmp_path / "feed"), str(tmp_path / "store"))
    archives = []
    for month in ("202607", "202608"):
        archives.append(str(tmp_path / f"notices_{month}.zip"))
        with zipfile.ZipFile(archives[-1], "w") as packed:
            packed.writestr("x.atom", page(entry(f"K{month}")))
    ingest.load_archives(spark, archives[:1], paths, label="x", buckets=2)
    labels, write = [], ingest.write_batch
    monkeypatch.setattr(ingest, "write_batch", lambda batch, label, *a, **b: (labels.append(label), write(batch, label, *a, **b)))
    ingest.load_archives(spark, archives, paths, label="x", buckets=2)
    assert labels == ["load-x-notices_202608.zip"]
    assert ingest.read_tenders(spark, paths).count() == 2


def packed_month(path, pages, size=1):
    with zipfile.ZipFile(path, "w") as packed:
        for number in range(pages):
            packed.writestr(f"p{number}.atom", page(*[entry(f"K{path.stem}-{number}")] * size))
    return str(path)


def test_archives_are_read_by_range_whatever_their_size(spark, tmp_path, monkeypatch):
    """More tasks than archives, each member once, also where one value could not hold the archive."""
    monkeypatch.setattr(feed, "MAX_VALUE_BYTES", 1_000)
    files = [packed_month(tmp_path / f"notices_20260{month}.zip", 9, size=5) for month in (7, 8)]
    assert all(dict(archives.archive_files(files))[file] > 50_000 for file in files)
    pages = archives.read_archives(spark, files, range_bytes=10_000)
    assert pages.rdd.getNumPartitions() > 2 * len(files)
    rows = pages.collect()
    assert sorted((r["path"], r["member"]) for r in rows) == sorted((f, f"p{i}.atom") for f in files for i in range(9))
    assert all(r["error"] is None and r["text"].count("<entry>") == 5 for r in rows)
    busy = pages.select(F.spark_partition_id().alias("task")).distinct().count()
    assert busy > 2 * len(files)
    paths = ingest.IngestPaths.below(str(tmp_path / "feed"), str(tmp_path / "store"))
    ingest.load_archives(spark, files, paths, label="x", buckets=2)
    assert ingest.read_tenders(spark, paths).count() == 18
    whole = archives.read_archives(spark, [str(tmp_path)]).collect()
    assert {(r["path"], r["member"]) for r in whole} == {(r["path"], r["member"]) for r in rows}


def test_each_member_belongs_to_one_range(tmp_path):
    file = packed_month(tmp_path / "m.zip", 7)
    size = dict(archives.archive_files([file]))[file]
    for step in (1, 999, 4_096, size, size + 1):
        starts = range(0, size, step) if step > 1 else [0, *(i.header_offset for i in zipfile.ZipFile(file).infolist()), size]
        ends = [*list(starts)[1:], size]
        found = [name for a, b in zip(starts, ends) for name, _, _ in archives.members(archives.ByteRange(file, a, b))]
        assert sorted(found) == [f"p{i}.atom" for i in range(7)]


def test_a_month_that_cannot_be_read_is_not_finished(spark, tmp_path):
    paths = ingest.IngestPaths.below(str(tmp_path / "feed"), str(tmp_path / "store"))
    good = packed_month(tmp_path / "notices_202608.zip", 1)
    bad = tmp_path / "notices_202607.zip"
    bad.write_bytes((tmp_path / "notices_202608.zip").read_bytes()[:-30])
    with pytest.raises(ValueError, match="not readable.*notices_202607.zip"):
        ingest.load_archives(spark, [str(bad), good], paths, label="x", buckets=2)
    assert [r["expediente"] for r in ingest.read_tenders(spark, paths).collect()] == ["Knotices_202608-0"]
    packed_month(bad, 1)
    ingest.load_archives(spark, [str(bad), good], paths, label="x", buckets=2)
    assert ingest.read_tenders(spark, paths).count() == 2


@pytest.mark.parametrize("by_range", [True, False])
def test_broken_archives_pages_and_bytes_are_refused_by_name(spark, tmp_path, monkeypatch, by_range):
    whole = page(entry("A"), entry("B"))
    with zipfile.ZipFile(tmp_path / "good.zip", "w", zipfile.ZIP_DEFLATED) as packed:
        packed.writestr("a.atom", whole)
        packed.writestr("cut.atom", page(entry("C"), entry("D"))[:-200])
        packed.writestr("latin.atom", '<?xml version="1.0" encoding="iso-8859-1"?>'.encode() + page(entry("E", title="Año")).encode("latin-1"))
        packed.writestr("bytes.atom", page(entry("F", title="Año")).encode("latin-1"))
        packed.writestr("text.atom", "no page at all")
    (tmp_path / "broken.zip").write_bytes(b"PK nothing")
    monkeypatch.setattr(archives, "readable", lambda path: by_range)
    pages = feed.read_archives(spark, [str(tmp_path / "good.zip"), str(tmp_path / "broken.zip")])
    rows = feed.parse_entries(feed.page_entries(pages), "path", "member")
    kept = {r["expediente"]: r["title"] for r in feed.accepted(rows).collect()}
    assert kept == {"A": "Portal web", "B": "Portal web", "C": "Portal web", "E": "Año"}
    refused = {(r["path"].rsplit("/", 1)[-1], r["member"]): r["reasons"] for r in feed.rejects(rows).collect()}
    assert set(refused) == {("good.zip", "cut.atom"), ("good.zip", "bytes.atom"), ("good.zip", "text.atom"), ("broken.zip", None)}
    assert all("entry malformed" in reasons for reasons in refused.values())


def test_first_of_repeated_elements_counts(spark):
    twice = entry("A").replace("</cacx:ContractFolderStatus>", (
        "<cac:LegalDocumentReference><cac:Attachment><cac:ExternalReference><cbc:URI>https://example.org/second"
        "</cbc:URI></cac:ExternalReference></cac:Attachment></cac:LegalDocumentReference>"
        "<cac:ProcurementProject><cbc:Name>Otro</cbc:Name><cbc:TypeCode>1</cbc:TypeCode></cac:ProcurementProject>"
        "</cacx:ContractFolderStatus>"))
    row = feed.accepted(parsed(spark, twice)).first()
    assert (row["pcap_url"], row["title"], row["contract_type"]) == ("https://example.org/pcap", "Portal web", "services")


def test_stale_stream_fails_abandoned_runs_only(spark, tmp_path):
    folder = tmp_path / "updates"
    schema = "expediente string, status string, updated_at timestamp"

    def land_updates(name, *rows):
        typed = [(k, s, dt.datetime(2026, 1, 1, 12, 0) + dt.timedelta(seconds=t)) for k, s, t in rows]
        spark.createDataFrame(typed, schema).coalesce(1).write.mode("append").parquet(str(folder))

    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stale.start_stale(spark, str(folder), out, checkpoint).awaitTermination()
        return sorted((r["expediente"], r["status"], r["updated_at"].second) for r in spark.read.schema(schema).parquet(out).collect())

    land_updates("1", ("dead", "in_progress", 1), ("done", "in_progress", 0), ("again", "in_progress", 0))
    assert run() == []
    land_updates("2", ("done", "completed", 100), ("again", "in_progress", 700), ("tick", "completed", 901))
    assert run() == []
    # Exactly at the allowed time a run isn't abandoned yet, a moment later it is.
    land_updates("3", ("tick", "completed", 902))
    assert run() == [("dead", "failed", 1)]
    land_updates("4", ("dead", "in_progress", 903), ("dead", "completed", 904))
    assert run() == [("dead", "failed", 1)]
    land_updates("5", ("tick", "completed", 5000))
    assert run() == [("again", "failed", 40), ("dead", "failed", 1)]


def test_stale_stream_query_keeps_to_the_newest_time_of_the_analyses(spark, tmp_path):
    # By their keys, 1798 is completed at 1798 s and ends the time seen; 0 and 903 run since 0 s and 903 s.
    day = dt.datetime(2001, 8, 1)
    rows = [(key, 1, "F", 1000.0, day, "1-URGENT") for key in (0, 903, 1798)]
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    failed = catalog.QUERIES["stale_run_stream"](spark, str(tmp_path)).collect()
    assert [row["expediente"] for row in failed] == ["0"]


def test_feed_files_are_packed_and_name_the_namespaces_once(spark, small_dir):
    folder = feed_views.feed_directory(spark, small_dir)
    files = [row["path"] for row in spark.read.format("binaryFile").load(folder).select("path").collect()]
    assert files and all(path.endswith(".gz") for path in files)
    assert feed_views.entry_texts(spark, small_dir).where("contains(entry, 'xmlns')").isEmpty()


def test_conditions_on_parsed_entries_do_not_repeat_the_parse(spark):
    pages = spark.range(2).select(F.lit("p").alias("path"), F.lit("m").alias("member"), F.concat(F.lit("<feed>"), F.col("id").cast("string")).alias("text"))
    refused = feed.rejects(feed.parse_entries(feed.page_entries(pages), "path", "member"))
    plan = refused._jdf.queryExecution().optimizedPlan().toString()
    conditions = [line for line in plan.splitlines() if "Filter" in line]
    assert plan.count("from_xml") + plan.count("xmltostructs") <= 1
    assert conditions and all(len(line) < 200 for line in conditions)


def test_archives_are_written_page_by_page(tmp_path):
    def rows():
        for page in range(3):
            for number in range(4):
                yield "202608", page, f"<entry>{page}.{number}</entry>"

    class Told:
        def open_output_stream(self, path):
            return open(path, "wb")

    names = [name for frame in feed_views._pack(rows(), Told(), str(tmp_path)) for name in frame["path"]]
    assert names == ["notices_202608.zip"]
    with zipfile.ZipFile(tmp_path / names[0]) as archive:
        assert archive.namelist() == ["page0.atom", "page1.atom", "page2.atom", "readme.txt"]
        texts = [archive.read(f"page{page}.atom").decode() for page in range(3)]
    assert all(text.count("<entry>") == 4 + (page == 2) for page, text in enumerate(texts))
    assert texts[2].endswith("<entry><id>broken") and texts[1].endswith("</feed>")


def test_a_batch_of_few_files_is_parsed_by_all_tasks(spark, tmp_path):
    land(tmp_path / "feed", "p1", entry("A"))
    told = lambda files: feed.stream_entries(spark, str(tmp_path / "feed"), files)._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression" in told(1) and "RepartitionByExpression" not in told(None)


def test_entries_found_by_cutting_are_those_of_the_parser(spark, tmp_path):
    a, b = entry("A"), entry("B")
    pages = {
        "plain": page(a, b),
        "declared": "<?xml version='1.0'?>\n<!DOCTYPE feed>\n" + page(a, b),
        "comment": page(f"<!-- {a} -->", b),
        "end in comment": page(a.replace("<id>", "<!-- </entry> --><id>"), b),
        "end in quoted text": page(entry("A", title="<![CDATA[x </entry> y]]>"), b),
        "start in quoted text": page(entry("A", title="<![CDATA[x <entry> y]]>"), b),
        "broken off": page(a, b)[:-200],
        "end missing": page(a, b)[: -len("</entry></feed>")],
        "attributes": page(a.replace("<entry>", "<entry\n a='>'>"), b),
        "empty": page("<entry/>", "<entry a='1'/>", b),
        "blank in the end": page(a.replace("</entry>", "</entry >"), b),
        "prefix": page(a.replace("entry>", "x:entry>"), b),
        "other name": page("<entryx>q</entryx>", b),
        "nested": page(a.replace("<id>", "<x><entry>z</entry></x><id>"), b),
        "unknown reference": page(entry("A", title="a &foo; b"), b),
        "nothing": "",
    }
    for number, text in enumerate(pages.values()):
        (tmp_path / str(number)).mkdir()
        (tmp_path / str(number) / "p.atom").write_text(text, encoding="utf-8")
    whole = str(tmp_path / "[0-9]*")
    fields = [f.name for f in feed._entry_schema().fields if f.name != "_corrupt_record"]
    shown = lambda frame: sorted(map(str, frame.select(*fields, F.col("_corrupt_record").isNotNull()).collect()))
    cut = feed._read_pieces(feed._entry_pieces(spark.read, whole))
    assert shown(cut) == shown(feed.scan_entries(spark, whole))
    # Bytes that are no text refuse their entry only.
    (tmp_path / "latin").mkdir()
    (tmp_path / "latin" / "p.atom").write_bytes(page(entry("A", title="Año"), b).encode("latin-1"))
    rows = feed.parse_entries(feed._read_pieces(feed._entry_pieces(spark.read, str(tmp_path / "latin"))))
    assert [r["expediente"] for r in feed.accepted(rows).collect()] == ["B"]
    assert [r["reasons"] for r in feed.rejects(rows).collect()] == [["entry malformed"]]


@pytest.mark.parametrize("groups", [1, 1024])
def test_runs_of_a_group_of_keys_are_told_apart(spark, tmp_path, monkeypatch, groups):
    """Whatever share a call: runs that end, run on, tie or are due just when the time stands."""
    monkeypatch.setattr(stale, "GROUPS", groups)
    calls = spark.sparkContext.accumulator(0)

    class Counted(stale.OpenRuns):
        def handleInputRows(self, *told):
            calls.add(1)
            return super().handleInputRows(*told)

    monkeypatch.setattr(stale, "OpenRuns", Counted)
    schema = "expediente string, status string, updated_at timestamp"
    begin = dt.datetime(2026, 1, 1, 12, 0)
    rows = [(f"k{i}", "in_progress", i % 7) for i in range(40)] + [(f"k{i}", "completed", 8) for i in range(20)]
    rows += [("tie", "in_progress", 5), ("old", "in_progress", 3), ("old", "failed", 2), ("edge", "in_progress", 100), ("next", "in_progress", 101)]
    for name, landed in (("1", rows), ("2", [("k30", "in_progress", 400), ("tie", "completed", 5), ("t", "completed", 1000.001)])):
        typed = [(key, status, begin + dt.timedelta(seconds=at)) for key, status, at in landed]
        spark.createDataFrame(typed, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "updates"))
        stale.start_stale(spark, str(tmp_path / "updates"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    found = spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()
    # By the second landing the time stands at 101 s, so that the end of `tie` comes too late.
    told = sorted((r["expediente"], r["status"], (r["updated_at"] - begin).seconds) for r in found)
    kept = [(f"k{i}", "failed", i % 7) for i in range(20, 40) if i != 30]
    assert told == sorted([*kept, ("old", "failed", 3), ("tie", "failed", 5), ("edge", "failed", 100)])
    assert groups > 1 or calls.value == 2
