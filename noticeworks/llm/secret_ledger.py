"""Secret scans with an incremental ledger of blobs.

Every version of every document is addressed by the SHA-256 of its text (its blob). The
ledger is a table of scans: blob, the rule versions applied to it and what they found. An
update takes each distinct blob once, leaves out the pairs of blob and rule version that
the ledger already holds, scans the rest and appends. Findings are joined back from blobs
to all documents that carry them. A new version of a rule is a new pair, so only that rule
runs again.

Spans are counted in code points, end exclusive. Defined cases: a null text is the empty
blob, without findings; repeated rows get their findings each; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm.common import blocks, free_names, texts
from noticeworks.session import shared_dir

#: Copies of a finding for the join back, so that a blob with very many documents is spread.
SALTS = 8


@dataclass(frozen=True)
class SecretRule:
    """A pattern over UTF-8 bytes. A match counts if the group `value` has `least` bytes or more.

    `needs` are lower-case strings of which a text must hold one (in either case) for any match.
    """

    kind: str
    version: int
    pattern: bytes
    value: int = 0
    least: int = 1
    needs: tuple[bytes, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: What stands between the lines of a key: line ends, also escaped ones, quotes and signs that join strings.
_GAP = rb"(?:[\s\"'>|,;]|\\[nrt]?|\+(?=[\s\"']))*+"
#: A key from its BEGIN line to the matching END line; where that is missing, to the end of its headers
#: and base64 lines, of which the last may be short.
_PRIVATE_KEY = (
    rb"-----BEGIN ([A-Z0-9 ]{0,40})PRIVATE KEY((?: BLOCK)?)-----(?:"
    rb"(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END \1PRIVATE KEY\2-----|"
    rb"(?:" + _GAP + rb"(?:Proc-Type|DEK-Info|Key-Info|Version|Comment|Hash|Charset|MessageID):[^\r\n\\\"']*+)*+"
    rb"(?:" + _GAP + rb"[A-Za-z0-9+/]{16,}+={0,2}+)*+"
    rb"(?:(?!\s*?\n[ \t\r]*\n)" + _GAP + rb"=?[A-Za-z0-9+/]++={0,2}+(?=[ \t]*(?:[\r\n\\\"']|\Z)))?)"
)

BASE_KINDS = ("assign", "access", "hex")
RULES = (
    SecretRule(
        "assign",
        1,
        rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
        (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"),
    ),
    SecretRule("access", 1, rb"AKIA[A-Z0-9]+", 0, 20, (b"akia",)),
    SecretRule("hex", 1, rb"[0-9a-f]{24,}", 0, 24),
    SecretRule("private_key", 2, _PRIVATE_KEY, 0, 1, (b"private key-----", b"private key block-----")),
    SecretRule("web_token", 1, rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, (b"eyj",)),
    SecretRule("prefixed", 1, rb"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,})", 0, 1, (b"gh", b"xox")),
    SecretRule("url_login", 2, rb"://[^\s/:@]+:[^\s/:@]{6,}@", 0, 1, (b"://",)),
)

_FINDINGS = "array<struct<rule:string,kind:string,start:bigint,end:bigint>>"
LEDGER = f"blob binary, rules array<string>, findings {_FINDINGS}"


def find(text: bytes, rules) -> list[tuple[str, str, int, int]]:
    """(rule key, kind, start, end) of all matches, leftmost and non-overlapping for each rule."""
    lowered, found = text.lower(), []
    for rule, pattern in rules:
        if rule.needs and not any(need in lowered for need in rule.needs):
            continue
        for match in pattern.finditer(text):
            if match.end(rule.value) - match.start(rule.value) >= rule.least:
                found.append((rule.key, rule.kind, match.start(), match.end()))
    if found and not text.isascii():
        place = {at: len(text[:at].decode("utf-8")) for span in found for at in span[2:]}
        found = [(key, kind, place[start], place[end]) for key, kind, start, end in found]
    return found


def with_blob(documents: DataFrame) -> DataFrame:
    """Adds the content address of the text; a null text is the empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", text.alias("text")).withColumn("blob", F.unhex(F.sha2(F.col("text"), 256)))


def update(documents: DataFrame, ledger: str, rules=RULES) -> None:
    """Scans the pairs of blob and rule version that the ledger at `ledger` lacks and appends what they hold.

    `documents` may hold any number of versions (doc_id, text). Copies are taken together
    before the shuffle, so the most frequent text moves once per task.
    """
    spark = documents.sparkSession
    keys = [rule.key for rule in rules]
    contents = with_blob(documents).groupBy("blob").agg(F.first("text").alias("text"))
    seen = read_ledger(spark, ledger)
    everything = F.array(*map(F.lit, keys))
    if seen is None:
        waiting = contents.select("blob", "text", everything.alias("rules"))
    else:
        done = seen.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("done"))
        missing = F.array_except(everything, F.coalesce(F.col("done"), F.array().cast("array<string>")))
        waiting = (
            contents.join(done, "blob", "left").select("blob", "text", missing.alias("rules")).where(F.size("rules") > 0)
        )
    compiled = {rule.key: (rule, rule.pattern) for rule in rules}

    def run(batches):
        patterns = {key: (rule, re.compile(pattern)) for key, (rule, pattern) in compiled.items()}
        kind = pa.list_(
            pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        )
        for block in blocks(batches, "text"):
            rows = [
                [dict(zip(("rule", "kind", "start", "end"), span)) for span in find(text, [patterns[key] for key in wanted])]
                for text, wanted in zip(texts(block.column(1)), block.column(2).to_pylist())
            ]
            yield pa.record_batch(
                [block.column(0), block.column(2), pa.array(rows, kind)], names=["blob", "rules", "findings"]
            )

    waiting.mapInArrow(run, LEDGER).write.mode("append").parquet(ledger)


def read_ledger(spark, ledger: str) -> DataFrame | None:
    """All scans so far, or None where nothing has been written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def findings(documents: DataFrame, ledger: str, rules=RULES) -> DataFrame:
    """doc_id, blob and spans: what the given rule versions found in each document's blob.

    Spans are ordered by start, then by the order of the rules. Only blobs with findings
    take part in the join; their rows are copied `SALTS` times and the documents dealt out
    over the copies, so that one blob in very many documents fills no single task.
    """
    keys = F.array(*[F.lit(rule.key) for rule in rules])
    found = (
        read_ledger(documents.sparkSession, ledger)
        .select("blob", F.explode("findings").alias("span"))
        .where(F.col("span.rule").isin([rule.key for rule in rules]))
        .groupBy("blob")
        .agg(
            F.array_sort(
                F.collect_set(
                    F.struct(
                        F.col("span.start").alias("start"),
                        F.array_position(keys, F.col("span.rule")).alias("place"),
                        F.col("span.end").alias("end"),
                        F.col("span.kind").alias("kind"),
                    )
                )
            ).alias("spans")
        )
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    carriers = with_blob(documents).select(
        "doc_id", "blob", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    )
    return carriers.join(found, ["blob", "salt"], "left").select(
        "doc_id", "blob", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans")
    )


def scan(documents: DataFrame, rules=RULES, ledger: str | None = None) -> DataFrame:
    """Updates the ledger (a new one in the shared folder by default) and joins the findings back."""
    ledger = ledger or shared_dir(documents.sparkSession, "secret-ledger")
    update(documents, ledger, rules)
    return findings(documents, ledger, rules)


def summary(found: DataFrame) -> DataFrame:
    """The contract's columns: counts of the base kinds, a digest of the base spans, and all spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *map(count, BASE_KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(documents: DataFrame, rules=RULES, ledger: str | None = None, marker: str = "[secret]") -> DataFrame:
    """The documents with every span that a rule finds replaced by `marker`; all columns stay.

    Overlapping spans are replaced together. The text of a null stays null. Rows are joined
    to the findings by blob, and only blobs with findings reach Python.
    """
    ledger = ledger or shared_dir(documents.sparkSession, "secret-ledger")
    update(documents, ledger, rules)
    spark = documents.sparkSession
    blob, salt, spans = free_names(documents, "blob", "salt", "spans")
    found = (
        read_ledger(spark, ledger)
        .where(F.size("findings") > 0)
        .select(F.col("blob").alias(blob), F.explode("findings").alias("span"))
        .where(F.col("span.rule").isin([rule.key for rule in rules]))
        .groupBy(blob)
        .agg(F.sort_array(F.collect_list(F.struct("span.start", "span.end"))).alias(spans))
        .withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )

    @F.pandas_udf("string")
    def replaced(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for one, begins, stops in zip(text, starts, ends):
            if one is not None and begins is not None:
                parts, at = [], 0
                for start, end in zip(begins, stops):
                    if start >= at:
                        parts += [one[at:start], marker]
                    at = max(at, end)
                one = "".join([*parts, one[at:]])
            out.append(one)
        return pd.Series(out, dtype=object)

    keyed = documents.withColumn(blob, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).withColumn(
        salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    )
    joined = keyed.join(found, [blob, salt], "left")
    starts, ends = F.col(f"{spans}.start"), F.col(f"{spans}.end")
    clean = F.when(F.col(spans).isNull(), F.col("text")).otherwise(replaced("text", starts, ends))
    return joined.withColumn("text", clean).select(*documents.columns)
