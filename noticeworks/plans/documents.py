"""Registered queries over document pages, citations and free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeworks.functions import text
from noticeworks.operators import citations, documents, encode, freetext
from noticeworks.plans import views
from noticeworks.plans.oracle_views import SPACE, outcome_sql, sql_text
from noticeworks.plans.registry import query
from noticeworks.sources.tables import read_table


@query(
    "text_layer",
    f"""
SELECT doc_id, count(*) AS pages, round(c, 6) AS chars_per_page, c >= 20 AS has_text_layer
FROM (SELECT doc_id, sum(length(regexp_replace(text, '{SPACE}+', '', 'g'))) OVER (PARTITION BY doc_id)
             / count(*) OVER (PARTITION BY doc_id) AS c FROM all_pages_v)
GROUP BY doc_id, c""",
)
def text_layer(spark, sf):
    return documents.text_layer(views.all_pages(spark, sf))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    hashed = documents.content_hash(read_table(spark, sf, "documents"), "text")
    return hashed.select("doc_id", "content_hash")


@query(
    "hash_reuse",
    """
SELECT a.expediente, a.pdf_hash, a.status, d.donor, s.status AS donor_status
FROM analyses_v a
LEFT JOIN (SELECT b.expediente, min(o.expediente) AS donor FROM analyses_v b
           JOIN analyses_v o ON o.pdf_hash = b.pdf_hash AND o.expediente <> b.expediente
           WHERE o.status IN ('completed', 'not_analyzable') GROUP BY 1) d ON a.expediente = d.expediente
LEFT JOIN analyses_v s ON s.expediente = d.donor""",
)
def hash_reuse(spark, sf):
    return documents.hash_reuse(views.analyses(spark, sf))


@query(
    "reuse_copies",
    """
SELECT a.expediente, d.donor IS NOT NULL AS reused, coalesce(s.status, a.status) AS status,
       CASE WHEN d.donor IS NULL THEN a.has_extraction ELSE s.has_extraction END AS has_extraction,
       CASE WHEN d.donor IS NULL THEN a.citation_faithfulness ELSE s.citation_faithfulness END AS citation_faithfulness,
       CASE WHEN d.donor IS NULL THEN a.error_message ELSE s.error_message END AS error_message
FROM analyses_v a
LEFT JOIN (SELECT b.expediente, min(o.expediente) AS donor FROM analyses_v b
           JOIN analyses_v o ON o.pdf_hash = b.pdf_hash AND o.expediente <> b.expediente
           WHERE o.status IN ('completed', 'not_analyzable') AND b.status NOT IN ('completed', 'not_analyzable')
           GROUP BY 1) d ON a.expediente = d.expediente
LEFT JOIN analyses_v s ON s.expediente = d.donor""",
)
def reuse_copies(spark, sf):
    return documents.copy_from_donor(views.analyses(spark, sf)).select(
        "expediente",
        "reused",
        "status",
        F.col("extraction").isNotNull().alias("has_extraction"),
        "citation_faithfulness",
        "error_message",
    )


@query(
    "doc_prompt",
    """
SELECT doc_id, part, CASE WHEN part = min(part) OVER d THEN '<PLIEGO>' || chr(10) ELSE '' END || body
  || CASE WHEN part = max(part) OVER d THEN chr(10) || '</PLIEGO>' ELSE chr(10) || chr(10) END AS prompt
FROM (SELECT doc_id, (page - 1) // 4 AS part,
             string_agg('===== PÁGINA ' || page || ' =====' || chr(10)
               || replace(replace(text, '</PLIEGO>', '[marca eliminada]'), '<PLIEGO>', '[marca eliminada]'),
               chr(10) || chr(10) ORDER BY page) AS body
      FROM all_pages_v GROUP BY ALL)
WINDOW d AS (PARTITION BY doc_id)""",
)
def doc_prompt(spark, sf):
    return documents.doc_prompt(views.all_pages(spark, sf))


_HEADER_SQL = r"(?i)^cl[aá]usula\s+(\d+(?:\.\d+)*)\s*[.\-:]?\s*(.+)$"


@query(
    "clause_chunks",
    f"""
SELECT doc_id, clause_index, part, regexp_extract(any_value(header), '{_HEADER_SQL}', 1) AS number,
       regexp_replace(regexp_extract(any_value(header), '{_HEADER_SQL}', 2), '^{SPACE}+|{SPACE}+$', '', 'g') AS title,
       any_value(start) AS page,
       CASE WHEN part = any_value(last_part) THEN regexp_replace(string_agg(line, chr(10) ORDER BY page, i), '{SPACE}+$', '')
            ELSE string_agg(line, chr(10) ORDER BY page, i) || chr(10) END AS text
FROM (SELECT *, max(part) OVER (PARTITION BY doc_id, clause_index) AS last_part
FROM (SELECT *, (page - start) // 4 AS part
FROM (SELECT *, first_value(line) OVER c AS header, first_value(page) OVER c AS start
FROM (SELECT *, sum(CASE WHEN regexp_matches(line, '{_HEADER_SQL}') THEN 1 ELSE 0 END)
                OVER (PARTITION BY doc_id ORDER BY page, i) AS clause_index
      FROM (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line,
                   unnest(range(0, len(string_split(text, chr(10))))) AS i FROM clause_pages_v))
WHERE clause_index > 0 WINDOW c AS (PARTITION BY doc_id, clause_index ORDER BY page, i))))
GROUP BY doc_id, clause_index, part""",
)
def clause_chunks(spark, sf):
    return documents.clause_chunks(views.clause_pages(spark, sf))


@query(
    "page_offsets",
    """
SELECT doc_id, page, length(text) + 1 AS size, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_offset FROM all_pages_v""",
)
def page_offsets(spark, sf):
    return documents.page_offsets(views.all_pages(spark, sf))


@query(
    "fixed_chunks",
    """
SELECT doc_id, i AS chunk, substring(whole, i * 500 + 1, 500) AS text
FROM (SELECT doc_id, whole, unnest(range(0, (length(whole) + 499) // 500)) AS i
      FROM (SELECT doc_id, string_agg(text || chr(10), '' ORDER BY page) AS whole FROM all_pages_v GROUP BY doc_id))""",
)
def fixed_chunks(spark, sf):
    return documents.fixed_chunks(views.all_pages(spark, sf))


@query(
    "mask_long_text",
    """
SELECT doc_id, CASE WHEN length(text) > 500
  THEN substring(text, 1, 500) || '... [' || length(text) || ' caracteres, truncado]' ELSE text END AS masked,
  array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(x) > 500
  THEN substring(x, 1, 500) || '... [' || length(x) || ' caracteres, truncado]' ELSE x END), chr(10)) AS masked_lines
FROM documents""",
)
def mask_long_text(spark, sf):
    lines = text.mask_long_all(F.split("text", "\n"))
    return read_table(spark, sf, "documents").select(
        "doc_id",
        text.mask_long(F.col("text")).alias("masked"),
        F.array_join(lines, "\n").alias("masked_lines"),
    )


_CUT = "CASE WHEN length({0}) > 500 THEN substring({0}, 1, 500) || '... [' || length({0}) || ' caracteres, truncado]' ELSE {0} END"


@query(
    "mask_nested",
    f"""
SELECT doc_id, {_CUT.format('text')} AS body, lang, {_CUT.format("(lang || text)")} AS noted, n_chars,
       array_to_string(list_transform(string_split(text, chr(10)), lambda x: {_CUT.format('x')}), chr(10)) AS lines
FROM documents""",
)
def mask_nested(spark, sf):
    """The same rule anywhere in a payload: text in structs, lists and maps is cut, all else stays."""
    payload = F.struct(
        F.struct("text", "lang", "n_chars").alias("input"),
        F.split("text", "\n").alias("lines"),
        F.create_map(F.lit("note"), F.concat("lang", "text")).alias("notes"),
    )
    rows = read_table(spark, sf, "documents").select("doc_id", payload.alias("payload"))
    masked = rows.select(
        "doc_id", text.mask_long_deep(F.col("payload"), rows.schema["payload"].dataType).alias("p")
    )
    return masked.select(
        "doc_id",
        F.col("p.input.text").alias("body"),
        F.col("p.input.lang").alias("lang"),
        F.col("p.notes")["note"].alias("noted"),
        F.col("p.input.n_chars").alias("n_chars"),
        F.array_join("p.lines", "\n").alias("lines"),
    )


@query(
    "parse_list_field",
    f"""
SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[,\\n]'),
         lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda e: e <> ''), '|') AS entries,
       n_chars + 0.5e0 AS amount
FROM documents""",
)
def parse_list_field(spark, sf):
    typed = F.concat(F.lit(" "), F.col("n_chars").cast("string"), F.lit(",5 "))
    return read_table(spark, sf, "documents").select(
        "doc_id",
        F.array_join(text.split_list(F.col("text")), "|").alias("entries"),
        text.parse_amount(typed).cast("double").alias("amount"),
    )


@query("citation_check", "SELECT doc_id, source_page, line, page, outcome FROM checked_v")
def citation_check(spark, sf):
    checked = citations.check_citations(views.citations(spark, sf), views.doc_pages(spark, sf))
    return checked.select("doc_id", "source_page", "line", "page", "outcome")


_REPORT_SQL = f"""
SELECT c.analysis_id, c.field, {outcome_sql('p.text', 'c.quote')} AS outcome
FROM page_citations_v c LEFT JOIN doc_pages_v p ON c.doc_id = p.doc_id AND c.page = p.page
WHERE c.quote IS NOT NULL"""


@query("citation_report", _REPORT_SQL)
def citation_report(spark, sf):
    report = citations.citation_report(views.page_extractions(spark, sf), views.doc_pages(spark, sf))
    return report.select("analysis_id", "field", "outcome")


@query(
    "faithfulness",
    f"""
SELECT analysis_id, count(*) AS citations,
       round(avg(CASE WHEN outcome <> 'unverified' THEN 1.0e0 ELSE 0.0e0 END), 9) AS faithfulness
FROM ({_REPORT_SQL}) GROUP BY analysis_id""",
)
def faithfulness(spark, sf):
    return citations.faithfulness(views.page_extractions(spark, sf), views.doc_pages(spark, sf))


@query(
    "context_window",
    """
SELECT c.doc_id, c.source_page, c.line, c.page,
       coalesce((SELECT string_agg(w.text, chr(10) || '--' || chr(10) ORDER BY w.page) FROM doc_pages_v w
                 WHERE w.doc_id = c.doc_id AND w.page BETWEEN c.page - 1 AND c.page + 1
                   AND EXISTS (SELECT 1 FROM doc_pages_v e WHERE e.doc_id = c.doc_id AND e.page = c.page)), '') AS contexts
FROM citations_v c""",
)
def context_window(spark, sf):
    windows = freetext.context_window(
        views.citations(spark, sf), views.doc_pages(spark, sf), ["doc_id", "source_page", "line"]
    )
    return windows.select(
        "doc_id",
        "source_page",
        "line",
        "page",
        F.array_join("contexts", "\n--\n").alias("contexts"),
    )


_FIELD_ROWS = ", ".join(
    f"{{'block': {sql_text(name)}, 'question': {sql_text(question)}}}"
    for name, question in freetext.QUESTIONS.items()
)


@query(
    "freetext_samples",
    f"""
SELECT s.analysis_id, s.field, s.question, s.description, s.cited_page, x.contexts,
       CASE WHEN s.cited_page IS NULL THEN {sql_text(freetext.NO_CITATION)}
            WHEN x.contexts IS NULL THEN {sql_text(freetext.NO_PAGE)} END AS skip_reason
FROM (SELECT c.analysis_id, c.doc_id, q.block || '.description' AS field, q.question,
             q.block || ': ' || c.own_text AS description, c.page AS cited_page
      FROM page_citations_v c JOIN (SELECT unnest([{_FIELD_ROWS}]) AS q) ON q.block = c.field) s
LEFT JOIN (SELECT m.doc_id, m.page, string_agg(w.text, chr(10) || '--' || chr(10) ORDER BY w.page) AS contexts
           FROM doc_pages_v m JOIN doc_pages_v w ON w.doc_id = m.doc_id AND w.page BETWEEN m.page - 1 AND m.page + 1
           GROUP BY 1, 2) x ON x.doc_id = s.doc_id AND x.page = s.cited_page""",
)
def freetext_samples(spark, sf):
    samples = freetext.freetext_samples(
        views.page_extractions(spark, sf), views.doc_pages(spark, sf)
    )
    shown = F.when(F.size("contexts") > 0, F.array_join("contexts", "\n--\n"))
    return samples.select(
        "analysis_id",
        "field",
        "question",
        "description",
        "cited_page",
        shown.alias("contexts"),
        "skip_reason",
    )


_FIELDS = [f"{name}.description" for name in freetext.QUESTIONS]
_FIELD_LIST_SQL = "[" + ", ".join(sql_text(f) for f in _FIELDS) + "]"
_SCORES_SQL = f"""
SELECT s.doc_id, s.field, count(c.outcome) AS claims,
       count(*) FILTER (WHERE c.outcome <> 'unverified') AS supported,
       round(count(*) FILTER (WHERE c.outcome <> 'unverified') / nullif(count(c.outcome), 0), 9) AS score
FROM (SELECT doc_id, unnest({_FIELD_LIST_SQL}) AS field FROM (SELECT DISTINCT doc_id FROM doc_pages_v)) s
LEFT JOIN (SELECT doc_id, outcome, ({_FIELD_LIST_SQL})[CAST(line % 7 + 1 AS INT)] AS field FROM checked_v) c
  ON c.doc_id = s.doc_id AND c.field = s.field
GROUP BY s.doc_id, s.field"""


def _claim_scores(spark, sf):
    fields = F.array(*[F.lit(f) for f in _FIELDS])
    pages = views.doc_pages(spark, sf)
    claims = citations.check_citations(views.citations(spark, sf), pages).select(
        "doc_id",
        F.element_at(fields, (F.col("line") % 7 + 1).cast("int")).alias("field"),
        (F.col("outcome") != citations.UNVERIFIED).alias("supported"),
    )
    samples = pages.select("doc_id").distinct().withColumn("field", F.explode(fields))
    return freetext.claim_scores(samples, claims)


@query("claim_support", _SCORES_SQL)
def claim_support(spark, sf):
    return _claim_scores(spark, sf)


@query(
    "claim_summary",
    f"""
SELECT count(*) AS descriptions, count(*) FILTER (WHERE claims = 0) AS without_claims, sum(claims) AS claims,
       sum(supported) AS supported, round(avg(score), 8) AS mean_score FROM ({_SCORES_SQL})""",
)
def claim_summary(spark, sf):
    return freetext.claim_summary(_claim_scores(spark, sf))


# The place and sign of a word come from the first three digits of its MD5.
_DIGIT = "(strpos('0123456789abcdef', substr(md5(w), {}, 1)) - 1)"
_WORDS = f"list_filter(regexp_split_to_array(lower(text), '{SPACE}+'), lambda w: w <> '')"


_BACKFILL_SQL = f"""
SELECT doc_id, list_transform(summed, lambda x: round(CAST(CAST(x / greatest(length, 1e-9) AS FLOAT) AS DOUBLE), 6)) AS embedding
FROM (SELECT *, sqrt(list_sum(list_transform(summed, lambda x: x * x))) AS length
FROM (SELECT doc_id, list_transform(range(0, 64), lambda d:
        coalesce(list_sum(list_transform(list_filter(words, lambda w: w[1] = d), lambda w: w[2])), 0)) AS summed
FROM (SELECT doc_id, list_transform({_WORDS}, lambda w: [{_DIGIT.format(1)} * 4 + {_DIGIT.format(2)} // 4,
        CASE WHEN {_DIGIT.format(3)} % 2 = 1 THEN 1 ELSE -1 END]) AS words FROM documents)))"""


def _backfilled(spark, sf, encoder):
    """Vectors for every document that has none yet; here, for all of them."""
    rows = read_table(spark, sf, "documents").select(
        "doc_id", "text", F.lit(None).cast("array<float>").alias("embedding")
    )
    filled = encode.backfill_vectors(rows, "doc_id", "text", encoder)
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 6))
    return filled.select("doc_id", rounded.alias("embedding"))


@query("backfill_vectors", _BACKFILL_SQL)
def backfill_vectors(spark, sf):
    return _backfilled(spark, sf, encode.hashing_encoder())


def _hashing_model():
    """The hashing encoder as a model that a worker loads: texts in, vectors out."""
    import hashlib
    import re

    import numpy as np

    blank = re.compile("[\\s\u000b\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

    def vectors(texts):
        out = np.zeros((len(texts), 64), np.float64)
        for row, one in zip(out, texts):
            for word in filter(None, blank.split(one.lower())):
                digits = hashlib.md5(word.encode()).hexdigest()
                row[int(digits[0], 16) * 4 + int(digits[1], 16) // 4] += 1 if int(digits[2], 16) % 2 else -1
        return out / np.maximum(np.sqrt((out * out).sum(1)), 1e-9)[:, None]

    return vectors


@query("backfill_vectors_model", _BACKFILL_SQL)
def backfill_vectors_model(spark, sf):
    """The same vectors from a model that every worker loads once."""
    return _backfilled(spark, sf, encode.model_encoder("hashing", _hashing_model))
