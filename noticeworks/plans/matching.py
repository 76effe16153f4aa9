"""Registered queries: tender lists, the funnel, rankings and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeworks.operators import evaluation, funnel, ranking, tenders
from noticeworks.functions import display
from noticeworks.plans import views
from noticeworks.plans.oracle_views import AS_OF_SQL, query_terms_sql, sql_case, title_terms_sql
from noticeworks.plans.registry import query, stamp

DIMENSION = 64
TOP = 20

_LIST_SQL = """expediente, title, status, location,
       strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at"""


def _listed():
    return ("expediente", "title", "status", "location", stamp("published_at"))


def _budget():
    return F.col("budget_with_vat").cast("double").alias("budget_with_vat")


@query(
    "tender_list",
    f"""
SELECT {_LIST_SQL}, CAST(budget_with_vat AS DOUBLE) AS budget_with_vat FROM tenders_v
WHERE status = 'open_for_submission' AND location = 'NATION_1'
  AND budget_with_vat >= 50000 AND budget_with_vat <= 250000
ORDER BY tenders_v.published_at DESC, expediente LIMIT 20 OFFSET 5""",
)
def tender_list(spark, sf):
    page = tenders.list_tenders(
        views.tenders(spark, sf),
        status="open_for_submission",
        location="NATION_1",
        min_budget=50000,
        max_budget=250000,
        limit=20,
        offset=5,
    )
    return page.select(*_listed(), _budget())


@query(
    "tender_list_total",
    """
SELECT count(*) AS total, greatest(0, least(20, count(*) - 5)) AS returned,
       CAST(20 AS BIGINT) AS "limit", CAST(5 AS BIGINT) AS "offset"
FROM tenders_v
WHERE status = 'open_for_submission' AND budget_with_vat >= 50000 AND budget_with_vat <= 250000""",
)
def tender_list_total(spark, sf):
    return tenders.list_total(
        views.tenders(spark, sf),
        status="open_for_submission",
        min_budget=50000,
        max_budget=250000,
        limit=20,
        offset=5,
    )


@query(
    "tender_list_code",
    f"""
SELECT {_LIST_SQL} FROM tenders_v WHERE list_contains(norm_codes, '72401800')
ORDER BY tenders_v.published_at DESC, expediente LIMIT 50""",
)
def tender_list_code(spark, sf):
    page = tenders.list_tenders(views.tenders(spark, sf), code="72401800-0", limit=50)
    return page.select(*_listed())


@query(
    "tender_list_prefix",
    f"""
SELECT {_LIST_SQL} FROM tenders_v
WHERE len(list_filter(norm_codes, lambda x: starts_with(x, '7212'))) > 0
ORDER BY tenders_v.published_at DESC, expediente LIMIT 50""",
)
def tender_list_prefix(spark, sf):
    return tenders.list_tenders(views.tenders(spark, sf), code="7212", limit=50).select(*_listed())


@query(
    "tender_by_key",
    f"""
SELECT {_LIST_SQL}, contract_type, procedure_type, contracting_body,
       array_to_string(cpv_codes, ',') AS cpv_codes FROM tenders_v WHERE expediente = '17'""",
)
def tender_by_key(spark, sf):
    return tenders.tender_by_key(views.tenders(spark, sf), "17").select(
        *_listed(),
        "contract_type",
        "procedure_type",
        "contracting_body",
        F.array_join("cpv_codes", ",").alias("cpv_codes"),
    )


@query(
    "vertical_filter",
    """
SELECT expediente, array_to_string(cpv_codes, ',') AS cpv_codes FROM tenders_v
WHERE len(list_filter(norm_codes, lambda x: starts_with(x, '72'))) > 0""",
)
def vertical_filter(spark, sf):
    return tenders.vertical_filter(views.tenders(spark, sf)).select(
        "expediente", F.array_join("cpv_codes", ",").alias("cpv_codes")
    )


_COUNTS_SQL = f"""
SELECT p.provider_id, (SELECT count(*) FROM tenders_v) AS total,
       (SELECT count(*) FROM tenders_v WHERE status = 'open_for_submission'
          AND submission_deadline >= {AS_OF_SQL}) AS after_status,
       count(c.expediente) AS after_code,
       count(*) FILTER (WHERE c.fits_budget) AS after_budget,
       count(*) FILTER (WHERE c.fits_budget AND c.fits_location) AS after_location
FROM providers_v p LEFT JOIN code_pairs_v c ON p.provider_id = c.provider_id GROUP BY p.provider_id"""


@query("funnel_counts", _COUNTS_SQL)
def funnel_counts(spark, sf):
    return funnel.funnel_counts(
        views.tenders(spark, sf), views.providers(spark, sf), views.as_of()
    )


@query(
    "match_answer",
    f"""
SELECT provider_id, after_location AS total, least(20, after_location) AS returned, CAST(20 AS BIGINT) AS "limit",
       total AS funnel_total, after_status AS funnel_after_status, after_code AS funnel_after_code,
       after_budget AS funnel_after_budget, after_location AS funnel_after_location FROM ({_COUNTS_SQL})""",
)
def match_answer(spark, sf):
    counts = funnel.funnel_counts(
        views.tenders(spark, sf), views.providers(spark, sf), views.as_of()
    )
    return funnel.match_answer(counts, limit=TOP)


@query(
    "provider_by_key",
    """
SELECT provider_id, description, array_to_string(certifications, ',') AS certifications
FROM providers_v WHERE provider_id = (SELECT min(provider_id) FROM providers_v)""",
)
def provider_by_key(spark, sf):
    everyone = views.providers(spark, sf)
    first = everyone.agg(F.min("provider_id")).scalar()
    return everyone.filter(F.col("provider_id") == first).select(
        "provider_id", "description", F.array_join("certifications", ",").alias("certifications")
    )


@query(
    "funnel_empty_stage",
    f"""
SELECT provider_id, CASE WHEN after_status = 0 THEN 'status' WHEN after_code = 0 THEN 'code'
       WHEN after_budget = 0 THEN 'budget' WHEN after_location = 0 THEN 'location' END AS empty_stage
FROM ({_COUNTS_SQL})""",
)
def funnel_empty_stage(spark, sf):
    counts = funnel.funnel_counts(
        views.tenders(spark, sf), views.providers(spark, sf), views.as_of()
    )
    return funnel.empty_stage(counts).select("provider_id", "empty_stage")


@query(
    "funnel_matches",
    """
SELECT provider_id, expediente, position, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at
FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY published_at DESC, expediente) AS position
      FROM candidates_v) WHERE position <= 20""",
)
def funnel_matches(spark, sf):
    pages = funnel.newest_matches(
        views.tenders(spark, sf), views.providers(spark, sf), views.as_of(), limit=TOP
    )
    return pages.select("provider_id", "expediente", "position", stamp("published_at"))


@query("title_terms", title_terms_sql("spanish_tenders_v"))
def title_terms(spark, sf):
    return ranking.title_terms(views.spanish_tenders(spark, sf))


@query(
    "query_terms",
    f"""
SELECT p.provider_id, coalesce(string_agg(q.term, ' | ' ORDER BY q.term), '') AS terms, count(q.term) AS n_terms
FROM providers_v p LEFT JOIN ({query_terms_sql("spanish_providers_v")}) q ON p.provider_id = q.provider_id GROUP BY p.provider_id""",
)
def query_terms(spark, sf):
    return ranking.query_terms(views.spanish_providers(spark, sf)).select(
        "provider_id",
        F.array_join("query_terms", " | ").alias("terms"),
        F.size("query_terms").alias("n_terms"),
    )


def _pairs(spark, sf, vectors: bool):
    tender_columns = ("expediente", "title", "cpv_codes", "budget_with_vat", "location", "status", "submission_deadline")
    t = views.tenders(spark, sf).select(*tender_columns)
    p = views.providers(spark, sf)
    if not vectors:
        return ranking.scored_pairs(t, p, views.as_of())
    return ranking.scored_pairs(
        t,
        p,
        views.as_of(),
        views.tender_vectors(spark, sf),
        views.provider_vectors(spark, sf),
        DIMENSION,
    )


@query(
    "lexical_topk",
    """
SELECT * FROM (SELECT provider_id, expediente, score,
    row_number() OVER (PARTITION BY provider_id ORDER BY score DESC, expediente) AS rank FROM lexical_v)
WHERE rank <= 20""",
)
def lexical_topk(spark, sf):
    return ranking.lexical_topk(_pairs(spark, sf, vectors=False), TOP)


@query(
    "vector_topk",
    """
SELECT * FROM (SELECT provider_id, expediente, distance,
    row_number() OVER (PARTITION BY provider_id ORDER BY distance, expediente) AS rank FROM vector_v)
WHERE rank <= 20""",
)
def vector_topk(spark, sf):
    return ranking.vector_topk(_pairs(spark, sf, vectors=True), TOP)


@query(
    "normalize_vectors",
    """
SELECT vec_id, pos, round(x / sqrt(list_dot_product(e, e)), 9) AS value
FROM (SELECT vec_id, e, unnest(e) AS x, unnest(range(0, len(e))) AS pos
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = 64))""",
)
def normalize_vectors(spark, sf):
    rows = ranking.unit_vectors(views.read_table(spark, sf, "embeddings"), DIMENSION)
    return rows.select("vec_id", F.posexplode("embedding").alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 9).alias("value")
    )


def _fused(spark, sf):
    return ranking.fuse(_pairs(spark, sf, vectors=True), TOP)


_FUSED = (
    "provider_id",
    "expediente",
    "position",
    "rrf_score",
    "lexical_rank",
    "lexical_score",
    "vector_rank",
    "vector_distance",
)


@query("rrf_fusion", f"SELECT {', '.join(_FUSED)} FROM matches_v")
def rrf_fusion(spark, sf):
    return _fused(spark, sf).select(*_FUSED)


@query(
    "match_origin",
    """
SELECT provider_id, expediente, CASE WHEN lexical_rank IS NOT NULL AND vector_rank IS NOT NULL THEN 'both'
       WHEN lexical_rank IS NOT NULL THEN 'lexical' ELSE 'vector' END AS origin FROM matches_v""",
)
def match_origin(spark, sf):
    return ranking.match_origin(_fused(spark, sf)).select("provider_id", "expediente", "origin")


@query(
    "origin_shares",
    """
SELECT origin, count(*) AS matches, round(count(*) / sum(count(*)) OVER (), 9) AS share
FROM (SELECT CASE WHEN lexical_rank IS NOT NULL AND vector_rank IS NOT NULL THEN 'both'
       WHEN lexical_rank IS NOT NULL THEN 'lexical' ELSE 'vector' END AS origin FROM matches_v) GROUP BY origin""",
)
def origin_shares(spark, sf):
    return ranking.origin_shares(_fused(spark, sf))


@query(
    "match_sorts",
    f"""
SELECT provider_id, expediente, position, days, amount,
       row_number() OVER (PARTITION BY provider_id ORDER BY CASE WHEN days < 0 THEN 1 ELSE 0 END,
                          days ASC NULLS LAST, position) AS deadline_position,
       row_number() OVER (PARTITION BY provider_id ORDER BY coalesce(amount, -1) DESC, position) AS amount_position
FROM (SELECT m.provider_id, m.expediente, m.position,
             CAST(ceil((epoch_us(t.submission_deadline) - epoch_us({AS_OF_SQL})) / 86400000000.0e0) AS BIGINT) AS days,
             CAST(coalesce(t.budget_with_vat, t.estimated_value) AS DOUBLE) AS amount
      FROM matches_v m JOIN tenders_v t ON m.expediente = t.expediente)""",
)
def match_sorts(spark, sf):
    facts = views.tenders(spark, sf).select(
        "expediente",
        display.days_until(F.col("submission_deadline"), views.as_of()).alias("days"),
        display.display_amount().cast("double").alias("amount"),
    )
    listed = _fused(spark, sf).select("provider_id", "expediente", "position").join(facts, "expediente")
    return ranking.match_sorts(listed)


@query(
    "recall_at_k",
    """
SELECT n.provider_id, m.method, n.n_relevant,
       round(count(*) FILTER (WHERE r.rank <= 5 AND r.label = 'relevant') / n.n_relevant, 9) AS recall_5,
       round(count(*) FILTER (WHERE r.rank <= 10 AND r.label = 'relevant') / n.n_relevant, 9) AS recall_10,
       round(count(*) FILTER (WHERE r.rank <= 15 AND r.label = 'relevant') / n.n_relevant, 9) AS recall_15
FROM (SELECT provider_id, count(*) AS n_relevant FROM interests_v WHERE label = 'relevant' GROUP BY 1) n
JOIN (SELECT unnest(['lexical', 'vector']) AS method) m ON true
LEFT JOIN (
  SELECT provider_id, 'vector' AS method, label,
         row_number() OVER (PARTITION BY provider_id ORDER BY s DESC, expediente) AS rank
  FROM (SELECT i.*, round(list_cosine_similarity(CAST(tv.embedding AS DOUBLE[]), CAST(pv.embedding AS DOUBLE[])), 9) AS s
        FROM interests_v i JOIN tender_vectors_v tv ON tv.expediente = i.expediente
        JOIN provider_vectors_v pv ON pv.provider_id = i.provider_id
        WHERE i.label <> 'excluded' AND tv.embedding IS NOT NULL)
  UNION ALL
  SELECT provider_id, 'lexical', label,
         row_number() OVER (PARTITION BY provider_id ORDER BY s DESC, expediente)
  FROM (SELECT i.provider_id, i.expediente, i.label,
               round(sum(list_sum(list_transform(range(1, tt.tf + 1), lambda j: 0.1e0 / (j * j))) / 1.64493406685e0)
                     / max(q.n), 12) AS s
        FROM interests_v i JOIN title_terms_v tt ON tt.expediente = i.expediente
        JOIN query_terms_v qt ON qt.provider_id = i.provider_id AND qt.term = tt.term
        JOIN (SELECT provider_id, count(*) AS n FROM query_terms_v GROUP BY 1) q ON q.provider_id = i.provider_id
        WHERE i.label <> 'excluded' GROUP BY 1, 2, 3)
) r ON r.provider_id = n.provider_id AND r.method = m.method
GROUP BY 1, 2, 3""",
)
def recall_at_k(spark, sf):
    judged = views.interests(spark, sf).filter(F.col("label") != "excluded")
    # Only judged tenders get terms and vectors.
    named = judged.select("expediente").distinct()
    titles = views.tenders(spark, sf).select("expediente", "title").join(named, "expediente", "left_semi")
    t = ranking.with_norms(
        ranking.with_title_terms(titles).join(
            views.tender_vectors(spark, sf), "expediente", "left"
        ),
        DIMENSION,
    )
    p = ranking.with_norms(
        ranking.query_terms(views.providers(spark, sf)).join(
            views.provider_vectors(spark, sf), "provider_id", "left"
        ),
        DIMENSION,
    )
    return evaluation.recall_at_k(judged, t, p, (5, 10, 15))


@query(
    "label_sets",
    """
SELECT count(*) AS population, count(*) FILTER (WHERE r) AS relevant, count(*) FILTER (WHERE n) AS not_relevant,
       count(*) FILTER (WHERE e) AS excluded, count(*) FILTER (WHERE r AND n) AS relevant_and_not_relevant,
       count(*) FILTER (WHERE r AND e) AS relevant_and_excluded, count(*) FILTER (WHERE n AND e) AS not_relevant_and_excluded
FROM (SELECT provider_id, expediente, bool_or(label = 'relevant') AS r, bool_or(label = 'not_relevant') AS n,
             bool_or(label = 'excluded') AS e FROM raw_labels_v GROUP BY 1, 2)""",
)
def label_sets(spark, sf):
    return evaluation.label_sets(views.raw_labels(spark, sf))


@query(
    "unlabelled",
    """
SELECT c.provider_id, c.expediente FROM candidates_v c
WHERE c.published_at <= TIMESTAMP '1998-05-01'
  AND NOT EXISTS (SELECT 1 FROM interests_v i WHERE i.provider_id = c.provider_id AND i.expediente = c.expediente)""",
)
def unlabelled(spark, sf):
    survivors = funnel.candidate_pairs(
        views.tenders(spark, sf), views.providers(spark, sf), views.as_of()
    )
    return evaluation.unlabelled(
        survivors, views.interests(spark, sf), F.col("published_at") <= F.lit("1998-05-01").cast("timestamp")
    )


@query(
    "deadline_buckets",
    f"""
SELECT expediente, days, CASE WHEN days IS NULL THEN 'none' WHEN days < 0 THEN 'closed' WHEN days <= 3 THEN 'critical'
         WHEN days <= 7 THEN 'soon' ELSE 'comfortable' END AS urgency,
       CASE WHEN days IS NULL THEN 'Sin plazo publicado' WHEN days < 0 THEN 'Plazo cerrado' WHEN days = 0 THEN 'Vence hoy'
         WHEN days = 1 THEN 'Queda 1 día' ELSE 'Quedan ' || days || ' días' END AS deadline_text
FROM (SELECT expediente, CAST(ceil((epoch_us(submission_deadline) - epoch_us({AS_OF_SQL})) / 86400000000.0e0) AS BIGINT) AS days
      FROM tenders_v)""",
)
def deadline_buckets(spark, sf):
    return tenders.with_deadline_display(views.tenders(spark, sf), views.as_of()).select(
        "expediente", "days", "urgency", "deadline_text"
    )


@query(
    "status_labels",
    f"""
SELECT t.expediente, {sql_case('t.status', display.TENDER_STATUS_LABELS, 't.status')} AS tender_label,
       {sql_case("coalesce(a.status, 'pending')", display.ANALYSIS_STATUS_LABELS)} AS analysis_label
FROM tenders_v t LEFT JOIN analyses_v a ON t.expediente = a.expediente""",
)
def status_labels(spark, sf):
    joined = (
        views.tenders(spark, sf)
        .select("expediente", "status")
        .join(
            views.analyses(spark, sf).select("expediente", F.col("status").alias("analysis")),
            "expediente",
            "left",
        )
    )
    return joined.select(
        "expediente",
        display.label(F.col("status"), display.TENDER_STATUS_LABELS).alias("tender_label"),
        display.label(
            F.coalesce("analysis", F.lit("pending")), display.ANALYSIS_STATUS_LABELS
        ).alias("analysis_label"),
    )


@query(
    "stale_status_ratio",
    f"""
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'open_for_submission') AS open_status,
       count(*) FILTER (WHERE status = 'open_for_submission' AND submission_deadline < {AS_OF_SQL}) AS open_but_expired,
       count(*) FILTER (WHERE status = 'open_for_submission' AND submission_deadline IS NULL) AS open_no_deadline,
       round(count(*) FILTER (WHERE status = 'open_for_submission' AND submission_deadline < {AS_OF_SQL})
             / nullif(count(*) FILTER (WHERE status = 'open_for_submission'), 0), 9) AS expired_share
FROM tenders_v""",
)
def stale_status_ratio(spark, sf):
    return tenders.status_counts(views.tenders(spark, sf), views.as_of())


@query(
    "format_money",
    """
SELECT expediente,
       replace(format('{:,}', CAST(round_even(amount, 0) AS BIGINT)), ',', '.') || ' €' AS eur,
       CASE WHEN amount IS NULL THEN 'Sin importe publicado'
            WHEN round(amount) < 10000 THEN CAST(CAST(round(amount) AS BIGINT) AS VARCHAR) || chr(160) || '€'
            ELSE replace(format('{:,}', CAST(round(amount) AS BIGINT)), ',', '.') || chr(160) || '€' END AS shown
FROM (SELECT expediente, CAST(coalesce(budget_with_vat, estimated_value) AS DOUBLE) AS amount FROM tenders_v)""",
)
def format_money(spark, sf):
    amount = display.display_amount().cast("double")
    return views.tenders(spark, sf).select(
        "expediente",
        display.format_eur(amount).alias("eur"),
        display.format_amount(amount).alias("shown"),
    )
