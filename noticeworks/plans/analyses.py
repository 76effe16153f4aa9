"""Registered queries over extractions: certifications, verdicts, scores, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeworks.functions import certs, display
from noticeworks.operators import costs, evaluation, verdicts
from noticeworks.plans import views
from noticeworks.plans.oracle_views import AS_OF_SQL, sql_case
from noticeworks.plans.registry import query, stamp
from noticeworks.session import shared_dir
from noticeworks.streaming import stale

_FOLD_SQL = "lower(strip_accents({}))"
_WORDS_SQL = "regexp_extract_all(lower(strip_accents({})), '[a-z0-9]+')"
_FORMAL_SQL = "(?i)" + certs.FORMAL
_TOKENS_SQL = f"list_distinct({_WORDS_SQL})"
_IDENTITY_SQL = f"""CASE WHEN len(regexp_extract_all(name, '{_FORMAL_SQL}')) = 0
  THEN [array_to_string({_WORDS_SQL.format('name')}, ' ')]
  ELSE list_distinct(list_transform(regexp_extract_all(name, '{_FORMAL_SQL}'),
    lambda m: coalesce(nullif(regexp_extract(m, '\\d{{4,5}}'), ''), array_to_string({_WORDS_SQL.format('m')}, ' ')))) END"""


@query(
    "cert_formal",
    f"SELECT expediente, name, regexp_matches(name, '{_FORMAL_SQL}') AS formal FROM cert_names_v",
)
def cert_formal(spark, sf):
    names = views.cert_names(spark, sf)
    return names.withColumn("formal", certs.is_formal(F.col("name")))


@query(
    "cert_tokens",
    f"""
SELECT expediente, array_to_string(list_sort({_TOKENS_SQL.format('name')}), ' ') AS tokens,
       array_to_string({_WORDS_SQL.format('name')}, ' ') AS normalized FROM cert_names_v""",
)
def cert_tokens(spark, sf):
    name = F.col("name")
    return views.cert_names(spark, sf).select(
        "expediente",
        F.array_join(F.sort_array(certs.tokens(name)), " ").alias("tokens"),
        certs.normalized_name(name).alias("normalized"),
    )


@query(
    "cert_identities",
    f"SELECT expediente, array_to_string(list_sort({_IDENTITY_SQL}), ',') AS identities FROM cert_names_v",
)
def cert_identities(spark, sf):
    found = F.sort_array(certs.identities(F.col("name")))
    return views.cert_names(spark, sf).select(
        "expediente", F.array_join(found, ",").alias("identities")
    )


@query(
    "cert_match",
    f"""
SELECT i.provider_id, i.expediente,
       coalesce(len(list_filter(p.certifications, lambda h:
         list_has_all({_TOKENS_SQL.format('h')}, {_TOKENS_SQL.format('n.name')})
         OR list_has_all({_TOKENS_SQL.format('n.name')}, {_TOKENS_SQL.format('h')}))) > 0, false) AS satisfied
FROM interests_v i JOIN cert_names_v n ON n.expediente = i.expediente
JOIN providers_v p ON p.provider_id = i.provider_id""",
)
def cert_match(spark, sf):
    required = views.cert_names(spark, sf).select(
        "expediente", certs.tokens(F.col("name")).alias("required")
    )
    held = views.providers(spark, sf).select(
        "provider_id", F.transform("certifications", certs.tokens).alias("held")
    )
    return (
        views.interests(spark, sf)
        .join(required, "expediente")
        .join(held, "provider_id")
        .select(
            "provider_id",
            "expediente",
            certs.satisfied(F.col("required"), F.col("held")).alias("satisfied"),
        )
    )


def _eur_sql(column: str) -> str:
    return f"replace(format('{{:,}}', CAST(round_even({column}, 0) AS BIGINT)), ',', '.') || ' €'"


def _cite_sql(block: int) -> str:
    return f"CASE WHEN (order_key + {block}) % 5 <> 1 THEN cite_page END"


_REASONS_SQL = f"""
SELECT i.provider_id, a.expediente,
  list_filter([
    CASE WHEN a.turnover IS NOT NULL AND p.annual_revenue IS NULL THEN
      'El pliego exige una facturación anual mínima de ' || {_eur_sql('a.turnover')}
      || ', pero tu perfil no declara facturación anual -- no se puede verificar.' END,
    CASE WHEN a.amount IS NOT NULL THEN
      'El pliego exige un importe acumulado de trabajos similares de ' || {_eur_sql('a.amount')}
      || ', pero tu perfil no registra importe de trabajos previos -- no se puede verificar.' END,
    CASE WHEN a.order_key % 6 = 1 THEN
      'El pliego pide ''Responsable técnico'' entre los requisitos, pero no es una certificación que tu perfil pueda declarar -- compruébalo a mano en la cláusula citada.' END
  ], lambda x: x IS NOT NULL) AS reserved,
  list_filter([
    CASE WHEN CAST(p.annual_revenue AS DOUBLE) < a.turnover THEN
      'Exigen una facturación anual mínima de ' || {_eur_sql('a.turnover')} || ' y tu perfil declara '
      || {_eur_sql('CAST(p.annual_revenue AS DOUBLE)')} || '.' END,
    CASE WHEN a.order_key % 6 = 0 AND p.supplier_key % 4 NOT IN (2, 3) THEN
      'Exigen la certificación ''ISO 27001'' y tu perfil no la declara.' END,
    CASE WHEN a.order_key % 6 = 3 AND p.supplier_key % 4 <> 2 THEN
      'Exigen la certificación ''ENS categoría media'' y tu perfil no la declara.' END
  ], lambda x: x IS NOT NULL) AS blocking,
  list_filter([CASE WHEN a.turnover IS NOT NULL AND p.annual_revenue IS NULL THEN coalesce({_cite_sql(0)}, 0) END,
    CASE WHEN a.amount IS NOT NULL THEN coalesce({_cite_sql(1)}, 0) END,
    CASE WHEN a.order_key % 6 = 1 THEN coalesce({_cite_sql(8)}, 0) END], lambda x: x IS NOT NULL) AS reserved_pages,
  list_filter([CASE WHEN CAST(p.annual_revenue AS DOUBLE) < a.turnover THEN coalesce({_cite_sql(0)}, 0) END,
    CASE WHEN a.order_key % 6 = 0 AND p.supplier_key % 4 NOT IN (2, 3) THEN coalesce({_cite_sql(8)}, 0) END,
    CASE WHEN a.order_key % 6 = 3 AND p.supplier_key % 4 <> 2 THEN coalesce({_cite_sql(8)}, 0) END], lambda x: x IS NOT NULL) AS blocking_pages
FROM interests_v i JOIN analyses_v a ON a.expediente = i.expediente
JOIN providers_v p ON p.provider_id = i.provider_id
WHERE a.has_extraction"""


@query(
    "verdicts",
    f"""
SELECT provider_id, expediente,
       CASE WHEN len(blocking) > 0 THEN 'no_apto' WHEN len(reserved) > 0 THEN 'apto_con_reservas' ELSE 'apto' END AS verdict,
       array_to_string(list_concat(blocking, reserved), ' | ') AS reasons,
       array_to_string(list_concat(blocking_pages, reserved_pages), ',') AS pages
FROM ({_REASONS_SQL})""",
)
def verdict_rows(spark, sf):
    judged = verdicts.verdicts(
        views.analyses(spark, sf), views.interests(spark, sf), views.providers(spark, sf)
    )
    pages = F.transform("reasons", lambda r: F.coalesce(r["citation"]["page"], F.lit(0)).cast("string"))
    return judged.select(
        "provider_id",
        "expediente",
        "verdict",
        F.array_join(F.transform("reasons", lambda r: r["detail"]), " | ").alias("reasons"),
        F.array_join(pages, ",").alias("pages"),
    )


@query(
    "verdict_labels",
    f"""
SELECT verdict, {sql_case('verdict', display.VERDICT_LABELS)} AS label,
       {sql_case('verdict', display.VERDICT_SUMMARIES)} AS summary, count(*) AS pairs
FROM (SELECT CASE WHEN len(blocking) > 0 THEN 'no_apto' WHEN len(reserved) > 0 THEN 'apto_con_reservas' ELSE 'apto' END AS verdict
      FROM ({_REASONS_SQL})) GROUP BY verdict""",
)
def verdict_labels(spark, sf):
    judged = verdicts.verdicts(
        views.analyses(spark, sf), views.interests(spark, sf), views.providers(spark, sf)
    )
    counted = judged.groupBy("verdict").agg(F.count("*").alias("pairs"))
    return counted.select(
        "verdict",
        display.label(F.col("verdict"), display.VERDICT_LABELS).alias("label"),
        display.label(F.col("verdict"), display.VERDICT_SUMMARIES).alias("summary"),
        "pairs",
    )


@query(
    "analysis_status",
    f"""
SELECT t.expediente, coalesce(a.st, 'pending') AS status, coalesce(a.has_extraction, false) AS has_extraction,
       a.citation_faithfulness, coalesce(a.st = 'completed' AND a.has_extraction, false) AS shows_verdict
FROM tenders_v t LEFT JOIN (SELECT *, CASE WHEN status = 'in_progress' AND updated_at < {AS_OF_SQL} - INTERVAL 900 SECOND
       THEN 'failed' ELSE status END AS st FROM analyses_v) a ON t.expediente = a.expediente""",
)
def analysis_status(spark, sf):
    return verdicts.analysis_status(
        views.tenders(spark, sf), views.analyses(spark, sf), views.as_of()
    )


@query(
    "settled_analyses",
    f"""
SELECT i.provider_id, i.expediente, CASE WHEN a.expediente IS NULL THEN 'pending'
         WHEN a.status = 'in_progress' AND a.updated_at < {AS_OF_SQL} - INTERVAL 900 SECOND THEN 'failed' ELSE a.status END AS status,
       coalesce(a.has_extraction, false) AS has_extraction, a.citation_faithfulness, a.error_message,
       CASE WHEN v.expediente IS NULL THEN NULL WHEN len(blocking) > 0 THEN 'no_apto'
            WHEN len(reserved) > 0 THEN 'apto_con_reservas' ELSE 'apto' END AS verdict,
       CASE WHEN v.expediente IS NOT NULL THEN array_to_string(list_concat(blocking, reserved), ' | ') END AS reasons
FROM interests_v i LEFT JOIN analyses_v a ON a.expediente = i.expediente
LEFT JOIN ({_REASONS_SQL}) v ON v.expediente = i.expediente AND v.provider_id = i.provider_id""",
)
def settled_analyses(spark, sf):
    seen = verdicts.settled_analyses(
        views.interests(spark, sf), views.analyses(spark, sf), views.providers(spark, sf), views.as_of()
    )
    return seen.select(
        "provider_id",
        "expediente",
        "status",
        F.col("extraction").isNotNull().alias("has_extraction"),
        "citation_faithfulness",
        "error_message",
        "verdict",
        F.array_join(F.transform("reasons", lambda r: r["detail"]), " | ").alias("reasons"),
    )


@query(
    "analysis_by_key",
    """
SELECT expediente, status, has_extraction, error_message FROM analyses_v
WHERE expediente = (SELECT min(expediente) FROM analyses_v)""",
)
def analysis_by_key(spark, sf):
    everything = views.analyses(spark, sf)
    found = everything.filter(F.col("expediente") == everything.agg(F.min("expediente")).scalar())
    return found.select(
        "expediente", "status", F.col("extraction").isNotNull().alias("has_extraction"), "error_message"
    )


@query(
    "stale_runs",
    f"""
SELECT expediente, updated_at < {AS_OF_SQL} - INTERVAL 900 SECOND AS stale FROM analyses_v WHERE status = 'in_progress'""",
)
def stale_runs(spark, sf):
    running = views.analyses(spark, sf).filter(F.col("status") == "in_progress")
    stale = verdicts.is_stale(F.col("status"), F.col("updated_at"), views.as_of())
    return running.select("expediente", stale.alias("stale"))


@query(
    "stale_run_stream",
    f"""
SELECT expediente, 'failed' AS status, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at
FROM analyses_v, (SELECT greatest(max(updated_at), {AS_OF_SQL}) AS seen FROM analyses_v)
WHERE status = 'in_progress' AND updated_at < seen - INTERVAL 900 SECOND""",
)
def stale_run_stream(spark, sf):
    """The same rule over a stream: updates of all runs, a restart, then an update that moves the time on."""
    root = shared_dir(spark, "stale")
    updates = views.analyses(spark, sf).where("updated_at is not null").select("expediente", "status", "updated_at")
    # A run that ended began a minute before: no update lies beyond the newest time of the analyses.
    running, ended = updates.where("status = 'in_progress'"), updates.where("status <> 'in_progress'")
    earlier = F.timestamp_add("SECOND", F.lit(-60), "updated_at")
    begun = running.unionByName(ended.withColumns({"status": F.lit("in_progress"), "updated_at": earlier}))
    seen = F.greatest(F.max("updated_at"), views.as_of()).alias("updated_at")
    moved = updates.agg(seen).select(F.lit("tick").alias("expediente"), F.lit("completed").alias("status"), "updated_at")
    for landed in (begun.unionByName(ended), moved):
        landed.write.mode("append").parquet(f"{root}/updates")
        stale.start_stale(spark, f"{root}/updates", f"{root}/failed", f"{root}/checkpoint").awaitTermination()
    failed = spark.read.schema(stale.UPDATES).parquet(f"{root}/failed")
    return failed.select("expediente", "status", stamp("updated_at"))


@query(
    "completed_analyses",
    """
SELECT a.expediente, t.title, t.pcap_url, strftime(a.updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at
FROM analyses_v a JOIN tenders_v t ON a.expediente = t.expediente
WHERE a.has_extraction ORDER BY a.updated_at DESC, a.expediente LIMIT 100""",
)
def completed_analyses(spark, sf):
    latest = verdicts.completed_analyses(
        views.analyses(spark, sf), views.tenders(spark, sf), limit=100
    )
    return latest.select("expediente", "title", "pcap_url", stamp("updated_at"))


def _shown_sql(column: str) -> str:
    return f"""CASE WHEN round({column}) < 10000 THEN CAST(CAST(round({column}) AS BIGINT) AS VARCHAR)
      ELSE replace(format('{{:,}}', CAST(round({column}) AS BIGINT)), ',', '.') END || chr(160) || '€'"""


_CERT_ROWS_SQL = """CASE order_key % 6
  WHEN 0 THEN ['ISO 27001 · Exigida para licitar'] WHEN 1 THEN ['Responsable técnico · Exigida para licitar']
  WHEN 2 THEN ['ISO 9001 · Solo puntúa'] WHEN 3 THEN ['ENS categoría media · Exigida para licitar', 'DEUC · Papeleo de licitación']
  ELSE ['El pliego no menciona ninguna.'] END"""
_ROWS_SQL = f"""
SELECT expediente, unnest(list_concat(
  [{{'label': 'Solvencia económica', 'value': CASE WHEN turnover IS NOT NULL THEN 'Cifra de negocio mínima: ' || {_shown_sql('turnover')}
      ELSE coalesce(nullif(economic_description, ''), 'No se exige una cifra concreta.') END, 'page': {_cite_sql(0)}}},
   {{'label': 'Solvencia técnica', 'value': CASE WHEN amount IS NOT NULL THEN 'Importe mínimo en trabajos similares: ' || {_shown_sql('amount')}
      ELSE coalesce(nullif(technical_description, ''), 'No se exige un importe concreto.') END, 'page': {_cite_sql(1)}}}],
  list_transform({_CERT_ROWS_SQL}, lambda x, i: {{'label': 'Certificaciones', 'value': x,
      'page': CASE WHEN order_key % 6 < 4 AND (order_key + 7 + i) % 5 <> 1 THEN cite_page END}}),
  [{{'label': 'Criterios de adjudicación', 'value': CASE WHEN order_key % 3 = 0 THEN '60.5' ELSE '100' END || ' puntos en total'
      || CASE WHEN price_points IS NOT NULL THEN ', ' || CAST(price_points AS BIGINT) || ' al precio' ELSE '' END || '.', 'page': {_cite_sql(2)}}},
   {{'label': 'Garantías', 'value': coalesce(nullif(guarantee_description, ''), CASE WHEN provisional_required
      THEN 'Se exige garantía provisional.' ELSE 'Sin garantía provisional.' END), 'page': {_cite_sql(3)}}},
   {{'label': 'Plazo de ejecución', 'value': coalesce(nullif(execution_description, ''), 'No indicado.')
      || CASE WHEN extensions_allowed THEN ' Prórrogas: ' || coalesce(extensions_description, 'previstas en el pliego.')
              WHEN NOT extensions_allowed THEN ' Sin prórrogas.' ELSE ' El pliego no dice nada sobre prórrogas.' END, 'page': {_cite_sql(4)}}},
   {{'label': 'Lotes', 'value': CASE WHEN divided_into_lots THEN coalesce(nullif(lots_description, ''), 'Dividido en lotes.')
      ELSE 'No está dividido en lotes.' END, 'page': {_cite_sql(7)}}}])) AS r,
  unnest(range(0, 6 + len({_CERT_ROWS_SQL}))) AS position
FROM analyses_v WHERE has_extraction"""


@query(
    "extraction_rows",
    f"SELECT expediente, position, r.label AS label, r.value AS value, r.page AS page FROM ({_ROWS_SQL})",
)
def extraction_rows(spark, sf):
    rows = verdicts.extraction_rows(views.analyses(spark, sf))
    return rows.select("expediente", "position", "label", "value", F.col("citation.page").alias("page"))


@query(
    "price_points",
    "SELECT expediente, price_points FROM analyses_v WHERE has_extraction",
)
def price_points(spark, sf):
    done = views.analyses(spark, sf).filter(F.col("extraction").isNotNull())
    return done.select("expediente", evaluation.price_points("extraction").alias("price_points"))


def _produced(spark, sf):
    """Two models' versions of every annotated extraction; the second fails on low priority."""
    key = F.col("order_key")
    e = F.col("extraction")
    done = views.analyses(spark, sf).filter(e.isNotNull())
    shifted = lambda by: e.withField(
        "economic_solvency.minimum_annual_turnover_eur",
        F.col("extraction.economic_solvency.minimum_annual_turnover_eur") + by,
    )
    first = shifted((key % 3) * 0.6).withField(
        "award_criteria.total_points", e["award_criteria"]["total_points"] + (key % 2) * 0.5
    )
    second = (
        shifted((key % 2) * 5.0)
        .withField(
            "certifications",
            F.when(key % 4 == 0, F.slice(F.col("extraction.certifications"), 1, 0)).otherwise(
                F.col("extraction.certifications")
            ),
        )
        .withField(
            "subcontracting.allowed",
            F.when(key % 5 != 0, F.col("extraction.subcontracting.allowed")),
        )
    )
    failed = F.col("extraction.submission_deadline.citation.quote").startswith("5")
    runs = F.array(
        F.struct(F.lit("first").alias("model"), first.alias("extraction")),
        F.struct(
            F.lit("second").alias("model"),
            F.when(~F.coalesce(failed, F.lit(False)), second).alias("extraction"),
        ),
    )
    return done.select(
        "expediente",
        F.col("citation_faithfulness").alias("faithfulness"),
        (F.col("order_key") % 100 / 1000.0).alias("cost_eur"),
        F.inline(runs),
    )


_IDENTITIES_SQL = """CASE order_key % 6 WHEN 0 THEN '27001' WHEN 1 THEN 'responsable tecnico' WHEN 3 THEN 'ens' ELSE '' END"""
_PRODUCED_SQL = f"""
SELECT a.*, m.model, {_IDENTITIES_SQL} AS names,
  CASE WHEN m.model = 'first' THEN turnover + (order_key % 3) * 0.6e0 ELSE turnover + (order_key % 2) * 5.0e0 END AS got_turnover,
  CASE WHEN m.model = 'first' THEN total_points + (order_key % 2) * 0.5e0 ELSE total_points END AS got_total,
  CASE WHEN m.model = 'second' AND order_key % 4 = 0 THEN '' ELSE {_IDENTITIES_SQL} END AS got_names,
  CASE WHEN m.model = 'second' AND order_key % 5 = 0 THEN NULL ELSE subcontracting_allowed END AS got_allowed,
  NOT (m.model = 'second' AND (order_key + 5) % 5 <> 1 AND starts_with(quote, '5')) AS produced,
  (order_key % 100) / 1000.0e0 AS cost_eur
FROM analyses_v a JOIN (SELECT unnest(['first', 'second']) AS model) m ON true WHERE a.has_extraction"""


def _number_sql(name: str, want: str, got: str, tolerance: str) -> str:
    return f"""{{'field': '{name}', 'correct': ({want} IS NULL AND {got} IS NULL) OR coalesce(abs({want} - {got}) <= {tolerance}, false),
     'expected': CAST({want} AS VARCHAR), 'got': CAST({got} AS VARCHAR)}}"""


def _flag_sql(name: str, want: str, got: str) -> str:
    return f"""{{'field': '{name}', 'correct': {want} IS NOT DISTINCT FROM {got},
     'expected': CAST({want} AS VARCHAR), 'got': CAST({got} AS VARCHAR)}}"""


_CHECKS_SQL = ", ".join(
    [
        _number_sql("economic_solvency.minimum_annual_turnover_eur", "turnover", "got_turnover", "1.0e0"),
        _number_sql("technical_solvency.minimum_amount_eur", "amount", "amount", "1.0e0"),
        _flag_sql("certifications", "names", "got_names"),
        _flag_sql("execution_deadline.extensions_allowed", "extensions_allowed", "extensions_allowed"),
        _number_sql("award_criteria.total_points", "total_points", "got_total", "0.5e0"),
        _number_sql("award_criteria.price_points", "price_points", "price_points", "0.5e0"),
        _flag_sql("guarantees.provisional_required", "provisional_required", "provisional_required"),
        _number_sql("guarantees.definitive_percentage", "definitive_percentage", "definitive_percentage", "0.5e0"),
        _flag_sql("subcontracting.allowed", "subcontracting_allowed", "got_allowed"),
        _flag_sql("lots.divided_into_lots", "divided_into_lots", "divided_into_lots"),
    ]
)
_SCORES_SQL = f"""
SELECT expediente, model, c.field AS field, c.correct AS correct, c.expected AS expected, c.got AS got
FROM (SELECT expediente, model, unnest([{_CHECKS_SQL}]) AS c FROM ({_PRODUCED_SQL}) WHERE produced)"""


def _scores(spark, sf):
    expected = views.analyses(spark, sf).filter(F.col("extraction").isNotNull())
    return evaluation.score_fields(expected, _produced(spark, sf))


@query("score_fields", _SCORES_SQL)
def score_fields(spark, sf):
    return _scores(spark, sf)


@query(
    "score_totals",
    f"""
SELECT expediente, model, count(*) FILTER (WHERE correct) AS correct, count(*) AS checks
FROM ({_SCORES_SQL}) GROUP BY expediente, model""",
)
def score_totals(spark, sf):
    return evaluation.score_totals(_scores(spark, sf))


@query(
    "score_by_model",
    f"""
SELECT r.model, r.documents, r.completed, f.correct, f.checks, round(f.correct / f.checks, 9) AS correctness,
       r.mean_faithfulness, r.cost_eur
FROM (SELECT model, count(*) AS documents, count(*) FILTER (WHERE produced) AS completed,
             round(avg(citation_faithfulness) FILTER (WHERE produced), 8) AS mean_faithfulness,
             round(sum(cost_eur) FILTER (WHERE produced), 4) AS cost_eur FROM ({_PRODUCED_SQL}) GROUP BY model) r
JOIN (SELECT model, count(*) FILTER (WHERE correct) AS correct, count(*) AS checks FROM ({_SCORES_SQL}) GROUP BY model) f
  ON r.model = f.model""",
)
def score_by_model(spark, sf):
    return evaluation.score_by_model(_produced(spark, sf), _scores(spark, sf))


@query(
    "cost_report",
    """
SELECT trace_id, input_tokens, output_tokens, total_tokens, round(cost_eur, 9) AS cost_eur, latency_s, attempts,
       total_tokens > 0 AS produced_usage FROM traces_v""",
)
def cost_report(spark, sf):
    report = costs.cost_report(views.trace_calls(spark, sf), views.trace_spans(spark, sf))
    return report.withColumn("cost_eur", F.round("cost_eur", 9)).withColumn(
        "produced_usage", F.col("total_tokens") > 0
    )


_USED = "FILTER (WHERE total_tokens > 0)"


@query(
    "cost_summary",
    f"""
SELECT count(*) {_USED} AS measured, count(*) FILTER (WHERE total_tokens <= 0) AS excluded,
       round(avg(input_tokens) {_USED}, 6) AS mean_input_tokens, round(avg(output_tokens) {_USED}, 6) AS mean_output_tokens,
       round(avg(total_tokens) {_USED}, 6) AS mean_total_tokens, round(avg(cost_eur) {_USED}, 6) AS mean_cost_eur,
       round(avg(latency_s) {_USED}, 6) AS mean_latency_s,
       CAST(min(total_tokens) {_USED} AS DOUBLE) AS min_total_tokens, min(latency_s) {_USED} AS min_latency_s,
       CAST(max(total_tokens) {_USED} AS DOUBLE) AS max_total_tokens, max(latency_s) {_USED} AS max_latency_s
FROM traces_v""",
)
def cost_summary(spark, sf):
    report = costs.cost_report(views.trace_calls(spark, sf), views.trace_spans(spark, sf))
    return costs.cost_summary(report)
