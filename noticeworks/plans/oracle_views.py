"""The derived tables of `views.py` stated in SQL, for the result check."""

from __future__ import annotations

from noticeworks.functions import codes, stem
from noticeworks.plans.views import AS_OF, CERT_CASES, SPANISH


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_case(column: str, mapping: dict[str, str], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in mapping.items())
    return f"CASE {column} {arms} ELSE {default} END"


AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
NORM = "trim(split_part({}, '-', 1))"

VIEWS: dict[str, str] = {}

VIEWS["parts_v"] = """
SELECT p_partkey, p_name,
       CASE WHEN p_size % 2 = 0 THEN '72' ELSE '48' END
       || lpad(CAST(p_size AS VARCHAR), 2, '0')
       || lpad(split_part(p_brand, '#', 2), 2, '0') || '00'
       || CASE WHEN p_size % 5 = 0 THEN '-' || CAST(p_size % 10 AS VARCHAR) ELSE '' END AS code
FROM part"""

VIEWS["coded_v"] = """
SELECT o.o_orderkey AS order_key, o.o_custkey AS customer_key,
       CAST(o.o_orderkey AS VARCHAR) AS expediente,
       c.c_name AS contracting_body,
       coalesce(l.title, '') AS title,
       coalesce(l.codes, CAST([] AS VARCHAR[])) AS cpv_codes,
       CASE WHEN o.o_orderkey % 11 <> 0 THEN CAST(o.o_totalprice AS DECIMAL(14,2)) END AS budget_with_vat,
       CASE WHEN o.o_orderkey % 11 <> 0 AND o.o_orderkey % 5 <> 0
            THEN CAST(o.o_totalprice AS DECIMAL(14,2)) - 100 END AS budget_without_vat,
       CASE WHEN o.o_orderkey % 4 <> 0 THEN CAST(o.o_totalprice AS DECIMAL(14,2)) * 2 END AS estimated_value,
       left(o.o_orderpriority, 1) AS priority_code,
       CASE left(o.o_orderpriority, 1) WHEN '4' THEN '40' WHEN '5' THEN '50'
            ELSE left(o.o_orderpriority, 1) END AS type_code,
       CAST(o.o_orderkey % 13 + 1 AS VARCHAR) AS procedure_code,
       CASE o.o_orderstatus WHEN 'O' THEN 'PUB' WHEN 'P' THEN 'EV' ELSE 'RES' END AS status_code,
       CASE WHEN o.o_orderkey % 13 <> 0
            THEN o.o_orderdate + to_days(CAST(o.o_orderkey % 90 AS INT)) END AS submission_deadline,
       n.n_name AS location,
       CASE WHEN o.o_orderkey % 10 <> 3 THEN 'https://example.org/pcap/' || o.o_orderkey END AS pcap_url,
       CASE WHEN o.o_orderkey % 10 <> 4 THEN 'https://example.org/ppt/' || o.o_orderkey END AS ppt_url,
       'https://example.org/notice/' || o.o_orderkey AS platform_url,
       o.o_orderdate AS published_at,
       o.o_orderdate + to_days(CAST(o.o_orderkey % 30 AS INT)) AS updated_at_source
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (
  SELECT l_orderkey,
         array_to_string(list_sort(list(DISTINCT p_name)), ' ') AS title,
         list_sort(list(DISTINCT code)) AS codes
  FROM lineitem JOIN parts_v ON l_partkey = p_partkey
  GROUP BY l_orderkey
) l ON o.o_orderkey = l.l_orderkey"""

VIEWS["tenders_v"] = f"""
SELECT *, {sql_case('type_code', codes.CONTRACT_TYPES)} AS contract_type,
       {sql_case('procedure_code', codes.PROCEDURES)} AS procedure_type,
       {sql_case('status_code', codes.STATUSES)} AS status,
       list_distinct(list_transform(cpv_codes, lambda x: {NORM.format('x')})) AS norm_codes
FROM coded_v"""

VIEWS["tender_vectors_v"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS expediente, embedding
FROM orders LEFT JOIN embeddings
  ON o_orderkey % 7 <> 3 AND o_orderkey % (SELECT count(*) FROM embeddings) = vec_id"""

VIEWS["providers_v"] = f"""
SELECT s.s_suppkey AS supplier_key, CAST(s.s_suppkey AS VARCHAR) AS provider_id,
       coalesce(g.description, '') AS description,
       coalesce(g.codes, CAST([] AS VARCHAR[])) AS cpv_codes,
       CASE WHEN s_suppkey % 3 <> 0 THEN CAST(20000 + 1000 * (s_suppkey % 50) AS DECIMAL(14,2)) END AS min_budget,
       CASE WHEN s_suppkey % 4 <> 0 THEN CAST(250000 AS DECIMAL(14,2)) END AS max_budget,
       CASE WHEN s_suppkey % 5 <> 0 THEN CAST(abs(s_acctbal) * 40 AS DECIMAL(14,2)) END AS annual_revenue,
       CASE s_suppkey % 4 WHEN 1 THEN ['ISO 9001'] WHEN 2 THEN ['ENS', 'ISO 27001']
            WHEN 3 THEN ['ISO/IEC 27001:2013'] END AS certifications,
       CASE WHEN s_suppkey % 2 = 1 THEN
            ['NATION_' || s_nationkey, 'NATION_' || ((s_nationkey + 1) % 25)] END AS locations
FROM supplier s LEFT JOIN (
  SELECT p_partkey % (SELECT count(*) FROM supplier) AS owner,
         array_to_string(list_sort(list(DISTINCT p_name)), ' ') AS description,
         list_sort(list(DISTINCT {NORM.format('code')})) AS codes
  FROM parts_v GROUP BY 1
) g ON s.s_suppkey = g.owner"""

VIEWS["provider_vectors_v"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS provider_id, embedding
FROM supplier LEFT JOIN embeddings ON s_suppkey % (SELECT count(*) FROM embeddings) = vec_id"""

VIEWS["interests_v"] = """
SELECT CAST(l_suppkey AS VARCHAR) AS provider_id, CAST(l_orderkey AS VARCHAR) AS expediente,
       CASE min(l_returnflag) WHEN 'A' THEN 'relevant' WHEN 'R' THEN 'not_relevant' ELSE 'excluded' END AS label
FROM lineitem GROUP BY l_suppkey, l_orderkey"""

VIEWS["raw_labels_v"] = """
SELECT CAST(l_suppkey AS VARCHAR) AS provider_id, CAST(l_orderkey AS VARCHAR) AS expediente,
       CASE l_returnflag WHEN 'A' THEN 'relevant' WHEN 'R' THEN 'not_relevant' ELSE 'excluded' END AS label
FROM lineitem"""

# Hard filters stated pair by pair, with no join on exploded codes.
VIEWS["code_pairs_v"] = f"""
SELECT t.*, p.provider_id, p.min_budget, p.max_budget, p.locations,
       coalesce((p.min_budget IS NULL OR t.budget_with_vat >= p.min_budget)
                AND (p.max_budget IS NULL OR t.budget_with_vat <= p.max_budget), false) AS fits_budget,
       coalesce(p.locations IS NULL OR len(p.locations) = 0
                OR list_contains(p.locations, t.location), false) AS fits_location
FROM tenders_v t JOIN providers_v p ON list_has_any(t.norm_codes, p.cpv_codes)
WHERE t.status = 'open_for_submission' AND t.submission_deadline >= {AS_OF_SQL}"""

VIEWS["candidates_v"] = "SELECT * FROM code_pairs_v WHERE fits_budget AND fits_location"

_VOWEL, _CONSONANT = f"[{stem.VOWELS}]", f"[^{stem.VOWELS}]"


def stem_sql(words: str) -> str:
    """word and stem of the distinct words that a statement selects as `word`: the Snowball rules in SQL."""
    any_of = lambda suffixes: "'(?:" + "|".join(suffixes) + ")$'"
    listed = lambda names: "(" + ", ".join(f"'{name}'" for name in names) + ")"
    after = lambda pattern: (
        f"CASE WHEN regexp_matches(word, '{pattern}') THEN length(regexp_extract(word, '{pattern}')) ELSE length(word) END"
    )
    less = lambda whole, end: f"left({whole}, length({whole}) - length({end}))"

    def cut(whole: str, suffixes) -> str:
        end = f"regexp_extract({whole}, {any_of(suffixes)})"
        return f"CASE WHEN {end} <> '' AND length({less(whole, end)}) >= r2 THEN {less(whole, end)} ELSE {whole} END"

    r1 = f"^{_CONSONANT}*{_VOWEL}+{_CONSONANT}"
    replaced = " ".join(f"WHEN '{old}' THEN base || '{new}'" for old, new in stem.REPLACED.items())
    adverb = cut("base", ("iv", "os", "ic", "ad"))
    return f"""
WITH w0 AS (SELECT DISTINCT word FROM ({words})),
w1 AS (SELECT word, {after(r1)} AS r1, {after(f"{r1}{_CONSONANT}*{_VOWEL}+{_CONSONANT}")} AS r2,
    CASE WHEN length(word) < 2 THEN length(word)
         WHEN NOT regexp_matches(word, '^.{_VOWEL}') THEN {after(f"^..{_CONSONANT}*{_VOWEL}")}
         WHEN regexp_matches(word, '^{_VOWEL}') THEN {after(f"^..{_VOWEL}*{_CONSONANT}")} ELSE least(3, length(word)) END AS rv,
    regexp_extract(word, {any_of(stem.PRONOUNS)}) AS pronoun FROM w0),
w2 AS (SELECT *, {less("word", "pronoun")} AS base FROM w1),
w3 AS (SELECT *, regexp_extract(substr(base, rv + 1), {any_of((*stem.ACCENTED_VERBS, *stem.PLAIN_VERBS, "yendo"))}) AS form FROM w2),
w4 AS (SELECT word, rv, r1, r2, CASE WHEN pronoun = '' OR form = '' THEN word
    WHEN form IN {listed(stem.ACCENTED_VERBS)} THEN {less("base", "form")} || translate(form, 'áéíóú', 'aeiou')
    WHEN form = 'yendo' AND NOT ends_with({less("base", "form")}, 'u') THEN word ELSE base END AS bare FROM w3),
w5 AS (SELECT *, regexp_extract(bare, {any_of(stem.STANDARD)}) AS ending FROM w4),
w6 AS (SELECT *, {less("bare", "ending")} AS base FROM w5),
w7 AS (SELECT *, {adverb} AS adverb FROM w6),
w8 AS (SELECT *, CASE WHEN ending = '' OR length(base) < CASE WHEN ending = 'amente' THEN r1 ELSE r2 END THEN bare
    WHEN ending IN {listed(stem.REPLACED)} THEN CASE ending {replaced} END
    WHEN ending IN {listed(stem.AGENTS)} THEN {cut("base", ("ic",))}
    WHEN ending = 'amente' THEN CASE WHEN adverb <> base AND ends_with(base, 'iv') THEN {cut("adverb", ("at",))} ELSE adverb END
    WHEN ending = 'mente' THEN {cut("base", ("ante", "able", "ible"))}
    WHEN ending IN ('idad', 'idades') THEN {cut("base", ("abil", "ic", "iv"))}
    WHEN ending IN ('iva', 'ivo', 'ivas', 'ivos') THEN {cut("base", ("at",))} ELSE base END AS shorter,
    regexp_extract(substr(bare, rv + 1), {any_of(stem.Y_VERBS)}) AS y_form,
    regexp_extract(substr(bare, rv + 1), {any_of((*stem.VERBS, *stem.VERBS_AFTER_GU))}) AS verb_form FROM w7),
w9 AS (SELECT word, rv, CASE WHEN shorter <> bare THEN shorter
    WHEN y_form <> '' AND ends_with({less("bare", "y_form")}, 'u') THEN {less("bare", "y_form")}
    WHEN verb_form IN {listed(stem.VERBS_AFTER_GU)} AND ends_with({less("bare", "verb_form")}, 'gu')
      THEN left(bare, length(bare) - length(verb_form) - 1)
    ELSE {less("bare", "verb_form")} END AS kept FROM w8),
w10 AS (SELECT *, regexp_extract(substr(kept, rv + 1), {any_of((*stem.RESIDUE, "e", "é"))}) AS ending FROM w9),
w11 AS (SELECT *, {less("kept", "ending")} AS base FROM w10)
SELECT word, translate(CASE WHEN ending IN ('e', 'é') AND ends_with(base, 'gu') AND length(base) - 1 >= rv
    THEN left(base, length(base) - 1) ELSE base END, 'áéíóú', 'aeiou') AS stem FROM w11"""


#: Words of a text column in SQL, without stop words.
def _words_sql(table: str, key: str, column: str) -> str:
    return f"""SELECT {key}, word FROM (SELECT {key}, unnest(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+')) AS word
    FROM {table}) WHERE word NOT IN (SELECT word FROM stop_words_v)"""


# The function words among the texts that the queries make.
VIEWS["stop_words_v"] = "SELECT unnest(['el', 'de', 'la', 'las', 'los', 'y', 'un', 'para', 'con', 'a', 'en']) AS word"


def title_terms_sql(table: str) -> str:
    words = _words_sql(table, "expediente", "title")
    return f"""SELECT expediente, stem AS term, count(*) AS tf
    FROM ({words}) JOIN ({stem_sql(words)}) USING (word) GROUP BY expediente, stem"""


def query_terms_sql(table: str) -> str:
    words = _words_sql(table, "provider_id", "description")
    first = f"SELECT provider_id, stem AS word FROM ({words}) JOIN ({stem_sql(words)}) USING (word) WHERE stem NOT IN (SELECT word FROM stop_words_v)"
    return f"SELECT DISTINCT provider_id, stem AS term FROM ({first}) JOIN ({stem_sql(first)}) USING (word)"


VIEWS["title_terms_v"] = title_terms_sql("tenders_v")

VIEWS["query_terms_v"] = query_terms_sql("providers_v")

# The same texts with inflected Spanish words in them.
VIEWS["spanish_tenders_v"] = f"""
SELECT expediente, title || ' ' || list_extract({SPANISH}, CAST(order_key % {len(SPANISH)} + 1 AS INT)) || ' de la '
       || list_extract({SPANISH}, CAST(order_key * 7 % {len(SPANISH)} + 1 AS INT)) AS title FROM tenders_v"""

VIEWS["spanish_providers_v"] = f"""
SELECT provider_id, description || ' ' || list_extract({SPANISH}, CAST(supplier_key % {len(SPANISH)} + 1 AS INT)) || ' y '
       || list_extract({SPANISH}, CAST(supplier_key * 5 % {len(SPANISH)} + 1 AS INT)) AS description FROM providers_v"""

VIEWS["lexical_v"] = """
SELECT c.provider_id, c.expediente,
       round(sum(list_sum(list_transform(range(1, tt.tf + 1), lambda j: 0.1e0 / (j * j))) / 1.64493406685e0)
             / max(q.n), 12) AS score
FROM candidates_v c
JOIN title_terms_v tt ON c.expediente = tt.expediente
JOIN query_terms_v qt ON qt.provider_id = c.provider_id AND qt.term = tt.term
JOIN (SELECT provider_id, count(*) AS n FROM query_terms_v GROUP BY 1) q ON q.provider_id = c.provider_id
GROUP BY 1, 2"""

VIEWS["vector_v"] = """
SELECT c.provider_id, c.expediente,
       round(1 - list_cosine_similarity(CAST(tv.embedding AS DOUBLE[]), CAST(pv.embedding AS DOUBLE[])), 9) AS distance
FROM candidates_v c
JOIN tender_vectors_v tv ON tv.expediente = c.expediente
JOIN provider_vectors_v pv ON pv.provider_id = c.provider_id
WHERE tv.embedding IS NOT NULL AND pv.embedding IS NOT NULL"""

VIEWS["fused_v"] = """
SELECT provider_id, expediente, l.r AS lexical_rank, l.score AS lexical_score,
       v.r AS vector_rank, v.distance AS vector_distance,
       round(coalesce(1.0e0 / (60 + l.r), 0e0) + coalesce(1.0e0 / (60 + v.r), 0e0), 12) AS rrf_score
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY score DESC, expediente) AS r
                     FROM lexical_v) WHERE r <= 50) l
FULL JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY distance, expediente) AS r
                          FROM vector_v) WHERE r <= 50) v
USING (provider_id, expediente)"""

VIEWS["matches_v"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY rrf_score DESC, expediente) AS position
               FROM fused_v) WHERE position <= 20"""

VIEWS["doc_pages_v"] = """
SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn + 1 AS INT) AS page, text FROM conversations"""

VIEWS["all_pages_v"] = """
SELECT 'c' || doc_id AS doc_id, page, text FROM doc_pages_v
UNION ALL SELECT 'd' || doc_id, 1, text FROM documents"""

VIEWS["clause_pages_v"] = """
SELECT doc_id, page, array_to_string(list_transform(string_split(text, chr(10)),
         lambda x, i: CASE WHEN (i - 1) % 3 = 1
           THEN 'Cláusula ' || i || '.' || page || '.- ' || x ELSE x END), chr(10)) AS text
FROM all_pages_v"""

VIEWS["citations_v"] = """
SELECT doc_id, source_page, line,
       CASE WHEN kind = 3 THEN source_page + 100 ELSE source_page END AS page,
       CASE kind WHEN 1 THEN array_to_string(list_reverse(string_split(q, ' ')), ' ')
                 WHEN 2 THEN q || ' zzzabsent'
                 ELSE array_to_string(string_split(q, ' '), '  ') END AS quote
FROM (SELECT *, (CAST(doc_id AS BIGINT) + source_page + line) % 4 AS kind
      FROM (SELECT doc_id, page AS source_page,
                   unnest(range(0, len(string_split(text, chr(10))))) AS line,
                   unnest(string_split(text, chr(10))) AS q
            FROM doc_pages_v))"""

# White space and word classes, the same as in functions/text.py.
SPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"
UNIT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ ]"


def collapse_sql(column: str) -> str:
    return f"trim(regexp_replace({column}, '{SPACE}+', ' ', 'g'))"


def outcome_sql(page_text: str, quote: str) -> str:
    page, wanted = f"lower({collapse_sql(page_text)})", f"lower({collapse_sql(quote)})"
    return f"""CASE WHEN {page_text} IS NULL THEN 'unverified'
       WHEN contains({page}, {wanted}) THEN 'verified'
       WHEN list_has_all(regexp_extract_all({page}, '{UNIT}'), regexp_extract_all({wanted}, '{UNIT}'))
       THEN 'verified_reordered' ELSE 'unverified' END"""


VIEWS["checked_v"] = f"""
SELECT c.*, {outcome_sql('p.text', 'c.quote')} AS outcome
FROM citations_v c LEFT JOIN doc_pages_v p ON c.doc_id = p.doc_id AND c.page = p.page"""

VIEWS["page_citations_v"] = """
SELECT doc_id || '-' || page AS analysis_id, doc_id, text AS own_text, f.field, f.page, f.quote
FROM (SELECT doc_id, page, text, unnest([
  {'field': 'economic_solvency', 'page': page, 'quote': text},
  {'field': 'technical_solvency', 'page': page, 'quote': array_to_string(list_reverse(string_split(text, ' ')), ' ')},
  {'field': 'award_criteria', 'page': page, 'quote': text || ' zzzabsent'},
  {'field': 'guarantees', 'page': page + 1, 'quote': text},
  {'field': 'execution_deadline', 'page': NULL, 'quote': NULL},
  {'field': 'submission_deadline', 'page': page + 100, 'quote': text},
  {'field': 'subcontracting', 'page': page, 'quote': translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')},
  {'field': 'lots', 'page': page, 'quote': array_to_string(string_split(text, ' '), '  ')},
  {'field': 'certifications[ISO 9001]', 'page': page, 'quote': text},
  {'field': 'certifications[ENS]', 'page': page + 1, 'quote': text}]) AS f FROM doc_pages_v)"""

VIEWS["cert_names_v"] = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS expediente,
       names[CAST(o_orderkey % {len(CERT_CASES)} + 1 AS INT)]
       || CASE WHEN o_orderkey % 2 = 0 THEN
            CASE WHEN o_orderkey % 3 = 0 THEN ' y ' ELSE ', ' END
            || names[CAST((o_orderkey // {len(CERT_CASES)}) % {len(CERT_CASES)} + 1 AS INT)] ELSE '' END AS name
FROM orders, (SELECT [{', '.join(sql_text(n) for n in CERT_CASES)}] AS names)"""

# Flat form of the extraction built by `views.extraction_columns`.
VIEWS["analyses_v"] = """
SELECT o_orderkey AS order_key, CAST(o_orderkey AS VARCHAR) AS expediente,
       CASE WHEN o_orderkey % 9 <> 0 THEN sha256(CAST(o_custkey AS VARCHAR)) END AS pdf_hash,
       CASE o_orderkey % 7 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'failed' WHEN 2 THEN 'not_analyzable'
            WHEN 3 THEN 'pending' ELSE 'completed' END AS status,
       (o_orderkey % 7 >= 4 AND o_orderkey % 11 <> 4) AS has_extraction,
       CASE WHEN o_orderkey % 7 >= 4 THEN (o_orderkey % 10) / 10.0e0 END AS citation_faithfulness,
       CASE o_orderkey % 7 WHEN 1 THEN 'run stopped' WHEN 2 THEN 'no text layer' END AS error_message,
       o_orderdate AS created_at, o_orderdate + to_seconds(CAST(o_orderkey % 1800 AS INT)) AS updated_at,
       o_orderpriority AS quote, o_orderkey % 4 + 1 AS cite_page,
       CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS turnover,
       CASE WHEN o_orderkey % 3 <> 0 THEN 'Volumen anual' ELSE '' END AS economic_description,
       CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice / 2 END AS amount,
       CASE WHEN o_orderkey % 2 <> 0 THEN 'Trabajos similares' ELSE '' END AS technical_description,
       CASE WHEN o_orderkey % 3 = 0 THEN 60.5e0 ELSE 100.0e0 END AS total_points,
       CASE WHEN o_orderkey % 8 >= 2 THEN CAST(30 + o_orderkey % 30 AS DOUBLE) END AS price_points,
       o_orderkey % 2 = 0 AS provisional_required,
       CASE WHEN o_orderkey % 4 <> 1 THEN 5.0e0 END AS definitive_percentage,
       CASE WHEN o_orderkey % 3 <> 0 THEN 'Definitiva del 5 %' ELSE '' END AS guarantee_description,
       CASE WHEN o_orderkey % 5 <> 2 THEN 'Doce meses.' ELSE '' END AS execution_description,
       CASE o_orderkey % 3 WHEN 1 THEN true WHEN 2 THEN false END AS extensions_allowed,
       CASE WHEN o_orderkey % 2 <> 0 THEN 'hasta 12 meses más.' END AS extensions_description,
       CASE o_orderkey % 3 WHEN 1 THEN true WHEN 2 THEN false END AS subcontracting_allowed,
       o_orderkey % 2 = 1 AS divided_into_lots,
       CASE WHEN o_orderkey % 3 <> 1 THEN 'Dos lotes.' ELSE '' END AS lots_description
FROM orders WHERE o_orderstatus IN ('O', 'F')"""

VIEWS["calls_v"] = """
SELECT CAST(event_id // 3 AS VARCHAR) AS trace_id,
       CASE WHEN event_type <> 'error' THEN CAST(floor(value * 100) AS BIGINT) END AS input_tokens,
       CASE WHEN event_type <> 'error' THEN CAST(floor(value * 10) AS BIGINT) END AS output_tokens,
       CASE WHEN event_type <> 'error' THEN CAST(floor(value * 100) AS BIGINT) + CAST(floor(value * 10) AS BIGINT) END AS total_tokens,
       CASE WHEN event_id % 4 <> 0 THEN value / 1000 END AS cost_eur
FROM events"""

VIEWS["spans_v"] = """
SELECT CAST(event_id // 3 AS VARCHAR) AS trace_id, event_id AS span_seq, value AS latency_s
FROM events WHERE event_type IN ('view', 'purchase')"""

VIEWS["traces_v"] = """
SELECT c.trace_id, sum(coalesce(input_tokens, 0)) AS input_tokens, sum(coalesce(output_tokens, 0)) AS output_tokens,
       sum(coalesce(total_tokens, 0)) AS total_tokens, sum(coalesce(cost_eur, 0)) AS cost_eur,
       coalesce(max(s.latency_s), 0) AS latency_s, count(*) AS attempts
FROM calls_v c LEFT JOIN (SELECT trace_id, arg_max(latency_s, span_seq) AS latency_s FROM spans_v GROUP BY 1) s
  ON c.trace_id = s.trace_id
GROUP BY c.trace_id"""


def with_views(body: str) -> str:
    """The query with a WITH list of every derived table it uses, in dependency order."""
    import re

    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\b([a-z_]+_v)\b", sql):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed)
    return f"WITH {ctes}\n{body.strip()}"
