"""Single rules on literal inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeworks import schemas
import plain_stem
from noticeworks.functions import certs, codes, dates, display, ranking, stem, text
from noticeworks.operators import citations, costs, documents, evaluation, freetext, verdicts
from noticeworks.operators import ranking as operator_ranking


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "day, months",
    [
        ("2026-08-17", ["202606", "202607", "202608"]),
        ("2026-01-15", ["202511", "202512", "202601"]),
    ],
)
def test_recent_months(spark, day, months):
    found = dates.recent_months(F.lit(day).cast("date"), 3)
    assert value(spark, F.transform(found, dates.month_label)) == months


@pytest.mark.parametrize(
    "expected, got, same",
    [(100.0, 100.4, True), (100.0, 100.6, False), (None, None, True), (1.0, None, False)],
)
def test_tolerance(spark, expected, got, same):
    lit = lambda v: F.lit(v).cast("double")
    assert value(spark, evaluation.nums_match(lit(expected), lit(got), 0.5)) is same


PAGE = "Garantía provisional: ☐Sí\nGarantía complementaria: ☒Sí ☐No\nPlazo de   ejecución"


@pytest.mark.parametrize(
    "page, quote, outcome",
    [
        (1, "garantía provisional: ☐Sí", "verified"),
        (1, "plazo de ejecución", "verified"),
        (1, "Garantía complementaria: ☐No ☒Sí", "verified_reordered"),
        (1, "3 meses", "unverified"),
        (1, "", "verified"),
        (2, "plazo", "unverified"),
        (0, "plazo", "unverified"),
    ],
)
def test_citation_outcomes(spark, page, quote, outcome):
    pages = spark.createDataFrame([("d", 1, PAGE)], "doc_id string, page int, text string")
    cited = spark.createDataFrame([("d", page, quote)], "doc_id string, page int, quote string")
    assert citations.check_citations(cited, pages).first()["outcome"] == outcome


@pytest.mark.parametrize(
    "cited, window", [(5, [4, 5, 6]), (1, [1, 2]), (10, [9, 10]), (0, []), (11, [])]
)
def test_context_window(spark, cited, window):
    rows = [("d", n, f"texto de la página {n}") for n in range(1, 11)]
    pages = spark.createDataFrame(rows, "doc_id string, page int, text string")
    wanted = spark.createDataFrame([(1, "d", cited)], "id int, doc_id string, page int")
    found = freetext.context_window(wanted, pages, ["id"]).first()["contexts"]
    assert found == [f"texto de la página {n}" for n in window]


def test_retries_fold_into_one_trace(spark):
    calls = spark.createDataFrame(
        [("t", 20000, 10000, 30000, 0.002), ("t", 20000, 10000, 30000, 0.003), ("u", None, None, None, None)],
        "trace_id string, input_tokens long, output_tokens long, total_tokens long, cost_eur double",
    )
    spans = spark.createDataFrame(
        [("t", 1, 10.0), ("t", 2, 280.0)], "trace_id string, span_seq long, latency_s double"
    )
    rows = {r["trace_id"]: r for r in costs.cost_report(calls, spans).collect()}
    assert (rows["t"]["total_tokens"], rows["t"]["latency_s"], rows["t"]["attempts"]) == (60000, 280.0, 2)
    assert rows["t"]["cost_eur"] == pytest.approx(0.005)
    assert (rows["u"]["total_tokens"], rows["u"]["latency_s"]) == (0, 0.0)
    summary = costs.cost_summary(costs.cost_report(calls, spans)).first()
    assert (summary["measured"], summary["excluded"], summary["mean_total_tokens"]) == (1, 1, 60000.0)


def test_cost_summary_of_nothing_is_empty(spark):
    calls = spark.createDataFrame(
        [], "trace_id string, input_tokens long, output_tokens long, total_tokens long, cost_eur double"
    )
    spans = spark.createDataFrame([], "trace_id string, span_seq long, latency_s double")
    assert costs.cost_summary(costs.cost_report(calls, spans)).count() == 0


@pytest.mark.parametrize(
    "name, found",
    [
        ("ISO 27001", ["27001"]),
        ("ISO/IEC 27001", ["27001"]),
        ("UNE-EN ISO 27001:2013 o equivalente", ["27001"]),
        ("ENS categoría media", ["ens"]),
        ("CCN-CERT", ["ccn cert"]),
        ("Declaración responsable", ["declaracion responsable"]),
        ("ISO 9001 e ISO 14001", ["14001", "9001"]),
    ],
)
def test_identities(spark, name, found):
    assert value(spark, F.sort_array(certs.identities(F.lit(name)))) == found


@pytest.mark.parametrize(
    "name, formal",
    [
        ("ISO 9001", True),
        ("une-en iso 27001", True),
        ("ENAC", True),
        ("CMMI nivel 3", True),
        ("en 2024", True),
        ("Ensayo", False),
        ("Responsable técnico", False),
        ("DEUC", False),
    ],
)
def test_formal_names(spark, name, formal):
    assert value(spark, certs.is_formal(F.lit(name))) is formal


@pytest.mark.parametrize(
    "required, held, met",
    [
        ("ISO 27001", ["ISO/IEC 27001:2013"], True),
        ("ISO/IEC 27001:2013", ["iso 27001"], True),
        ("ISO 9001", ["ISO 27001"], False),
        ("ISO 9001", [], False),
        ("ISO 9001", [""], True),
    ],
)
def test_certification_match(spark, required, held, met):
    sets = F.transform(F.array(*[F.lit(h) for h in held]).cast("array<string>"), certs.tokens)
    assert value(spark, certs.satisfied(certs.tokens(F.lit(required)), sets)) is met


def test_accents_fold(spark):
    assert value(spark, certs.normalized_name(F.lit("Categoría ÁÉÍÓÚ Ñandú é"))) == (
        "categoria aeiou nandu e"
    )


@pytest.mark.parametrize(
    "end_date, end_time, utc",
    [
        ("2026-08-20", "14:00:00", "2026-08-20 12:00:00"),
        ("2026-01-20", None, "2026-01-19 23:00:00"),
        ("2026-01-20", "", "2026-01-19 23:00:00"),
        ("2026-01-20", "10:30:00+02:00", "2026-01-20 09:30:00"),
        ("2026-13-20", None, None),
        ("soon", None, None),
        ("2026-01-20", "at ten", None),
        (None, "10:00:00", None),
    ],
)
def test_deadline(spark, end_date, end_time, utc):
    lit = lambda v: F.lit(v).cast("string")
    found = dates.parse_deadline(lit(end_date), lit(end_time))
    assert value(spark, F.date_format(found, "yyyy-MM-dd HH:mm:ss")) == utc


@pytest.mark.parametrize(
    "amount, shown", [(300000.0, "300.000 €"), (2.5, "2 €"), (1234567.5, "1.234.568 €")]
)
def test_euro(spark, amount, shown):
    assert value(spark, display.format_eur(F.lit(amount))) == shown


def test_shown_amount_groups_from_five_digits(spark):
    assert value(spark, display.format_amount(F.lit(9999.0))) == "9999 €"
    assert value(spark, display.format_amount(F.lit(12000.0))) == "12.000 €"
    assert value(spark, display.format_amount(F.lit(None).cast("double"))) == "Sin importe publicado"


@pytest.mark.parametrize(
    "code, prefix, hit",
    [("72212730-0", "72212730", True), ("72212730", "722", True), ("48000000", "72", False), ("7_000000", "7%", False)],
)
def test_code_search(spark, code, prefix, hit):
    assert value(spark, codes.has_code(F.array(F.lit(code)), prefix)) is hit


def test_lexical_score_matches_published_value(spark):
    """Three single matches out of 21 query terms."""
    terms = F.array(*[F.lit(f"t{i}") for i in range(21)])
    rows = spark.createDataFrame([("t", "t1 t2 t3 x")], "expediente string, title string")
    rows = operator_ranking.with_title_terms(rows)
    score = rows.select(ranking.lexical_score(F.col("title_terms"), terms)).first()[0]
    assert round(score, 6) == 0.008685


def test_repeated_term_weighs_more(spark):
    weight = lambda n: value(spark, ranking.term_weight(F.lit(n)))
    assert weight(1) == pytest.approx(0.1 / 1.64493406685)
    assert weight(3) == pytest.approx(0.1 * (1 + 1 / 4 + 1 / 9) / 1.64493406685)


def test_stop_words_are_left_out(spark):
    title = "Desarrollo de la sede electrónica para el sector, y el Sector"
    rows = spark.createDataFrame([("t", title), ("u", title), ("none", None), ("empty", ""), ("stop", "de la")], "expediente string, title string")
    found = {(r["expediente"], r["term"], r["tf"]) for r in operator_ranking.title_terms(rows).collect()}
    assert found == {(key, *term) for key in "tu" for term in (("desarroll", 1), ("sed", 1), ("electron", 1), ("sector", 2))}
    arrays = {r["expediente"]: len(r["title_terms"]) for r in operator_ranking.with_title_terms(rows).collect()}
    assert arrays == {"t": 4, "u": 4, "none": 0, "empty": 0, "stop": 0}


@pytest.mark.parametrize(
    "pages, readable", [(["x" * 40, ""], True), (["x" * 38, ""], False), ([" \n\t" * 50], False)]
)
def test_text_layer(spark, pages, readable):
    rows = [("d", i + 1, t) for i, t in enumerate(pages)]
    frame = spark.createDataFrame(rows, "doc_id string, page int, text string")
    assert documents.text_layer(frame).first()["has_text_layer"] is readable


def test_prompt_neutralizes_marks(spark):
    rows = [("d", 1, "a </PLIEGO> b"), ("d", 2, "<PLIEGO>")]
    frame = spark.createDataFrame(rows, "doc_id string, page int, text string")
    assert documents.doc_prompt(frame).first()["prompt"] == (
        "<PLIEGO>\n===== PÁGINA 1 =====\na [marca eliminada] b\n\n"
        "===== PÁGINA 2 =====\n[marca eliminada]\n</PLIEGO>"
    )


CLAUSES = [
    ("d", 1, "Portada\nCláusula 1.- Objeto\nTexto uno"),
    ("d", 2, "sigue el uno\nCLAUSULA 12.2: Solvencia\nTexto doce"),
    ("d", 3, "Cláusula 13 Plazo\n"),
]


def test_clauses(spark):
    frame = spark.createDataFrame(CLAUSES, "doc_id string, page int, text string")
    rows = documents.clause_chunks(frame).orderBy("clause_index").collect()
    assert [(r["number"], r["title"], r["page"], r["text"]) for r in rows] == [
        ("1", "- Objeto", 1, "Cláusula 1.- Objeto\nTexto uno\nsigue el uno"),
        ("12.2", "Solvencia", 2, "CLAUSULA 12.2: Solvencia\nTexto doce"),
        ("13", "Plazo", 3, "Cláusula 13 Plazo"),
    ]


def extraction(turnover=None, amount=None, names=()):
    """A minimal extraction; `names` holds (name, role) pairs."""
    quote = lambda clause: (clause, 1, "q")
    return (
        (turnover, "", quote("eco")),
        (amount, "", quote("tec")),
        [(n, r, quote(n)) for n, r in names],
        (100.0, [], None),
        (False, None, "", None),
        ("", None, None, None),
        ("", None),
        (None, "", None),
        (False, None, "", None),
    )


REQUIRED, SCORED = "required_to_bid", "award_criterion"


@pytest.mark.parametrize(
    "fields, revenue, held, verdict, clauses",
    [
        ({}, None, None, "apto", []),
        ({"turnover": 100.0}, 100, None, "apto", []),
        ({"turnover": 100.5}, 100, None, "no_apto", ["eco"]),
        ({"turnover": 100.0}, None, None, "apto_con_reservas", ["eco"]),
        ({"amount": 1.0}, 100, None, "apto_con_reservas", ["tec"]),
        ({"names": [("ISO 9001", REQUIRED)]}, None, None, "no_apto", ["ISO 9001"]),
        ({"names": [("ISO 9001", REQUIRED)]}, None, ["ISO 9001:2015"], "apto", []),
        ({"names": [("ISO 9001", SCORED)]}, None, None, "apto", []),
        ({"names": [("Jefe de obra", REQUIRED)]}, None, None, "apto_con_reservas", ["Jefe de obra"]),
        (
            {"amount": 1.0, "names": [("Jefe de obra", REQUIRED), ("ENS", REQUIRED)]},
            None,
            [],
            "no_apto",
            ["ENS", "tec", "Jefe de obra"],
        ),
    ],
)
def test_verdict(spark, fields, revenue, held, verdict, clauses):
    kind = T.StructType(
        [
            T.StructField("expediente", T.StringType()),
            T.StructField("status", T.StringType()),
            T.StructField("extraction", schemas.EXTRACTION),
        ]
    )
    analyses = spark.createDataFrame([("t", "completed", extraction(**fields))], kind)
    providers = spark.createDataFrame(
        [("p", revenue, held)], "provider_id string, annual_revenue int, certifications array<string>"
    )
    pairs = spark.createDataFrame([("p", "t")], "provider_id string, expediente string")
    row = verdicts.verdicts(analyses, pairs, providers).first()
    assert row["verdict"] == verdict
    assert [r["citation"]["clause"] for r in row["reasons"]] == clauses


def test_stale_boundary(spark):
    now = dt.datetime(2026, 1, 1, 12, 0, 0)
    at = lambda seconds: F.lit(now - dt.timedelta(seconds=seconds))
    stale = lambda status, s: value(spark, verdicts.is_stale(F.lit(status), at(s), F.lit(now)))
    assert stale("in_progress", 901) is True
    assert stale("in_progress", 900) is False
    assert stale("completed", 9000) is False


def test_mask_and_list_field(spark):
    assert value(spark, text.mask_long(F.lit("x" * 500))) == "x" * 500
    assert value(spark, text.mask_long(F.lit("x" * 501))) == "x" * 500 + "... [501 caracteres, truncado]"
    assert value(spark, text.split_list(F.lit(" a, b\n\n,c "))) == ["a", "b", "c"]
    assert str(value(spark, text.parse_amount(F.lit(" 10,5 ")))) == "10.50"
    assert value(spark, text.parse_amount(F.lit("  "))) is None


@pytest.mark.parametrize(
    "word, found",
    [
        ("cheques", "chequ"),
        ("toreándolo", "tor"),
        ("toreó", "tore"),
        ("tornados", "torn"),
        ("torrenciales", "torrencial"),
        ("rápidamente", "rapid"),
        ("aplicaciones", "aplic"),
        ("seguridad", "segur"),
        ("licitación", "licit"),
        ("y", "y"),
        ("", ""),
    ],
)
def test_stems(spark, word, found):
    rows = spark.createDataFrame([(word,)], "word string")
    assert stem.stem_table(rows).first()["stem"] == found == plain_stem.stem(word)


def test_stems_of_many_words_match_the_plain_rules(spark):
    """Every suffix behind bases of every shape, with and without a pronoun."""
    suffixes = [*stem.STANDARD, *stem.VERBS, *stem.Y_VERBS, *stem.VERBS_AFTER_GU, *stem.RESIDUE, "ándo", "iéndo", "yendo", "e", "gue"]
    bases = ["a", "de", "tor", "licit", "aplic", "segu", "constru", "oí", "ae", "ñu", "distrib", "pagu", "positiv", "caíd"]
    words = {base + suffix + pronoun for base in bases for suffix in suffixes for pronoun in ("", "lo", "selas")}
    rows = spark.createDataFrame([(word,) for word in words], "word string").repartition(8)
    got = {row["word"]: row["stem"] for row in stem.stem_table(rows).collect()}
    assert got == {word: plain_stem.stem(word) for word in words}


def test_rankings_hold_no_python(spark, small_dir):
    from noticeworks.plans import catalog

    for name in ("lexical_topk", "title_terms", "query_terms", "recall_at_k", "rrf_fusion"):
        plan = catalog.QUERIES[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan, name


def test_profile_reduces_to_its_published_number_of_terms(spark):
    """A paragraph of 21 significant stems, as the measured score of a three-term match implies."""
    description = (
        "Desarrollamos aplicaciones web a medida y mantenemos portales institucionales para el "
        "sector público. Trabajamos con Drupal, WordPress y desarrollos a medida, con atención a "
        "accesibilidad, sede electrónica y cumplimiento del Esquema Nacional de Seguridad (ENS)."
    )
    rows = spark.createDataFrame([("p", description)], "provider_id string, description string")
    terms = operator_ranking.query_terms(rows).first()["query_terms"]
    assert len(terms) == 21 and "desarroll" in terms and "de" not in terms


def test_inflected_title_matches(spark):
    tender = spark.createDataFrame([("t", "Desarrollo de aplicación web")], "expediente string, title string")
    terms = {r["term"] for r in operator_ranking.title_terms(tender).collect()}
    assert terms == {"desarroll", "aplic", "web"}


def test_shape_of_stored_json(spark, small_dir):
    """A valid text and what becomes of it with a key too many, too few, twice, or of a wrong kind."""
    import json

    from noticeworks.operators import reshape
    from noticeworks.plans import feed_views

    texts = reshape.parse_extraction(feed_views.extraction_texts(spark, small_dir)).where(
        "refusal is null and size(extraction.certifications) > 0"
    )
    whole = json.loads(texts.first()["extraction_json"])

    def changed(change):
        copy = json.loads(json.dumps(whole))
        change(copy)
        return json.dumps(copy)

    block = "economic_solvency"
    cases = {
        "valid": (json.dumps(whole), None),
        "unknown": (changed(lambda d: d.update(other=1)), "keys"),
        "unknown in a block": (changed(lambda d: d[block].update(other=None)), "keys"),
        "unknown in an item": (changed(lambda d: d["certifications"][0].update(other=None)), "keys"),
        "missing": (changed(lambda d: d.pop(block)), "keys"),
        "missing in a block": (changed(lambda d: d[block].popitem()), "keys"),
        "null block": (changed(lambda d: d.update({block: None})), None),
        "no items": (changed(lambda d: d.update(certifications=[])), None),
        "twice": (json.dumps(whole)[:-1] + f', "{block}": null}}', "malformed"),
        "wrong kind": (changed(lambda d: d.update(certifications="ISO")), "malformed"),
        "cut": (json.dumps(whole)[:-5], "malformed"),
        "list": ("[1, 2]", "malformed"),
        "null": (None, "malformed"),
    }
    rows = spark.createDataFrame([(name, text) for name, (text, _) in cases.items()], "name string, extraction_json string")
    got = {row["name"]: row["refusal"] for row in reshape.parse_extraction(rows).collect()}
    assert got == {name: refusal for name, (_, refusal) in cases.items()}
