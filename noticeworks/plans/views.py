"""Canonical tables derived from the driver's Parquet tables.

Every view keeps all rows of the tables it is built from. `oracle.py` states the
same rules in SQL.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks import schemas
from noticeworks.functions import codes
from noticeworks.sources.tables import read_table

# Inflected words that the term queries add to titles and descriptions.
SPANISH = (
    "licitaciones licitación licitamos rápidamente aplicaciones aplicación seguridad actividades mantenimientos "
    "desarrollándolo construyendo averigüe torrenciales distribuciones accesibilidad positivamente agentes creativos "
    "portales leyendo siguen analogías frecuencias"
).split()
AS_OF = "1998-06-01 00:20:00"
ROLE_REQUIRED = "required_to_bid"
ROLE_SCORED = "award_criterion"
ROLE_PAPERWORK = "administrative_paperwork"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def key_case(key: Column, modulus: int, values: dict[int, Column], default: Column) -> Column:
    """A value chosen by the remainder of a numeric key."""
    out = None
    for remainder, value in values.items():
        test = (key % modulus) == remainder
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def parts(spark: SparkSession, sf: str) -> DataFrame:
    size = F.lpad(F.col("p_size").cast("string"), 2, "0")
    brand = F.lpad(F.substring_index("p_brand", "#", -1), 2, "0")
    division = F.when(F.col("p_size") % 2 == 0, "72").otherwise("48")
    check = F.when(
        F.col("p_size") % 5 == 0, F.concat(F.lit("-"), (F.col("p_size") % 10).cast("string"))
    ).otherwise("")
    return read_table(spark, sf, "part").select(
        "p_partkey", "p_name", F.concat(division, size, brand, F.lit("00"), check).alias("code")
    )


def notices_coded(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order, with the raw codes a feed entry carries."""
    lots = (
        read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
        .join(parts(spark, sf), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey")
        # Both sets are bounded by closed vocabularies, whatever the number of lines.
        .agg(F.collect_set("p_name").alias("names"), F.collect_set("code").alias("codes"))
    )
    key = F.col("o_orderkey")
    price = F.col("o_totalprice").cast(schemas.MONEY)
    missing_budget = key % 11 == 0
    url = lambda kind: F.concat(F.lit(f"https://example.org/{kind}/"), key.cast("string"))
    return (
        read_table(spark, sf, "orders")
        .join(read_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read_table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(lots, key == F.col("l_orderkey"), "left")
        .select(
            key.alias("order_key"),
            F.col("o_custkey").alias("customer_key"),
            key.cast("string").alias("expediente"),
            F.col("c_name").alias("contracting_body"),
            F.coalesce(F.array_join(F.sort_array("names"), " "), F.lit("")).alias("title"),
            F.coalesce(F.sort_array("codes"), F.array().cast("array<string>")).alias("cpv_codes"),
            F.when(~missing_budget, price).alias("budget_with_vat"),
            F.when(~missing_budget & (key % 5 != 0), (price - 100).cast(schemas.MONEY)).alias(
                "budget_without_vat"
            ),
            F.when(key % 4 != 0, (price * 2).cast(schemas.MONEY)).alias("estimated_value"),
            F.substring("o_orderpriority", 1, 1).alias("priority_code"),
            key_case(
                F.substring("o_orderpriority", 1, 1).cast("int"),
                10,
                {4: F.lit("40"), 5: F.lit("50")},
                F.substring("o_orderpriority", 1, 1),
            ).alias("type_code"),
            (key % 13 + 1).cast("string").alias("procedure_code"),
            F.when(F.col("o_orderstatus") == "O", "PUB")
            .when(F.col("o_orderstatus") == "P", "EV")
            .otherwise("RES")
            .alias("status_code"),
            F.when(
                key % 13 != 0,
                F.col("o_orderdate").cast("timestamp")
                + F.make_dt_interval((key % 90).cast("int")),
            ).alias("submission_deadline"),
            F.col("n_name").alias("location"),
            F.when(key % 10 != 3, url("pcap")).alias("pcap_url"),
            F.when(key % 10 != 4, url("ppt")).alias("ppt_url"),
            url("notice").alias("platform_url"),
            F.col("o_orderdate").cast("timestamp").alias("published_at"),
            (
                F.col("o_orderdate").cast("timestamp") + F.make_dt_interval((key % 30).cast("int"))
            ).alias("updated_at_source"),
        )
    )


def tenders(spark: SparkSession, sf: str) -> DataFrame:
    coded = notices_coded(spark, sf)
    return coded.select(
        "order_key",
        *[c for c in schemas.TENDER_COLUMNS if c in coded.columns],
        codes.label_of(F.col("type_code"), codes.CONTRACT_TYPES).alias("contract_type"),
        codes.label_of(F.col("procedure_code"), codes.PROCEDURES).alias("procedure_type"),
        codes.label_of(F.col("status_code"), codes.STATUSES).alias("status"),
    )


def tender_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Tenders assigned to the embedding table in turn; every seventh has no vector."""
    vectors = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    count = read_table(spark, sf, "embeddings").agg(F.count("*")).scalar()
    orders = read_table(spark, sf, "orders").select("o_orderkey")
    slot = F.when(F.col("o_orderkey") % 7 != 3, F.col("o_orderkey") % count)
    return (
        orders.withColumn("slot", slot)
        .join(vectors, F.col("slot") == F.col("vec_id"), "left")
        .select(F.col("o_orderkey").cast("string").alias("expediente"), "embedding")
    )


def providers(spark: SparkSession, sf: str) -> DataFrame:
    supplier = read_table(spark, sf, "supplier")
    count = supplier.agg(F.count("*")).scalar()
    groups = (
        parts(spark, sf)
        .groupBy((F.col("p_partkey") % count).alias("owner"))
        .agg(
            F.collect_set("p_name").alias("names"),
            F.collect_set(codes.normalize_code(F.col("code"))).alias("codes"),
        )
    )
    key = F.col("s_suppkey")
    cert = lambda *names: F.array(*[F.lit(n) for n in names])
    nation = lambda k: F.concat(F.lit("NATION_"), k.cast("string"))
    return supplier.join(groups, key == F.col("owner"), "left").select(
        key.alias("supplier_key"),
        key.cast("string").alias("provider_id"),
        F.coalesce(F.array_join(F.sort_array("names"), " "), F.lit("")).alias("description"),
        F.coalesce(F.sort_array("codes"), F.array().cast("array<string>")).alias("cpv_codes"),
        F.when(key % 3 != 0, (20000 + 1000 * (key % 50)).cast(schemas.MONEY)).alias("min_budget"),
        F.when(key % 4 != 0, F.lit(250000).cast(schemas.MONEY)).alias("max_budget"),
        F.when(key % 5 != 0, (F.abs("s_acctbal") * 40).cast(schemas.MONEY)).alias("annual_revenue"),
        key_case(
            key,
            4,
            {1: cert("ISO 9001"), 2: cert("ENS", "ISO 27001"), 3: cert("ISO/IEC 27001:2013")},
            F.lit(None).cast("array<string>"),
        ).alias("certifications"),
        F.when(
            key % 2 == 1,
            F.array(nation(F.col("s_nationkey")), nation((F.col("s_nationkey") + 1) % 25)),
        ).alias("locations"),
    )


def provider_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    count = read_table(spark, sf, "embeddings").agg(F.count("*")).scalar()
    return (
        read_table(spark, sf, "supplier")
        .withColumn("slot", F.col("s_suppkey") % count)
        .join(vectors, F.col("slot") == F.col("vec_id"), "left")
        .select(F.col("s_suppkey").cast("string").alias("provider_id"), "embedding")
    )


def interests(spark: SparkSession, sf: str) -> DataFrame:
    """Provider and tender pairs with a judgement, from the order lines."""
    flag = F.min("l_returnflag")
    return (
        read_table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_returnflag")
        .groupBy("l_suppkey", "l_orderkey")
        .agg(
            F.when(flag == "A", "relevant")
            .when(flag == "R", "not_relevant")
            .otherwise("excluded")
            .alias("label")
        )
        .select(
            F.col("l_suppkey").cast("string").alias("provider_id"),
            F.col("l_orderkey").cast("string").alias("expediente"),
            "label",
        )
    )


def raw_labels(spark: SparkSession, sf: str) -> DataFrame:
    """One label per order line, before any cleaning; sets may overlap."""
    return read_table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("provider_id"),
        F.col("l_orderkey").cast("string").alias("expediente"),
        F.when(F.col("l_returnflag") == "A", "relevant")
        .when(F.col("l_returnflag") == "R", "not_relevant")
        .otherwise("excluded")
        .alias("label"),
    )


def doc_pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"),
        (F.col("turn") + 1).cast("int").alias("page"),
        "text",
    )


def all_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as paged documents, and every document as one page."""
    paged = doc_pages(spark, sf).withColumn("doc_id", F.concat(F.lit("c"), "doc_id"))
    whole = read_table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.lit(1).alias("page"),
        "text",
    )
    return paged.unionByName(whole)


def clause_pages(spark: SparkSession, sf: str) -> DataFrame:
    """All pages with a clause header in front of every third line, from the second on."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when(
            i % 3 == 1,
            F.concat(
                F.lit("Cláusula "),
                (i + 1).cast("string"),
                F.lit("."),
                F.col("page").cast("string"),
                F.lit(".- "),
                line,
            ),
        ).otherwise(line),
    )
    return all_pages(spark, sf).select("doc_id", "page", F.array_join(lines, "\n").alias("text"))


def altered_quote(quote: Column, kind: Column) -> Column:
    """0 double spaces, 1 words reversed, 2 an absent word, 3 as 0."""
    spread = F.array_join(F.split(quote, " "), "  ")
    turned = F.array_join(F.reverse(F.split(quote, " ")), " ")
    return (
        F.when(kind == 1, turned)
        .when(kind == 2, F.concat(quote, F.lit(" zzzabsent")))
        .otherwise(spread)
    )


def citations(spark: SparkSession, sf: str) -> DataFrame:
    """One citation per line of every page, altered in four ways."""
    lines = doc_pages(spark, sf).select(
        "doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line", "quote")
    )
    kind = (F.col("doc_id").cast("bigint") + F.col("page") + F.col("line")) % 4
    return lines.select(
        "doc_id",
        F.col("page").alias("source_page"),
        "line",
        F.when(kind == 3, F.col("page") + 100).otherwise(F.col("page")).alias("page"),
        altered_quote(F.col("quote"), kind).alias("quote"),
    )


def citation_struct(clause: Column, page: Column, quote: Column) -> Column:
    return F.struct(
        clause.cast("string").alias("clause"), page.cast("int").alias("page"), quote.alias("quote")
    )


def null_citation() -> Column:
    return F.lit(None).cast(schemas.CITATION)


def page_extractions(spark: SparkSession, sf: str) -> DataFrame:
    """One extraction per page, citing that page's text in different shapes."""
    page, quote = F.col("page"), F.col("text")
    cite = lambda p, q: citation_struct(F.lit("1"), p, q)
    certification = lambda name, p, q: F.struct(
        F.lit(name).alias("name"), F.lit(ROLE_REQUIRED).alias("role"), cite(p, q).alias("citation")
    )
    blocks = {
        "economic_solvency": cite(page, quote),
        "technical_solvency": cite(page, altered_quote(quote, F.lit(1))),
        "award_criteria": cite(page, altered_quote(quote, F.lit(2))),
        "guarantees": cite(page + 1, quote),
        "execution_deadline": null_citation(),
        "submission_deadline": cite(page + 100, quote),
        "subcontracting": cite(page, F.translate(quote, ascii_lowercase, ascii_uppercase)),
        "lots": cite(page, altered_quote(quote, F.lit(0))),
    }
    described = lambda name: F.concat(F.lit(f"{name}: "), quote)
    built = [
        F.struct(described(name).alias("description"), citation.alias("citation")).alias(name)
        for name, citation in blocks.items()
    ]
    extraction = F.struct(
        *built,
        F.array(
            certification("ISO 9001", page, quote),
            certification("ENS", page + 1, quote),
            F.struct(
                F.lit("CMMI").alias("name"),
                F.lit(ROLE_SCORED).alias("role"),
                null_citation().alias("citation"),
            ),
        ).alias("certifications"),
    )
    return doc_pages(spark, sf).select(
        F.concat_ws("-", "doc_id", "page").alias("analysis_id"),
        "doc_id",
        extraction.alias("extraction"),
    )


# Certification names used as cases, formal ones first.
CERT_CASES = (
    "ISO 9001",
    "ISO/IEC 27001",
    "ISO IEC 20000",
    "UNE-EN ISO 27001:2013 o equivalente",
    "ENS categoría media",
    "CMMI nivel 3",
    "CCN-CERT",
    "Acreditación ENAC",
    "Responsable técnico",
    "DEUC",
    "Declaración responsable",
    "Certificación positiva de la Agencia Tributaria",
    "Clasificación empresarial",
    "Analista programador",
)


def cert_names(spark: SparkSession, sf: str) -> DataFrame:
    """Certification names of every tender: one of the cases, or two of them joined."""
    names = F.array(*[F.lit(n) for n in CERT_CASES])
    key = F.col("o_orderkey")
    size = len(CERT_CASES)
    pick = lambda k: F.element_at(names, (k % size + 1).cast("int"))
    joiner = key_case(key, 3, {0: F.lit(" y ")}, F.lit(", "))
    second = F.concat(joiner, pick(F.floor(key / size)))
    return read_table(spark, sf, "orders").select(
        key.cast("string").alias("expediente"),
        F.concat(pick(key), F.when(key % 2 == 0, second).otherwise("")).alias("name"),
    )


def extraction_columns(key: Column, price: Column, priority: Column) -> Column:
    """A full extraction struct whose fields follow from an order."""
    null_d = F.lit(None).cast("double")
    null_b = F.lit(None).cast("boolean")

    def cite(block: int) -> Column:
        return F.when(
            (key + block) % 5 != 1,
            citation_struct(F.concat(F.lit("c"), F.lit(str(block))), key % 4 + 1, priority),
        )

    def cert(name: str, role: str, citation: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"), F.lit(role).alias("role"), citation.alias("citation")
        )

    def criterion(name: str, points: Column, is_price: bool) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            points.cast("double").alias("points"),
            F.lit(is_price).alias("is_price"),
        )

    no_certs = F.array().cast(schemas.EXTRACTION["certifications"].dataType)
    no_criteria = F.array().cast("array<struct<name:string,points:double,is_price:boolean>>")
    three_way = key_case(key, 3, {0: null_b, 1: F.lit(True)}, F.lit(False))
    return F.struct(
        F.struct(
            F.when(key % 4 != 0, price).alias("minimum_annual_turnover_eur"),
            key_case(key, 3, {0: F.lit("")}, F.lit("Volumen anual")).alias("description"),
            cite(0).alias("citation"),
        ).alias("economic_solvency"),
        F.struct(
            F.when(key % 5 == 0, price / 2).alias("minimum_amount_eur"),
            key_case(key, 2, {0: F.lit("")}, F.lit("Trabajos similares")).alias("description"),
            cite(1).alias("citation"),
        ).alias("technical_solvency"),
        key_case(
            key,
            6,
            {
                0: F.array(cert("ISO 27001", ROLE_REQUIRED, cite(8))),
                1: F.array(cert("Responsable técnico", ROLE_REQUIRED, cite(8))),
                2: F.array(cert("ISO 9001", ROLE_SCORED, cite(8))),
                3: F.array(
                    cert("ENS categoría media", ROLE_REQUIRED, cite(8)),
                    cert("DEUC", ROLE_PAPERWORK, cite(9)),
                ),
            },
            no_certs,
        ).alias("certifications"),
        F.struct(
            key_case(key, 3, {0: F.lit(60.5)}, F.lit(100.0)).alias("total_points"),
            key_case(
                key,
                8,
                {0: no_criteria, 1: F.array(criterion("Memoria", F.lit(40), False))},
                F.array(
                    criterion("Memoria", F.lit(40), False),
                    criterion("Precio", 30 + key % 30, True),
                    criterion("Mejoras", F.lit(5), True),
                ),
            ).alias("criteria"),
            cite(2).alias("citation"),
        ).alias("award_criteria"),
        F.struct(
            (key % 2 == 0).alias("provisional_required"),
            key_case(key, 4, {1: null_d}, F.lit(5.0)).alias("definitive_percentage"),
            key_case(key, 3, {0: F.lit("")}, F.lit("Definitiva del 5 %")).alias("description"),
            cite(3).alias("citation"),
        ).alias("guarantees"),
        F.struct(
            key_case(key, 5, {2: F.lit("")}, F.lit("Doce meses.")).alias("description"),
            three_way.alias("extensions_allowed"),
            key_case(key, 2, {0: F.lit(None).cast("string")}, F.lit("hasta 12 meses más.")).alias(
                "extensions_description"
            ),
            cite(4).alias("citation"),
        ).alias("execution_deadline"),
        F.struct(F.lit("Quince días").alias("description"), cite(5).alias("citation")).alias(
            "submission_deadline"
        ),
        F.struct(
            three_way.alias("allowed"),
            F.lit("Según pliego").alias("description"),
            cite(6).alias("citation"),
        ).alias("subcontracting"),
        F.struct(
            (key % 2 == 1).alias("divided_into_lots"),
            key_case(key, 4, {1: F.lit(True), 3: F.lit(False)}, null_b).alias(
                "can_bid_partial_lots"
            ),
            key_case(key, 3, {1: F.lit("")}, F.lit("Dos lotes.")).alias("description"),
            cite(7).alias("citation"),
        ).alias("lots"),
    )


def analyses(spark: SparkSession, sf: str) -> DataFrame:
    """Analyses of every tender that is open or resolved; none while an award is pending."""
    key = F.col("o_orderkey")
    status = key_case(
        key,
        7,
        {
            0: F.lit("in_progress"),
            1: F.lit("failed"),
            2: F.lit("not_analyzable"),
            3: F.lit("pending"),
        },
        F.lit("completed"),
    )
    created = F.col("o_orderdate").cast("timestamp")
    extraction = extraction_columns(key, F.col("o_totalprice"), F.col("o_orderpriority"))
    done = status == "completed"
    return (
        read_table(spark, sf, "orders")
        .filter(F.col("o_orderstatus").isin("O", "F"))
        .select(
            key.alias("order_key"),
            key.cast("string").alias("expediente"),
            F.when(key % 9 != 0, F.sha2(F.col("o_custkey").cast("string"), 256)).alias("pdf_hash"),
            status.alias("status"),
            F.when(done & (key % 11 != 4), extraction).alias("extraction"),
            F.when(done, (key % 10) / 10.0).alias("citation_faithfulness"),
            key_case(
                key, 7, {1: F.lit("run stopped"), 2: F.lit("no text layer")}, F.lit(None).cast("string")
            ).alias("error_message"),
            created.alias("created_at"),
            (
                created
                + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (key % 1800).cast("decimal(18,6)"))
            ).alias("updated_at"),
        )
    )


def trace_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Three consecutive events form a trace; errors report no usage."""
    failed = F.col("event_type") == "error"
    return read_table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 3).cast("string").alias("trace_id"),
        F.when(~failed, F.floor(F.col("value") * 100).cast("bigint")).alias("input_tokens"),
        F.when(~failed, F.floor(F.col("value") * 10).cast("bigint")).alias("output_tokens"),
        F.when(
            ~failed,
            F.floor(F.col("value") * 100).cast("bigint")
            + F.floor(F.col("value") * 10).cast("bigint"),
        ).alias("total_tokens"),
        F.when(F.col("event_id") % 4 != 0, F.col("value") / 1000).alias("cost_eur"),
    )


def trace_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Views and purchases carry the latency of their trace."""
    return (
        read_table(spark, sf, "events")
        .filter(F.col("event_type").isin("view", "purchase"))
        .select(
            F.floor(F.col("event_id") / 3).cast("string").alias("trace_id"),
            F.col("event_id").alias("span_seq"),
            F.col("value").alias("latency_s"),
        )
    )


def spanish_tenders(spark: SparkSession, sf: str) -> DataFrame:
    """expediente and title of all tenders, with two inflected Spanish words in each title."""
    words, key = F.array(*map(F.lit, SPANISH)), F.col("order_key")
    word = lambda place: F.get(words, (place % len(SPANISH)).cast("int"))
    title = F.concat("title", F.lit(" "), word(key), F.lit(" de la "), word(key * 7))
    return tenders(spark, sf).select("expediente", title.alias("title"))


def spanish_providers(spark: SparkSession, sf: str) -> DataFrame:
    """provider_id and description of all providers, with two inflected Spanish words in each description."""
    words, key = F.array(*map(F.lit, SPANISH)), F.col("supplier_key")
    word = lambda place: F.get(words, (place % len(SPANISH)).cast("int"))
    description = F.concat("description", F.lit(" "), word(key), F.lit(" y "), word(key * 5))
    return providers(spark, sf).select("provider_id", description.alias("description"))
