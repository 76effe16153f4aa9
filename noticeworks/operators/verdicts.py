"""Rule-based verdict of an analysed tender for a provider, and analysis status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks import schemas
from noticeworks.functions import certs, display

# Verdicts, the role that can block, the idle limit, and the texts a reader sees.
APTO, WITH_RESERVES, NOT_APTO = "apto", "apto_con_reservas", "no_apto"
REQUIRED = "required_to_bid"
STALE_SECONDS = 900
TURNOVER_UNKNOWN = (
    "El pliego exige una facturación anual mínima de {required}, pero tu perfil no declara "
    "facturación anual -- no se puede verificar."
)
TURNOVER_SHORT = (
    "Exigen una facturación anual mínima de {required} y tu perfil declara {declared}."
)
AMOUNT_UNKNOWN = (
    "El pliego exige un importe acumulado de trabajos similares de {required}, pero tu perfil no "
    "registra importe de trabajos previos -- no se puede verificar."
)
CERTIFICATION_MISSING = "Exigen la certificación '{name}' y tu perfil no la declara."
CERTIFICATION_ODD = (
    "El pliego pide '{name}' entre los requisitos, pero no es una certificación que tu perfil "
    "pueda declarar -- compruébalo a mano en la cláusula citada."
)
ROW_ECONOMIC = "Solvencia económica"
ROW_TECHNICAL = "Solvencia técnica"
ROW_CERTIFICATIONS = "Certificaciones"
ROW_CRITERIA = "Criterios de adjudicación"
ROW_GUARANTEES = "Garantías"
ROW_EXECUTION = "Plazo de ejecución"
ROW_LOTS = "Lotes"
TURNOVER_STATED = "Cifra de negocio mínima: {amount}"
TURNOVER_SILENT = "No se exige una cifra concreta."
AMOUNT_STATED = "Importe mínimo en trabajos similares: {amount}"
AMOUNT_SILENT = "No se exige un importe concreto."
CERTIFICATIONS_SILENT = "El pliego no menciona ninguna."
POINTS_WITH_PRICE = "{total} puntos en total, {price} al precio."
POINTS_ONLY = "{total} puntos en total."
GUARANTEE_YES = "Se exige garantía provisional."
GUARANTEE_NO = "Sin garantía provisional."
EXECUTION_SILENT = "No indicado."
EXTENSIONS_YES = "{base} Prórrogas: {extension}"
EXTENSIONS_PLANNED = "previstas en el pliego."
EXTENSIONS_NO = "{base} Sin prórrogas."
EXTENSIONS_SILENT = "{base} El pliego no dice nada sobre prórrogas."
LOTS_YES = "Dividido en lotes."
LOTS_NO = "No está dividido en lotes."

BLOCK, RESERVE = "block", "reserve"


def reason(severity: Column, detail: Column, citation: Column) -> Column:
    return F.struct(
        severity.alias("severity"),
        detail.alias("detail"),
        citation.cast(schemas.CITATION).alias("citation"),
    )


def turnover_reason(required: Column, revenue: Column, citation: Column) -> Column:
    """Undeclared revenue reserves, a lower one blocks, an equal one passes."""
    amount = display.format_eur(required)
    unknown = display.fill(TURNOVER_UNKNOWN, required=amount)
    short = display.fill(TURNOVER_SHORT, required=amount, declared=display.format_eur(revenue))
    return F.when(
        required.isNotNull() & revenue.isNull(), reason(F.lit(RESERVE), unknown, citation)
    ).when(revenue < required, reason(F.lit(BLOCK), short, citation))


def amount_reason(required: Column, citation: Column) -> Column:
    """Past work is not part of a profile, so a stated amount always reserves."""
    detail = display.fill(AMOUNT_UNKNOWN, required=display.format_eur(required))
    return F.when(required.isNotNull(), reason(F.lit(RESERVE), detail, citation))


def certification_reasons(required: Column, held: Column) -> Column:
    """Unmet requirements: a recognised scheme blocks, any other demand reserves."""

    def unmet(c: Column) -> Column:
        missing = display.fill(CERTIFICATION_MISSING, name=c["name"])
        odd = display.fill(CERTIFICATION_ODD, name=c["name"])
        return F.when(c["formal"], reason(F.lit(BLOCK), missing, c["citation"])).otherwise(
            reason(F.lit(RESERVE), odd, c["citation"])
        )

    return F.transform(F.filter(required, lambda c: ~certs.satisfied(c["tokens"], held)), unmet)


def verdicts(analyses: DataFrame, pairs: DataFrame, providers: DataFrame) -> DataFrame:
    """Verdict and reasons for every (provider, tender) pair with a completed extraction.

    Only the blocks the rules read travel through the joins. Names are reduced
    to token sets once per analysis and once per provider, not once per pair.
    """
    required = F.transform(
        F.filter("extraction.certifications", lambda c: c["role"] == REQUIRED),
        lambda c: F.struct(
            c["name"].alias("name"),
            c["citation"].alias("citation"),
            certs.is_formal(c["name"]).alias("formal"),
            certs.tokens(c["name"]).alias("tokens"),
        ),
    )
    demands = analyses.filter(
        (F.col("status") == "completed") & F.col("extraction").isNotNull()
    ).select(
        "expediente",
        F.col("extraction.economic_solvency").alias("economic"),
        F.col("extraction.technical_solvency").alias("technical"),
        required.alias("required"),
    )
    none = F.array().cast("array<string>")
    profiles = providers.select(
        "provider_id",
        F.col("annual_revenue").cast("double").alias("revenue"),
        F.transform(F.coalesce("certifications", none), certs.tokens).alias("held"),
    )
    rules = F.concat(
        F.array_compact(
            F.array(
                turnover_reason(
                    F.col("economic.minimum_annual_turnover_eur"),
                    F.col("revenue"),
                    F.col("economic.citation"),
                ),
                amount_reason(
                    F.col("technical.minimum_amount_eur"), F.col("technical.citation")
                ),
            )
        ),
        certification_reasons(F.col("required"), F.col("held")),
    )
    of = lambda severity: F.filter("rules", lambda r: r["severity"] == severity)
    shown = lambda rows: F.transform(
        rows, lambda r: F.struct(r["detail"].alias("detail"), r["citation"].alias("citation"))
    )
    return (
        pairs.select("provider_id", "expediente")
        .join(demands, "expediente")
        .join(profiles, "provider_id")
        .select("provider_id", "expediente", rules.alias("rules"))
        .select(
            "provider_id",
            "expediente",
            F.when(F.exists("rules", lambda r: r["severity"] == BLOCK), NOT_APTO)
            .when(F.size("rules") > 0, WITH_RESERVES)
            .otherwise(APTO)
            .alias("verdict"),
            shown(F.concat(of(BLOCK), of(RESERVE))).alias("reasons"),
        )
    )


def is_stale(status: Column, updated: Column, now: Column) -> Column:
    """In progress and untouched for longer than a run may take."""
    idle = F.unix_micros(now) - F.unix_micros(updated)
    return (status == "in_progress") & (idle > STALE_SECONDS * 1_000_000)


def analysis_status(tenders: DataFrame, analyses: DataFrame, now: Column) -> DataFrame:
    """Every tender with its analysis; pending without one, failed when its run is stale."""
    stale = is_stale(F.col("status"), F.col("updated_at"), now)
    settled = analyses.select(
        "expediente",
        F.when(stale, "failed").otherwise(F.col("status")).alias("analysis_status"),
        F.col("extraction").isNotNull().alias("has_extraction"),
        "citation_faithfulness",
    )
    status = F.coalesce("analysis_status", F.lit("pending"))
    found = F.coalesce("has_extraction", F.lit(False))
    return tenders.select("expediente").join(settled, "expediente", "left").select(
        "expediente",
        status.alias("status"),
        found.alias("has_extraction"),
        "citation_faithfulness",
        ((status == "completed") & found).alias("shows_verdict"),
    )


def settled_analyses(
    interests: DataFrame, analyses: DataFrame, providers: DataFrame, now: Column
) -> DataFrame:
    """What a provider sees of a tender's analysis: its state and result, and the verdict once it is completed.

    Pending without an analysis, failed when its run is stale.
    """
    stale = is_stale(F.col("status"), F.col("updated_at"), now)
    seen = analyses.select(
        "expediente",
        F.when(stale, "failed").otherwise(F.col("status")).alias("status"),
        "extraction",
        "citation_faithfulness",
        "error_message",
    )
    judged = verdicts(analyses.filter(F.col("status") == "completed"), interests, providers)
    pairs = interests.select("provider_id", "expediente")
    return (
        pairs.join(seen, "expediente", "left")
        .withColumn("status", F.coalesce("status", F.lit("pending")))
        .join(judged, ["provider_id", "expediente"], "left")
    )


def completed_analyses(analyses: DataFrame, tenders: DataFrame, limit: int) -> DataFrame:
    """The analyses with an extraction updated last, with their tender."""
    done = analyses.filter((F.col("status") == "completed") & F.col("extraction").isNotNull())
    return (
        done.join(tenders.select("expediente", "title", "pcap_url"), "expediente")
        .orderBy(F.desc("updated_at"), "expediente")
        .limit(limit)
    )


def plain_number(value: Column) -> Column:
    """A number as text without a trailing zero fraction."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def extraction_rows(analyses: DataFrame) -> DataFrame:
    """An extraction as labelled rows, in reading order, with fallbacks for silence."""
    e = lambda path: F.col(f"extraction.{path}")
    said = lambda c: F.nullif(c, F.lit(""))

    def amount_or(stated: str, amount: Column, description: Column, silent: str) -> Column:
        shown = display.fill(stated, amount=display.format_amount(amount))
        return F.when(amount.isNotNull(), shown).otherwise(
            F.coalesce(said(description), F.lit(silent))
        )

    price = F.get(F.filter(e("award_criteria.criteria"), lambda c: c["is_price"]), F.lit(0))
    total = plain_number(e("award_criteria.total_points"))
    points = F.when(
        price.isNotNull(),
        display.fill(POINTS_WITH_PRICE, total=total, price=plain_number(price["points"])),
    ).otherwise(display.fill(POINTS_ONLY, total=total))
    base = F.coalesce(said(e("execution_deadline.description")), F.lit(EXECUTION_SILENT))
    allowed = e("execution_deadline.extensions_allowed")
    extension = F.coalesce(
        e("execution_deadline.extensions_description"), F.lit(EXTENSIONS_PLANNED)
    )
    execution = (
        F.when(allowed, display.fill(EXTENSIONS_YES, base=base, extension=extension))
        .when(~allowed, display.fill(EXTENSIONS_NO, base=base))
        .otherwise(display.fill(EXTENSIONS_SILENT, base=base))
    )
    economic = amount_or(
        TURNOVER_STATED,
        e("economic_solvency.minimum_annual_turnover_eur"),
        e("economic_solvency.description"),
        TURNOVER_SILENT,
    )
    technical = amount_or(
        AMOUNT_STATED,
        e("technical_solvency.minimum_amount_eur"),
        e("technical_solvency.description"),
        AMOUNT_SILENT,
    )
    guarantees = F.coalesce(
        said(e("guarantees.description")),
        F.when(e("guarantees.provisional_required"), GUARANTEE_YES).otherwise(GUARANTEE_NO),
    )
    lots = F.when(
        e("lots.divided_into_lots"), F.coalesce(said(e("lots.description")), F.lit(LOTS_YES))
    ).otherwise(LOTS_NO)
    values = {
        ROW_ECONOMIC: (economic, e("economic_solvency.citation")),
        ROW_TECHNICAL: (technical, e("technical_solvency.citation")),
        ROW_CRITERIA: (points, e("award_criteria.citation")),
        ROW_GUARANTEES: (guarantees, e("guarantees.citation")),
        ROW_EXECUTION: (execution, e("execution_deadline.citation")),
        ROW_LOTS: (lots, e("lots.citation")),
    }

    def row(label: str, value: Column, citation: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            value.alias("value"),
            citation.cast(schemas.CITATION).alias("citation"),
        )

    rows = [row(label, value, citation) for label, (value, citation) in values.items()]
    named = F.transform(
        e("certifications"),
        lambda c: row(
            ROW_CERTIFICATIONS,
            F.concat(c["name"], F.lit(" · "), display.label(c["role"], display.ROLE_LABELS)),
            c["citation"],
        ),
    )
    silent = F.array(row(ROW_CERTIFICATIONS, F.lit(CERTIFICATIONS_SILENT), F.lit(None)))
    ordered = F.concat(
        F.array(*rows[:2]),
        F.when(F.size(e("certifications")) > 0, named).otherwise(silent),
        F.array(*rows[2:]),
    )
    listed = analyses.filter(F.col("extraction").isNotNull()).select(
        "expediente", F.posexplode(ordered).alias("position", "row")
    )
    return listed.select("expediente", "position", "row.label", "row.value", "row.citation")
