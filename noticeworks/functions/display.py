"""Values a reader sees: labels, amounts, deadlines."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeworks.functions.codes import literal_map

# Labels of the closed vocabularies.
TENDER_STATUS_LABELS = {
    "prior_notice": "Anuncio previo",
    "open_for_submission": "En plazo de presentación",
    "pending_award": "Pendiente de adjudicación",
    "awarded": "Adjudicada",
    "resolved": "Resuelta",
    "cancelled": "Anulada",
}
VERDICT_LABELS = {
    "apto": "APTO",
    "apto_con_reservas": "APTO CON RESERVAS",
    "no_apto": "NO APTO",
}
VERDICT_SUMMARIES = {
    "apto": "Nada en el pliego bloquea ni condiciona tu candidatura.",
    "apto_con_reservas": "Puedes presentarte, pero hay requisitos que tu perfil no permite verificar.",
    "no_apto": "Hay requisitos que tu perfil no cumple.",
}
ANALYSIS_STATUS_LABELS = {
    "pending": "En cola",
    "in_progress": "Analizando el pliego",
    "completed": "Análisis completado",
    "failed": "El análisis falló",
    "not_analyzable": "Pliego no analizable",
}
ROLE_LABELS = {
    "required_to_bid": "Exigida para licitar",
    "award_criterion": "Solo puntúa",
    "administrative_paperwork": "Papeleo de licitación",
}
NO_AMOUNT = "Sin importe publicado"
NO_DEADLINE = "Sin plazo publicado"
DEADLINE_PASSED = "Plazo cerrado"
DUE_TODAY = "Vence hoy"
ONE_DAY_LEFT = "Queda 1 día"
DAYS_LEFT = "Quedan {days} días"
CRITICAL_DAYS = 3
SOON_DAYS = 7


def fill(template: str, **parts: Column) -> Column:
    """A text with columns in the places of its names; null when one of them is null."""
    pieces: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(parts[name])
    return F.concat(*pieces)


def label(value: Column, labels: dict[str, str]) -> Column:
    """Display label of a value; a value without one is shown as it is."""
    return F.coalesce(F.try_element_at(literal_map(labels), value), value)


def grouped(number: Column) -> Column:
    """Whole number with a point between thousands, ties to even."""
    return F.translate(F.format_number(number, 0), ",", ".")


def format_eur(amount: Column) -> Column:
    return F.concat(grouped(amount), F.lit(" €"))


def format_amount(amount: Column) -> Column:
    """Amount as a Spanish page shows it: four-digit numbers stay ungrouped."""
    whole = F.round(amount.cast("double"), 0)
    plain = F.format_string("%.0f", whole)
    number = F.when(F.abs(whole) < 10000, plain).otherwise(grouped(whole))
    return F.when(amount.isNull(), F.lit(NO_AMOUNT)).otherwise(F.concat(number, F.lit(" €")))


def format_count(number: Column) -> Column:
    return grouped(number)


def display_amount() -> Column:
    return F.coalesce("budget_with_vat", "estimated_value")


def days_until(moment: Column, as_of: Column) -> Column:
    """Days from `as_of`, any started day counting as a whole one; null without a date."""
    micros = F.unix_micros(moment) - F.unix_micros(as_of)
    return F.ceil(micros / F.lit(86400000000)).cast("bigint")


def urgency(days: Column) -> Column:
    return (
        F.when(days.isNull(), "none")
        .when(days < 0, "closed")
        .when(days <= CRITICAL_DAYS, "critical")
        .when(days <= SOON_DAYS, "soon")
        .otherwise("comfortable")
    )


def deadline_text(days: Column) -> Column:
    return (
        F.when(days.isNull(), NO_DEADLINE)
        .when(days < 0, DEADLINE_PASSED)
        .when(days == 0, DUE_TODAY)
        .when(days == 1, ONE_DAY_LEFT)
        .otherwise(fill(DAYS_LEFT, days=days.cast("string")))
    )
