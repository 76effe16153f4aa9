"""Classification codes and the closed code lists of the notice format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Official code lists and the division that scopes ingestion.
CONTRACT_TYPES = {
    "1": "supplies",
    "2": "services",
    "3": "works",
    "21": "public_services_management",
    "22": "services_concession",
    "31": "public_works_concession",
    "32": "works_concession",
    "40": "public_private_collaboration",
    "7": "special_administrative",
    "8": "private",
    "50": "patrimonial",
}
STATUSES = {
    "PRE": "prior_notice",
    "PUB": "open_for_submission",
    "EV": "pending_award",
    "ADJ": "awarded",
    "RES": "resolved",
    "ANUL": "cancelled",
}
PROCEDURES = {
    "1": "Abierto",
    "2": "Restringido",
    "3": "Negociado sin publicidad",
    "4": "Negociado con publicidad",
    "5": "Diálogo competitivo",
    "6": "Contrato menor",
    "7": "Derivado de acuerdo marco",
    "8": "Concurso de proyectos",
    "9": "Abierto simplificado",
    "10": "Asociación para la innovación",
    "11": "Derivado de asociación para la innovación",
    "12": "Basado en un sistema dinámico de adquisición",
    "13": "Licitación con negociación",
    "100": "Normas internas",
    "999": "Otros",
}
CODE_LISTS = {"contract_type": CONTRACT_TYPES, "status": STATUSES, "procedure": PROCEDURES}
IT_DIVISION = "72"
FULL_CODE_LENGTH = 8


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])


def label_of(code: Column, mapping: dict[str, str]) -> Column:
    """Label of a code from a closed list; null when the code is unknown."""
    return F.try_element_at(literal_map(mapping), code)


def normalize_code(code: Column) -> Column:
    """A classification code without its check digit."""
    return F.trim(F.substring_index(code, "-", 1))


def normalize_codes(codes: Column) -> Column:
    return F.array_distinct(F.transform(codes, normalize_code))


def any_code_startswith(codes: Column, prefix: str) -> Column:
    return F.exists(codes, lambda c: F.startswith(normalize_code(c), F.lit(prefix)))


def in_it_division(codes: Column) -> Column:
    return any_code_startswith(codes, IT_DIVISION)


def has_code(codes: Column, wanted: str) -> Column:
    """Exact containment for a full code, prefix search for a shorter one."""
    normalized = wanted.split("-")[0].strip()
    if len(normalized) == FULL_CODE_LENGTH:
        return F.exists(codes, lambda c: normalize_code(c) == F.lit(normalized))
    return any_code_startswith(codes, normalized)
