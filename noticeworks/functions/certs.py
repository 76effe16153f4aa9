"""Names of certifications: tokens, recognised schemes, comparable identities."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeworks.functions.codes import literal_map

# Fixed value: the scheme families a requirement names, without regard to case.
FORMAL = r"(?:ISO/?\s?IEC|ISO|UNE(?:[-\s]?EN)?|EN)\s?\d{4,5}|CMMI|ENS\b|CCN-?CERT|ENAC"
# Fixed value: the number of a standard.
NUMBER = r"\d{4,5}"
_FORMAL = "(?iU)" + FORMAL


@lru_cache(maxsize=1)
def folding() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to one ASCII character, that character, and all longer decompositions."""
    accented, plain, longer = [], [], {}
    for point in range(0x80, 0x110000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        decomposed = unicodedata.normalize("NFKD", chr(point))
        base = "".join(c for c in decomposed if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalnum():
            accented.append(chr(point))
            plain.append(base)
        elif any(c.isascii() and c.isalnum() for c in base):
            longer[chr(point)] = base
    return "".join(accented), "".join(plain), longer


def _plain_text(text: Column) -> Column:
    accented, plain, longer = folding()
    opened = F.regexp_replace(text, r"\p{Mn}+", "")
    # A class of that many characters in a pattern costs far more than translating them away.
    holds_longer = F.length(F.translate(opened, "".join(longer), "")) < F.length(opened)
    spelled = F.transform(
        F.split(opened, ""), lambda c: F.coalesce(F.try_element_at(literal_map(longer), c), c)
    )
    # Few texts hold a character that becomes several; only those are taken apart.
    return F.translate(F.when(holds_longer, F.array_join(spelled, "")).otherwise(opened), accented, plain)


def fold(text: Column) -> Column:
    """Lowercase text without accents; a character such as a ligature becomes all its letters."""
    return F.lower(_plain_text(text))


def word_list(name: Column) -> Column:
    return F.regexp_extract_all(fold(name), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(name: Column) -> Column:
    return F.array_distinct(word_list(name))


def normalized_name(name: Column) -> Column:
    return F.array_join(word_list(name), " ")


def is_formal(name: Column) -> Column:
    """Whether a name belongs to a recognised scheme; the list is closed on purpose."""
    return name.rlike(_FORMAL)


def identities(name: Column) -> Column:
    """The numbers of the standards a name claims, a family without one, or the whole name."""
    marks = F.regexp_extract_all(name, F.lit(_FORMAL), F.lit(0))

    def identity(mark: Column) -> Column:
        digits = F.regexp_extract(mark, NUMBER, 0)
        return F.coalesce(F.nullif(digits, F.lit("")), normalized_name(mark))

    return F.when(F.size(marks) == 0, F.array(normalized_name(name))).otherwise(
        F.array_distinct(F.transform(marks, identity))
    )


def blocking_identities(certifications: Column, role: str) -> Column:
    """Sorted identities of the certifications in a role."""
    chosen = F.filter(certifications, lambda c: c["role"] == role)
    return F.sort_array(
        F.array_distinct(F.flatten(F.transform(chosen, lambda c: identities(c["name"]))))
    )


def covers(a: Column, b: Column) -> Column:
    """Whether one token set contains the other, whichever is the smaller."""
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def satisfied(required: Column, held: Column) -> Column:
    """Whether any held certification, given as token sets, matches the required one."""
    return F.coalesce(F.exists(held, lambda h: covers(required, h)), F.lit(False))
