"""Text rules. Character classes are spelled out so that every engine agrees on them."""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeworks.functions.display import fill

SPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"
UNIT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ ]"
WORD = r"[\p{L}\p{N}]+"

# Longest text kept whole, and the note after a cut one.
MASK_LIMIT = 500
MASK_NOTE = "{start}... [{length} caracteres, truncado]"


def collapse(text: Column) -> Column:
    """Every run of white space becomes one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def comparable(text: Column) -> Column:
    return F.lower(collapse(text))


def units(comparable_text: Column) -> Column:
    """Words and single symbols of a text that went through `comparable`."""
    return F.regexp_extract_all(comparable_text, F.lit(UNIT), F.lit(0))


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE + "+", ""))


@lru_cache(maxsize=1)
def spanish_stopwords() -> tuple[str, ...]:
    """The stop word list that ships with Spark."""
    return tuple(sorted(set(StopWordsRemover.loadDefaultStopWords("spanish"))))


def raw_words(text: Column) -> Column:
    """Lowercase words in text order, stop words and repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def mask_long(text: Column, limit: int = MASK_LIMIT) -> Column:
    """Long text cut at `limit` characters with a note of its full length."""
    length = F.length(text).cast("string")
    noted = fill(MASK_NOTE, start=F.substring(text, 1, limit), length=length)
    return F.when(F.length(text) > limit, noted).otherwise(text)


def mask_long_deep(value: Column, kind: T.DataType, limit: int = MASK_LIMIT) -> Column:
    """Long text cut wherever it stands in a nested value of the given type; the shape stays."""
    if isinstance(kind, T.StringType):
        return mask_long(value, limit)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: mask_long_deep(x, kind.elementType, limit))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: mask_long_deep(x, kind.valueType, limit))
    if isinstance(kind, T.StructType):
        fields = [mask_long_deep(value[f.name], f.dataType, limit).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def mask_long_all(texts: Column, limit: int = MASK_LIMIT) -> Column:
    return F.transform(texts, lambda t: mask_long(t, limit))


def split_list(field: Column) -> Column:
    """A comma or newline separated field as trimmed, non-empty entries."""
    parts = F.transform(F.split(field, r"[,\n]"), lambda e: F.regexp_replace(e, f"^{SPACE}+|{SPACE}+$", ""))
    return F.filter(parts, lambda e: e != "")


def parse_amount(field: Column) -> Column:
    """A form amount with decimal comma; blank means not declared."""
    dotted = F.replace(F.trim(field), F.lit(","), F.lit("."))
    return dotted.try_cast("decimal(14,2)")
