"""Extraction JSON: closed-schema parsing and the rewrite between its two stored shapes.

For the rewrite a text is taken apart once into its blocks, each still as text; whatever
needs a closer look is then parsed from its own block. For parsing, the typed value comes
from one reading of the text, and the shape is checked on a variant, which is parsed once
and then only looked into.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeworks import schemas

KEEP_NULLS = {"ignoreNullFields": "false"}
REQUIRED = "required_to_bid"
_BLOCKS = schemas.EXTRACTION.fieldNames()
_SHARED = "certifications_citation"
_TEXTS = T.StructType([T.StructField(n, T.StringType()) for n in (*_BLOCKS, _SHARED)])
_CERTIFICATIONS = schemas.EXTRACTION["certifications"].dataType


def to_text(extraction: Column) -> Column:
    """JSON text of a typed extraction; null fields keep their keys."""
    return F.to_json(extraction, KEEP_NULLS)


def _same_keys(keys: Column, kind: T.StructType) -> Column:
    return F.sort_array(keys) == F.array(*[F.lit(n) for n in sorted(kind.fieldNames())])


_MEMBERS = "map<string,variant>"


def _members(value: Column, path: str = "$", kind: str = _MEMBERS) -> Column:
    """The members of the object at a path of a variant; null if there is no object."""
    return F.try_variant_get(value, path, kind)


def _closed_object(members: Column, kind: T.StructType) -> Column:
    """Whether the members of an object have exactly the keys of a schema, citations included."""
    found = [_same_keys(F.map_keys(members), kind)]
    for field in kind.fields:
        member = F.try_element_at(members, F.lit(field.name))
        if isinstance(field.dataType, T.StructType):
            found.append(F.coalesce(_same_keys(F.map_keys(_members(member)), field.dataType), F.lit(True)))
        elif isinstance(field.dataType, T.ArrayType):
            found.append(_closed_items(_members(member, kind=f"array<{_MEMBERS}>"), field.dataType.elementType))
    return reduce(lambda a, b: a & b, found)


def _closed_items(items: Column, kind: T.StructType) -> Column:
    return F.coalesce(F.forall(items, lambda m: _closed_object(m, kind)), F.lit(True))


def parse_extraction(rows: DataFrame, column: str = "extraction_json") -> DataFrame:
    """Typed extraction of a JSON text, or why it is refused.

    Refused are texts that are no JSON, name a key twice or hold a value of a wrong type
    ("malformed"), and objects with a missing or an unknown key ("keys").
    """
    corrupt = "_corrupt_record"
    reading = T.StructType([*schemas.EXTRACTION.fields, T.StructField(corrupt, T.StringType())])
    parsed = rows.withColumn(
        "parsed",
        F.from_json(column, reading, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}),
    ).withColumn("shape", F.try_parse_json(F.col(column)))
    objects = [n for n in _BLOCKS if isinstance(schemas.EXTRACTION[n].dataType, T.StructType)]
    for name in objects:
        parsed = parsed.withColumn(f"m_{name}", _members(F.col("shape"), f"$.{name}"))
    conditions = [
        _same_keys(F.map_keys(_members(F.col("shape"))), schemas.EXTRACTION),
        *[_closed_object(F.col(f"m_{n}"), schemas.EXTRACTION[n].dataType) for n in objects],
        _closed_items(_members(F.col("shape"), "$.certifications", f"array<{_MEMBERS}>"), schemas.CERTIFICATION),
    ]
    closed = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(True)) for c in conditions])
    refusal = F.when(
        F.col("parsed").isNull() | F.col("shape").isNull() | F.col(f"parsed.{corrupt}").isNotNull(), "malformed"
    ).when(~closed, "keys")
    blocks = F.struct(*[F.col(f"parsed.{n}").alias(n) for n in _BLOCKS])
    return (
        parsed.withColumn("refusal", refusal)
        .withColumn("extraction", F.when(F.col("refusal").isNull(), blocks))
        .drop("parsed", "shape", *[f"m_{n}" for n in objects])
    )


def _assembled(blocks: dict[str, Column]) -> Column:
    """JSON text of an object whose member values are given as JSON texts."""
    parts: list[Column] = []
    for position, (name, value) in enumerate(blocks.items()):
        lead = "{" if position == 0 else ","
        parts += [F.lit(f'{lead}"{name}":'), F.coalesce(value, F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def _is_list_of(text: Column, first: str) -> Column:
    """Whether a JSON text is an array that is empty or starts with the given character."""
    return F.coalesce(text.rlike(rf"\A\s*\[\s*(?:\]|{first})"), F.lit(False))


def reshape_up(rows: DataFrame, column: str = "extraction_json") -> DataFrame:
    """Rewrites the older shape: names with one shared citation become objects.

    The shared citation goes to the first certification only. The two deadline
    fields are added as nulls where missing. Text in the newer shape is left as
    it is, so a second run changes nothing.
    """
    taken = rows.withColumn("b", F.from_json(column, _TEXTS))
    old_list = _is_list_of(F.col("b.certifications"), '"')
    lacks = ~F.array_contains(
        F.json_object_keys("b.execution_deadline"), "extensions_allowed"
    )
    flagged = taken.withColumn("old_list", old_list).withColumn(
        "lacks_fields", F.coalesce(lacks, F.lit(False))
    )
    shared = F.from_json(F.col(f"b.{_SHARED}"), schemas.CITATION)
    with_parts = flagged.withColumn("shared", F.when(F.col("old_list"), shared))
    objects = F.transform(
        F.from_json("b.certifications", "array<string>"),
        lambda n, i: F.struct(
            n.alias("name"),
            F.lit(REQUIRED).alias("role"),
            F.when(i == 0, F.col("shared")).alias("citation"),
        ),
    )
    added = '"extensions_allowed":null,"extensions_description":null}'
    deadline = F.regexp_replace("b.execution_deadline", r"\s*\}\s*\z", "," + added)
    deadline = F.regexp_replace(deadline, r"\A\s*\{\s*,", "{")
    blocks = {n: F.col(f"b.{n}") for n in _BLOCKS}
    blocks["certifications"] = F.when(
        F.col("old_list"), F.to_json(objects, KEEP_NULLS)
    ).otherwise(F.col("b.certifications"))
    blocks["execution_deadline"] = F.when(F.col("lacks_fields"), deadline).otherwise(
        F.col("b.execution_deadline")
    )
    changed = F.col("old_list") | F.col("lacks_fields")
    return with_parts.withColumn(
        column, F.when(changed, _assembled(blocks)).otherwise(F.col(column))
    ).drop("b", "old_list", "lacks_fields", "shared")


def reshape_down(rows: DataFrame, column: str = "extraction_json") -> DataFrame:
    """Back to names and one citation, the first one's. Roles are lost."""
    taken = rows.withColumn("b", F.from_json(column, _TEXTS)).withColumn(
        "items", F.from_json("b.certifications", _CERTIFICATIONS)
    )
    is_new = _is_list_of(F.col("b.certifications"), r"\{")
    first = F.get(F.transform("items", lambda c: c["citation"]), F.lit(0))
    deadline = F.to_json(
        F.from_json("b.execution_deadline", schemas.EXTRACTION_OLD["execution_deadline"].dataType),
        KEEP_NULLS,
    )
    blocks = {n: F.col(f"b.{n}") for n in _BLOCKS}
    blocks["certifications"] = F.to_json(F.transform("items", lambda c: c["name"]), KEEP_NULLS)
    blocks["execution_deadline"] = deadline
    blocks[_SHARED] = F.to_json(first, KEEP_NULLS)
    return taken.withColumn(
        column, F.when(is_new, _assembled(blocks)).otherwise(F.col(column))
    ).drop("b", "items")
