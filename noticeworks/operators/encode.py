"""Filling in missing vectors with a text encoder that is passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from string import ascii_lowercase, ascii_uppercase, digits

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.text import SPACE

#: From a text column to a vector column; a model comes as a pandas UDF.
Encoder = Callable[[Column], Column]
_LETTERS = ascii_uppercase + ascii_lowercase + digits + "+/"


def hashing_encoder(dimension: int = 64) -> Encoder:
    """Unit vectors of hashed words, up to 64 places: no model file, no Python.

    The first two digits of a word's MD5 choose the place, the third the sign.
    """

    def encode(text: Column) -> Column:
        words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE + "+"), lambda w: w != "")
        # Twelve bits: six for the place, the last for the sign.
        bits = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 3), 16, 10).cast("int")
        letter = lambda place: F.substr(F.lit(_LETTERS), place + 1, F.lit(1))
        # A letter per word for its place, by sign: letters are counted in whole strings, so that
        # a word costs no pass over all places.
        letters = lambda found, sign: F.array_join(
            F.transform(
                F.filter(found, lambda n: n.bitwiseAND(1) == sign),
                lambda n: letter(F.pmod(F.shiftright(n, 6), F.lit(dimension))),
            ),
            "",
        )
        count = lambda string, one: F.octet_length(string) - F.octet_length(F.replace(string, one, F.lit("")))
        signed = bound(
            F.transform(words, bits), lambda found: F.struct(letters(found, 1).alias("plus"), letters(found, 0).alias("minus"))
        )
        sums = bound(
            signed,
            lambda s: F.transform(
                F.sequence(F.lit(0), F.lit(dimension - 1)),
                lambda at: count(s["plus"], letter(at)) - count(s["minus"], letter(at)),
            ),
        )
        return unit(sums)

    return encode


#: From texts to a vector for each.
Model = Callable[[list[str]], Sequence[Sequence[float]]]
_MODELS: dict[str, Model] = {}


def loaded(name: str, load: Callable[[], Model]) -> Model:
    """The model of this name, loaded when this worker first needs it and kept for its later tasks."""
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = load()
    return _MODELS[name]


def in_parts(model: Model, texts: pd.Series, batch: int) -> Iterator[pd.Series]:
    """Vectors of `batch` texts at a time; a part leaves before the next is looked at."""
    for start in range(0, len(texts), batch):
        found = model(texts.iloc[start : start + batch].fillna("").tolist())
        yield pd.Series([np.asarray(vector, np.float32) for vector in found], dtype=object)


def model_encoder(name: str, load: Callable[[], Model], batch: int = 256) -> Encoder:
    """An encoder around a model that `load` brings into a Python worker.

    The model sees `batch` texts at most at once; a null text is empty. `name` tells models apart.
    """

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(name, load)
        for texts in parts:
            yield from in_parts(model, texts, batch)

    return lambda text: encode(text.cast("string"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(sums: Column) -> Column:
    """A vector of whole numbers brought to length one; the zero vector stays."""

    def length(v: Column) -> Column:
        squares = F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * x)
        return F.greatest(F.sqrt(squares), F.lit(1e-9))

    divided = lambda v: bound(length(v), lambda n: F.transform(v, lambda x: x / n))
    return bound(sums, divided).cast("array<float>")


def encode_texts(rows: DataFrame, text: str, encoder: Encoder, output: str = "embedding") -> DataFrame:
    """Adds the vector of a text column; equal texts are encoded once.

    Copies are folded by content hash before the encoder, and only the hash and
    the vector travel back to them.
    """
    hashed = rows.withColumn("text_hash", F.sha2(F.col(text).cast("binary"), 256))
    distinct = hashed.groupBy("text_hash").agg(F.first(text).alias("distinct_text"))
    vectors = distinct.select("text_hash", encoder(F.col("distinct_text")).alias(output))
    return hashed.join(vectors, "text_hash").drop("text_hash")


def backfill_vectors(rows: DataFrame, key: str, text: str, encoder: Encoder) -> DataFrame:
    """Rows whose vector is null get one; the others keep theirs."""
    missing = rows.filter(F.col("embedding").isNull()).select(key, text)
    fresh = encode_texts(missing, text, encoder, "fresh").select(key, "fresh")
    return rows.join(fresh, key, "left").withColumn(
        "embedding", F.coalesce("embedding", "fresh")
    ).drop("fresh")
