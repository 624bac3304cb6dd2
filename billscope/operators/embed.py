"""Texts to vectors, and how well a text's parts match its themes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, NGram, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billscope.functions.vectors import cosine, dot, length_weights, norm, unit

Encoder = Callable[[Sequence[str]], np.ndarray]


def encode(df: DataFrame, text: str, output: str = "vector", size: int = 256, grams: int = 3) -> DataFrame:
    """Hashed character n-gram vector of length one, worked out in the JVM."""
    out = df.withColumn("_chars", F.split(F.lower(text), ""))
    out = NGram(n=grams, inputCol="_chars", outputCol="_grams").transform(out)
    out = HashingTF(numFeatures=size, inputCol="_grams", outputCol="_tf").transform(out)
    out = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(out)
    return out.withColumn(output, vector_to_array("_unit")).drop("_chars", "_grams", "_tf", "_unit")


def encode_with(df: DataFrame, text: str, encoder: Encoder, output: str = "vector") -> DataFrame:
    """Vectors from a user's model, a batch of rows at a time.

    A text column gives one vector per row, an array column one vector per element.
    """
    many = isinstance(df.schema[text].dataType, T.ArrayType)
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(vector) if many else vector)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = [list(c) if c is not None else [] for c in batch[text]] if many else [[t or ""] for t in batch[text]]
            flat = [t for cell in cells for t in cell]
            vectors = np.asarray(encoder(flat), dtype=float) if flat else np.zeros((0, 0))
            ends = np.cumsum([len(cell) for cell in cells])
            per_row = [[v.tolist() for v in vectors[end - len(cell):end]] for cell, end in zip(cells, ends)]
            yield batch.assign(**{output: per_row if many else [rows[0] for rows in per_row]})

    return df.mapInPandas(run, schema)


# Fixed value: the letters of the built-in profile.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_profile(text: Column, letters: str = LETTERS) -> Column:
    """How often each letter occurs in a lower-case text: a cheap stand-in vector.

    The letters take one byte each, so the bytes lost by removing one are its count.
    """
    whole = F.octet_length(text)
    return F.array(*[
        (whole - F.octet_length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in letters
    ])


def letter_profiles(texts: Column) -> Column:
    """Profiles of an array of texts, case ignored."""
    return F.transform(F.transform(texts, lambda t: F.lower(t)), lambda t: letter_profile(t))


def similarity_matrix(left: Column, right: Column) -> Column:
    """Cosine of every left vector with every right vector, as one array per left vector."""
    return F.transform(left, lambda a: F.transform(right, lambda b: cosine(a, b)))


def weighted_best_similarity(
    df: DataFrame, parts: str, part_vectors: Column, theme_vectors: Column, output: str = "similarity"
) -> DataFrame:
    """For each part its best cosine over the row's themes, averaged by part length.

    Everything stays inside the row, so no part or theme is ever shuffled. A row without
    parts or themes gets 0 and has no effect on other rows.
    """
    out = df.withColumn("_pv", part_vectors).withColumn("_tv", F.transform(theme_vectors, lambda t: unit(t)))
    best = F.transform("_pv", lambda p: F.coalesce(
        F.try_divide(F.array_max(F.transform("_tv", lambda t: dot(p, t))), norm(p)), F.lit(0.0)
    ))
    weighted = F.zip_with(best, F.col("_weights"), lambda s, w: s * w)
    score = F.aggregate(weighted, F.lit(0.0), lambda a, b: a + b)
    empty = (F.coalesce(F.size("_pv"), F.lit(0)) <= 0) | (F.coalesce(F.size("_tv"), F.lit(0)) <= 0)
    out = out.withColumn("_weights", length_weights(F.col(parts)))
    return out.withColumn(
        output, F.when(empty, F.lit(0.0)).otherwise(F.coalesce(score, F.lit(0.0)))
    ).drop("_pv", "_tv", "_weights")
