"""Vectors as arrays of doubles: higher-order functions, no Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero norms."""
    product = norm(a) * norm(b)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (product > 0), dot(a, b) / product).otherwise(F.lit(0.0))


def normalised(a: Column) -> Column:
    """To length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def hashed(tokens: Column, dims: int = 512) -> Column:
    """Signed feature hashing of tokens into dims places, to length 1; the sign is the hash's low bit. Hashes are Spark's; they are summed by place in one pass over the tokens."""
    codes = F.transform(tokens, lambda t: (F.pmod(F.shiftright(F.xxhash64(t), 1), F.lit(dims)) * 2 + F.pmod(F.xxhash64(t), F.lit(2))).cast("int"))

    @F.pandas_udf("array<double>")
    def summed(rows: pd.Series) -> pd.Series:
        def one(row) -> np.ndarray:
            x = np.asarray(row if row is not None else (), np.int64)
            out = np.bincount(x >> 1, weights=(x & 1) * 2.0 - 1, minlength=dims).astype(float)
            n = np.sqrt((out * out).sum())
            return out / n if n else out

        return rows.map(one)

    return summed(codes)
