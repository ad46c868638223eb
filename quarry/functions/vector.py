"""Vector functions as Column builders, and the hashed bag-of-words embedding."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

DIM = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def normalise(a: Column) -> Column:
    """The vector at length 1; its elements are null if it has no length."""
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.try_divide(x, n))), 1)


def term_slot(term: Column) -> Column:
    """The dimension of a term."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % DIM).cast("int")


def term_sign(term: Column) -> Column:
    return F.when(F.substring(F.md5(term), 9, 1) < "8", 1).otherwise(-1)


@F.pandas_udf(S.ArrayType(S.DoubleType()))
def hash_embed(texts: pd.Series) -> pd.Series:
    """Unit vectors of hashed bags of words: what stands in for a model; a UDF around one takes its place."""
    out = np.zeros((len(texts), DIM))
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", (t or "").lower()):
            h = zlib.crc32(w.encode())
            out[i, h % DIM] += 1 if h >> 16 & 1 else -1
    norm = np.linalg.norm(out, axis=1)[:, None]
    return pd.Series(list(out / np.where(norm > 0, norm, 1)))
