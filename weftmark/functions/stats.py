"""Statistics that Spark has no built-in for, written as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def student_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p value of Student's t for whole degrees of freedom.

    Abramowitz and Stegun 26.7.3 and 26.7.4: with theta = atan(t / sqrt(df)) the central probability is a
    finite sum of cosine powers, so no special function is needed. Each step multiplies the previous term.
    """
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    sin, cos2 = F.sin(theta), F.pow(F.cos(theta), F.lit(2.0))
    odd = (df % 2) == 1

    def partial_sum(first: Column, numer, denom, last: Column) -> Column:
        start = F.struct(first.alias("term"), first.alias("total"))

        def step(acc: Column, j: Column) -> Column:
            term = acc["term"] * cos2 * numer(j) / denom(j)
            return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

        steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step, lambda acc: acc["total"])

    odd_sum = partial_sum(
        F.cos(theta), lambda j: 2.0 * j, lambda j: 2.0 * j + 1.0, ((df - 3) / 2).cast("int")
    )
    even_sum = partial_sum(
        F.lit(1.0), lambda j: 2.0 * j - 1.0, lambda j: 2.0 * j, ((df - 2) / 2).cast("int")
    )
    central = (
        F.when(df == 1, theta * (2.0 / math.pi))
        .when(odd, (theta + sin * odd_sum) * (2.0 / math.pi))
        .otherwise(sin * even_sum)
    )
    return F.greatest(F.lit(0.0), F.lit(1.0) - central)


def char_entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of a short string, as a match; 0 for an empty one.

    With counts c over n characters the entropy is log2(n) - sum(c log2 c) / n. A distinct character is
    counted by how many bytes the string loses without it: one linear pass each, all inside string functions.
    """

    def of(value: Column) -> Column:
        chars = F.filter(F.array_distinct(F.split(value, "")), lambda c: c != "")

        def add(total: Column, c: Column) -> Column:
            lost = F.octet_length(value) - F.octet_length(F.replace(value, c, F.lit("")))
            count = lost / F.octet_length(c)
            return total + count * F.log2(count)

        size = F.length(value)
        entropy = F.log2(size) - F.aggregate(chars, F.lit(0.0), add) / size
        return F.when(size > 0, F.greatest(F.lit(0.0), entropy)).when(size == 0, F.lit(0.0))

    # as an element, the text is computed once and not anew for each character
    return F.element_at(F.transform(F.array(text), of), 1)


def text_entropy(text: Column) -> Column:
    """``char_entropy`` of whole texts of any length, in one pass over their characters.

    Arrow batches and numpy: column functions take half a microsecond and more for each character, which is most of the work on
    long texts.
    """

    @F.pandas_udf("double")
    def entropy(texts: pd.Series) -> pd.Series:
        out = np.full(len(texts), np.nan)
        for i, value in enumerate(texts):
            if value is not None:
                codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4")
                counts = np.bincount(codes) if len(codes) and codes.max() < 4 * len(codes) + 256 else np.unique(codes, return_counts=True)[1]
                counts = counts[counts > 0]
                out[i] = max(0.0, np.log2(len(codes)) - (counts * np.log2(counts)).sum() / len(codes)) if len(codes) else 0.0
        return pd.Series(out)

    return F.when(text.isNotNull(), entropy(text))
