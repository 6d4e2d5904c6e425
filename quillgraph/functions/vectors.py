"""Vector functions over array<float> columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import strip_html


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; 0 where sizes differ or a side is null."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(0.0))


def cosine_normalised(a: Column, b: Column) -> Column:
    """VE3: for vectors of norm 1 the cosine is the dot product, as a float."""
    return dot(a, b).cast("float")


def norm(v: Column) -> Column:
    """AG12."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """VE2's last step: double norm, float result; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x).cast("float"))


def passage(title: Column, snippet: Column, limit: int = 600) -> Column:
    """VE4."""
    return F.substring(F.concat(title, F.lit(". "), strip_html(snippet)), 1, limit)


def embed(text: Column, model: Callable[[list[str]], list[list[float]]], prefix: str) -> Column:
    """VE1: vectors of "query: " or "passage: " texts by a pluggable model, in Arrow batches."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model(s.fillna("").tolist()))

    return run(F.concat(F.lit(f"{prefix}: "), F.trim(text)))
