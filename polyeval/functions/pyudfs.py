"""Arrow-batched pandas UDFs: the only Python on the row path.

Kept in a module without ``from __future__ import annotations`` because
pandas UDFs read their type hints at definition time. Each one is a small
per-value helper; the surrounding work (filtering, joins, aggregation) stays
in Spark, and callers route only the rows that need Python through them.
"""

import ast

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


@pandas_udf(T.ArrayType(T.StringType()))
def literal_list(s: pd.Series) -> pd.Series:
    """B3 fallback: ``ast.literal_eval`` of a Python list literal; null when it
    is not a list or does not parse."""
    def one(x):
        if x is None:
            return None
        try:
            v = ast.literal_eval(x)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        return [str(e) for e in v] if isinstance(v, (list, tuple)) else None
    return s.map(one)


def language_detector(fn):
    """B35 with a user detector: ``fn(text) -> language code`` as one
    Arrow-batched pandas UDF (e.g. a statistical language-id library)."""
    @pandas_udf(T.StringType())
    def detect(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else fn(t))
    return detect
