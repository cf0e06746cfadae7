"""JSON re-indentation."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _indented(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        indented = json.dumps(json.loads(text), indent=2, ensure_ascii=False)
        indented.encode("utf-8")  # an escaped lone surrogate has no UTF-8 form
        return indented
    except (ValueError, RecursionError):
        return text


@F.pandas_udf(T.StringType())
def indent_json(texts: pd.Series) -> pd.Series:
    """Valid JSON indented by two, keys in their order; anything else unchanged."""
    return texts.map(_indented)


def normalize_json(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, indent_json(F.col(column)))
