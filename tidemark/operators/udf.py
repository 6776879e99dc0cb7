"""User functions: frame functions by partition and Python metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.operators.evaluation import METRICS, regression_metrics, register_metric


def apply_by_partition(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """Apply a pandas frame function to Arrow batches of every partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def register_sum_metric(name: str, term: Callable[[Column, Column], Column], finish: Callable[[Column], Column] = lambda c: c) -> None:
    """A metric that is the weighted mean of a row term, finished by a function of the mean."""
    register_metric(name, lambda y, p, w: finish(F.try_divide(F.sum(w * term(y, p)), F.sum(w))))


def evaluate(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return regression_metrics(df, keys, names=names)


def registered() -> list[str]:
    return sorted(METRICS)
