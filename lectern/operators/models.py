"""The places where speech and speaker models are plugged in; any function of values will do."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(loaders: dict[str, Callable[[], Callable]]) -> dict[str, Callable]:
    """The models that load, by name, in the order given.  None is an error; one alone, a warning: it cannot be outvoted."""
    found = {}
    for name, load in loaders.items():
        try:
            found[name] = load()
        except Exception as e:  # noqa: BLE001  whatever a model's loading raises
            warnings.warn(f"{name} is left out: {e}", stacklevel=2)
    if not found:
        raise RuntimeError("no model could be loaded")
    if len(found) == 1:
        warnings.warn("a single model judges alone", stacklevel=2)
    return found


def transcripts(takes: DataFrame, models: dict[str, Callable]) -> DataFrame:
    """(chunk_id, take, verifier, verifier_ord, transcript) of takes (chunk_id, take, audio): what each model hears in each, null where it failed."""

    def heard(model: Callable):
        @F.pandas_udf(T.StringType())
        def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            def one(x):
                try:
                    return model(x)
                except Exception:  # noqa: BLE001  a take that a model fails on
                    return None

            for s in batches:
                yield s.map(one)

        return work

    rows = takes.select("chunk_id", "take", "audio")
    each = [rows.select("chunk_id", "take", F.lit(name).alias("verifier"), F.lit(i).alias("verifier_ord"), heard(model)("audio").alias("transcript")) for i, (name, model) in enumerate(models.items())]
    return reduce(DataFrame.unionByName, each)


def embeddings(takes: DataFrame, model: Callable) -> DataFrame:
    """(chunk_id, take, embedding) of takes (chunk_id, take, audio), null where the model failed."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(x):
            try:
                return [float(v) for v in model(x)]
            except Exception:  # noqa: BLE001  a take that the model fails on
                return None

        for s in batches:
            yield s.map(one)

    return takes.select("chunk_id", "take", work("audio").alias("embedding"))
