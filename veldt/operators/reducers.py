"""User reducers and visitors: state that each partition builds from whole batches and that is merged once by group."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Reducer(Protocol):
    """State is a list of floats. add takes a batch of values; zeros, where given, a number of structural zeros."""

    def start(self) -> list[float]: ...

    def add(self, state: list[float], values: np.ndarray) -> list[float]: ...

    def merge(self, a: list[float], b: list[float]) -> list[float]: ...

    def result(self, state: list[float]) -> float: ...


class Visitor(Protocol):
    """As a reducer, with the places of the values: add takes a batch's index arrays and values."""

    def start(self) -> list[float]: ...

    def add(self, state: list[float], places: list[np.ndarray], values: np.ndarray) -> list[float]: ...

    def merge(self, a: list[float], b: list[float]) -> list[float]: ...


def reduced(df: DataFrame, keys: list[str], reducer: Reducer, size: int | None = None) -> DataFrame:
    """(keys, v): the reducer's result of v by keys. With a size, groups of fewer entries have structural zeros, which go to reducer.zeros."""
    fields = "".join(f"{k} long, " for k in keys)

    def partial(frames):
        held: dict[tuple, tuple[list[float], int]] = {}
        for pdf in frames:
            groups = pdf.groupby(keys) if keys else [((), pdf)]
            for key, part in groups:
                key = key if isinstance(key, tuple) else (key,)
                state, n = held.get(key, (reducer.start(), 0))
                held[key] = (reducer.add(state, part["v"].to_numpy(float)), n + len(part))
        if held:
            yield pd.DataFrame([(*map(int, k), [float(x) for x in s], n) for k, (s, n) in held.items()], columns=[*keys, "state", "n"])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        states = [list(s) for s in pdf["state"]]
        state = states[0]
        for other in states[1:]:
            state = reducer.merge(state, other)
        missing = (size or 0) - int(pdf["n"].sum())
        if missing > 0:
            state = reducer.zeros(state, missing)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "v": [float(reducer.result(state))]})

    parts = df.select(*keys, "v").mapInPandas(partial, f"{fields}state array<double>, n long")
    grouped = parts.groupBy(*keys) if keys else parts.groupBy((F.col("n") * 0).alias("_all"))
    return grouped.applyInPandas(final, f"{fields}v double")


def visited(df: DataFrame, places: list[str], visitor: Visitor) -> DataFrame:
    """(state): one row, the visitor's state after all stored entries; batches come in no order."""

    def partial(frames):
        state, seen = visitor.start(), False
        for pdf in frames:
            if len(pdf):
                state, seen = visitor.add(state, [pdf[c].to_numpy() for c in places], pdf["v"].to_numpy(float)), True
        if seen:
            yield pd.DataFrame({"state": [[float(x) for x in state]]})

    def final(frames):
        state = visitor.start()
        for pdf in frames:
            for other in pdf["state"]:
                state = visitor.merge(state, list(other))
        yield pd.DataFrame({"state": [[float(x) for x in state]]})

    # a row per partition is left for the one task that merges
    return df.select(*places, "v").mapInPandas(partial, "state array<double>").repartition(1).mapInPandas(final, "state array<double>")
