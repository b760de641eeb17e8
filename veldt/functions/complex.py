"""Complex numbers as struct(re, im)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def real(z: Column) -> Column:
    return z["re"]


def imag(z: Column) -> Column:
    return z["im"]


def conj(z: Column) -> Column:
    return make(z["re"], -z["im"])


def add(a: Column, b: Column) -> Column:
    return make(a["re"] + b["re"], a["im"] + b["im"])


def mul(a: Column, b: Column) -> Column:
    return make(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def abs2(z: Column) -> Column:
    return z["re"] * z["re"] + z["im"] * z["im"]


def absolute(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def arg(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def sign(z: Column) -> Column:
    """z / |z|, and 0 for 0."""
    size = absolute(z)
    safe = F.when(size == 0, F.lit(1.0)).otherwise(size)
    return make(z["re"] / safe, z["im"] / safe)


def exp(z: Column) -> Column:
    return make(F.exp(z["re"]) * F.cos(z["im"]), F.exp(z["re"]) * F.sin(z["im"]))
