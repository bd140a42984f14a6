"""Samples by hash: a row is in or out by its key alone, so a sample can be drawn again, and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(key: str, seed: int = 0) -> Column:
    """A number from 0 up to 2**32 for each key, by the first eight hexadecimal digits of the MD5 of ``seed:key``."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def hashed_sample(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """About ``share`` of the distinct keys, with all of their rows; null keys are never in. Larger shares hold smaller ones."""
    return rows.where(place(key, seed) < F.lit(round(share * (1 << 32))))


def hashed_strata(rows: DataFrame, key: str, stratum: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """The same with a share for each value of ``stratum``; values without a share, and nulls, are left out."""
    most = F.coalesce(*[F.when(F.col(stratum) == name, F.lit(round(share * (1 << 32)))) for name, share in shares.items()], F.lit(0))
    return rows.where(place(key, seed) < most)
