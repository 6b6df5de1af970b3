"""Settings of a run; environment variables and Spark settings override the defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    tolerance: int = 100  # minor units that entries sharing a reference may differ by
    lag_days: int = 2  # usual days from sale to payout
    max_payout_lag_days: int = 60
    slack: int = 2  # minor units that independently rounded fees may miss an identity by
    accept: float = 0.72  # lowest score of a residual pair
    pair_window: int = 40  # rows above which an amount window is too crowded to pair in
    pool: int = 60  # units above which no subset is looked for; 0: none of this and the next two limits
    candidates: int = 8
    combinations: int = 400_000
    split_size: int = 6
    merge_size: int = 4
    max_rows: int = 50_000  # of an upload
    agent_rows: int = 150  # residual entries above which an outside resolver isn't asked
    agent_batch: int = 150  # entries that it is shown at a time

    def updated(self, values: dict[str, str]) -> Settings:
        """With the named values; those that don't parse keep their default."""
        new = {}
        for f in fields(self):
            if f.name in values:
                try:
                    new[f.name] = type(getattr(self, f.name))(values[f.name])
                except ValueError:
                    continue
        return replace(self, **new)

    @classmethod
    def of(cls, spark: SparkSession | None = None) -> Settings:
        env = {f.name: os.environ[k] for f in fields(cls) if (k := f"TIEOUT_{f.name.upper()}") in os.environ}
        out = cls().updated(env)
        if spark is not None:
            out = out.updated({f.name: v for f in fields(cls) if (v := spark.conf.get(f"tieout.{f.name}", None)) is not None})
        return out
