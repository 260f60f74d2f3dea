"""Registry: query name -> (spark, sf_dir) -> DataFrame, and name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import screening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = sql


register("holdout_screening", screening.holdout_screening, screening.holdout_screening_sql())

from . import explore  # noqa: E402

for _n, (_f, _s) in explore.QUERIES.items():
    register(_n, _f, _s)

from . import signals  # noqa: E402

for _n, (_f, _s) in signals.QUERIES.items():
    register(_n, _f, _s)

from . import balance  # noqa: E402

for _n, (_f, _s) in balance.QUERIES.items():
    register(_n, _f, _s)

from . import models  # noqa: E402

for _n, (_f, _s) in models.QUERIES.items():
    register(_n, _f, _s)

from . import learning  # noqa: E402

for _n, (_f, _s) in learning.QUERIES.items():
    register(_n, _f, _s)

from . import given  # noqa: E402

for _n, (_f, _s) in given.QUERIES.items():
    register(_n, _f, _s)

from . import streams  # noqa: E402

for _n, (_f, _s) in streams.QUERIES.items():
    register(_n, _f, _s)

from . import storage  # noqa: E402

for _n, (_f, _s) in storage.QUERIES.items():
    register(_n, _f, _s)
