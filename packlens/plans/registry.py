"""All registered queries of the listing audit and their oracle SQL, by area."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packlens.plans import q_audit, q_branches, q_intake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _area in (q_audit, q_branches, q_intake):
    QUERIES |= _area.QUERIES
    ORACLES |= _area.ORACLES
