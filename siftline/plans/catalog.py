"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from siftline.plans import dense, evaluation, features, fusion, geo, lexical, params, split_build, splits  # noqa: F401
from siftline.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
