"""Queries of this subpackage by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": q.p2_found,
        "p2_classes": q.p2_classes,
        "p2_unified": q.p2_unified,
        "p3_found": q.p3_found,
        "p3_clean": q.p3_clean,
        "p3_validation": q.p3_validation,
        "p4_found": q.p4_found,
        "p4_clean": q.p4_clean,
        "p5_found": q.p5_found,
        "p5_wrappers": q.p5_wrappers,
        "p6_packed": q.p6_packed,
        "p6_fill": q.p6_fill,
        "p7_mixture": q.p7_mixture,
        "p7_shares": q.p7_shares,
        "p8_found": q.p8_found,
        "p8_stats": q.p8_stats,
    }


def oracle_sql() -> dict[str, str]:
    return {}
