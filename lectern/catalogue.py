"""Queries of the course-knowledge operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.queries.activity import ACTIVITY
from lectern.queries.boundaries import BOUNDARIES
from lectern.queries.documents import DOCUMENTS
from lectern.queries.imports import IMPORTS
from lectern.queries.keyed import KEYED
from lectern.queries.pages import PAGES
from lectern.queries.prompts import PROMPTS
from lectern.queries.retrieval import RETRIEVAL
from lectern.queries.segments import SEGMENTS
from lectern.queries.texts import TEXTS
from lectern.queries.upkeep import UPKEEP
from lectern.queries.works import WORKS

ALL = RETRIEVAL | ACTIVITY | DOCUMENTS | PAGES | UPKEEP | TEXTS | WORKS | BOUNDARIES | KEYED | IMPORTS | PROMPTS | SEGMENTS


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked evidence for each question."""
    return ALL["retrieve_topk"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(ALL)


def oracle_sql() -> dict[str, str]:
    return {name: query.oracle() for name, query in ALL.items() if query.sql is not None}
