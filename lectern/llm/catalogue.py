"""Queries of the corpus operators and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.decontamination import OP9_SQL, op9_decontamination
from lectern.llm.divergence import OP12_SQL, op12_divergence
from lectern.llm.languages import op11_language_id
from lectern.llm.licences import op8_licences, op8_sql
from lectern.llm.mixing import OP7_SQL, op7_mixing
from lectern.llm.negatives import OP13_SQL, op13_hard_negatives
from lectern.llm.pii import op4_pii
from lectern.llm.quality import op5_quality
from lectern.llm.sharding import op1_sharding
from lectern.llm.simhash import op2_simhash
from lectern.llm.suffix_dedup import op6_suffix_dedup
from lectern.llm.token_counts import op10_token_counts
from lectern.llm.toxicity import op3_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_simhash": op2_simhash,
        "op3_toxicity": op3_toxicity,
        "op4_pii": op4_pii,
        "op5_quality": op5_quality,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_mixing": op7_mixing,
        "op8_licences": op8_licences,
        "op9_decontamination": op9_decontamination,
        "op10_token_counts": op10_token_counts,
        "op11_language_id": op11_language_id,
        "op12_divergence": op12_divergence,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": OP7_SQL, "op8_licences": op8_sql(), "op9_decontamination": OP9_SQL, "op12_divergence": OP12_SQL, "op13_hard_negatives": OP13_SQL}
