"""All queries of this subpackage and the pipeline, gathered from their modules."""

from __future__ import annotations

import corpus_pipeline
from colgauge.llm import (  # noqa: F401
    backoff_lm, best_fit_packing, feistel_pii, filter_audit, odd_sketch, pivot_search, sentencepieces, simhash, string_kernel,
    token_counts, toxic_grammar, vector_codes, weighted_mix,
)
from colgauge.llm.common import QUERIES, SQL, Query


def registered_queries() -> dict[str, Query]:
    return QUERIES | {"pipeline": corpus_pipeline.run}


def registered_sql() -> dict[str, str]:
    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
