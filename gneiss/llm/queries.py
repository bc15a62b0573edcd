"""The corpus operators' registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .codes import OP13_SQL, op13_vector_codes
from .decontamination import OP9_SQL, op9_benchmark_decontamination
from .embeddings import OP10_SQL, op10_embedding_near_dedup
from .jaccard import OP4_SQL, op4_ngram_jaccard_join
from .licenses import op5_license_scan
from .line_dedup import OP3_SQL, op3_line_dedup
from .packing import op2_best_fit_packing
from .ppm import op7_lm_scoring
from .secrets import op6_secret_scan
from .spelling import OP12_SQL, op12_spelling_variants
from .token_counts import op8_token_counts
from .topk import OP11_SQL, op11_exact_topk
from .toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_license_scan": op5_license_scan,
    "op6_secret_scan": op6_secret_scan,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_token_counts": op8_token_counts,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_exact_topk": op11_exact_topk,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op4_ngram_jaccard_join": OP4_SQL,
    "op9_benchmark_decontamination": OP9_SQL,
    "op10_embedding_near_dedup": OP10_SQL,
    "op11_exact_topk": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
