"""Queries of this subpackage and their SQL, for registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmint.llm.exact_dedup import OP13_SQL, op13_exact_dedup
from quillmint.llm.merkle import OP11_SQL, op11_merkle_manifest
from quillmint.llm.minhash_dedup import op2_minhash_dedup
from quillmint.llm.nbsvm import op6_quality_classifier, op8_toxicity
from quillmint.llm.packing import op3_best_fit_packing
from quillmint.llm.pieces import op1_sentencepiece
from quillmint.llm.quality_rules import op5_quality_rules
from quillmint.llm.resampling import OP12_SQL, op12_importance_resampling
from quillmint.llm.secrets import op4_secret_scans
from quillmint.llm.substring_dedup import op9_substring_dedup
from quillmint.llm.topk import OP7_SQL, op7_exact_top_k
from quillmint.llm.warc import op10_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_secret_scans": op4_secret_scans,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_warc": op10_warc,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {"op7_exact_top_k": OP7_SQL, "op11_merkle_manifest": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_exact_dedup": OP13_SQL}
