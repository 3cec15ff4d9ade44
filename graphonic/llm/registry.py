"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, html_wrappers, licenses, lm_scoring, packing, sharding, simhash, token_files, topk, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_exact_top_k": topk.op2_exact_top_k,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_sharding": sharding.op5_sharding,
    "op6_html_extraction": html_wrappers.op6_html_extraction,
    "op7_lm_scoring": lm_scoring.op7_lm_scoring,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_packing": packing.op9_packing,
    "op10_token_files": token_files.op10_token_files,
}

ORACLE_SQL = {"op1_license_scan": licenses.ORACLE, "op2_exact_top_k": topk.ORACLE}
