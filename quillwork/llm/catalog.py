"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, exact_dedup, license_scan, media, near_dedup, packing, periodic_runs, pii, quality, secret_scan, spelling, substring_dedup, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_media_columns": media.op3_media_columns,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_pii": pii.op5_pii,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_quality": quality.op8_quality,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
SQL = {
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op11_substring_dedup": substring_dedup.OP11_SQL,
}
