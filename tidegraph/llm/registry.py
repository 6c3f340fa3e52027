"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, exact_dedup, license_scan, maxscore, mixing, quality, secret_scan, simhash, substring_dedup, url_filter


def queries() -> dict:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_quality": quality.op3_quality,
        "op4_maxscore": maxscore.op4_maxscore,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_byte_bpe": byte_bpe.op7_byte_bpe,
        "op8_simhash_dedup": simhash.op8_simhash_dedup,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict:
    return {
        "op1_license_scan": license_scan.OP1_SQL,
        "op2_substring_dedup": substring_dedup.OP2_SQL,
        "op4_maxscore": maxscore.OP4_SQL,
        "op5_secret_scan": secret_scan.OP5_SQL,
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op9_url_filter": url_filter.OP9_SQL,
        "op10_mixing": mixing.OP10_SQL,
    }
