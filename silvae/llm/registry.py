"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from silvae.llm import op1_minhash, op2_warc, op3_bpe, op4_urls, op5_pii, op6_mpeg, op7_sharding, op8_langid, op9_winnow, op10_quality, op11_counts, op12_runs, op13_align


def queries() -> dict:
    return {
        "op1_minhash_dedup": op1_minhash.op1_minhash_dedup,
        "op2_warc": op2_warc.op2_warc,
        "op3_bpe": op3_bpe.op3_bpe,
        "op4_url_rules": op4_urls.op4_url_rules,
        "op5_pii_surrogates": op5_pii.op5_pii_surrogates,
        "op6_mpeg_audio": op6_mpeg.op6_mpeg_audio,
        "op7_extendible_sharding": op7_sharding.op7_extendible_sharding,
        "op8_language_filters": op8_langid.op8_language_filters,
        "op9_winnowing": op9_winnow.op9_winnowing,
        "op10_quality_mil": op10_quality.op10_quality_mil,
        "op11_token_counts": op11_counts.op11_token_counts,
        "op12_runs": op12_runs.op12_runs,
        "op13_align": op13_align.op13_align,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_dedup": op1_minhash.ORACLE,
        "op2_warc": op2_warc.ORACLE,
        "op4_url_rules": op4_urls.ORACLE,
        "op7_extendible_sharding": op7_sharding.ORACLE,
        "op9_winnowing": op9_winnow.ORACLE,
    }
