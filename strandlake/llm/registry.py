"""The queries of the ten operators, and SQL for those that SQL can express."""

from __future__ import annotations

from strandlake.llm import decontaminate, langid, line_dedup, lm, pieces, quality_rules, simhash, site_quality, tokenfile, warc


def queries() -> dict:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_token_files": tokenfile.op2_token_files,
        "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_piece_sampling": pieces.op7_piece_sampling,
        "op8_lm_scoring": lm.op8_lm_scoring,
        "op9_warc_revisits": warc.op9_warc_revisits,
        "op10_quality_classifier": site_quality.op10_quality_classifier,
    }


def oracle_sql() -> dict:
    return {"op4_quality_rules": quality_rules.OP4_SQL, "op9_warc_revisits": warc.OP9_SQL}
