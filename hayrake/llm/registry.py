"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import decontaminate, dialogue, language_id, licenses, line_dedup, near_join, pieces, resample, secrets, token_store, url_filter, warc, webp


def queries() -> dict:
    return {
        "op1_token_store": token_store.op1_token_store,
        "op2_secrets": secrets.op2_secrets,
        "op3_sentencepiece": pieces.op3_sentencepiece,
        "op4_warc": warc.op4_warc,
        "op5_near_join": near_join.op5_near_join,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_language_id": language_id.op9_language_id,
        "op10_webp": webp.op10_webp,
        "op11_license_scan": licenses.op11_license_scan,
        "op12_dialogue_repair": dialogue.op12_dialogue_repair,
        "op13_resample": resample.op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secrets": secrets.OP2_SQL,
        "op4_warc": warc.OP4_SQL,
        "op6_decontaminate": decontaminate.OP6_SQL,
        "op11_license_scan": licenses.OP11_SQL,
        "op12_dialogue_repair": dialogue.OP12_SQL,
        "op13_resample": resample.OP13_SQL,
    }
