"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, chat, decontaminate, divergence, language, lexical, licenses, minhash, oracles, pii, sentencepiece_bpe, suffix_dedup, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_sentencepiece": sentencepiece_bpe.op2_sentencepiece,
        "op3_language_id": language.op3_language_id,
        "op4_minhash": minhash.op4_minhash,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_chat_format": chat.op6_chat_format,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_neighbours": ann.op9_neighbours,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_license_scan": licenses.op12_license_scan,
        "op13_lexical_search": lexical.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": oracles.ORACLE_OP1, "op4_minhash": oracles.ORACLE_OP4, "op10_suffix_dedup": oracles.ORACLE_OP10, "op5_url_filter": url_filter.ORACLE_OP5, "op6_chat_format": chat.ORACLE_OP6, "op11_source_divergence": divergence.ORACLE_OP11, "op12_license_scan": licenses.ORACLE_OP12, "op13_lexical_search": lexical.ORACLE_OP13}
