"""The queries of this folder's operators."""

from __future__ import annotations

from glosswork.llm import bpe, exact_dedup, infill, licenses, media, packing, pii, quality, secret_layers, simhash, token_files, turn_tries, urls


def queries():
    return {
        "op1_genetic_packing": packing.query,
        "op2_bpe_prefix_dp": bpe.query,
        "op3_content_sort_dedup": exact_dedup.query,
        "op4_license_sentences": licenses.query,
        "op5_contextual_pii": pii.query,
        "op6_simhash_popcount": simhash.query,
        "op7_iso_media": media.query,
        "op8_token_files": token_files.query,
        "op9_rule_quality": quality.query,
        "op10_url_ngrams": urls.query,
        "op11_secret_layers": secret_layers.query,
        "op12_turn_tries": turn_tries.query,
        "op13_fill_in_middle": infill.query,
    }


def oracle_sql():
    return {
        "op3_content_sort_dedup": exact_dedup.SQL,
        "op4_license_sentences": licenses.SQL,
        "op12_turn_tries": turn_tries.SQL,
        "op13_fill_in_middle": infill.SQL,
    }
