"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from . import decontaminate, html_text, infill, jaccard, language_model, media, packing, pii, secrets, spelling, token_store, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        jaccard.op1_jaccard,
        secrets.op2_secrets,
        decontaminate.op3_decontaminate,
        token_store.op4_token_store,
        packing.op5_packing,
        html_text.op6_html,
        language_model.op7_language_model,
        pii.op8_pii,
        media.op9_media,
        toxicity.op10_toxicity,
        spelling.op11_spelling,
        warc.op12_warc,
        infill.op13_infill,
    )
}
ORACLE_SQL = {
    "op1_jaccard": jaccard.ORACLE_SQL,
    "op3_decontaminate": decontaminate.ORACLE_SQL,
    "op11_spelling": spelling.ORACLE_SQL,
    "op12_warc": warc.ORACLE_SQL,
    "op13_infill": infill.ORACLE_SQL,
}
