"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from . import decontam, exact, html_text, licences, mixing, neardup, pii, secrets, shards, toxicity

QUERIES = {
    "op1_decontamination": decontam.op1,
    "op2_bag_minhash": neardup.op2,
    "op3_toxicity": toxicity.op3,
    "op4_pii_surrogates": pii.op4,
    "op5_licence_scan": licences.op5,
    "op6_exact_dedup": exact.op6,
    "op7_source_mix": mixing.op7,
    "op8_hilbert_shards": shards.op8,
    "op9_secret_scan": secrets.op9,
    "op10_main_text": html_text.op10,
}
ORACLE_SQL = {
    "op6_exact_dedup": exact.OP6_SQL,
    "op9_secret_scan": secrets.OP9_SQL,
}
