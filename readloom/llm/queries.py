"""The queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from . import decontaminate, hilbert, jaccard_join, langid, linededup, mixing, pii, secret_scan, spotsigs, tokenfile

QUERIES = {
    "op1_decontaminate": decontaminate.op1,
    "op2_secret_scan": secret_scan.op2,
    "op3_mix_sources": mixing.op3,
    "op4_personal_data": pii.op4,
    "op5_language_id": langid.op5,
    "op6_line_dedup": linededup.op6,
    "op7_spotsigs": spotsigs.op7,
    "op8_hilbert_shards": hilbert.op8,
    "op9_jaccard_join": jaccard_join.op9,
    "op10_token_file": tokenfile.op10,
}
ORACLE_SQL = {"op1_decontaminate": decontaminate.OP1_SQL, "op6_line_dedup": linededup.OP6_SQL, "op9_jaccard_join": jaccard_join.OP9_SQL}
