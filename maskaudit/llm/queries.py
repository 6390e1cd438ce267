"""The registered queries of this folder: name to (function, SQL that must give the same rows, or None)."""

from __future__ import annotations

from maskaudit.llm import (
    chat, decontamination, embeddings, jaccard, langid, licenses, negatives, packing, periods, pii, secrets, slack, tokens,
)

REGISTRY = {
    "op1_embedding_dedup": (embeddings.op1_embedding_dedup, embeddings.OP1_SQL),
    "op8_token_counts": (tokens.op8_token_counts, None),
    "op9_language": (langid.op9_language, None),
    "op10_chat_format": (chat.op10_chat_format, chat.OP10_SQL),
    "op2_decontamination": (decontamination.op2_decontamination, None),
    "op3_licenses": (licenses.op3_licenses, licenses.OP3_SQL),
    "op4_packing": (packing.op4_packing, None),
    "op5_secrets": (secrets.op5_secrets, secrets.OP5_SQL),
    "op6_jaccard": (jaccard.op6_jaccard, jaccard.OP6_SQL),
    "op7_pii": (pii.op7_pii, None),
    "op11_hard_negatives": (negatives.op11_hard_negatives, negatives.OP11_SQL),
    "op12_slack_packing": (slack.op12_slack_packing, None),
    "op13_periodic_runs": (periods.op13_periodic_runs, periods.OP13_SQL),
}
