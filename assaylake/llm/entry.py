"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import alignment, bpe, chat, exact_dedup, htmltext, linededup, minhash, mixing, ogg, simhash, tokencount, toxicity, whitening


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_minhash": minhash.op2_minhash,
        "op3_chat_rotation": chat.op3_chat_rotation,
        "op4_bpe": bpe.op4_bpe,
        "op5_line_dedup": linededup.op5_line_dedup,
        "op6_ogg": ogg.op6_ogg,
        "op7_token_counts": tokencount.op7_token_counts,
        "op8_mix": mixing.op8_mix,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_main_text": htmltext.op10_main_text,
        "op11_simhash": simhash.op11_simhash,
        "op12_whitening": whitening.op12_whitening,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op3_chat_rotation": chat.OP3_SQL,
        "op5_line_dedup": linededup.OP5_SQL,
        "op8_mix": mixing.OP8_SQL,
    }
