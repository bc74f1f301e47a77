"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from . import audio, chat, lines, mixing, packing, pii, search, secrets, simhash, toxicity

QUERIES = {
    "op1_packing": packing.op1,
    "op2_toxicity": toxicity.op2,
    "op3_pii": pii.op3,
    "op4_secrets": secrets.op4,
    "op5_simhash": simhash.op5,
    "op6_mixing": mixing.op6,
    "op7_audio": audio.op7,
    "op8_lines": lines.op8,
    "op9_chat": chat.op9,
    "op10_search": search.op10,
}

ORACLE_SQL = {
    "op1_packing": packing.OP1_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op9_chat": chat.OP9_SQL,
    "op10_search": search.OP10_SQL,
}
