"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from vistaframe.llm import chat, jaccard, licenses, mixing, neighbours, packing, perplexity, quality, repeats, sharding

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_licenses": licenses.op3_licenses,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_repeats": repeats.op5_repeats,
    "op6_packing": packing.op6_packing,
    "op7_perplexity": perplexity.op7_perplexity,
    "op8_chat": chat.op8_chat,
    "op9_sharding": sharding.op9_sharding,
    "op10_mixing": mixing.op10_mixing,
}

ORACLE_SQL = {
    "op2_jaccard": jaccard.sql(),
    "op4_neighbours": neighbours.sql(),
    "op5_repeats": repeats.sql(),
    "op6_packing": packing.sql(),
    "op8_chat": chat.SQL,
    "op9_sharding": sharding.sql(),
    "op10_mixing": mixing.sql(),
}
