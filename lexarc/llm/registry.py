"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ["op1_langid", "op2_secrets", "op3_bpe", "op4_tokencount", "op5_embeddings", "op6_chat", "op7_jaccard", "op8_quality", "op9_suffix", "op10_decontaminate", "op11_codes",
           "op12_lines", "op13_elkan"]


def queries() -> dict:
    found = {}
    for name in MODULES:
        found |= import_module(f"{__package__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found |= import_module(f"{__package__}.{name}").SQL
    return found
