"""The registered queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from importlib import import_module

#: query name -> module that defines a function of that name (and ORACLE where SQL can express it)
MODULES = {
    "op1_nearest": "nearest",
    "op2_substring_dedup": "substring_dedup",
    "op4_warc": "warc",
    "op6_mixing": "mixing",
    "op7_language_id": "language_id",
    "op3_toxicity": "toxicity",
    "op9_document_fingerprints": "digest",
    "op8_simhash": "simhash",
    "op5_bpe": "bpe",
    "op10_line_dedup": "line_dedup",
    "op11_chat_format": "chat_format",
    "op12_whitening": "whitening",
    "op13_repair": "repair",
}


def query(name: str):
    return getattr(import_module(f"{__package__}.{MODULES[name]}"), name)


def oracle(name: str) -> str | None:
    """SQL of a query, None where SQL can't express it."""
    return getattr(import_module(f"{__package__}.{MODULES[name]}"), "ORACLE", None)
