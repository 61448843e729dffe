"""Operators on training corpora. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

#: Query name, module and function of each operator.
OPERATORS = {
    "op1_simhash": ("simhash", "op1_simhash"),
    "op2_grammar_tokens": ("grammar_tokens", "op2_grammar_tokens"),
    "op5_decontamination": ("decontaminate", "op5_decontamination"),
    "op4_toxicity": ("toxicity", "op4_toxicity"),
    "op6_language": ("language", "op6_language"),
    "op7_main_text": ("main_text", "op7_main_text"),
    "op9_pii": ("pii", "op9_pii"),
    "op3_byte_bpe": ("bpe_transducer", "op3_byte_bpe"),
    "op8_line_templates": ("line_templates", "op8_line_templates"),
    "op10_topk": ("exact_topk", "op10_topk"),
    "op11_piece_offsets": ("piece_offsets", "op11_piece_offsets"),
    "op12_conversation_trie": ("conversation_trie", "op12_conversation_trie"),
    "op13_collocations": ("collocations", "op13_collocations"),
}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __name__), function) for name, (module, function) in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (module, _) in OPERATORS.items():
        sql = getattr(import_module(f".{module}", __name__), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
