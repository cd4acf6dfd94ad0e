"""Operators for large text corpora. Nothing else in the library imports this subpackage."""

#: Modules of this subpackage with QUERIES and ORACLES.
MODULES = ["op1_warc", "op2_langid", "op3_edits", "op4_quality", "op5_licenses", "op6_neardup", "op7_urls", "op8_bpe", "op9_secrets", "op10_decontaminate"]
