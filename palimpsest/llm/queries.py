"""The queries of this subpackage, by name, and their DuckDB SQL where there is one."""

from __future__ import annotations

from . import op01, op02, op03, op04, op05, op06, op07, op08, op09, op10

QUERIES = {
    "op1_quality_rules": op01.query,
    "op2_fingerprints": op02.query,
    "op3_language": op03.query,
    "op4_sentencepiece": op04.query,
    "op5_quality": op05.query,
    "op6_mixing": op06.query,
    "op7_toxicity": op07.query,
    "op8_simhash": op08.query,
    "op9_html": op09.query,
    "op10_compact_windows": op10.query,
}
ORACLES = {
    "op1_quality_rules": op01.ORACLE,
    "op6_mixing": op06.ORACLE,
}
