"""The subpackage's queries and, where SQL can express one, its SQL."""

from __future__ import annotations

import importlib

import corpus_pipeline

_NAMES = {
    "op1_repeats": "repeats", "op2_line_dedup": "line_dedup", "op3_simhash": "simhash", "op4_exact_dedup": "exact_dedup", "op5_toxicity": "toxicity",
    "op6_media": "media", "op7_mixing": "mixing", "op8_packing": "packing", "op9_pii": "pii", "op10_secrets": "secrets",
}
_MODULES = {name: importlib.import_module(f"lmdata.llm.{module}") for name, module in _NAMES.items()}


def queries() -> dict:
    return {name: getattr(m, name) for name, m in _MODULES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    own = {name: m.SQL for name, m in _MODULES.items() if getattr(m, "SQL", None)}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
