"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("op1_secrets", "op2_language", "op3_quality", "op4_decontaminate", "op5_near_dedup", "op6_neighbours", "op7_token_output", "op8_chat", "op9_html_text", "op10_packing")


def _each(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"weftgraph.llm.{m}"), name)
    return out


def queries() -> dict[str, Callable]:
    return _each("QUERIES")


def oracles() -> dict[str, str]:
    return _each("ORACLES")
