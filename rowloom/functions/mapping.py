"""Value lookups."""

from __future__ import annotations

from collections.abc import Mapping

from rowloom.functions.columns import value_of


def map_values(e: str, table: Mapping) -> str:
    """Look a value up in a small constant table; unknown values give NULL."""
    cases = " ".join(f"WHEN {value_of(k)} THEN {value_of(v)}" for k, v in table.items())
    return f"CASE {e} {cases} END"
