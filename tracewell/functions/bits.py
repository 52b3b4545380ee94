"""Small sets of names as the bits of one bigint."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Bits of a non-negative bigint.
MAX_BITS = 63


def few_names(names: DataFrame, limit: int) -> list[str] | None:
    """The distinct values of a one-column table in order, or None if there are more than ``limit``."""
    rows = names.distinct().limit(limit + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= limit else None


def array_sql(names: list[str]) -> str:
    """The names as a constant. Their bytes are written, so that no quoting rule of the parser matters."""
    return f"cast(array({', '.join(f"X'{n.encode().hex()}'" for n in names)}) AS array<string>)"


def bit_sql(names: list[str], value: str) -> str:
    """The number of the bit that stands for ``value``."""
    return f"cast(array_position({array_sql(names)}, {value}) - 1 AS int)"


def to_bits_sql(names: list[str], values: str) -> str:
    """An array of names as bits."""
    return f"aggregate({values}, 0L, (m, v) -> m | shiftleft(1L, {bit_sql(names, 'v')}))"


def from_bits_sql(names: list[str], bits: str) -> str:
    """Bits as an array in the order of ``names``."""
    return f"filter({array_sql(names)}, (v, i) -> {bits} & shiftleft(1L, i) <> 0)"
