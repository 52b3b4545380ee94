"""Writers for footprints, binding counts and word counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_footprint_text(text: DataFrame, path: str, single_file: bool = False) -> None:
    """Lines of ``footprint_text`` in order: over the sorted part files, or in one file."""
    ordered = text.coalesce(1).sortWithinPartitions("row_no") if single_file else text.orderBy("row_no")
    ordered.select("line").write.text(path)


def write_bindings(counts: DataFrame, path: str, file_format: str = "parquet", single_file: bool = False) -> None:
    """Binding counts; as text, lines such as ``((a/SUCC,Set(b, c)),5)``."""
    _write(counts, path, file_format, single_file, F.concat(
        F.lit("(("), "activity", F.lit("/"), "side", F.lit(",Set("), F.array_join("binding", ", "), F.lit(")),"),
        F.col("n").cast("string"), F.lit(")")))


def write_counts(counts: DataFrame, path: str, file_format: str = "parquet", single_file: bool = False) -> None:
    """Word counts; as text, lines such as ``(word,5)``."""
    _write(counts, path, file_format, single_file, F.concat(
        F.lit("("), "word", F.lit(","), F.col("n").cast("string"), F.lit(")")))


def _write(rows: DataFrame, path: str, file_format: str, single_file: bool, line: Column) -> None:
    if single_file:
        rows = rows.coalesce(1)
    if file_format == "text":
        rows.select(line.alias("value")).write.text(path)
    elif file_format == "parquet":
        rows.write.parquet(path)
    else:
        raise ValueError(f"file_format must be 'parquet' or 'text', not {file_format!r}")
