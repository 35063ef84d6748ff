"""Write tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Standardised CSV: comma, header, UTF-8, doubled quotes, white space kept."""
    df.write.mode(mode).csv(path, header=True, escape='"', encoding="UTF-8",
                            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All records as JSON lines; missing cells are written as null."""
    df.write.mode(mode).json(path, ignoreNullFields=False)
