"""Read delimited and JSON files: separator, encoding, header, types."""

from __future__ import annotations

import csv
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsight.functions import values as V

# Cells read as missing, and the spellings of truth values.
MISSING_TOKENS = ("", "NA", "N/A", "NULL", "null", "NaN", "nan", "None", "n/a", "#N/A", "#NA",
                  "<NA>", "-nan", "-NaN", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
                  "#N/A N/A")
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
INFINITIES = ("inf", "-inf", "+inf", "infinity", "-infinity", "+infinity")
UNNAMED = "Unnamed:"
WHOLE_PATTERN = r"^\s*[+-]?\d+\s*$"
FALLBACK_ENCODING = "ISO-8859-1"
BAD_CHARACTER = "�"
ROW_NUMBER = "_row"
_SPLIT_ROWS = 1 << 33


class EmptyDataset(ValueError):
    """The file holds no records."""


# --- files ----------------------------------------------------------------------------------

def first_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    row = spark.read.option("encoding", encoding).csv(
        path, sep="\x00", quote="", schema="line string").limit(1).first()
    return (row["line"] or "").lstrip("﻿") if row else ""


def sniff_separator(line: str) -> str:
    """Tab before semicolon before comma, by presence in the first line."""
    return next((sep for sep in ("\t", ";") if sep in line), ",")


def header_names(line: str, sep: str, case_sensitive: bool = False) -> list[str]:
    """Unique column names: repeats get `.1`, `.2`; blanks get their position.

    Names that differ in case only count as repeats unless the session tells
    them apart.
    """
    def key(name: str) -> str:
        return name if case_sensitive else name.lower()

    cells = next(csv.reader([line], delimiter=sep), [])
    names: list[str] = []
    taken: set[str] = set()
    repeats: Counter[str] = Counter()
    for i, cell in enumerate(cells):
        base = cell if cell else f"{UNNAMED} {i}"
        name = base
        while key(name) in taken:
            repeats[key(base)] += 1
            name = f"{base}.{repeats[key(base)]}"
        taken.add(key(name))
        names.append(name)
    return names


def spans_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> bool:
    """Whether a record has line breaks inside quotes: some line holds an odd number of quotes.

    One pass over the raw lines, which files are split into as usual.
    """
    lines = spark.read.csv(path, sep="\x00", quote="", encoding=encoding, schema="line string")
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    return not lines.where(quotes % 2 == 1).isEmpty()


def read_cells(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8",
               multiline: bool | None = None, row_number: bool = False) -> DataFrame:
    """All columns as text, missing tokens as null."""
    if multiline is None:
        multiline = spans_lines(spark, path, encoding)
    line = first_line(spark, path, encoding)
    sep = sep or sniff_separator(line)
    names = header_names(line, sep, spark.conf.get("spark.sql.caseSensitive") == "true")
    if not names:
        raise EmptyDataset("The dataset contains no records.")
    # Columns are read by position and named last.
    plain = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    raw = spark.read.csv(
        path, sep=sep, schema=plain, header=True, enforceSchema=True, encoding=encoding,
        escape='"', multiLine=multiline, mode="PERMISSIVE")
    cells = [F.when(~F.col(f"c{i}").isin(*MISSING_TOKENS), F.col(f"c{i}")).alias(name)
             for i, name in enumerate(names)]
    if not row_number:
        return raw.select(*cells)
    return _numbered(raw, cells)


def _numbered(raw: DataFrame, cells: list[Column]) -> DataFrame:
    """Add `_row`, increasing in file order: the rank of the split, then the row in it.

    Splits may be packed into tasks in any order, but rows inside one keep theirs.
    """
    split = F.struct("_metadata.file_path", "_metadata.file_block_start").alias("__split")
    rows = raw.select(*cells, split, F.monotonically_increasing_id().alias("__id"))
    # One row per split, ranked without the driver; Spark chooses the join.
    ranks = raw.select(split).distinct().select(
        F.col("__split").alias("__of"),
        (F.row_number().over(Window.orderBy("__split")) - 1).cast("long").alias("__rank"))
    within = F.col("__id") % F.lit(_SPLIT_ROWS)
    data = [V.col(c) for c in rows.columns if c not in ("__split", "__id")]
    return rows.join(ranks, F.col("__split") == F.col("__of")).select(
        *data, (F.col("__rank") * F.lit(_SPLIT_ROWS) + within).alias(ROW_NUMBER))


# --- types ----------------------------------------------------------------------------------

def _is_number(text: Column) -> Column:
    return text.rlike(V.NUMBER_PATTERN) | F.lower(F.trim(text)).isin(*INFINITIES)


def _number(text: Column) -> Column:
    return F.when(_is_number(text), F.trim(text).try_cast("double"))


def _whole(text: Column) -> Column:
    # A failed cast costs an exception, so only digits get there.
    return F.when(text.rlike(WHOLE_PATTERN), F.trim(text).try_cast("bigint"))


def _truth(text: Column) -> Column:
    return F.when(text.isin(*TRUE_TOKENS), True).when(text.isin(*FALSE_TOKENS), False)


def text_facts(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Per text column: cells, whole numbers, numbers, truths, decoding damage, constancy.

    One aggregate over the file decides types, empty columns and the encoding. A
    second one looks at blank headers, if there are any.
    """
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        x = V.col(c)
        aggs += [F.count(x).alias(f"cells{i}"), F.count(_whole(x)).alias(f"whole{i}"),
                 F.count_if(F.coalesce(_is_number(x), F.lit(False))).alias(f"number{i}"),
                 F.count(_truth(x)).alias(f"truth{i}"),
                 F.count_if(F.coalesce(x.contains(BAD_CHARACTER), F.lit(False)))
                 .alias(f"bad{i}")]
    row = df.agg(*aggs).first()
    keys = ("cells", "whole", "number", "truth", "bad")
    facts = {c: {"rows": row["rows"], "constant": False, **{k: row[f"{k}{i}"] for k in keys}}
             for i, c in enumerate(columns)}
    unnamed = [c for c in columns if c.startswith(UNNAMED)]
    if unnamed:
        ends = df.agg(*[F.coalesce(F.min(V.col(c)) == F.max(V.col(c)), F.lit(True)).alias(f"u{i}")
                        for i, c in enumerate(unnamed)]).first()
        for i, c in enumerate(unnamed):
            facts[c]["constant"] = ends[i]
    return facts


def type_of_facts(facts: dict) -> str:
    """Narrowest type all cells fit: bigint, double, boolean, string."""
    n = facts["cells"]
    if n == 0 or facts["whole"] == n:
        return "bigint" if n else "string"
    if facts["number"] == n:
        return "double"
    return "boolean" if facts["truth"] == n else "string"


def infer_types(df: DataFrame) -> DataFrame:
    """(position, column, cells, inferred_dtype) of a table of text columns."""
    columns = df.columns
    facts = text_facts(df, columns)
    return df.sparkSession.createDataFrame(
        [(i, c, facts[c]["cells"], type_of_facts(facts[c])) for i, c in enumerate(columns)],
        "position int, column string, cells bigint, inferred_dtype string")


def cast_types(df: DataFrame, facts: dict[str, dict]) -> DataFrame:
    """Cast every text column to its inferred type in one projection."""
    casts = {"bigint": _whole, "double": _number, "boolean": _truth, "string": lambda x: x}
    return df.select(*[
        (casts[type_of_facts(facts[c])](V.col(c)) if c in facts else V.col(c)).alias(c)
        for c in df.columns])


def unwanted_columns(facts: dict[str, dict]) -> list[str]:
    """Empty columns, and unnamed ones that are mostly empty or hold one value."""
    out = []
    for c, f in facts.items():
        nulls = f["rows"] - f["cells"]
        unnamed = c.startswith(UNNAMED) and f["rows"] and (
            nulls / f["rows"] > 0.5 or f["constant"])
        if f["cells"] == 0 or unnamed:
            out.append(c)
    return out


def drop_unwanted(df: DataFrame) -> DataFrame:
    """A table of text columns without its empty and blank-header leftovers."""
    unwanted = unwanted_columns(text_facts(df, df.columns))
    return df.select(*[V.col(c) for c in df.columns if c not in unwanted])


# --- entry points ---------------------------------------------------------------------------

def read_delimited(spark: SparkSession, path: str, sep: str | None = None,
                   multiline: bool | None = None, row_number: bool = False) -> DataFrame:
    """A typed table from CSV or TSV files; `sep=None` sniffs the separator.

    Text that does not decode as UTF-8 is read again in the fallback encoding.
    Line breaks inside quotes are found by a look at the raw lines, unless `multiline`
    says so; such files are read by one task each, so large tables should be written as
    many files. `row_number` adds the file order as `_row`.
    """
    cells = read_cells(spark, path, sep, "UTF-8", multiline, row_number)
    columns = [c for c in cells.columns if c != ROW_NUMBER]
    facts = text_facts(cells, columns)
    damaged = any(f["bad"] for f in facts.values()) or any(BAD_CHARACTER in c for c in columns)
    if damaged and _truly_damaged(spark, path):
        cells = read_cells(spark, path, sep, FALLBACK_ENCODING, multiline, row_number)
        columns = [c for c in cells.columns if c != ROW_NUMBER]
        facts = text_facts(cells, columns)
    unwanted = set(unwanted_columns(facts))
    kept = [c for c in columns if c not in unwanted]
    if not kept or facts[kept[0]]["rows"] == 0:
        raise EmptyDataset("The dataset contains no records.")
    order = [ROW_NUMBER] if row_number else []
    typed = cells.select(*[V.col(c) for c in kept + order])
    return cast_types(typed, {c: facts[c] for c in kept})


def _truly_damaged(spark: SparkSession, path: str) -> bool:
    """False when the replacement character is really in the file, as its three bytes."""
    written = "ï¿½"

    def occurrences(encoding: str, mark: str) -> int:
        text = spark.read.csv(path, sep="\x00", quote="", encoding=encoding,
                              schema="line string")
        size = F.length("line") - F.length(F.replace("line", F.lit(mark), F.lit("")))
        return (text.agg(F.sum(size)).first()[0] or 0) // len(mark)

    return occurrences("UTF-8", BAD_CHARACTER) != occurrences(FALLBACK_ENCODING, written)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, None, **options)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, "\t", **options)


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """Records from JSON lines (splittable) or, with `lines=False`, from one array per file.

    By default the first line decides: an array left open there spans several lines.
    """
    if lines is None:
        first = first_line(spark, path).strip()
        lines = not first.startswith("[") or first.endswith("]")
    df = spark.read.json(path, multiLine=not lines)
    filled = df.agg(F.count("*").alias("rows"), *[
        F.count(V.col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    kept = [c for i, c in enumerate(df.columns) if filled[f"n{i}"]]
    if not kept:
        raise EmptyDataset("The dataset contains no records.")
    return df.select(*[V.col(c) for c in kept])


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Choose the reader by file extension."""
    lower = path.lower().rstrip("/")
    readers = {".csv": read_csv, ".tsv": read_tsv, ".json": read_json, ".jsonl": read_json,
               ".parquet": lambda s, p: s.read.parquet(p)}
    for extension, reader in readers.items():
        if lower.endswith(extension):
            return reader(spark, path, **options)
    raise ValueError(f"unsupported file format; choose from {sorted(readers)}")

