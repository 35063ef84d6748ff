"""Business figures recognised by column name, and generic fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsight.functions import frequency
from gridsight.functions import values as V
from gridsight.functions.money import DEFAULT_CURRENCY, money_text
from gridsight.operators import profile as P

# Name terms per kind of figure, in order of precedence.
KPI_TERMS = {
    "revenue": ("revenue", "sales_amount", "sales", "turnover", "invoice_val"),
    "sales_qty": ("quantity", "qty", "volume", "units_sold", "units"),
    "profit": ("profit", "margin", "net_profit", "earnings"),
    "cost": ("cost", "spend", "expense", "expenses", "budget"),
    "customers": ("customer_id", "cust_id", "client_id", "user_id", "customer", "user", "buyer"),
    "products": ("product_id", "prod_id", "item_id", "product", "item", "sku"),
    "orders": ("order_id", "transaction_id", "trans_id", "order_no", "invoice_id", "order"),
}
# Names of the distinct-count figures.
COUNT_NAMES = {"customers": "Total Customers", "products": "Total Products",
               "orders": "Total Transactions"}
MONEY_KINDS = ("revenue", "profit", "cost")
FALLBACK_COLUMNS = 3

KPI_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("raw_value", T.DoubleType()),
    T.StructField("value", T.StringType()),
])


def _matches(name: str, term: str) -> bool:
    return name == term or name.startswith(f"{term}_") or name.endswith(f"_{term}")


def match_columns(columns) -> dict[str, str]:
    """{kind: column}; a column takes its first kind, a kind its last column."""
    matched: dict[str, str] = {}
    for column in columns:
        kind = next((k for k, terms in KPI_TERMS.items()
                     if any(_matches(column.lower(), t) for t in terms)), None)
        if kind:
            matched[kind] = column
    return matched


def kpi_match(df: DataFrame) -> DataFrame:
    """(position, kind, column) of the recognised columns."""
    rows = [(i, kind, c) for i, (kind, c) in enumerate(match_columns(df.columns).items())]
    return df.sparkSession.createDataFrame(rows, "position int, kind string, column string")


def kpis(df: DataFrame, types: dict[str, str], currency: str = DEFAULT_CURRENCY) -> DataFrame:
    """All figures of a table: one aggregate for sums and means, one for distinct counts."""
    matched = match_columns(df.columns)
    sums = [(k, c) for k, c in matched.items()
            if k in (*MONEY_KINDS, "sales_qty") and types.get(c) == "numeric"]
    counted = [(k, c) for k, c in matched.items() if k in COUNT_NAMES]
    fallback = [] if sums or counted else P.of_type(types, "numeric")[:FALLBACK_COLUMNS]

    numbers = [c for _, c in sums] + fallback
    facts = df.agg(F.count("*").alias("rows"), *[
        agg for i, c in enumerate(numbers) for agg in (
            F.coalesce(F.sum(V.as_number(df, c)), F.lit(0.0)).alias(f"s{i}"),
            F.avg(V.as_number(df, c)).alias(f"m{i}"))
    ]).first()
    total = {c: facts[f"s{i}"] for i, c in enumerate(numbers)}
    mean = {c: facts[f"m{i}"] for i, c in enumerate(numbers)}
    distinct = {}
    if counted:
        distinct = {r["column"]: r["unique_count"] for r in
                    frequency.distinct_counts(df, {c for _, c in counted}).collect()}

    def text(number: float | None) -> str:
        return money_text(number if number is not None else float("nan"), currency)

    rows = [("Total Records", "N/A", "generic", facts["rows"], f"{facts['rows']:,}")]
    for kind, c in matched.items():
        if (kind, c) in counted:
            n = distinct.get(c, 0)
            rows.append((COUNT_NAMES[kind], c, "business_count", n, f"{n:,}"))
        elif (kind, c) in sums and kind == "sales_qty":
            rows.append((f"Total Quantity ({c})", c, "business_qty", total[c],
                         f"{total[c]:,.0f}"))
        elif (kind, c) in sums:
            rows.append((f"Total {c}", c, "business_sum", total[c], text(total[c])))
            rows.append((f"Average {c}", c, "business_avg", mean[c], text(mean[c])))
    for c in fallback:
        shown = "nan" if mean[c] is None else f"{mean[c]:,.2f}"
        rows.append((f"Average {c}", c, "generic_avg", mean[c], shown))
    rows.append(("Total Features", "N/A", "generic", len(df.columns), str(len(df.columns))))
    return df.sparkSession.createDataFrame(
        [(i, name, c, kind, None if raw is None else float(raw), shown)
         for i, (name, c, kind, raw, shown) in enumerate(rows)], KPI_SCHEMA)


def fallback_total(df: DataFrame) -> DataFrame:
    """Sum of the first numeric column, for tables without a revenue figure."""
    first = next((f.name for f in df.schema.fields if V.is_numeric(f.dataType)), None)
    if first is None:
        return df.sparkSession.createDataFrame([], "column string, total double")
    return df.agg(F.coalesce(F.sum(V.as_number(df, first)), F.lit(0.0)).alias("total")).select(
        F.lit(first).alias("column"), "total")
