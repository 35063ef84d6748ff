"""The whole analysis of one table: profile, clean, describe, figures, findings, charts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from gridsight.functions import dates
from gridsight.functions.money import DEFAULT_CURRENCY
from gridsight.functions.values import col
from gridsight.operators import (
    charts, clean, describe, insights, kpi, profile, timeseries)
from gridsight.session import stage
from gridsight.sources import catalog


class Trends(NamedTuple):
    """Time-series results of the first date column."""

    date_column: str
    grain: timeseries.Grain
    periods: DataFrame
    growth: DataFrame
    peaks: DataFrame


class Analysis(NamedTuple):
    """Every result table of a run; all but `data` are small."""

    data: DataFrame
    raw_profile: DataFrame
    profile: DataFrame
    log: DataFrame
    outliers: DataFrame
    kpis: DataFrame
    describe: DataFrame
    distribution: DataFrame
    extremes: DataFrame
    pairs: DataFrame
    strong: DataFrame
    groups: DataFrame
    crosstab: DataFrame | None
    trends: Trends | None
    insights: DataFrame


def trend_tables(data: DataFrame, types: dict[str, str]) -> Trends | None:
    """Period sums of the first numbers over the first date column."""
    found = profile.of_type(types, "datetime")
    numbers = profile.of_type(types, "numeric")[:timeseries.TREND_COLUMNS]
    if not found:
        return None
    layout = dates.format_of(data, found[0])
    grain = timeseries.choose_grain(data, found[0], layout)
    if grain is None or not numbers:
        return None
    periods = timeseries.resample(data, found[0], numbers, grain, layout)
    return Trends(found[0], grain, periods, timeseries.growth(periods),
                  timeseries.peak_and_low(periods))


def _listed(table: DataFrame, *order: str) -> list[dict]:
    """Rows of a small statistics table."""
    rows = [r.asDict() for r in table.collect()]
    return sorted(rows, key=lambda r: tuple(r[k] for k in order))


def gather(types, raw_profile, outliers, log, described, extremes, strong, groups,
           trends: Trends | None) -> insights.Statistics:
    """The statistics tables as the finding rules read them."""
    labelled = profile.of_type(types, "categorical") + profile.of_type(types, "boolean")
    found = {r["column"]: r for r in _listed(extremes)} if extremes is not None else {}
    lines: list[dict] = []
    if trends is not None:
        peaks = {r["metric"]: r for r in _listed(trends.peaks)}
        lines = [{**g, **peaks[g["metric"]]}
                 for g in _listed(trends.growth, "metric_position")]
    place = {c: i for i, c in enumerate(types)}
    pairs = [] if strong is None else sorted(
        _listed(strong), key=lambda p: (-abs(p["r"]), place[p["col1"]], place[p["col2"]]))
    return insights.Statistics(
        profile=_listed(raw_profile, "position"), outliers=_listed(outliers, "position"),
        log_size=log.count(), describe=_listed(described, "position"),
        categories=[found[c] for c in labelled if c in found], pairs=pairs,
        groups=[] if groups is None else _listed(groups, "cat_position", "num_position", "rank"),
        trends=lines)


def analyze(df: DataFrame, imputation: str = "auto", drop_copies: bool = True,
            outlier_multiplier: float = 1.5, order_by: str | None = None,
            row_number: str | None = None, currency: str = DEFAULT_CURRENCY,
            keep=stage) -> Analysis:
    """Run every step on a table.

    The cleaned table is written once (`keep`) and read column-wise by each
    later step. Semantic types are inferred again after cleaning, as filled
    cells can change them.
    """
    first = [row_number] if row_number else None
    columns = [c for c in df.columns if c != row_number]
    raw_profile = profile.profile_columns(df, first, columns=columns)
    done = clean.clean(df, raw_profile, imputation, drop_copies, outlier_multiplier,
                       order_by, row_number, keep)
    data = done.data
    cleaned_profile = profile.profile_columns(data, first, columns=columns)
    types = profile.types_of(cleaned_profile)
    numbers = profile.of_type(types, "numeric")
    categories = profile.of_type(types, "categorical")
    labelled = categories + profile.of_type(types, "boolean")
    compared, main = numbers[:describe.COMPARED_COLUMNS], categories[:describe.COMPARED_COLUMNS]

    described = describe.numeric_describe(data, numbers)
    distribution = extremes = None
    if labelled:
        distribution = describe.value_distribution(data, labelled)
        extremes = describe.category_extremes(data, labelled)
    pairs = describe.pair_correlations(data, numbers)
    strong = describe.strong_pairs(pairs)
    groups = describe.group_stats(data, main, compared)
    cross = describe.crosstab(data, main[0], main[1]) if len(main) >= 2 else None
    trends = trend_tables(data, types)
    statistics = gather(types, cleaned_profile, done.outliers, done.log, described, extremes,
                        strong, groups, trends)
    return Analysis(
        data, raw_profile, cleaned_profile, done.log, done.outliers,
        kpi.kpis(data.select(*[col(c) for c in columns]), types, currency),
        described, distribution, extremes, pairs, strong,
        groups, cross, trends, insights.insights(data.sparkSession, statistics))


class ChartData(NamedTuple):
    """Tables behind the charts of a run."""

    histograms: DataFrame
    boxes: DataFrame
    bars: DataFrame | None
    heatmap: DataFrame
    group_bars: DataFrame
    trend_points: DataFrame | None


def chart_data(run: Analysis, top: int = charts.TOP_INTERACTIVE) -> ChartData:
    """Chart tables of the columns worth showing."""
    chosen = charts.chart_columns(run.profile, run.kpis)
    shown = [r["column"] for r in charts.meaningful_columns(run.profile).collect()]
    numbers = chosen["numeric"][:charts.CHART_COLUMNS]
    labels = chosen["categorical"][:charts.CHART_COLUMNS]
    numeric = profile.of_type(profile.types_of(run.profile), "numeric")
    return ChartData(
        charts.histogram(run.data, numbers), charts.box_summary(run.data, numbers),
        charts.topn_counts(run.data, labels, top) if labels else None,
        charts.heatmap_long(run.data, numeric, shown), charts.group_bars(run.groups, shown),
        charts.trend_points(run.trends.periods, shown) if run.trends else None)


def save_run(run: Analysis, path: str, filename: str, owner: str | None = None) -> str:
    """Append the small result and chart tables of a run to the catalog; returns the run id."""
    tables = {"kpis": run.kpis, "insights": run.insights, "outliers": run.outliers,
              "profile": run.profile, "cleaning_log": run.log, "describe": run.describe,
              "extremes": run.extremes, "strong_pairs": run.strong, "groups": run.groups,
              "distribution": run.distribution, "correlations": run.pairs,
              "crosstab": run.crosstab}
    if run.trends is not None:
        tables |= {"periods": run.trends.periods, "growth": run.trends.growth,
                   "peaks": run.trends.peaks}
    tables |= {f"chart_{name}": table for name, table in chart_data(run)._asdict().items()}
    content = {name: [r.asDict(recursive=True) for r in table.collect()]
               for name, table in tables.items() if table is not None}
    records = content["profile"][0]["row_count"] if content["profile"] else 0
    record = catalog.run_record(filename, records, content, owner)
    catalog.append_run(run.data.sparkSession, path, record)
    return record[5]
