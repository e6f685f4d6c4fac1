"""The Markdown report, and the tables that charts are drawn from."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import analyze as A


QUALITY = "avg_gold_similarity"
#: What the points of a scatter chart stand over.
COST = {"quality_by_latency": "avg_total_latency_ms", "quality_by_tokens": "avg_context_tokens"}


def chart_data(results: DataFrame) -> dict[str, DataFrame]:
    """What each of the six charts shows."""
    summaries = A.summary(results)
    points = A.with_parts(summaries)
    return {
        "quality_by_latency": points.join(A.pareto_frontier(summaries).select("config_name", F.lit(True).alias("on_frontier")), "config_name", "left"),
        "search_by_category": A.grid(results, "search"), "chunking_by_category": A.grid(results, "chunking"), "top_k_by_category": A.grid(results, "top_k"),
        "failure_modes": A.failure_shares(results).join(A.top_and_bottom(summaries), "config_name"), "quality_by_tokens": points.select("config_name", "search", "avg_context_tokens", QUALITY),
    }


def _bars(ax, rows: pd.DataFrame) -> None:
    """A group of bars for each category, a bar for each value of the grid's dimension."""
    dimension, categories = rows.columns[1], sorted(rows["question_category"].unique())
    values = sorted(rows[dimension].unique())
    width = 0.8 / max(len(values), 1)
    for k, value in enumerate(values):
        heights = rows[rows[dimension] == value].set_index("question_category")["similarity"].reindex(categories)
        ax.bar([i + (k + 0.5) * width - 0.4 for i in range(len(categories))], heights.tolist(), width, label=str(value))
    ax.set_xticks(range(len(categories)), categories)
    ax.set_ylabel("similarity")


def _stacks(ax, rows: pd.DataFrame) -> None:
    """A stacked bar for each configuration, the best on top; each part begins where the one before it ends."""
    rows = rows.assign(worst=rows["end"] == "bottom", at=rows["place"].where(rows["end"] == "top", -rows["place"]))
    rows = rows.sort_values(["worst", "at"], kind="stable").drop_duplicates(["config_name", "mode"])
    for mode in A.MODES:
        part = rows[rows["mode"] == mode]
        ax.barh(part["config_name"].tolist(), part["pct"].tolist(), left=part["bar_start"].tolist(), label=mode)
    ax.invert_yaxis()
    ax.set_xlabel("% of results")


def _points(ax, rows: pd.DataFrame, cost: str, line: pd.DataFrame | None) -> None:
    """A point for each configuration; the frontier joined and named, or the trend line."""
    for search, part in rows.groupby("search"):
        ax.scatter(part[cost].tolist(), part[QUALITY].tolist(), label=search)
    if "on_frontier" in rows:
        best = rows[rows["on_frontier"].notna()].sort_values([cost, "config_name"])
        ax.plot(best[cost].tolist(), best[QUALITY].tolist(), label="frontier")
        for r in best.itertuples():
            ax.annotate(r.config_name, (getattr(r, cost), getattr(r, QUALITY)), fontsize=7)
    if line is not None and len(line):
        ax.plot(line["x"].tolist(), line["y"].tolist(), "--", label="trend")
    ax.set_xlabel(cost)
    ax.set_ylabel(QUALITY)


def write_charts(results: DataFrame, folder: str) -> list[str]:
    """Draw the charts where matplotlib is there; returns the files. Each chart's table has a few rows a configuration."""
    try:
        import matplotlib
    except ImportError:
        return []
    matplotlib.use("Agg")
    from matplotlib import pyplot as plt

    Path(folder).mkdir(parents=True, exist_ok=True)
    files = []
    for name, data in chart_data(results).items():
        rows, line = data.toPandas(), None
        if rows.empty:
            continue
        if name == "quality_by_tokens":
            x = rows[COST[name]]
            line = A.trend_line(A.trend(A.summary(results)), float(x.min()), float(x.max())).orderBy("x").toPandas()
        fig, ax = plt.subplots(figsize=(10, 6))
        if name in COST:
            _points(ax, rows, COST[name], line)
        elif name == "failure_modes":
            _stacks(ax, rows)
        else:
            _bars(ax, rows)
        ax.set_title(name.replace("_", " "))
        ax.legend()
        fig.savefig(f"{folder}/{name}.png", bbox_inches="tight")
        plt.close(fig)
        files.append(f"{folder}/{name}.png")
    return files


def report_text(results: DataFrame) -> str:
    """The report; only summary rows reach the driver, and numbers are formatted there."""
    summaries = A.summary(results)
    rows = summaries.orderBy(A.quantised(F.col("avg_gold_similarity"), 9).desc(), "config_name").toPandas()
    if rows.empty:
        return "# Retrieval evaluation\n\nNo results.\n"
    gain, ranks = A.rerank_gain(results).first(), A.strategy_rank(results).orderBy("rank").toPandas()
    level = A.plateau(summaries).first()
    line = lambda r: f"| {r.config_name} | {r.avg_gold_similarity:.3f} | {r.avg_fact_recall:.3f} | {r.avg_context_precision:.3f} | {r.avg_context_recall:.3f} | {r.avg_total_latency_ms:.0f} | {r.avg_context_tokens:.0f} |"
    out = ["# Retrieval evaluation", "", f"{len(rows)} configurations.", "", "| Configuration | Similarity | Facts | Precision | Recall | Latency (ms) | Tokens |", "| --- | --- | --- | --- | --- | --- | --- |", *map(line, rows.itertuples()), ""]
    out += [f"Best: {rows.config_name.iloc[0]}. Worst: {rows.config_name.iloc[-1]}.", "", f"Best search: {ranks['search'].iloc[0]} ({ranks['similarity'].iloc[0]:.3f}). Rescoring changes similarity by {gain['gain_pct']:+.1f} % and retrieval by {gain['latency_ms']:+.0f} ms."]
    if level:
        out += ["", f"From {level['plateau_tokens']} context tokens on, quality is within 5 % of the best."]
    out += ["", "## Failures", "", "| Configuration | " + " | ".join(A.MODES) + " |", "| --- |" + " --- |" * len(A.MODES)]
    out += [f"| {r.config_name} | " + " | ".join(str(getattr(r, m)) for m in A.MODES) + " |" for r in A.failure_modes(results).orderBy("config_name").toPandas().itertuples()]
    return "\n".join(out) + "\n"


def write_report(results: DataFrame, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(report_text(results), encoding="utf-8")
