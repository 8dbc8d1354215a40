"""Small results as text: aligned and LaTeX tables, and data for plots. What is shown is collected; it is for final tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a table may show.
MOST = 10_000


def _cells(df: DataFrame, digits: int, missing: str) -> list[list[str]]:
    rows = df.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a table of more than {MOST} rows is no report")
    show = lambda v: missing if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return [[show(v) for v in r] for r in rows]


def text_table(df: DataFrame, digits: int = 2, missing: str = "-") -> str:
    cells = [df.columns, *_cells(df, digits, missing)]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in cells)


def latex_table(df: DataFrame, digits: int = 2, missing: str = "-") -> str:
    escape = lambda s: s.replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    lines = [" & ".join(map(escape, r)) + r" \\" for r in [df.columns, *_cells(df, digits, missing)]]
    return "\n".join([rf"\begin{{tabular}}{{l{'r' * (len(df.columns) - 1)}}}", r"\toprule", lines[0], r"\midrule", *lines[1:], r"\bottomrule", r"\end{tabular}"])


def gigabytes(kilobytes: str = "index_size"):
    """An index size in KB as GB."""
    return F.col(kilobytes) / (1024 * 1024)


def front_points(front: DataFrame) -> DataFrame:
    """(dataset, algorithm, points): the (recall, qps) steps of each front, in order, as a plot draws them."""
    return front.groupBy("dataset", "algorithm").agg(F.array_sort(F.collect_set(F.struct("recall", "qps"))).alias("points"))
