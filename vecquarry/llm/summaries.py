"""Sound rows of the table of configurations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All columns of a configuration but the time of its export.
CONFIGURATION = ["k", "dataset", "algorithm", "params", "qps", "recall", "build_time", "index_size", "run_at"]


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite (NaN is above everything in Spark's order)."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def sound(df: DataFrame) -> DataFrame:
    """Configurations with dataset and algorithm, a finite qps above 0 and a recall in [0, 1], each once however often
    it was exported. Other columns are ignored."""
    qps, recall = F.col("qps"), F.col("recall")
    ok = F.col("dataset").isNotNull() & F.col("algorithm").isNotNull() & finite(qps) & (qps > 0) & finite(recall) & recall.between(0, 1)
    return df.select(*CONFIGURATION).filter(ok).distinct()
