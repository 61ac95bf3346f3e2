"""Quality statistics of aligned rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import is_blank


def quality_report(df: DataFrame, similarity: str = "similarity") -> DataFrame:
    """One row: totals, similarity, bands (over 0.7, 0.5 to 0.7, under 0.5) and blank sides; one pass."""
    s = F.col(similarity)
    bands = {"high": s > 0.7, "medium": (s >= 0.5) & (s <= 0.7), "low": s < 0.5}
    counts = {f"n_{k}": F.count_if(v) for k, v in bands.items()}
    return df.agg(
        F.count("*").alias("n_rows"), F.avg(s).alias("avg_similarity"), F.max(s).alias("max_similarity"), F.min(s).alias("min_similarity"),
        *[v.alias(k) for k, v in counts.items()], F.count_if(is_blank(F.col("src"))).alias("n_blank_src"), F.count_if(is_blank(F.col("tgt"))).alias("n_blank_tgt"),
    ).withColumns({f"pct_{k}": F.when(F.col("n_rows") > 0, 100.0 * F.col(f"n_{k}") / F.col("n_rows")) for k in bands})


def method_counts(df: DataFrame, method: str = "split_method") -> DataFrame:
    return df.groupBy(method).agg(F.count("*").alias("n"))


def totals(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: rows written, rows processed, and of these the failed and the missing ones."""
    counted = checks.agg(F.count("*").alias("n_processed"), F.count_if(~F.col("valid") & ~F.col("missing")).alias("n_failed"), F.count_if(F.col("missing")).alias("n_missing"))
    return rows.agg(F.count("*").alias("n_rows")).crossJoin(counted)  # one row each


def observed(rows: DataFrame, name: str, keys: list[str]) -> tuple[DataFrame, Observation]:
    """rows, and what counts them while they are written: units out, and those with an empty side."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("n_units"), F.count_if(is_blank(F.col("src")) | is_blank(F.col("tgt"))).alias("n_half_empty"), F.approx_count_distinct(F.struct(*keys)).alias("n_rows_about")), seen
