"""Fusion of anomaly channels: flags, categories, doc totals, a first-component score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flagged(df: DataFrame, flags: dict[str, Column], channels: dict[str, list[str]]) -> DataFrame:
    """Adds the flags, their number, the category, and cross: do several channels agree?"""
    df = df.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in flags.items()})
    n = sum((F.col(k).cast("int") for k in flags), F.lit(0))
    hit = sum((F.greatest(*(F.col(f).cast("int") for f in fs), F.lit(0)) for fs in channels.values()), F.lit(0))
    return df.withColumns({"n_flags": n, "category": category(n), "cross": hit >= 2})


def category(n_flags: Column) -> Column:
    return F.when(n_flags >= 3, "CRITICA").when(n_flags == 2, "ALTA").when(n_flags == 1, "MODERADA").otherwise("NORMAL")


def doc_totals(df: DataFrame, doc: str, score: str) -> DataFrame:
    """Per doc: rows, rows of each category, cross rows, and total, largest and mean score."""
    c = F.col("category")
    return df.groupBy(doc).agg(
        F.count("*").alias("n"),
        *(F.count_if(c == k).alias(f"n_{k.lower()}") for k in ("CRITICA", "ALTA", "MODERADA")),
        F.count_if("cross").alias("n_cross"),
        F.sum(score).alias("score_total"),
        F.max(score).alias("score_max"),
        F.avg(score).alias("score_mean"),
    )


def untested_share(pairs: DataFrame, significance: DataFrame) -> DataFrame:
    """Per line: share of its tested bigrams that are not significant; null where none was tested."""
    s = significance.select("a", "b", "significant")
    return pairs.join(s, ["a", "b"], "left").groupBy("doc", "line").agg(
        F.count("significant").alias("tested"),
        F.count_if(~F.col("significant")).alias("not_valid"),
        F.try_divide(F.count_if(~F.col("significant")), F.count("significant")).alias("frac_not_valid"),
    )


def first_component(df: DataFrame, columns: list[str], out: str = "score") -> DataFrame:
    """Score on the first principal component of z-scored columns; nulls count as 0, loadings sum to 0 at least, the least score is 0.

    One pass gives all moments (a row of p(p+3)/2 numbers); the p x p eigenproblem is
    solved on the driver, scores are a native expression.
    """
    import numpy as np

    p = len(columns)
    x = {c: F.col(c).cast("double") for c in columns}
    row = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(x.values())), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x.values()))).first()
    z = [F.coalesce((c - row[f"m{i}"]) / row[f"s{i}"], F.lit(0.0)) if row[f"s{i}"] else F.lit(0.0) for i, c in enumerate(x.values())]
    moments = df.agg(*(F.avg(z[i] * z[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i + 1)), *(F.avg(z[i]).alias(f"a{i}") for i in range(p))).first()
    a = np.array([moments[f"a{i}"] or 0.0 for i in range(p)])
    cov = np.array([[moments[f"c{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(p)] for i in range(p)]) - np.outer(a, a)
    sd = np.sqrt(np.diag(cov))
    scale = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0)
    _, vectors = np.linalg.eigh(cov * np.outer(scale, scale))
    load = vectors[:, -1]
    load = -load if load.sum() < 0 else load
    raw = sum((F.lit(float(load[i] * scale[i])) * (z[i] - float(a[i])) for i in range(p)), F.lit(0.0))
    scored = df.withColumn(out, raw)
    least = scored.agg(F.min(out).alias("least_"))
    return scored.join(F.broadcast(least)).withColumn(out, F.col(out) - F.col("least_")).drop("least_")
