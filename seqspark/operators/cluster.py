"""Token embeddings and classes: features, PCA, k-means, silhouette, agreement."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_macro, paren_depth
from ..sources.corpora import tokens_of
from .counts import markov_profile, position_stats
from .stats import ppmi


def token_features(lines: DataFrame, vocabulary: int = 500, hapax: int = 1) -> DataFrame:
    """token, features: successor and predecessor PPMI against the most frequent tokens, position, form.

    Position: shares of lines begun and ended, entropy of successors and predecessors,
    mean and spread of the relative place; form: group, depth of groups, length / 10.

    Every token that stands more than `hapax` times has a row; only the columns are
    the `vocabulary` most frequent ones.  Long (token, index, value) rows are gathered into vectors; the width is a
    parameter, so the model's size does not grow with the corpus.
    """
    often = tokens_of(lines).groupBy("token").agg(F.count("*").alias("n"))
    top = often.orderBy(F.desc("n"), "token").limit(vocabulary)
    ids = {r.token: i for i, r in enumerate(top.select("token").collect())}  # `vocabulary` rows
    if not ids:
        return lines.sparkSession.createDataFrame([], "token string").withColumn("features", F.lit(None).cast(VectorUDT()))
    index = F.create_map(*(F.lit(x) for kv in ids.items() for x in kv))
    v, width = len(ids), 2 * len(ids) + 9
    succ = ppmi(lines).select(F.col("a").alias("token"), index[F.col("b")].alias("i"), F.col("ppmi").alias("x"))
    pred = ppmi(lines, "pred").select(F.col("b").alias("token"), (index[F.col("a")] + v).alias("i"), F.col("ppmi").alias("x"))
    own = markov_profile(lines).join(position_stats(lines).drop("n"), "token")
    nine = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("p_first", "p_last", "h_succ", "h_pred", "mean_pos", "sd_pos")), is_macro(F.col("token")).cast("double"), paren_depth(F.col("token")).cast("double"), F.length("token") / 10.0)
    place = own.select("token", F.posexplode(nine).alias("k", "x")).select("token", (F.col("k") + 2 * v).alias("i"), "x")
    long = succ.unionByName(pred).unionByName(place).where(F.col("i").isNotNull() & (F.col("x") != 0)).join(often.where(F.col("n") > hapax).select("token"), "token", "left_semi")
    held = long.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct(F.col("i").cast("int"), "x"))).alias("xs"))  # at most `width` of a token
    row = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.col("xs")[i], F.lit(0.0)))
    return held.select("token", array_to_vector(row).alias("features"))


def vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.select(key, array_to_vector(F.col(column).cast("array<double>")).alias("features"))


def reduced(df: DataFrame, k: int, column: str = "features") -> DataFrame:
    """Unit rows, centred, on the first k principal components, as column pca."""
    unit = Normalizer(p=2.0, inputCol=column, outputCol="unit_").transform(df)
    centred = StandardScaler(withMean=True, withStd=False, inputCol="unit_", outputCol="centred_").fit(unit).transform(unit)
    return PCA(k=k, inputCol="centred_", outputCol="pca").fit(centred).transform(centred).drop("unit_", "centred_")


def loadings(df: DataFrame, k: int, names: list[str], column: str = "features") -> DataFrame:
    """component, name, loading, share of variance: the principal axes of unit, centred rows; a component's largest loading is positive."""
    unit = Normalizer(p=2.0, inputCol=column, outputCol="unit_").transform(df)
    centred = StandardScaler(withMean=True, withStd=False, inputCol="unit_", outputCol="centred_").fit(unit).transform(unit)
    model = PCA(k=k, inputCol="centred_", outputCol="pca").fit(centred)
    axes, shares, rows = model.pc.toArray(), model.explainedVariance.toArray(), []  # columns by k numbers
    for c in range(k):
        axis = axes[:, c] if axes[abs(axes[:, c]).argmax(), c] >= 0 else -axes[:, c]
        rows += [(c + 1, name, float(x), float(shares[c])) for name, x in zip(names, axis, strict=True)]
    return df.sparkSession.createDataFrame(rows, "component int, name string, loading double, variance double")


def scatter(points: DataFrame, key: str, column: str, label: str) -> DataFrame:
    """Points (kind 'point') on their first two coordinates, and each label's centre (kind 'centre'), to which points are joined by spokes."""
    xy = points.select(F.lit("point").alias("kind"), F.col(key).cast("string").alias("name"), F.col(label).alias("label"), vector_to_array(column)[0].alias("x"), vector_to_array(column)[1].alias("y"))
    centres = xy.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return xy.unionByName(centres.select(F.lit("centre").alias("kind"), F.col("label").cast("string").alias("name"), "label", F.col("cx").alias("x"), F.col("cy").alias("y")))


def best_kmeans(df: DataFrame, k: int, starts: int = 3, column: str = "pca", seed: int = 42) -> tuple[DataFrame, KMeansModel]:
    """k-means with several starts, by least cost; adds column label."""
    models = [KMeans(k=k, seed=seed + s, featuresCol=column, predictionCol="label", maxIter=30).fit(df) for s in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(df), best


def choose_k(df: DataFrame, ks: range, column: str = "pca", metric: str = "cosine", starts: int = 2) -> tuple[int, DataFrame]:
    """The k with the best silhouette; the smallest one wins ties."""
    ev = ClusteringEvaluator(predictionCol="label", featuresCol=column, distanceMeasure=metric)
    scored = [(ev.evaluate(out := best_kmeans(df, k, starts, column)[0]), -k, out) for k in ks]
    _, k, out = max(scored, key=lambda x: x[:2])
    return -k, out


def silhouette_cosine(df: DataFrame, key: str, column: str, label: str) -> DataFrame:
    """Mean cosine silhouette from sums of unit vectors per cluster: one pass, no pairs of points.

    The mean distance of a point to a cluster is 1 minus its product with the
    cluster's mean unit vector; in its own cluster the point itself is left out.
    """
    norm = F.sqrt(F.aggregate(F.col(column).cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x))
    unit = df.select(key, F.col(label).alias("label"), F.transform(F.col(column).cast("array<double>"), lambda x: F.try_divide(x, norm)).alias("u"))
    long = unit.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    sums = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("s"))
    sizes = unit.groupBy("label").agg(F.count("*").alias("n"))
    clusters = sums.join(sizes, "label").select(F.col("label").alias("other"), "s", "n")
    table = clusters.agg(F.collect_list(F.struct("other", "s", "n")).alias("cs"))  # a row per cluster
    inner = lambda c: F.aggregate(F.zip_with("u", c["s"], lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    own = F.filter("cs", lambda c: c["other"] == F.col("label"))[0]
    self_ = F.aggregate("u", F.lit(0.0), lambda acc, x: acc + x * x)
    others = F.transform(F.filter("cs", lambda c: c["other"] != F.col("label")), lambda c: 1 - inner(c) / c["n"])
    a = (own["n"] - 1 - (inner(own) - self_)) / (own["n"] - 1)
    x = unit.join(F.broadcast(table)).select(F.when(own["n"] > 1, a).alias("a"), F.array_min(others).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return x.agg(F.avg(s).alias("silhouette"), F.count("*").alias("n"))


def adjusted_rand(df: DataFrame, x: str, y: str) -> DataFrame:
    """Adjusted Rand index of two labellings of the same rows, from the contingency counts."""
    pairs = lambda n: n * (n - 1) / 2
    cell = df.groupBy(x, y).agg(F.count("*").alias("n"))
    a = cell.groupBy(x).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sa"))
    b = cell.groupBy(y).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sb"))
    c = cell.agg(F.sum(pairs(F.col("n"))).alias("sc"), F.sum("n").alias("n"))
    t = c.join(F.broadcast(a)).join(F.broadcast(b))
    expected = F.col("sa") * F.col("sb") / pairs(F.col("n"))
    top = (F.col("sa") + F.col("sb")) / 2 - expected
    return t.select("n", F.when(top == 0, 1.0).otherwise(F.try_divide(F.col("sc") - expected, top)).alias("ari"))


def as_array(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, vector_to_array(column))
