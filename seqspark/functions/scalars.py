"""Column functions: statistics of rows and arrays, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series after a shift by 8, exact to about 1e-12."""
    y = x + 8
    stirling = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    shift = x
    for i in range(1, 8):
        shift = shift * (x + i)
    return stirling - F.ln(shift)


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def fisher_greater(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """One-sided Fisher test P(X >= n_ab) of a 2 x 2 table with margins n_a, n_b out of n.

    The first term comes from log-gamma, the others by their ratio; the sum runs
    away from the mode, upwards or over the complement, so terms only shrink.
    """
    low, high, rest = F.greatest(F.lit(0), n_a + n_b - n), F.least(n_a, n_b), n - n_a - n_b
    nothing = F.array().cast("array<bigint>")

    def tail(start: Column, ks: Column, ratio) -> Column:
        first = F.exp(log_choose(n_a, start) + log_choose(n - n_a, n_b - start) - log_choose(n, n_b))
        step = lambda acc, k: F.struct((acc["t"] * ratio(k)).alias("t"), (acc["s"] + acc["t"] * ratio(k)).alias("s"))
        return F.aggregate(ks, F.struct(first.alias("t"), first.alias("s")), step, lambda acc: acc["s"])

    upper = tail(n_ab, F.when(n_ab < high, F.sequence(n_ab, high - 1)).otherwise(nothing), lambda k: 1.0 * (n_a - k) * (n_b - k) / ((k + 1.0) * (rest + k + 1)))
    below = n_ab - 1
    lower = tail(below, F.when(below > low, F.sequence(below, low + 1, F.lit(-1).cast("long"))).otherwise(nothing), lambda k: 1.0 * k * (rest + k) / ((n_a - k + 1.0) * (n_b - k + 1)))
    over = 1.0 * n_ab * n >= 1.0 * n_a * n_b
    return F.when(n_ab <= low, 1.0).when(n_ab > high, 0.0).when(over, F.least(F.lit(1.0), upper)).otherwise(F.greatest(F.lit(0.0), 1 - lower))


def z_score(x: Column, mean: Column, sd: Column, flat: Column | float = 0.0) -> Column:
    """(x - mean) / sd; `flat` where there is no spread."""
    return F.when(sd > 0, (x - mean) / sd).otherwise(flat if isinstance(flat, Column) else F.lit(flat))


def z_within(x: Column, *by: str) -> Column:
    """Population z-score of a column within groups; 0 without spread."""
    w = Window.partitionBy(*by)
    return z_score(x, F.avg(x).over(w), F.stddev_pop(x).over(w))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in [0, 2]; 1 if a vector is null-valued, null if one is missing."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    # greatest and least skip nulls, so the division is guarded before them
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), na * nb)))
    return F.when(a.isNull() | b.isNull(), None).when(na * nb > 0, 1 - clamped).otherwise(1.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def is_macro(token: Column) -> Column:
    return token.startswith("(") & token.endswith(")") & (F.length(token) >= 2)


def paren_depth(token: Column) -> Column:
    """The most parentheses open at once."""
    step = lambda acc, c: F.struct(
        (acc["now"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("now"),
        F.greatest(acc["most"], acc["now"] + F.when(c == "(", 1).otherwise(0)).alias("most"),
    )
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.split(token, ""), start, step, lambda acc: acc["most"])


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("..."))).otherwise(text)


def accents_stripped(text: Column) -> Column:
    return F.translate(text, "ÀÁÈÉÌÍÒÓÙÚàáèéìíòóùú", "AAEEIIOOUUaaeeiioouu")


def label_order(label: Column) -> list[Column]:
    """Sort keys that put C2 before C10 and names without a number last."""
    plain = label.rlike(r"^\D\d+$")
    return [F.when(plain, 0).otherwise(1), F.when(plain, F.regexp_extract(label, r"(\d+)$", 1).cast("int")), label]


def runs_z(n0: Column, n1: Column, runs: Column) -> Column:
    """Wald-Wolfowitz z of a 0/1 series; null where it is constant or shorter than 4."""
    n = n0 + n1
    mean = 2.0 * n0 * n1 / n + 1
    var = 2.0 * n0 * n1 * (2.0 * n0 * n1 - n) / (n * n * (n - 1.0))
    return F.when((n0 > 0) & (n1 > 0) & (n >= 4), F.when(var > 0, (runs - mean) / F.sqrt(var)))


def overlap_free_count(text: Column, part: Column) -> Column:
    """Occurrences of a substring that do not overlap."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")
