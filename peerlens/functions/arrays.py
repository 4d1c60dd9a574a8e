"""Column expressions over arrays, sets and vectors; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r6(x) -> Column:
    """Round to 6 digits. The small shift sends exact halves the same way whatever the order of a sum
    was; adding zero turns -0.0 into 0.0."""
    return F.round(_c(x).cast("double") + F.lit(1e-10), 6) + F.lit(0.0)


def doubles(v) -> Column:
    return _c(v).cast("array<double>")


def total(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine of two vectors, NULL when one has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; a column used inside a lambda is otherwise
    evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(a) -> Column:
    """Unit vector; NaN and infinite components count as zero, a zero vector stays zero."""
    safe = F.transform(
        _c(a), lambda x: F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)
    )

    def scaled(v):
        return let(norm(v), lambda n: F.transform(v, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n)))

    return let(safe, scaled)


def squared_distance(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def sorted_quantile(s: Column, q: float) -> Column:
    """Linear-interpolated quantile of an ascending array."""
    at = F.lit(q) * (F.size(s) - 1)
    lo = F.element_at(s, (F.floor(at) + 1).cast("int"))
    hi = F.element_at(s, (F.ceil(at) + 1).cast("int"))
    return lo + (hi - lo) * (at - F.floor(at))


def _centred(v: Column) -> Column:
    return let(total(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m))


def _power_mean(c: Column, k: int) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + F.pow(x, F.lit(float(k)))) / F.size(c)


def _shape(v: Column, k: int) -> Column:
    def ratio(c):
        return _power_mean(c, k) / F.nullif(F.pow(_power_mean(c, 2), F.lit(k / 2.0)), F.lit(0.0))

    return let(v, lambda w: let(_centred(w), ratio))


def skewness(v: Column) -> Column:
    """Population skewness of an array, NULL when it is constant."""
    return _shape(v, 3)


def kurtosis(v: Column) -> Column:
    """Population excess kurtosis of an array, NULL when it is constant."""
    return _shape(v, 4) - 3


def jaccard(a, b) -> Column:
    """Shared share of two sets; 0 when either is empty."""
    a, b = _c(a), _c(b)
    either = F.size(F.array_union(a, b))
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.nullif(either, F.lit(0))
    ).otherwise(F.lit(0.0))


def mean_of(*cols) -> Column:
    """Mean of the non-null columns of a row."""
    cols = [_c(c).cast("double") for c in cols]
    present = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    return sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)) / F.nullif(present, F.lit(0))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def other_members(df, authors: str, own: str):
    """Names and organisation words of the authors other than the group's own, without ``NULL``.

    ``authors`` is an array of structs whose ``name`` and ``org`` are comma-joined lists; an author is
    the group's own when the list of names contains ``own``.
    """
    others = F.filter(authors, lambda a: ~F.array_contains(F.split(a["name"], ","), F.col(own)))

    def flat(field):
        return F.filter(F.flatten(F.transform(others, lambda a: F.split(a[field], ","))), lambda w: w != "NULL")

    return df.withColumns({"names": flat("name"), "orgs": flat("org")})


def token_counts(df, columns: dict[str, str]):
    """Lengths of token arrays, and ``no_data`` = 1 where all of them are empty."""
    sizes = {n: F.size(c).cast("long") for n, c in columns.items()}
    return df.withColumns({**sizes, "no_data": (sum(sizes.values(), F.lit(0)) == 0).cast("int")})
