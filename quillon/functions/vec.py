"""Vector expressions. Arithmetic is in double precision, folded from the left, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cos(a: Column | str, b: Column | str) -> Column:
    """Null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def similarity(name: str):
    return {"dot": dot, "cos": cos}[name]


def axpy(alpha: float, a: Column | str, beta: float, b: Column | str) -> Column:
    """alpha * a + beta * b."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x * alpha + y * beta)


def vector_sum(vectors: Column) -> Column:
    """The sum of an array of vectors, in the array's order."""
    v = vectors.cast("array<array<double>>")
    return F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.element_at(v, 1), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))


def scaled(v: Column | str, by: Column | float) -> Column:
    return F.transform(doubles(v), lambda x: x * by)


def normalised(v: Column | str) -> Column:
    """To length 1; null for a zero vector."""
    n = F.nullif(norm(v), F.lit(0.0))
    return F.transform(doubles(v), lambda x: x / n)


def sub_vectors(v: Column | str, parts: int, width: int) -> Column:
    """The vector cut into ``parts`` vectors of ``width``."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda m: F.slice(doubles(v), m * width + 1, width))


def times_matrix(v: Column | str, matrix: list[list[float]]) -> Column:
    """Row vector times a small constant matrix."""
    columns = F.array(*[F.array(*[F.lit(float(x)) for x in col]) for col in zip(*matrix, strict=True)])
    return F.transform(columns, lambda c: dot(v, c))


def register_functions(spark: SparkSession) -> None:
    """vec_dot, vec_norm and vec_cos for SQL, as SQL functions that the optimizer inlines."""
    fold = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    own = "aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x)"
    other = own.replace("(a,", "(b,")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {fold}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vec_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt({own})")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vec_cos(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {fold} / nullif(sqrt({own}) * sqrt({other}), 0D)")
