"""The distance functions for SQL text, as temporary SQL functions: they inline into plans and run no Python."""

from pyspark.sql import SparkSession

V = "ARRAY<DOUBLE>"
FUNCTIONS = {
    "l2_sq": (f"a {V}, b {V}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
    "inner_product": (f"a {V}, b {V}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "cosine_distance": (f"a {V}, b {V}", "DOUBLE", "1D - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "norm_sq": (f"a {V}", "DOUBLE", "aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x)"),
    "labels_contain": ("labels ARRAY<BIGINT>, wanted ARRAY<BIGINT>", "BOOLEAN", "coalesce(size(array_except(wanted, labels)) = 0, false)"),
    "labels_overlap": ("labels ARRAY<BIGINT>, wanted ARRAY<BIGINT>", "BOOLEAN", "coalesce(arrays_overlap(wanted, labels), false)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make them known to the session; their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
