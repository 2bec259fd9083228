"""Session settings the package is meant to run with."""

from pyspark.sql import SparkSession

#: Runtime settings; each keeps a value the cluster has already set.
SETTINGS = {
    # Re-plan joins and partition sizes from real sizes, split skewed join sides.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Long rule chains make long generated methods, which the JVM would not compile;
    # above this size Spark splits them instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


def builder(app: str = "tallyspark") -> SparkSession.Builder:
    build = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        build = build.config(key, value)
    return build
