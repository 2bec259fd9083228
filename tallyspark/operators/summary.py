"""Per-user and per-period aggregates."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.functions.money import rounded
from tallyspark.operators.blocks import running_sum
from tallyspark.operators.clean import keep_first
from tallyspark.schema import MONEY

IS_CREDIT = "tx_type = 'credit'"
IS_DEBIT = "tx_type = 'debit'"


def sum_where(condition: str, column: str = "amount") -> Column:
    return F.expr(f"cast(coalesce(sum(case when {condition} then {column} end), 0) "
                  "as decimal(18,2))")


def signed() -> Column:
    return F.when(F.expr(IS_CREDIT), F.col("amount")).otherwise(-F.col("amount"))


def categories(spark: SparkSession) -> DataFrame:
    """The category table; its size is fixed."""
    return spark.createDataFrame(V.CATEGORIES,
                                 "category_id int, name string, slug string, is_income boolean")


def monthly_summary(tx: DataFrame) -> DataFrame:
    return (tx.groupBy("user_id", F.trunc("tx_date", "month").alias("month"))
            .agg(sum_where(IS_CREDIT).alias("total_income"),
                 sum_where(IS_DEBIT).alias("total_expenses"),
                 F.sum(signed()).cast(MONEY).alias("net_savings"),
                 F.count(F.lit(1)).alias("tx_count")))


def category_spend(tx: DataFrame) -> DataFrame:
    """Debits by user, month and category, with category names.

    Amounts are summed before the join, so the join sees one row per group.
    """
    spend = (tx.where(IS_DEBIT)
             .groupBy("user_id", F.trunc("tx_date", "month").alias("month"), "category")
             .agg(F.sum("amount").cast(MONEY).alias("total"),
                  F.count(F.lit(1)).alias("tx_count")))
    names = categories(tx.sparkSession).select("slug", F.col("name").alias("_name"))
    return (spend.join(F.broadcast(names), spend.category == names.slug)
            .select("user_id", "month", F.col("_name").alias("category"), "slug", "total",
                    "tx_count"))


def period_category_spend(tx: DataFrame) -> DataFrame:
    return (tx.where(IS_DEBIT).groupBy("user_id", "category")
            .agg(F.sum("amount").cast(MONEY).alias("total")))


def period_summary(tx: DataFrame) -> DataFrame:
    """Income, expenses, net, savings rate and period of each user."""
    totals = tx.groupBy("user_id").agg(
        sum_where(IS_CREDIT).alias("total_income"),
        sum_where(IS_DEBIT).alias("total_expenses"),
        F.min("tx_date").alias("period_start"), F.max("tx_date").alias("period_end"),
        F.count(F.lit(1)).alias("tx_count"))
    return with_rate(totals)


def with_rate(totals: DataFrame) -> DataFrame:
    """Add net savings and the savings rate to sums of income and expenses."""
    net = F.col("total_income") - F.col("total_expenses")
    return (totals.withColumn("net_savings", net.cast(MONEY))
            .withColumn("savings_rate_pct", F.when(
                F.col("total_income") > 0,
                rounded(F.try_divide(F.col("net_savings").cast("double"),
                                     F.col("total_income").cast("double")) * 100, 2))
                .otherwise(F.lit(0.0))))


def dominant_bank(tx: DataFrame) -> DataFrame:
    """Most frequent bank of each user; ties go to the first name."""
    counts = (tx.where("bank is not null").groupBy("user_id", "bank")
              .agg(F.count(F.lit(1)).alias("n")))
    return keep_first(counts, ["user_id"], [F.desc("n"), "bank"])


def running_balance(tx: DataFrame, opening: float = 0) -> DataFrame:
    """Opening amount plus all signed amounts up to each transaction; rows of two uploads
    with the same day and place count in the order of the uploads' ids."""
    summed = running_sum(tx, signed(), ["user_id"], "tx_date", "row_ord", "running_balance",
                         ("upload_id",))
    return summed.withColumn("running_balance",
                             (F.col("running_balance") + F.lit(opening)).cast("decimal(28,2)"))


CHECKS = ["tx_type_domain", "unique_fingerprint", "unique_budget", "unique_snapshot",
          "upload_reference", "category_reference"]


def constraint_checks(tx: DataFrame, uploads: DataFrame, budgets: DataFrame,
                      snapshots: DataFrame) -> DataFrame:
    """Violations per table constraint: domain (rows), uniqueness (keys held by several rows),
    references (distinct keys that refer to nothing; null is such a key).

    Every row yields the keys it has in each check, and one aggregate counts the rows that use
    a key and those that own it. So each table is read once, whatever the number of checks, and
    keys are summed up before the one shuffle of keys.
    """
    def key(check: str, *columns: str, uses: Column = F.lit(1), owns: Column = F.lit(0)) -> Column:
        parts = [F.col(c).cast("string") for c in columns]
        parts += [F.lit(None).cast("string")] * (3 - len(parts))
        return F.struct(F.lit(check).alias("check_name"),
                        *[p.alias(f"k{n}") for n, p in enumerate(parts)],
                        uses.cast("long").alias("uses"), owns.cast("long").alias("owns"))

    def keys(df: DataFrame, *found: Column) -> DataFrame:
        return df.select(F.inline(F.array(*found)))

    valid = F.coalesce(F.col("tx_type").isin("debit", "credit"), F.lit(False))
    slug = F.coalesce(F.col("category").isin([c[2] for c in V.CATEGORIES]), F.lit(False))
    parts = [
        keys(tx, key("tx_type_domain", uses=(~valid).cast("int")),
             key("unique_fingerprint", "user_id", "fingerprint"),
             key("upload_reference", "upload_id"),
             key("category_reference", "category", owns=slug.cast("int"))),
        keys(uploads.where("upload_id is not null"),
             key("upload_reference", "upload_id", uses=F.lit(0), owns=F.lit(1))),
        keys(budgets, key("unique_budget", "user_id", "category", "month")),
        keys(snapshots, key("unique_snapshot", "user_id", "month")),
        # Checks without a row are reported too.
        tx.sparkSession.createDataFrame([(c, None, None, None, 0, 0) for c in CHECKS],
                                        "check_name string, k0 string, k1 string, k2 string, "
                                        "uses long, owns long")]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    counted = union.groupBy("check_name", "k0", "k1", "k2").agg(
        F.sum("uses").alias("uses"), F.sum("owns").alias("owns"))
    violations = (F.when(F.col("check_name") == "tx_type_domain", F.col("uses"))
                  .when(F.col("check_name").startswith("unique"), (F.col("uses") > 1).cast("long"))
                  .otherwise(((F.col("uses") > 0) & (F.col("owns") == 0)).cast("long")))
    return counted.groupBy("check_name").agg(F.sum(violations).alias("violations"))
