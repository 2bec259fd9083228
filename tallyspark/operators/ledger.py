"""Stored tables: write semantics and the reports read from them."""

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyspark.functions import fixed_values as V
from tallyspark.functions.money import finite
from tallyspark.operators.clean import keep_first
from tallyspark.operators.summary import period_category_spend


# -- write semantics ---------------------------------------------------------

def storable(tx: DataFrame) -> DataFrame:
    """Stored form of transactions: text cut to the stored widths."""
    return tx.select(*[
        F.substring(c, 1, V.STORED_WIDTHS[c]).alias(c) if c in V.STORED_WIDTHS else F.col(c)
        for c in tx.columns])


def new_transactions(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows whose (user, fingerprint) is not stored yet, one per fingerprint.

    Only the two key columns of the stored table are read.
    """
    known = stored.select("user_id", "fingerprint")
    fresh = keep_first(incoming, ["user_id", "fingerprint"], ["row_ord", "upload_id"])
    return storable(fresh.join(known, ["user_id", "fingerprint"], "left_anti")
                    .select(*incoming.columns))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace stored rows with the same key."""
    both = (stored.withColumn("_new", F.lit(0))
            .unionByName(incoming.withColumn("_new", F.lit(1))))
    return keep_first(both, keys, [F.desc("_new")]).drop("_new")


def replace_for_users(stored: DataFrame, incoming: DataFrame, users: DataFrame) -> DataFrame:
    """All rows of the given users are replaced by the incoming ones."""
    kept = stored.join(users.select("user_id").distinct(), "user_id", "left_anti")
    return kept.unionByName(incoming)


def sanitise(df: DataFrame) -> DataFrame:
    """Null in place of NaN and infinities, wherever a column holds doubles."""
    def clean(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return finite(value)
        if not holds_doubles(kind):
            return value
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(value, lambda _, x: clean(x, kind.valueType))
        fields = [clean(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def holds_doubles(kind: T.DataType) -> bool:
    """Whether a type has doubles at any depth (map keys aside)."""
    if isinstance(kind, T.ArrayType):
        return holds_doubles(kind.elementType)
    if isinstance(kind, T.MapType):
        return holds_doubles(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(holds_doubles(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.DoubleType, T.FloatType))


# -- reports -----------------------------------------------------------------

def top_recent(df: DataFrame, order: list, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def upload_history(uploads: DataFrame) -> DataFrame:
    """The twenty newest uploads of each user."""
    return top_recent(uploads, [F.desc("created_at"), "upload_id"], V.HISTORY_LENGTH)


def jobs_by_user(jobs: DataFrame, user_id: str | None = None) -> DataFrame:
    """Jobs of one user (or of all), most recent first within a user."""
    mine = jobs if user_id is None else jobs.where(F.col("user_id") == user_id)
    return mine.orderBy("user_id", F.desc("seq"))


def manual_ledger(changes: DataFrame) -> DataFrame:
    """Current manual entries from a log of add, update and delete changes.

    An entry lives if it was added and not deleted since. Its latest change replaces
    all its fields; it keeps the place in the list where it was added. Changes of an
    entry that isn't there do nothing.
    """
    keys = ["user_id", "entry_id"]
    fields = [c for c in changes.columns if c not in keys]
    gone = (changes.where("op = 'delete'").groupBy(keys)
            .agg(F.max("seq").alias("gone_seq")))
    since = (changes.where("op <> 'delete'").join(gone, keys, "left")
             .where(F.col("gone_seq").isNull() | (F.col("seq") > F.col("gone_seq"))))
    # The latest change comes after the first add, if there is one.
    latest = (since.groupBy(keys).agg(
        F.min(F.when(F.col("op") == "add", F.col("seq"))).alias("added_seq"),
        F.max_by(F.struct(*fields), "seq").alias("now"))
        .where("added_seq is not null").select(*keys, "added_seq", "now.*"))

    def default(name: str, value: str) -> Column:
        return F.coalesce(F.when(F.col(name) != "", F.col(name)), F.lit(value)).alias(name)

    return latest.select(
        "user_id", "entry_id", "added_seq", "tx_date", "description", "amount", "tx_type",
        default("category", "miscellaneous"), default("channel", "cash"),
        default("notes", ""))


def transaction_list(tx: DataFrame, user_id: str | None = None, since=None, until=None,
                     category: str | None = None, tx_type: str | None = None,
                     limit: int | None = None) -> DataFrame:
    """Transactions by the given filters, newest first.

    The filters are plain comparisons, so they reach a partitioned or clustered store.
    """
    wanted = [("user_id", "=", user_id), ("tx_date", ">=", since), ("tx_date", "<=", until),
              ("category", "=", category), ("tx_type", "=", tx_type)]
    for column, comparison, value in wanted:
        if value is not None:
            col = F.col(column)
            tx = tx.where(col == value if comparison == "=" else
                          col >= F.lit(value).cast("date") if comparison == ">=" else
                          col <= F.lit(value).cast("date"))
    ordered = tx.orderBy(F.desc("tx_date"), F.desc("amount"), "row_ord", "upload_id")
    return ordered if limit is None else ordered.limit(limit)


def goal_progress(goals: DataFrame) -> DataFrame:
    """Share reached and months left at the planned contribution."""
    target, current = (F.col(c).cast("double") for c in ("target_amount", "current_amount"))
    gap = F.greatest(target - current, F.lit(0.0))
    return goals.select(
        "user_id", "name", F.round(F.least(F.lit(1.0), F.try_divide(current, target)), 6)
        .alias("progress"),
        gap.alias("remaining"),
        F.ceil(F.try_divide(gap, F.col("monthly_contribution").cast("double"))).cast("bigint")
        .alias("months_left"),
        (F.coalesce("is_completed", F.lit(False)) | (current >= target)).alias("is_reached"))


def dashboard(months: DataFrame, spend: DataFrame, month: str | None = None) -> DataFrame:
    """Monthly summary with that month's category spend, for one month or the latest."""
    chosen = (months.where(F.col("month") == F.lit(month).cast("date")) if month else
              keep_first(months, ["user_id"], [F.desc("month")]))
    return (chosen.withColumnRenamed("tx_count", "month_tx_count")
            .join(spend, ["user_id", "month"], "left"))


def active_recommendations(recs: DataFrame, now: Column) -> DataFrame:
    """Stored recommendations that are neither dismissed nor expired, by priority."""
    return (recs.where(~F.coalesce("is_dismissed", F.lit(False)))
            .where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
            .orderBy("user_id", "priority", "title"))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    return keep_first(snapshots, ["user_id"], [F.desc("month")])


def stored_snapshot(summary: DataFrame, health: DataFrame, spend: DataFrame) -> DataFrame:
    """Monthly health snapshot rows with JSON breakdowns.

    ``summary`` and ``spend`` are monthly, ``health`` has one row per user. A month
    has at most one row per category, so the collected map is bounded by the
    category table.
    """
    by_category = spend.groupBy("user_id", "month").agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(
            F.struct("slug", "total"))))).alias("expense_by_category"))
    income, net = F.col("total_income").cast("double"), F.col("net_savings").cast("double")
    rate = F.when(income > 0, F.round(F.try_divide(net, income), 4)).otherwise(F.lit(0.0))
    return (summary.join(by_category, ["user_id", "month"], "left")
            .join(health.select("user_id", F.col("score").alias("health_score"),
                                F.to_json("breakdown").alias("score_breakdown")),
                  "user_id", "left")
            .select("user_id", "month", "total_income", "total_expenses", "net_savings",
                    rate.alias("savings_rate"), "health_score", "score_breakdown",
                    "expense_by_category"))


def result_documents(summary: DataFrame, tx: DataFrame, recurring: DataFrame,
                     validation: DataFrame, banks: DataFrame, health: DataFrame | None = None,
                     recommendations: DataFrame | None = None,
                     forecast: DataFrame | None = None,
                     outlook: DataFrame | None = None) -> DataFrame:
    """JSON results of every user as (user_id, part, item, document).

    Part "result" is one document per user: summary, category map, validation. A
    user's recurring payments and transactions have no bound, so they are not folded
    into one value; they follow as one document each, parts "recurring" and
    "transaction", under the same user. The analytics given are parts "health_score" (one
    document), "recommendation" (one each, item its rank) and "cash_flow_forecast" (one of
    the ``outlook`` with the days of ``forecast``, whose number is the horizon).
    """
    spend = period_category_spend(tx).groupBy("user_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(
            F.struct("category", F.col("total").cast("double"))))).alias("category_spend"))
    counts = recurring.groupBy("user_id").agg(F.count(F.lit(1)).alias("recurring_count"))
    checks = validation.select("user_id", F.struct(
        *[c for c in validation.columns if c != "user_id"]).alias("validation_report"))
    joined = (summary.join(spend, "user_id", "left").join(counts, "user_id", "left")
              .join(checks, "user_id", "left")
              .join(banks.select("user_id", F.col("bank").alias("bank_detected")), "user_id",
                    "left"))
    totals = F.struct(*[F.col(c).cast("double").alias(c)
                        for c in ("total_income", "total_expenses", "net_savings",
                                  "savings_rate_pct")])
    results = joined.select(
        "user_id", F.lit("result").alias("part"), F.lit("").alias("item"),
        F.to_json(F.struct(
            F.lit("success").alias("status"), "tx_count", "bank_detected", "period_start",
            "period_end", totals.alias("summary"), "category_spend",
            F.coalesce("recurring_count", F.lit(0)).alias("recurring_count"),
            "validation_report", F.col("validation_report.warnings").alias("warnings")))
        .alias("document"))
    payments = recurring.select(
        "user_id", F.lit("recurring").alias("part"), F.col("name").alias("item"),
        F.to_json(F.struct(
            "name", "frequency", "estimated_monthly", "last_charged",
            F.coalesce(F.col("next_estimated").cast("string"), F.lit("Unknown"))
            .alias("next_estimated"),
            "action", "occurrence_count", "amount_variation")).alias("document"))
    records = transaction_documents(tx).select(
        "user_id", F.lit("transaction").alias("part"),
        F.concat_ws("/", "upload_id", "row_ord").alias("item"),
        F.col("record").alias("document"))
    parts = [results, payments, records]

    def part(df: DataFrame, name: str, item, *fields) -> DataFrame:
        return df.select("user_id", F.lit(name).alias("part"), item.alias("item"),
                         F.to_json(F.struct(*fields)).alias("document"))

    if health is not None:
        parts.append(part(health, "health_score", F.lit(""), "score", "grade", "breakdown",
                          "insights"))
    if recommendations is not None:
        parts.append(part(recommendations, "recommendation", F.col("rank").cast("string"),
                          *[c for c in recommendations.columns if c != "user_id"]))
    if forecast is not None:
        days = forecast.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(
            *[c for c in forecast.columns if c != "user_id"]))).alias("daily_forecast"))
        if outlook is not None:
            days = outlook.join(days, "user_id", "left")
        parts.append(part(days, "cash_flow_forecast", F.lit(""),
                          *[c for c in days.columns if c != "user_id"]))
    union = parts[0]
    for more in parts[1:]:
        union = union.unionByName(more)
    return union


def transaction_documents(tx: DataFrame) -> DataFrame:
    """One JSON record per transaction."""
    return tx.select("user_id", "upload_id", "row_ord",
                     F.to_json(F.struct(*[c for c in tx.columns])).alias("record"))
