"""Frames that several queries start from, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.operators.classify import classify
from tallyspark.operators.clean import normalise_descriptions, remove_noise
from tallyspark.operators.recurring import detect_recurring
from tallyspark.operators.standardise import standardise
from tallyspark.plans import tables
from tallyspark.plans.tables import _choose as choose
from tallyspark.plans.tables import derive, derive_sql, entries, event_entries, table


def standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardise(entries(spark, sf_dir))


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised transactions without noise rows, descriptions rewritten."""
    return normalise_descriptions(remove_noise(standard(spark, sf_dir)))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised, normalised and classified transactions."""
    return classify(normal(spark, sf_dir))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled transactions with recurring payments.

    Recurring payments do not depend on the category, so rows are classified last,
    once, and not again inside the interval search.
    """
    return classify(detect_recurring(normal(spark, sf_dir)))


def event_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardise(event_entries(spark, sf_dir))


def event_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(event_standard(spark, sf_dir))


def event_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_recurring(event_standard(spark, sf_dir))


# -- repeated entries ----------------------------------------------------------

#: Every entry again: even keys unchanged, odd keys in lower case.
REPEAT = {
    "row_ord": "row_ord + 1000000000",
    "raw_desc": "case when row_ord % 2 = 0 then raw_desc else lower(raw_desc) end",
}


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries twice, standardised."""
    once = entries(spark, sf_dir)
    again = once.selectExpr(*[f"{REPEAT.get(c, c)} as {c}" for c in once.columns])
    return standardise(once.unionByName(again))


def repeated_sql() -> str:
    """Needs the part ``entries``."""
    columns = list(tables.entry_columns("duckdb"))
    again = ", ".join(f"{REPEAT.get(c, c)} as {c}" for c in columns)
    return (f"select {', '.join(columns)} from entries union all select {again} from entries")


# -- side tables, from customers ------------------------------------------------

USER = "cast(cast(floor(c_custkey / 30.0) as bigint) as string)"
_USER_NO = "cast(floor(c_custkey / 30.0) as bigint)"
_BALANCE = "cast(c_acctbal as decimal(18,2))"
_SIZE = "cast(abs(c_acctbal) as decimal(18,2))"


def _per_user(values: list[str]) -> str:
    return choose(f"{_USER_NO} % {len(values)}", values)


PROFILE = {
    "user_id": USER,
    "fund": f"case when {_USER_NO} % 11 = 10 then null else abs({_BALANCE}) * "
            + _per_user(["0", "1", "2", "4", "20", "250", "450", "700"]) + " end",
    "debt": f"abs({_BALANCE}) * " + _per_user(["0", "11", "25", "45", "80"]),
}
BUDGET = {
    "user_id": USER,
    "category": choose("c_custkey % 7", [f"'{c}'" for c, _ in V.CATEGORY_TARGETS]),
    "month": "case when c_custkey % 2 = 0 then cast('2001-01-01' as date) "
             "else cast('2001-02-01' as date) end",
    "amount": f"{_SIZE} * " + _per_user(["40", "400", "4000"]),
}
GOAL = {
    "user_id": USER,
    "name": "c_name",
    "target_amount": f"cast({_SIZE} * 100 + 1000 as decimal(18,2))",
    "current_amount": f"cast({_SIZE} * (c_custkey % 12) * 10 as decimal(18,2))",
    "monthly_contribution": f"case when c_custkey % 13 = 0 then null else "
                            f"cast({_SIZE} * " + _per_user(["1", "10", "30", "60"])
                            + " as decimal(18,2)) end",
    "is_completed": "c_custkey % 4 = 0",
}


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emergency fund (null for some users) and debt."""
    return (derive(table(spark, sf_dir, "customer"), PROFILE).groupBy("user_id")
            .agg(F.sum("fund").cast("decimal(18,2)").alias("emergency_fund"),
                 F.sum("debt").cast("decimal(18,2)").alias("total_debt")))


def profiles_sql() -> str:
    return (f"select user_id, cast(sum(fund) as decimal(18,2)) emergency_fund, "
            f"cast(sum(debt) as decimal(18,2)) total_debt "
            f"from ({derive_sql('customer', PROFILE)}) group by user_id")


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (derive(table(spark, sf_dir, "customer"), BUDGET)
            .groupBy("user_id", "category", "month")
            .agg(F.sum("amount").cast("decimal(18,2)").alias("amount")))


def budgets_sql() -> str:
    return (f"select user_id, category, month, cast(sum(amount) as decimal(18,2)) amount "
            f"from ({derive_sql('customer', BUDGET)}) group by user_id, category, month")


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "customer"), GOAL)


def goals_sql() -> str:
    return derive_sql("customer", GOAL)


# -- statements, from orders ------------------------------------------------------

_DMY = ("lpad(cast(day(tx_date) as string), 2, '0')", "lpad(cast(month(tx_date) as string), 2, '0')",
        "cast(year(tx_date) as string)")
_MON = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(month(tx_date) as int) * 3 - 2, 3)"
_DEBIT = "case when tx_type = 'debit' then {0} else '' end"
_CREDIT = "case when tx_type = 'credit' then {0} else '' end"
_AMOUNT = "cast(amount as string)"
_BAL = "coalesce(cast(balance as string), '')"
_NAIRA = "concat('₦', cast(amount as string))"
_QUOTED = f"concat('\"', substr({_AMOUNT}, 1, 1), ',', substr({_AMOUNT}, 2), '\"')"


def _join(*cells: str) -> str:
    return "concat(" + ", ',', ".join(cells) + ")"


_SLASHED = f"concat({_DMY[0]}, '/', {_DMY[1]}, '/', {_DMY[2]})"
_ISO = f"concat({_DMY[2]}, '-', {_DMY[1]}, '-', {_DMY[0]})"

#: Header lines (number, text) and row text of each rendered layout, by user in turn.
RENDERED = [
    ("GTBank", ["Account Statement", "Account Name:,A CUSTOMER", "Account Number:,0123456789",
                "Currency:,NGN", "", "Date,Details,Debit,Credit,Balance"],
     _join(_SLASHED, "case when row_ord % 7 = 0 then concat(raw_desc, ' 12\" BOX') "
           "else raw_desc end", _DEBIT.format(_AMOUNT), _CREDIT.format(_AMOUNT), _BAL)),
    ("Zenith", ["Trans. Date,Remarks,Debit,Credit,Balance"],
     _join(f"concat({_DMY[0]}, '-', {_MON}, '-', {_DMY[2]})", "raw_desc",
           _DEBIT.format(_NAIRA), _CREDIT.format(_NAIRA), _BAL)),
    ("UBA", ["Transaction Date,Transaction Details,Amount,Transaction Type,Ledger Balance"],
     _join(_ISO, "raw_desc", _AMOUNT, "upper(tx_type)", _BAL)),
    ("Access", ["Trans Date,Narration,Withdrawals,Deposits,Balance"],
     _join(_SLASHED, "concat('\"', raw_desc, ', \"\"NG\"\"\"')", _DEBIT.format(_AMOUNT),
           _CREDIT.format(_AMOUNT), _BAL)),
    ("OPay", ["Date,Remark,Amount,Type,Balance"],
     _join(f"concat({_ISO}, ' 09:30:00')", "raw_desc", _AMOUNT,
           "case when tx_type = 'credit' then 'Credit' else 'Debit' end", _BAL)),
    ("Kuda", ["Date,Description,Debit,Credit,Balance"],
     _join(f"concat({_DMY[0]}, ' ', {_MON}, ' ', {_DMY[2]})", "raw_desc",
           _DEBIT.format(_QUOTED), _CREDIT.format(_QUOTED), _BAL)),
    ("generic", ["", "Posting Date,Particulars,Dr,Cr,Closing Balance"],
     _join(_ISO, "raw_desc", _DEBIT.format(_AMOUNT), _CREDIT.format(_AMOUNT), _BAL)),
]
LAYOUT_NO = f"(cast(user_id as bigint) % {len(RENDERED)})"
ROW_LINE = {
    "user_id": "user_id", "upload_id": "upload_id", "line_no": "row_ord + 10",
    "line": choose(LAYOUT_NO, [row for _, _, row in RENDERED]),
}
HEAD_LINES = max(len(head) for _, head, _ in RENDERED)
_HEAD_TEXT = "case " + " ".join(
    f"when {LAYOUT_NO} = {k} and line_no = {i} then '{text}'"
    for k, (_, head, _) in enumerate(RENDERED) for i, text in enumerate(head)) + " end"
HEAD_LINE = {"user_id": "user_id", "upload_id": "upload_id",
             "line_no": "cast(line_no as bigint)", "line": _HEAD_TEXT}


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as lines of bank statements in seven layouts."""
    rows = entries(spark, sf_dir)
    uploads = rows.select("user_id", "upload_id").distinct().withColumn(
        "line_no", F.explode(F.sequence(F.lit(0), F.lit(HEAD_LINES - 1))))
    head = derive(uploads, HEAD_LINE).where("line is not null")
    return head.unionByName(derive(rows, ROW_LINE))


def statement_lines_sql() -> str:
    """Needs the part ``entries``."""
    uploads = (f"(select user_id, upload_id, unnest(range(0, {HEAD_LINES})) line_no "
               f"from (select distinct user_id, upload_id from entries))")
    return (f"select * from ({derive_sql(uploads, HEAD_LINE)}) where line is not null "
            f"union all {derive_sql('entries', ROW_LINE)}")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per statement, as the file reader gives it.

    A statement holds the lines of at most 5,000 neighbouring order keys.
    """
    lines = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return (statement_lines(spark, sf_dir).groupBy("user_id", "upload_id")
            .agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("text"))
            .select("user_id", "upload_id", F.lit("csv").alias("file_type"), "text"))


#: Files of every user that no transaction can be read from, and why.
BAD_FILES = [
    ("bad-header", "csv", "a,b\n1,2\n", "Cannot determine date/description columns."),
    ("no-amount", "csv", "Date,Details,Balance\n01/02/2001,X,1.00\n",
     "Cannot find amount column in statement."),
    ("no-rows", "csv", "Date,Details,Debit,Credit,Balance\n", V.NO_TRANSACTIONS),
    ("noise", "csv", "Date,Details,Debit,Credit,Balance\n01/02/2001,OPENING BALANCE,5.00,,1.00\n",
     V.ALL_REMOVED),
    ("book", "xlsx", None, "Unsupported file type: xlsx"),
]


def described_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statements as described files, and the unreadable ones of every user."""
    good = statements(spark, sf_dir)
    bad = good.select("user_id").distinct().select("user_id", F.explode(F.array(*[
        F.struct(F.concat(F.lit(f"{name}-"), "user_id").alias("upload_id"),
                 F.lit(kind).alias("file_type"), F.lit(text).cast("string").alias("text"))
        for name, kind, text, _ in BAD_FILES])).alias("f")).select("user_id", "f.*")
    refused = F.col("file_type") == "xlsx"
    return good.unionByName(bad).select(
        "*", F.concat("upload_id", F.lit("."), "file_type").alias("filename"),
        F.floor(F.octet_length("text") / 1024).cast("int").alias("file_size_kb"),
        F.when(refused, "failed").otherwise("pending").alias("status"),
        F.when(refused, "Unsupported file type: xlsx").alias("error_message"))


#: Printed lines as found in statements without columns.
PRINTED = {
    "user_id": "user_id", "upload_id": "upload_id", "row_ord": "row_ord",
    "line": f"concat('  ', {choose('row_ord % 3', [_SLASHED, _ISO, f'replace({_SLASHED}, chr(47), chr(45))'])}, "
            f"'   ', raw_desc, '  ', {_QUOTED.replace(chr(34), '')}, "
            f"case when tx_type = 'credit' then 'CR' when row_ord % 2 = 0 then ' DR' else '' end, "
            f"'   ', {_BAL}, ' ')",
}


def printed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(entries(spark, sf_dir), PRINTED)


def printed_lines_sql() -> str:
    return derive_sql("entries", PRINTED)


# -- large statements, from orders -------------------------------------------------

#: A statement has the orders of a thousand neighbouring users of one layout.
LARGE_UPLOAD = f"concat({LAYOUT_NO}, '-', cast(floor(cast(user_id as bigint) / 1000) as bigint))"
#: Quoted cells of the layout ``Access`` span two lines in every fifth row.
LARGE_ROW = (f"case when {LAYOUT_NO} = 3 and row_ord % 5 = 0 then replace({ROW_LINE['line']}, "
             f"', \"\"NG', concat(chr(10), 'x, \"\"NG')) else {ROW_LINE['line']} end")


def write_large_statements(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Statements as files ``upload=<upload>/...``: header lines, then rows by user and order."""
    rows = entries(spark, sf_dir).selectExpr(
        "user_id", f"{LARGE_UPLOAD} as upload", "upload_id", "row_ord", "1 as part",
        f"{LARGE_ROW} as line")
    uploads = rows.groupBy("upload").agg(F.min("user_id").alias("user_id")).withColumn(
        "line_no", F.explode(F.sequence(F.lit(0), F.lit(HEAD_LINES - 1))))
    head = uploads.selectExpr("user_id", "upload", "'' as upload_id",
                              "cast(line_no as bigint) as row_ord", "0 as part",
                              f"{_HEAD_TEXT} as line").where("line is not null")
    (head.unionByName(rows).repartition("upload")
     .sortWithinPartitions("upload", "part", "user_id", "upload_id", "row_ord")
     .select("upload", "line").write.partitionBy("upload").text(path))
