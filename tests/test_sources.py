import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.clean import clean_transactions, newest_first, validation_report
from tallyspark.operators.standardise import standardise
from tallyspark.sources import statements as S

GTBANK = """Statement of a current account
Branch:,NORTH QUAY

Date,Details,Debit,Credit,Balance
02/05/2026,Wages Harbour Works,,412000.50,512000.50
09/05/2026,POS GREEN GROCER 5,7300,,504700.50
21/05/2026,FERRY SEASON TICKET,18250,,486450.50
21/05/2026,FERRY SEASON TICKET,18250,,486450.50
,Closing Balance,,,
"""
QUOTES = '''
Date,Details,Amount,Balance
03/05/2026 14:33,PIZZA 12" BOX,1500 DR,10
04/05/2026 09:05:10,"RENT
PART ""2""",2000 DR,20
05/05/2026 7:01 PM,TV 40" LG,3000 DR,30
'''
DR_CR = "Date,Description,Dr,Cr,Balance\n04/05/2026,BREAD,12.00,,5\n05/05/2026,GIFT,,8.00,13\n"
OPAY = """Date,Remark,Amount,Type,Balance
01-02-2026,"RENT, ""LEKKI""\nPHASE 1",100000,Debit,50000
14-03-2026,OPay Transfer In,20000,Credit,
"""
GENERIC = "Value Date,Particulars,Dr,Cr\n2026-01-05,ÉCOLE FEES,\"1,500.00\",\n05/01/2026,BAD DATE,2.00,\n"
TEXT = """SOME BANK PLC
2026-03-15  POS SHOPRITE LEKKI   18,600.00DR   1,042,000.00
2026-03-16  Transfer from Segun    5,000.00CR       999,000.00
short
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("statements")
    for user, name, data in [("u1", "gt.csv", GTBANK.encode()), ("u1", "opay.csv", OPAY.encode()),
                             ("u2", "gen.csv", GENERIC.encode("latin-1")),
                             ("u2", "lines.txt", TEXT.encode()), ("u2", "book.xlsx", b"PK"),
                             ("u4", "quotes.csv", QUOTES.encode()),
                             ("u4", "drcr.csv", DR_CR.encode()),
                             ("u3", "none.csv", b"a,b\n1,2\n")]:
        (root / user).mkdir(exist_ok=True)
        (root / user / name).write_bytes(data)
    return str(root)


@pytest.fixture(scope="module")
def rows(spark, folder):
    got = S.ingest(S.read_files(spark, folder)).orderBy("upload_id", "row_ord").collect()
    by_upload = {}
    for r in got:
        by_upload.setdefault(r.upload_id, []).append(r)
    return by_upload


def test_files_are_described(spark, folder):
    states = {r.filename: (r.user_id, r.status, r.error_message)
              for r in S.read_files(spark, folder).collect()}
    assert states["gt.csv"] == ("u1", "pending", None)
    assert states["book.xlsx"] == ("u2", "failed", "Unsupported file type: xlsx")


def test_metadata_lines_and_split_amounts(rows):
    assert [(str(r.tx_date), r.raw_desc, float(r.amount), r.tx_type, r.row_ord)
            for r in rows["gt"]] == [
        ("2026-05-02", "Wages Harbour Works", 412000.5, "credit", 0),
        ("2026-05-09", "POS GREEN GROCER 5", 7300.0, "debit", 1),
        ("2026-05-21", "FERRY SEASON TICKET", 18250.0, "debit", 2),
        ("2026-05-21", "FERRY SEASON TICKET", 18250.0, "debit", 3)]


def test_quotes_times_and_missing_layout_columns_lose_no_row(rows):
    assert [(r.tx_date.day, r.tx_date.month, r.raw_desc, float(r.amount), float(r.balance))
            for r in rows["quotes"]] == [
        (5, 3, 'PIZZA 12" BOX', 1500.0, 10.0), (5, 4, 'RENT\nPART "2"', 2000.0, 20.0),
        (5, 5, 'TV 40" LG', 3000.0, 30.0)]
    assert [(r.raw_desc, float(r.amount), r.tx_type) for r in rows["drcr"]] == [
        ("BREAD", 12.0, "debit"), ("GIFT", 8.0, "credit")]


def test_layout_dates_fall_back_to_mixed_and_quotes_span_lines(rows):
    first, second = rows["opay"]
    assert (first.raw_desc, first.tx_date) == ('RENT, "LEKKI"\nPHASE 1', dt.date(2026, 1, 2))
    assert (second.tx_type, second.balance, second.tx_date) == (
        "credit", None, dt.date(2026, 3, 14))


def test_generic_columns_latin1_and_first_date_pattern(rows):
    assert [(r.raw_desc, float(r.amount), r.tx_date) for r in rows["gen"]] == [
        ("ÉCOLE FEES", 1500.0, dt.date(2026, 1, 5)), ("BAD DATE", 2.0, None)]


def test_printed_lines(rows):
    assert [(r.raw_desc, float(r.amount), r.tx_type, float(r.balance)) for r in rows["lines"]] == [
        ("POS SHOPRITE LEKKI", 18600.0, "debit", 1042000.0),
        ("Transfer from Segun", 5000.0, "credit", 999000.0)]


def test_unreadable_header_is_reported(spark, folder):
    scanned = S.scan(S.read_files(spark, folder).where("status = 'pending'"))
    errors = {r.upload_id: r.error_message for r in scanned.collect()}
    assert errors["none"] == "Cannot determine date/description columns."
    assert errors["gt"] is None


def test_scan_has_no_shuffle(spark, folder):
    plan = S.ingest(S.read_files(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_statement_to_clean_transactions(spark, folder):
    files = S.read_files(spark, folder).where("upload_id = 'gt'")
    cleaned = clean_transactions(standardise(S.ingest(files)))
    got = newest_first(cleaned).collect()
    assert [r.raw_desc for r in got] == ["FERRY SEASON TICKET", "POS GREEN GROCER 5",
                                         "Wages Harbour Works"]
    assert all(len(r.fingerprint) == 64 for r in got)
    report = validation_report(cleaned).collect()[0]
    assert (report.total_rows, float(report.total_debits), report.warnings) == (3, 25550.0, [])


def test_table_headers_carry_over_pages(spark):
    def page(no, rows):
        return ("u", "s", no, rows)

    tables = spark.createDataFrame([
        page(0, [["Statement", None, ""], ["Date", "Narration", "Amount"],
                 ["2026-01-01", "SPAR", "1,000.00"], ["", "", ""],
                 ["", "Closing Balance", "9"]]),
        page(1, [["2026-01-02", "UBER", "500 CR"], ["2026-01-03", "KFC"]]),
    ], "user_id string, upload_id string, table_no int, rows array<array<string>>")
    normal = S.normalise_tables(tables)
    assert {tuple(r.header) for r in normal.collect()} == {("date", "narration", "amount")}
    got = S.map_table_rows(normal).orderBy("row_ord").collect()
    assert [(r.raw_desc, None if r.amount is None else float(r.amount), r.tx_type)
            for r in got] == [("SPAR", 1000.0, "debit"), ("UBER", 500.0, "credit"),
                              ("KFC", 0.0, "debit")]


def test_tables_without_any_header_use_the_first_row(spark):
    tables = spark.createDataFrame([
        ("u", "s", 0, [["x", "y"], ["1", "2"]]), ("u", "s", 1, [["3", "4"], ["5", ""]]),
    ], "user_id string, upload_id string, table_no int, rows array<array<string>>")
    got = S.normalise_tables(tables).orderBy("table_no", "row_no").collect()
    assert [(r.header, r.cells) for r in got] == [
        (["x", "y"], ["1", "2"]), (["x", "y"], ["3", "4"]), (["x", "y"], ["5", ""])]


def test_header_is_not_carried_from_a_table_without_rows(spark):
    tables = spark.createDataFrame([
        ("u", "s", 0, [["Date", "Narration", "Amount"], ["1/2/2026", "A", "5.00"]]),
        ("u", "s", 1, [["Reference", "Balance", "Channel"], ["", "Opening Balance", ""]]),
        ("u", "s", 2, [["1/3/2026", "B", "6.00"], ["1/4/2026", "C", "7.00"]]),
    ], "user_id string, upload_id string, table_no int, rows array<array<string>>")
    got = S.map_table_rows(S.normalise_tables(tables)).orderBy("row_ord").collect()
    assert [(r.raw_desc, float(r.amount), r.row_ord) for r in got] == [
        ("A", 5.0, 1), ("B", 6.0, 4), ("C", 7.0, 5)]


def test_description_comes_before_narration(spark):
    tables = spark.createDataFrame([
        ("u", "s", 0, [["Date", "Narration", "Description", "Amount"],
                       ["1/2/2026", "n", "d", "5.00"]])],
        "user_id string, upload_id string, table_no int, rows array<array<string>>")
    assert S.map_table_rows(S.normalise_tables(tables)).collect()[0].raw_desc == "d"


def test_large_files_are_read(spark, tmp_path):
    (tmp_path / "u").mkdir()
    line = "01/05/2026,%s %06d,5.00,,1.00\n"
    (tmp_path / "u" / "big.csv").write_text(
        "Date,Details,Debit,Credit,Balance\n"
        + "".join(line % ("X" * 700, i) for i in range(15_500)))
    assert (tmp_path / "u" / "big.csv").stat().st_size > 11_000_000
    files = S.read_files(spark, str(tmp_path))
    assert S.ingest(files).where("amount = 5").count() == 15_500
    refused = S.read_files(spark, str(tmp_path), max_bytes=10 * 1024 * 1024)
    assert refused.collect()[0].error_message == "File too large. Max 10MB."


def test_files_above_a_given_limit_are_refused(spark):
    files = spark.createDataFrame([("/d/u/a.csv", dt.datetime(2026, 1, 1), 11 * 1024 * 1024,
                                    bytearray(b"x"))],
                                  "path string, modificationTime timestamp, length long, "
                                  "content binary")
    row = S.describe_files(files, max_bytes=10 * 1024 * 1024).select("status", "error_message", F.col("text")).collect()[0]
    assert tuple(row) == ("failed", "File too large. Max 10MB.", None)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cells_are_read_once_a_row(spark):
    files = spark.createDataFrame([("u", "s", "csv", "x")],
                                  "user_id string, upload_id string, file_type string, text string")
    # One search gives all cells of a printed line.
    assert "regexp_extract" not in _plan(files.select(S.text_cells(F.col("text"))))
    # One number each for debit, credit, amount and balance.
    assert _plan(S.read_statements(files)).count("₦") <= 4


def test_lines_after_the_header_are_not_tested(spark):
    # The third line can't be read as a number: testing it would fail.
    lines = F.array(*[F.lit(x) for x in ["0", "1", "x"]])
    tested = S._first_place(lines, lambda c: c.cast("int") > 0)
    assert spark.range(1).select(tested.alias("n")).first().n == 2
    heads = ["\n\nDate,Details\nDate,Debit", "a\nb", "", "\n \n x"]
    got = spark.createDataFrame([(t,) for t in heads], "text string").select(
        S.header_line(F.col("text")).alias("n")).collect()
    assert [r.n for r in got] == [2, 0, 0, 2]


def test_printed_groups_may_hold_any_character(spark):
    lines = [" \t2026-03-15  A B  1,000.00DR  5.00", "x 1/2/26 POS $1 \\ |  7 CR",
             "2026-03-15  \x01TAB\tBED  12.5\n", "2026-03-15", None]
    got = [r.c for r in spark.createDataFrame([(x,) for x in lines], "x string").select(
        S.text_cells(F.col("x")).alias("c")).collect()]
    # A line separator ends the description's search, so no cell holds one.
    assert got == [None, ["1/2/26", "POS $1 \\ |", "7 CR", ""],
                   ["2026-03-15", "\x01TAB\tBED", "12.5", ""], None, None]
