"""Statement files to transaction entries.

A statement is one row (user_id, upload_id, text). Files of any size are read; an upload
route that refuses large ones passes its limit as ``max_bytes``. Everything up to the
exploded entries is array work on that row: a whole folder of statements is read in one
pass without a shuffle.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.functions.dates import MIXED, day_of, mixed_day, read_as, without_time
from tallyspark.functions.money import parse_money, signed_amount, split_amounts, typed_amount
from tallyspark.functions.once import with_once
from tallyspark.functions.sqltext import case, quoted
from tallyspark.functions.text import any_of
from tallyspark.schema import MONEY
from tallyspark.sources import layouts

LINE_BREAK = r"\r\n|\r|\n"
CSV_TYPES = ["csv"]
TEXT_TYPES = ["txt"]
#: A cell of a delimited record: quoted only if it starts with a quote that is closed. A
#: quote elsewhere is plain text.
CELL = r'"(?:[^"]++|"")*+"[^,\r\n]*+|[^,\r\n]*+'
TEXT_HEADER = ["date", "description", "amount", "balance"]


# -- files --------------------------------------------------------------------

def read_files(spark: SparkSession, path: str, file_type: str | None = None,
               max_bytes: int | None = None) -> DataFrame:
    """Statement files under a folder laid out as ``<user>/<upload>.<type>``.

    ``status`` is pending for readable files and failed, with a reason, for others.
    Contents of refused files are not decoded.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    return describe_files(files, file_type, max_bytes)


def describe_files(files: DataFrame, file_type: str | None = None,
                   max_bytes: int | None = None) -> DataFrame:
    """User, upload, type, text and status of binaryFile rows.

    Files above ``max_bytes`` are refused, if it is given (the default of uploads is
    ``fixed_values.MAX_UPLOAD_BYTES``).
    """
    name = F.element_at(F.split("path", "/"), -1)
    kind = (F.lit(file_type) if file_type else
            F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)))
    supported = kind.isin(*CSV_TYPES, *TEXT_TYPES)
    error = F.when(~supported, F.concat(F.lit("Unsupported file type: "), kind))
    if max_bytes is not None:
        error = error.when(F.col("length") > max_bytes,
                           f"File too large. Max {max_bytes // 1024 // 1024}MB.")
    return (files.select(
        F.element_at(F.split("path", "/"), -2).alias("user_id"),
        F.regexp_replace(name, r"\.[^.]+$", "").alias("upload_id"),
        name.alias("filename"), kind.alias("file_type"),
        F.floor(F.col("length") / 1024).cast("int").alias("file_size_kb"),
        F.col("modificationTime").alias("created_at"),
        F.when(error.isNull(), decode("content")).alias("text"),
        F.when(error.isNull(), "pending").otherwise("failed").alias("status"),
        error.alias("error_message")))


def decode(content: str) -> Column:
    """UTF-8 text, or Latin-1 where the bytes are not valid UTF-8."""
    text = F.col(content).cast("string")
    decoded = F.when(F.is_valid_utf8(text), text).otherwise(
        F.decode(F.col(content), "ISO-8859-1"))
    return F.regexp_replace(decoded, "^\\uFEFF", "")


# -- delimited statements -------------------------------------------------------

def plain_cells(line: Column) -> Column:
    """Lower-case comma pieces of a line, for recognising headers."""
    return F.transform(F.split(line, ","),
                       lambda c: F.btrim(F.lower(F.trim(c)), F.lit('"')))


def is_header_line(line: Column) -> Column:
    """True where a line shares two different cells with the known header cells."""
    known = F.array(*[F.lit(c) for c in V.HEADER_CELLS])
    return F.size(F.array_intersect(plain_cells(line), known)) >= 2


def _first_place(lines: Column, holds: Callable[[Column], Column]) -> Column:
    """Place, from 1, of the first line for which a test holds, else null. Lines after it are
    not tested."""
    found = F.aggregate(
        lines, F.struct(F.lit(0).alias("n"), F.lit(0).alias("at")), lambda s, line: F.struct(
            (s["n"] + 1).alias("n"), F.when(s["at"] > 0, s["at"])
            .when(holds(line), s["n"] + 1).otherwise(0).alias("at")))
    return F.nullif(found["at"], F.lit(0))


def header_line(text: Column) -> Column:
    """Zero-based number of the header among the first 15 lines, else of the first line that
    isn't blank."""
    head = F.slice(F.split(text, LINE_BREAK, V.HEADER_SCAN_LINES + 1), 1, V.HEADER_SCAN_LINES)
    return F.greatest(F.coalesce(
        _first_place(head, is_header_line),
        _first_place(head, lambda line: F.trim(line) != "")) - 1, F.lit(0))


def csv_cells(record: Column) -> Column:
    """Cells of a comma-separated record; quoted cells may hold commas and quotes."""
    pieces = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({CELL})"), 1)
    cells = F.transform(pieces, lambda c: F.when(
        c.startswith('"'),
        F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    plain = ~(record.contains('"') | record.contains("\n") | record.contains("\r"))
    return F.when(plain, F.split(record, ",")).otherwise(cells)


def is_data_row(cells: Column) -> Column:
    """True where a row shows a date or an amount."""
    joined = F.array_join(cells, " ")
    return joined.rlike(V.DATA_ROW_DATE) | joined.rlike(V.DATA_ROW_AMOUNT)


def records(text: Column) -> Column:
    """Non-blank records of a text: cells joined by commas; a quoted cell may span lines."""
    found = F.when(~text.contains('"'), F.split(text, r"[\r\n]+")).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?:{CELL})(?:,(?:{CELL}))*+"), 0))
    return F.filter(found, lambda r: F.trim(r) != "")


def text_cells(line: Column) -> Column:
    """Date, description, amount and balance cells of a printed line, else null."""
    def cells(trimmed):
        fits = (F.length(trimmed) >= V.TEXT_LINE_MIN_CHARS) & trimmed.rlike(V.TEXT_LINE)
        # All groups by one search, between separators that none of them can hold.
        groups = F.regexp_replace(trimmed, f"^(?s:.*?){V.TEXT_LINE}(?s:.*)",
                                  "$1\u2028$2\u2028$3\u2028$4")
        return F.when(fits, F.transform(F.split(groups, "\u2028"), lambda c: F.trim(c)))

    # The trimmed line is bound to a name, so that it is made once.
    return F.get(F.transform(F.array(F.btrim(line, F.lit(" \t\n\x0b\f\r"))), cells), F.lit(0))


def scan(statements: DataFrame) -> DataFrame:
    """Header, column positions and data rows of statements, one row per statement.

    ``statements`` holds user_id, upload_id, file_type and text. Delimited and
    printed statements are read in the same pass: a printed line becomes four cells
    under a fixed header.
    """
    printed = F.col("file_type").isin(*TEXT_TYPES)
    csv_rows = F.filter(F.transform(records(F.coalesce("_body", F.lit(""))), csv_cells),
                        is_data_row)
    text_rows = F.array_compact(F.transform(F.split("text", LINE_BREAK), text_cells))
    parts = with_once(with_once(statements, "header_line",
                                F.when(~printed, header_line(F.col("text")))),
                      "_parts", F.when(~printed, F.split(F.col("text"), LINE_BREAK,
                                                         F.col("header_line") + 2)))
    headed = with_once(parts.withColumn("_body", F.get("_parts", F.col("header_line") + 1)),
                       "header", F.when(printed, F.array(*[F.lit(c) for c in TEXT_HEADER]))
                       .otherwise(csv_cells(F.get("_parts", F.col("header_line")))))
    return (layouts.with_positions(headed)
            .withColumn("error_message", F.expr(layouts.PROBLEM))
            .withColumn("rows", F.when(printed, text_rows).otherwise(csv_rows))
            .select("user_id", "upload_id", "file_type", "header_line", "header", "columns",
                    "error_message", "rows"))


def _parsed(text: str, pattern: str, patterns: list[str], day: str | None = None) -> str:
    """Date by the pattern a column names; ``day`` is the text without its time of day."""
    return case([(f"{pattern} = {quoted(p)}",
                  f"cast({read_as(day_of(text, p, day), p)} as date)")
                 for p in patterns])


def _guessed(day: str) -> str:
    """The first pattern that fits a text without its time of day."""
    return case([(f"{read_as(day, p)} is not null", quoted(p))
                 for p in MIXED], "cast(null as string)")


def _date_pattern() -> str:
    """How a statement's dates are read.

    A layout's own pattern if any value fits it, else "mixed"; without a layout, the
    pattern of the first non-empty value.
    """
    known = sorted({layout[-1] for layout in V.LAYOUTS})
    return (f"case when columns.pattern is null then {_guessed('_first')} "
            f"when exists(_dates, d -> {_parsed('d', 'columns.pattern', known)} is not null) "
            f"then columns.pattern else 'mixed' end")


def _money(text: str, value: Column | None = None) -> Column:
    """Number of a cell (``value``, if it is at hand); an empty cell is missing."""
    return F.when(F.trim(text) != "", parse_money(F.col(text)) if value is None else value)


def _entry_columns(amount: Column, tx_date: Column, balance: Column | None = None
                   ) -> list[Column]:
    """Entry columns from the cells of one row."""
    balance = _money("_balance") if balance is None else balance
    return ["user_id", "upload_id", "row_ord", tx_date.alias("tx_date"),
            F.trim(F.coalesce("_desc", F.lit(""))).alias("raw_desc"),
            F.round(amount["amount"], 2).try_cast(MONEY).alias("amount"),
            amount["tx_type"].alias("tx_type"),
            F.round(balance, 2).try_cast(MONEY).alias("balance")]


def _cells(df: DataFrame) -> DataFrame:
    """One column per meaning, from the cells and the positions of a row."""
    return df.selectExpr("*", *[f"get(cells, columns.{field} - 1) as _{field}"
                                for field in V.LAYOUT_FIELDS])


def map_rows(scanned: DataFrame, day_first: bool = False) -> DataFrame:
    """Data rows to entries by column positions.

    ``day_first`` changes only how ambiguous dates are read when no pattern fits.
    """
    dates = "filter(transform(rows, r -> get(r, columns.date - 1)), d -> trim(d) <> '')"
    readable = scanned.where("error_message is null").withColumn("_dates", F.expr(dates))
    readable = with_once(readable, "_first", without_time(F.get("_dates", F.lit(0))))
    return entries_of(readable.selectExpr("*", f"{_date_pattern()} as _pattern").selectExpr(
        "user_id", "upload_id", "columns", "_pattern", "posexplode(rows) as (pos, cells)"),
        day_first)


def date_patterns(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, _pattern) of statements whose data rows (columns, cells) are rows of their own."""
    text = F.expr("get(cells, columns.date - 1)")
    dated = with_once(rows.select(key, order, "columns.pattern", text.alias("_text")), "_day",
                      without_time(F.col("_text")))
    known = sorted({layout[-1] for layout in V.LAYOUTS})
    fits = F.expr(f"{_parsed('_text', 'pattern', known)} is not null")
    filled = F.trim("_text") != ""
    return (dated.groupBy(key, "pattern").agg(
        F.bool_or(fits & filled).alias("_fits"),
        F.min_by(F.when(filled, F.col("_day")), F.when(filled, F.col(order))).alias("_first"))
        .select(key, F.expr(f"""case when pattern is null then {_guessed('_first')}
                                when _fits then pattern else 'mixed' end""").alias("_pattern")))


def entries_of(rows: DataFrame, day_first: bool = False) -> DataFrame:
    """Entries of data rows (user_id, upload_id, columns, _pattern, pos, cells)."""
    rows = _cells(rows).withColumn("row_ord", F.col("pos").cast("bigint"))
    # The amounts below use a cell's number several times; every cell is read once here.
    rows = with_once(rows, "_read", F.struct(
        without_time(F.col("_date")).alias("day"), _money("_debit").alias("debit"),
        _money("_credit").alias("credit"), parse_money(F.col("_amount")).alias("amount"),
        _money("_balance").alias("balance"))).withColumn("_day", F.col("_read.day"))
    amount = F.col("_read.amount")
    amounts = (F.when(F.expr("columns.debit is not null and columns.credit is not null"),
                      split_amounts(F.col("_read.debit"), F.col("_read.credit")))
               .when(F.expr("columns.type is not null"),
                     typed_amount(_money("_amount", amount), F.col("_type")))
               .otherwise(signed_amount(F.col("_amount"), amount)))
    known = sorted({*MIXED, *(layout[-1] for layout in V.LAYOUTS)})
    # Some forty patterns in generated code make a method too long to be compiled; a function
    # over an array is evaluated pattern by pattern.
    tx_date = F.expr(f"""
        get(transform(array(named_struct('pattern', _pattern, 'text', _date, 'day', _day)), r ->
            case when r.pattern = 'mixed' then {mixed_day('r.day', day_first)}
                 else {_parsed('r.text', 'r.pattern', known, 'r.day')} end), 0)""")
    return rows.withColumn("_money", amounts).select(
        *_entry_columns(F.col("_money"), tx_date, F.col("_read.balance")))


def read_statements(statements: DataFrame, day_first: bool = False) -> DataFrame:
    """Entries of statements (user_id, upload_id, file_type, text)."""
    return map_rows(scan(statements), day_first)


# -- rows of extracted tables -----------------------------------------------------

def is_table_header(cells: Column) -> Column:
    """True where at least two cells contain a header word."""
    words = any_of([w for w in V.TABLE_HEADER_WORDS])
    return F.size(F.filter(cells, lambda c: F.lower(c).rlike(words))) >= 2


def is_table_row(cells: Column) -> Column:
    """True for rows that aren't blank and aren't totals or balances of the statement."""
    return ((F.trim(F.array_join(cells, "")) != "")
            & ~F.lower(F.array_join(cells, " ")).rlike(any_of(V.TABLE_SUMMARY_PHRASES)))


def normalise_tables(tables: DataFrame) -> DataFrame:
    """Rows of extracted tables as header-to-cell maps.

    ``tables`` has one row per extracted table: user_id, upload_id, table_no and
    rows (array of arrays of cells). A table without a header of its own takes the
    header of the last earlier table of the upload that has one and yielded rows.
    ``first_row`` counts the rows of the tables before.
    """
    trimmed = F.transform("rows", lambda row: F.transform(
        row, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    own = F.array_position(F.transform("_rows", is_table_header), True).cast("int")
    names = F.transform(F.element_at("_rows", F.col("_at")), lambda h: F.lower(
        F.replace(h, F.lit("\n"), F.lit(" "))))
    named = F.transform(names, lambda h, i: F.when(h != "", h).otherwise(
        F.concat(F.lit("_col"), i.cast("string"))))
    found = (tables.where(F.size("rows") >= 2).withColumn("_rows", trimmed)
             .withColumn("_own", F.nullif(own, F.lit(0))))
    # Only the short headers travel through this window; table rows do not. The very
    # first table of an upload, lacking a header, gives up its first row for one.
    earlier = Window.partitionBy("user_id", "upload_id").orderBy("table_no").rowsBetween(
        Window.unboundedPreceding, -1)
    headers = (found.withColumn("_at", F.coalesce("_own", F.lit(1)))
               .select("user_id", "upload_id", "table_no", "_own", named.alias("_names"),
                       F.exists(F.slice("_rows", F.col("_at") + 1, F.size("_rows")),
                                is_table_row).alias("_yields"),
                       F.size("_rows").cast("bigint").alias("_n"))
               .withColumn("_own_names", F.when(F.col("_own").isNotNull(), F.col("_names")))
               .withColumn("_carried", F.coalesce(
                   F.last(F.when(F.col("_yields"), F.col("_own_names")),
                          ignorenulls=True).over(earlier),
                   F.first(F.when(F.col("_yields"), F.col("_names")),
                           ignorenulls=True).over(earlier)))
               .select("user_id", "upload_id", "table_no",
                       F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("first_row"),
                       F.coalesce("_own_names", "_carried", "_names").alias("header"),
                       F.when(F.col("_own").isNotNull(), F.col("_own"))
                       .when(F.col("_carried").isNotNull(), 0).otherwise(1).alias("_skip")))
    # A table meets its header as one row; its cells come apart afterwards.
    cells = (found.select("user_id", "upload_id", "table_no", "_rows")
             .join(headers, ["user_id", "upload_id", "table_no"])
             .select("user_id", "upload_id", "table_no", "first_row", "header", "_skip",
                     F.posexplode("_rows").alias("row_no", "cells")))
    return (cells.where((F.col("row_no") >= F.col("_skip")) & is_table_row(F.col("cells")))
            .select("user_id", "upload_id", "table_no", "first_row", "row_no", "header",
                    F.transform("header", lambda h, i: F.coalesce(
                        F.get("cells", i), F.lit(""))).alias("cells")))


def map_table_rows(rows: DataFrame) -> DataFrame:
    """Normalised table rows to entries by header synonyms.

    Dates follow the pattern of the upload's first one.
    """
    columns = F.expr(layouts.synonym_positions("header", V.TABLE_SYNONYMS))
    ordered = _cells(with_once(rows, "columns", columns)).withColumn(
        "row_ord", F.col("first_row") + F.col("row_no"))
    first = (ordered.where("trim(_date) <> ''").groupBy("user_id", "upload_id")
             .agg(without_time(F.min_by("_date", "row_ord")).alias("_first"))
             .selectExpr("user_id", "upload_id", f"{_guessed('_first')} as _pattern"))
    amounts = (F.when(F.expr("columns.debit is not null and columns.credit is not null"),
                      split_amounts(_money("_debit"), _money("_credit")))
               .otherwise(signed_amount(F.col("_amount"))))
    return (with_once(ordered.join(first, ["user_id", "upload_id"], "left"), "_day",
                      without_time(F.col("_date")))
            .withColumn("_money", amounts)
            .select(*_entry_columns(F.col("_money"),
                                    F.expr(_parsed("_date", "_pattern", MIXED, "_day")))))


# -- dispatch -----------------------------------------------------------------------

def ingest(files: DataFrame, day_first: bool = False) -> DataFrame:
    """Entries of described files, whatever their type, in one pass."""
    return read_statements(files.where("status = 'pending'"), day_first)
