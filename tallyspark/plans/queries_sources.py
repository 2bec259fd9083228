"""Queries over statement sources: header search, layouts, mapping, tables, lines."""

from pyspark.sql import functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.operators import pipeline
from tallyspark.operators.sinks import materialise, shared_folder
from tallyspark.operators.standardise import standardise
from tallyspark.plans import duck, frames
from tallyspark.plans.queries_cleaning import EXACT, NEAR
from tallyspark.plans.registry import plain, register
from tallyspark.plans.tables import entries
from tallyspark.sources import layouts, splits, statements as S

LINES = {"lines": frames.statement_lines_sql()}
_LAYOUT = frames.LAYOUT_NO
_TOKENS = ("list_transform(string_split(line, ','), lambda c: "
           "regexp_replace(lower(trim(c)), '^\"+|\"+$', '', 'g'))")
_WORDS = "[" + ", ".join(duck.lit(w) for w in V.HEADER_CELLS) + "]"

#: Number of the header line of each statement, and the lines after it.
HEADERS = f"""
    select user_id, upload_id,
           coalesce(min(case when n < {V.HEADER_SCAN_LINES}
                              and len(list_intersect({_TOKENS}, {_WORDS})) >= 2
                             then n end), min(case when trim(line) <> '' then n end), 0)
               as header_line
    from numbered group by user_id, upload_id"""
NUMBERED = """
    select *, row_number() over (partition by upload_id order by line_no) - 1 as n from lines"""
SCANNED = {"lines": LINES["lines"], "numbered": NUMBERED, "headers": HEADERS}


@register("find_header_row", duck.query(
    "select user_id, upload_id, cast(header_line as int) as header_line from headers",
    "entries", **SCANNED))
def find_header_row(spark, sf_dir):
    return frames.statements(spark, sf_dir).select(
        "user_id", "upload_id", S.header_line(F.col("text")).alias("header_line"))


@register("drop_metadata_rows", duck.query(f"""
    select l.upload_id, count(*) as n_rows
    from numbered l join headers h on l.upload_id = h.upload_id and l.n > h.header_line
    where regexp_matches(replace(line, ',', ' '), {duck.lit(V.DATA_ROW_DATE)})
       or regexp_matches(replace(line, ',', ' '), {duck.lit(V.DATA_ROW_AMOUNT)})
    group by l.upload_id""", "entries", **SCANNED))
def drop_metadata_rows(spark, sf_dir):
    return S.scan(frames.statements(spark, sf_dir)).select(
        "upload_id", F.size("rows").cast("bigint").alias("n_rows"))


def _sniff_sql() -> str:
    scores = []
    for i, layout in enumerate(V.LAYOUTS):
        names = [n.lower() for f, n in layouts.layout_names(layout).items() if n and f != "type"]
        scores.append(f"({i}, {duck.lit(layout[0])}, "
                      "[" + ", ".join(duck.lit(n) for n in names) + "])")
    return f"""
        select upload_id, case when score >= 2 then layout end as layout,
               case when score >= 2 then cast(score as int) end as score
        from (select l.upload_id, p.layout, len(list_intersect({_TOKENS}, p.names)) as score,
                     row_number() over (partition by l.upload_id order by
                         len(list_intersect({_TOKENS}, p.names)) desc, p.i) as rn
              from numbered l
              join headers h on l.upload_id = h.upload_id and l.n = h.header_line
              cross join (values {", ".join(scores)}) as p(i, layout, names))
        where rn = 1"""


@register("sniff_profile", duck.query(_sniff_sql(), "entries", **SCANNED))
def sniff_profile(spark, sf_dir):
    header = S.scan(frames.statements(spark, sf_dir)).select(
        "upload_id", layouts.lowered(F.col("header")).alias("low"))
    return header.selectExpr("upload_id", f"{layouts.sniff('low')} as s").select(
        "upload_id", "s.layout", "s.score")


#: What reading a rendered statement must give back: the entries it was made from.
ROUND_TRIP = f"""
    select user_id, upload_id,
           cast(row_number() over (partition by upload_id order by row_ord) - 1 as bigint)
               as row_ord,
           tx_date, trim(case when {_LAYOUT} = 3 then concat(raw_desc, ', "NG"')
                              when {_LAYOUT} = 0 and row_ord % 7 = 0
                              then concat(raw_desc, ' 12" BOX')
                              else raw_desc end) as raw_desc,
           cast(amount as double) as amount, tx_type, cast(balance as double) as balance
    from entries"""


@register("scan_csv_statement", duck.query(ROUND_TRIP, "entries"))
def scan_csv_statement(spark, sf_dir):
    return plain(S.read_statements(frames.statements(spark, sf_dir)))


@register("scan_large_statements", duck.query(f"""
    select 'all' as user_id, upload as upload_id,
           cast(row_number() over (partition by upload order by user_id, upload_id, row_ord) - 1
                as bigint) as row_ord, tx_date,
           trim(case when {_LAYOUT} = 3 and row_ord % 5 = 0
                     then concat(raw_desc, chr(10), 'x, "NG"')
                     when {_LAYOUT} = 3 then concat(raw_desc, ', "NG"')
                     when {_LAYOUT} = 0 and row_ord % 7 = 0 then concat(raw_desc, ' 12" BOX')
                     else raw_desc end) as raw_desc,
           cast(amount as double) as amount, tx_type, cast(balance as double) as balance
    from (select *, concat({_LAYOUT}, '-', cast(floor(cast(user_id as bigint) / 1000) as bigint))
                    as upload from entries)""", "entries"))
def scan_large_statements(spark, sf_dir):
    """All orders as a few large statements, read in splits."""
    path = shared_folder(spark, "statements")
    frames.write_large_statements(spark, sf_dir, path)
    return plain(splits.read_statements(spark, path, lambda p: (
        F.lit("all"), F.regexp_extract(p, "upload=([^/]+)", 1)), cut=materialise))


@register("apply_profile", duck.query(
    f"{ROUND_TRIP} where {_LAYOUT} <> 6", "entries"))
def apply_profile(spark, sf_dir):
    scanned = S.scan(frames.statements(spark, sf_dir))
    return plain(S.map_rows(scanned.where("columns.layout <> 'generic'")))


@register("generic_map", duck.query(
    f"{ROUND_TRIP} where {_LAYOUT} = 6", "entries"))
def generic_map(spark, sf_dir):
    scanned = S.scan(frames.statements(spark, sf_dir))
    return plain(S.map_rows(scanned.where("columns.layout = 'generic'")))


@register("parse_text_lines", duck.query(f"""
    select upload_id, row_ord, d as date_text, trim(t) as description, trim(a) as amount_text,
           trim(b) as balance_text
    from (select *, regexp_extract(s, {duck.lit(V.TEXT_LINE)}, 1) as d,
                 regexp_extract(s, {duck.lit(V.TEXT_LINE)}, 2) as t,
                 regexp_extract(s, {duck.lit(V.TEXT_LINE)}, 3) as a,
                 regexp_extract(s, {duck.lit(V.TEXT_LINE)}, 4) as b
          from (select *, trim(line) as s from printed))
    where length(s) >= {V.TEXT_LINE_MIN_CHARS}
      and regexp_matches(s, {duck.lit(V.TEXT_LINE)})""",
    "entries", printed=frames.printed_lines_sql()))
def parse_text_lines(spark, sf_dir):
    cells = S.text_cells(F.col("line"))
    return (frames.printed_lines(spark, sf_dir).withColumn("cells", cells)
            .where("cells is not null")
            .select("upload_id", "row_ord", F.col("cells")[0].alias("date_text"),
                    F.col("cells")[1].alias("description"),
                    F.col("cells")[2].alias("amount_text"),
                    F.col("cells")[3].alias("balance_text")))


#: Orders as rows of extracted tables: one table per 500 order keys of a statement,
#: the first of them opening with a title and a header.
def extracted_tables(spark, sf_dir):
    rows = entries(spark, sf_dir).withColumn(
        "table_no", F.floor((F.col("row_ord") % 5000) / 500).cast("int"))
    cells = F.array(F.col("tx_date").cast("string"), F.col("raw_desc"), F.lit(None).cast("string"),
                    F.when(F.col("tx_type") == "debit", F.col("amount").cast("string")),
                    F.when(F.col("tx_type") == "credit", F.col("amount").cast("string")),
                    F.col("balance").cast("string"))
    grouped = rows.groupBy("user_id", "upload_id", "table_no").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("row_ord", cells.alias("c")))),
                    lambda r: r.c).alias("body"))
    first = F.min("table_no").over(_upload())
    title = F.array(F.lit("Customer statement"), *[F.lit("")] * 5)
    header = F.array(*[F.lit(h) for h in ["Value Date", " Narration", "", "Debit", "Credit",
                                          "Closing\nBalance"]])
    blank = F.array(*[F.lit("")] * 6)
    return grouped.withColumn("rows", F.when(
        F.col("table_no") == first, F.concat(F.array(title, header), F.col("body")))
        .otherwise(F.concat(F.array(blank), F.col("body")))).drop("body")


def stored_tables(spark, sf_dir):
    """The tables, written once: headers and rows are two reads of them."""
    return materialise(extracted_tables(spark, sf_dir), "extracted-tables")


def _upload():
    from pyspark.sql import Window
    return Window.partitionBy("user_id", "upload_id")


_TABLE_ROWS = f"""
    select user_id, upload_id, row_ord, tx_date, trim(raw_desc) as raw_desc, amount, tx_type,
           balance, cast(floor((row_ord % 5000) / 500.0) as int) as table_no
    from entries"""
_KEPT = " and ".join(f"not contains(lower(concat(cast(tx_date as varchar), ' ', raw_desc)), "
                     f"{duck.lit(p)})" for p in V.TABLE_SUMMARY_PHRASES)


@register("normalize_table_rows", duck.query(f"""
    select upload_id, table_no, 'value date|narration|_col2|debit|credit|closing balance'
               as header,
           concat(cast(tx_date as varchar), '|', raw_desc, '||',
                  case when tx_type = 'debit' then cast(amount as varchar) else '' end, '|',
                  case when tx_type = 'credit' then cast(amount as varchar) else '' end, '|',
                  coalesce(cast(balance as varchar), '')) as cells
    from table_rows where {_KEPT}""", "entries", table_rows=_TABLE_ROWS))
def normalize_table_rows(spark, sf_dir):
    return S.normalise_tables(stored_tables(spark, sf_dir)).select(
        "upload_id", "table_no", F.array_join("header", "|").alias("header"),
        F.array_join("cells", "|").alias("cells"))


@register("map_table_rows", duck.query(f"""
    select upload_id, tx_date, raw_desc, cast(amount as double) as amount, tx_type,
           cast(balance as double) as balance
    from table_rows where {_KEPT}""", "entries", table_rows=_TABLE_ROWS))
def map_table_rows(spark, sf_dir):
    rows = S.normalise_tables(stored_tables(spark, sf_dir))
    return plain(S.map_table_rows(rows)).drop("user_id", "row_ord")


@register("standardize", duck.query("""
    select user_id, upload_id, row_ord, tx_date, description, raw_desc,
           cast(amount as double) as amount, tx_type, cast(balance as double) as balance,
           channel, merchant, bank, fingerprint from std""", "std"))
def standardize(spark, sf_dir):
    return plain(frames.standard(spark, sf_dir))


#: Formats of printed dates in the order in which a statement's first date is tried on them.
_PRINTED_FORMATS = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d-%m-%Y"]


def _ingested_sql() -> tuple[str, dict[str, str]]:
    """Entries of the delimited statements and of the printed ones.

    All dates of a printed statement follow the first one; lines of another form have no date.
    """
    fits = duck.lit(V.TEXT_LINE)
    day = duck.case([(f"pattern = {i}", f"try_strptime(d, '{f}')")
                     for i, f in enumerate(_PRINTED_FORMATS)], "null")
    value, balance = duck.parse_money("a"), duck.parse_money("nullif(b, '')")
    return """
        select user_id, upload_id, row_ord, tx_date, description, raw_desc,
               cast(amount as double) as amount, tx_type, cast(balance as double) as balance,
               channel, merchant, bank, fingerprint from ingested""", {
        "delimited": ROUND_TRIP.replace("cast(amount as double) as amount", "amount").replace(
            "cast(balance as double) as balance", "balance"),
        "printed": frames.printed_lines_sql(),
        "printed_cells": f"""
            select user_id, concat(upload_id, '-printed') as upload_id,
                   cast(row_number() over (partition by upload_id order by row_ord) - 1 as bigint)
                       as row_ord,
                   regexp_extract(s, {fits}, 1) as d, trim(regexp_extract(s, {fits}, 2)) as t,
                   trim(regexp_extract(s, {fits}, 3)) as a,
                   trim(regexp_extract(s, {fits}, 4)) as b
            from (select *, trim(line) as s from printed)
            where length(s) >= {V.TEXT_LINE_MIN_CHARS} and regexp_matches(s, {fits})""",
        "printed_forms": "select upload_id as of_upload, " + duck.case(
            [(f"try_strptime(d, '{f}') is not null", str(i))
             for i, f in enumerate(_PRINTED_FORMATS)], "null")
        + " as pattern from printed_cells where row_ord = 0",
        "read_back": f"""
            select user_id, upload_id, row_ord, tx_date, raw_desc, amount, tx_type, balance
            from delimited
            union all
            select user_id, upload_id, row_ord, cast({day} as date), t,
                   cast(round(abs({value}), 2) as decimal(18,2)),
                   case when {value} >= 0 and regexp_matches(a, '(?i)cr\\b') then 'credit'
                        else 'debit' end,
                   case when b <> '' then cast(round({balance}, 2) as decimal(18,2)) end
            from printed_cells join printed_forms on upload_id = of_upload""",
        "ingested": duck.standardised("read_back")}


@register("ingest_statements", duck.query(_ingested_sql()[0], "entries", **_ingested_sql()[1]))
def ingest_statements(spark, sf_dir):
    """Delimited and printed statements of all orders, read and standardised in one pass."""
    printed = frames.printed_lines(spark, sf_dir).groupBy("user_id", "upload_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_ord", "line"))),
                                 lambda x: x.line), "\n").alias("text")).select(
        "user_id", F.concat("upload_id", F.lit("-printed")).alias("upload_id"),
        F.lit("txt").alias("file_type"), "text")
    files = (frames.statements(spark, sf_dir).unionByName(printed)
             .withColumn("status", F.lit("pending")))
    return plain(standardise(S.ingest(files)))


def _bad_files_sql() -> str:
    return " union all ".join(
        f"select user_id, concat({duck.lit(name + '-')}, user_id) upload_id, "
        f"{duck.lit(kind)} file_type, null bank_detected, null period_start, null period_end, "
        f"0 tx_count, 'failed' status, {duck.lit(error)} error_message from users"
        for name, kind, _, error in frames.BAD_FILES)


def _upload_sql() -> str:
    """Uploads of the rendered statements, by way of their entries."""
    read = ROUND_TRIP.replace("cast(amount as double) as amount", "amount").replace(
        "cast(balance as double) as balance", "balance")
    return f"""
        select user_id, upload_id, 'csv' file_type,
               (select bank from banks b where b.upload_id = p.upload_id and rn = 1)
                   bank_detected,
               period_start, period_end, tx_count, 'complete' status, null error_message
        from (select user_id, upload_id, count(*) tx_count, min(tx_date) period_start,
                     max(tx_date) period_end from up3 group by 1, 2) p
        union all {_bad_files_sql()}""", {
        "read_back": read, "up_std": duck.standardised("read_back"),
        "up1": duck.normalised("up_std"), "up2": EXACT.format("up1"), "up3": NEAR.format("up2"),
        "banks": """select upload_id, bank, row_number() over (
            partition by upload_id order by count(*) desc, bank) rn
            from up3 where bank is not null group by upload_id, bank""",
        "users": "select distinct user_id from entries"}


@register("run_pipeline", duck.query(_upload_sql()[0], "entries", **_upload_sql()[1]))
def run_pipeline(spark, sf_dir):
    """A record of every upload, readable or not, after the whole pipeline."""
    done = pipeline.run_pipeline(frames.described_files(spark, sf_dir), materialise)
    return done.uploads.drop("filename", "file_size_kb", "processed_at")
