"""Delimited statements of any size, each read by many tasks.

``statements.read_files`` holds a statement in one row; here a statement is its lines, wherever
the reader cuts the file. A quoted cell may span lines, and so may a record span splits, and a
split can't know by itself whether it begins inside quotes. So every line tells what it does to
either state (``ends_inside`` and ``closes``), a split sums that up for both, and a prefix over the
splits of a file, one row each, picks the true one. Lines outside of quotes are records as they
stand; only records of several lines are grouped.

The first lines of a file give its header and column positions, one row for each file, as small
as for small files, and the rest is the same code as theirs. Lines are shuffled by split to
tell their state, and data rows once more to number them.

A quote that is never closed is plain text: the lines after it are held as one text and cut
again, as for small files. Line breaks inside quotes are read as ``\\n``. A file with a line that
isn't UTF-8 is read as Latin-1.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.sources import statements as S

SPLIT = ["path", "block"]
#: Stores a frame that several steps read (such as ``sinks.materialise``), or not.
Cut = Callable[[DataFrame, str], DataFrame]


def keep(df: DataFrame, name: str) -> DataFrame:
    return df


#: A line read from outside of quotes ends inside: its last cell opens with a quote.
ENDS_INSIDE = r'^(?:(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+)?,)*+"(?:[^"]|"")*+$'
#: What a line that begins inside quotes holds up to the end of that cell.
CLOSES = r'^(?:[^"]|"")*+"(?!")[^,]*+'


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line, value) of the files below a folder: the split a line is read with and
    a number in the order of reading."""
    return (spark.read.option("recursiveFileLookup", "true").text(path)
            .select(F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("line"), "value"))


def numbered(lines: DataFrame, cut: Cut = keep) -> DataFrame:
    """Add ``nth``, the number of each line in its file, and ``latin``, whether a line of the
    file isn't UTF-8. A split is read in one piece, so its lines are numbered without gaps: the
    first number and the count of every split tell all places. Where these few rows are stored
    (``cut``) no line is moved for them."""
    earlier = (Window.partitionBy("path").orderBy("block")
               .rowsBetween(Window.unboundedPreceding, -1))
    starts = (lines.groupBy(*SPLIT).agg(
        F.count(F.lit(1)).alias("_n"), F.min("line").alias("_first"),
        F.bool_or(~F.is_valid_utf8("value")).alias("_bad"))
        .select(*SPLIT, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                F.bool_or("_bad").over(Window.partitionBy("path")).alias("latin")))
    return (lines.join(cut(starts, "splits"), SPLIT)
            .withColumn("nth", F.col("_before") + F.col("line") - F.col("_first") + 1)
            .drop("_first", "_before"))


def running_count(rows: DataFrame, flag: Column, name: str, *order: str) -> DataFrame:
    """Add the number of flagged rows of the file up to each row: counted inside splits, then
    shifted by the counts of earlier splits."""
    own = Window.partitionBy(*SPLIT).orderBy(*order)
    earlier = (Window.partitionBy("path").orderBy("block")
               .rowsBetween(Window.unboundedPreceding, -1))
    starts = (rows.groupBy(*SPLIT).agg(F.count_if(flag).alias("_n"))
              .select(*SPLIT, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    counted = rows.withColumn("_here", F.sum(flag.cast("long")).over(own))
    return (counted.join(starts, SPLIT)
            .withColumn(name, F.col("_before") + F.col("_here")).drop("_before", "_here"))


def with_state(lines: DataFrame) -> DataFrame:
    """Add ``inside`` (the line begins inside quotes) and ``open`` (it ends inside).

    A line either keeps the state, swaps it, or fixes it. So the state after some lines is the
    one last fixed, swapped as often as lines after it swap, or that of the start if none fixes.
    """
    quoted = F.col("value").contains('"')
    outside = quoted & F.col("value").rlike(ENDS_INSIDE)
    rest = F.regexp_replace("value", CLOSES, "")
    inside = ~(quoted & F.col("value").rlike(CLOSES)) | (
        rest.startswith(",") & F.substring(rest, 2, 2**31 - 1).rlike(ENDS_INSIDE))
    lines = (lines.withColumn("_o", outside).withColumn("_i", inside)
             .withColumn("_fix", F.when(F.col("_o") == F.col("_i"), F.col("_o")))
             .withColumn("_swap", (F.col("_o") & ~F.col("_i")).cast("long")))

    def after(rows: DataFrame, window) -> DataFrame:
        """``_fixed``: a state was fixed; ``_turn``: that state, or whether the start's swaps."""
        rows = rows.withColumn("_swaps", F.sum("_swap").over(window))
        last = F.last(F.when(F.col("_fix").isNotNull(), F.struct("_fix", "_swaps")),
                      ignorenulls=True).over(window)
        rows = rows.withColumn("_last", last)
        odd = (F.col("_swaps") - F.coalesce("_last._swaps", F.lit(0))) % 2 == 1
        return (rows.withColumn("_fixed", F.col("_last").isNotNull())
                .withColumn("_turn", F.coalesce("_last._fix", F.lit(False)) != odd)
                .drop("_swaps", "_last"))

    own = Window.partitionBy(*SPLIT).orderBy("line")
    lines = after(lines, own).drop("_o", "_i", "_fix", "_swap")
    splits = (lines.groupBy(*SPLIT).agg(F.max_by(F.struct("_fixed", "_turn"), "line").alias("e"))
              .select(*SPLIT, F.when(F.col("e._fixed"), F.col("e._turn")).alias("_fix"),
                      (~F.col("e._fixed") & F.col("e._turn")).cast("long").alias("_swap")))
    in_order = Window.partitionBy("path").orderBy("block")
    splits = after(splits, in_order).select(
        *SPLIT, F.coalesce(F.lag("_turn").over(in_order), F.lit(False)).alias("_start"))
    lines = lines.join(splits, SPLIT)
    ends = F.when(F.col("_fixed"), F.col("_turn")).otherwise(F.col("_start") != F.col("_turn"))
    return (lines.withColumn("open", ends)
            .withColumn("inside", F.coalesce(F.lag("open").over(own), F.col("_start")))
            .drop("_fixed", "_turn", "_start"))


def records(lines: DataFrame, cut: Cut = keep) -> DataFrame:
    """(path, block, line, sub, record) of lines (path, block, line, value): whole records, with
    the place of their first line."""
    stated = cut(with_state(lines), "stated")
    single = stated.where("not inside and not open").select(
        *SPLIT, "line", F.lit(0).alias("sub"), F.col("value").alias("record"))
    begins = F.col("open") & ~F.col("inside")
    several = running_count(stated.where("inside or open"), begins, "_record", "line")
    parts = F.sort_array(F.collect_list(F.struct(*SPLIT[1:], "line", "value")))
    whole = (several.groupBy("path", "_record").agg(parts.alias("p"))
             .select("path", "p", F.posexplode(S.records(F.array_join(
                 F.transform("p", lambda x: x["value"]), "\n"))).alias("sub", "record")))
    first = F.get("p", F.lit(0))
    return single.where(F.trim("record") != "").unionByName(whole.select(
        "path", first["block"].alias("block"), first["line"].alias("line"), "sub", "record"))


def folder_ids(path: Column) -> tuple[Column, Column]:
    """User and upload of ``<user>/<upload>.<type>``."""
    pieces = F.split(F.url_decode(path), "/")
    return (F.element_at(pieces, -2),
            F.regexp_replace(F.element_at(pieces, -1), r"\.[^.]+$", ""))


def read_statements(spark: SparkSession, path: str, ids=folder_ids,
                    day_first: bool = False, cut: Cut = keep) -> DataFrame:
    """Entries of all delimited files below a folder; ``ids`` makes user and upload of a path.
    Files whose columns can't be told give none."""
    raw = numbered(cut(read_lines(spark, path), "lines"), cut)
    text = F.when(F.col("latin"), F.decode(F.col("value").cast("binary"), "ISO-8859-1")) \
        .otherwise(F.col("value"))
    raw = raw.withColumn(
        "value", F.when(F.col("nth") == 1, F.regexp_replace(text, "^\\uFEFF", "")).otherwise(text))
    head = F.sort_array(F.collect_list(F.struct("nth", "value")))
    user, upload = ids(F.col("path"))
    heads = (raw.where(F.col("nth") <= V.HEADER_SCAN_LINES).groupBy("path").agg(head.alias("h"))
             .select(F.col("path").alias("upload_id"), F.lit("").alias("user_id"),
                     F.lit("csv").alias("file_type"), F.array_join(F.transform(
                         "h", lambda x: x["value"]), "\n").alias("text")))
    layouts = cut(S.scan(heads).where("error_message is null").select(
        F.col("upload_id").alias("path"), "header_line", "columns"), "layouts")
    body = (raw.join(layouts.select("path", "header_line"), "path")
            .where(F.col("nth") > F.col("header_line") + 1).select(*SPLIT, "line", "value"))
    rows = records(body, cut).withColumn("cells", S.csv_cells(F.col("record"))) \
        .where(S.is_data_row(F.col("cells"))).drop("record")
    rows = running_count(cut(rows, "rows"), F.lit(True), "pos", "line", "sub").join(
        layouts.select("path", "columns"), "path")
    patterns = S.date_patterns(rows, "path", "pos")
    return S.entries_of(
        rows.join(patterns, "path").withColumn("pos", F.col("pos") - 1)
        .withColumns({"user_id": user, "upload_id": upload}), day_first)
