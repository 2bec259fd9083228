"""Quality rules, line first: bad lines go, then documents that lose too much of their text.

Main path: column expressions of one scan, no shuffle, no Python.

A line fails by one of three rules:

* punctuation: at least a fifth of its words hold a run of two or more symbols (``***``, ``!!``);
* navigation: two or more of its words are bare menu separators (``|``, ``»``, ``>``, ``·``,
  ``/``) and these are at least a fifth of them;
* boilerplate: a license, copyright, cookie or log-in notice of at most ``NOTICE_WORDS`` words.

Symbols that mean something are not counted: Markdown's heading and quote marks, emphasis, line
of marks under a heading, table row; operators of code and the marks around comments; two or
three marks that end a line.

A document is rejected if the base measures fail it, or if the lines lost to any rule hold more
than ``MOST_LOST`` percent of its words. ``clean`` also drops a document if what is left of it
after its cuts fails the base measures.

Defined cases: null or empty text has no words, so ``base_failed``; lines without a word are
kept as they are; repeated rows are judged one by one; a null ``doc_id`` is passed through.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.llm.common import fresh, once, words

WINDOW = 5
LEAST_WORDS = 10
#: Base rule: more than this share (percent) of the words in repeated windows.
MOST_REPEATED = 20
#: Verdict: more than this share (percent) of the words lost with bad lines.
MOST_LOST = 30
NOTICE_WORDS = 25

# Patterns both Java and RE2 read alike; notices are matched in lower case.
WORD = r"[^\x20\x09-\x0D]"
MARKS = r"[^#*$%&<>~^=_!?|»·/]+"
SYMBOL = r"[^#*$%&|<>]+"
RUN = r"[#*$%&<>~^=_!?|]{2,}"
SEPARATOR = r"^[|»>·/]+$"
# What has a meaning, in the order of its removal: a pattern and what takes its place.
MEANT = (
    (r"^[\x20\t]*(#+|\*+|=+|_+|~+|\^+)[\x20\t\r]*$", ""),
    (r"^[\x20\t]*(/\*\*+|<!--|<\?|#!)|(\*\*+/|\?>)[\x20\t\r]*$", ""),
    (r"(?:\*\*|__|~~)([^\s*_~](?:[^*_~]*[^\s*_~])?)(?:\*\*|__|~~)", r"\1"),
    (r"^[\x20\t]*(?:#{1,6}|//+|>[>\x20]*)[\x20\t]+", ""),
    (r"(^|[\x20\t]|[\p{L}0-9_)\]\"'])(?:===|!==|==|!=|<=|>=|&&|\|\||=>|->|<<|>>|<>|\*\*|__)"
     r"($|[\x20\t]|[\p{L}0-9_(\[\"'!:;,-])", r"\1 \2"),
    (r"[?!]{2,3}([)\"'\x20\t\r]*)$", r"!\1"),
)
TABLE_ROW = r"^[\x20\t]*\|.*\|[\x20\t\r]*$"
NOTICE = (r"all rights reserved|licen[sc]ed under|released under|general public license|"
          r"creative commons|copyright (\(c\)|©|[0-9]{4})|terms of (use|service)|"
          r"privacy policy|(use|uses|accept|enable) (of )?cookies|enable javascript")
#: One of these is in every text that ``NOTICE`` matches.
STEMS = ("rights reserved", "ed under", "public license", "creative commons", "copyright ",
         "terms of ", "privacy policy", "cookies", "javascript")


def repeated_words(items: Column, windows: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` found twice or more; ``windows`` are its hashes.

    Texts without a repeat are settled by counting distinct hashes. For the others, hashes
    sorted with their positions put equal ones side by side; the covered words are counted
    from the gaps between marked positions, so the work stays n log n for any length.
    """
    marked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def let(value, use):
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def twice(s):
        return F.sort_array(F.transform(
            F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(s, k + 1)["h"])
                     | x["h"].eqNullSafe(F.get(s, k - 1)["h"])), lambda x: x["i"]))

    def covered(at):
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.get(at, k + 1) - x,
                                                                F.lit(WINDOW))),
                           F.lit(0).cast("long"), lambda acc, x: acc + x)

    # least() skips the null after the last position, which so counts a whole window.
    return (F.when(F.size(F.array_distinct(windows)) < F.size(windows),
                   let(let(marked, twice), covered))
            .otherwise(F.lit(0).cast("long")))


def windows_of(w: Column) -> Column:
    """A hash for each window of ``WINDOW`` words."""
    n = F.size(w)
    return (F.when(n >= WINDOW, F.transform(
        F.slice(w, 1, n - WINDOW + 1),
        lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")))


def without_meant(line: Column) -> Column:
    """The line without the symbols that mean something."""
    out = line
    for pattern, instead in MEANT:
        out = F.regexp_replace(out, pattern, instead.replace("\\", "$"))
    return F.when(line.rlike(f"{RUN}|[|»>·/]"), out).otherwise(line)


def line_verdicts(text: Column) -> Column:
    """Per line: its text, its words, and the rule it fails (null: none)."""
    def verdict(line):
        def of(tokens):
            n = F.size(tokens["all"])
            runs = F.size(F.filter(tokens["judged"], lambda w: w.rlike(RUN)))
            menu = F.size(F.filter(tokens["judged"], lambda w: w.rlike(SEPARATOR)))
            rule = (F.when(n == 0, F.lit(None).cast("string"))
                    .when((runs > 0) & (5 * runs >= n), F.lit("punctuation"))
                    .when((menu >= 2) & (5 * menu >= n) & ~line.rlike(TABLE_ROW),
                          F.lit("navigation"))
                    .when((n <= NOTICE_WORDS) & F.lower(line).rlike(NOTICE),
                          F.lit("boilerplate")))
            return F.struct(line.alias("line"), n.cast("long").alias("n"), rule.alias("rule"))
        tokens = F.struct(words(line).alias("all"), words(without_meant(line)).alias("judged"))
        return F.get(F.transform(F.array(tokens), of), F.lit(0))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), verdict)


def suspicious(low: Column, marks: Column) -> Column:
    """Whether any line of a lower-cased text can fail at all: a mark of the line rules, or the
    stem of a notice. Only such texts have their lines examined; one without either has no
    failing line."""
    found = F.char_length(marks) >= 2
    for stem in STEMS:
        found = found | F.contains(low, F.lit(stem))
    return found


def total(lines: Column, keep) -> Column:
    return F.aggregate(F.filter(lines, keep), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])


def assess(documents: DataFrame, text_col: str = "text", prefix: str = "q_") -> DataFrame:
    """All columns plus base measures, lost words, the cleaned text and the verdict, each named
    with ``prefix`` so that no column of the table is touched.

    ``q_kept`` false means rejected. ``q_text`` is the text without its failing lines; it is
    the text itself (null included) when no line fails.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    p = prefix
    df = documents.withColumn(f"{p}words", words(F.col(text_col)))
    w, n = F.col(f"{p}words"), F.size(F.col(f"{p}words"))
    df = df.withColumn(f"{p}windows", windows_of(w))
    df = df.withColumn(f"{p}marks", F.regexp_replace(text, MARKS, ""))
    df = df.withColumn(f"{p}low", F.lower(text))
    marks = F.col(f"{p}marks")
    df = df.withColumn(f"{p}lines", F.when(suspicious(F.col(f"{p}low"), marks),
                                           line_verdicts(text)))
    lines = F.coalesce(F.col(f"{p}lines"),
                       F.array().cast("array<struct<line:string,n:bigint,rule:string>>"))
    worded = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    df = once(df, f"{p}m", F.struct(
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(marks, SYMBOL, "")).cast("long").alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
        repeated_words(w, F.col(f"{p}windows")).alias("n_repeat_words"),
        total(lines, lambda x: x["rule"] == "punctuation").alias("lost_punctuation"),
        total(lines, lambda x: x["rule"] == "navigation").alias("lost_navigation"),
        total(lines, lambda x: x["rule"] == "boilerplate").alias("lost_boilerplate"),
        F.when(F.exists(lines, lambda x: x["rule"].isNotNull()), F.array_join(F.transform(
            F.filter(lines, lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n"))
        .otherwise(F.col(text_col)).alias("text")))
    m = F.col(f"{p}m")
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "lost_punctuation", "lost_navigation", "lost_boilerplate", "text"]
    failed = ((m["n_words"] < LEAST_WORDS)
              | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"]))
    lost = (100 * (m["lost_punctuation"] + m["lost_navigation"] + m["lost_boilerplate"])
            > MOST_LOST * m["n_words"])
    return df.select(*documents.columns, *[m[x].alias(f"{p}{x}") for x in measures],
                     failed.alias(f"{p}base_failed"), (~failed & ~lost).alias(f"{p}kept"))


def clean(documents: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents that pass, with their failing lines cut out and ``chars_col`` to match.

    What is left after a cut must pass the base rules too, so no document is kept without text.
    """
    q = fresh(documents.columns, "q_")
    text = F.col(f"{q}text")
    same = text == F.col(text_col)
    new = {text_col: text}
    if chars_col in documents.columns:
        new[chars_col] = F.when(same, F.col(chars_col)).otherwise(
            F.char_length(text).cast("long"))
    df = once(assess(documents, text_col, q).where(f"{q}kept"), f"{q}left",
              words(F.when(~same, text)))
    left = F.col(f"{q}left")
    df = once(df, f"{q}left_windows", windows_of(left))
    df = once(df, f"{q}passes", (F.size(left) >= LEAST_WORDS) & (
        100 * repeated_words(left, F.col(f"{q}left_windows")) <= MOST_REPEATED * F.size(left)))
    return df.where(same | F.col(f"{q}passes")).select(
        *[new.get(c, F.col(c)).alias(c) for c in documents.columns])
