"""DuckDB spellings of the expressions, for the SQL counterparts of the queries."""

from string import Formatter

from tallyspark.functions import fixed_values as V
from tallyspark.functions import text
from tallyspark.functions.money import NUMBER
from tallyspark.plans import tables


def lit(value) -> str:
    """SQL literal."""
    if value is None:
        return "null"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("'", "''") + "'"


def matches(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(pattern)})"


def replace(expr: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(by)}, 'g')"


def squeeze(expr: str) -> str:
    return f"trim({replace(expr, r'\s+', ' ')})"


def case(branches: list[tuple[str, str]], default: str) -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in branches) + f" else {default} end"


def contains_any(expr: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({expr}, {lit(w)})" for w in words) + ")"


def parse_money(expr: str) -> str:
    bare = replace(replace(expr, r"[₦,\s]"), "(?i)(DR|CR)$")
    return (f"case when lower({bare}) = 'nan' then null "
            f"when regexp_matches({bare}, {lit(NUMBER)}) "
            f"then try_cast({bare} as double) else 0.0 end")


def naira(expr: str) -> str:
    return f"concat('₦', format('{{:,.2f}}', cast({expr} as double)))"


def fixed(expr: str, places: int) -> str:
    return f"format('{{:.{places}f}}', cast({expr} as double))"


def rounded(expr: str, places: int) -> str:
    """By the exact value of the double, ties to even."""
    return f"cast({fixed(expr, places)} as double)"


def grouped(expr: str, places: int) -> str:
    return f"format('{{:,.{places}f}}', cast({expr} as double))"


def fill(template: str, **values: str) -> str:
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(lit(literal))
        if name:
            parts.append(values[name])
    return "concat(" + ", ".join(parts) + ")"


def detect_bank(expr: str) -> str:
    return case([(contains_any(f"lower({expr})", words), lit(bank))
                 for bank, words in V.BANK_KEYWORDS], "null")


def detect_channel(expr: str) -> str:
    return case([(contains_any(f"lower({expr})", words), lit(channel))
                 for channel, words in V.CHANNEL_KEYWORDS], lit(V.DEFAULT_CHANNEL))


def clean_description(expr: str) -> str:
    kept = squeeze(replace(replace(expr, r"\b\d{8,}\b"), r"\|.*$"))
    return f"substr(case when {kept} <> '' then {kept} else {expr} end, 1, 255)"


def title_case(expr: str) -> str:
    runs = f"regexp_extract_all(lower({expr}), '[a-z]+|[^a-z]+')"
    return (f"array_to_string(list_transform({runs}, lambda run: "
            f"concat(upper(substr(run, 1, 1)), substr(run, 2))), '')")


def extract_merchant(expr: str) -> str:
    name = squeeze(replace(replace(expr, V.MERCHANT_PREFIX), V.MERCHANT_REFERENCE))
    return f"substr(case when {name} <> '' then {title_case(name)} else {expr} end, 1, 100)"


def normalise_description(expr: str) -> str:
    for pattern, by in V.DESCRIPTION_REWRITES:
        expr = replace(expr, "(?i)" + pattern, by)
    return f"trim({expr})"


def merchant_key(expr: str) -> str:
    bare = replace(replace(f"lower({expr})", V.MERCHANT_KEY_NOISE), r"[^a-z\s]")
    return f"substr({squeeze(bare)}, 1, {V.MERCHANT_KEY_CHARS})"


def category_found(expr: str, phrases: list[str]) -> str:
    """RE2 has no lookahead: a forbidden phrase is blanked out before matching."""
    plain = "|".join(p for p in phrases if "!" not in p)
    tests = [matches(expr, rf"(?i)\b(?:{plain})\b")]
    for phrase in phrases:
        wanted, _, forbidden = phrase.partition("!")
        if forbidden:
            rest = replace(expr, rf"(?i)\b{wanted}\b{forbidden}", "~")
            tests.append(matches(rest, rf"(?i)\b{wanted}\b"))
    return "(" + " or ".join(tests) + ")"


def matched_category(expr: str, tx_type: str) -> str:
    def chain(categories):
        return case([(category_found(expr, phrases), lit(c)) for c, phrases in categories],
                    "null")

    return (f"case when {tx_type} = 'credit' then {chain(V.CREDIT_CATEGORIES)} "
            f"else {chain(V.DEBIT_CATEGORIES)} end")


def known_subscription(expr: str) -> str:
    return case([(f"contains(lower({expr}), {lit(w)})", lit(name))
                 for w, name, _ in reversed(V.SUBSCRIPTIONS)], "null")


def subscription_advice(expr: str) -> str:
    return case([(f"contains(lower({expr}), {lit(w)})", lit(advice))
                 for w, _, advice in V.SUBSCRIPTIONS], lit(V.DEFAULT_ADVICE))


def fingerprint() -> str:
    return ("sha256(concat_ws('|', cast(tx_date as varchar), cast(amount as varchar), "
            "substr(raw_desc, 1, 60)))")


def standardised(source: str) -> str:
    return f"""
        select user_id, upload_id, row_ord, tx_date, {clean_description('raw_desc')} description,
               raw_desc, amount, tx_type, balance, {detect_channel('raw_desc')} channel,
               {extract_merchant('raw_desc')} merchant, {detect_bank('raw_desc')} bank,
               {fingerprint()} fingerprint
        from {source}
        where tx_date is not null and amount > 0
          and length({clean_description('raw_desc')}) > 0"""


def normalised(source: str) -> str:
    """Noise rows dropped, descriptions rewritten."""
    return f"""
        select * replace ({normalise_description('description')} as description)
        from {source} where not regexp_matches(description, {lit(text.noise_pattern())})"""


def classified(source: str) -> str:
    return f"""
        select * exclude (found),
               coalesce(found, case when tx_type = 'credit' then {lit(V.CREDIT_DEFAULT[0])}
                                    else {lit(V.DEBIT_DEFAULT[0])} end) category,
               cast(case when found is not null then {V.MATCHED_CONFIDENCE}
                    when tx_type = 'credit' then {V.CREDIT_DEFAULT[1]}
                    else {V.DEBIT_DEFAULT[1]} end as double) confidence,
               'rule' classified_by
        from (select *, {matched_category('description', 'tx_type')} found from {source})"""


def known(source: str) -> str:
    return f"""
        select *, known_group is not null known_recurring
        from (select *, {known_subscription('description')} known_group,
                     {merchant_key('description')} merchant_key,
                     cast(round_even(amount / 100, 0) * 100 as bigint) bucket from {source})"""


def intervals(source: str) -> str:
    """Gap statistics straight from the rows: lag, then mean and population deviation."""
    fits = " or ".join(
        f"(abs(mean_gap - {d}) / {d}.0 <= {V.CYCLE_MEAN_TOLERANCE} "
        f"and std_gap <= {d} * {V.CYCLE_STD_TOLERANCE})" for d in V.CYCLES)
    return f"""
        select *, ({fits}) is_regular from (
          select user_id, merchant_key, bucket, count(*) n, avg(gap) mean_gap,
                 stddev_pop(gap) std_gap
          from (select *, tx_date - lag(tx_date) over (
                          partition by user_id, merchant_key, bucket order by tx_date) gap
                from {source} where tx_type = 'debit')
          group by all having count(*) >= 2)"""


def recurring(known_source: str, interval_source: str) -> str:
    return f"""
        select k.* exclude (known_group, known_recurring, merchant_key, bucket),
               (k.known_recurring or i.user_id is not null) is_recurring,
               coalesce({title_case('i.merchant_key')}, k.known_group) recurring_group
        from {known_source} k left join (select * from {interval_source} where is_regular) i
          on k.user_id = i.user_id and k.merchant_key = i.merchant_key
             and k.bucket = i.bucket and k.tx_type = 'debit'"""


#: Common table expressions by name; each may use those before it.
PARTS = {
    "entries": lambda: tables.derive_sql("orders", tables.entry_columns("duckdb")),
    "std": lambda: standardised("entries"),
    "norm": lambda: normalised("std"),
    "lab": lambda: classified("norm"),
    "known": lambda: known("lab"),
    "intervals": lambda: intervals("known"),
    "rec": lambda: recurring("known", "intervals"),
    "ev_entries": lambda: tables.derive_sql("events", tables.event_columns("duckdb")),
    "fc_entries": lambda: tables.derive_sql(
        "events", tables.event_columns("duckdb", tables.FORECAST_SCALE)),
    "fc_std": lambda: standardised("fc_entries"),
    "ev_std": lambda: standardised("ev_entries"),
    "ev_lab": lambda: classified("ev_std"),
    "ev_known": lambda: known("ev_lab"),
    "ev_intervals": lambda: intervals("ev_known"),
    "ev_rec": lambda: recurring("ev_known", "ev_intervals"),
}
CHAINS = {
    "entries": ["entries"], "std": ["entries", "std"], "norm": ["entries", "std", "norm"],
    "lab": ["entries", "std", "norm", "lab"],
    "known": ["entries", "std", "norm", "lab", "known"],
    "rec": ["entries", "std", "norm", "lab", "known", "intervals", "rec"],
    "fc_std": ["fc_entries", "fc_std"], "ev_entries": ["ev_entries"], "ev_std": ["ev_entries", "ev_std"],
    "ev_lab": ["ev_entries", "ev_std", "ev_lab"],
    "ev_intervals": ["ev_entries", "ev_std", "ev_lab", "ev_known", "ev_intervals"],
    "ev_rec": ["ev_entries", "ev_std", "ev_lab", "ev_known", "ev_intervals", "ev_rec"],
}


def query(body: str, *bases: str, **more: str) -> str:
    """A query over named bases, with further common table expressions before it."""
    names: list[str] = []
    for base in bases:
        names += [n for n in CHAINS[base] if n not in names]
    ctes = [f"{n} as materialized ({PARTS[n]()})" for n in names]
    ctes += [f"{n} as ({sql})" for n, sql in more.items()]
    return (f"with {', '.join(ctes)} " if ctes else "") + body
