"""Transaction frames derived from the given tables.

The given tables hold no statements, so orders and events are read as bank
transactions. Each derivation is a list of SQL column expressions that Spark and
DuckDB both accept; the few spellings that differ are looked up by engine. Every
derivation covers its whole table.
"""

from pyspark.sql import DataFrame, SparkSession

#: Narrations given to orders by turns: every category, channel and kind of noise.
NARRATIONS = [
    "SALARY PAYMENT ACME LTD",
    "NIP TRF FROM CLIENT - FREELANCE PROJECT PAYMENT",
    "DIVIDEND CREDIT STANBIC INVESTMENT",
    "NETFLIX SUBSCRIPTION WEB PURCHASE",
    "SPOTIFY PREMIUM MONTHLY",
    "DSTV MONTHLY PACKAGE",
    "CHATGPT PLUS OPENAI ONLINE",
    "GOOGLE ONE STORAGE",
    "CANVA PRO CARD PAYMENT",
    "HOUSE RENT LEKKI LANDLORD",
    "SERVICE CHARGE ESTATE FACILITIES",
    "EKEDC PREPAID TOKEN 12345678901",
    "SPECTRANET INTERNET BILL",
    "LAWMA   WASTE BILL ",
    "POS PURCHASE AT SHOPRITE LEKKI/POS/REF1234567",
    "POS SPAR MARKET IKEJA",
    "CHOWDECK ORDER - RESTAURANT",
    "GLOVO FOOD DELIVERY",
    "GLOVO  PAYMENT REFUND FEE",
    "DOMINOS PIZZA VI",
    "KFC AJAH|SESSION9988776655",
    "UBER TRIP LAGOS",
    "BOLT RIDE IKEJA",
    "BOLT BANK CHARGE",
    "CONOIL FUEL STATION",
    "AIR PEACE FLIGHT TICKET",
    "INVOICE 4471 OFFICE SUPPLIES VENDOR",
    "FIRS TAX PAYMENT",
    "TAX REFUND PROCESSING FEE",
    "TRF TO MAMA ACCOUNT GTBANK",
    "NIP ZENITH TRF JOHN DOE",
    "USSD AIRTIME RECHARGE *737*",
    "OPAY WALLET TRANSFER",
    "KUDA BANK SEND MONEY",
    "ATM WITHDRAWAL AT FIRST BANK BRANCH",
    "CASH DEPOSIT OVER THE COUNTER",
    "Opening Balance",
    "Total Debit",
    "CHEQUE 000123 STANDING ORDER",
    "FOOD BANK DONATION VIA   PAYSTACK",
    "DUBAI MALL SHOPPING",
]

#: Narration of each event type.
EVENT_NARRATIONS = {
    "click": "POS PURCHASE AT SPAR MARKET",
    "error": "NETFLIX SUBSCRIPTION",
    "purchase": "UBER TRIP LAGOS",
    "signup": "SALARY PAYMENT ACME LTD",
    "view": "EKEDC PREPAID TOKEN",
}

#: Thirty neighbouring customers share one user's account.
USER = "cast(cast(floor(o_custkey / 30.0) as bigint) as string)"
#: A statement covers 5,000 neighbouring order keys, so none is longer than that.
PART = "cast(cast(floor(o_orderkey / 5000.0) as bigint) as string)"

#: Share of the order price that is spent, by user.
DEBIT_SHARES = ["0.10", "0.18", "0.20", "0.22", "0.24", "0.30"]

ENGINE = {
    "spark": {"isodow": "(weekday({0}) + 1)"},
    "duckdb": {"isodow": "isodow({0})"},
}


def _choose(selector: str, values: list[str]) -> str:
    whens = " ".join(f"when {i} then {v}" for i, v in enumerate(values))
    return f"case {selector} {whens} end"


def _looked_up(selector: str, values: list[str]) -> str:
    """As :func:`_choose` in Spark, but by position in a constant array: one step a row."""
    return f"get(array({', '.join(values)}), cast({selector} as int))"


def entry_columns(engine: str) -> dict[str, str]:
    """Orders as transactions."""
    user = "cast(floor(o_custkey / 30.0) as bigint)"
    day = "cast(o_orderdate as date)"
    dow = ENGINE[engine]["isodow"].format(day)
    price = "cast(o_totalprice as decimal(18,2))"
    choose = _looked_up if engine == "spark" else _choose
    share = choose(f"{user} % 6", [f"cast({s} as decimal(4,2))" for s in DEBIT_SHARES])
    return {
        "user_id": USER,
        "upload_id": f"concat({USER}, '-', {PART})",
        "row_ord": "o_orderkey",
        # One user in ten moves spending from Monday and Tuesday back to Sunday.
        "tx_date": f"case when {user} % 10 = 0 and {dow} <= 2 then {day} - cast({dow} as int) "
                   f"else {day} end",
        "raw_desc": choose("o_orderkey % 41", [f"'{n}'" for n in NARRATIONS]),
        "amount": f"cast(case when o_orderkey % 5 = 0 then {price} "
                  f"else round({price} * {share}, 2) end as decimal(18,2))",
        "tx_type": "case when o_orderkey % 5 = 0 then 'credit' else 'debit' end",
        "balance": f"case when o_orderkey % 7 = 0 then null "
                   f"else cast({price} * 3 as decimal(18,2)) end",
    }


#: Factor that brings event values near the low-balance threshold of the forecast.
FORECAST_SCALE = 1000


def event_columns(engine: str, scale: int = 1) -> dict[str, str]:
    """Events as transactions over one month; one user in ten has five days only."""
    day = "cast(ts as date)"
    narration = " ".join(f"when '{k}' then '{v}'" for k, v in EVENT_NARRATIONS.items())
    return {
        "user_id": "cast(user_id as string)",
        "upload_id": "concat('e', cast(user_id as string))",
        "row_ord": "event_id",
        "tx_date": f"case when user_id % 10 = 0 then "
                   f"cast('2024-01-01' as date) + cast(event_id % 5 as int) else {day} end",
        "raw_desc": f"case event_type {narration} end",
        "amount": f"cast(cast(value as decimal(18,2)) * {scale} as decimal(18,2))",
        "tx_type": "case when event_type = 'signup' then 'credit' else 'debit' end",
        "balance": "case when event_id % 3 = 0 then null else "
                   f"cast(cast(value as decimal(18,2)) * {scale * 5} as decimal(18,2)) end",
    }


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} as {name}" for name, expr in columns.items()])


def derive_sql(source: str, columns: dict[str, str]) -> str:
    return "select " + ", ".join(f"{e} as {n}" for n, e in columns.items()) + f" from {source}"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "orders"), entry_columns("spark"))


def event_entries(spark: SparkSession, sf_dir: str, scale: int = 1) -> DataFrame:
    return derive(table(spark, sf_dir, "events"), event_columns("spark", scale))
