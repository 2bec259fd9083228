from pyspark.sql import functions as F

from tallyspark.functions import dates, labels, money, text


def evaluate(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_parse_money(spark):
    texts = ["18600", "1,234,567.50", "₦18,600.00", "18,600.00 DR", "18,600.00CR", "-18600", "",
             "N/A", "nan", None, "5d", "1e3", "₦ 1 200.5 cr"]
    assert evaluate(spark, texts, money.parse_money(F.col("x"))) == [
        18600.0, 1234567.5, 18600.0, 18600.0, 18600.0, -18600.0, 0.0, 0.0, None, None, 0.0,
        1000.0, 1200.5]


def test_naira(spark):
    values = [1234567.5, 0.0, 5000.0, -5000.0]
    assert evaluate(spark, values, money.naira(F.col("x")), "double") == [
        "₦1,234,567.50", "₦0.00", "₦5,000.00", "₦-5,000.00"]
    assert evaluate(spark, values, money.naira(F.col("x"), True), "double") == [
        "+₦1,234,567.50", "+₦0.00", "+₦5,000.00", "-₦5,000.00"]


def test_signed_amount(spark):
    got = evaluate(spark, ["-18600.00", "18600.00 CR", "18600.00 DR", "5000", None],
                   money.signed_amount(F.col("x")))
    assert [(r.amount, r.tx_type) for r in got] == [
        (18600.0, "debit"), (18600.0, "credit"), (18600.0, "debit"), (5000.0, "debit"),
        (None, "debit")]


def test_rounding_follows_the_double(spark):
    assert evaluate(spark, [2.675, 0.125, 1234.565, -0.5], money.rounded(F.col("x"), 2),
                    "double") == [round(v, 2) for v in [2.675, 0.125, 1234.565, -0.5]]


def test_amount_bucket_ties_to_even(spark):
    assert evaluate(spark, [50.0, 150.0, 250.0, 149.99],
                    money.amount_bucket(F.col("x").cast("decimal(18,2)")), "double") == [
        round(a / 100) * 100 for a in (50.0, 150.0, 250.0, 149.99)]


def test_labels(spark):
    assert evaluate(spark, ["TRF FROM GTBank - JOHN DOE", "ZENITH BANK TRANSFER",
                            "OPAY WALLET TRANSFER", "PALMPAY PAYMENT", "KUDA BANK TRANSFER",
                            "RANDOM PAYMENT DESCRIPTION", "DUBAI MALL"],
                    labels.detect_bank("x")) == ["GTBank", "Zenith", "OPay", "PalmPay", "Kuda",
                                                 None, "UBA"]
    assert evaluate(spark, ["POS PURCHASE AT SHOPRITE", "ATM WITHDRAWAL AT GTB BRANCH",
                            "NIP TRF TO JOHN DOE", "NETFLIX SUBSCRIPTION PAYMENT",
                            "USSD AIRTIME PURCHASE", "SOME RANDOM DESCRIPTION", "CALL *737*1#"],
                    labels.detect_channel("x")) == ["POS", "ATM", "Transfer", "Card Online",
                                                    "USSD", "Bank Transfer", "USSD"]


def test_merchant(spark):
    got = evaluate(spark, ["POS PURCHASE AT SHOPRITE LEKKI/REF12345678", "TRF TO JOHN DOE SAVINGS",
                           "o'neil-shop LEKKI 2x", "/REF123456"],
                   text.extract_merchant(F.col("x")))
    assert got == ["Shoprite Lekki", "John Doe Savings", "O'Neil-Shop Lekki 2X", "/REF123456"]


def test_clean_description(spark):
    got = evaluate(spark, ["SHOPRITE LEKKI 123456789012", "UBER TRIP|SESSION12345", "", "A" * 300,
                           "12345678"], text.clean_description(F.col("x")))
    assert got == ["SHOPRITE LEKKI", "UBER TRIP", "", "A" * 255, "12345678"]


def test_normalise_description(spark):
    got = evaluate(spark, ["POS PURCHASE AT  SPAR", "trf to mama", "NIP ZENITH TRF x",
                           "PAID via  paystack "], text.normalise_description(F.col("x")))
    assert got == ["POS — SPAR", "Transfer to mama", "NIP Transfer x", "PAID via Paystack"]


def test_merchant_key(spark):
    assert evaluate(spark, ["POS NETFLIX.COM 4471 payment", "to-from"],
                    text.merchant_key(F.col("x"))) == ["netflixcom", ""]


def test_categories(spark):
    cases = [
        ("Salary Payment Glovo Nigeria", "credit", "income"),
        ("Random incoming payment", "credit", None),
        ("FREELANCE PROJECT", "credit", "freelance"),
        ("POS PURCHASE AT SHOPRITE LEKKI", "debit", "food"),
        ("DOMINOS PIZZA VICTORIA ISLAND", "debit", "food"),
        ("GLOVO FOOD DELIVERY ORDER", "debit", "food"),
        ("GLOVO PAYMENTS", "debit", None),
        ("UBER TRIP - VICTORIA ISLAND LAGOS", "debit", "transport"),
        ("BOLT RIDE IKEJA TO LEKKI", "debit", "transport"),
        ("BOLT BANK", "debit", None),
        ("EKEDC PREPAID TOKEN", "debit", "utilities"),
        ("SPECTRANET INTERNET SUBSCRIPTION", "debit", "subscriptions"),
        ("OFFICE RENT", "debit", "rent"),
        ("PARK 'N SHOP", "debit", "food"),
        ("NIP TRF TO MAMA ACCOUNT", "debit", "transfers"),
        ("XYZ UNKNOWN", "debit", None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)],
                               "i int, d string, t string, want string")
    got = df.select("i", "want", labels.matched_category("d", "t").alias("y")).orderBy("i")
    assert [(r.i, r.y) for r in got.collect()] == [(i, c[2]) for i, c in enumerate(cases)]


def test_mixed_dates(spark):
    got = evaluate(spark, ["01/02/2026", "15/02/2026", "5-Jan-2026", "2026-01-05 10:11:12",
                           "05 JAN 2026", "x"], dates.parse_mixed(F.col("x")))
    assert [str(d) if d else None for d in got] == [
        "2026-01-02", "2026-02-15", "2026-01-05", "2026-01-05", "2026-01-05", None]
    assert str(evaluate(spark, ["01/02/2026"], dates.parse_mixed(F.col("x"), True))[0]) \
        == "2026-02-01"


def test_trigram_similarity(spark):
    score = text.trigram_similarity(text.trigrams(F.col("x")), text.trigrams(F.lit("word")))
    assert evaluate(spark, ["word", "words", "zzz"], score) == [1.0, 4 / 7, 0.0]


def test_shapes_leave_out_no_text_that_a_pattern_reads(spark):
    from tallyspark.functions import fixed_values as V
    texts = ["2026-1-5", "02026-1-5", "+12026-01-05", "2026/01/05", "13/2/2026", "1/2/26",
             "1-2-2026", "001-2-2026", "5-Jan-2026", "05 jan 26", "January 5, 2026", "Jan 5 2026", "Sep 5, 2026",
             "20260105", "2026-01-05 9:30:00", "2026-01-05 09:30:00", "-2026-1-5", "x", "", None]
    patterns = sorted({*dates.MIXED, *(layout[-1] for layout in V.LAYOUTS)})
    policy = "spark.sql.legacy.timeParserPolicy"
    spark.conf.set(policy, "CORRECTED")
    try:
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        for p in patterns:
            read = df.selectExpr("t", f"cast(try_to_timestamp(t, '{p}') as string) as whole",
                                 f"cast({dates.read_as('t', p)} as string) as shaped").collect()
            assert [r for r in read if r.whole != r.shaped] == [], p
    finally:
        spark.conf.unset(policy)


def test_plain_numbers_are_read_like_others(spark):
    cells = ["5", "+5.", "-.5", "1e3", "5\n", "5d", "NaN", "Infinity", "5\u0085", " 5 ", "1,000.50",
             "₦7 DR", "", None]
    assert str(evaluate(spark, cells, money.parse_money(F.col("x")))) == str(
        [5.0, 5.0, -0.5, 1000.0, 5.0, 0.0, None, 0.0, 5.0, 5.0, 1000.5, 7.0, 0.0, None])
