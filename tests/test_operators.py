import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.operators import (blocks, clean, forecast, health, ledger, recommend, recurring,
                                  summary)
from tallyspark.operators.classify import classify
from tallyspark.operators.features import user_features
from tallyspark.operators.standardise import standardise
from tallyspark.schema import ANNOTATIONS


def day(start, offset):
    return str(dt.date.fromisoformat(start) + dt.timedelta(days=offset))


@pytest.fixture(scope="module")
def no_profiles(spark):
    return spark.createDataFrame([], "user_id string, emergency_fund decimal(18,2), "
                                     "total_debt decimal(18,2)")


def annotated(rows_df):
    return classify(recurring.detect_recurring(standardise(rows_df)))


def test_recurring_services_and_summary(entries):
    rows = [(day("2026-01-01", 30 * i), "NETFLIX SUBSCRIPTION MONTHLY", 5900, "debit", 9)
            for i in range(3)]
    rows += [(day("2026-01-03", 30 * i), "SPOTIFY PREMIUM MONTHLY", 3200, "debit", 9)
             for i in range(3)]
    rows += [("2026-01-09", "ODD THING", 10, "debit", 9)]
    tx = annotated(entries(rows))
    assert tx.where("is_recurring").count() == 6
    items = recurring.recurring_summary(tx).orderBy(F.desc("estimated_monthly")).collect()
    assert [(r.name, r.frequency, r.estimated_monthly, str(r.last_charged),
             str(r.next_estimated), r.action, r.occurrence_count) for r in items] == [
        ("Netflix Subscription Monthly", "Monthly", 5900.0, "2026-03-02", "2026-04-01", "review",
         3),
        ("Spotify Premium Monthly", "Monthly", 3200.0, "2026-03-04", "2026-04-03", "review", 3)]


def test_intervals_equal_brute_force_with_a_hot_group(spark, entries):
    random.seed(7)
    rows = [(day("2026-01-01", random.randrange(400)), f"SHOP {random.choice('ABCD')}",
             100, random.choice(["debit"] * 4 + ["credit"]), None) for _ in range(300)]
    rows += [("2026-02-01", "SHOP HOT", 100, "debit", None)] * 300
    got = {r.merchant_key: r for r in
           recurring.interval_groups(standardise(entries(rows))).collect()}
    groups = {}
    for d, text, _, kind, _ in rows:
        if kind == "debit":
            groups.setdefault(text.lower(), []).append(dt.date.fromisoformat(d))
    for key, days in groups.items():
        days.sort()
        gaps = [(b - a).days for a, b in zip(days, days[1:])]
        mean = sum(gaps) / len(gaps)
        std = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5
        regular = any(abs(mean - c) / c <= 0.35 and std <= 0.4 * c for c in V.CYCLES)
        r = got[key]
        assert r.n == len(days)
        assert (r.mean_gap, r.std_gap) == pytest.approx((mean, std), abs=1e-6)
        assert r.is_regular == regular


def test_known_service_last_entry_wins(entries):
    tx = recurring.match_known(standardise(entries(
        [("2026-01-01", "NETFLIX VIA ZOOM VPN", 1, "debit", None),
         ("2026-01-01", "KFC", 1, "debit", None)])))
    assert [(r.is_recurring, r.recurring_group) for r in tx.orderBy("row_ord").collect()] == [
        (True, "VPN Service"), (False, None)]


@pytest.mark.parametrize("block_rows", [3, 65_536])
def test_blocked_windows_equal_plain_order(spark, monkeypatch, block_rows):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block_rows)
    random.seed(3)
    data = []
    for user, size in [("hot", 200), ("a", 7), ("b", 1)]:
        for i in range(size):
            data.append((user, dt.date(2026, 1, 1 + random.randrange(5)), i,
                         random.choice([None, None, i]), i % 5 - 2))
    df = spark.createDataFrame(data, "user_id string, d date, o long, v long, x long")
    filled = {(r.user_id, r.o): r.v
              for r in blocks.carry_forward(df, "v", ["user_id"], "o").collect()}
    sums = {(r.user_id, r.o): r.s for r in blocks.running_sum(
        df, F.col("x"), ["user_id"], "d", "o", "s").collect()}
    assert len(filled) == len(sums) == len(data)
    for user in ("hot", "a", "b"):
        last, total = None, 0
        mine = [r for r in data if r[0] == user]
        for r in sorted(mine, key=lambda r: r[2]):
            last = r[3] if r[3] is not None else last
            assert filled[user, r[2]] == last
        for r in sorted(mine, key=lambda r: (r[1], r[2])):
            total += r[4]
            assert sums[user, r[2]] == total


def test_deduplication_keeps_the_first_and_is_idempotent(entries):
    rows = [("2026-01-01", "UBER TRIP", 10, "debit", None),
            ("2026-01-01", "UBER TRIP", 10, "debit", None),
            ("2026-01-01", "uber trip", 10, "debit", None),
            ("2026-01-02", "UBER TRIP", 10, "debit", None)]
    once = clean.deduplicate(standardise(entries(rows)))
    assert sorted(r.row_ord for r in once.collect()) == [0, 3]
    assert clean.deduplicate(once).count() == 2


def test_duplicates_are_cut_before_the_shuffle(entries):
    plan = clean.drop_exact_duplicates(standardise(entries(
        [("2026-01-01", "X", 1, "debit", None)])))._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.index("Partial") > plan.index("Exchange")


def test_health_score_bounds_and_examples(entries, no_profiles, spark):
    def score(income, spent, fund=None):
        tx = classify(standardise(entries([
            ("2026-03-25", "Salary", income, "credit", None),
            ("2026-03-15", "FOOD", spent, "debit", None)])))
        profiles = no_profiles if fund is None else spark.createDataFrame(
            [("u1", Decimal(fund), Decimal(0))], no_profiles.schema)
        return health.score_users(user_features(tx), profiles).collect()[0]

    good, bad = score(1_000_000, 200_000, 1_200_000), score(300_000, 500_000)
    assert 70 <= good.score <= 100 and 0 <= bad.score < 50
    assert set(good.breakdown) == {name for name, _ in V.HEALTH_WEIGHTS}
    assert good.breakdown["expense_stability"].score == 70.0
    assert bad.insights[0] == V.INSIGHTS["savings_critical"]


def plans(spark, budgets=(), goals=()):
    return (spark.createDataFrame(list(budgets), "user_id string, category string, month date, "
                                                 "amount decimal(18,2)"),
            spark.createDataFrame(list(goals), "user_id string, monthly_contribution "
                                               "decimal(18,2), is_completed boolean"))


def test_recommendations_of_an_overspender(entries, no_profiles, spark):
    rows = [("2026-03-28", "Salary", 210_000, "credit", None),
            ("2026-03-03", "KFC", 126_000, "debit", None),
            ("2026-03-07", "HOUSE RENT", 61_000, "debit", None),
            ("2026-03-16", "NETFLIX", 55_000, "debit", None),
            ("2026-03-19", "UBER", 33_000, "debit", None)]
    budgets, goals = plans(spark, [("u1", "food", dt.date(2026, 1, 1), Decimal(999_999)),
                                   ("u1", "food", dt.date(2026, 3, 1), Decimal(100_000))])
    planned = recommend.with_plans(user_features(annotated(entries(rows))), no_profiles, budgets,
                                   goals)
    got = recommend.recommend(planned).orderBy("rank").collect()
    assert [r.title for r in got][:3] == [
        "⚠ Negative Cash Flow This Month", "↑ Overspending on Food", "Over Budget: Food"]
    assert [r.priority for r in got] == sorted(r.priority for r in got)
    assert got[0].body.startswith("You spent ₦65,000.00 more than you earned.")
    assert any("Subscription Overload (1 services, ₦55,000.00/mo)" in r.title for r in got)
    assert len({r.title for r in got}) == len(got)


def test_no_transactions_no_recommendations(spark, entries, no_profiles):
    budgets, goals = plans(spark)
    empty = annotated(entries([("2026-01-01", "X", 1, "debit", None)])).where("amount > 5")
    assert recommend.recommend(recommend.with_plans(user_features(empty), no_profiles, budgets,
                                                    goals)).count() == 0


def test_goals_exceed_savings(spark, entries, no_profiles):
    budgets, goals = plans(spark, goals=[("u1", Decimal(700), False), ("u1", None, False),
                                         ("u1", Decimal(9999), True)])
    rows = [("2026-03-25", "Salary", 1000, "credit", None),
            ("2026-03-10", "XX", 500, "debit", None)]
    planned = recommend.with_plans(user_features(annotated(entries(rows))), no_profiles, budgets,
                                   goals)
    got = recommend.recommend(planned, ["goals"]).collect()
    assert [(r.priority, r.impact_amount) for r in got] == [(4, 200.0)]


def test_forecast_rows_and_closed_forms(entries):
    base, rows = "2026-03-01", []
    for i in range(30):
        rows.append((day(base, i), "SPEND", 20_000, "debit", 500_000 - i * 5000))
        if i == 24:
            rows.append((day(base, i), "SALARY", 850_000, "credit", 1_000_000))
    tx = standardise(entries(rows))
    ahead = forecast.cashflow_forecast(tx).orderBy("day_no").collect()
    assert len(ahead) == 30 and str(ahead[0].forecast_date) == "2026-03-31"
    net = [-20_000.0 + (850_000 if i == 24 else 0) for i in range(30)]
    weights = [forecast.DECAY ** (29 - i) for i in range(30)]
    ewm = sum(w * x for w, x in zip(weights, net)) / sum(weights)
    feature = forecast.history_features(tx).collect()[0]
    assert feature.ewm_net == pytest.approx(ewm)
    weekdays = [dt.date.fromisoformat(day(base, i)).weekday() for i in range(30)]
    overall = sum(net) / 30
    for d in range(7):
        mine = [x for x, w in zip(net, weekdays) if w == d]
        assert feature.dow_factors[d] == pytest.approx(
            max(0.2, min(3.0, sum(mine) / len(mine) / overall)))
    assert ahead[0].net_flow == pytest.approx(
        round(ewm * feature.dow_factors[1] + 850_000 / 30, 2))
    assert feature.current_balance == 355_000.0


def test_a_stated_balance_opens_the_forecast(spark, entries):
    tx = standardise(entries([(f"2026-01-{d:02d}", "X", 10, "debit", 500) for d in range(1, 11)]))
    stated = spark.createDataFrame([("u1", 70.0)], "user_id string, balance double")
    assert forecast.forecast_summary(tx).first().current_balance == 500.0
    assert forecast.forecast_summary(tx, opening=stated).first().current_balance == 70.0
    first = forecast.cashflow_forecast(tx, opening=stated).orderBy("day_no").first()
    assert round(first.projected_balance - first.net_flow, 2) == 70.0


@pytest.mark.parametrize("column, value, score", [
    ("monthly_cv", 0.10, 100.0), ("monthly_cv", 0.101, 85.0), ("monthly_cv", 0.25, 85.0),
    ("monthly_cv", 0.40, 65.0), ("monthly_cv", 0.5, 55.0), ("monthly_cv", 0.9, 30.0),
    ("weekly_cv", 0.15, 100.0), ("weekly_cv", 0.30, 60.0), ("weekly_cv", 0.50, 30.0),
    ("weekly_cv", 0.75, 15.0), ("weekly_cv", 2.0, 0.0), ("weekly_cv", None, 0.0),
    ("debt_ratio", 0.0, 100.0), ("debt_ratio", 0.15, 90.0), ("debt_ratio", 0.30, 50.0),
    ("debt_ratio", 0.50, 20.0), ("debt_ratio", 2.0, 0.0), ("emergency_months", 6.0, 100.0),
    ("emergency_months", 3.0, 60.0), ("emergency_months", 1.0, 25.0),
    ("emergency_months", 0.5, 12.5), ("savings_rate", 0.3, 100.0), ("savings_rate", 0.2, 80.0),
    ("savings_rate", 0.1, 50.0), ("savings_rate", 0.05, 25.0), ("savings_rate", -0.1, 0.0)])
def test_score_bands(spark, column, value, score):
    """Literal expectations at the edges of every band."""
    name = {"monthly_cv": "income_stability", "weekly_cv": "expense_stability",
            "emergency_months": "emergency_coverage"}.get(column, column)
    row = spark.createDataFrame([(value, 9, 9, 9)], f"{column} double, n_debits int, "
                                                    "n_credits int, n_months int")
    assert row.selectExpr(health.SCORES[name]).first()[0] == pytest.approx(score)


def test_a_single_week_has_no_spread(entries, no_profiles):
    tx = classify(standardise(entries([(f"2026-03-0{d}", "FOOD", d, "debit", None)
                                       for d in range(2, 7)])))
    shown = health.score_users(user_features(tx), no_profiles).first().breakdown
    assert shown["expense_stability"].label == "CV=nan% expense variability"


def test_thin_history_and_no_history(spark, entries):
    tx = standardise(entries([("2026-03-01", "PAY", 700, "credit", None),
                              ("2026-03-03", "SPEND", 100, "debit", None)]))
    users = spark.createDataFrame([("u1",), ("nobody",)], "user_id string")
    got = {r.user_id: r for r in forecast.forecast_summary(tx, users=users).collect()}
    assert (got["u1"].days_until_low, got["u1"].expected_month_end_balance,
            got["u1"].estimated_monthly_income) == (None, 9000.0, 700.0)
    assert (got["nobody"].days_until_low, got["nobody"].expected_month_end_balance) == (None, 0)


def test_validation_warnings(spark, entries):
    tx = standardise(entries([("2026-03-01", "PAY", 700, "credit", None)]))
    uploads = spark.createDataFrame([("u1",), ("u2",)], "user_id string")
    got = {r.user_id: r.warnings for r in clean.validation_report(tx, uploads).collect()}
    assert got == {"u1": [V.VALIDATION_WARNINGS["all_credits"]],
                   "u2": [V.VALIDATION_WARNINGS["empty"]]}


def test_spend_adds_up(entries):
    rows = [("2026-01-01", "KFC", "10.10", "debit", None), ("2026-02-01", "UBER", 5, "debit", None),
            ("2026-02-02", "SALARY", 50, "credit", None)]
    tx = classify(standardise(entries(rows)))
    spent = summary.category_spend(tx).agg(F.sum("total")).first()[0]
    assert spent == summary.monthly_summary(tx).agg(F.sum("total_expenses")).first()[0]
    assert float(spent) == 15.1


def test_manual_entries_fold(spark):
    log = spark.createDataFrame([
        ("u", 1, "a", "add", "lunch", None), ("u", 2, "b", "add", "taxi", "x"),
        ("u", 3, "a", "update", "dinner", ""), ("u", 4, "b", "delete", "taxi", None),
        ("u", 5, "b", "update", "late", None), ("u", 6, "c", "update", "never added", None)],
        "user_id string, seq long, entry_id string, op string, description string, "
        "category string").selectExpr("*", "date'2026-01-01' as tx_date", "1D as amount",
                                      "'debit' as tx_type", "'' as channel",
                                      "cast(null as string) as notes")
    got = ledger.manual_ledger(log).collect()
    assert [(r.entry_id, r.description, r.category, r.channel, r.notes) for r in got] == [
        ("a", "dinner", "miscellaneous", "cash", "")]


def test_sanitise_reaches_nested_doubles(spark):
    df = spark.sql("""select 1 as n, double('NaN') as a, array(double('inf'), 1D) as b,
        named_struct('x', double('NaN'), 'y', 's') as c, cast(null as struct<x:double>) as e,
        map('k', named_struct('v', array(double('-inf'), 2D))) as d""")
    row = ledger.sanitise(df).collect()[0]
    assert (row.n, row.a, row.b, row.c.x, row.c.y, row.e) == (1, None, [None, 1.0], None, "s", None)
    assert row.d["k"].v == [None, 2.0]
    assert [f.dataType for f in ledger.sanitise(df).schema][:4] == [
        f.dataType for f in df.schema][:4]


def test_two_uploads_with_the_same_day_and_place_are_ordered(spark, entries):
    rows = [("2026-03-01", "A", 10, "debit", 100), ("2026-03-01", "B", 5, "credit", 200)]
    both = entries(rows, upload="s2").union(entries(rows, upload="s1")).repartition(3)
    tx = standardise(both)
    got = summary.running_balance(tx).orderBy("running_balance").collect()
    assert {(r.upload_id, r.raw_desc): float(r.running_balance) for r in got} == {
        ("s1", "A"): -10.0, ("s2", "A"): -20.0, ("s1", "B"): -15.0, ("s2", "B"): -10.0}
    late = tx.withColumn("balance", F.when(F.col("upload_id") == "s2", F.col("balance") + 1)
                         .otherwise(F.col("balance")))
    assert float(forecast.current_balance(late).first().current_balance) == 201.0


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "user_id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "user_id string, v int")
    assert sorted(map(tuple, ledger.upsert(old, new, ["user_id"]).collect())) == [
        ("a", 1), ("b", 3), ("c", 4)]
    users = spark.createDataFrame([("a",)], "user_id string")
    assert sorted(map(tuple, ledger.replace_for_users(old, new, users).collect())) == [
        ("b", 2), ("b", 3), ("c", 4)]


def test_annotations_are_complete(entries):
    tx = annotated(entries([("2026-01-01", "X", 1, "debit", None)]))
    assert set(ANNOTATIONS) <= set(tx.columns)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cleaned_once_and_unread_labels_not_made(entries, spark):
    from tallyspark.operators.clean import remove_noise
    from tallyspark.operators.standardise import standardise
    from tallyspark.schema import ENTRY
    spark.conf.set("spark.sql.maxPlanStringLength", "1000000")
    raw = spark.createDataFrame([], ENTRY).repartition(2)
    plan = _plan(remove_noise(standardise(raw)).select("user_id", "description"))
    assert plan.count("d{8,}") == 1
    assert "initcap" not in plan and "Contains" not in plan


def _some_orders(spark, folder):
    """Orders whose keys lie outside the looked-up values or are missing, and customers."""
    spark.sql("""select * from values
        (-7L, 35L, 'O', 100D, timestamp'2001-01-02 00:00:00', 'x'),
        (3L, -40L, 'O', 80D, timestamp'2001-02-02 00:00:00', 'x'),
        (3L, 40L, 'O', 80D, timestamp'2001-02-02 00:00:00', 'x'),
        (4L, 40L, 'O', 90D, timestamp'2001-03-02 00:00:00', 'x'),
        (5L, 40L, 'O', 90D, timestamp'2001-03-02 00:00:00', 'x'),
        (null, null, 'O', 90D, timestamp'2001-03-02 00:00:00', 'x')
        as t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)
        """).write.parquet(f"{folder}/orders.parquet")
    spark.sql("""select * from values (40L, 'c', 12.5D) as t(c_custkey, c_name, c_acctbal)
        """).write.parquet(f"{folder}/customer.parquet")


def test_looked_up_entry_values_equal_their_cases(spark, tmp_path):
    from tallyspark.plans import tables
    _some_orders(spark, str(tmp_path))
    cases = tables.derive(tables.table(spark, str(tmp_path), "orders"), {
        "o_orderkey": "o_orderkey", "o_custkey": "o_custkey",
        "raw_desc": tables.entry_columns("duckdb")["raw_desc"],
        "amount": tables.entry_columns("duckdb")["amount"]})
    found = tables.derive(tables.table(spark, str(tmp_path), "orders"), {
        "o_orderkey": "o_orderkey", "o_custkey": "o_custkey",
        "raw_desc": tables.entry_columns("spark")["raw_desc"],
        "amount": tables.entry_columns("spark")["amount"]})
    assert found.dtypes == cases.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, cases.collect()))


def test_recommendations_read_orders_once(spark, tmp_path):
    from tallyspark.plans import queries_recommend
    _some_orders(spark, str(tmp_path))
    plan = _plan(queries_recommend.planned(spark, str(tmp_path)))
    assert "o_orderkey" not in plan and "paystack" not in plan.lower()


def test_search_of_many_texts_equals_all_pairs(spark):
    import random
    from tallyspark.operators import search
    r = random.Random(4)
    words = ["netflix", "subscription", "web", "fuel", "station", "lekki", "market", "rice"]

    def typo(w):
        k = r.randrange(len(w))
        return w[:k] + r.choice("aeiou") + w[k + 1:]
    texts = [" ".join(r.choice([w, typo(w)]) for w in r.choices(words, k=r.randint(1, 4)))
             for _ in range(200)] + [None, "", "--", "rice", "rice"]
    asked = [" ".join(r.choices(words, k=2)) for _ in range(30)] + [None, "", "ab"]

    def grams(t):
        return {p[i:i + 3] for w in (t or "").split() for p in [f"  {w} "]
                for i in range(len(p) - 2)}
    for threshold in (0.3, 0.5, 1.0):
        got = search.search_many(spark.createDataFrame([(t,) for t in texts], "description string"),
                                 spark.createDataFrame([(t,) for t in asked], "search string"),
                                 threshold).collect()
        want = {}
        for a in {x for x in asked if grams(x)}:
            for b in {x for x in texts if grams(x.strip("-") if x else x)}:
                share = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
                if share >= threshold:
                    want[a, b] = (round(share, 6), texts.count(b))
        assert {(x.search, x.text): (x.similarity, x.n) for x in got} == want
        assert want


def test_search_of_many_texts_verifies_few_pairs(spark):
    """Words made of the same few pieces share many trigrams, yet hardly any pair is verified."""
    import random
    from tallyspark.operators import search
    draw = random.Random(7)
    parts = ["an", "de", "the", "ion", "er", "re", "on", "ha", "ou", "ly"]

    def sentence():
        return " ".join("".join(draw.choices(parts, k=3)) for _ in range(8))

    texts = [sentence() for _ in range(300)]
    asked = [sentence() for _ in range(20)] + [texts[5] + " an", texts[9][:40]]
    sizes = {}

    def cut(df, name):
        sizes[name] = df.count()
        return df

    got = search.search_many(spark.createDataFrame([(t,) for t in texts], "description string"),
                             spark.createDataFrame([(t,) for t in asked], "search string"),
                             0.5, cut=cut).collect()

    def grams(text):
        return {f"  {w} "[i:i + 3] for w in text.split() for i in range(len(w) + 1)}

    want = {(a, b) for a in asked for b in texts
            if 2 * len(grams(a) & grams(b)) >= len(grams(a) | grams(b))}
    assert {(r.search, r.text) for r in got} == want and len(want) >= 2
    assert sizes["pairs"] < 300 * 22 / 10 + 2 * len(want)


def test_search_of_many_texts_moves_few_bytes(spark, tmp_path):
    """Texts are stored and moved without their trigrams; postings of the texts are not moved."""
    from tallyspark.operators import search

    def cut(df, name):
        if name == "pairs":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        if name == "texts":
            assert df.columns == ["text", "n", "text_key"]
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    plans, texts = [], [(f"rice market number {k} lekki",) for k in range(50)]
    got = search.search_many(spark.createDataFrame(texts, "description string"),
                             spark.createDataFrame([("rice market number 7 lekki",), ("fuel",)],
                                                   "search string"), 0.9, cut=cut)
    assert ("rice market number 7 lekki", 1.0) in [(r.text, r.similarity) for r in got.collect()]
    assert plans[0].count("MapInArrow") == 1 and "Window" not in plans[0]
    assert plans[0].count("Exchange hashpartitioning") == 1  # of the pairs that are left


def test_postings_hold_the_rarest_trigrams_of_any_letters(spark):
    import numpy as np
    import pyarrow as pa
    from tallyspark.operators import postings
    words = ["ab a", "\u00e9t\u00e9 \U00010400x", "", "ab"]
    batch = pa.RecordBatch.from_pydict({"key": list(range(4)), "words": words})
    found = pa.Table.from_batches(postings.rare_postings(
        [batch], np.zeros(postings.BUCKETS, np.int64), None, 0.01)).to_pylist()

    def codes(text):
        return {sum(ord(c) << s for c, s in zip(p[i:i + 3], (42, 21, 0)))
                for w in text.split() for p in [f"  {w} "] for i in range(len(p) - 2)}
    for key, text in enumerate(words):
        own = [r for r in found if r["key"] == key]
        assert {r["gram"] for r in own} == codes(text)
        assert [r["place"] for r in own] == list(range(1, len(own) + 1))
        assert all(r["size"] == len(own) for r in own)
    assert sum(r["n"] for b in postings.bucket_counts([batch]) for r in b.to_pylist()) == len(found)


def test_constraint_checks_read_each_table_once(spark, tmp_path):
    from tallyspark.operators import summary
    tx = spark.createDataFrame(
        [("a", "f1", "s1", "food", "debit"), ("a", "f1", "s1", "food", "credit"),
         ("b", "f1", "s2", "nothing", "other"), ("b", None, None, None, None),
         ("b", None, "s3", "rent", "debit")],
        "user_id string, fingerprint string, upload_id string, category string, tx_type string")
    uploads = spark.createDataFrame([("s1",), (None,), ("s9",)], "upload_id string")
    budgets = spark.createDataFrame([("a", "food", 1), ("a", "food", 1), ("a", "food", 2),
                                     ("a", None, 2), ("a", None, 2), ("a", "", 2)],
                                    "user_id string, category string, month int")
    months = spark.createDataFrame([("a", 1), ("b", 1), ("a", 1), ("a", 1)],
                                   "user_id string, month int")
    found = summary.constraint_checks(tx, uploads, budgets, months).collect()
    assert {r.check_name: r.violations for r in found} == {
        "tx_type_domain": 2, "unique_fingerprint": 2, "unique_budget": 2, "unique_snapshot": 1,
        "upload_reference": 3, "category_reference": 2}
    none = summary.constraint_checks(*[t.limit(0) for t in (tx, uploads, budgets, months)])
    assert sorted((r.check_name, r.violations) for r in none.collect()) == [
        (name, 0) for name in sorted(summary.CHECKS)]
    stored = []
    for n, frame in enumerate((tx, uploads, budgets, months)):
        frame.write.parquet(str(tmp_path / str(n)))
        stored.append(spark.read.parquet(str(tmp_path / str(n))))
    plan = summary.constraint_checks(*stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 4
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
