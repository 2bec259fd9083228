"""Recommendations: every check reads one feature row per user.

A check is SQL over that row: a condition and, where it holds, a struct. All checks
of a user are one projection, and titles are deduplicated inside the short array it
yields; nothing is shuffled after the feature row.
"""

from pyspark.sql import DataFrame, functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.functions.sqltext import case, fill, naira, plain_number, quoted
from tallyspark.operators.clean import keep_first
from tallyspark.schema import MONEY

BUDGETED = [category for category, _ in V.CATEGORY_TARGETS]


def _advice(key: str, impact: str = "null", about: str | None = None, **values: str) -> str:
    kind, title, body, priority = V.ADVICE[key]
    return (f"named_struct('type', {quoted(kind)}, 'title', {fill(title, **values)}, "
            f"'body', {fill(body, **values)}, 'category', {quoted(about)}, "
            f"'impact_amount', cast({impact} as double), 'priority', {priority})")


def _percent(share: str, places: int = 1) -> str:
    return plain_number(f"({share}) * 100", places)


def savings_check() -> str:
    rate = _percent("savings_rate")
    to_min, to_good = (f"(({limit}D - savings_rate) * income)"
                       for limit in (V.MIN_SAVINGS_RATE, V.GOOD_SAVINGS_RATE))
    return case([
        ("savings_rate < 0", _advice("cash_negative", "abs(net)", gap=naira("abs(net)"))),
        (f"savings_rate < {V.MIN_SAVINGS_RATE}D",
         _advice("savings_low", to_min, rate=rate, gap=naira(to_min))),
        (f"savings_rate < {V.GOOD_SAVINGS_RATE}D",
         _advice("savings_boost", to_good, rate=rate, gap=naira(to_good)))],
        _advice("savings_strong", rate=rate))


def burn_check() -> str:
    share = "(case when income > 0 then try_divide(expenses, income) else 1D end)"
    buffer = "expenses * 0.1D"
    return case([(f"{share} >= 0.95D and {share} < 1D",
                  _advice("burn", buffer, share=_percent(share), buffer=naira(buffer)))])


def overspend_check(category: str, target: float) -> str:
    actual, saving = f"spend_{category}", f"spend_{category} * 0.15D"
    share = f"try_divide({actual}, income)"
    return case([(
        f"income > 0 and {actual} > 0 and {share} > {target}D * 1.2D",
        _advice("overspend", saving, category, title=quoted(category.title()),
                category=quoted(category), actual=naira(actual), share=_percent(share),
                target=quoted(f"{target * 100:.0f}"), saving=naira(saving)))])


def budget_check(category: str) -> str:
    """Over budget; only where the user has income and a budget for the category."""
    actual, budget = f"spend_{category}", f"budget_{category}"
    over = f"({actual} - {budget})"
    return case([(f"income > 0 and {actual} > 0 and {actual} > {budget}", _advice(
        "over_budget", over, category, title=quoted(category.title()),
        category=quoted(category), over=naira(over), actual=naira(actual),
        budget=naira(budget)))])


def subscription_check() -> str:
    total, n = "spend_subscriptions", "cast(n_subscriptions as string)"
    share, saving = f"try_divide({total}, income)", f"{total} * 0.35D"
    return case([
        (f"{total} > 0 and income > 0 and {share} > {V.SUBSCRIPTION_SHARE}D",
         _advice("subscription_load", saving, "subscriptions", n=n, total=naira(total),
                 share=_percent(share), saving=naira(saving))),
        (f"{total} > 0 and n_subscriptions >= 4",
         _advice("subscription_count", "null", "subscriptions", n=n, total=naira(total)))])


def emergency_check() -> str:
    """Skipped for users whose emergency fund is not known."""
    months = "try_divide(emergency_fund, expenses)"
    target = f"(expenses * {V.EMERGENCY_MONTHS})"
    gap = f"({target} - emergency_fund)"
    shown = plain_number(months, 1)
    return case([
        (f"expenses > 0 and {months} < 1",
         _advice("fund_critical", gap, months=shown, gap=naira(gap))),
        (f"expenses > 0 and {months} < 3",
         _advice("fund_low", f"{gap} / 6", months=shown, target=naira(target),
                 fund=naira("emergency_fund"), monthly=naira(f"{gap} / 6"))),
        (f"expenses > 0 and {months} < {V.EMERGENCY_MONTHS}",
         _advice("fund_building", "null", months=shown, gap=naira(gap)))])


def food_check() -> str:
    ratio, saving = "try_divide(eat_out, groceries)", "eat_out * 0.40D"
    return case([(f"eat_out > 0 and groceries > 0 and {ratio} > 2", _advice(
        "eating_out", saving, "food", ratio=plain_number(ratio, 1), out=naira("eat_out"),
        groceries=naira("groceries"), saving=naira(saving)))])


def weekend_check() -> str:
    share = "try_divide(weekend_spend, expenses) * 100"
    return case([(f"{share} > 40", _advice(
        "weekend", "weekend_spend * 0.15D", share=plain_number(share, 0),
        weekend=naira("weekend_spend"), weekday=naira("weekday_spend")))])


def income_check() -> str:
    return case([("n_credits >= 2 and n_months >= 2 and monthly_cv > 0.3D", _advice(
        "variable_income", cv=_percent("monthly_cv", 0), lowest=naira("lowest_month")))])


def goal_check() -> str:
    gap = "(goal_contributions - net)"
    return case([("net > 0 and goal_contributions > net", _advice(
        "goals", gap, needed=naira("goal_contributions"), net=naira("net"),
        gap=naira(gap)))])


def check_groups() -> dict[str, list[str]]:
    """All checks in their order, by name."""
    spending = [check for category, target in V.CATEGORY_TARGETS
                for check in (overspend_check(category, target), budget_check(category))]
    return {"savings": [savings_check()], "burn": [burn_check()], "spending": spending,
            "overspend": [overspend_check(c, t) for c, t in V.CATEGORY_TARGETS],
            "budget": [budget_check(c) for c in BUDGETED],
            "subscriptions": [subscription_check()], "emergency": [emergency_check()],
            "food": [food_check()], "weekend": [weekend_check()],
            "income_var": [income_check()], "goals": [goal_check()]}


ALL_CHECKS = ["savings", "burn", "spending", "subscriptions", "emergency", "food", "weekend",
              "income_var", "goals"]


def with_plans(features: DataFrame, profiles: DataFrame, budgets: DataFrame,
               goals: DataFrame) -> DataFrame:
    """Add emergency fund, latest budget per category and open goal contributions.

    Each side is reduced to one row per user before it is joined.
    """
    latest = keep_first(budgets, ["user_id", "category"], [F.desc("month")])
    budget_row = latest.groupBy("user_id").agg(*[
        F.expr(f"max(case when category = '{c}' then amount end)").alias(f"budget_{c}")
        for c in BUDGETED])
    goal_row = goals.where("not coalesce(is_completed, false)").groupBy("user_id").agg(
        F.sum(F.coalesce("monthly_contribution", F.lit(0))).cast(MONEY)
        .alias("goal_contributions"))
    return (features
            .join(profiles.select("user_id", "emergency_fund"), "user_id", "left")
            .join(budget_row, "user_id", "left").join(goal_row, "user_id", "left"))


def recommend(planned: DataFrame, checks: list[str] | None = None) -> DataFrame:
    """One row per recommendation: by priority, then check order, first of each title."""
    groups = check_groups()
    structs = [check for name in (checks or ALL_CHECKS) for check in groups[name]]
    # Texts and rates are worked out on doubles.
    numbers = planned.withColumn("weekday_spend", F.col("expenses") - F.col("weekend_spend"))
    numbers = numbers.select(*[F.col(c).cast("double") if kind.startswith("decimal")
                               else F.col(c) for c, kind in numbers.dtypes])
    ranked = ("array_sort(transform(array_compact(array(" + ", ".join(structs) + ")), (r, i) -> "
              "named_struct('priority', r.priority, 'seq', i, 'rec', r)))")
    first = ("filter(ranked, (r, i) -> not exists(slice(ranked, 1, i), "
             "e -> e.rec.title = r.rec.title))")
    return (numbers.selectExpr("user_id", f"{ranked} as ranked")
            .selectExpr("user_id", f"posexplode({first}) as (pos, r)")
            .selectExpr("user_id", "pos + 1 as rank", "r.rec.*"))
