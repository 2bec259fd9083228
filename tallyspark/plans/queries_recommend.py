"""Queries over recommendations."""

from tallyspark.functions import fixed_values as V
from tallyspark.operators import recommend
from tallyspark.operators.classify import classify
from tallyspark.operators.features import user_features
from tallyspark.operators.recurring import detect_recurring, with_group_key
from tallyspark.operators.sinks import materialise
from tallyspark.plans import duck, frames
from tallyspark.plans.queries_health import features_sql
from tallyspark.plans.registry import plain, register

N = duck.naira


def _pct(share: str, places: int = 1) -> str:
    return duck.fixed(f"({share}) * 100", places)


def _rec(key: str, where: str, impact: str = "null", about: str | None = None,
         **values: str) -> str:
    kind, title, body, priority = V.ADVICE[key]
    return f"""
        select user_id, {duck.lit(kind)} as type, {duck.fill(title, **values)} as title,
               {duck.fill(body, **values)} as body,
               cast({duck.lit(about)} as varchar) as category,
               cast({impact} as double) as impact_amount, {priority} as priority, {{seq}} as seq
        from planned where {where}"""


#: Money as doubles: the same arithmetic as the rates and texts need.
PLANNED = """
    select f.user_id, cast(income as double) as income, cast(expenses as double) as expenses,
           cast(net as double) as net, savings_rate, n_credits, n_months, monthly_cv,
           cast(lowest_month as double) as lowest_month,
           cast(weekend_spend as double) as weekend,
           cast(expenses - weekend_spend as double) as weekday,
           cast(eat_out as double) as eat_out, cast(groceries as double) as groceries,
           coalesce(s.n, 0) as n_subs, cast(p.emergency_fund as double) as fund,
           cast(g.needed as double) as needed, {spends}, {budgets}
    from features f
    left join (select user_id, count(distinct recurring_group) as n from rec
               where category = 'subscriptions' and is_recurring group by user_id) s
      on f.user_id = s.user_id
    left join profiles p on f.user_id = p.user_id
    left join (select user_id, {picks}
               from (select *, row_number() over (partition by user_id, category
                                                  order by month desc) as rn from budget)
               where rn = 1 group by user_id) b on f.user_id = b.user_id
    left join (select user_id, sum(coalesce(monthly_contribution, 0)) as needed from goal
               where not is_completed group by user_id) g on f.user_id = g.user_id""".format(
    spends=", ".join(f"cast(spend_{c} as double) as spend_{c}" for c, _ in V.CATEGORY_TARGETS),
    budgets=", ".join(f"cast(b.budget_{c} as double) as budget_{c}"
                      for c, _ in V.CATEGORY_TARGETS),
    picks=", ".join(f"max(amount) filter (category = '{c}') as budget_{c}"
                    for c, _ in V.CATEGORY_TARGETS))


def _overspend(c: str, t: float) -> str:
    a = f"spend_{c}"
    return _rec("overspend", f"income > 0 and {a} > 0 and {a} / income > {t}::double * 1.2::double",
                f"{a} * 0.15::double", c, title=duck.lit(c.title()), category=duck.lit(c),
                actual=N(a), share=_pct(f"{a} / income"), target=duck.lit(f"{t * 100:.0f}"),
                saving=N(f"{a} * 0.15::double"))


def _budget(c: str) -> str:
    a, b = f"spend_{c}", f"budget_{c}"
    return _rec("over_budget", f"income > 0 and {a} > 0 and {a} > {b}", f"{a} - {b}", c,
                title=duck.lit(c.title()), category=duck.lit(c), over=N(f"{a} - {b}"),
                actual=N(a), budget=N(b))


_LOW, _GOOD = (f"({r}::double - savings_rate) * income"
               for r in (V.MIN_SAVINGS_RATE, V.GOOD_SAVINGS_RATE))
_S, _RATE = "spend_subscriptions", _pct("savings_rate")
_GAP = f"(expenses * {V.EMERGENCY_MONTHS} - fund)"
_MONTHS = duck.fixed("fund / expenses", 1)
CHECKS = {
    "savings": [
        _rec("cash_negative", "savings_rate < 0", "abs(net)", gap=N("abs(net)")),
        _rec("savings_low", "savings_rate >= 0 and savings_rate < 0.2", _LOW, rate=_RATE,
             gap=N(_LOW)),
        _rec("savings_boost", "savings_rate >= 0.2 and savings_rate < 0.3", _GOOD, rate=_RATE,
             gap=N(_GOOD)),
        _rec("savings_strong", "savings_rate >= 0.3", rate=_RATE)],
    "burn": [_rec("burn", "income > 0 and expenses / income >= 0.95 and expenses / income < 1",
                  "expenses * 0.1::double", share=_pct("expenses / income"),
                  buffer=N("expenses * 0.1::double"))],
    "overspend": [_overspend(c, t) for c, t in V.CATEGORY_TARGETS],
    "budget": [_budget(c) for c, _ in V.CATEGORY_TARGETS],
    "spending": [sql for c, t in V.CATEGORY_TARGETS for sql in (_overspend(c, t), _budget(c))],
    "subscriptions": [
        _rec("subscription_load", f"{_S} > 0 and income > 0 and {_S} / income > 0.05",
             f"{_S} * 0.35::double", "subscriptions", n="n_subs", total=N(_S),
             share=_pct(f"{_S} / income"), saving=N(f"{_S} * 0.35::double")),
        _rec("subscription_count",
             f"{_S} > 0 and not (income > 0 and {_S} / income > 0.05) and n_subs >= 4",
             "null", "subscriptions", n="n_subs", total=N(_S))],
    "emergency": [
        _rec("fund_critical", "expenses > 0 and fund / expenses < 1", _GAP, months=_MONTHS,
             gap=N(_GAP)),
        _rec("fund_low", "expenses > 0 and fund / expenses >= 1 and fund / expenses < 3",
             f"{_GAP} / 6", months=_MONTHS, target=N("expenses * 6"), fund=N("fund"),
             monthly=N(f"{_GAP} / 6")),
        _rec("fund_building", "expenses > 0 and fund / expenses >= 3 and fund / expenses < 6",
             months=_MONTHS, gap=N(_GAP))],
    "food": [_rec("eating_out", "eat_out > 0 and groceries > 0 and eat_out / groceries > 2",
                  "eat_out * 0.4::double", "food", ratio=duck.fixed("eat_out / groceries", 1),
                  out=N("eat_out"), groceries=N("groceries"),
                  saving=N("eat_out * 0.4::double"))],
    "weekend": [_rec("weekend", "expenses > 0 and weekend / expenses * 100 > 40",
                     "weekend * 0.15::double", share=_pct("weekend / expenses", 0),
                     weekend=N("weekend"), weekday=N("weekday"))],
    "income_var": [_rec("variable_income", "n_credits >= 2 and n_months >= 2 and "
                        "monthly_cv > 0.3", cv=_pct("monthly_cv", 0),
                        lowest=N("lowest_month"))],
    "goals": [_rec("goals", "net > 0 and needed > net", "needed - net", needed=N("needed"),
                   net=N("net"), gap=N("needed - net"))],
}
PARTS = {"profiles": frames.profiles_sql(), "budget": frames.budgets_sql(),
         "goal": frames.goals_sql(), "features": features_sql("lab"), "planned": PLANNED}


def recs_sql(names: list[str], source: str = "found") -> str:
    """Priority order, then check order; first of each title."""
    return f"""
        select user_id, row_number() over (partition by user_id order by priority, seq) as rank,
               type, title, body, category, impact_amount, priority
        from (select *, row_number() over (partition by user_id, title
                                           order by priority, seq) as copy from {source})
        where copy = 1"""


def found_sql(names: list[str]) -> str:
    parts = [sql for name in names for sql in CHECKS[name]]
    return " union all ".join(sql.replace("{seq}", str(i)) for i, sql in enumerate(parts))


def planned(spark, sf_dir):
    # The interval search and the flags read the same rows: their texts are rewritten
    # and keyed once.
    tx = materialise(with_group_key(frames.normal(spark, sf_dir).select(
        "user_id", "tx_date", "description", "amount", "tx_type")), "normal")
    features = user_features(classify(detect_recurring(tx)))
    return recommend.with_plans(features, frames.profiles(spark, sf_dir),
                                frames.budgets(spark, sf_dir), frames.goals(spark, sf_dir))


def _query(name: str, checks: list[str]) -> None:
    columns = "user_id, cast(rank as int) as rank, type, title, body, category, " \
              "round(impact_amount, 4) as impact_amount, priority"

    @register(name, duck.query(f"select {columns} from recs", "rec", **PARTS,
                               found=found_sql(checks), recs=recs_sql(checks)))
    def run(spark, sf_dir):
        found = recommend.recommend(planned(spark, sf_dir), checks)
        return plain(found.selectExpr(*[
            "round(impact_amount, 4) as impact_amount" if c == "impact_amount" else c
            for c in found.columns]))


for _name, _checks in {
        "rec_savings": ["savings"], "rec_burn": ["burn"], "rec_overspend": ["overspend"],
        "rec_budget": ["budget"], "rec_subscriptions": ["subscriptions"],
        "rec_emergency": ["emergency"], "rec_food": ["food"], "rec_weekend": ["weekend"],
        "rec_income_var": ["income_var"], "rec_goals": ["goals"],
        "recommendations": recommend.ALL_CHECKS}.items():
    _query(_name, _checks)
