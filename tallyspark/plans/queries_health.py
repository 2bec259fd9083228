"""Queries over the health score."""

from pyspark.sql import functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.operators import health
from tallyspark.operators.features import DAILY_SUMS, DEBIT_SLUGS, user_features
from tallyspark.plans import duck, frames
from tallyspark.plans.registry import register

_ESSENTIAL = ", ".join(duck.lit(c) for c in V.ESSENTIAL_CATEGORIES)


def _sum(condition: str) -> str:
    return f"coalesce(sum(amount) filter ({condition}), 0)"


def features_sql(source: str) -> str:
    """Feature row per user: one plain aggregate, weeks and months each on their own."""
    spends = ", ".join(f"{_sum(f'''tx_type = 'debit' and category = '{c}' ''')} as spend_{c}"
                       for c in DEBIT_SLUGS)
    out, groceries = "|".join(V.EAT_OUT_WORDS), "|".join(V.GROCERY_WORDS)
    food = "tx_type = 'debit' and category = 'food' and regexp_matches(lower(description), '{0}')"
    return f"""
        select t.*, income - expenses as net,
               cast(case when income > 0 then cast(income - expenses as double)
                         / cast(income as double) else 0 end as double) as savings_rate,
               {duck.rounded("cast(essentials as double) "
                             "/ greatest(1, (last_date - first_date) / 30.0)", 2)}
                   as monthly_essentials,
               coalesce(n_weeks, 0) as n_weeks, weekly_cv, coalesce(n_months, 0) as n_months,
               monthly_cv, lowest_month
        from (select user_id, {_sum("tx_type = 'credit'")} as income,
                     {_sum("tx_type = 'debit'")} as expenses, {spends},
                     {_sum(f"tx_type = 'debit' and category in ({_ESSENTIAL})")} as essentials,
                     {_sum("tx_type = 'debit' and isodow(tx_date) >= 6")} as weekend_spend,
                     {_sum(food.format(out))} as eat_out,
                     {_sum(food.format(groceries))} as groceries,
                     count(*) filter (tx_type = 'credit') as n_credits,
                     count(*) filter (tx_type = 'debit') as n_debits,
                     min(tx_date) as first_date, max(tx_date) as last_date
              from {source} group by user_id) t
        left join (select user_id, count(*) as n_weeks,
                          stddev_samp(cast(s as double)) / avg(cast(s as double)) as weekly_cv
                   from (select user_id, sum(amount) as s from {source}
                         where tx_type = 'debit'
                         group by user_id, date_trunc('week', tx_date)) group by user_id) w
          on t.user_id = w.user_id
        left join (select user_id, count(*) as n_months, min(s) as lowest_month,
                          stddev_samp(cast(s as double)) / avg(cast(s as double)) as monthly_cv
                   from (select user_id, sum(amount) as s from {source}
                         where tx_type = 'credit'
                         group by user_id, date_trunc('month', tx_date)) group by user_id) m
          on t.user_id = m.user_id"""


DIMENSIONS = """
    select *,
      case when savings_rate >= 0.30 then 100.0::double
           when savings_rate >= 0.20 then 80 + (savings_rate - 0.20::double) / 0.10::double * 20
           when savings_rate >= 0.10 then 50 + (savings_rate - 0.10::double) / 0.10::double * 30
           when savings_rate >= 0 then savings_rate / 0.10::double * 50 else 0 end
        as savings_rate_score,
      case when n_debits < 4 then 70.0::double when weekly_cv is null then 0
           else cast(format('{:.1f}', cast(case when weekly_cv <= 0.15 then 100
                when weekly_cv <= 0.30 then 80 - (weekly_cv - 0.15::double) / 0.15::double * 20
                when weekly_cv <= 0.50 then 60 - (weekly_cv - 0.30::double) / 0.20::double * 30
                else greatest(0, 30 - (weekly_cv - 0.50::double) * 60) end
                as double)) as double) end
        as expense_stability_score,
      case when n_debits < 4 then 0.0::double else
           cast(format('{:.4f}', cast(weekly_cv as double)) as double) end as expense_cv,
      case when debt_ratio = 0 then 100.0::double when debt_ratio <= 0.15 then 90
           when debt_ratio <= 0.30 then 70 - (debt_ratio - 0.15::double) / 0.15::double * 20
           when debt_ratio <= 0.50 then 50 - (debt_ratio - 0.30::double) / 0.20::double * 30
           else greatest(0, 20 - (debt_ratio - 0.50::double) * 40) end as debt_ratio_score,
      case when emergency_months >= 6 then 100.0::double
           when emergency_months >= 3 then 60 + (emergency_months - 3) / 3 * 40
           when emergency_months >= 1 then 25 + (emergency_months - 1) / 2 * 35
           else greatest(0, emergency_months * 25) end as emergency_coverage_score,
      case when n_credits < 2 or n_months < 2 then 70.0::double
           else cast(format('{:.1f}', cast(case when monthly_cv <= 0.10 then 100
                when monthly_cv <= 0.25 then 85
                when monthly_cv <= 0.40 then 65
                else greatest(30, 65 - (monthly_cv - 0.40::double) * 100) end
                as double)) as double) end
        as income_stability_score,
      case when n_credits < 2 or n_months < 2 then 0.0::double else
           cast(format('{:.4f}', cast(monthly_cv as double)) as double) end
        as income_cv
    from (select f.*, coalesce(cast(p.emergency_fund as double), 0) as emergency_fund,
                 case when income > 0 and coalesce(p.total_debt, 0) > 0
                      then cast(p.total_debt as double) / cast(income as double)
                      else 0.0::double end as debt_ratio,
                 case when monthly_essentials > 0
                      then coalesce(cast(p.emergency_fund as double), 0) / monthly_essentials
                      else 0.0::double end as emergency_months
          from features f left join profiles p on f.user_id = p.user_id)"""


def _parts(source: str) -> dict[str, str]:
    return {"profiles": frames.profiles_sql(), "features": features_sql(source),
            "dims": DIMENSIONS}


_FEATURES = [*DAILY_SUMS, "n_credits", "n_debits", "n_weeks", "n_months", "lowest_month", "net",
             "monthly_essentials"]


@register("user_features", duck.query(
    "select user_id, " + ", ".join(f"cast({c} as double) as {c}" for c in _FEATURES)
    + """, first_date, last_date, round(savings_rate, 6) as savings_rate,
         round(weekly_cv, 6) as weekly_cv, round(monthly_cv, 6) as monthly_cv
         from features""", "lab", features=features_sql("lab")))
def features_query(spark, sf_dir):
    rows = user_features(frames.labelled(spark, sf_dir))
    return rows.select("user_id", *[F.col(c).cast("double").alias(c) for c in _FEATURES],
                       "first_date", "last_date",
                       *[F.round(c, 6).alias(c)
                         for c in ("savings_rate", "weekly_cv", "monthly_cv")])


def _dimensions(spark, sf_dir, events=False):
    tx = (frames.event_labelled if events else frames.labelled)(spark, sf_dir)
    return health.health_dimensions(user_features(tx), frames.profiles(spark, sf_dir))


def _dimension_query(name, value, score, events=False):
    base = "ev_lab" if events else "lab"

    @register(name, duck.query(
        f"select user_id, round({value}, 6) as value, round({score}, 6) as score from dims",
        base, **_parts(base)))
    def run(spark, sf_dir):
        return _dimensions(spark, sf_dir, events).select(
            "user_id", F.round(value, 6).alias("value"), F.round(score, 6).alias("score"))


_dimension_query("health_savings", "savings_rate", "savings_rate_score")
_dimension_query("health_expense_stability", "expense_cv", "expense_stability_score", True)
_dimension_query("health_debt", "debt_ratio", "debt_ratio_score")
_dimension_query("health_emergency", "emergency_months", "emergency_coverage_score")
_dimension_query("health_income_stability", "income_cv", "income_stability_score")

_WEIGHTED = " + ".join(["0.0::double"] + [f"{n}_score * {w}::double"
                                          for n, w in V.HEALTH_WEIGHTS])
_GRADE = duck.case([(f"score >= {limit}", duck.lit(label)) for limit, label in V.GRADES[:-1]],
                   duck.lit(V.GRADES[-1][1]))
_I = V.INSIGHTS
SCORED = f"""
    select *, {_GRADE} as grade,
        coalesce(nullif(concat_ws(' | ',
            case when savings_rate < 0.10 then {duck.lit(_I['savings_critical'])}
                 when savings_rate < 0.20 then {duck.lit(_I['savings_low'])} end,
            case when expense_cv > 0.4 then {duck.lit(_I['expense_swings'])} end,
            case when debt_ratio > 0.40 then {duck.lit(_I['debt'])} end,
            case when emergency_months < 3 then
                 {duck.fill(_I['emergency'], months=duck.fixed('emergency_months', 1))} end,
            case when income_cv > 0.3 then {duck.lit(_I['income_swings'])} end), ''),
            {duck.lit(_I['default'])}) as insights
    from (select *, greatest(0, least(100, cast(round_even({_WEIGHTED}, 0) as int))) as score
          from dims)"""


def _score_query(name, events):
    base = "ev_lab" if events else "lab"

    @register(name, duck.query(
        "select user_id, score, grade, insights from scored", base, **_parts(base),
        scored=SCORED))
    def run(spark, sf_dir):
        return health.health_score(_dimensions(spark, sf_dir, events)).select(
            "user_id", "score", "grade", F.array_join("insights", " | ").alias("insights"))


_score_query("health_score", False)
_score_query("health_score_events", True)

_SHOWN = {"savings_rate": ("savings_rate", 100, "{x}% savings rate", 1),
          "expense_stability": ("expense_cv", 100, "CV={x}% expense variability", 0),
          "debt_ratio": ("debt_ratio", 100, "{x}% debt-to-income", 0),
          "emergency_coverage": ("emergency_months", 1, "{x} months covered", 1),
          "income_stability": ("income_cv", 100, "CV={x}% income variability", 0)}


def _number(name: str) -> str:
    column, scale, _, places = _SHOWN[name]
    return f"coalesce({duck.fixed(f'{column} * {scale}', places)}, 'nan')"


@register("health_breakdown", duck.query(" union all ".join(
    f"select user_id, '{name}' as dimension, round({name}_score, 6) as score, "
    f"{weight}::double as weight, "
    f"{duck.rounded(f'{_SHOWN[name][0]} * {_SHOWN[name][1]}', 1)} as value, "
    f"{duck.fill(_SHOWN[name][2], x=_number(name))}"
    f" as label from dims" for name, weight in V.HEALTH_WEIGHTS), "lab", **_parts("lab")))
def health_breakdown(spark, sf_dir):
    scored = health.health_score(_dimensions(spark, sf_dir))
    return (scored.select("user_id", F.explode("breakdown").alias("dimension", "d"))
            .select("user_id", "dimension", F.round("d.score", 6).alias("score"), "d.weight",
                    "d.value", "d.label"))
