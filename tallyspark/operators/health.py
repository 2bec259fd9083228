"""Financial health score (0-100) from a user's feature row."""

from pyspark.sql import DataFrame, functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.functions.sqltext import case, fill, plain_number, quoted, rounded

#: Score of each dimension as SQL over the feature row.
SCORES = {
    "savings_rate": """
        case when savings_rate >= 0.30D then 100D
             when savings_rate >= 0.20D then 80 + (savings_rate - 0.20D) / 0.10D * 20
             when savings_rate >= 0.10D then 50 + (savings_rate - 0.10D) / 0.10D * 30
             when savings_rate >= 0 then savings_rate / 0.10D * 50
             else 0D end""",
    # Neutral below four debits; 0 where a single week leaves no spread.
    "expense_stability": f"""
        case when n_debits < 4 then 70D
             when weekly_cv is null then 0D
             else {rounded("""case when weekly_cv <= 0.15D then 100D
                  when weekly_cv <= 0.30D then 80 - (weekly_cv - 0.15D) / 0.15D * 20
                  when weekly_cv <= 0.50D then 60 - (weekly_cv - 0.30D) / 0.20D * 30
                  else greatest(0D, 30 - (weekly_cv - 0.50D) * 60) end""", 1)} end""",
    "debt_ratio": """
        case when debt_ratio = 0 then 100D
             when debt_ratio <= 0.15D then 90D
             when debt_ratio <= 0.30D then 70 - (debt_ratio - 0.15D) / 0.15D * 20
             when debt_ratio <= 0.50D then 50 - (debt_ratio - 0.30D) / 0.20D * 30
             else greatest(0D, 20 - (debt_ratio - 0.50D) * 40) end""",
    "emergency_coverage": """
        case when emergency_months >= 6 then 100D
             when emergency_months >= 3 then 60 + (emergency_months - 3) / 3 * 40
             when emergency_months >= 1 then 25 + (emergency_months - 1) / 2 * 35
             else greatest(0D, emergency_months * 25) end""",
    # Neutral below two credits or two months with credits.
    "income_stability": f"""
        case when n_credits < 2 or n_months < 2 then 70D
             else {rounded("""case when monthly_cv <= 0.10D then 100D
                  when monthly_cv <= 0.25D then 85D
                  when monthly_cv <= 0.40D then 65D
                  else greatest(30D, 65 - (monthly_cv - 0.40D) * 100) end""", 1)} end""",
}

#: Column, scale, label and decimals under which a dimension is shown.
NO_NUMBER = quoted("nan")
SHOWN = {
    "savings_rate": ("savings_rate", 100, "{x}% savings rate", 1),
    "expense_stability": ("expense_cv", 100, "CV={x}% expense variability", 0),
    "debt_ratio": ("debt_ratio", 100, "{x}% debt-to-income", 0),
    "emergency_coverage": ("emergency_months", 1, "{x} months covered", 1),
    "income_stability": ("income_cv", 100, "CV={x}% income variability", 0),
}


def health_dimensions(features: DataFrame, profiles: DataFrame) -> DataFrame:
    """Value and score of the five dimensions, one row per user.

    ``profiles`` holds user_id, emergency_fund and total_debt; a missing profile
    counts as no fund and no debt.
    """
    joined = features.join(
        profiles.selectExpr("user_id", "cast(emergency_fund as double) as emergency_fund",
                            "cast(total_debt as double) as total_debt"),
        "user_id", "left").fillna(0.0, ["emergency_fund", "total_debt"])
    values = joined.selectExpr(
        "*",
        "case when income > 0 and total_debt > 0 "
        "then try_divide(total_debt, cast(income as double)) else 0D end as debt_ratio",
        "case when monthly_essentials > 0 "
        "then try_divide(emergency_fund, monthly_essentials) else 0D end as emergency_months",
        f"case when n_debits < 4 then 0D else {rounded('weekly_cv', 4)} end as expense_cv",
        f"case when n_credits < 2 or n_months < 2 then 0D else {rounded('monthly_cv', 4)} end "
        "as income_cv")
    return values.selectExpr("*", *[f"{sql} as {name}_score" for name, sql in SCORES.items()])


def _insights() -> str:
    texts = V.INSIGHTS
    found = [
        case([("savings_rate < 0.10D", quoted(texts["savings_critical"])),
              ("savings_rate < 0.20D", quoted(texts["savings_low"]))]),
        case([("expense_cv > 0.4D", quoted(texts["expense_swings"]))]),
        case([("debt_ratio > 0.40D", quoted(texts["debt"]))]),
        case([("emergency_months < 3", fill(
            texts["emergency"], months=plain_number("emergency_months", 1)))]),
        case([("income_cv > 0.3D", quoted(texts["income_swings"]))]),
    ]
    return "array_compact(array(" + ", ".join(found) + "))"


def _breakdown() -> str:
    entries = []
    for name, weight in V.HEALTH_WEIGHTS:
        column, scale, label, places = SHOWN[name]
        value = f"{column} * {scale}"
        entries.append(
            f"'{name}', named_struct('score', {name}_score, 'weight', {weight}D, "
            f"'value', {rounded(value, 1)}, 'label', "
            # A spread that doesn't exist is shown as not a number.
            f"{fill(label, x=f'coalesce({plain_number(value, places)}, {NO_NUMBER})')})")
    return "map(" + ", ".join(entries) + ")"


def health_score(dimensions: DataFrame) -> DataFrame:
    """Composite score, grade, insights and a breakdown map."""
    weighted = "0D" + "".join(f" + {name}_score * {weight}D"
                              for name, weight in V.HEALTH_WEIGHTS)
    grade = case([(f"score >= {limit}", quoted(label)) for limit, label in V.GRADES[:-1]],
                 quoted(V.GRADES[-1][1]))
    scored = dimensions.selectExpr(
        "*", f"greatest(0, least(100, cast(bround({weighted}, 0) as int))) as score",
        f"{_insights()} as _found", f"{_breakdown()} as breakdown")
    return scored.selectExpr(
        "*", f"{grade} as grade",
        f"case when size(_found) > 0 then _found "
        f"else array({quoted(V.INSIGHTS['default'])}) end as insights").drop("_found")


def score_users(features: DataFrame, profiles: DataFrame) -> DataFrame:
    """Health score straight from feature rows."""
    return health_score(health_dimensions(features, profiles)).select(
        "user_id", "score", "grade", "breakdown", F.col("insights"))
