"""Rule-based assistant replies for a table of messages."""

from pyspark.sql import DataFrame, functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.functions.money import plain_number
from tallyspark.functions.text import contains_any, fill, first_matching


def reply(messages: DataFrame, summary: DataFrame) -> DataFrame:
    """Intent and reply of every message, from its user's period summary.

    ``messages`` holds user_id and message; a user without a summary counts as zeros.
    """
    facts = summary.select("user_id", *[
        F.col(c).cast("double").alias(c)
        for c in ("total_income", "total_expenses", "net_savings", "savings_rate_pct")])
    joined = (messages.join(facts, "user_id", "left")
              .fillna(0.0, ["total_income", "total_expenses", "net_savings",
                            "savings_rate_pct"]))
    income, expenses, savings = (F.col(c) for c in ("total_income", "total_expenses",
                                                    "net_savings"))
    goal = income * V.CHAT_GOAL_SHARE
    share, food = V.CHAT_FOOD_CUT
    values = {
        "rate": plain_number(F.col("savings_rate_pct"), 1),
        "food_cut": F.format_number(expenses * share * food, 0),
        "goal": F.format_number(goal, 0),
        "savings": F.format_number(savings, 0),
        "gap": F.format_number(F.greatest(F.lit(0.0), goal - savings), 0),
        "income": F.format_number(income, 0),
        "expenses": F.format_number(expenses, 0),
    }
    low = F.lower("message")
    *named, (default, _, default_text) = V.CHAT_INTENTS
    return (joined
            .withColumn("intent", first_matching(
                [(contains_any(low, words), F.lit(name)) for name, words, _ in named],
                F.lit(default)))
            .withColumn("reply", first_matching(
                [(F.col("intent") == name, fill(text, **values)) for name, _, text in named],
                fill(default_text, **values)))
            .select(*messages.columns, "intent", "reply"))
