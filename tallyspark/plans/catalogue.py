"""All registered queries."""

from tallyspark.plans import (queries_cleaning, queries_expressions, queries_forecast,  # noqa: F401
                              queries_health, queries_ledger, queries_recommend,
                              queries_recurring, queries_sources, queries_summary)
from tallyspark.plans.registry import ORACLES, QUERIES  # noqa: F401
