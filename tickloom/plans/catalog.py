"""All registered queries."""

from tickloom.plans import (  # noqa: F401
    bar_queries, evaluation_queries, model_queries, monitoring_queries, option_queries,
)
from tickloom.plans.registry import ORACLE, QUERIES  # noqa: F401
