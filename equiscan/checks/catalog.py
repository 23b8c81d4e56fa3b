"""All registered queries."""

from equiscan.checks import function_queries, job_queries, portfolio_queries, score_queries  # noqa: F401
from equiscan.checks.registry import REGISTRY, oracle, spark_query  # noqa: F401
