"""All queries by name, and the DuckDB SQL of those that SQL can express."""

from concord.plans import q_api, q_dedup, q_extract, q_merge, q_pipelines, q_rank, q_rules, q_text, q_times  # noqa: F401
from concord.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
