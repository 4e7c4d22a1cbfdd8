"""Named queries, each with the DuckDB SQL of the same rows where SQL can say it."""

from slackline.catalog import evaluation, generate, graph, potential, ranking, search
from slackline.catalog.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "evaluation", "generate", "graph", "potential", "ranking", "search"]
