"""All registered queries."""

from edgeloom.plans import contract_queries, event_queries, graph_queries, history_queries, stream_queries, text_queries  # noqa: F401
from edgeloom.plans.registry import ORACLE, QUERIES  # noqa: F401
