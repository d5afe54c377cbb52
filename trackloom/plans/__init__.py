"""Named queries over the warehouse tables, each with its SQL counterpart."""

from trackloom.plans.registry import Query, all_queries

__all__ = ["Query", "all_queries"]
