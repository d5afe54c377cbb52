"""trackloom: a SQL warehouse surface and an interval-track algebra on PySpark."""

from trackloom.session import build_session, configure

__all__ = ["build_session", "configure"]
