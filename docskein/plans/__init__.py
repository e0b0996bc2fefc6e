"""Composed plans and the query registry."""

from importlib import import_module, util

MODULES = ("q_catalog", "q_metrics", "q_filters", "q_ingest", "q_pii", "q_understand", "q_search", "q_context",
           "q_tickets", "q_streams")


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        if util.find_spec(f"docskein.plans.{name}") is not None:
            import_module(f"docskein.plans.{name}")
