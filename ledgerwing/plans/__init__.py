"""Views of the driver's tables and the registered queries over them."""

from __future__ import annotations

from types import ModuleType


def load_all() -> ModuleType:
    """The catalog, with every query module imported."""
    from ledgerwing.plans import catalog, code_queries, decision_queries, event_queries, governance_queries, review_queries, source_queries, stream_queries, text_queries, trail_queries  # noqa: F401

    return catalog
