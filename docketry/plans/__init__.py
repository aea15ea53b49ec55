"""End-to-end plans: inputs derived from the given tables, the registered queries, their SQL counterparts."""

from importlib import import_module

_MODULES = ("text_queries", "citation_queries", "intake_queries", "rule_queries", "search_queries", "evaluation_queries",
            "verification_queries", "flow_queries")


def load_all() -> None:
    """Import the modules that register queries."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
