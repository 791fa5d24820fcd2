from __future__ import annotations


def load_all():
    """Import every query module once and return (queries, statements)."""
    import importlib

    from . import registry

    for m in ("q_passes", "q_tables", "q_sources", "q_code", "q_rules"):
        try:
            importlib.import_module(f".{m}", __name__)
        except ModuleNotFoundError as e:
            if m not in str(e):
                raise
    return registry.QUERIES, registry.ORACLES
