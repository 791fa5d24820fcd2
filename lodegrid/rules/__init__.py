from .catalog import all_rules, catalog_frame, detectors, rules_for
from .engine import evaluate, parse

__all__ = ["all_rules", "catalog_frame", "detectors", "evaluate", "parse", "rules_for"]
