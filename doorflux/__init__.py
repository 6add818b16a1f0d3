"""Door-counter visitor analytics on Spark DataFrames."""

from doorflux.config import BusinessRules, CleaningRule, TableSpec, default_specs
from doorflux.functions.periods import Request
from doorflux.operators.normalize import Traffic

__all__ = [
    "BusinessRules",
    "CleaningRule",
    "Request",
    "TableSpec",
    "Traffic",
    "default_specs",
]
