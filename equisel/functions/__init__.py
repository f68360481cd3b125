"""Column-expression helpers shared by all operators."""

from equisel.functions.exprs import (
    hash32,
    unit_hash,
    safe_div,
    nan_to_null,
    is_missing,
    r6,
)
from equisel.functions.prefix import running_totals

__all__ = ["hash32", "unit_hash", "safe_div", "nan_to_null", "is_missing", "r6", "running_totals"]
