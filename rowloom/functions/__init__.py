"""Column expressions as SQL text: missing values, arithmetic, lookups, names.

A feature table has hundreds of expressions. Building each from Column objects
costs several calls into the JVM per operator; as text a whole projection is
one call, and Catalyst sees the same plan.
"""

from rowloom.functions.columns import (
    name_of,
    numeric_columns,
    operand,
    require_columns,
    require_unique,
    string_columns,
    told_apart,
    value_of,
)
from rowloom.functions.mapping import map_values
from rowloom.functions.nulls import (
    fill_missing,
    flag,
    inf_to,
    nan_to_null,
    null_above,
    null_if,
    unless_equal,
    zero_fill,
)
from rowloom.functions.numeric import (
    class_of,
    half_even,
    half_up,
    ieee_div,
    safe_ratio,
    to_float32,
)

__all__ = [
    "class_of",
    "fill_missing",
    "flag",
    "half_even",
    "half_up",
    "ieee_div",
    "inf_to",
    "map_values",
    "name_of",
    "nan_to_null",
    "null_above",
    "null_if",
    "numeric_columns",
    "operand",
    "require_columns",
    "require_unique",
    "safe_ratio",
    "string_columns",
    "told_apart",
    "to_float32",
    "unless_equal",
    "value_of",
    "zero_fill",
]
