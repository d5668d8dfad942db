"""Key hygiene shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the object id that stands for "no object".
ZERO_OID = "0" * 40


def clean_key(c: Column | str) -> Column:
    """The key as it is compared: without spaces at its ends and in lower case; null, blank text and the zero id
    are all null ("none")."""
    c = F.col(c) if isinstance(c, str) else c
    k = F.lower(F.trim(c))
    return F.when((k != "") & (k != ZERO_OID), k)


def clean_key_sql(expr: str) -> str:
    """The same in SQL text, for oracles."""
    return f"nullif(nullif(lower(trim({expr})), ''), repeat('0', 40))"
