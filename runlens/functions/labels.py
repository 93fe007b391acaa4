"""Display labels for report cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions._col import col
from runlens.functions.numeric import num_text

# Fixed display values of the report tables.
DASH = "—"
CHECK = "✅"
CROSS = "❌"


def tristate_label(c: Column | str, true_text: str, false_text: str,
                   null_text: str = DASH) -> Column:
    """true / false / NULL -> three labels (e.g. Detected / Clean / —)."""
    c = col(c)
    return (F.when(c, F.lit(true_text))
            .when(~c, F.lit(false_text))
            .otherwise(F.lit(null_text)))


def value_label(c: Column | str, unit: str = "ms", places: int = 0,
                null_text: Column | str = DASH) -> Column:
    """Number plus unit ('1441ms', '62.8s'); NULL and NaN get ``null_text``."""
    c = col(c)
    fallback = null_text if isinstance(null_text, Column) else F.lit(null_text)
    return F.coalesce(F.concat(num_text(c, places), F.lit(unit)), fallback)


def emphasise_nonzero(n: Column | str) -> Column:
    """'**n**' when n > 0, else '0' (NULL counts as 0)."""
    n = F.coalesce(col(n), F.lit(0))
    return F.when(n > 0, F.concat(F.lit("**"), n.cast("string"), F.lit("**"))).otherwise(F.lit("0"))
