"""Money handling: minor-unit scaling, exact sums and safe division.

Money is carried as DECIMAL so that sums do not depend on partition order
(and a re-run after a lost executor gives the same digits).  Values are
exposed as DOUBLE only at the edge of each operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Divisors of the stored minor units by column-name suffix.
MINOR_UNIT_DIVISORS = {"_brl": 100, "_usdc": 1_000_000, "_usd_cents": 100}

# Decimal type used for per-row values that come out of a double division.
FINE = T.DecimalType(30, 10)
# Decimal type for aggregated money (keeps later additions inside 38 digits).
MONEY = T.DecimalType(28, 10)


def money(c) -> Column:
    return col(c).cast(MONEY)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dec(c, precision: int = 18, scale: int = 2) -> Column:
    return col(c).cast(T.DecimalType(precision, scale))


def fine(c) -> Column:
    """Round a per-row double to 10 decimals as DECIMAL so later sums are exact."""
    return col(c).cast(FINE)


def dbl(c) -> Column:
    return col(c).cast("double")


def safe_div(num, den) -> Column:
    """num / den as DOUBLE; null when den is 0 or null (never an error, never inf)."""
    return F.try_divide(dbl(num), dbl(den))


def mean_exact(c) -> Column:
    """Order-independent mean: exact DECIMAL sum, one double division."""
    c = col(c)
    return safe_div(F.sum(c), F.count(c))


def r6(c) -> Column:
    """Round a derived ratio for presentation (percentile, mean, share...)."""
    return F.round(dbl(c), 6)


def nz(c) -> Column:
    """Null-safe term: null -> 0."""
    return F.coalesce(col(c), F.lit(0))


def _scale(c: Column, divisor: int) -> Column:
    # Multiplying by the exact decimal reciprocal keeps the value exact.
    recip = {100: "0.01", 1_000_000: "0.000001"}[divisor]
    return c.try_cast(T.DecimalType(20, 0)) * F.expr(recip)


def scale_minor_units(df: DataFrame, divisors: dict[str, int] | None = None) -> DataFrame:
    """Divide every column whose name ends in a known suffix by its minor-unit divisor.

    ``*_brl`` is in centavos (/100), ``*_usdc`` in micros (/1e6).  Values that
    are not numbers become null; other columns pass through untouched.  One
    ``select`` built from the schema, so Catalyst still prunes unused columns.
    """
    divisors = divisors or {"_brl": 100, "_usdc": 1_000_000}
    cols = []
    for field in df.schema.fields:
        name = field.name
        div = next((d for sfx, d in divisors.items() if name.endswith(sfx)), None)
        if div is None:
            cols.append(F.col(name))
        else:
            cols.append(_scale(F.col(name), div).alias(name))
    return df.select(*cols)


def rnd(c, digits: int) -> Column:
    """Half-up presentation rounding done on the decimal value, so the result
    does not depend on the binary form of a double."""
    return F.round(fine(c), digits).cast("double")


def dlit(x) -> Column:
    """An exact DECIMAL literal for a Python number (0.3 stays 0.3)."""
    from decimal import Decimal
    return F.lit(Decimal(str(x)))
