"""Small expression helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def one_row(stats: DataFrame) -> Column:
    """A one-row aggregate as a struct value usable in any projection (scalar subquery)."""
    return stats.select(F.struct(*stats.columns)).scalar()


def with_scalars(df: DataFrame, stats: DataFrame, name: str = "_s") -> DataFrame:
    """Attach the single row of ``stats`` to every row of ``df`` as struct ``name``."""
    return df.withColumn(name, one_row(stats))


def safe_div(a, b, fallback=None) -> Column:
    """``a / b`` with ``fallback`` (NULL by default) where ``b`` is zero."""
    a, b = _col(a), _col(b)
    return F.when(b != 0, a / b).otherwise(F.lit(fallback))


def near_zero_div(a, b, fallback=0.0) -> Column:
    """``a / b`` with ``fallback`` where ``|b|`` is at most 1e-9."""
    a, b = _col(a), _col(b)
    return F.when(F.abs(b) > 1e-9, a / b).otherwise(F.lit(fallback))


def _col(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def rnd(c, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(_col(c).cast("double"), digits) + F.lit(0.0)


def half_even(c, digits: int) -> Column:
    """Decimal rounding the way array libraries do it: scale, round half to even, scale back."""
    scale = F.lit(float(10**digits))
    return F.rint(_col(c) * scale) / scale


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def sample_skew(x: Column) -> Column:
    """Bias-corrected skewness (NULL below three values or without spread)."""
    n = F.count(x).cast("double")
    return F.when(
        (n > 2) & (F.stddev_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    )


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis (NULL below four values or without spread)."""
    n = F.count(x).cast("double")
    return F.when(
        (n > 3) & (F.stddev_pop(x) > 0),
        (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6),
    )


def no_nan(c: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(c), c)


def require(ok: Column, message: str, value: Column) -> Column:
    """``value`` where ``ok`` holds, a query error otherwise."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


# Rational approximation of the normal distribution function (West 2005).
_CDF_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
_CDF_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
               296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf_expr(x: Column) -> Column:
    """Standard normal distribution function as plain (code-generated) arithmetic."""
    a = F.abs(x)
    bell = F.exp(-a * a / 2)
    near = bell * _horner(a, _CDF_TOP) / _horner(a, _CDF_BOTTOM)
    frac = a + 0.65
    for k in (4, 3, 2, 1):
        frac = a + F.lit(float(k)) / frac
    tail = F.when(a < 7.07106781186547, near).otherwise(bell / frac / 2.506628274631)
    return F.when(x > 0, 1 - tail).otherwise(tail)
