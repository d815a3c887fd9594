"""Column expressions used throughout."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df; an error that lists the columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def finite_or(c: Column, default: float = 0.0) -> Column:
    return F.when(is_finite(c), c).otherwise(F.lit(default))


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or the default where b is zero."""
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def decibels(v: Column, eps: float = 1e-30) -> Column:
    return 10 * F.log10(F.greatest(v, F.lit(eps)))


def uniform(seed: int | Column, *ids: Column, turn: int = 0) -> Column:
    """A number in (0, 1) that depends on the seed and the ids only, not on partitions: 32 bits of an MD5 sum."""
    text = F.md5(F.concat_ws(":", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), *[i.cast("string") for i in ids]).cast("binary"))
    return (F.conv(F.substring(text, 1 + 8 * turn, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def gaussian(seed: int | Column, *ids: Column) -> Column:
    """A standard normal number by Box and Muller from two uniforms."""
    return F.sqrt(-2 * F.log(uniform(seed, *ids))) * F.cos(2 * F.pi() * uniform(seed, *ids, turn=1))


def mapped(c: Column, names: Mapping[str, str]) -> Column:
    """The display name of a trimmed lower-cased label, the label itself where there is none."""
    key = F.lower(F.trim(c))
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), key)


def first_max(values: Column) -> Column:
    """Index from 0 of the first largest element of an array."""
    return F.array_position(values, F.array_max(values)) - 1
