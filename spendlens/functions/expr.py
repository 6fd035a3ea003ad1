"""Small Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c: Column | str, default=0) -> Column:
    """Value or the default where it is missing."""
    return F.coalesce(col(c), F.lit(default))


def ratio(num: Column | str, den: Column | str, floor: float = 1.0) -> Column:
    """num / max(den, floor): the guard keeps ANSI division safe."""
    return col(num) / F.greatest(col(den).cast("double"), F.lit(float(floor)))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def epoch_us(ts: Column | str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Fractional days."""
    return (epoch_us(later) - epoch_us(earlier)) / F.lit(86400e6)


def hash_bucket(key: Column, n: int) -> Column:
    """Stable bucket in 0..n-1 out of an md5, equal on every engine."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % F.lit(n)


def words(text: Column | str) -> Column:
    """Whitespace tokens, empty ones dropped."""
    return F.filter(F.split(col(text), r"\s+"), lambda w: w != "")


def count_hits(text: Column, vocabulary: list[str]) -> Column:
    """How many distinct vocabulary entries occur as substrings."""
    hit = [F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in vocabulary]
    out = hit[0]
    for h in hit[1:]:
        out = out + h
    return out


def first_of(*rules: Column) -> Column:
    """Array of the rule results that are not NULL, in rule order."""
    return F.array_compact(F.array(*rules))


def literal_map(values: dict) -> Column:
    items: list[Column] = []
    for k, v in values.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def lookup(values: dict, key: Column, default=None) -> Column:
    got = F.try_element_at(literal_map(values), key)
    return got if default is None else F.coalesce(got, F.lit(default))


def fixed(x: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded half-even on the exact binary value."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """withColumns whose expressions are evaluated exactly once per row.

    A later filter or projection would otherwise inline a long expression at every use; the
    one-row generator is a boundary the optimizer does not substitute through.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
