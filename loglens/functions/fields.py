"""Field access and coercion over rows whose open part is a map of strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, also where it is used within lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def first_entries(names: Column, values: Column) -> Column:
    """A map from two arrays; of equal names, the first entry stays."""

    def chosen(z: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(z["n"])), lambda i: F.array_position(z["n"], F.element_at(z["n"], i)) == i)
        return let(at, lambda ix: F.map_from_arrays(F.transform(ix, lambda i: F.element_at(z["n"], i)), F.transform(ix, lambda i: F.element_at(z["v"], i))))

    empty = F.from_json(F.lit("{}"), "map<string,string>")
    alone = lambda z: F.size(F.array_distinct(z["n"])) == F.size(z["n"])
    return let(F.struct(names.alias("n"), values.alias("v")), lambda z: F.when(F.size(z["n"]) == 0, empty).when(alone(z), F.map_from_arrays(z["n"], z["v"])).otherwise(chosen(z)))


def field(df: DataFrame, name: str, fields: str = "fields") -> Column:
    """The column of that name, else the entry of the map of fields, else a null string."""
    if name in df.columns:
        return F.col(f"`{name}`")
    if fields in df.columns:
        return F.try_element_at(F.col(fields), F.lit(name))
    return F.lit(None).cast("string")


def num0(c: Column) -> Column:
    """A number for comparisons: 0 where there is none."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def numn(c: Column) -> Column:
    """A number for aggregates and arithmetic: null where there is none."""
    return c.try_cast("double")


def lenient_timestamp(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss Z")) -> Column:
    """Seconds, milliseconds, microseconds or nanoseconds by their number of digits, else ISO or a format."""
    text = F.trim(c.cast("string"))
    whole = text.try_cast("long")
    epoch = (
        F.when(text.rlike(r"^\d{19}$"), F.timestamp_micros((whole / 1000).cast("long")))
        .when(text.rlike(r"^\d{16}$"), F.timestamp_micros(whole))
        .when(text.rlike(r"^\d{13}$"), F.timestamp_millis(whole))
        .when(text.rlike(r"^\d{9,10}$"), F.timestamp_seconds(whole))
    )
    return F.coalesce(epoch, F.when(~text.rlike(r"^\d+$"), F.coalesce(text.try_cast("timestamp"), *(F.try_to_timestamp(text, F.lit(f)) for f in formats))))


def log_id(when: Column, raw: Column) -> Column:
    """The first 16 bytes of a digest of the time in nanoseconds and the raw text, as hex."""
    return F.substring(F.sha2(F.concat_ws(":", (F.unix_micros(when) * 1000).cast("string"), raw), 256), 1, 32)
