"""Normalization of fields: flatten, rename, map, time and identity. Works on batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import first_entries, lenient_timestamp, let, log_id

#: Names under which a time is looked for at last.
TIME_FIELDS = ("timestamp", "@timestamp", "time", "ts", "_time")


OBJECT, LIST = "map<string,variant>", "array<variant>"


def plain_number(d: Column) -> Column:
    """A double in plain decimals: no exponent, no point without digits after it, and no more digits than tell it apart."""

    def placed(x: Column) -> Column:
        """x: m (digits with at most one point), e (exponent)"""
        whole = F.when(F.instr(x["m"], ".") > 0, F.instr(x["m"], ".") - 1).otherwise(F.length(x["m"]))
        cut = lambda y: F.when(y["p"] <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -y["p"]), y["d"])).when(y["p"] >= F.length(y["d"]), F.concat(y["d"], F.repeat(F.lit("0"), y["p"] - F.length(y["d"])))).otherwise(F.concat(F.substr(y["d"], F.lit(1), y["p"]), F.lit("."), F.substr(y["d"], y["p"] + 1)))
        return let(F.struct(F.replace(x["m"], F.lit("."), F.lit("")).alias("d"), (whole + x["e"]).alias("p")), cut)

    def parted(s: Column) -> Column:
        short = F.regexp_replace(F.split_part(s, F.lit("E"), F.lit(1)), r"\.0$", "")
        return let(F.struct(short.alias("m"), F.coalesce(F.split_part(s, F.lit("E"), F.lit(2)).try_cast("int"), F.lit(0)).alias("e")), placed)

    text = d.cast("string")
    return F.when(text.startswith("-"), F.concat(F.lit("-"), let(F.substr(text, F.lit(2)), parted))).otherwise(let(text, parted))


def plain_text(v: Column) -> Column:
    """A variant as the text of a field: strings as they are, numbers in plain decimals (read as doubles), null as '', objects and arrays as JSON."""

    def of(x: Column) -> Column:
        text = F.variant_get(x["v"], "$", "string")
        number = F.when(x["j"].rlike(r"^-?\d{1,15}$"), x["j"]).otherwise(plain_number(F.try_variant_get(x["v"], "$", "double")))
        return F.when(F.is_variant_null(x["v"]), "").when(x["j"].rlike("^[-0-9]"), number).otherwise(text)

    return F.coalesce(let(F.struct(v.alias("v"), F.to_json(v).alias("j")), of), F.lit(""))


def flattened(fields: Column, depth: int = 64, leaf: bool = False, most: int = 1000, items: int = 16, nested: Column | None = None) -> Column:
    """A struct (fields, truncated): objects become entries of their own, named by their path joined with _,
    or by their last name where that is unique. Dots in names become _.

    nested names the fields that were objects when they were read (nested_keys()); only these are opened. Without it, so is any text that is
    a JSON object. Within an object, arrays of objects are opened up to that number of items; longer, mixed
    and other arrays stay whole, as JSON text, and so does what is nested deeper than depth. Strings that hold JSON
    stay strings. Entries beyond the limit are dropped, in order. truncated says whether an
    entry was dropped or an object is too deep.
    """
    safe = lambda k: F.replace(k, F.lit("."), F.lit("_"))
    entry = lambda key, last, text, value: F.struct(key.alias("key"), last.alias("last"), text.alias("text"), value.alias("value"))
    no_text, no_value = F.lit(None).cast("string"), F.lit(None).cast("variant")
    is_object = lambda v: F.try_variant_get(v, "$", OBJECT).isNotNull()

    def opens(v: Column) -> Column:
        of_objects = lambda a: F.coalesce(a.isNotNull() & (F.size(a) > 0) & (F.size(a) <= items) & F.forall(a, is_object), F.lit(False))
        return is_object(v) | let(F.try_variant_get(v, "$", LIST), of_objects)

    def below(e: Column, v: Column, prefix: Column) -> Column:
        one = lambda x: let(opens(x["value"]), lambda o: entry(F.concat_ws("_", prefix, safe(x["key"])), safe(x["key"]), F.when(~o, plain_text(x["value"])), F.when(o, x["value"])))
        return F.transform(F.map_entries(F.try_variant_get(v, "$", OBJECT)), one)

    def expand(e: Column) -> Column:
        of_list = F.flatten(F.transform(F.try_variant_get(e["value"], "$", LIST), lambda v, i: below(e, v, F.concat_ws("_", e["key"], i.cast("string")))))
        return F.when(e["value"].isNull(), F.array(e)).when(is_object(e["value"]), below(e, e["value"], e["key"])).otherwise(of_list)

    def named(own: Column) -> Column:
        values = F.transform(own, lambda e: F.coalesce(e["text"], F.to_json(e["value"]), F.lit("")))
        if not leaf:
            return first_entries(F.transform(own, lambda e: e["key"]), values)
        alone = lambda lasts: F.transform(own, lambda e: F.when(F.size(F.filter(lasts, lambda x: x == e["last"])) == 1, e["last"]).otherwise(e["key"]))
        return first_entries(let(F.transform(own, lambda e: e["last"]), alone), values)

    def finished(own: Column) -> Column:
        deep = F.exists(own, lambda e: e["value"].isNotNull())
        return F.struct(let(F.slice(own, 1, most), named).alias("fields"), (deep | (F.size(own) > most)).alias("truncated"))

    def opened(own: Column) -> Column:
        """own with objects opened level by level, as many times as it has brackets, but depth times at most."""
        brackets = F.aggregate(own, F.lit(0), lambda n, e: n + F.coalesce(let(F.to_json(e["value"]), lambda t: F.length(t) - F.length(F.replace(t, F.lit("{"), F.lit("")))), F.lit(0)))
        level = lambda now, _: F.when(F.exists(now, lambda e: e["value"].isNotNull()), F.flatten(F.transform(now, expand))).otherwise(now)
        times = F.sequence(F.lit(1), F.greatest(F.least(brackets, F.lit(depth)), F.lit(1)))
        return F.when(F.exists(own, lambda e: e["value"].isNotNull()), F.aggregate(times, own, level)).otherwise(own)

    def first(e: Column) -> Column:
        """A field: to be opened if it is an object."""
        looks = e["value"].startswith("{")
        wanted = looks if nested is None else looks & F.coalesce(F.array_contains(nested, e["key"]), F.lit(False))
        value = F.when(wanted, F.try_parse_json(e["value"]))
        return let(F.when(is_object(value), value), lambda v: entry(safe(e["key"]), safe(e["key"]), F.when(v.isNull(), F.coalesce(e["value"], F.lit(""))), v))

    return let(let(F.transform(F.map_entries(fields), first), opened), finished)


def flatten(fields: Column, depth: int = 64, leaf: bool = False, most: int = 1000, items: int = 16, nested: Column | None = None) -> Column:
    """The fields of flattened()."""
    return flattened(fields, depth, leaf, most, items, nested)["fields"]


def snake(k: Column) -> Column:
    """A name in snake case: words begin where a small letter is followed by a large one and at the last large
    letter before a small one, in any script; - / and blanks separate words, but don't lead; underscores stay, also a leading one."""
    joined = F.regexp_replace(F.regexp_replace(k, r"^[- \t/]+", ""), r"[-_ \t/]+", "_")
    low = F.lower(F.regexp_replace(joined, r"(?<=\p{Ll})(?=\p{Lu})|(?<=[^_])(?=\p{Lu}\p{Ll})", "_"))
    return let(low, lambda n: F.when(F.rtrim(n, F.lit("_")) == "", n).otherwise(F.rtrim(n, F.lit("_"))))


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))


def _joined(k: Column, first: bool) -> Column:
    """Words between underscores in small letters, each but perhaps the first with a capital; a name without underscores only changes its first letter."""
    words = lambda ws: F.array_join(F.transform(ws, lambda w, i: F.when((i > 0) | F.lit(first), _capital(w)).otherwise(w)), "")
    one = F.concat((F.upper if first else F.lower)(F.substring(k, 1, 1)), F.substr(k, F.lit(2)))
    return F.when(F.contains(k, F.lit("_")), let(F.split(F.lower(k), "_"), words)).otherwise(one)


def case_name(k: Column, how: str) -> Column:
    return {
        "lowercase": lambda: F.lower(k),
        "uppercase": lambda: F.upper(k),
        "dedot": lambda: F.replace(k, F.lit("."), F.lit("_")),
        "snake": lambda: F.when(k.rlike(r"^[a-z0-9]+(_[a-z0-9]+)*$"), k).otherwise(snake(k)),
        "pascal": lambda: _joined(k, True),
        "camel": lambda: _joined(k, False),
    }[how]()


def rename_fields(fields: Column, how: str) -> Column:
    """Names in another case; where names meet, the first entry stays (trace_normalization() shows them all)."""
    return first_entries(F.transform(F.map_keys(fields), lambda k: case_name(k, how)), F.map_values(fields))


def map_fields(fields: Column, mapping: dict[str, list[str]]) -> Column:
    """{target: sources}: the first source with an entry moves to the target, its other sources go."""
    sources = [s for names in mapping.values() for s in names]
    if not sources:
        return fields
    targets = [(t, F.coalesce(*(F.try_element_at(fields, F.lit(s)) for s in names))) for t, names in mapping.items()]
    moved = F.map_filter(F.create_map(*(x for t, v in targets for x in (F.lit(t), v))), lambda _, v: v.isNotNull())
    rest = F.map_filter(fields, lambda k, _: ~k.isin(*sources))
    return F.map_zip_with(rest, moved, lambda _, a, b: F.coalesce(b, a))


def map_values(fields: Column, source: str, target: str, values: dict[str, str], default: str | None = None) -> Column:
    """Adds target by looking the source's value up; without a match the default, or nothing."""
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    found = F.coalesce(F.try_element_at(table, F.try_element_at(fields, F.lit(source))), F.lit(default).cast("string"))
    there = F.map_contains_key(fields, F.lit(source)) & found.isNotNull()
    return F.when(there, F.map_zip_with(fields, F.create_map(F.lit(target), found), lambda _, a, b: F.coalesce(b, a))).otherwise(fields)


def extract_timestamp(fields: Column, arrival: Column, candidates: tuple[str, ...] = ()) -> Column:
    """The first readable time among the candidates and the usual names, else the arrival."""
    return F.coalesce(*(lenient_timestamp(F.try_element_at(fields, F.lit(n))) for n in (*candidates, *TIME_FIELDS)), arrival)


def normalized(df: DataFrame, arrival: Column, tenant: Column, raw: Column, how: tuple[str, ...] = ("snake",), mapping: dict[str, list[str]] | None = None, normalizer: str = "default@1", time_fields: tuple[str, ...] = ()) -> DataFrame:
    """Rows with fields to log rows: timestamp, ingest_timestamp, log_id, tenant_id, normalizer, norm_log, fields, dates."""
    fields = F.col("fields")
    for h in how:
        fields = rename_fields(fields, h)
    out = df.withColumns({"_raw": raw, "_at": arrival, "_tenant": tenant}).withColumn("fields", map_fields(fields, mapping or {}))
    out = out.withColumn("timestamp", extract_timestamp(F.col("fields"), F.col("_at"), time_fields))
    return out.select("timestamp", F.col("_at").alias("ingest_timestamp"), log_id(F.col("timestamp"), F.col("_raw")).alias("log_id"), F.col("_tenant").alias("tenant_id"), F.lit(normalizer).alias("normalizer"), F.to_json("fields").alias("norm_log"), "fields", F.to_date("timestamp").alias("event_date"), F.to_date("_at").alias("ingest_date"))


def trace_normalization(df: DataFrame, key: str, before: str, mapping: dict[str, list[str]], values: list[tuple[str, str, dict[str, str], str | None]] = ()) -> DataFrame:
    """(key, field, value, source, alias, derived, override, collision): where each field after normalization comes from.

    before is the map of fields whose names are final but for the mapping {target: sources}; values are
    maps of values (source, target, {value: other}, default), applied in turn, as map_values() does. Unlike there, all fields that
    end in one name are kept, with collision; the first source by name counts where a value is looked up. alias is the
    source by which the mapping was found; derived fields have a value from a map, which replaced another one where override is set.
    All of it happens within a row: nothing is joined.
    """
    owner = {s: t for t, own in mapping.items() for s in own}
    table = F.create_map(*(F.lit(x) for pair in owner.items() for x in pair)) if owner else None
    nothing, no = F.lit(None).cast("string"), F.lit(False)
    field = lambda name, value, source, alias, derived, override: F.struct(name.alias("field"), value.alias("value"), source.alias("source"), alias.alias("alias"), derived.alias("derived"), override.alias("override"))

    def read(e: Column) -> Column:
        target = nothing if table is None else F.try_element_at(table, e["key"])
        return field(F.coalesce(target, e["key"]), e["value"], e["key"], F.when(target.isNotNull(), e["key"]), no, no)

    def mapped(own: Column, source: str, target: str, pairs: dict[str, str], default: str | None) -> Column:
        first = lambda name: F.try_element_at(F.filter(own, lambda f: f["field"] == name), F.lit(1))
        known = F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)) if pairs else F.from_json(F.lit("{}"), "map<string,string>")
        new = F.when(first(source).isNotNull(), F.coalesce(F.try_element_at(known, first(source)["value"]), F.lit(default or None).cast("string")))

        def put(x: Column) -> Column:
            over = F.transform(own, lambda f: F.when(f["field"] == target, field(f["field"], x["new"], f["source"], f["alias"], F.lit(True), F.lit(True))).otherwise(f))
            added = F.concat(own, F.array(field(F.lit(target), x["new"], F.lit(source), nothing, F.lit(True), no)))
            return F.when(x["new"].isNull() | x["old"]["value"].eqNullSafe(x["new"]), own).when(x["old"].isNotNull(), over).otherwise(added)

        return let(F.struct(new.alias("new"), first(target).alias("old")), put)

    step = lambda own, *how: let(own, lambda o: mapped(o, *how))
    own = F.transform(F.array_sort(F.map_entries(before)), read)
    for source, target, pairs, default in values:
        own = step(own, source, target, pairs, default)
    met = lambda o: F.transform(o, lambda f: f.withField("collision", f["source"].isNotNull() & (F.size(F.filter(o, lambda g: g["field"] == f["field"])) > 1)))
    return df.select(key, F.explode(let(own, met)).alias("_f")).select(key, "_f.*")
