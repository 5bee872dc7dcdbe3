"""Log formats to rows with a map of string fields. The parsers take any DataFrame with a text column,
batch or stream; the readers add the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fields import first_entries, let
from ..operators.enrich import cidr_ranges, load_dictionary
from .normalize import OBJECT, plain_text

# Names of syslog facilities and severities.
FACILITIES = ("kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "audit", "alert", "clock", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7")
LEVELS = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")


def string_map(text: Column) -> Column:
    """A JSON object as a flat map: numbers in plain decimals, nested values as JSON text, null as '', null for what is no object.

    Numbers are read as doubles. What isn't quite JSON, or names a field twice, is read without types.
    """
    typed = lambda m: F.transform_values(m, lambda _, v: plain_text(v))
    loose = let(F.from_json(text, "map<string,string>"), lambda m: first_entries(F.reverse(F.map_keys(m)), F.transform(F.reverse(F.map_values(m)), lambda v: F.coalesce(v, F.lit("")))))
    return F.coalesce(let(F.try_variant_get(F.try_parse_json(text), "$", OBJECT), typed), loose)


def nested_keys(text: Column) -> Column:
    """The names of a JSON object's fields that are objects: those that flatten() may open."""
    inner = F.map_filter(F.try_variant_get(F.try_parse_json(text), "$", OBJECT), lambda _, v: F.try_variant_get(v, "$", OBJECT).isNotNull())
    return F.map_keys(inner)


def parse_json(df: DataFrame, text: str = "value", nested: str | None = None) -> DataFrame:
    """Adds fields, and under the name nested, if one is given, which of them were objects. An array gives a row for each object in it; text that is no JSON object is skipped."""
    many = F.from_json(F.col(text), "array<string>")
    each = F.when(F.ltrim(F.col(text)).startswith("["), many).otherwise(F.array(F.col(text)))
    own = df.withColumn("_one", F.explode(each)).withColumn("fields", string_map(F.col("_one")))
    if nested:
        own = own.withColumn(nested, nested_keys(F.col("_one")))
    return own.drop("_one").where(F.col("fields").isNotNull() & (F.size("fields") > 0))


def parse_kv(df: DataFrame, text: str = "value") -> DataFrame:
    """Adds fields from k=v, k="a b" and k='c'; other tokens are skipped, of equal keys the last wins."""
    pattern = r"""([^\s=]+)=("[^"]*"|'[^']*'|\S*)"""
    keys = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    values = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2)), lambda v: F.regexp_replace(v, r"""^(["'])(.*)\1$""", "$2"))
    fields = first_entries(F.reverse(keys), F.reverse(values))
    return df.withColumn("fields", fields).where(F.size("fields") > 0)


def parse_syslog(df: DataFrame, text: str = "value") -> DataFrame:
    """Adds fields from RFC 5424, else RFC 3164, else the whole line as message.

    priority, facility and severity are numbers, with facility_name and severity_name beside them; empty
    fields and "-" are left out. A priority above 191 makes the line a message.
    """
    line = F.col(text)
    new = r"(?s)^<(\d{1,3})>(\d)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(-|(?:\[(?:[^\]\\]|\\.)*\])+)?\s*(.*)$"
    old = r"(?s)^<(\d{1,3})>([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(?:([^:\[]*)(?:\[([^:]*)\])?: ?)?(.*)$"
    pri = F.regexp_extract(line, r"^<(\d{1,3})>", 1).try_cast("int")
    good = F.coalesce(pri < 192, F.lit(False))
    is_new, is_old = good & line.rlike(new), good & line.rlike(old)
    some = is_new | is_old
    number = lambda n: F.when(some, n.cast("string")).otherwise("")
    name = lambda names, i: F.when(some, F.element_at(F.array(*(F.lit(n) for n in names)), (i + 1).cast("int"))).otherwise("")
    pick = lambda a, b: F.when(is_new, F.regexp_extract(line, new, a) if a else F.lit("")).when(is_old, F.regexp_extract(line, old, b) if b else F.lit("")).otherwise("")
    entries = {
        "priority": number(pri),
        "facility": number(F.floor(pri / 8)),
        "severity": number(pri % 8),
        "facility_name": name(FACILITIES, F.floor(pri / 8)),
        "severity_name": name(LEVELS, pri % 8),
        "version": pick(2, 0),
        "timestamp": pick(3, 2),
        "hostname": pick(4, 3),
        "appname": pick(5, 4),
        "procid": pick(6, 5),
        "msgid": pick(7, 0),
        "structured_data": pick(8, 0),
        "message": F.when(is_new, F.regexp_extract(line, new, 9)).when(is_old, F.regexp_extract(line, old, 6)).otherwise(line),
    }
    whole = F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), v)))
    return df.withColumn("fields", F.map_filter(whole, lambda k, v: ((k == "message") | (v != "-")) & (v != ""))).where(line.isNotNull() & (F.trim(line) != ""))


def pair_bulk(lines: DataFrame, body: list[str], order: list[str], line: str = "value") -> DataFrame:
    """(fields, action): a row for each document of a bulk body, given its lines and their order.

    A line that is an object with an index or create object is an action, and the line after it is its
    document, whatever that holds; any other line (delete, update and what follows them, blanks) is
    passed over. So what a line is depends on how many lines that look like actions stand right before it:
    after an odd number it is a document. Lines of a body are one sorted group, which spills.
    """
    looks = F.from_json(F.col(line), "index map<string,string>, create map<string,string>")
    own = lines.withColumn("_a", looks).withColumn("_action", F.when(F.col("_a.index").isNotNull(), "index").when(F.col("_a.create").isNotNull(), "create")).drop("_a")
    by = Window.partitionBy(*body).orderBy(*order)
    own = own.withColumn("_at", F.row_number().over(by))
    other = F.max(F.when(F.col("_action").isNull(), F.col("_at"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumns({"_run": F.col("_at") - 1 - F.coalesce(other, F.lit(0)), "_before": F.lag("_action").over(by)})
    out = own.where("_run % 2 = 1").withColumn("fields", string_map(F.col(line)))
    return out.where("fields is not null and size(fields) > 0").select("fields", F.col("_before").alias("action"))


def parse_bulk(df: DataFrame, text: str = "value") -> DataFrame:
    """pair_bulk() of a text column with one bulk body a row."""
    lines = df.withColumn("_id", F.monotonically_increasing_id()).select("_id", F.posexplode(F.split(F.col(text), "\r?\n")).alias("_pos", "value"))
    return pair_bulk(lines, ["_id"], ["_pos"])


def parse_otlp(df: DataFrame, text: str = "value") -> DataFrame:
    """(text column of one JSON export a row) A row for each log record, with resource. and scope. prefixes."""
    value = "struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string>"
    attrs = f"array<struct<key:string,value:{value}>>"
    record = f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:string,severityText:string,body:{value},attributes:{attrs},traceId:string,spanId:string>"
    schema = f"struct<resourceLogs:array<struct<resource:struct<attributes:{attrs}>,scopeLogs:array<struct<scope:struct<name:string,version:string>,logRecords:array<{record}>>>>>>"
    plain = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"], v["boolValue"], F.lit(""))
    attributes = lambda a, prefix: F.map_from_entries(F.transform(F.coalesce(a, F.from_json(F.lit("[]"), attrs)), lambda x: F.struct(F.concat(F.lit(prefix), x["key"]).alias("key"), plain(x["value"]).alias("value"))))
    rows = df.select(F.explode(F.from_json(F.col(text), schema)["resourceLogs"]).alias("r")).select("r.resource", F.explode("r.scopeLogs").alias("s")).select("resource", "s.scope", F.explode("s.logRecords").alias("l"))
    entries = {"message": plain(F.col("l.body")), "severity": F.coalesce("l.severityText", "l.severityNumber"), "timestamp": F.coalesce("l.timeUnixNano", "l.observedTimeUnixNano"), "trace_id": F.lower("l.traceId"), "span_id": F.lower("l.spanId"), "scope.name": F.col("scope.name"), "scope.version": F.col("scope.version")}
    known = F.map_filter(F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), F.coalesce(v, F.lit(""))))), lambda _, v: v != "")
    merged = F.map_zip_with(F.map_zip_with(attributes(F.col("resource.attributes"), "resource."), attributes(F.col("l.attributes"), ""), lambda _, a, b: F.coalesce(b, a)), known, lambda _, a, b: F.coalesce(b, a))
    return rows.select(merged.alias("fields"))


def parse_csv(df: DataFrame, columns: list[str], text: str = "value", sep: str = ",") -> DataFrame:
    """Adds fields from separated values under the given names."""
    row = F.from_csv(F.col(text), F.lit(", ".join(f"`{c}` string" for c in columns)), {"sep": sep})
    return df.withColumn("_r", row).withColumn("fields", F.create_map(*(x for c in columns for x in (F.lit(c), F.coalesce(F.col(f"_r.`{c}`"), F.lit("")))))).drop("_r")


def read_json_logs(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """NDJSON, or with whole one array or object a file."""
    return parse_json(spark.read.text(path, wholetext=whole)).select("fields")


def read_kv_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_kv(spark.read.text(path)).select("fields")


def read_syslog_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_syslog(spark.read.text(path)).select("fields")


def read_bulk_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Bulk bodies, one a file: files are read by line and split, so that none has to fit in a row."""
    place = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()}
    return pair_bulk(spark.read.text(path).withColumns(place), ["_file"], ["_block", "_id"])


def read_otlp_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_otlp(spark.read.text(path))


def read_csv_logs(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """CSV or TSV (by its extension, or the given separator) with a header, all fields as text."""
    rows = spark.read.csv(path, header=True, sep=sep or ("\t" if path.endswith(".tsv") else ","))
    return rows.select(F.create_map(*(x for c in rows.columns for x in (F.lit(c), F.coalesce(F.col(f"`{c}`"), F.lit(""))))).alias("fields"))


def sniffed(spark: SparkSession, path: str) -> str:
    """json (whole), ndjson, csv, tsv or kv, by the first line that isn't blank of the first file: one task reads until it."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    line = first[0]["value"].strip() if first else ""
    if line[:1] in "[{":
        return "json" if line[:1] == "[" or not line.endswith("}") else "ndjson"
    return "tsv" if "\t" in line else "csv" if "," in line and "=" not in line.split(",")[0] else "kv"


def read_logs(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Files of one format; its kind is looked up where it isn't given."""
    kind = kind or sniffed(spark, path)
    if kind in ("csv", "tsv"):
        return read_csv_logs(spark, path, "\t" if kind == "tsv" else ",")
    return {"json": lambda: read_json_logs(spark, path, whole=True), "ndjson": lambda: read_json_logs(spark, path), "kv": lambda: read_kv_logs(spark, path), "syslog": lambda: read_syslog_logs(spark, path), "bulk": lambda: read_bulk_ndjson(spark, path), "otlp": lambda: read_otlp_json(spark, path)}[kind]()


def load_dictionary_csv(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The header names the columns; of equal keys, the row that was read last wins."""
    rows = spark.read.csv(path, header=True).withColumn("_order", F.monotonically_increasing_id())
    return load_dictionary(rows, keys, "_order").drop("_order")


def load_geo_ranges(spark: SparkSession, blocks: str, locations: str) -> DataFrame:
    """Address blocks with their locations' attributes and lo, hi, prefix for geo_lookup()."""
    b, n = spark.read.csv(blocks, header=True), spark.read.csv(locations, header=True)
    return cidr_ranges(b.join(n, "geoname_id", "left"), "network")
