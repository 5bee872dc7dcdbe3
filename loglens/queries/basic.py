"""Queries over scans, predicates, transforms, order and joins, with their oracles."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions import fields as ff
from ..functions import predicates as p
from ..functions import transforms as t
from ..operators import enrich, order
from ..sources import archive, readers
from ..sources import normalize as nz
from .tables import events, logs, read

Q: dict = {}
O: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


IP = "'10.' || (user_id % 4) || '.' || (user_id % 200) || '.' || (event_id % 250)"
LOG_ID = "lpad(CAST(event_id AS VARCHAR), 12, '0')"


@query("a1_scan_logs", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND user_id % 3 IN (0, 2)")
def a1(spark, d):
    return archive.scan_logs(logs(spark, d), ["t0", "t2"], datetime(2024, 1, 5), datetime(2024, 1, 20), closed=False).select("event_id", "event_type")


@query("a2_parse_json", """SELECT event_id, CAST(user_id AS VARCHAR) AS u, event_type AS kind, '{"k":"' || (event_id % 7) || '"}' AS nested FROM events""")
def a2(spark, d):
    line = F.to_json(F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("kind"), F.struct((F.col("event_id") % 7).cast("string").alias("k")).alias("nested")))
    rows = readers.parse_json(events(spark, d).select("event_id", line.alias("value")))
    return rows.select("event_id", *(F.col("fields")[k].alias(k) for k in ("u", "kind", "nested")))


@query("a3_parse_kv", "SELECT event_id, CAST(user_id AS VARCHAR) AS user, event_type || ' x' AS kind, 'b c' AS note FROM events")
def a3(spark, d):
    line = F.concat(F.lit("junk user=old user="), F.col("user_id"), F.lit(' kind="'), F.col("event_type"), F.lit(" x\" note='b c' more"))
    rows = readers.parse_kv(events(spark, d).select("event_id", line.alias("value")))
    return rows.select("event_id", *(F.col("fields")[k].alias(k) for k in ("user", "kind", "note")))


@query("a4_parse_syslog", """
WITH e AS (SELECT *, CASE event_id % 3 WHEN 0 THEN event_id % 192 WHEN 1 THEN 134 END AS pri FROM events), names AS (SELECT ['kern', 'user', 'mail', 'daemon', 'auth', 'syslog', 'lpr', 'news', 'uucp', 'cron', 'authpriv', 'ftp', 'ntp', 'audit', 'alert', 'clock', 'local0', 'local1', 'local2', 'local3', 'local4', 'local5', 'local6', 'local7'] AS f, ['emergency', 'alert', 'critical', 'error', 'warning', 'notice', 'info', 'debug'] AS s)
SELECT event_id, CAST(pri AS VARCHAR) AS priority, CAST(pri // 8 AS VARCHAR) AS facility, CAST(pri % 8 AS VARCHAR) AS severity, f[pri // 8 + 1] AS facility_name, s[pri % 8 + 1] AS severity_name,
 CASE WHEN event_id % 3 = 0 THEN '1' END AS version, CASE event_id % 3 WHEN 2 THEN NULL ELSE 'srv' || (user_id % 5) END AS hostname, CASE event_id % 3 WHEN 2 THEN NULL ELSE 'app' END AS appname, CASE event_id % 3 WHEN 2 THEN NULL ELSE '12' END AS procid,
 CASE event_id % 3 WHEN 0 THEN 'EV9' END AS msgid, CASE event_id % 3 WHEN 2 THEN '<200>plain ' || event_type ELSE event_type END AS message FROM e, names""")
def a4(spark, d):
    host = F.concat(F.lit("srv"), F.col("user_id") % 5)
    new = F.concat(F.lit("<"), F.col("event_id") % 192, F.lit(">1 2024-03-05T07:41:02.250Z "), host, F.lit(" app 12 EV9 - "), F.col("event_type"))
    old = F.concat(F.lit("<134>Mar  5 07:41:02 "), host, F.lit(" app[12]: "), F.col("event_type"))
    line = F.when(F.col("event_id") % 3 == 0, new).when(F.col("event_id") % 3 == 1, old).otherwise(F.concat(F.lit("<200>plain "), F.col("event_type")))
    rows = readers.parse_syslog(events(spark, d).select("event_id", line.alias("value")))
    return rows.select("event_id", *(F.col("fields")[k].alias(k) for k in ("priority", "facility", "severity", "facility_name", "severity_name", "version", "hostname", "appname", "procid", "msgid", "message")))


@query("a5_parse_bulk", """SELECT CAST(event_id AS VARCHAR) AS id, CASE event_id % 4 WHEN 0 THEN 'index' ELSE 'create' END AS action, CASE WHEN event_id % 3 = 0 THEN '{}' WHEN event_id % 3 = 1 THEN '5' END AS looks FROM events WHERE event_id % 4 < 2""")
def a5(spark, d):
    act = F.element_at(F.array(*(F.lit(x) for x in ("index", "create", "update", "delete"))), (F.col("event_id") % 4 + 1).cast("int"))
    # two thirds of the documents begin like an action
    first = F.element_at(F.array(F.lit('{"create":{},"id":'), F.lit('{"index":5,"id":'), F.lit('{"id":')), (F.col("event_id") % 3 + 1).cast("int"))
    document = F.when(act == "delete", "").when(act == "update", '{"doc":{}}\n').otherwise(F.concat(first, F.col("event_id"), F.lit("}\n")))
    body = F.concat(F.lit('{"'), act, F.lit('":{}}\n\n'), F.lit('{"'), act, F.lit('":{}}\n'), document, F.lit('{"delete":{"_id":"1"}}\n'))
    rows = readers.parse_bulk(events(spark, d).select(body.alias("value")))
    return rows.select(F.col("fields")["id"].alias("id"), "action", F.coalesce(F.col("fields")["create"], F.col("fields")["index"]).alias("looks"))


@query("a6_parse_otlp", "SELECT event_type AS message, 'svc' || (user_id % 3) AS service, 'lib' AS scope, CAST(event_id AS VARCHAR) AS id FROM events")
def a6(spark, d):
    body = F.concat(F.lit('{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc'), F.col("user_id") % 3, F.lit('"}}]},"scopeLogs":[{"scope":{"name":"lib"},"logRecords":[{"timeUnixNano":"1","body":{"stringValue":"'), F.col("event_type"), F.lit('"},"attributes":[{"key":"id","value":{"intValue":'), F.col("event_id"), F.lit("}}]}]}]}]}"))
    rows = readers.parse_otlp(events(spark, d).select(body.alias("value")))
    return rows.select(F.col("fields")["message"].alias("message"), F.col("fields")["resource.service.name"].alias("service"), F.col("fields")["scope.name"].alias("scope"), F.col("fields")["id"].alias("id"))


@query("a7_parse_csv", "SELECT CAST(event_id AS VARCHAR) AS id, event_type || ', x' AS kind FROM events")
def a7(spark, d):
    line = F.concat(F.col("event_id"), F.lit(',"'), F.col("event_type"), F.lit(', x"'))
    rows = readers.parse_csv(events(spark, d).select(line.alias("value")), ["id", "kind"])
    return rows.select(F.col("fields")["id"].alias("id"), F.col("fields")["kind"].alias("kind"))


@query("a8_load_dictionary", "SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def a8(spark, d):
    return enrich.load_dictionary(read(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("a9_geo_ranges", "SELECT DISTINCT '10.' || (user_id % 200) || '.0.0/16' AS network, 167772160 + (user_id % 200) * 65536 AS lo, 167772160 + (user_id % 200) * 65536 + 65535 AS hi, 16 AS prefix FROM events")
def a9(spark, d):
    nets = events(spark, d).select(F.concat(F.lit("10."), F.col("user_id") % 200, F.lit(".0.0/16")).alias("network")).distinct()
    return enrich.cidr_ranges(nets, "network")


@query("a11_dedup_ids", "SELECT count(DISTINCT event_id) AS n FROM events")
def a11(spark, d):
    e = logs(spark, d)
    return order.dedup_ids(e.unionByName(e)).agg(F.count("*").alias("n"))


@query("a13_restore", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25' AND event_id % 5 <> 0")
def a13(spark, d):
    e = logs(spark, d)
    return archive.restore(e.unionByName(e), e.where("event_id % 5 = 0"), datetime(2024, 1, 3), datetime(2024, 1, 25)).select("event_id")


@query("a14_reconcile_counts", "SELECT 't' || (user_id % 3) AS tenant, CAST(ts AS DATE) AS day, count(*) AS archived, count(*) FILTER (event_id % 4 <> 0) AS hot, count(*) > count(*) FILTER (event_id % 4 <> 0) AS restore FROM events GROUP BY 1, 2")
def a14(spark, d):
    e = logs(spark, d)
    return archive.reconcile_counts(e, e.where("event_id % 4 <> 0"), "tenant_id", "timestamp")


@query("a15_expired_partitions", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-15' GROUP BY 1")
def a15(spark, d):
    days = events(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return archive.expired_partitions(days, 15, date(2024, 1, 30))


@query("a16_rollover", """
WITH days AS (SELECT 't' || (user_id % 3) AS tenant, CAST(ts AS DATE) AS day, sum(strlen(props)) AS bytes FROM events GROUP BY 1, 2),
w AS (SELECT *, sum(bytes) OVER (PARTITION BY tenant) AS total, sum(bytes) OVER (PARTITION BY tenant ORDER BY day DESC) AS rest, max(day) OVER (PARTITION BY tenant) AS newest FROM days)
SELECT tenant, day, CAST(bytes AS BIGINT) AS bytes FROM w WHERE total > 20000 AND rest > 16000 AND day < newest""")
def a16(spark, d):
    days = events(spark, d).groupBy(F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant"), F.to_date("ts").alias("day")).agg(F.sum(F.octet_length("props")).alias("bytes"))
    return archive.rollover(days, 20_000)


#: JSON numbers and other values, and the texts that they become.
NUMBERS = (("1e30", "1000000000000000000000000000000"), ("1.0", "1"), ("123456789012345678901", "123456789012345680000"), ("-0.000125", "-0.000125"), ("1.5e-9", "0.0000000015"), ("12.50", "12.5"), ("-7", "-7"), ("1E5", "100000"), ("true", "true"), ('"1e30"', "1e30"), ('""', ""))


def _choice(values, by):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (by % len(values) + 1).cast("int"))


@query("n1_build_fields", f"""SELECT event_id, '{{"k":"' || event_type || '"}}' AS nested, '' AS nothing, CAST(user_id AS VARCHAR) AS n, {[v for _, v in NUMBERS]}[event_id % {len(NUMBERS)} + 1] AS v,
 '[1,"' || event_type || '",{{}}]' AS list, '{{"k":1}}' AS text, CASE WHEN event_id % 2 = 0 THEN 'o,nested' ELSE 'nested' END AS objects FROM events""")
def n1(spark, d):
    kind, n = F.col("event_type"), F.col("event_id")
    more = F.when(n % 2 == 0, '"o":{},').otherwise("")
    text = F.concat(F.lit("{"), more, F.lit('"v":'), _choice([j for j, _ in NUMBERS], n), F.lit(',"list":[1, "'), kind, F.lit('", {}],"text":"{\\"k\\":1}","nested":{"k":"'), kind, F.lit('"},"nothing":null,"n":'), F.col("user_id"), F.lit("}"))
    own = events(spark, d).select("event_id", readers.string_map(text).alias("f"), F.array_join(F.reverse(F.sort_array(readers.nested_keys(text))), ",").alias("objects"))
    return own.select("event_id", "objects", *(F.col("f")[k].alias(k) for k in ("nested", "nothing", "n", "v", "list", "text")))


#: Items of an array by an event's number; every 240th event has 1000.
ITEMS = (0, 1, 16, 17, 20)


@query("n2_flatten", f"""
WITH e AS (SELECT *, CASE WHEN event_id % 240 = 7 THEN 1000 ELSE {list(ITEMS)}[event_id % {len(ITEMS)} + 1] END AS items FROM events)
SELECT event_id, CAST(event_id AS VARCHAR) AS a_b_c, event_type AS a_d, '1' AS a_x_y, '{{"k":1}}' AS a_s, '[{{"x":1}},2]' AS a_mixed, '[{{"v":"x"}}]' AS l, '{{"k":2}}' AS s,
 CASE WHEN items BETWEEN 1 AND 16 THEN NULL ELSE '[' || array_to_string(list_transform(range(items), lambda i: '{{"v":' || i || '}}'), ',') || ']' END AS a_l,
 CASE WHEN items BETWEEN 1 AND 16 THEN array_to_string(range(items), ',') ELSE '' END AS opened, false AS truncated FROM e""")
def n2(spark, d):
    n = F.when(F.col("event_id") % 240 == 7, 1000).otherwise(_choice(ITEMS, F.col("event_id")))
    items = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit('{"v":'), (i - 1).cast("string"), F.lit("}")))
    some = F.when(n > 0, F.array_join(items, ",")).otherwise("")
    text = F.concat(F.lit('{"a":{"b":{"c":'), F.col("event_id"), F.lit('},"d":"'), F.col("event_type"), F.lit('","x.y":1,"e":{},"s":"{\\"k\\":1}","mixed":[{"x":1},2],"l":['), some, F.lit(']},"s":"{\\"k\\":2}","l":[{"v":"x"}]}'))
    read_ = events(spark, d).select("event_id", text.alias("text")).select("event_id", readers.string_map(F.col("text")).alias("m"), readers.nested_keys(F.col("text")).alias("k"))
    own = read_.select("event_id", nz.flattened(F.col("m"), nested=F.col("k")).alias("f")).select("event_id", "f.*")
    opened = F.array_join(F.filter(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.try_element_at("fields", F.concat(F.lit("a_l_"), i.cast("string"), F.lit("_v")))), lambda v: v.isNotNull()), ",")
    return own.select("event_id", "truncated", opened.alias("opened"), *(F.try_element_at("fields", F.lit(k)).alias(k) for k in ("a_b_c", "a_d", "a_x_y", "a_s", "a_mixed", "l", "s", "a_l")))


#: Names, and how they are written in snake, camel and Pascal case.
NAMES = (
    ("queryName", "query_name", "queryName", "QueryName"), ("EventID", "event_id", "eventID", "EventID"), ("HTTPStatusCode", "http_status_code", "hTTPStatusCode", "HTTPStatusCode"), ("HTTPServer", "http_server", "hTTPServer", "HTTPServer"),
    ("Accept-Encoding", "accept_encoding", "accept-Encoding", "Accept-Encoding"), ("accept-encoding", "accept_encoding", "accept-encoding", "Accept-encoding"), ("Process Name", "process_name", "process Name", "Process Name"), ("_Own__name_", "_own_name", "OwnName", "OwnName"),
    ("query_name", "query_name", "queryName", "QueryName"), ("@timestamp", "@timestamp", "@timestamp", "@timestamp"), ("a/b", "a_b", "a/b", "A/b"), ("-x-", "x", "-x-", "-x-"), ("Ünï", "ünï", "ünï", "Ünï"), ("имяПоля", "имя_поля", "имяПоля", "ИмяПоля"), ("名前", "名前", "名前", "名前"), ("MyField.Name", "my_field._name", "myField.Name", "MyField.Name"),
)


@query("n3_rename_fields", f"SELECT event_id, event_type AS value, {[x[0] for x in NAMES]}[event_id % {len(NAMES)} + 1] AS name, " + ", ".join(f"{[x[i] for x in NAMES]}[event_id % {len(NAMES)} + 1] AS {how}" for i, how in ((1, "snake"), (2, "camel"), (3, "pascal"))) + " FROM events")
def n3(spark, d):
    name = _choice([x[0] for x in NAMES], F.col("event_id"))
    own = events(spark, d).select("event_id", name.alias("name"), *(nz.rename_fields(F.create_map(name, F.col("event_type")), how).alias(how) for how in ("snake", "camel", "pascal")))
    return own.select("event_id", "name", F.map_values("snake")[0].alias("value"), *(F.map_keys(how)[0].alias(how) for how in ("snake", "camel", "pascal")))


@query("n4_map_fields", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'second' END AS target, 2 - 1 AS n FROM events")
def n4(spark, d):
    f = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.lit("second"))).otherwise(F.create_map(F.lit("b"), F.lit("second")))
    m = nz.map_fields(f, {"target": ["a", "b"]})
    return events(spark, d).select("event_id", m["target"].alias("target"), F.size(m).alias("n"))


@query("n5_map_values", "SELECT event_id, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE 'other' END AS code FROM events")
def n5(spark, d):
    return logs(spark, d).select("event_id", nz.map_values(F.col("fields"), "action", "code", {"click": "c", "view": "v"}, "other")["code"].alias("code"))


@query("n6_extract_timestamp", "SELECT event_id, to_timestamp(CAST(floor(epoch(ts)) AS BIGINT))::TIMESTAMP AS at FROM events")
def n6(spark, d):
    s = F.unix_seconds("ts").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, s).when(F.col("event_id") % 3 == 1, F.concat(s, F.lit("000"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return events(spark, d).select("event_id", nz.extract_timestamp(F.create_map(F.lit("time"), text), F.lit(None).cast("timestamp")).alias("at"))


@query("n7_assign_log_id", "SELECT event_id, substr(sha256((epoch_us(ts) * 1000) || ':' || props), 1, 32) AS log_id FROM events")
def n7(spark, d):
    return events(spark, d).select("event_id", ff.log_id(F.col("ts"), F.col("props")).alias("log_id"))


@query("n8_normalizer_stamp", "SELECT event_id, 'web@3' AS normalizer, 't' || (user_id % 3) AS tenant_id, ts AS timestamp FROM events")
def n8(spark, d):
    e = logs(spark, d).withColumn("fields", F.map_concat("fields", F.create_map(F.lit("ts"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))))
    own = nz.normalized(e.select("event_id", "fields", "ingest_timestamp", "tenant_id"), F.col("ingest_timestamp"), F.col("tenant_id"), F.to_json("fields"), normalizer="web@3")
    return own.select(F.col("fields")["user"].alias("_u"), "normalizer", "tenant_id", "timestamp").join(events(spark, d).select("event_id", F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("_u")), ["timestamp", "_u"]).select("event_id", "normalizer", "tenant_id", "timestamp")


@query("n9_trace_normalization", """
WITH t AS (SELECT event_id, event_type AS action, CAST(user_id AS VARCHAR) AS usr, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE 'other' END AS code, event_id % 2 = 0 AS even FROM events)
SELECT event_id, 'target' AS field, action AS value, 'action' AS source, 'action' AS alias, false AS derived, false AS override, true AS collision FROM t
UNION ALL SELECT event_id, 'target', 'x', 'verb', 'verb', false, false, true FROM t
UNION ALL SELECT event_id, 'user', CASE WHEN usr = '1' THEN 'one' ELSE usr END, 'user', NULL, usr = '1', usr = '1', false FROM t
UNION ALL SELECT event_id, 'code', code, 'target', NULL, true, false, false FROM t WHERE NOT even
UNION ALL SELECT event_id, 'code', code, 'code', NULL, code <> 'other', code <> 'other', false FROM t WHERE even""")
def n9(spark, d):
    own = F.create_map(F.lit("verb"), F.lit("x"), F.lit("action"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    own = F.when(F.col("event_id") % 2 == 0, F.map_concat(own, F.create_map(F.lit("code"), F.lit("other")))).otherwise(own)
    values = [("target", "code", {"click": "c", "view": "v"}, "other"), ("user", "user", {"1": "one"}, None), ("nothing", "more", {"a": "b"}, "c")]
    return nz.trace_normalization(events(spark, d).select("event_id", own.alias("before")), "event_id", "before", {"target": ["action", "verb"]}, values)


def _filter(name, sql, condition, table="events", columns=("event_id",)):
    @query(name, f"SELECT {', '.join(columns)} FROM {table} WHERE {sql}")
    def run(spark, d):
        return read(spark, d, table).where(condition()).select(*columns)


_filter("f1_eq_in_list", "event_type IN ('click', 'view')", lambda: p.eq(F.col("event_type"), "click", "view"))
_filter("f2_ne_not_in_list", "coalesce(event_type, '') NOT IN ('click', 'view')", lambda: p.ne(F.col("event_type"), "click", "view"))
_filter("f3_exists", "props IS NOT NULL AND props <> ''", lambda: p.exists(F.col("props")) & ~p.missing(F.col("event_type")))
_filter("f4_compare", "coalesce(TRY_CAST(props AS DOUBLE), 0) < 10 AND value > 50 AND value <= 90", lambda: p.lt(F.col("props"), 10) & p.gt(F.col("value"), 50) & p.le(F.col("value"), 90))
_filter("f5_matches", "regexp_matches(url, '(?i)EXAMPLE\\.(com|org)/en')", lambda: p.matches(F.col("url"), r"EXAMPLE\.(com|org)/en", ignore_case=True), "pages", ("page_id",))
_filter("f6_contains_any", "contains(lower(url), 'spam') OR contains(lower(url), 'pills')", lambda: p.contains_any(F.col("url"), "SPAM", "pills"), "pages", ("page_id",))
_filter("f7_starts_ends", "prefix(lower(url), 'https://') AND (suffix(lower(url), '.html') OR suffix(lower(url), '/'))", lambda: p.starts_with_any(F.col("url"), "HTTPS://") & p.ends_with_any(F.col("url"), ".html", "/"), "pages", ("page_id",))
_filter("f8_text_search", "contains(lower(text), 'license')", lambda: p.text_search(F.col("text"), "License"), "documents", ("doc_id",))
_filter("f9_in_values", "event_type NOT IN ('click') AND user_id IN (1, 2, 3, 5, 8, 13)", lambda: ~p.eq(F.col("event_type"), "click") & p.eq(F.col("user_id"), 1, 2, 3, 5, 8, 13))
_filter("f11_boolean_combine", "(event_type = 'click' OR value > 90) AND NOT user_id < 100", lambda: (p.eq(F.col("event_type"), "click") | p.gt(F.col("value"), 90)) & ~p.lt(F.col("user_id"), 100))


@query("f10_in_cidr", f"SELECT event_id, {IP} AS src_ip FROM events WHERE user_id % 4 = 1 AND (user_id % 200) BETWEEN 0 AND 127")
def f10(spark, d):
    return logs(spark, d).where(p.in_cidr(F.col("src_ip"), "10.1.0.0/17") & ~p.in_cidr(F.lit("x"), "::/0")).select("event_id", "src_ip")


@query("f12_post_filter", "SELECT user_id, count(*) AS _count FROM events WHERE value > 10 GROUP BY 1 HAVING count(*) > 3")
def f12(spark, d):
    from ..operators.aggregate import group_by

    return group_by(events(spark, d).where("value > 10"), ["user_id"]).where("_count > 3")


@query("f13_commented", "SELECT event_id FROM events WHERE event_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND contains(lower(text), 'the'))")
def f13(spark, d):
    comments = read(spark, d, "documents").select(F.col("doc_id").alias("event_id"), F.array("lang").alias("tags"), "text")
    return p.commented(events(spark, d), comments, "event_id", ("en",), "the").select("event_id")


@query("p1_table", "SELECT event_type, event_id FROM events ORDER BY event_id LIMIT 100")
def p1(spark, d):
    return order.table(events(spark, d).orderBy("event_id"), "event_type", "event_id", n=100)


@query("p2_table_aggs", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1, 2")
def p2(spark, d):
    return order.table(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus", aggs=(F.round(F.sum("l_quantity"), 2).alias("q"),))


@query("p3_assign", "SELECT event_id, round(value * 2 + user_id / nullif(event_id % 5, 0), 6) AS m, TRY_CAST(event_type AS DOUBLE) AS none FROM events")
def p3(spark, d):
    own = events(spark, d).withColumn("k", F.col("event_id") % 5)
    return own.select("event_id", F.round(ff.numn(F.col("value")) * 2 + t.divide(F.col("user_id"), F.col("k")), 6).alias("m"), ff.numn(F.col("event_type")).alias("none"))


@query("p4_case_when", "SELECT event_id, CASE WHEN value > 80 THEN 'high' WHEN value > 40 THEN upper(event_type) ELSE 'low' END AS band FROM events")
def p4(spark, d):
    return events(spark, d).select("event_id", t.case_when([(F.col("value") > 80, "high"), (F.col("value") > 40, F.upper("event_type"))], "low").alias("band"))


@query("p5_case_agg", "SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 4) AS viewed FROM events GROUP BY 1")
def p5(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.round(F.coalesce(F.sum(F.when(F.col("event_type") == "view", F.col("value"))), F.lit(0.0)), 4).alias("viewed"))


@query("p6_strftime", "SELECT event_id, strftime(ts, '%Y/%m/%d at %H:%M:%S %a %b') AS s FROM events")
def p6(spark, d):
    return events(spark, d).select("event_id", t.strftime(F.col("ts"), "%Y/%m/%d at %H:%M:%S %a %b").alias("s"))


@query("p7_now", "SELECT event_id, true AS ok FROM events")
def p7(spark, d):
    return events(spark, d).select("event_id", (F.current_timestamp() > F.col("ts")).alias("ok"))


@query("p8_case", "SELECT event_id, upper(event_type) AS u, lower(upper(event_type)) AS l FROM events")
def p8(spark, d):
    return events(spark, d).select("event_id", F.upper("event_type").alias("u"), F.lower(F.upper("event_type")).alias("l"))


@query("p9_regex_extract", "SELECT page_id, regexp_extract(url, '://([^/?#]+)/([a-z]{2})/', 1) AS host, regexp_extract(url, '://([^/?#]+)/([a-z]{2})/', 2) AS my_lang, len(regexp_extract_all(url, '\\d+')) AS n FROM pages")
def p9(spark, d):
    own = t.regex_groups(read(spark, d, "pages"), "url", r"://(?<host>[^/?#]+)/(?<my_lang>[a-z]{2})/")
    return own.select("page_id", "host", "my_lang", F.size(t.regex_all(F.col("url"), r"\d+")).alias("n"))


@query("p10_regex_replace", "SELECT page_id, regexp_replace(url, '\\d+', 'N', 'g') AS u FROM pages")
def p10(spark, d):
    return read(spark, d, "pages").select("page_id", t.regex_replace(F.col("url"), r"\d+", "N").alias("u"))


@query("p11_concat", "SELECT event_id, coalesce(event_type, '') || user_id AS c FROM events")
def p11(spark, d):
    return events(spark, d).select("event_id", t.concat_fields(F.col("event_type"), F.col("user_id")).alias("c"))


@query("p12_hash_key", "SELECT count(*) AS n, count(DISTINCT event_type || ':' || user_id) AS keys, 2 * count(DISTINCT event_type) AS halves FROM events")
def p12(spark, d):
    half = [F.when(F.col("event_id") % 2 == k, F.col("event_type")) for k in (0, 1)]  # one of the two is null
    return events(spark, d).agg(F.count("*").alias("n"), F.count_distinct(t.hash_key(F.col("event_type"), F.col("user_id"))).alias("keys"), F.count_distinct(t.hash_key(*half)).alias("halves"))


@query("p13_len", "SELECT doc_id, strlen(text) AS bytes FROM documents")
def p13(spark, d):
    return read(spark, d, "documents").select("doc_id", t.byte_length(F.col("text")).alias("bytes"))


@query("p14_log_size", "SELECT event_id, coalesce(strlen(props), 0) + 16 AS size FROM events")
def p14(spark, d):
    return events(spark, d).select("event_id", t.log_size(F.col("props")).alias("size"))


@query("p15_edit_distance", "SELECT p_partkey, damerau_levenshtein(p_brand, p_type) AS d FROM part")
def p15(spark, d):
    return read(spark, d, "part").select("p_partkey", t.edit_distance(F.col("p_brand"), F.col("p_type")).alias("d"))


@query("p16_base64_decode", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS s FROM events")
def p16(spark, d):
    return events(spark, d).select("event_id", t.base64_decode(F.when(F.col("event_id") % 2 == 0, F.base64(F.col("event_type").cast("binary"))).otherwise("%%%")).alias("s"))


@query("p17_split_part", "SELECT page_id, split_part(url, '/', 3) AS a, split_part(url, '/', 99) AS b FROM pages")
def p17(spark, d):
    return read(spark, d, "pages").select("page_id", t.split_part(F.col("url"), "/", 3).alias("a"), t.split_part(F.col("url"), "/", 99).alias("b"))


@query("p18_substr", "SELECT page_id, substr(url, 9) AS a, substr(url, 2, 4) AS b FROM pages")
def p18(spark, d):
    return read(spark, d, "pages").select("page_id", t.substr(F.col("url"), 9).alias("a"), t.substr(F.col("url"), 2, 4).alias("b"))


@query("p19_url_decode", "SELECT page_id, url_decode(replace(url, '/', '%2F') || '+x%20y') AS u FROM pages")
def p19(spark, d):
    return read(spark, d, "pages").select("page_id", t.url_decode(F.concat(F.replace("url", F.lit("/"), F.lit("%2F")), F.lit("+x%20y"))).alias("u"))


@query("p20_coalesce", "SELECT event_id, coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END, ''), 'z') AS c FROM events")
def p20(spark, d):
    return events(spark, d).select("event_id", t.coalesce_nonempty(F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("event_type")), F.lit("z")).alias("c"))


@query("p21_sprintf", "SELECT event_id, printf('%s-%d', coalesce(nullif(event_type, 'click'), ''), user_id) AS s FROM events")
def p21(spark, d):
    return events(spark, d).select("event_id", t.sprintf("%s-%d", F.nullif(F.col("event_type"), F.lit("click")), F.col("user_id")).alias("s"))


TAGGED = "CASE event_id % 3 WHEN 0 THEN 'attack.t1059 x T1543.003' WHEN 1 THEN 'attack.execution' ELSE 'none' END"


@query("p22_attack_tags", f"SELECT event_id, unnest(list_distinct(regexp_extract_all(lower({TAGGED}), '\\b((?:attack|mitre)\\.[a-z0-9_.-]+|t\\d{{4}}(?:\\.\\d{{3}})?)\\b', 1))) AS tag FROM events")
def p22(spark, d):
    return events(spark, d).select("event_id", F.explode(t.attack_tags(F.expr(TAGGED))).alias("tag"))


@query("p23_abstract", f"SELECT event_id, 'c:\\users\\*\\app*.exe' AS path, regexp_replace({IP}, '\\.\\d+$', '.0/24') AS ip, 'a.com' AS dom FROM events")
def p23(spark, d):
    return logs(spark, d).select("event_id", t.abstract_path(F.concat(F.lit("C:\\Users\\Bob"), F.col("user_id"), F.lit("\\app1234567.exe"))).alias("path"), t.abstract_ip(F.col("src_ip")).alias("ip"), t.abstract_domain(F.lit("A.com.")).alias("dom"))


@query("l1_sort", "SELECT event_id, value FROM events ORDER BY value DESC, event_id")
def l1(spark, d):
    return order.sort(events(spark, d).select("event_id", "value"), ("value", True), ("event_id", False))


@query("l2_limit", "SELECT count(*) AS n FROM (SELECT * FROM events LIMIT 77)")
def l2(spark, d):
    return order.limit(events(spark, d), 77).agg(F.count("*").alias("n"))


@query("l3_head", "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 200")
def l3(spark, d):
    return order.head(logs(spark, d)).select("event_id")


@query("l4_tail", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def l4(spark, d):
    return order.tail(logs(spark, d)).select("event_id")


@query("l5_dedup", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def l5(spark, d):
    return order.dedup(logs(spark, d).select("user_id", "event_type", "event_id", "timestamp", "log_id"), ["user_id", "event_type"]).select("user_id", "event_type", "event_id")


@query("l6_default_order", "SELECT event_id, ts AS timestamp FROM events ORDER BY ts DESC, event_id DESC")
def l6(spark, d):
    return order.newest_first(logs(spark, d)).select("event_id", "timestamp")


@query("l7_keyset_page", f"SELECT event_id FROM events WHERE (ts, {LOG_ID}) < (TIMESTAMP '2024-01-15', '000000000500') ORDER BY ts DESC, event_id DESC LIMIT 50")
def l7(spark, d):
    return order.page_after(logs(spark, d), 50, (datetime(2024, 1, 15), "000000000500")).select("event_id")


@query("j1_correlate", "SELECT event_id, c AS _join_c FROM events JOIN (SELECT user_id, count(*) AS c FROM events WHERE event_type = 'purchase' GROUP BY 1) USING (user_id)")
def j1(spark, d):
    e = events(spark, d)
    return enrich.correlate(e, e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("c")), ["user_id"]).select("event_id", "_join_c")


@query("j2_lookup", "SELECT c_custkey, coalesce(n_name, '') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey")
def j2(spark, d):
    return enrich.lookup(read(spark, d, "customer"), read(spark, d, "nation").where("n_nationkey % 2 = 0"), "c_nationkey", "n_nationkey", ["n_name"]).select("c_custkey", "n_name")


@query("j3_geo_lookup", f"""
WITH r AS (SELECT '10.' || a AS start, 167772160 + a * 65536 AS lo, 167772160 + a * 65536 + 65535 AS hi, 16 AS prefix, 'city' || a AS city FROM range(0, 3) t(a)
 UNION ALL SELECT '10.', 167772160, 167772160 + 16777215, 8, 'ten'
 UNION ALL SELECT '10.1.64', 167772160 + 65536 + 64 * 256, 167772160 + 65536 + 64 * 256 + 16383, 18, 'part'),
e AS (SELECT event_id, 167772160 + (user_id % 4) * 65536 + (user_id % 200) * 256 + event_id % 250 AS ip FROM events)
SELECT event_id, arg_max(city, prefix) AS city FROM e JOIN r ON ip BETWEEN lo AND hi GROUP BY 1""")
def j3(spark, d):
    nets = spark.range(3).select(F.concat(F.lit("10."), "id", F.lit(".0.0/16")).alias("network"), F.concat(F.lit("city"), "id").alias("city"))
    nets = nets.unionByName(spark.range(1).select(F.lit("10.0.0.0/8").alias("network"), F.lit("ten").alias("city"))).unionByName(spark.range(1).select(F.lit("10.1.64.0/18").alias("network"), F.lit("part").alias("city")))
    return enrich.geo_lookup(logs(spark, d), enrich.cidr_ranges(nets, "network"), "src_ip", ["city"]).select("event_id", "city")


@query("j5_hydrate", "SELECT event_id, event_type FROM events WHERE event_id % 10 = 0 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-20'")
def j5(spark, d):
    e = logs(spark, d)
    return enrich.hydrate(e, e.where("event_id % 10 = 0").select("log_id"), dates=(date(2024, 1, 2), date(2024, 1, 20))).select("event_id", "event_type")
