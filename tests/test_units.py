"""Hand-made cases for what SQL can't check or the tables don't hold."""

import collections
import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loglens.functions import predicates as p
from loglens.functions import transforms as t
from loglens.operators import enrich, graph, models, profile, rule_index, rules, sequence, sketches
from loglens.operators import provenance as pv
from loglens.sources import archive
from loglens.sources import normalize as nz
from loglens.sources import readers
from loglens.streaming import jobs


def one(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def strings(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_addresses(spark):
    df = strings(spark, "10.1.2.3", "10.1.2.300", "x", None, "2001:db8::1", "::1", "2001:db8:0:0:0:0:0:1:2")
    assert one(df.select(p.ipv4(F.col("value")).alias("a")), "a") == [(167838211,), (None,), (None,), (None,), (None,), (None,), (None,)]
    got = one(df.select(p.in_cidr(F.col("value"), "10.0.0.0/8").alias("a"), p.in_cidr(F.col("value"), "2001:db8::/32").alias("b"), (~p.in_cidr(F.col("value"), "::1/128")).alias("c")), "a", "b", "c")
    assert got == [(True, False, True), (False, False, True), (False, False, True), (False, False, True), (False, True, True), (False, False, False), (False, False, True)]


def test_missing_fields(spark):
    df = strings(spark, "a", "", None)
    got = one(df.select(p.ne(F.col("value"), "a").alias("ne"), p.exists(F.col("value")).alias("e"), p.lt(F.col("value"), 1).alias("lt")), "ne", "e", "lt")
    assert got == [(False, True, True), (True, False, True), (True, False, True)]


@pytest.mark.parametrize(("a", "b", "n"), [("", "abc", 3), ("ab", "ba", 1), ("ca", "abc", 2), ("abcd", "abdc", 1), ("kitten", "sitting", 3), ("x", "x", 0)])
def test_edit_distance(spark, a, b, n):
    assert t.damerau_levenshtein(a, b) == n
    assert spark.createDataFrame([(a, b)], "a string, b string").select(t.edit_distance(F.col("a"), F.col("b"))).first()[0] == n


def test_syslog(spark):
    new = "<163>1 2024-03-05T07:41:02.250Z gate07 billing 88 EV9 - Invoice 12 was paid"
    data = '<110>1 2024-03-05T07:41:03Z gate07 audit - EV10 [who@99 name="a \\] b"][x@99] Key was changed'
    got = [r["fields"] for r in readers.parse_syslog(strings(spark, new, data, "<26>Mar  5 07:41:04 gate08 smtpd[7]: queue is full", "no header", "", "<999>x")).collect()]
    assert got[0] == {"priority": "163", "version": "1", "facility": "20", "severity": "3", "facility_name": "local4", "severity_name": "error", "timestamp": "2024-03-05T07:41:02.250Z", "hostname": "gate07", "appname": "billing", "procid": "88", "msgid": "EV9", "message": "Invoice 12 was paid"}
    assert got[1]["structured_data"] == '[who@99 name="a \\] b"][x@99]' and got[1]["message"] == "Key was changed" and got[1]["facility_name"] == "audit"
    assert got[2] == {"priority": "26", "facility": "3", "severity": "2", "facility_name": "daemon", "severity_name": "critical", "timestamp": "Mar  5 07:41:04", "hostname": "gate08", "appname": "smtpd", "procid": "7", "message": "queue is full"}
    assert got[3] == {"message": "no header"} and len(got) == 5


def test_json_and_bulk(spark):
    rows = readers.parse_json(strings(spark, '{"a":1}', "broken", '[{"a":2},{"a":3}]', None))
    assert [r["fields"]["a"] for r in rows.collect()] == ["1", "2", "3"]
    body = '{"index":{}}\n{"x":1}\n{"delete":{"_id":"1"}}\n{"update":{}}\n{"doc":{}}\n{"create":{}}\n{"x":2}\n'
    assert sorted(r["fields"]["x"] for r in readers.parse_bulk(strings(spark, body)).collect()) == ["1", "2"]


def bulk_by_hand(body):
    out, lines = [], iter(body.split("\n"))
    for line in lines:
        try:
            action = json.loads(line)
        except ValueError:
            continue
        kind = next((k for k in ("index", "create") if isinstance(action, dict) and isinstance(action.get(k), dict)), None)
        if kind:
            try:
                document = json.loads(next(lines, ""))
            except ValueError:
                continue
            if isinstance(document, dict) and document:
                out.append((kind, document.get("id")))
    return out


def test_bulk_bodies(spark, tmp_path):
    """Documents that look like actions, blanks, broken lines and what updates and deletes leave, in any order."""
    r = random.Random(1)
    line = lambda: r.choice(['{"create":{}}', '{"index":{"_id":"1"}}', '{"index":5,"id":"%d"}', '{"create":{"a":1},"id":"%d"}', '{"id":"%d"}', '{"delete":{"_id":"1"}}', '{"update":{}}', '{"doc":{"x":1}}', "", "broken", "[1]", '{"index":{},"id":"%d"}'])
    bodies = ["\n".join((x % r.randint(0, 99)) if "%d" in x else x for x in (line() for _ in range(r.randint(1, 40)))) for _ in range(60)]
    bodies += ['{"create":{}}\n{"index":5,"id":"1"}', '{"index":{}}\n{"create":{},"id":"2"}\n{"create":{}}\n{"id":"3"}\n', ""]
    want = [x for b in bodies for x in bulk_by_hand(b)]
    assert len(want) > 100
    got = readers.parse_bulk(strings(spark, *bodies)).collect()
    assert sorted(((r["action"], r["fields"].get("id")) for r in got), key=repr) == sorted(want, key=repr)
    for i, b in enumerate(bodies):
        (tmp_path / f"{i}.ndjson").write_text(b)
    got = readers.read_bulk_ndjson(spark, str(tmp_path)).collect()
    assert sorted(((r["action"], r["fields"].get("id")) for r in got), key=repr) == sorted(want, key=repr)


def test_files_of_each_format(spark, tmp_path):
    files = {
        "a.ndjson": '{"u":"1","k":{"x":2}}\n\n{"u":"2"}\n', "a.json": '[{"u":"1"},\n {"u":"2"}]', "a.kv": 'u=1 note="b c"\nnothing here\nu=2\n', "a.log": "<13>1 2024-03-05T07:41:02Z h a - - - hi\nplain\n", "a.csv": 'u,note\n1,"b, c"\n2,\n', "a.tsv": "u\tnote\n1\tb, c\n2\t\n",
        "o.json": '{"resourceLogs":[{"resource":{"attributes":[]},"scopeLogs":[{"scope":{"name":"s"},"logRecords":[{"body":{"stringValue":"m"},"severityText":"WARN"}]}]}]}', "d.csv": "k,v\na,1\nb,2\na,3\n,4\n",
        "blocks.csv": "network,geoname_id\n10.1.0.0/16,7\n10.1.2.0/24,8\nbad,7\n", "names.csv": "geoname_id,country\n7,AA\n8,BB\n",
    }
    for n, text in files.items():
        (tmp_path / n).write_text(text)
    at = lambda n: str(tmp_path / n)
    users = lambda df: sorted(r["fields"].get("u") for r in df.collect())
    assert users(readers.read_json_logs(spark, at("a.ndjson"))) == users(readers.read_json_logs(spark, at("a.json"), whole=True)) == users(readers.read_kv_logs(spark, at("a.kv"))) == ["1", "2"]
    assert [r["fields"]["message"] for r in readers.read_syslog_logs(spark, at("a.log")).collect()] == ["hi", "plain"]
    for n in ("a.csv", "a.tsv"):
        assert sorted((r["fields"]["u"], r["fields"]["note"]) for r in readers.read_csv_logs(spark, at(n)).collect()) == [("1", "b, c"), ("2", "")]
    assert readers.read_otlp_json(spark, at("o.json")).first()["fields"] == {"message": "m", "severity": "WARN", "scope.name": "s"}
    assert {n: readers.sniffed(spark, at(n)) for n in ("a.ndjson", "a.json", "a.kv", "a.csv", "a.tsv")} == {"a.ndjson": "ndjson", "a.json": "json", "a.kv": "kv", "a.csv": "csv", "a.tsv": "tsv"}
    assert all(users(readers.read_logs(spark, at(n))) == ["1", "2"] for n in ("a.ndjson", "a.json", "a.kv", "a.csv", "a.tsv"))
    assert sorted(one(readers.load_dictionary_csv(spark, at("d.csv"), ["k"]), "k", "v")) == [("a", "3"), ("b", "2")]
    ranges = readers.load_geo_ranges(spark, at("blocks.csv"), at("names.csv"))
    hosts = strings(spark, "10.1.2.3", "10.1.9.9", "9.9.9.9")
    assert sorted(one(enrich.geo_lookup(hosts, ranges, "value", ["country"]), "value", "country")) == [("10.1.2.3", "BB"), ("10.1.9.9", "AA"), ("9.9.9.9", "")]


def test_nulls_in_keys_and_formats(spark):
    df = spark.createDataFrame([("a", None, 1), (None, "a", None), ("a", "a", 2), (None, None, 3)], "x string, y string, n int")
    assert df.select(t.hash_key(F.col("x"), F.col("y")).alias("k")).distinct().count() == 4
    assert one(df.select(t.sprintf("%s|%5s|%d%%", F.col("x"), F.col("y"), F.col("n")).alias("s")), "s") == [("a|     |1%",), ("|    a|0%",), ("a|    a|2%",), ("|     |3%",)]


def test_edit_distances_together(spark):
    r = random.Random(5)
    text = lambda: "".join(r.choice("abc") for _ in range(r.randint(0, 9)))
    rows = [(text(), text()) for _ in range(400)] + [("x" * 300 + text(), "y" * 280 + text()) for _ in range(3)] + [(None, "a"), ("a", None), ("", ""), ("é🙂", "🙂é")]
    got = spark.createDataFrame(rows, "a string, b string").coalesce(1).select("a", "b", t.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    for x in got:
        assert x["d"] == (None if x["a"] is None or x["b"] is None else t.damerau_levenshtein(x["a"], x["b"])), x


def test_flatten_says_what_it_cut(spark):
    deep = lambda n: '{"a":' * n + "1" + "}" * n
    wide = json.dumps({f"k{i}": i for i in range(12)})
    many = lambda n: '{"o":{"l":[' + ",".join('{"v":1}' for _ in range(n)) + "]}}"
    rows = [deep(3), deep(64), deep(70), wide, many(16), many(17), many(1000), '{"l":[1,2],"e":{},"s":"{x"}', "{}", "nonsense", '{"a":1,"a":{"b":2}}', "{'a':{'b':1}}"]
    f = readers.string_map(F.col("value"))
    got = strings(spark, *rows).select(nz.flattened(f, most=10).alias("f")).select("f.*").collect()
    assert [r["truncated"] for r in got] == [False, False, True, True, True, False, False, False, False, None, False, False]
    assert got[1]["fields"] == {"_".join("a" * 64): "1"} and len(got[3]["fields"]) == 10 and len(got[4]["fields"]) == 10 and got[8]["fields"] == {}
    assert json.loads(got[6]["fields"]["o_l"]) == [{"v": 1}] * 1000 and got[7]["fields"] == {"l": "[1,2]", "s": "{x"}
    assert got[10]["fields"] == {"a_b": "2"} and got[11]["fields"] == {"a_b": "1"}


def flat(fields, depth=64):
    """Fields of parsed JSON, opened as flatten() does."""
    out = {}
    text = lambda v: v if isinstance(v, str) else "" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else json.dumps(v, separators=(",", ":"), sort_keys=True, ensure_ascii=False)

    def walk(prefix, o):
        for k, v in o.items():
            name = f"{prefix}_{k}".replace(".", "_") if prefix else k.replace(".", "_")
            if isinstance(v, dict):
                walk(name, v)
            elif prefix and isinstance(v, list) and 0 < len(v) <= 16 and all(isinstance(x, dict) for x in v):
                for i, x in enumerate(v):
                    walk(f"{name}_{i}", x)
            else:
                out.setdefault(name, text(v))

    walk("", fields)
    return out


def test_flatten_of_any_json(spark):
    r = random.Random(4)

    def value(depth):
        kind = r.randint(0, 9 if depth else 5)
        if kind < 6:
            return [r.randint(-9, 10**9), "é {x}", '{"k":[1]}', None, True, ""][kind]
        if kind == 6:
            return [value(depth - 1) for _ in range(r.randint(0, 3))]
        if kind == 7:
            return [{r.choice("ab"): value(depth - 1)} for _ in range(r.choice([1, 2, 16, 17]))]
        return {r.choice(["a", "b", "c.d", "ü"]) + str(i): value(depth - 1) for i in range(r.randint(0, 3))}

    rows = [{f"f{i}": value(4) for i in range(r.randint(0, 5))} for _ in range(300)]
    df = strings(spark, *(json.dumps(x, ensure_ascii=False) for x in rows)).coalesce(1)
    text = F.col("value")
    got = df.select(nz.flattened(readers.string_map(text), most=10**6, nested=readers.nested_keys(text)).alias("f")).select("f.*").collect()
    for x, want in zip(got, rows, strict=True):
        assert x["fields"] == flat(want) and not x["truncated"], want


@pytest.mark.parametrize("d", [0.0, -0.0, 1.0, 1e30, -1e30, 1e-7, 1.25e-300, 1.7976931348623157e308, 123456.789, 0.001, 9999999.5, 1e7, 12345678901234567890.0])
def test_plain_numbers(spark, d):
    from decimal import Decimal

    text = spark.createDataFrame([(d,)], "d double").select(nz.plain_number(F.col("d"))).first()[0]
    assert "E" not in text and float(text) == d and text == (format(Decimal(repr(d)).normalize(), "f") if d else "-0" if str(d) == "-0.0" else "0")


def test_typed_flags_pass_through_parse_json(spark):
    rows = readers.parse_json(strings(spark, '{"a":{"b":1},"s":"{\\"c\\":2}"}'), nested="objects").collect()
    assert rows[0]["objects"] == ["a"] and rows[0]["fields"] == {"a": '{"b":1}', "s": '{"c":2}'}


@pytest.mark.parametrize(("parts", "keys"), [(None, ["k", "j"]), (7, ["k", "j"]), (9, ["j"]), (12, [])])
def test_spaced_rows(spark, parts, keys):
    r = random.Random(2)
    rows = {(r.choice(["a", "b", None]), r.choice([1, 1, 1, 2]), r.randint(0, 4000)) for _ in range(900)} | {("c", 3, 5)}
    # at is there once for each key
    rows = [*{(*(dict(zip("kj", x[:2], strict=True))[k] for k in keys), x[2]): x for x in sorted(rows, key=str)}.values()]
    df = spark.createDataFrame(rows, "k string, j int, at long").repartition(3)
    for gap in (25, 900):
        got = collections.defaultdict(list)
        for x in sequence.spaced(df, keys, "at", gap, parts).collect():
            got[tuple(x[k] for k in keys)].append(x["at"])
        for key in {tuple(dict(zip("kj", x[:2], strict=True))[k] for k in keys) for x in rows}:
            want, last = [], None
            for at in sorted(x[2] for x in rows if tuple(dict(zip("kj", x[:2], strict=True))[k] for k in keys) == key):
                if last is None or at >= last + gap:
                    want.append(at)
                    last = at
            assert sorted(got[key]) == want, (key, gap)
    assert sequence.spaced(df.limit(0), keys, "at", 5, parts).count() == 0


def test_chains_end_where_a_walk_ends():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(200):
        values, gap = np.unique(r.integers(0, 300, r.integers(1, 120))), int(r.integers(1, 80))
        entries, ends = sequence._ends(values, gap)
        assert len(entries) == min(len(values), int((values < values[0] + gap).sum()) + 1)
        for e, end in zip(entries, ends, strict=True):
            assert sequence._kept(values[values >= e], None, gap)[1] == end



def test_tenants_have_baselines_and_trees_of_their_own(spark):
    columns = "tenant_id string, timestamp timestamp, log_id string, category string, process_guid string, parent_guid string, image string, parent_image string, computer_name string, target_file string"
    now = datetime(2024, 1, 1)
    row = lambda tenant, n, child, parent, image: (tenant, now, f"{tenant}{n}", "process_creation", child, parent, image, "p.exe", "h", None)
    rows = [row("t1", 1, "c", "r", "only.exe"), row("t1", 2, "r", "", "root.exe"), row("t2", 1, "c", "x", "only.exe")] + [row("t2", 2 + k, f"o{k}", "r", f"other{k % 9}.exe") for k in range(180)]
    events = spark.createDataFrame(rows, columns)
    events = events.where("not (tenant_id = 't1' and process_guid = 'r')").unionByName(events.where("tenant_id = 't1' and process_guid = 'r'").withColumn("parent_image", F.lit("")))
    line = pv.build_lineage(events)
    scored = pv.score_edges(pv.spawn_edges(line), pv.build_frequency(events), pv.hosts_of(line))
    got = {(r["tenant_id"], r["child"]): r["anomaly_score"] for r in scored.collect()}
    assert got["t1", "c"] == 0.0 and got["t2", "c"] == pytest.approx(1 - 1 / 181, abs=1e-4)  # all that t1's parent ever starts
    seeds = spark.createDataFrame([("t1", "r")], "tenant_id string, start string")
    assert sorted(one(graph.tree_ids(line, "process_guid", "parent_guid", seeds, scope=["tenant_id"]), "tenant_id", "id")) == [("t1", "c"), ("t1", "r")]
    up = {(r["tenant_id"], r["child"]): r["anomaly_score"] for r in pv.diffuse(scored).collect()}
    assert up["t1", "c"] == 0.0 and up["t2", "c"] > 0.9
    assert {r["tenant_id"] for r in pv.provenance(events, seeds).collect()} == {"t1"}
    assert pv.provenance(events, spark.createDataFrame([("t2", "x"), ("t2", "o3")], "tenant_id string, start string"), most=1).count() == 1


def test_rule_cases_alone_and_together(spark):
    events = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "a"), ("c2", "a"), ("c3", "b")], "case_id string, kind string")
    cases = [("c1", "match", None, False, False), ("c1", "match", None, True, True), ("c1", "match", 2, True, False), ("c1", "no_match", None, False, False), ("c2", "match", None, False, True), ("c2", "match", 2, True, True), ("c3", "no_match", None, True, True), ("c4", "match", None, False, False), ("c4", "no_match", None, False, True)]
    for case, expect, count, together, want in cases:
        df = spark.createDataFrame([(case, "r", expect, count, together)], "case_id string, rule_id string, expect string, count long, together boolean")
        assert rules.rule_test(events, {"r": {"selections": {"s": {"kind": "a"}}, "when": "s"}}, df).first()["passed"] == want, (case, expect, count, together)


def test_rules_by_index_are_those_of_all(spark):
    """Random rules over random rows, nulls and empty texts among them, with and without counts."""
    rng = random.Random(5)
    words = ["", "a", "ab", "B", "abc", "İx", "x y", "cab", "ünï"]
    rows = [(i, rng.choice([*words, None]), rng.choice([*words, None]), rng.choice(["file_write", "dns_query", None]), {"f": rng.choice(words)} if i % 3 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, one string, two string, category string, fields map<string,string>")

    def entry():
        name = rng.choice(["one", "two", "f", "gone", "id"]) + rng.choice(["", "|contains", "|startswith", "|endswith", "|contains|all", "|re"])
        return {name: rng.choice([rng.choice(words), [rng.choice(words) for _ in range(rng.randrange(1, 3))]]) if rng.random() < 0.9 else [None]}

    def when(depth=0):
        kind = rng.choice(["name", "and", "or", "not", "1 of", "all of"]) if depth < 3 else "name"
        if kind == "name":
            return rng.choice(["s_a", "s_b", "t"])
        return (kind, rng.choice(["s_", "t", "none"])) if kind.endswith("of") else (kind, *(when(depth + 1) for _ in range(1 if kind == "not" else 2)))

    made = {}
    for i in range(120):
        chosen = {n: entry() | entry() if rng.random() < 0.7 else [entry(), entry()] for n in ("s_a", "s_b", "t")}
        made[f"r{i}"] = {"selections": chosen, "when": when()} | ({"category": rng.choice(["file_event", "dns_query", "other"])} if rng.random() < 0.3 else {})
    want = sorted(one(rules.rule_match(df, made), "id", "rule_id"))
    assert sorted(one(rule_index.rule_match_indexed(df, made), "id", "rule_id")) == want and want
    counts = rule_index.key_rows(df, made)
    assert sorted(one(rule_index.rule_match_indexed(df, made, counts), "id", "rule_id")) == want
    assert rule_index.rule_match_indexed(df.limit(0), made).count() == 0 == rule_index.rule_match_indexed(df, {}).count()


def test_rules_are_looked_up_by_their_rarest_texts():
    rule = {"category": "dns_query", "selections": {"a": {"x|contains": ["common", "word"], "y": "Rare"}, "no": {"z": "z"}}, "when": ("and", "a", ("not", "no"))}
    n = {("x", False, "common"): 90, ("x", False, "word"): 5, ("y", True, "rare"): 99, ("category", True, "dns_query"): 999}
    assert rule_index.required(rule, lambda need: sum(n[k] for k in need)) == {("x", False, "common"), ("x", False, "word")}
    assert rule_index.required({"selections": {"a": {"x|re": "y"}, "b": {"x": "k"}}, "when": ("or", "a", "b")}, len) is None
    assert rule_index.required({"selections": {}, "when": ("1 of", "a")}, len) == frozenset()


def test_sketches_of_days_are_those_of_all(spark):
    """The union of days, and of weeks of days, tells what a sketch of all rows tells, within the errors given."""
    df = spark.range(60_000).selectExpr("if(id % 10 = 9, null, if(id % 3 = 0, id % 20, id % 30000)) as v", "cast(id % 2 as string) as k", "date_add(date'2024-01-01', cast(id % 13 as int)) as day", "id as n")
    exact = {r["k"]: r for r in df.groupBy("k").agg(F.count("v").alias("rows"), F.count_distinct("v").alias("values")).collect()}
    often = {(r["k"], str(r["v"])): r["c"] for r in df.groupBy("k", "v").agg(F.count("*").alias("c")).collect()}
    sizes = {"registers": 10, "followed": 64}
    days = sketches.sketch_state(df, "v", ["k"], F.col("day"), **sizes)
    weeks = sketches.merge_sketches(days, ["k"], F.trunc("span", "week"))
    assert days.count() == 26 and weeks.count() == 4
    for state in (sketches.sketch_state(df, "v", ["k"], **sizes), sketches.merge_sketches(days, ["k"]), sketches.merge_sketches(weeks, ["k"])):
        found = sketches.sketch_report(state, 3, **sizes).collect()
        assert len(found) == 2
        for r in found:
            assert r["n"] == exact[r["k"]]["rows"] and abs(r["distinct"] - exact[r["k"]]["values"]) <= 4 * r["distinct_error"] and r["top_error"] > 0 and r["top"]
            assert all(abs(x["count"] - often[r["k"], x["item"]]) <= r["top_error"] for x in r["top"])
    whole = sketches.sketch_report(sketches.merge_sketches(days), 2, **sizes).collect()
    assert len(whole) == 1 and whole[0]["n"] == 54_000
    assert sketches.sketch_report(sketches.sketch_state(df.where("v is null"), "v", ["k"])).count() == 0


def test_top_of_more_values_than_are_followed(spark):
    """Counts are exact in groups with more values than a sketch follows, of null keys and of days, too."""
    df = spark.range(30_000).selectExpr("if(id % 11 = 0, null, id % 3000 + if(id < 200, 0, id div 3000)) as v", "if(id % 3 = 0, null, cast(id % 3 as string)) as k", "date_add(date'2024-01-01', cast(id % 4 as int)) as day")
    few = spark.range(90).selectExpr("id % 7 as v", "'few' as k", "date'2024-01-01' as day")
    both, sizes = df.unionByName(few), {"registers": 10, "followed": 64}
    days = sketches.sketch_state(both, "v", ["k"], F.col("day"), **sizes)
    counts = collections.Counter((r["k"], r["day"], str(r["v"])) for r in both.where("v is not null").collect())
    for span, state in ((None, sketches.merge_sketches(days, ["k"])), (F.col("day"), days)):
        want = collections.defaultdict(collections.Counter)
        for (k, day, v), n in counts.items():
            want[k, None if span is None else day][v] += n
        report = sketches.sketch_report(state, 4, **sizes)
        assert {r["top_error"] > 0 for r in report.collect()} == {True, False}
        found = {(r["k"], r["span"]): r for r in sketches.exact_top(report, both, "v", ["k"], span, 4).collect()}
        assert found.keys() == want.keys() and all(r["top_error"] == 0 for r in found.values())
        for group, r in found.items():
            assert [x["count"] for x in r["top"]] == sorted(want[group].values(), reverse=True)[:4] and all(want[group][x["item"]] == x["count"] for x in r["top"])


def test_daily_sketches_of_many_users_equal_sql(spark, tmp_path):
    import duckdb
    from oracle import rows_of_query, rows_of_sql

    from loglens.queries import ORACLES, QUERIES

    kinds = "CASE i % 4 WHEN 0 THEN 'few' WHEN 1 THEN 'hot' WHEN 2 THEN 'flat' END"
    users = "CASE i % 4 WHEN 0 THEN i % 900 WHEN 1 THEN CASE WHEN i % 5 = 0 THEN i % 7 ELSE i END WHEN 2 THEN CASE WHEN i < 20000 THEN i % 7000 ELSE i END END"
    duckdb.connect().execute(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_hours(CAST(i % 50 AS BIGINT)) AS ts, {users} AS user_id, {kinds} AS event_type FROM range(160000) t(i)) TO '{tmp_path}/events.parquet'")
    assert rows_of_query(QUERIES["g4_daily_sketches"](spark, str(tmp_path))) == rows_of_sql(str(tmp_path), ORACLES["g4_daily_sketches"])


def test_coverage_totals(spark):
    tech = spark.createDataFrame([("T1002", "", False, ["x"]), ("T1000", "", False, ["x", "y"]), ("T1000.001", "T1000", False, ["y"]), ("T1001", "", True, ["x"])], "id string, parent string, deprecated boolean, tactics array<string>")
    made = [(1, ["attack.t1000.001"]), (2, ["attack.execution"]), (3, ["attack.t1001"]), (4, ["attack.t9999", "attack.impact"]), (5, ["other"]), (6, [])]
    own = spark.createDataFrame([(i, True, "Informational", x) for i, x in made], "id int, enabled boolean, severity string, labels array<string>")
    assert rules.coverage_summary(own, tech).first().asDict() == {"rules": 6, "mapped": 1, "tactic_only": 1, "retired": 2, "unmapped": 2, "techniques": 3, "covered": 2, "leaves": 2, "covered_leaves": 1}
    assert sorted(one(rules.coverage_by_tactic(own, tech), "tactic", "techniques", "covered")) == [("x", 2, 1), ("y", 2, 2)]
    assert {r["max_severity"] for r in rules.attack_coverage(own, tech).collect()} == {"info"}


def test_archive_is_compacted_and_cut(spark, tmp_path):
    path = str(tmp_path / "archive")
    day = lambda d, k: spark.range(10 * k, 10 * k + 10).select(F.lit(datetime(2024, 1, d)).alias("timestamp"), F.col("id").cast("string").alias("log_id"), F.lit("t :1%").alias("tenant_id"), F.lit(date(2024, 1, d)).alias("ingest_date"), F.create_map(F.lit("user"), F.lit("u")).alias("fields"))
    for k in range(3):
        archive.write_archive(day(1, k).unionByName(day(2, k + 3)).coalesce(1), path, ("user",))
    rows = archive.read_archive(spark, path)
    chosen = archive.small_partitions(rows, 1 << 20, date(2024, 1, 2))
    assert [r["files"] for r in chosen.collect()] == [3]
    files = lambda: {r["ingest_date"].day: r["n"] for r in archive.read_archive(spark, path).groupBy("ingest_date").agg(F.count_distinct("_metadata.file_path").alias("n")).collect()}
    archive.compact(spark, path, chosen)
    spark.catalog.refreshByPath(path)
    assert files() == {1: 1, 2: 3} and archive.read_archive(spark, path).count() == 60 and archive.read_archive(spark, path).select("log_id").distinct().count() == 60
    archive.write_archive(day(1, 9), path, ("user",))
    assert files() == {1: 2, 2: 3}
    gone = archive.read_archive(spark, path).where("ingest_date = date '2024-01-02'").select("tenant_id", "ingest_date")
    assert archive.delete_partitions(spark, path, gone) == 1
    spark.catalog.refreshByPath(path)
    assert files() == {1: 2} and archive.read_archive(spark, path).count() == 40
    found, hit = archive.archive_search(archive.read_archive(spark, path), date(2024, 1, 1), date(2024, 1, 1), lambda x: x.orderBy(F.col("log_id").cast("int").desc()), 3)
    assert one(found, "log_id") == [("99",), ("98",), ("97",)] and hit.first()[0]


def test_backfill_goes_on(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = spark.createDataFrame([(datetime(2024, 1, d, h), f"u{d}") for d in (1, 2, 3) for h in (0, 23)], "ts timestamp, user string")
    state = lambda df: models.first_seen_state(df, "user", "ts")
    span = (date(2024, 1, 1), date(2024, 1, 3))
    assert models.backfill(rows, "ts", path, state, span[0], date(2024, 1, 2)) == [date(2024, 1, 1), date(2024, 1, 2)]
    assert models.backfill(rows, "ts", path, state, *span) == [date(2024, 1, 3)] and models.backfill(rows, "ts", path, state, *span) == []
    assert len(models.backfill(rows, "ts", path, state, *span, again=True)) == 3
    assert sorted(one(models.first_seen_score(spark.read.parquet(path), datetime(2024, 2, 1)), "entity", "n")) == [("u1", 2), ("u2", 2), ("u3", 2)]


def test_sliding_alert_on_a_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, m), "u") for m in (1, 9, 12)] + [(datetime(2024, 1, 1, 9), "u")]
    spark.createDataFrame(rows, "t timestamp, k string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "in"))
    q = jobs.sliding_alert(stream, "t", "10 minutes", "5 minutes", ["k"], 2).writeStream.format("memory").queryName("sliding").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["as_of"].minute, r["n"]) for r in spark.table("sliding").collect()) == [(10, 2), (15, 2)]


def test_newest_span(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 2) - timedelta(minutes=m),) for m in range(120)], "t timestamp")
    assert profile.newest_span(df, 600, "t", datetime(2024, 1, 2)) == timedelta(hours=10)
    assert profile.newest_span(df, 600, "t", datetime(2025, 1, 2)) == timedelta(days=30)


def test_flatten_collisions(spark):
    df = strings(spark, '{"a":{"b":"1","c":{"b":"2"}},"l":[{"v":"x"},{"v":"y"}],"n":null,"e":{}}')
    f = readers.string_map(F.col("value"))
    assert df.select(nz.flatten(f).alias("f")).first()["f"] == {"a_b": "1", "a_c_b": "2", "l": '[{"v":"x"},{"v":"y"}]', "n": ""}
    assert df.select(nz.flatten(f, leaf=True).alias("f")).first()["f"] == {"a_b": "1", "a_c_b": "2", "l": '[{"v":"x"},{"v":"y"}]', "n": ""}
    deep = strings(spark, '{"a":{"only":"1"}}')
    assert deep.select(nz.flatten(f, leaf=True).alias("f")).first()["f"] == {"only": "1"}


@pytest.mark.parametrize(("how", "want"), [("snake", "my_field._name"), ("camel", "myField.Name"), ("pascal", "MyField.Name"), ("dedot", "myField_Name"), ("uppercase", "MYFIELD.NAME")])
def test_names(spark, how, want):
    assert spark.range(1).select(nz.rename_fields(F.create_map(F.lit("myField.Name"), F.lit("v")), how).alias("f")).first()["f"] == {want: "v"}


def test_lenient_times(spark):
    df = strings(spark, "1704067200", "1704067200000", "1704067200000000", "1704067200000000000", "2024-01-01 00:00:00", "2024-01-01T00:00:00Z", "nonsense", None)
    from loglens.functions.fields import lenient_timestamp

    got = one(df.select(lenient_timestamp(F.col("value")).alias("t")), "t")
    assert got[:6] == [(datetime(2024, 1, 1),)] * 6 and got[6:] == [(None,), (None,)]


def sequence_of(spark, text, within=None):
    rows = [("e", datetime(2024, 1, 1) + timedelta(seconds=10 * i), i, c) for i, c in enumerate(text)]
    df = spark.createDataFrame(rows, "entity string, ts timestamp, id int, kind string")
    out = sequence.chain(df, "entity", [F.col("kind") == "A", F.col("kind") == "B"], "ts", "id", within).collect()
    return out[0]["chain_count"] if out else 0


@pytest.mark.parametrize(("text", "n"), [("AxBAxB", 2), ("AAB", 1), ("BA", 0), ("ABAB", 2), ("AB", 1), ("xx", 0)])
def test_chain_counts(spark, text, n):
    assert sequence_of(spark, text) == n


def test_chain_within(spark):
    assert sequence_of(spark, "AxB", within=10) == 0 and sequence_of(spark, "AxB", within=20) == 1


def test_correlate_joins_all_keys_unless_limited(spark):
    df = spark.range(10_050).withColumnRenamed("id", "k")
    sub = df.withColumn("c", F.col("k") * 2)
    assert enrich.correlate(df, sub, ["k"]).count() == 10_050
    assert enrich.correlate(df, sub, ["k"], how="left").where("_join_c is null").count() == 0
    assert sorted(one(enrich.correlate(df, sub, ["k"], most=3), "k", "_join_c")) == [(0, 0), (1, 2), (2, 4)]


def pair(times, sizes=None):
    return (("a", "b", "443", len(times), times, sizes or [1024.0] * len(times), times[0], times[-1]),)


PAIR = "src string, dst string, port string, n long, ts array<long>, sizes array<double>, first_ts long, last_ts long"


def test_beacons(spark):
    regular = [300 * i for i in range(288)]
    jitter = [300 * i + ((i * 97) % 281) - 140 for i in range(1, 288)]
    score = lambda ts: models.beacon_score(spark.createDataFrame(pair(ts), PAIR), 86_400).first()
    best = score(regular)
    assert best["beacon"] >= 0.95 and min(best["ts_score"], best["ds_score"], best["dur_score"], best["hist_score"]) >= 0.99
    assert score(sorted(jitter))["beacon"] < best["beacon"]
    assert score([0, 1, 2])["beacon"] == 0.0


def test_pairs_are_scored_on_their_whole_history(spark):
    """Regular for 2500 connections, then not: the scores are those of all rows, null ports included."""
    r, start = random.Random(1), 1_704_067_200
    hot = [start + 300 * i for i in range(2500)]
    hot += [hot[-1] + 7 * (i + 1) ** 2 % 500_000 + i * 40 for i in range(1200)]
    rows = [("a", "b", p, t, r.choice([100.0, 100.0, 250.0, 900.0 + r.randint(0, 99)]), 1.0) for p, ts in (("443", hot), (None, hot[:700:3]), ("1", hot[:2]), ("2", [start] * 5)) for t in ts]
    df = spark.createDataFrame(rows, "src string, dst string, port string, t long, size double, d double").repartition(5)
    state = models.network_state(df.withColumn("ts", F.timestamp_seconds("t")), "src", "dst", "port", "ts", "size", "d")
    keys = ["src", "dst", "port"]
    lists = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("t")).alias("ts"), F.collect_list("size").alias("sizes"), F.min("t").alias("first_ts"), F.max("t").alias("last_ts"))
    names = ("n", "beacon", "ts_score", "ds_score", "dur_score", "hist_score")
    want = {x["port"]: tuple(x[c] for c in names) for x in models.beacon_score(lists, 90 * 86_400).collect()}
    assert {x["port"]: tuple(x[c] for c in names) for x in models.score_pairs(state, 90 * 86_400).collect()} == want
    # the regular part of a pair takes few rows, and days merge to what all rows are as one span
    once = models.network_state(df.where("size < 900 and t < 1704810000").withColumn("ts", F.timestamp_seconds("t")), "src", "dst", "port", "ts", "size", "d")
    assert once.where("port = '443'").count() < 10 * 40 < df.where("size < 900 and t < 1704810000 and port = '443'").count()
    whole = models.network_state(df.withColumn("ts", F.timestamp_seconds("t")), "src", "dst", "port", "ts", "size", "d", every=None)
    rows = lambda x: sorted(map(str, x.drop("span").collect()))
    week = models.network_state(df.withColumn("ts", F.timestamp_seconds("t")), "src", "dst", "port", "ts", "size", "d", every=7 * 86_400)
    assert rows(models.merge_network(state)) == rows(whole) == rows(models.merge_network(week)) == rows(models.merge_network(whole))


@pytest.mark.parametrize(("seconds", "want"), [(3599, 0.0), (3600, 0.0), (14_400, 0.25), (28_800, 0.5), (43_200, 0.75), (86_400, 1.0), (10**6, 1.0)])
def test_long_connections(spark, seconds, want):
    assert spark.range(1).select(models.long_conn_score(F.lit(float(seconds)))).first()[0] == want


def test_coverage_counts_a_rule_once(spark):
    tech = spark.createDataFrame([("T1543", "", False, 3), ("T1543.003", "T1543", False, 1), ("T1001", "", False, 2)], "id string, parent string, deprecated boolean, log_sources int")
    made = [(1, True, "low", ["attack.t1543.003"]), (2, False, "high", ["attack.t1543_003", "attack.t1543"]), (3, True, "low", ["attack.execution", "other"])]
    cov = rules.attack_coverage(spark.createDataFrame(made, "id int, enabled boolean, severity string, labels array<string>"), tech)
    got = {r["id"]: (r["direct"], r["inherited"], r["enabled"], r["max_severity"]) for r in cov.collect()}
    assert got == {"T1543.003": (2, 0, 1, "high"), "T1543": (1, 1, 1, "high")}
    gaps = rules.coverage_gaps(tech, cov, spark.createDataFrame([("p", ["attack.t1001"])], "path string, labels array<string>"))
    assert one(gaps, "id", "available", "score") == [("T1001", 1, 1002)]


def test_tree_with_a_cycle_ends(spark):
    df = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b")], "child string, parent string")
    seeds = spark.createDataFrame([("a",)], "start string")
    assert sorted(one(graph.tree_ids(df, "child", "parent", seeds), "id", "depth")) == [("a", 0), ("b", 1), ("c", 2)]
    assert graph.bfs(df, "child", "parent", seeds, 5).count() == 6


@pytest.mark.parametrize("direction", ["forward", "backward", "both"])
def test_jumps_reach_what_levels_reach(spark, direction):
    """Forests with cycles, several parents, parents that don't exist, nulls and two tenants, at depths around powers of two."""
    rng = random.Random(3)
    rows = [(t, i, rng.choice([None, -1, rng.randrange(40), (i - 1) % 40])) for t in "ab" for i in range(40)] + [("a", 5, 7), ("a", 5, 9), ("b", None, 3), (None, 1, 2)]
    df = spark.createDataFrame(rows, "t string, c int, p int")
    seeds = spark.createDataFrame([("a", 3), ("a", 20), ("b", 20), ("b", 99), ("a", None)], "t string, start int")
    jumps = graph.jump_table(df, "c", "p", 9, ["t"])
    for depth, by_seed in ((3, False), (4, True), (9, True)):
        want = graph.tree_ids(df, "c", "p", seeds, depth, direction, scope=["t"], by_seed=by_seed)
        got = graph.tree_ids_by_jumps(df, "c", jumps, seeds, depth, direction, ["t"], by_seed)
        assert sorted(one(got, *want.columns)) == sorted(one(want, *want.columns))


def test_jumps_of_a_long_chain(spark):
    df = spark.range(200).selectExpr("id as c", "if(id = 0, null, id - 1) as p")
    jumps = graph.jump_table(df, "c", "p", 199)
    assert jumps.select("k").distinct().count() == 8
    found = graph.tree_ids_by_jumps(df, "c", jumps, spark.createDataFrame([(199,)], "start long"), 199, "backward")
    assert sorted(one(found, "id", "depth")) == [(i, 199 - i) for i in range(200)]
    assert graph.jump_table(df.limit(0), "c", "p").count() == 0


def test_throttle(spark):
    rows = [("a", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 5, 9, 10, 19, 20, 31)]
    got = jobs.throttle(spark.createDataFrame(rows, "k string, t timestamp"), ["k"], "t", 10)
    assert sorted(r["t"].second for r in got.collect()) == [0, 10, 20, 31]


def test_window_alert_on_a_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, m), "u") for m in (1, 2, 3, 40)] + [(datetime(2024, 1, 1, 9), "u")]
    spark.createDataFrame(rows, "t timestamp, k string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "in"))
    out = jobs.window_alert(stream, "t", "10 minutes", ["k"], 3)
    q = out.writeStream.format("memory").queryName("alerts_seen").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["window_start"].minute, r["n"]) for r in spark.table("alerts_seen").collect()] == [(0, 3)]


def stop_when(query, done, seconds=40):
    """A query that works as time passes doesn't end by itself."""
    import time

    end = time.time() + seconds
    while time.time() < end and query.isActive and not done():
        time.sleep(0.5)
    query.stop()


def test_throttle_on_a_stream(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 5, 10, 21)]
    spark.createDataFrame(rows, "k string, t timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
    q = jobs.throttle_stream(stream, ["k"], "t", 10).writeStream.format("memory").queryName("throttled").outputMode("append").trigger(processingTime="1 second").start()
    stop_when(q, lambda: spark.table("throttled").count() == 3)
    assert sorted(r["t"].second for r in spark.table("throttled").collect()) == [0, 10, 21]


def test_throttled_keys_are_forgotten(spark, tmp_path):
    """A key's state goes when its span has passed since it fired, by the clock of arrival."""
    rows = [("a", datetime(2024, 1, 1, 0, 0, 0)), ("a", datetime(2024, 1, 1, 0, 0, 2)), ("b", datetime(2024, 1, 1, 0, 0, 1))]
    spark.createDataFrame(rows, "k string, t timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
    q = jobs.throttle_stream(stream, ["k"], "t", 3).writeStream.format("memory").queryName("forgotten").outputMode("append").trigger(processingTime="1 second").start()
    held = lambda: [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    stop_when(q, lambda: 2 in held() and held()[-1] == 0)
    assert 2 in held() and held()[-1] == 0 and spark.table("forgotten").count() == 2


def test_firings_of_an_alert(spark):
    hits = spark.createDataFrame([("u2", datetime(2024, 1, 1, 0, 0, 5)), ("u1", datetime(2024, 1, 1, 0, 0, 1)), (None, datetime(2024, 1, 1, 0, 0, 3))], "user string, t timestamp")
    assert [(r["alert"], r["value"], r["t"].second) for r in jobs.alert_firings(hits, "x", "t", "user").collect()] == [("x", "u1", 5)]
    assert jobs.alert_firings(hits, "x", "t").first()["value"] is None and jobs.alert_firings(hits.limit(0), "x", "t", "user").count() == 0


@pytest.mark.parametrize("by", [["tenant_id"], ["tenant_id", "start"]])
def test_peers_are_ranked_within_a_tree(spark, by):
    r = random.Random(6)
    rows = [(t, s, r.choice(["file", "net"]), f"src{r.randint(0, 3)}", f"p{r.randint(0, 12)}", f"o{r.randint(0, 8)}", "l") for t in ("t1", "t2", "t3") for s in ("a", "b") for _ in range(60)]
    rows.append(("t4", "a", "file", "src0", "only", "o1", "l"))
    peers = spark.createDataFrame(rows, "tenant_id string, start string, recon_type string, src_guid string, peer_guid string, object_id string, label string")
    peers = peers.withColumn("anomaly", F.when(F.col("recon_type") == "file", 1.0).otherwise(0.85))
    peers = peers if "start" in by else peers.drop("start")
    got = {tuple(x) for x in pv.rank_peers(peers, 3).select(*by, "peer_guid").distinct().collect()}
    things, best = collections.defaultdict(set), collections.defaultdict(float)
    for t, s, kind, _, p, o, _ in rows:
        key = (t, s, p) if "start" in by else (t, p)
        things[key].add(o)
        best[key] = max(best[key], 1.0 if kind == "file" else 0.85)
    want = set()
    for tree in {k[:-1] for k in things}:
        own = sorted((k for k in things if k[:-1] == tree), key=lambda k: (-len(things[k]), -best[k], k[-1]))
        want |= set(own[:3])
    assert got == want and any("only" in k for k in got)
    starts = {tuple(x) for x in pv.expandable(peers, 2, 0.9).collect()}
    more = set()
    for tree in {k[:-1] for k in things}:
        more |= {(k[0], k[-1]) for k in sorted((k for k in things if k[:-1] == tree and best[k] >= 0.9), key=lambda k: (-best[k], k[-1]))[:2]}
    assert starts == more
    assert pv.rank_peers(peers, None).count() == len(rows)


def test_reconnect_ranks_before_it_pairs(spark):
    r = random.Random(8)
    line = spark.createDataFrame([(f"t{i % 3}", f"p{i}", f"C:\\app{r.randint(0, 3)}.exe") for i in range(90)], "tenant_id string, process_guid string, image string")
    edges = spark.createDataFrame([(f"t{i % 3}", f"p{i}", r.choice(["file_write", "process_access"]), f"C:\\app{r.randint(0, 5)}.exe", f"n{r.randint(0, 5)}", "x") for i in range(30) for _ in range(4)], "tenant_id string, process_guid string, event_type string, label string, dst_node string, fkey_tgt string")
    freq = spark.createDataFrame([], "tenant_id string, event_type string, target_norm string, host string, src_image string")
    tree = spark.createDataFrame([(f"t{i % 3}", f"p{i}", f"s{i % 2}") for i in range(30)], "tenant_id string, process_guid string, start string")
    for own in (tree, tree.drop("start")):
        every = pv.rank_peers(pv.reconnect(own, edges, line, freq), 4)
        few = pv.reconnect(own, edges, line, freq, 4)
        assert every.columns == few.columns
        assert sorted(map(tuple, every.collect())) == sorted(map(tuple, few.collect())) and few.count() > 0


@pytest.mark.parametrize("keys", [[], ["g", "h"]])
def test_quantiles_in_passes(spark, keys):
    r = random.Random(9)
    numbers = [0.0, -0.0, 1.5, -1.5, 1e308, -1e308, 5e-324, 3.0, 3.0, 3.0]
    rows = [(r.choice(["a", "b", None]), r.choice([1, None]), r.choice([*numbers, r.uniform(-1e6, 1e6), r.gauss(0, 1e-6)])) for _ in range(700)] + [("few", 1, 2.0), ("few", 1, None), ("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, h int, x double").repartition(5)
    shares = (0.0, 0.1, 0.5, 0.503, 0.99, 1.0)
    from loglens.operators.quantiles import quantiles

    got = lambda bound: {tuple(x[k] for k in keys): x["q"] for x in quantiles(df, F.col("x"), keys, shares, bound).collect()}
    plain, passes = got(10**6), got(5)
    assert passes.keys() == plain.keys() and len(plain) == (7 if keys else 1)
    for k, want in plain.items():
        assert passes[k] == pytest.approx(want, rel=1e-12, abs=1e-300), k


def test_quantiles_of_one_large_group(spark):
    from loglens.operators.quantiles import quantiles

    df = spark.range(0, 400_000, 1, 8).select((F.col("id") * 7919 % 400_009).cast("double").alias("x"))
    q = quantiles(df, F.col("x"), [], (0.5, 0.9), 1000).first()["q"]
    import numpy as np

    want = np.quantile((np.arange(400_000) * 7919 % 400_009).astype(float), [0.5, 0.9]).tolist()
    assert q == pytest.approx(want)


def test_parentheses_in_a_class_are_no_groups(spark):
    df = strings(spark, "a(7", "a?7", "x]8")
    got = t.regex_groups(df, "value", r"(a)[(](?<n>\d)").collect()
    assert [r["n"] for r in got] == ["7", "", ""]
    assert [r["v"] for r in df.select(t.regex_all(F.col("value"), r"[(]\d").alias("v")).collect()] == [["(7"], [], []]


def test_large_days_are_cut(spark, tmp_path):
    rows = spark.range(40_000).select(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 2).alias("timestamp"), F.sha2(F.col("id").cast("string"), 256).alias("log_id"), F.lit("t").alias("tenant_id"), F.lit(date(2024, 1, 1)).alias("ingest_date"), F.create_map(F.lit("x"), F.sha2(F.col("id").cast("string"), 512)).alias("fields"))
    path = str(tmp_path / "a")
    for k in (0, 1):
        archive.write_archive(rows.where(F.col("timestamp").cast("long") / 2 % 2 == k), path, ())
    chosen = archive.small_partitions(archive.read_archive(spark, path), 1 << 40, date(2024, 2, 1))
    archive.compact(spark, path, chosen, 1 << 20)
    files = archive.read_archive(spark, path).groupBy(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).agg(F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).collect()
    assert sum(r["n"] for r in files) == 40_000 and len(files) >= 3 and max(r["s"] for r in files) < 4 << 20
