"""Detection rules as conditions, all matched in one scan; tests of rules; technique coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import field
from ..functions.predicates import contains_any, eq, exists, matches

# Categories of rules and of events.
CATEGORIES = {
    "process_creation": "process_creation",
    "file_event": "file_write",
    "network_connection": "network_connect",
    "dns_query": "dns_query",
    "create_remote_thread": "remote_thread",
    "process_access": "process_access",
}


def event_category(rule_category: Column) -> Column:
    """The events' category for a rule's; an unknown one is kept."""
    out = rule_category
    for a, b in CATEGORIES.items():
        out = F.when(rule_category == a, b).otherwise(out)
    return out


class Tests:
    """Conditions of many rules over one table; tests that rules share, and fields in lower case, are made once.

    Every test is true or false, never null, so nothing that is built of them is.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self.false, self.true = F.lit(False), F.lit(True)
        self.low: dict[str, Column] = {}
        self.made: dict[tuple, Column] = {}

    def lower(self, name: str) -> Column:
        if name not in self.low:
            self.low[name] = F.lower(field(self.df, name).cast("string"))
        return self.low[name]

    def any(self, tests: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, tests) if tests else self.false

    def all(self, tests: list[Column]) -> Column:
        return reduce(lambda a, b: a & b, tests) if tests else self.true

    def test(self, name: str, how: tuple[str, ...], values: list) -> Column:
        key = (name, how, tuple((type(v), v) for v in values))
        if key not in self.made:
            self.made[key] = self._test(name, how, values)
        return self.made[key]

    def _test(self, name: str, how: tuple[str, ...], values: list) -> Column:
        if values == [None]:
            return ~exists(field(self.df, name))
        kind = next((h for h in how if h in ("contains", "startswith", "endswith", "re")), None)
        if kind == "re":
            each = [matches(field(self.df, name), v) for v in values]
        elif kind and "all" not in how and kind == "contains" and len(values) > 4:
            each = [contains_any(field(self.df, name), *values)]
        elif kind:
            each = [F.coalesce(getattr(self.lower(name), kind)(v.lower()), self.false) for v in values]
        else:
            each = [self.lower(name).eqNullSafe(str(v).lower()) for v in values]
        return (self.all if "all" in how else self.any)(each)

    def selection(self, spec: dict | list) -> Column:
        """{field|modifier: value or values} with all entries, or a list of such of which one."""
        if isinstance(spec, list):
            return self.any([self.selection(s) for s in spec])
        tests = []
        for name, values in spec.items():
            column, *how = name.split("|")
            tests.append(self.test(column, tuple(how), values if isinstance(values, list) else [values]))
        return self.all(tests)

    def condition(self, rule: dict) -> Column:
        """A rule {category?, selections, when}: when is a name, or ('and' | 'or' | 'not', ...), or ('1 of' | 'all of', prefix)."""

        def build(x) -> Column:
            if isinstance(x, str):
                return self.selection(rule["selections"][x])
            op, *rest = x
            if op == "not":
                return ~build(rest[0])
            if op in ("1 of", "all of"):
                named = [build(n) for n in rule["selections"] if n.startswith(rest[0])]
                return self.any(named) if op == "1 of" else self.all(named)
            return (self.all if op == "and" else self.any)([build(r) for r in rest])

        out = build(rule["when"])
        if rule.get("category"):
            key = ("category", CATEGORIES.get(rule["category"], rule["category"]))
            if key not in self.made:
                self.made[key] = eq(field(self.df, "category"), key[1])
            out = self.made[key] & out
        return out


def selection(df: DataFrame, spec: dict | list) -> Column:
    return Tests(df).selection(spec)


def condition(df: DataFrame, rule: dict) -> Column:
    return Tests(df).condition(rule)


def conditions(df: DataFrame, rules: dict[str, dict]) -> list[Column]:
    """The condition of each rule, in order."""
    tests = Tests(df)
    return [tests.condition(r) for r in rules.values()]


def rule_match(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Rows that match, once for each rule, in one scan whatever the number of rules."""
    ids = F.filter(F.array(*(F.when(c, F.lit(i)) for i, c in zip(rules, conditions(df, rules), strict=True))), lambda x: x.isNotNull())
    return df.withColumn("rule_id", F.explode(ids))


def rule_test(events: DataFrame, rules: dict[str, dict], cases: DataFrame) -> DataFrame:
    """(case_id, rule_id, matched, passed): events have case_id, cases case_id, rule_id, expect (match, no_match), a
    count or null, and may have together.

    Each event of a case is judged alone and all must meet the expectation; together, they are one batch,
    in which one match, or count of them, is enough. A case without events fails if a match is expected.
    """
    hits = rule_match(events, rules).groupBy("case_id", "rule_id").agg(F.count("*").alias("n"))
    every = events.groupBy("case_id").agg(F.count("*").alias("all"))
    out = cases.join(hits, ["case_id", "rule_id"], "left").join(every, "case_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    together = F.coalesce("together", F.lit(False)) if "together" in cases.columns else F.lit(False)
    enough = F.when(together, F.coalesce(F.col("n") == F.col("count"), F.lit(True))).otherwise(F.col("n") == F.col("all"))
    good = F.when(F.col("expect") == "no_match", F.col("n") == 0).otherwise((F.col("n") > 0) & F.coalesce(enough, F.lit(False)))
    return out.select("case_id", "rule_id", F.col("n").alias("matched"), good.alias("passed"))


# Severities in order.
SEVERITIES = ("info", "low", "medium", "high", "critical")


def techniques_of(labels: Column) -> Column:
    """Technique ids in labels like attack.t1543.003 or attack.t1543_003."""
    plain = F.transform(labels, lambda x: F.upper(F.regexp_extract(F.replace(F.lower(F.trim(x)), F.lit("_"), F.lit(".")), r"^attack\.(t\d{4}(?:\.\d{3})?)$", 1)))
    return F.array_distinct(F.filter(plain, lambda x: x != ""))


def attack_coverage(rules: DataFrame, techniques: DataFrame) -> DataFrame:
    """(id, direct, inherited, enabled, max_severity) of each technique (id, parent, deprecated) with rules.

    A rule counts once for a technique; those of sub-techniques count for the parent unless they name it.
    """
    rank = F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), F.regexp_replace(F.lower("severity"), "^informational$", "info"))
    named = rules.select(F.col("id").alias("rule"), "enabled", rank.alias("rank"), F.explode(techniques_of(F.col("labels"))).alias("id"))
    direct = named.join(techniques.where("not deprecated").select("id", "parent"), "id")
    above = direct.where("parent is not null and parent <> ''").select("rule", "enabled", "rank", F.col("parent").alias("id")).distinct()
    above = above.join(direct.select("rule", "id"), ["rule", "id"], "left_anti")
    both = direct.select("rule", "enabled", "rank", "id", F.lit(1).alias("direct")).unionByName(above.withColumn("direct", F.lit(0)))
    out = both.groupBy("id").agg(F.sum("direct").alias("direct"), F.sum(1 - F.col("direct")).alias("inherited"), F.count_if("enabled").alias("enabled"), F.max("rank").alias("top"))
    return out.select("id", "direct", "inherited", "enabled", F.element_at(F.array(*(F.lit(s) for s in SEVERITIES)), F.col("top").cast("int")).alias("max_severity"))


def coverage_summary(rules: DataFrame, techniques: DataFrame) -> DataFrame:
    """One row of totals, rules counted by what their labels name.

    rules, mapped (a live technique), tactic_only (a tactic, no technique), retired (a deprecated or unknown
    technique), unmapped; techniques, covered, leaves (live techniques without live sub-techniques), covered_leaves.
    """
    live = techniques.where("not deprecated")
    labels = F.transform("labels", lambda x: F.replace(F.lower(F.trim(x)), F.lit("_"), F.lit(".")))
    tactic = F.exists(labels, lambda x: x.rlike(r"^attack\.[a-z][a-z.-]*$"))
    own = rules.select(F.col("id").alias("rule"), tactic.alias("tactic"), techniques_of(F.col("labels")).alias("ids"))
    named = own.select("rule", "tactic", F.explode_outer("ids").alias("id")).join(live.select("id", F.lit(True).alias("live")), "id", "left")
    by = named.groupBy("rule").agg(F.max("tactic").alias("tactic"), F.max(F.coalesce("live", F.lit(False))).alias("mapped"), F.max(F.col("id").isNotNull() & F.col("live").isNull()).alias("retired"))
    of_rules = by.agg(F.count("*").alias("rules"), F.count_if("mapped").alias("mapped"), F.count_if(F.col("tactic") & ~F.col("mapped") & ~F.col("retired")).alias("tactic_only"), F.count_if("retired").alias("retired"), F.count_if(~F.col("tactic") & ~F.col("mapped") & ~F.col("retired")).alias("unmapped"))
    covered = attack_coverage(rules, techniques).select("id", F.lit(True).alias("covered"))
    parents = live.where("parent <> ''").select(F.col("parent").alias("id"), F.lit(True).alias("split")).distinct()
    each = live.join(covered, "id", "left").join(parents, "id", "left")
    leaf, has = F.col("split").isNull(), F.col("covered").isNotNull()
    of_techniques = each.agg(F.count("*").alias("techniques"), F.count_if(has).alias("covered"), F.count_if(leaf).alias("leaves"), F.count_if(leaf & has).alias("covered_leaves"))
    return of_rules.crossJoin(of_techniques)  # one row each


def coverage_by_tactic(rules: DataFrame, techniques: DataFrame) -> DataFrame:
    """(tactic, techniques, covered) of live techniques that have an array of tactics."""
    live = techniques.where("not deprecated").select("id", F.explode("tactics").alias("tactic"))
    covered = attack_coverage(rules, techniques).select("id", F.lit(1).alias("one"))
    return live.join(covered, "id", "left").groupBy("tactic").agg(F.count("*").alias("techniques"), F.count("one").alias("covered"))


def coverage_gaps(techniques: DataFrame, coverage: DataFrame, candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """Techniques without a rule, those first that waiting rules (path, labels) and log sources would close."""
    open_ = techniques.where("not deprecated").join(coverage.select("id"), "id", "left_anti")
    named = candidates.select("path", F.explode(techniques_of(F.col("labels"))).alias("id"))
    own = named.join(techniques.select("id", "parent"), "id")
    ready = own.select("path", "id").unionByName(own.where("parent <> ''").select("path", F.col("parent").alias("id"))).groupBy("id").agg(F.count_distinct("path").alias("available"))
    out = open_.join(ready, "id", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    out = out.select("id", "available", (1000 * F.col("available") + F.least("log_sources", F.lit(999))).alias("score")).orderBy(F.col("score").desc(), "id")
    return out if limit is None else out.limit(limit)


def attack_matrix(df: DataFrame, tags: Column, by: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of each tag, the most frequent first; all of them unless a limit is given."""
    own = df.select(F.explode(tags).alias("tag"), *([by] if by else []))
    out = own.groupBy("tag", *([by] if by else [])).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tag", *([by] if by else []))
    return out if limit is None else out.limit(limit)
