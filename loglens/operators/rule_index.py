"""Many rules in one scan: an index of the texts that rules need names those that a row can match at all."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import field
from .rules import CATEGORIES, conditions

#: A text in a field: (field, whole, text); whole if the field must equal it, else it holds it. All are in lower case.
Key = tuple[str, bool, str]
#: Keys of which a matching row has at least one; none at all: no row matches; None: nothing is known.
Need = frozenset[Key] | None


def _either(needs: list[Need]) -> Need:
    return None if any(n is None for n in needs) else frozenset().union(*needs)


def required(rule: dict, cost: Callable[[frozenset[Key]], float | tuple]) -> Need:
    """What rows that match the rule must have; of several such sets, the one of the least cost.

    Patterns, missing fields and whatever is below a "not" need nothing that could be looked up.
    """

    def all_(needs: list[Need]) -> Need:
        return min((n for n in needs if n is not None), key=cost, default=None)

    def entry(name: str, values) -> Need:
        column, *how = name.split("|")
        values = values if isinstance(values, list) else [values]
        kind = next((h for h in how if h in ("contains", "startswith", "endswith", "re")), None)
        if values == [None] or kind == "re":
            return None
        each = [frozenset({(column, kind is None, str(v).lower())}) if kind is None or v else None for v in values]
        return all_(each) if "all" in how else _either(each)

    def selection(spec: dict | list) -> Need:
        if isinstance(spec, list):
            return _either([selection(s) for s in spec])
        return all_([entry(name, values) for name, values in spec.items()])

    def build(x) -> Need:
        if isinstance(x, str):
            return selection(rule["selections"][x])
        op, *rest = x
        if op == "not":
            return None
        if op in ("1 of", "all of"):
            named = [build(n) for n in rule["selections"] if n.startswith(rest[0])]
            return _either(named) if op == "1 of" else all_(named)
        return (all_ if op == "and" else _either)([build(r) for r in rest])

    of_category = CATEGORIES.get(rule.get("category"), rule.get("category"))
    return all_([build(rule["when"]), frozenset({("category", True, of_category.lower())}) if of_category and of_category.isascii() else None])


def _keys(rule: dict) -> set[Key]:
    """All keys that the rule could be looked up by."""
    keys: set[Key] = set()
    required(rule, lambda need: keys.update(need) or 0)
    return keys


def _found(df: DataFrame, index: dict[Key, list[int]]) -> Column:
    """The numbers that the index gives for the texts found in a row, each once, in order.

    One automaton for each field reads a text once, whatever the number of keys; equal texts of a batch are read together.
    """
    columns = sorted({k[0] for k in index})
    whole = [{text: nums for (c, w, text), nums in index.items() if c == column and w} for column in columns]
    part = [{text: nums for (c, w, text), nums in index.items() if c == column and not w} for column in columns]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def find(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:  # of one column, Spark passes the series alone
        automata = []
        for texts in part:
            a = ahocorasick.Automaton()
            for text, nums in texts.items():
                a.add_word(text, nums)
            if texts:
                a.make_automaton()
            automata.append(a if texts else None)
        none: frozenset[int] = frozenset()
        for batch in batches:
            batch = (batch,) if isinstance(batch, pd.Series) else batch
            rows = [none] * len(batch[0])
            for series, equal, automaton in zip(batch, whole, automata, strict=True):
                places, texts = pd.factorize(series)
                known = [frozenset(equal.get(t, ())).union(*((nums for _, nums in automaton.iter(t)) if automaton else ())) for t in texts]
                if any(known):
                    rows = [r | known[p] if p >= 0 and known[p] else r for r, p in zip(rows, places.tolist(), strict=True)]
            yield pd.Series([sorted(r) for r in rows], dtype=object)

    return find(*(F.lower(field(df, c).cast("string")) for c in columns))


def key_rows(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """(field, whole, text, n): in how many rows each text is found that a rule could be looked up by; a row for each."""
    order = sorted(set().union(*map(_keys, rules.values())))
    names = df.sparkSession.createDataFrame([(i, *k) for i, k in enumerate(order)], "k int, field string, whole boolean, text string")
    if not order:
        return names.select("field", "whole", "text", F.lit(0).cast("long").alias("n"))
    hits = df.select(F.explode(_found(df, {k: [i] for i, k in enumerate(order)})).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return names.join(hits, "k", "left").select("field", "whole", "text", F.coalesce("n", F.lit(0)).alias("n"))


def rule_match_indexed(df: DataFrame, rules: dict[str, dict], counts: DataFrame | None = None) -> DataFrame:
    """As rules.rule_match(): rows that match, once for each rule, at a cost that grows with hits, not with rules times rows.

    Each rule is looked up by the rarest texts that it needs: by key_rows() of an earlier day, if given, else those that
    the fewest rules share (a category last), then the longest. Its whole condition is evaluated on rows that have one of
    them. Rules that need no text, such as those of patterns or negations alone, are evaluated on every row. A null or missing field holds no text. No rules give no rows.
    """
    if not rules:
        return df.withColumn("rule_id", F.lit(None).cast("string")).where(F.lit(False))
    uses = Counter(k for r in rules.values() for k in _keys(r))
    rows_of = {} if counts is None else {(r["field"], r["whole"], r["text"]): r["n"] for r in counts.collect()}  # a row for each text of a rule

    def cost(need: frozenset[Key]) -> tuple:
        return sum(rows_of.get(k, 0) for k in need), any(k[0] == "category" for k in need), max((uses[k] for k in need), default=0), -min((len(k[2]) for k in need), default=0), len(need)

    needs = [required(r, cost) for r in rules.values()]
    index: dict[Key, list[int]] = {}
    for i, need in enumerate(needs):
        for k in need or ():
            index.setdefault(k, []).append(i)
    tests = conditions(df, rules)

    def judged(i: Column, lo: int, hi: int) -> Column:
        """The condition of rule i, found by halving."""
        if hi - lo == 1:
            return tests[lo]
        mid = (lo + hi) // 2
        return F.when(i < mid, judged(i, lo, mid)).otherwise(judged(i, mid, hi))

    always = F.lit([i for i, need in enumerate(needs) if need is None]).cast("array<int>")
    candidates = F.concat(_found(df, index), always) if index else always
    rows = df.withColumn("__rule", F.explode(F.filter(candidates, lambda i: judged(i, 0, len(tests)))))
    return rows.withColumn("rule_id", F.get(F.lit(list(rules)), F.col("__rule"))).drop("__rule")
