"""License scans by an exact set-similarity join of text blocks with notice templates."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.9
#: Words of a block that spans line ends, as a multiple of the template's words.
SPAN = 1.25
#: Bytes that the templates may have.
MOST = 16 << 20

# Phrases and their labels.
PHRASES = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

# Usual wordings of public license notices and their labels.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)

#: Lower case; everything but digits, letters, bytes of other scripts and the end of a line is a space.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 or b == 10 else 32 for b in range(256))


def folded(text: str | None) -> bytes:
    return (text or "").encode().translate(FOLD)


def span_share(at: list[int], found: list, size: int) -> int:
    """The most distinct words among those found, at ascending positions, in any run of so many words."""
    held: Counter = Counter()
    most = first = 0
    for p, w in zip(at, found, strict=True):
        held[w] += 1
        while p - at[first] >= size:
            held[found[first]] -= 1
            if not held[found[first]]:
                del held[found[first]]
            first += 1
        most = max(most, len(held))
    return most


def frequencies(docs: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How many documents hold each template word: one row a batch and word, summed up by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[bytes] = Counter()
            for text in batch["text"].to_pylist():
                found.update(vocabulary.intersection(folded(text).split()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def wordings(templates: DataFrame | None) -> list[tuple[str, list[bytes]]]:
    """(label, words) of templates (label, text), or of TEMPLATES. Every task holds them, so their size is checked."""
    if templates is None:
        rows = TEMPLATES
    else:
        own = templates.select(F.col("label").cast("string").alias("label"), F.col("text").alias("text")).dropna()
        size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if size > MOST:
            raise ValueError(f"templates have {size} bytes, more than {MOST}")
        rows = [(r["label"], r["text"]) for r in own.distinct().orderBy("label", "text").collect()]
    split = [(label, folded(t).split()) for label, t in rows]
    return [(label, w) for label, w in split if w]


class Index:
    """The templates' words in global order, and their prefixes inverted."""

    def __init__(self, templates: list[tuple[str, list[bytes]]], often: dict[bytes, int], containment: float):
        every = frozenset(w for _, words in templates for w in words)
        self.rank = {w: i for i, w in enumerate(sorted(every, key=lambda w: (often.get(w, 0), w)))}
        self.labels = [label for label, _ in templates]
        self.sets = [sorted({self.rank[w] for w in words}) for _, words in templates]
        self.need = [math.ceil(containment * len(t) - 1e-9) for t in self.sets]
        self.spans = [math.ceil(SPAN * len(words) - 1e-9) for _, words in templates]
        self.posts: dict[int, list[tuple[int, int]]] = {}
        for k, (t, need) in enumerate(zip(self.sets, self.need, strict=True)):
            for i, r in enumerate(t[: len(t) - need + 1]):
                self.posts.setdefault(r, []).append((k, i))
        self.least = min(self.need, default=1)

    def meet(self, block: set[int]) -> list[tuple[int, int]]:
        """(template, shared words) for each template of which the block has enough words.

        The block's words are in the templates' order, too. The first word that the two share lies in the
        prefix of both, and what follows it on either side must make up the rest.
        """
        m = len(block)
        if m < self.least or block.isdisjoint(self.posts):
            return []
        found: dict[int, int] = {}
        for j, r in enumerate(sorted(block)[: m - self.least + 1]):
            for k, i in self.posts.get(r, ()):
                need = self.need[k]
                if k not in found and m >= need and 1 + min(len(self.sets[k]) - i - 1, m - j - 1) >= need:
                    found[k] = len(block.intersection(self.sets[k]))
        return [(k, n) for k, n in found.items() if n >= self.need[k]]


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(place, label) of each phrase, in one pass over the words for each distinct last word."""
    out = []
    for last in {p.split()[-1] for p in PHRASES}:
        own = [(p.split(), label) for p, label in PHRASES.items() if p.split()[-1] == last]
        at = -1
        try:
            while True:
                at = words.index(last, at + 1)
                for phrase, label in own:
                    first = at - len(phrase) + 1
                    if first >= 0 and words[first : at + 1] == phrase:
                        out.append((first, label))
        except ValueError:
            pass
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, templates: DataFrame | None = None) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each row of docs.

    Base: places where a phrase's words stand next to each other. Method: each line is a block, and so
    is, for each template (label, text), every run of SPAN times as many words as its wording has, over the
    ends of lines; a template labels a block that holds the given share of its distinct words. score is 1
    with a base phrase, else the largest share of a template that a block reached, 0 without one.

    The words of the templates are ordered by their frequency over all documents, rarest first, and blocks
    and templates meet by prefix, length and position in that order, see Index.meet(): nothing that reaches
    the threshold is missed. Runs are looked through only for templates that the whole text meets.
    Null and blank texts have no words and no labels; null ids stay null; repeated rows are scanned alike;
    templates without a word or label are left out. Only the id and the text are read.
    """
    wanted = wordings(templates)
    index = Index(wanted, frequencies(docs, text_col, frozenset(w for _, words in wanted for w in words)), containment)

    def blocks(text: bytes, words: list[bytes]) -> tuple[set[str], float]:
        """Labels and the best share of a text."""
        labels, best = set(), 0.0
        own = [(p, r) for p, w in enumerate(words) if (r := index.rank.get(w)) is not None]
        whole = index.meet({r for _, r in own})
        if not whole:
            return labels, best
        found = {}
        for line in text.split(b"\n"):
            for k, n in index.meet({r for w in line.split() if (r := index.rank.get(w)) is not None}):
                found[k] = max(found.get(k, 0), n)
        for k, _ in whole:
            t = frozenset(index.sets[k])
            near = [(p, r) for p, r in own if r in t]
            found[k] = max(found.get(k, 0), span_share([p for p, _ in near], [r for _, r in near], index.spans[k]))
        for k, n in found.items():
            if n >= index.need[k]:
                labels.add(index.labels[k])
                best = max(best, n / len(index.sets[k]))
        return labels, best

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, raw in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                text = folded(raw)
                words = text.split()
                places = phrase_places(words)
                base = {label for _, label in places}
                labels, best = blocks(text, words)
                first, last = min(places, default=(None,))[0], max(places, default=(None,))[0]
                rows.append((i, len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else best))
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(find, schema).withColumnRenamed("id", id_col)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
