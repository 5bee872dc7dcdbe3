"""Language ID by compression with one zstandard dictionary for each language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .words import chunks, tidy

#: Documents a language is learned from at most, characters taken of each, and bytes of a dictionary at most: about
#: what such a sample comes to.
SAMPLE, PIECE, DICTIONARY = 180, 600, 110_000
#: Texts are encoded in blocks of so many bytes, so that a long text leans on the dictionary throughout.
BLOCK, LEVEL = 2048, 3
#: A prediction is rejected where the second best encoding is not this share larger than the best.
MARGIN = 0.004
UNKNOWN = "und"
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """What is encoded: the text in lower case, each run of other characters than letters as one space."""
    return OTHER.sub(" ", text.lower()).encode()


def coder(dictionary: bytes) -> zstandard.ZstdCompressor:
    """An encoder that also finds matches of three bytes, which short function words need."""
    own = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(dictionary), min_match=3, write_content_size=0, write_dict_id=0)
    raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw.precompute_compress(compression_params=own)
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=own)


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict[str, bytes]:
    """A raw-content dictionary for each language of the labelled rows with a text and a language.

    It is fitted on the first PIECE characters of at most sample documents of each language, those with the
    smallest hash of id and text, joined and cut to DICTIONARY bytes: rows are first thinned at a rate from the language's count, so few reach the last step. Only
    these bounded dictionaries come to the driver. Languages come by falling number of rows.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")).where("lang is not null and text is not null and text <> ''")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    limits = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 3 * sample / n) * (2**62)))))
    thin = rows.where(F.shiftrightunsigned("h", 2) <= limits[F.col("lang")])
    last = thin.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= sample)
    parts: dict[str, list] = {}
    for r in last.select("lang", "r", F.substring("text", 1, PIECE).alias("text")).collect():
        parts.setdefault(r["lang"], []).append((r["r"], r["text"]))
    return {lang: b"\n".join(letters(t) for _, t in sorted(p))[:DICTIONARY] for lang, p in sorted(parts.items(), key=lambda x: (-counts[x[0]], x[0]))}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred, score and rejected added; columns of these names are replaced.

    Every whole text is encoded with each language's dictionary, and the language with the smallest sum
    of encoded bytes is predicted; ties go to the more frequent. score is 0.5 where the two best are
    equal and rises to 1 with their distance. rejected holds where the second best isn't larger than the
    best by the margin, and where lang_pred is 'und': a null text or one without a letter (score 0).
    With no language learned, all are 'und'. Nothing but the text is read for a prediction.
    """
    names = list(dictionaries)
    columns = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]

    @tidy
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [coder(d) for d in dictionaries.values()]
        for whole in batches:
            for batch in chunks(whole, at, 2 << 20):
                best, score, no = [], [], []
                for text in batch[at].to_pylist():
                    if not coders or not text or not any(map(str.isalpha, text)):
                        best.append(UNKNOWN), score.append(0.0), no.append(True)
                        continue
                    data = letters(text)
                    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
                    sizes = np.array([sum(len(c.compress(b)) for b in blocks) for c in coders])
                    order = np.argsort(sizes, kind="stable")
                    apart = 1.0 - sizes[order[0]] / sizes[order[1]] if len(order) > 1 else 1.0
                    best.append(names[order[0]]), score.append(float(1 - 0.5 * np.exp(-apart / 0.05))), no.append(bool(apart < margin))
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(no, pa.bool_())], names=[*kept, "_lang", "_score", "_no"])

    kept = [f"c{i}" for i in range(len(columns))]
    own = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(columns, kept, strict=True)))
    at = kept[columns.index(text_col)]
    schema = own.select(*kept, F.lit("").alias("_lang"), F.lit(0.0).alias("_score"), F.lit(True).alias("_no")).schema
    out = own.mapInArrow(predict, schema)
    return out.select(*(F.col(k).alias(c) for c, k in zip(columns, kept, strict=True)), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_no").alias("rejected"))


def held_out(id_col: str = "doc_id"):
    """Documents never learned from: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = learn(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), dictionaries)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
