"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes, modulo 2**BITS, of its lower-cased words (letters and
digits), of pairs of neighbours, of pairs with one word between and of the words' first STEM letters,
which join inflected forms. FTRL-proximal keeps a rate for
each coordinate and an L1 term that holds most weights at exactly zero, so the trained weights are a
short sorted list, bounded by 2**BITS entries, which is broadcast.

Training takes at most about `most` labelled documents, chosen by a hash, dealt to SHARDS tasks;
each runs `epochs` passes over its shard from the same start, and the weights of the shards are
averaged (coordinates unseen by a shard do not count for it); averaging makes them timid, so one
scale and one offset are fitted to the sums of weights of the same documents. Labels other than 0 and 1 are not
learnt from; without two kinds of labels every score is the share of label 1 (0.5 without labels).

Scores: the logistic function of the bias and the weights of the text's features; null and empty
texts have the bias alone, very long ones are read whole. Repeated rows have equal scores (a doc_id
with several labels counts as 1 if any is; each of its texts is learnt from). An empty table gives an
empty one. A column of the caller that has the name of the score is replaced, others pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.calibration import platt
from vigil.llm.common import fresh, given_back, held_out, pieces, sampled, spans, written

BITS = 20
MOST = 16_000
SHARDS = 4
STEM = 5
CACHE = 150_000
WORD = re.compile(r"[^\W_]+")
#: Odd multipliers that tell words, neighbours and pairs with a gap apart.
ONE, NEXT, GAP, STEMS = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xA0761D6478BD642F))


class WordHashes(dict):
    """CRC-32 by word and, above it, of its stem; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = zlib.crc32(word.encode()) | zlib.crc32(word[:STEM].encode()) << 32
        return out


def features(texts: list[str | None], kept: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts in turn, repeats included, and the texts' offsets."""
    words = [WORD.findall(x.lower()) if x else [] for x in texts]
    sizes = np.array([len(x) for x in words], np.int64)
    flat = np.fromiter((kept[w] for x in words for w in x), np.uint64, sizes.sum())
    at = spans(sizes)
    text = np.repeat(np.arange(len(words)), sizes)
    shift = np.uint64(64 - BITS)
    stem, flat = flat >> np.uint64(32), flat & np.uint64(0xFFFFFFFF)
    found, owner = [(flat + np.uint64(1)) * ONE >> shift, (stem ^ STEMS) * ONE >> shift], [text, text]
    for apart, by in ((1, NEXT), (2, GAP)):
        if len(flat) > apart:
            same = text[apart:] == text[:-apart]
            pair = ((flat[:-apart] * NEXT + flat[apart:] + np.uint64(1)) ^ by) * ONE >> shift
            found.append(pair[same])
            owner.append(text[apart:][same])
    joined, owner = np.concatenate(found).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return joined[order], spans(np.bincount(owner, minlength=len(words))) if len(words) else at


def distinct(found: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of each text once."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    both = np.unique((owner << BITS) | found)
    return both & ((1 << BITS) - 1), spans(np.bincount(both >> BITS, minlength=len(at) - 1))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int, seed: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coordinates, weights, seen) of one shard; the last coordinate, 2**BITS, is the bias, which has no penalty."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rng = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        size = np.abs(z[at])
        low = np.where(at == 1 << BITS, 0.0, l1)
        return np.where(size <= low, 0.0, -(z[at] - np.sign(z[at]) * low) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at = np.append(rows[k], 1 << BITS)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            old = n[at]
            n[at] = old + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(old)) / alpha * w
    seen = np.flatnonzero(n > 0)
    return seen, weights(seen), np.ones(len(seen), np.int64)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", most: int = MOST, epochs: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias): coordinates ascending, weights not zero."""
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = sampled(known, F.col("doc_id"), most)
    taken = written(docs.select("doc_id", F.col(text).alias("t")).join(known, "doc_id").select("t", "y", "doc_id"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        share = 0.5 if not counts else float(next(iter(counts)))
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    dealt = taken.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(SHARDS)).cast("int"))

    def shard(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(np.asarray(group.column("doc_id")), kind="stable")))
        kept, rows = WordHashes(), []
        for batch in group.to_batches(max_chunksize=500):
            found, at = distinct(*features(batch.column("t").to_pylist(), kept))
            found = found.astype(np.int32)
            rows += [found[a:b] for a, b in zip(at, at[1:])]
        at, w, seen = ftrl(rows, np.asarray(group.column("y")).astype(float), epochs, 7)
        return pa.table({"at": pa.array(at, pa.int64()), "w": pa.array(w, pa.float64())})

    mean = dealt.groupBy("shard").applyInArrow(shard, "at long, w double").groupBy("at").agg((F.sum("w") / F.count("w")).alias("w"))
    # At most 2**BITS + 1 rows, and L1 leaves few of them.
    model = mean.where("w <> 0").toPandas().sort_values("at")
    at, w = model["at"].to_numpy(np.int64), model["w"].to_numpy(float)
    bias = float(w[at == 1 << BITS].sum())
    at, w = at[at < 1 << BITS], w[at < 1 << BITS]
    sums = score(taken.select("t", "y"), (at, w, bias), "t", "p").select("p", "y").toPandas()
    p = sums["p"].to_numpy(float)
    scale, offset = platt(np.log(p / (1 - p)), sums["y"].to_numpy(float), 1e-6)
    return at, scale * w, scale * bias + offset


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", name: str = "score") -> DataFrame:
    """The documents with their score, 0 to 1; rows one to one, other columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept_rows = docs.drop(name)
    schema = T.StructType([*kept_rows.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = sent.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[at] = w
        kept = WordHashes()
        for batch in pieces(batches, text, 1 << 20):
            found, offsets = features(batch.column(text).to_pylist(), kept)
            some = np.flatnonzero(weights[found])  # the others add nothing, so only these are made distinct
            owner = np.searchsorted(offsets, some, "right") - 1
            both = np.unique((owner << BITS) | found[some])
            total = np.bincount(both >> BITS, weights[both & ((1 << BITS) - 1)], minlength=batch.num_rows) + bias
            out = pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, name])

    return kept_rows.mapInArrow(given_back(run), schema)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", from_score: float = 0.5) -> DataFrame:
    """The documents that score less; columns unchanged."""
    name = fresh(docs, "toxicity")[0]
    return score(docs, train(docs, labels, text), text, name).where(F.col(name) < from_score).drop(name)
