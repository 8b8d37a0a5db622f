"""Language identification by hyperdimensional profiles.

Each letter has a random vector of DIM signs, made from a seed. The vector of an n-gram is the
product of its letters' vectors, each rotated by its place in the n-gram; a text's vector is the sum
of its n-grams' vectors, a language's prototype the sum over learnt texts. A text gets the language
whose prototype has the greatest cosine with it (of equals the first by code point).

Letters are lower-cased and each has a code of its own: a to z and the most usual accented ones those
below SYMBOLS, others SYMBOLS plus their code point; all else is a gap (runs of gaps count once, and
texts begin and end with one). N-grams take three codes. Those of codes below SYMBOLS have their
vectors in a table, and sums over texts are sums of its rows by count; the vectors of others are bound
as they occur, a few thousand at a time.

A text that is null or holds no letter gets `und` with score 0. The score of others is the softmax of
the cosines times SHARP, between 0 and 1. Without learnable rows all get `und`. Repeated rows have
equal results, very long texts are read whole, an empty table gives an empty one. Columns of the caller
that have the names of new ones are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import held_out, pieces

DIM = 512
SEED = 2024
SHARP = 40.0
MOST = 20_000
#: Rows of each language that are learnt from, about, however few of all rows it has (all, if it has fewer).
FEW = 200
# Letters with a code of their own, after the gap.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäæçèéêëìíîïñòóôöøùúûüœ"
SYMBOLS = 56
PIECE = 512 << 10
CHUNK = 4096


def letter_code(c: int) -> int:
    low = chr(c).lower()[0]
    return 1 + LETTERS.index(low) if low in LETTERS else SYMBOLS + ord(low)


@cache
def codes() -> np.ndarray:
    """The code of each character of the basic plane; 0 is the gap."""
    out = np.zeros(1 << 16, np.int64)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = letter_code(c)
    return out


@cache
def usual_signs() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, DIM)).astype(np.int8) * 2 - 1


@lru_cache(1 << 15)
def signs(code: int) -> np.ndarray:
    """The signs of any code, the same in every worker."""
    return usual_signs()[code] if code < SYMBOLS else np.random.default_rng([SEED, code]).integers(0, 2, DIM).astype(np.int8) * 2 - 1


@cache
def ngram_vectors() -> np.ndarray:
    """(SYMBOLS**3, DIM) of signs."""
    own = usual_signs()
    a, b, c = np.roll(own, 2, axis=1), np.roll(own, 1, axis=1), own
    return (a[:, None, None] * b[None, :, None] * c[None, None, :]).reshape(-1, DIM)


def letter_codes(points: np.ndarray) -> np.ndarray:
    """The code of each code point."""
    out = codes()[np.minimum(points, 0xFFFF)]
    for point in np.unique(points[points > 0xFFFF]).tolist():
        out[points == point] = letter_code(point) if chr(point).isalpha() else 0
    return out


def add_bound(out: np.ndarray, grams: np.ndarray, owner: np.ndarray) -> None:
    """Adds to the rows of `out` the vectors of their n-grams: (n, 3) codes and (n,) rows in order."""
    key = (grams[:, 0] << 42) | (grams[:, 1] << 21) | grams[:, 2]
    kinds, kind = np.unique(key, return_inverse=True)
    pairs, times = np.unique(owner * max(1, len(kinds)) + kind, return_counts=True)
    for a in range(0, len(pairs), CHUNK):
        row, k = np.divmod(pairs[a : a + CHUNK], len(kinds))
        three = np.stack([kinds[k] >> 42, kinds[k] >> 21 & (1 << 21) - 1, kinds[k] & (1 << 21) - 1])
        met, at = np.unique(three, return_inverse=True)
        own, at = np.array([signs(c) for c in met.tolist()]), at.reshape(three.shape)
        v = np.roll(own, 2, axis=1)[at[0]] * np.roll(own, 1, axis=1)[at[1]] * own[at[2]]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[first]] += np.add.reduceat(v * times[a : a + CHUNK, None].astype(np.float32), first, axis=0)


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text, and whether it has a letter."""
    framed = "".join(f" {x} " for x in texts)
    sizes = np.fromiter((len(x) + 2 for x in texts), np.int64, len(texts))
    code = letter_codes(np.frombuffer(framed.encode("utf-32-le", "replace"), np.uint32))
    owner = np.repeat(np.arange(len(texts)), sizes)
    some = np.bincount(owner, code != 0, minlength=len(texts)) > 0
    keep = np.append(True, (code[1:] != 0) | (code[:-1] != 0) | (owner[1:] != owner[:-1]))
    code, owner = code[keep], owner[keep]
    inside = owner[:-2] == owner[2:]
    grams, owner = np.stack([code[:-2], code[1:-1], code[2:]], axis=1)[inside], owner[:-2][inside]
    usual = (grams < SYMBOLS).all(axis=1)
    others, whose = grams[~usual], owner[~usual]
    found, owner = grams[usual] @ np.array([SYMBOLS * SYMBOLS, SYMBOLS, 1]), owner[usual]
    used = np.flatnonzero(np.bincount(found, minlength=SYMBOLS**3))
    place = np.zeros(SYMBOLS**3, np.int64)
    place[used] = np.arange(len(used))
    out = np.zeros((len(texts), DIM), np.float32)
    step = max(1, (4 << 20) // max(1, len(used)))  # of the table of counts a few million cells at a time
    table = ngram_vectors()[used].astype(np.float32)
    for a in range(0, len(texts), step):
        own = slice(*np.searchsorted(owner, [a, a + step]))
        n = min(step, len(texts) - a)
        counts = np.bincount((owner[own] - a) * len(used) + place[found[own]], minlength=n * len(used))
        out[a : a + n] = counts.reshape(n, -1).astype(np.float32) @ table if len(used) else 0
    add_bound(out, others, whose)
    return out, some


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def train(docs: DataFrame, text: str = "text", label: str = "lang", most: int = MOST) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes of length 1) from about `most` documents that are not held out, and FEW more of each language at most."""
    known = docs.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col(text).alias("t"), F.col(label).alias("l"))
    sizes = known.groupBy("l").count().collect()  # one row a language
    total = sum(r["count"] for r in sizes)
    if total > most:
        rates = [(r["l"], int((1 << 40) * min(1, max(most / total, FEW / r["count"])))) for r in sizes]
        rates = F.broadcast(docs.sparkSession.createDataFrame(rates, "l string, rate long"))
        known = known.join(rates, "l").where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40)) < F.col("rate")).select("doc_id", "t", "l")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in pieces(batches, "t", PIECE):
            made, some = vectors([x or "" for x in batch.column("t").to_pylist()])
            made[~some] = 0
            for v, lang in zip(unit(made), batch.column("l").to_pylist()):  # long texts count as one
                sums[lang] = sums.get(lang, 0) + v
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.astype(float) for v in sums.values()], pa.list_(pa.float64()))], names=["l", "v"]
        )

    parts = known.mapInArrow(bundle, "l string, v array<double>")
    total = parts.select("l", F.posexplode("v").alias("n", "x")).groupBy("l", "n").agg(F.sum("x").alias("x"))
    rows = total.groupBy("l").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("v")).select("l", "v.x").collect()  # one row a language
    rows.sort(key=lambda r: r["l"])
    profiles = np.array([r["x"] for r in rows], np.float32).reshape(len(rows), DIM)
    return [r["l"] for r in rows], unit(profiles)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """The documents with `lang_pred` and `score`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prototypes = sent.value
        for batch in pieces(batches, text, PIECE):
            made, some = vectors([x or "" for x in batch.column(text).to_pylist()])
            if names:
                cosine = (unit(made) @ prototypes.T).astype(float)
                best = cosine.argmax(axis=1)
                scores = np.where(some, 1 / np.exp(SHARP * (cosine - cosine.max(axis=1, keepdims=True))).sum(axis=1), 0.0)
                langs = [names[n] if ok else "und" for n, ok in zip(best.tolist(), some.tolist())]
            else:
                langs, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            out = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def predictions(docs: DataFrame) -> DataFrame:
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
