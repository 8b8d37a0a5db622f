"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A text is cut into chunks of CHUNK bytes, each compressed with either dictionary; the difference of
the two totals (bad less good), divided by the text's bytes, tells how much better the good
dictionary knows it. A rising curve fitted to labelled documents turns that into a score.

Training takes at most about `most` labelled documents, chosen by a hash: half for the dictionaries,
half for the curve, of which only the differences are gathered. For the dictionaries texts are cut,
where they are read, into up to EACH evenly spaced pieces; of each class about SAMPLES pieces, chosen
by a hash among all of them, go to the one task that builds its dictionary (PIECE * SAMPLES bytes at
most, about). Labels other than 0 and 1 are not learnt from; without both kinds of labels every score
is the share of label 1 (0.5 without labels). Too few samples for a trained dictionary serve as a raw
one.

Null and empty texts have difference 0, very long ones are read whole. Repeated rows have equal scores
(a doc_id with several labels counts as 1 if any is). An empty table gives an empty one. A column of
the caller that has the name of the score is replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.calibration import rising
from vigil.llm.common import held_out, pieces, sampled, texts, written

MOST = 12_000
CHUNK = 1500
PIECE = 2000
EACH = 4
SAMPLES = 8000
DICTIONARY = 256 << 10
LEVEL = 3


def cut(text: bytes) -> list[bytes]:
    """Up to EACH pieces, evenly spaced."""
    places = np.unique(np.linspace(0, max(0, len(text) - PIECE), min(EACH, max(1, -(-len(text) // PIECE)))).astype(int))
    return [text[a : a + PIECE] for a in places.tolist() if text]


def dictionary(parts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:DICTIONARY]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    if not content:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    known = zstandard.ZstdCompressionDict(content)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)


def size(by: zstandard.ZstdCompressor, text: bytes) -> int:
    return sum(len(by.compress(text[a : a + CHUNK])) for a in range(0, len(text), CHUNK))


def differences(
    docs: DataFrame, dictionaries: tuple[bytes, bytes], text: str, name: str, curve: tuple[np.ndarray, np.ndarray] | None = None
) -> DataFrame:
    """Adds the normalised difference, or its place on the curve; dictionaries: of bad and of good text."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    kept = docs.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = map(compressor, sent.value)
        for batch in pieces(batches, text):
            found = np.array([(size(bad, t) - size(good, t)) / max(1, len(t)) for t in texts(batch.column(text))], float)
            out = pa.array(found if curve is None else np.interp(found, *curve), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", most: int = MOST) -> tuple[tuple[bytes, bytes], np.ndarray, np.ndarray]:
    """(dictionaries, knots, values of the curve)."""
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = sampled(known, F.col("doc_id"), most)
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).alias("half")
    taken = written(docs.select("doc_id", F.col(text).alias("t")).join(known, "doc_id").select("doc_id", "t", "y", half))

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            parts = [cut(t) for t in texts(batch.column("t"))]
            of = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            flat = [x for own in parts for x in own]
            h = pa.array([xxhash.xxh64_intdigest(x, 3) >> 2 for x in flat], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("y").take(pa.array(of)), h, pa.array(flat, pa.binary())], names=["y", "h", "piece"])

    cuts = taken.where("half = 0").select("t", "y").mapInArrow(pieces_of, "y int, h long, piece binary")
    # Equal pieces count once, so that copies neither fill the sample nor the task.
    cuts = written(cuts.dropDuplicates(["y", "h"]))
    rate = {r["y"]: min(1.0, SAMPLES / r["count"]) for r in cuts.groupBy("y").count().collect()}
    chosen = F.lit(False)
    for y, share in rate.items():
        chosen |= (F.col("y") == y) & (F.col("h") < int(share * (1 << 62)))

    def build(group: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(group.column("h")), kind="stable")
        made = dictionary(group.column("piece").take(pa.array(order)).to_pylist())
        return pa.table({"y": group.column("y").slice(0, 1), "content": pa.array([made], pa.binary())})

    made = {r["y"]: bytes(r["content"]) for r in cuts.where(chosen).groupBy("y").applyInArrow(build, "y int, content binary").collect()}
    if len(made) < 2:
        share = float(next(iter(made))) if made else 0.5
        return (b"", b""), np.array([0.0]), np.array([share])
    both = made[0], made[1]
    fitted = differences(taken.where("half = 1").select("t", "y"), both, "t", "x").select("x", "y").toPandas()
    return both, *rising(fitted["x"].to_numpy(float), fitted["y"].to_numpy(float))


def score(docs: DataFrame, model: tuple[tuple[bytes, bytes], np.ndarray, np.ndarray], text: str = "text", name: str = "score") -> DataFrame:
    """The documents with their score, 0 to 1; rows one to one, other columns unchanged."""
    both, knots, values = model
    return differences(docs, both, text, name, (knots, values))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
