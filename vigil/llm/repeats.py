"""Finding what repeats across a corpus: keys of stretches are dealt to buckets by content and meet there.

A piece (some megabytes of texts) makes runs: consecutive starts in one text that share an anchor,
a content-chosen place, so that equal stretches lie in runs of equal anchors. Repeats inside the
piece are settled in the piece; of stretches that are equal there, only the first is sent on, so a
passage that millions of texts share reaches a bucket once a piece. Texts are named by two 64-bit
hashes, so equal texts share a name.

Hot keys: what occurs often in a bounded sample of the texts (`common`) repeats for certain, so it is
settled wherever it is met and not sent at all; and where such a key would only bring different
stretches together, the callers deal these by more of their content. The sample decides how
stretches travel, never whether they repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import pieces, sampled, spans, texts

#: Odd multipliers of two rolling hashes, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
SENT = "bucket int, names binary, run binary, anchor binary, load binary, settled binary"
FOUND = "k1 bigint, k2 bigint, first array<int>, last array<int>"
#: Texts of the sample, occurrences in it from which a key is hot, and hot keys at most (the most frequent; the others travel like all).
SAMPLE, OFTEN, HOT = 16_000, 8, 1 << 14
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2**64."""
    kept = _POWERS.get((base, 0))
    if kept is None or len(kept) <= n:
        steps = np.full(max(n + 1, 1 << 16), base, np.uint64)
        steps[0] = 1
        kept = _POWERS[base, 0] = np.cumprod(steps, dtype=np.uint64)
    return kept


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolled(values: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash of each stretch of `length` values; empty if there are fewer values."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(BASES[which], len(values))[: len(values)], out=sums[1:])
    return mixed((sums[length:] - sums[:n]) * _powers(INVERSES[which], n)[:n])


def anchors(grams: np.ndarray, wide: int) -> np.ndarray:
    """For each start, the place of the least of the `wide` grams from there on (the first of equals)."""
    if len(grams) < wide:
        return np.zeros(0, np.int64)
    least, place = grams, np.arange(len(grams))
    have = 1
    while have < wide:
        step = min(have, wide - have)
        place = np.where(least[step:] < least[:-step], place[step:], place[:-step])
        least = np.minimum(least[step:], least[:-step])
        have += step
    return place


def starts_within(at: np.ndarray, length: int) -> np.ndarray:
    """For consecutive texts with these offsets: True where a stretch of `length` ends within its text."""
    ok = np.zeros(at[-1], np.int64)
    ends = np.maximum(np.diff(at) - length + 1, 0)
    full = ends > 0
    marks = np.zeros(at[-1] + 1, np.int64)
    np.add.at(marks, at[:-1][full], 1)
    np.add.at(marks, (at[:-1] + ends)[full], -1)
    ok = np.cumsum(marks[:-1])
    return ok > 0


def text_of(at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of consecutive texts with these offsets each place lies in."""
    return np.searchsorted(at, places, "right") - 1


def stretches(starts: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive ascending starts; `cut`, by start, must be equal within a run."""
    if not len(starts):
        return starts, starts
    new = np.diff(starts) != 1
    if cut is not None:
        new |= np.diff(cut) != 0
    edge = np.flatnonzero(new)
    return starts[np.concatenate(([0], edge + 1))], starts[np.concatenate((edge, [len(starts) - 1]))]


def sent(
    of: int, names: np.ndarray, at: np.ndarray, runs: tuple[np.ndarray, np.ndarray], anchor: np.ndarray, loads: list[bytes] | None, settled: tuple[np.ndarray, np.ndarray]
) -> pa.RecordBatch:
    """Rows of SENT for a piece: runs of starts (first, last) with their anchors' hashes and loads, and settled stretches of starts.

    names: two hashes a text; at: the texts' offsets in the piece, on which starts count.
    """
    first, last = runs
    bucket = (anchor % np.uint64(of)).astype(np.int64)
    text = text_of(at, first)
    s_first, s_last = settled
    s_text = text_of(at, s_first)
    s_bucket = (names[s_text, 0].view(np.uint64) % np.uint64(of)).astype(np.int64)
    by, s_by = np.argsort(bucket, kind="stable"), np.argsort(s_bucket, kind="stable")
    rows: dict[str, list] = {x: [] for x in ("bucket", "names", "run", "anchor", "load", "settled")}
    for b in np.union1d(bucket, s_bucket).tolist():
        own = by[slice(*np.searchsorted(bucket[by], [b, b + 1]))]
        s_own = s_by[slice(*np.searchsorted(s_bucket[s_by], [b, b + 1]))]
        used, place = np.unique(np.concatenate((text[own], s_text[s_own])), return_inverse=True)
        run = np.stack((place[: len(own)], first[own] - at[text[own]], last[own] - at[text[own]]), axis=1)
        done = np.stack((place[len(own) :], s_first[s_own] - at[s_text[s_own]], s_last[s_own] - at[s_text[s_own]]), axis=1)
        rows["bucket"].append(b)
        rows["names"].append(names[used].tobytes())
        rows["run"].append(run.astype("<i4").tobytes())
        rows["anchor"].append(anchor[own].tobytes())
        rows["load"].append(b"".join([loads[n] for n in own.tolist()]) if loads is not None else b"")
        rows["settled"].append(done.astype("<i4").tobytes())
    kinds = [pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))


def again(keys: np.ndarray, also: np.ndarray | None = None) -> np.ndarray:
    """True for each key that occurs more than once (with an equal `also`)."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    if also is not None:
        other = np.diff(also[order]) != 0
        if (same & other).any():
            order = np.lexsort((also, keys))
            same = (np.diff(keys[order]) == 0) & (np.diff(also[order]) == 0)
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


class Known:
    """Pairs of 64-bit hashes that are known to repeat."""

    def __init__(self, pairs: list[tuple[int, int]]) -> None:
        both = np.array(sorted((a % (1 << 64), b % (1 << 64)) for a, b in pairs), np.uint64).reshape(-1, 2)
        self.one, self.two = both[:, 0].copy(), both[:, 1].copy()

    def holds(self, one: np.ndarray, two: np.ndarray | int) -> np.ndarray:
        """For each pair whether it is among them."""
        out = np.zeros(len(one), bool)
        two = np.broadcast_to(np.asarray(two, np.uint64), len(one))
        at, end = np.searchsorted(self.one, one, "left"), np.searchsorted(self.one, one, "right")
        todo = np.flatnonzero(at < end)
        at = at[todo]
        while len(todo):
            out[todo] = self.two[at] == two[todo]
            on = ~out[todo] & (at + 1 < end[todo])
            todo, at = todo[on], at[on] + 1
        return out


def common(named_texts: DataFrame, keys: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], piece: int) -> Known:
    """named_texts(k1, k2, _text): pairs of hashes that occur OFTEN times or more in about SAMPLE different texts, HOT pairs at most.

    keys(texts) gives the pairs of a piece, one for each occurrence; only those that the piece has twice are counted.
    """
    some = sampled(named_texts.select("k1", "k2", "_text"), F.col("k1"), SAMPLE).dropDuplicates(["k1", "k2"])

    def count(batches: Pieces) -> Pieces:
        for batch in pieces(batches, "_text", piece):
            one, two = keys(texts(batch.column("_text")))
            more = again(one, two)
            pairs, n = np.unique(np.stack((one[more], two[more]), axis=1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.uint64).view(np.int64)), pa.array(pairs[:, 1].astype(np.uint64).view(np.int64)), pa.array(n)], names=["one", "two", "n"])

    counted = some.mapInArrow(count, "one long, two long, n long").groupBy("one", "two").agg(F.sum("n").alias("n"))
    return Known([(r.one, r.two) for r in counted.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "one", "two").limit(HOT).collect()])


def first_of_each(keys: np.ndarray) -> np.ndarray:
    """True for the first of equal keys."""
    out = np.zeros(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out


def stretched(text: np.ndarray, which: np.ndarray, start: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Rows of text, first and last for the starts that are hit; which: the run of each start."""
    which, start = which[hit], start[hit]
    if not len(start):
        return np.zeros((0, 3), np.int64)
    edge = np.flatnonzero((np.diff(which) != 0) | (np.diff(start) != 1))
    first, last = np.concatenate(([0], edge + 1)), np.concatenate((edge, [len(start) - 1]))
    return np.stack((text[which[first]], start[first], start[last]), axis=1)


def met(dealt: DataFrame, repeated: Callable[[np.ndarray, np.ndarray, list[bytes]], np.ndarray]) -> DataFrame:
    """Brings the runs of a bucket together: rows of FOUND, repeated starts by text, as stretches.

    repeated(runs, anchors, loads): runs are rows of text, first and last start; loads come in their
    order. It returns such rows for the starts that repeat.
    """

    def meet(group: pa.Table) -> pa.Table:
        names, runs, anchor, loads, settled, texts = [], [], [], [], [], 0
        for row in group.select(["names", "run", "anchor", "load", "settled"]).to_pylist():
            own = np.frombuffer(row["names"], "<i8").reshape(-1, 2)
            run = np.frombuffer(row["run"], "<i4").reshape(-1, 3).astype(np.int64)
            done = np.frombuffer(row["settled"], "<i4").reshape(-1, 3).astype(np.int64)
            run[:, 0] += texts
            done[:, 0] += texts
            texts += len(own)
            names.append(own)
            runs.append(run)
            settled.append(done)
            anchor.append(np.frombuffer(row["anchor"], "<u8"))
            loads.append(row["load"])
        name, run, done = np.concatenate(names), np.concatenate(runs), np.concatenate(settled)
        hits = repeated(run, np.concatenate(anchor), loads)
        # Stretches to starts of one text after another, so that those of equal texts come together.
        who, which = np.unique(name, axis=0, return_inverse=True)
        which = which.reshape(-1)
        first = np.concatenate((hits[:, 1], done[:, 1]))
        last = np.concatenate((hits[:, 2], done[:, 2]))
        own = which[np.concatenate((hits[:, 0], done[:, 0]))]
        order = np.lexsort((last, first, own))
        own, first, last = own[order], first[order], last[order]
        new = np.append(True, (np.diff(own) != 0) | (np.diff(first) != 0) | (np.diff(last) != 0))[: len(own)]
        own, first, last = own[new], first[new], last[new]  # copies of a text bring the same ones
        at = np.searchsorted(own, np.arange(len(who) + 1))
        rows = [(who[n], first[a:b], last[a:b]) for n, (a, b) in enumerate(zip(at, at[1:])) if b > a]
        return pa.table(
            [
                pa.array([int(w[0]) for w, _, _ in rows], pa.int64()),
                pa.array([int(w[1]) for w, _, _ in rows], pa.int64()),
                pa.array([f for _, f, _ in rows], pa.list_(pa.int32())),
                pa.array([x for _, _, x in rows], pa.list_(pa.int32())),
            ],
            names=["k1", "k2", "first", "last"],
        )

    found = dealt.groupBy("bucket").applyInArrow(meet, FOUND)
    # At most a few stretches for each start of one text. Grouped by the pair as one value, so that a
    # join by the two names deals these rows anew and Spark can split a name that very many rows have.
    gathered = found.groupBy(F.struct("k1", "k2").alias("k")).agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    return gathered.select("k.k1", "k.k2", F.flatten("first").alias("first"), F.flatten("last").alias("last"))


def named(docs: DataFrame, text: str, without: list[str]) -> DataFrame:
    """(_row, _text, k1, k2): the other columns as one struct, the text (null as empty) and the two hashes that name it."""
    rest = [F.col(f"`{c}`") for c in docs.drop(text, *without).columns]
    t = F.coalesce(text, F.lit(""))
    row = F.struct(F.lit(0).alias("_"), *rest).alias("_row")
    return docs.select(row, t.alias("_text"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit("second"), t).alias("k2"))


def beside(marked: DataFrame, found: DataFrame) -> DataFrame:
    """The texts that have found stretches, with these; in the order of their names, so that a task that is run again makes the same pieces."""
    return marked.join(found, ["k1", "k2"]).sortWithinPartitions("k1", "k2")


def restored(out: DataFrame, docs: DataFrame, text: str, new: list[str]) -> DataFrame:
    """The columns of `docs` in their order, then the new ones."""
    rest = docs.drop(*new).columns
    return out.select(*(F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in rest), *new)


def names_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c)).astype("<i8") for c in ("k1", "k2")], axis=1)


def distinct_twice(names: np.ndarray) -> np.ndarray:
    """Rows of a piece to work on: of equal texts the first two, for these repeat each other wholly."""
    _, which = np.unique(names, axis=0, return_inverse=True)
    which = which.reshape(-1)
    order = np.argsort(which, kind="stable")
    begun = np.searchsorted(which[order], which[order])
    return np.sort(order[np.arange(len(order)) - begun < 2])


def covered(first: np.ndarray, last: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a stretch of `length` that starts in one of [first, last]."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(last + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def offsets(sizes: list[int]) -> np.ndarray:
    return spans(np.array(sizes, np.int64))


Pieces = Iterator[pa.RecordBatch]
