"""Exact substring dedup over bytes by suffix arrays of shards and a merge across shards.

Shards are pieces of some megabytes of texts. Of a shard only stretches that can repeat are sorted:
of each string of the wanted length only its own anchor is looked at (the gram of GRAM bytes in it
with the least hash); equal strings have equal anchors, so a string whose anchor occurs nowhere else
in the corpus cannot repeat. The shard's suffix array over the rest is built by Larsson-Sadakane
refinement (groups of equal prefixes are sorted by the rank of what follows, doubling the prefix
until it has the wanted length), the common prefixes of neighbours by Kasai's rule (along a text they
shrink by one byte at most, so a comparison begins only where the neighbour's place jumps). Common
prefixes of the wanted length are repeats within the shard. Across shards, the strings that are first of their
kind in their shard meet by anchor. There they are dealt to slices of a bounded number by a hash, so
that equal ones come together; strings that share their hash with no other are done with. In a slice
the bytes of the shards' strings are merged into one sorted array and each string is looked up in it
by binary search: one that is found more than once is a repeat. Equality is that of bytes, but for
strings that are frequent in a sample of the texts: these are known by two 64-bit hashes and settled
where they are met. Strings of an anchor that is frequent there are dealt by both their ends too, so
that an anchor in very many texts with different surroundings is split over many buckets.

Texts are UTF-8 bytes, null and empty ones have none. Every covered byte goes, the first occurrence
included; strings never reach over documents and are judged on the input. Equal texts share their
result; repeated rows count as occurrences. Very long texts are read whole, one at a time where they
exceed a shard. An empty table gives an empty one. Columns of the caller that have the names of new
ones are replaced by these, all others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm import repeats as R
from vigil.llm.common import buckets, given_back, pieces, texts

GRAM = 64
SHARD = 2 << 20
#: Bytes of runs that a merge reads at a time, and bytes of strings that a slice holds, about.
MERGE = 1 << 20
SLICE = 8 << 20
#: Along a chain of falling common prefixes a comparison is made anew after so many bytes.
ANEW = 256
VALUE = R.mixed(np.arange(1, 257, dtype=np.uint64))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number of the same order; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    out = np.zeros(len(data), np.uint64)
    for n in range(8):
        out |= padded[n : n + len(data)].astype(np.uint64) << np.uint64(56 - 8 * n)
    return out


def suffix_array(key: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Places in the order of their first `length` bytes, equal ones ascending; exact where so many bytes precede `ends`.

    key: eights of the data; ends: for each place the end of its stretch.
    """
    n, have = len(key), 8
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n, np.int64)

    def ranked(at: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Sets the ranks of the sorted places at these indexes (new: first of a group); those of larger groups."""
        head = np.maximum.accumulate(np.where(new, at, -1))
        rank[order[at]] = head
        alone = new & np.append(new[1:], True)
        return at[~alone]

    active = ranked(np.arange(n), np.append(True, np.diff(key[order]) != 0)) if n else order
    while have < length and len(active):
        step = min(have, length - have)
        have += step
        active = active[order[active] + have <= ends[order[active]]]  # others are shorter than that
        if not len(active):
            break
        place = order[active]
        pair = (rank[place] << 32) | rank[place + step]
        by = np.argsort(pair, kind="stable")
        order[active] = place[by]
        pair = pair[by]
        active = ranked(active, np.append(True, np.diff(pair) != 0))
    return order


def common_prefixes(key: np.ndarray, ends: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place of `order`, bytes in common with the place before it in that order, exact below length + ANEW; by place, -1 elsewhere."""
    out = np.full(len(key), -1, np.int64)
    if len(order) < 2:
        return out
    before = np.full(len(key) + 1, -2, np.int64)
    before[order[1:]] = order[:-1]
    places = np.flatnonzero(before[:-1] >= 0)
    falls = (places > 0) & (before[places] == before[places - 1] + 1) & (before[places - 1] >= 0)
    chain = np.maximum.accumulate(np.where(falls, 0, np.arange(len(places))))
    head = ~falls | ((np.arange(len(places)) - chain) % ANEW == 0)
    a, b = places[head], before[places[head]]
    most = np.minimum(np.minimum(ends[a] - a, ends[b] - b), length + ANEW)
    got = np.zeros(len(a), np.int64)
    todo = np.arange(len(a))
    while len(todo):
        x, y = a[todo] + got[todo], b[todo] + got[todo]
        differ = key[x] ^ key[y]
        zeros = sum((differ < np.uint64(1 << n)).astype(np.int64) for n in range(0, 64, 8))
        got[todo] += zeros
        todo = todo[(zeros == 8) & (got[todo] < most[todo])]
    own = np.cumsum(head) - 1
    heads = np.flatnonzero(head)
    out[places] = np.minimum(got, most)[own] - (np.arange(len(places)) - heads[own])
    return out


def anchored(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of whole strings, the place of each one's anchor, hashes of all grams)."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = R.rolled(VALUE[data], gram, 1)
    starts = np.flatnonzero(R.starts_within(at, length)[: len(data) - length + 1])
    return starts, R.anchors(grams, length - gram + 1)[starts], grams


def in_shard(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For ascending starts of strings: which repeat within these data, and which are the first of their kind."""
    if not len(starts):
        return np.zeros(0, bool), np.zeros(0, bool)
    first, last = R.stretches(starts)
    inside = R.covered(first, last, length, len(data))
    small = np.cumsum(inside) - 1  # places among the bytes inside
    key = eights(data[inside])
    edges = np.flatnonzero(np.diff(np.flatnonzero(inside)) != 1) + 1
    ends = np.append(edges, len(key))[np.searchsorted(edges, np.arange(len(key)), "right")]
    valid = np.zeros(len(key), bool)
    valid[small[starts]] = True
    order = suffix_array(key, ends, length)
    order = order[valid[order]]
    same = common_prefixes(key, ends, order, length) >= length
    repeats = same.copy()
    repeats[order[:-1][same[order[1:]]]] = True
    return repeats[small[starts]], ~same[small[starts]]


def looked_up(data: np.ndarray, places: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings at these places occur more than once; key: a hash of each string.

    A slice takes all strings of the hashes in it, so equal strings never part.
    """
    out = np.zeros(len(places), bool)
    may = np.flatnonzero(R.again(key))
    may = may[np.argsort(key[may], kind="stable")]
    if not len(may):
        return out
    string = np.ndarray(len(data) - length + 1, f"S{length}", data, strides=(1,))
    new = np.append(True, np.diff(key[may]) != 0)
    part = np.flatnonzero(new)[np.cumsum(new) - 1] // max(1, SLICE // length)
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(part) != 0)), len(may))
    for a, b in zip(cuts, cuts[1:]):
        own = string[places[may[a:b]]]
        merged = np.sort(own)
        out[may[a:b]] = np.searchsorted(merged, own, "right") - np.searchsorted(merged, own, "left") > 1
    return out


def across_shards(length: int):
    def merge(run: np.ndarray, anchor: np.ndarray, loads: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"".join(loads), np.uint8)
        sizes = run[:, 2] - run[:, 1] + length
        at = R.offsets(sizes)
        by = np.argsort(anchor, kind="stable")
        new = np.flatnonzero(np.append(True, np.diff(anchor[by]) != 0)) if len(by) else np.zeros(0, np.int64)
        part = np.cumsum(sizes[by])[np.append(new[1:], len(by)) - 1] // MERGE if len(by) else new
        cuts = new[np.append(True, np.diff(part) != 0)] if len(by) else new
        out = [np.zeros((0, 3), np.int64)]
        for x, y in zip(cuts, np.append(cuts[1:], len(by))):
            own = by[x:y]
            joined = np.concatenate([data[at[n] : at[n + 1]] for n in own.tolist()])
            inner = R.offsets(sizes[own])
            places = np.flatnonzero(R.starts_within(inner, length)[: len(joined) - length + 1])
            which = np.searchsorted(inner, places, "right") - 1
            key = R.rolled(VALUE[joined], length)[places] ^ R.mixed(anchor[own][which])
            hit = looked_up(joined, places, key, length)
            out.append(R.stretched(run[own, 0], which, run[own, 1][which] + places - inner[which], hit))
        return np.concatenate(out)

    return merge


def at_ends(grams: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string the places of the least gram of its first quarter and of its last."""
    quarter = max(gram, length // 4)
    least = R.anchors(grams, quarter - gram + 1)
    return least[starts], least[starts + length - quarter]


def removed_bytes(docs: DataFrame, text: str = "text", length: int = 400) -> DataFrame:
    """The documents with `kept` (binary: the bytes that stay), `n_bytes`, `n_removed` and `n_spans` (removed runs); a null text becomes empty."""
    gram = min(GRAM, max(1, length // 2))
    of = buckets(docs.sparkSession)
    new = [T.StructField("kept", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans"))]
    marked = R.named(docs, text, [f.name for f in new])

    def shards(batches: R.Pieces):
        for batch in pieces(batches, "_text", SHARD):
            names = R.names_of(batch)
            use = R.distinct_twice(names)
            all_texts = texts(batch.column("_text"))
            raw = [all_texts[n] for n in use.tolist()]
            yield batch, names[use], use, np.frombuffer(b"".join(raw), np.uint8), R.offsets([len(x) for x in raw])

    def keys(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Anchors with zero, strings at anchors that the piece has twice by two hashes."""
        data, at = np.frombuffer(b"".join(raw), np.uint8), R.offsets([len(x) for x in raw])
        starts, anchor, grams = anchored(data, at, length, gram)
        place = np.unique(anchor)
        twice = np.zeros(len(grams), bool)
        twice[place[R.again(grams[place])]] = True
        one, two = string_keys(data, starts[twice[anchor]])
        return np.concatenate((grams[place], one)), np.concatenate((np.zeros(len(place), np.uint64), two))

    def string_keys(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return R.rolled(VALUE[data], length)[starts], R.rolled(VALUE[data], length, 1)[starts] | np.uint64(1)

    known = R.common(marked, keys, SHARD)

    def find_anchors(batches: R.Pieces) -> R.Pieces:
        for _, names, _, data, at in shards(batches):
            _, anchor, grams = anchored(data, at, length, gram)
            place = np.unique(anchor)
            key = grams[place]
            sure = known.holds(key, 0)
            twice, send = R.again(key) | sure, R.first_of_each(key) & ~sure
            yield R.sent(of, names, at, (place[send], place[send]), key[send], None, R.stretches(place[twice], R.text_of(at, place[twice])))

    def sort_shards(batches: R.Pieces) -> R.Pieces:
        for batch, names, use, data, at in shards(batches):
            edge = np.zeros(len(data) + 1, np.int64)
            for k, n in enumerate(use.tolist()):
                np.add.at(edge, np.asarray(batch.column("first")[n].values) + at[k], 1)
                np.add.at(edge, np.asarray(batch.column("last")[n].values) + at[k] + 1, -1)
            candidate = np.cumsum(edge[:-1]) > 0
            starts, anchor, grams = anchored(data, at, length, gram)
            own = candidate[anchor]
            starts, anchor = starts[own], anchor[own]
            hot = known.holds(grams[anchor], 0)
            sure = np.zeros(len(starts), bool)
            sure[hot] = known.holds(*string_keys(data, starts[hot]))
            settled, starts, anchor, hot = starts[sure], starts[~sure], anchor[~sure], hot[~sure]
            twice, kind = in_shard(data, starts, length)
            key, cut = grams[anchor], anchor
            if hot.any():  # runs of their own, dealt by both ends of the strings too
                a, b = at_ends(grams, starts[hot], length, gram)
                key[hot] = R.mixed(key[hot] ^ R.mixed(grams[a] ^ R.mixed(grams[b])))
                cut = np.stack((anchor, np.full(len(starts), -1), np.full(len(starts), -1)), axis=1)
                cut[hot, 1], cut[hot, 2] = a, b
                cut = np.append(0, np.cumsum((np.diff(cut, axis=0) != 0).any(axis=1)))
            first, last = R.stretches(starts, cut)
            begun = np.searchsorted(starts, first)
            send = np.add.reduceat(kind, begun, dtype=np.int64) > 0 if len(begun) else np.zeros(0, bool)
            first, last = first[send], last[send]
            loads = [data[x : y + length].tobytes() for x, y in zip(first, last)]
            yield R.sent(of, names, at, (first, last), key[begun[send]], loads, R.stretches(np.sort(np.concatenate((starts[twice], settled)))))

    candidates = R.met(marked.select("k1", "k2", "_text").mapInArrow(given_back(find_anchors), R.SENT), lambda run, anchor, _: run[R.again(anchor)])
    # The same columns as below, so that the texts are dealt out once for both joins.
    ranges = R.met(R.beside(marked, candidates).mapInArrow(given_back(sort_shards), R.SENT), across_shards(length))
    schema = T.StructType([marked.schema["_row"], T.StructField("_text", T.StringType()), *new])

    def take(batches: R.Pieces) -> R.Pieces:
        for batch in pieces(batches, "_text", SHARD):
            kept, counts = [], []
            for n, raw in enumerate(texts(batch.column("_text"))):
                if (first := batch.column("first")[n].values) is None:
                    kept.append(raw)
                    counts.append((len(raw), 0, 0))
                    continue
                gone = R.covered(np.asarray(first), np.asarray(batch.column("last")[n].values), length, len(raw))
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                counts.append((len(raw), int(gone.sum()), int(gone[:1].sum() + (np.diff(gone.astype(np.int8)) == 1).sum())))
            out = [pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in zip(*counts))]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_text"), *out], names=schema.names)

    out = marked.join(ranges, ["k1", "k2"], "left").mapInArrow(given_back(take), schema)
    return R.restored(out, docs, text, [f.name for f in new])


def digests(docs: DataFrame) -> DataFrame:
    out = removed_bytes(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
