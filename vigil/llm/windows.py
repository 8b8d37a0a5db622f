"""Substring dedup over words: windows repeated at one length alone are extended to twice that length.

The wanted length is halved STEPS times (35: 9, 18, 35 words), and the levels run from the shortest
up. A window that repeats at one level is extended to twice its words, to the right where that stays
inside the full window it stands for, else to the left; the next level judges only such extensions,
and the last one only full windows that hold a survivor. A level without survivors leaves nothing to
judge for those above it, so the work ends where no candidates survive.

The first level is thinned without loss: a full window is stood for by one of its shortest windows,
the one with the least hash. Which one that is, and how it is extended, depends on the words of the
full window alone, so equal full windows climb by equal windows: if one of these occurs nowhere
else, neither does the full window. Every level meets by content in buckets (see repeats.py); repeats
within a piece of some megabytes are settled before anything is sent, so are windows that are frequent in a
sample of the texts, and full windows that climbed by such a one are dealt by their own hashes.

Words are runs of other characters than space, tab, line feed, vertical tab, form feed and carriage
return. Every covered word goes, the first occurrence included; windows never reach over documents
and are judged on the input. Null and empty texts have no words. Equal texts share their result;
repeated rows count as occurrences. Very long texts are read whole, one at a time where they exceed a
piece. An empty table gives an empty one. Columns of the caller that have the names of new ones are
replaced by these, all others pass through. Windows are told apart by 64-bit hashes of the window and
of the one it was extended from, both equal only by chance of about 2**-128 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm import repeats as R
from vigil.llm.common import buckets, given_back, pieces, texts

CACHE = 150_000
#: Times that the wanted length is halved.
STEPS = 2
#: Bytes of a piece of the sample.
SAMPLED = 4 << 20


class WordHashes(dict):
    """XXH64 by word; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def hashed(found: list[bytes], kept: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of these texts in turn, and the texts' offsets."""
    words = [x.split() for x in found]
    at = R.offsets([len(x) for x in words])
    flat = np.fromiter((kept[w] for x in words for w in x), np.uint64, at[-1])
    return flat, at


def levels(length: int) -> list[int]:
    """Window lengths from the shortest up; each is at most twice the one before."""
    out = [length]
    while len(out) <= STEPS and out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out


def climbed(values: np.ndarray, at: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(starts of full windows; for each level below the last the places of the windows they climb by; hashes of all windows of its length).

    sizes: the levels' lengths, or the first of them: as far as is needed. The last entry is the full length.
    """
    length = sizes[-1]
    grams = [R.rolled(values, size, 1) for size in sizes[:-1]]
    if len(values) < length:
        return np.zeros(0, np.int64), [np.zeros(0, np.int64) for _ in grams], grams
    starts = np.flatnonzero(R.starts_within(at, length)[: len(values) - length + 1])
    places = [R.anchors(grams[0], length - sizes[0] + 1)[starts]]
    for short, long in zip(sizes, sizes[1:-1]):
        last = places[-1]
        places.append(np.where(last + long <= starts + length, last, last + short - long))
    return starts, places, grams


def removed_words(docs: DataFrame, text: str = "text", length: int = 35) -> DataFrame:
    """The documents with `kept` (the words that stay, joined by a space), `n_words` and `n_removed`; a null text becomes empty."""
    if length < 2:
        raise ValueError("a window has two words at least")
    of, sizes = buckets(docs.sparkSession), levels(length)
    new = [T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    marked = R.named(docs, text, [f.name for f in new])
    last_gram = len(sizes) - 2

    def keys(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Windows of each level with the level, full windows with the one of the last level that they hold."""
        values, at = hashed(raw, WordHashes())
        starts, places, grams = climbed(values, at, sizes)
        short = [g[np.unique(p)] for g, p in zip(grams, places)]
        levels_of = [np.full(len(x), k, np.uint64) for k, x in enumerate(short)]
        full_keys = R.rolled(values, length)[starts] if len(starts) else np.zeros(0, np.uint64)
        return np.concatenate((*short, full_keys)), np.concatenate((*levels_of, grams[-1][places[-1]]))

    known = R.common(marked, keys, SAMPLED)

    def hashes(batches: R.Pieces):
        kept = WordHashes()
        for batch in pieces(batches, "_text"):
            names = R.names_of(batch)
            use = R.distinct_twice(names)
            all_texts = texts(batch.column("_text"))
            yield batch, names[use], use, *hashed([all_texts[n] for n in use.tolist()], kept)

    def survivors(batch: pa.RecordBatch, use: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """For each place whether its window of the level before repeats."""
        edge = np.zeros(n + 1, np.int64)
        firsts, lasts = batch.column("first"), batch.column("last")
        for k, row in enumerate(use.tolist()):
            np.add.at(edge, np.asarray(firsts[row].values) + at[k], 1)
            np.add.at(edge, np.asarray(lasts[row].values) + at[k] + 1, -1)
        return np.cumsum(edge[:-1]) > 0

    def level(k: int):
        """Sends the windows of level k: at the first all that full windows are stood for by, at others the extensions of survivors."""

        def run(batches: R.Pieces) -> R.Pieces:
            for batch, names, use, values, at in hashes(batches):
                _, places, grams = climbed(values, at, [*sizes[: k + 1], length])
                place = places[k]
                if k:
                    place = place[survivors(batch, use, at, len(values))[places[k - 1]]]
                place = np.unique(place)
                key = grams[k][place]
                sure = known.holds(key, k)
                twice, send = R.again(key) | sure, R.first_of_each(key) & ~sure
                yield R.sent(of, names, at, (place[send], place[send]), key[send], None, R.stretches(place[twice], R.text_of(at, place[twice])))

        return run

    def full(batches: R.Pieces) -> R.Pieces:
        """Sends the full windows that hold a survivor: as runs that climbed by the same one, each for itself where that one is hot."""
        for batch, names, use, values, at in hashes(batches):
            starts, places, grams = climbed(values, at, sizes)
            own = survivors(batch, use, at, len(values))[places[-1]]
            starts, anchor = starts[own], places[-1][own]
            key, gram = R.rolled(values, length)[starts], grams[-1][anchor]
            sure, hot = known.holds(key, gram), known.holds(gram, last_gram)
            twice, wanted = R.again(key) | sure, R.first_of_each(key) & ~sure
            # A run is sent if it holds the first of any equal windows; the others are settled here.
            cold, alone = np.flatnonzero(~hot), np.flatnonzero(hot & wanted)
            first, last = R.stretches(starts[cold], anchor[cold])
            begun = np.searchsorted(starts[cold], first)
            send = np.add.reduceat(wanted[cold], begun, dtype=np.int64) > 0 if len(begun) else np.zeros(0, bool)
            loads = [key[cold[a:b]].tobytes() for a, b, s in zip(begun, np.append(begun[1:], len(cold)), send) if s]
            loads += [x.tobytes() for x in key[alone]]
            met = np.concatenate((gram[cold[begun[send]]], R.mixed(gram[alone] ^ R.mixed(key[alone]))))
            runs = (np.concatenate((first[send], starts[alone])), np.concatenate((last[send], starts[alone])))
            yield R.sent(of, names, at, runs, met, loads, R.stretches(starts[twice]))

    def repeated(run: np.ndarray, anchor: np.ndarray, loads: list[bytes]) -> np.ndarray:
        return run[R.again(anchor)]

    def full_repeated(run: np.ndarray, anchor: np.ndarray, loads: list[bytes]) -> np.ndarray:
        key = np.frombuffer(b"".join(loads), "<u8")
        counts = run[:, 2] - run[:, 1] + 1
        which = np.repeat(np.arange(len(run)), counts)
        start = run[which, 1] + np.arange(len(key)) - R.offsets(counts)[which]
        return R.stretched(run[:, 0], which, start, R.again(key, anchor[which]))

    found = R.met(marked.select("k1", "k2", "_text").mapInArrow(given_back(level(0)), R.SENT), repeated)
    # All joins take the same columns, so that the texts are dealt out once for all of them.
    for k in range(1, len(sizes) - 1):
        found = R.met(R.beside(marked, found).mapInArrow(given_back(level(k)), R.SENT), repeated)
    ranges = R.met(R.beside(marked, found).mapInArrow(given_back(full), R.SENT), full_repeated)
    schema = T.StructType([marked.schema["_row"], T.StructField("_text", T.StringType()), *new])

    def take(batches: R.Pieces) -> R.Pieces:
        for batch in pieces(batches, "_text"):
            kept, n_words, n_removed = [], [], []
            for n, raw in enumerate(texts(batch.column("_text"))):
                words = raw.split()
                gone = 0
                if (first := batch.column("first")[n].values) is not None and len(words) >= length:
                    stay = ~R.covered(np.asarray(first), np.asarray(batch.column("last")[n].values), length, len(words))
                    gone = len(words) - int(stay.sum())
                    n_words.append(len(words))
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                else:
                    n_words.append(len(words))
                kept.append(b" ".join(words).decode())
                n_removed.append(gone)
            out = [pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_text"), *out], names=schema.names)

    out = marked.join(ranges, ["k1", "k2"], "left").mapInArrow(given_back(take), schema)
    return R.restored(out, docs, text, [f.name for f in new])


def digests(docs: DataFrame) -> DataFrame:
    out = removed_words(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def drop_repeated_windows(docs: DataFrame, text: str = "text", length: int = 35) -> DataFrame:
    """The documents without repeated windows: a text that loses words becomes its other words, joined by a space; others stay as they are."""
    rest = [c for c in docs.columns if c != text]
    row = F.struct(F.col(text).isNull().alias("null"), *(F.col(f"`{c}`").alias(f"_{n}") for n, c in enumerate(rest)))
    out = removed_words(docs.select(row.alias("row"), F.col(text).alias("text")), "text", length)
    fewer = F.col("n_removed") > 0
    own = {c: F.col(f"row._{n}") for n, c in enumerate(rest)}
    own[text] = F.when(~F.col("row.null"), F.when(fewer, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in own:
        own["n_chars"] = F.when(fewer, F.char_length("kept").cast("bigint")).otherwise(own["n_chars"])
    return out.select(*(own[c].alias(c) for c in docs.columns))
