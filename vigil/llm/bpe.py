"""Byte-level BPE encoding and decoding with a public tokenizer file.

Each word is merged over a contiguous rank array: part boundaries and the ranks of adjacent parts
are plain lists; the smallest rank is found by a scan, its inner boundary deleted and the two
neighbouring ranks refreshed. Words of more than LONG bytes, for which repeated scans would be
quadratic, take the same merges from a heap of ranks over linked parts.

Null and empty texts have no tokens and decode to the empty text. Rows are kept one to one,
repeated rows included; other columns pass through unchanged, and an existing column with an
output's name is replaced. Very long texts are encoded whole, one at a time; an empty table gives an
empty one.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import given_back, pieces

LONG = 200
NO_RANK = 1 << 60
CACHE = 120_000

# Letters and numbers of Unicode 17 that the tokenizer's older tables do not know.
UNKNOWN = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_OLD = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in UNKNOWN)
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORDS_OLD = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{_OLD}]]+| ?[\p{{N}}--[{_OLD}]]+"
    rf"| ?[[^\s\p{{L}}\p{{N}}]||[{_OLD}]]+|\s+(?!\S)|\s+",
    regex.V1,
)
HAS_OLD = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNKNOWN) + "]")
SPACE_RUN = re.compile(r"\s ")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such vocabularies: printable ones for themselves, others from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(rest)}


class Kept(dict):
    """Results by text: at most CACHE of them, made on first use; texts over LONG are not kept."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, text: str) -> bytes:
        out = self.make(text)
        if len(text) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[text] = out
        return out


class Codec:
    """Encodes and decodes with one vocabulary.

    `merge` maps two adjacent parts, as id * WIDE + id, to rank * WIDE + id of the merged part, so
    that the smallest value is the merge of the smallest rank.
    """

    WIDE = 1 << 20

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        letter = byte_letters()
        as_bytes = lambda s: bytes(letter[c] for c in s)
        ids = {as_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merge = {}
        for rank, (a, b) in enumerate((as_bytes(a), as_bytes(b)) for a, b in pairs):
            self.merge[ids[a] * self.WIDE + ids[b]] = rank * self.WIDE + ids[a + b]
        self.byte = [ids[bytes([b])] for b in range(256)]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.added = {k: np.array([v], "<u4").tobytes() for k, v in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.piece = [b""] * (1 + max([*ids.values(), *added.values()]))
        for k, v in ids.items():
            self.piece[v] = k
        for k, v in added.items():
            self.piece[v] = k.encode()
        self.words = Kept(lambda word: struct.pack(f"<{len(x)}I", *x) if (x := self.merged(word.encode())) else b"")
        self.spaced = Kept(lambda rest: self._plain(" " + rest))

    def merged(self, word: bytes) -> list[int]:
        """Ids of the word's parts once no adjacent two can be merged."""
        if len(word) > LONG:
            return self._merged_long(word)
        get, wide = self.merge.get, self.WIDE
        parts = [self.byte[b] for b in word]  # a part begins at each boundary
        ranks = [get(a * wide + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != NO_RANK:
            i = ranks.index(low)
            parts[i] = new = low % wide
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new * wide + parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = get(parts[i - 1] * wide + new, NO_RANK)
        return parts

    def _merged_long(self, word: bytes) -> list[int]:
        """The same from a heap of (merge, place), parts linked to their neighbours."""
        n, get, wide = len(word), self.merge.get, self.WIDE
        parts = [self.byte[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            if (b := after[a]) < n and (found := get(parts[a] * wide + parts[b])) is not None:
                heapq.heappush(heap, (found, a, parts[a], parts[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            low, a, left, right = heapq.heappop(heap)
            if parts[a] != left or (b := after[a]) >= n or parts[b] != right:
                continue  # merged otherwise meanwhile
            parts[a], parts[b], after[a] = low % wide, -1, after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [x for x in parts if x >= 0]

    def _plain(self, text: str) -> bytes:
        found = (WORDS_OLD if not text.isascii() and HAS_OLD.search(text) else WORDS).findall(text)
        return b"".join(map(self.words.__getitem__, found))

    def _segment(self, text: str) -> bytes:
        # Words never reach over a space that follows a non-space, so such texts are cut there first.
        if text[:1] == " " or SPACE_RUN.search(text):
            return self._plain(text)
        first, *rest = text.split(" ")
        return self._plain(first) + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split is None:
            return self._segment(text)
        return b"".join(self.added[x] if n % 2 else self._segment(x) for n, x in enumerate(self.split.split(text)) if x)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.piece.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")


_CODECS: dict[int, Codec] = {}


def _codec(content: bytes) -> Codec:
    """One codec a worker and vocabulary."""
    key = hash(content)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(content)
    return _CODECS[key]


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Adds `ids` (binary, little-endian unsigned 32-bit), `n_tokens` and, if asked, `decoded` (the ids decoded again)."""
    with open(tokenizer_path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    new = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    new += [T.StructField("decoded", T.StringType())] * decoded
    names = {f.name for f in new}
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value)
        for batch in pieces(batches, text):
            ids = [codec.encode(x) if x else b"" for x in batch.column(text).to_pylist()]
            out = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if decoded:
                out.append(pa.array([codec.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *(f.name for f in new)])

    return kept.mapInArrow(given_back(run), schema)


def decode(encoded: DataFrame, tokenizer_path: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded`, the text of the ids; null ids decode to the empty text."""
    with open(tokenizer_path, "rb") as f:
        content = encoded.sparkSession.sparkContext.broadcast(f.read())
    kept = encoded.drop("decoded")
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value)
        for batch in batches:
            out = pa.array([codec.decode(x or b"") for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(given_back(run), schema)


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded text."""
    out = encode(docs.select("doc_id", "text"), tokenizer_path, decoded=True)
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
