"""Fill-in-the-middle transformation by a piece table.

A document is a list of descriptors (start, length) over two immutable buffers: its own UTF-8 bytes and
the bytes of the three sentinels. Cutting splits descriptors, arranging permutes them and puts sentinel
descriptors between, the inverse permutation restores the text; hashes are fed descriptor by descriptor.
No bytes are moved before a text is laid out for a column.

Cuts fall between tokens: `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+` or white space at the end. What is cut and
in which form depends on the seed and the key alone, so repeated rows come out equal, reruns agree, and
a lost executor's rows are made again as they were.

Forms: plain (the text as it is), psm (prefix, suffix, middle) and spm (suffix, prefix, middle). Texts that
hold a sentinel themselves stay plain, so what stands before, between and behind sentinels is always told
apart. Null and empty texts are plain with no tokens; null stays null. Texts of any length are handled
whole, one at a time. A null key is drawn as if its digits were none. Empty tables give empty ones; the
caller's columns pass through, and the new ones replace those of the same names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import fresh, pieces, texts

#: The sentinels' buffer, and where each begins in it.
MARKS = b"<P><S><M>"
P, S, M = 0, 3, 6
#: Order of the parts (0 prefix, 1 suffix, 2 middle) in each form, with their sentinels.
FORMS = {"psm": ((P, 0), (S, 1), (M, 2)), "spm": ((S, 1), (P, 0), (M, 2))}


class Piece(NamedTuple):
    buffer: bytes
    start: int
    length: int

    def view(self) -> memoryview:
        return memoryview(self.buffer)[self.start : self.start + self.length]


def token_ends(text: bytes) -> np.ndarray:
    """Offset behind each token, ascending."""
    a = np.frombuffer(text, np.uint8)
    if not len(a):
        return np.zeros(0, np.int64)
    space = (a == 32) | ((a >= 9) & (a <= 13))
    last = ~space
    last[:-1] &= space[1:]
    last[-1] = True
    return np.flatnonzero(last) + 1


def cut(table: list[Piece], at: int) -> list[Piece]:
    """The same text with a boundary at this offset; descriptors may become empty, so that parts keep their number."""
    out, done = [], False
    for x in table:
        if not done and at <= x.length:
            out += [Piece(x.buffer, x.start, at), Piece(x.buffer, x.start + at, x.length - at)]
            done = True
        else:
            out.append(x)
            at -= x.length
    return out


def arranged(table: list[Piece], form: str) -> list[Piece]:
    """table: prefix, middle, suffix. The descriptors of the output."""
    parts = (table[0], table[2], table[1])
    return [x for mark, part in FORMS[form] for x in (Piece(MARKS, mark, 3), parts[part])]


def parsed(output: bytes, form: str) -> list[Piece]:
    """Descriptors of an output: sentinels and parts in turn. A sentinel can't lie across a boundary, as it begins and ends with signs of its own."""
    marks, at, begins = [MARKS[m : m + 3] for m, _ in FORMS[form]], 0, []
    for mark in marks:
        begins.append(at := output.index(mark, at))
        at += 3
    ends = [*begins[1:], len(output)]
    return [x for a, b in zip(begins, ends) for x in (Piece(output, a, 3), Piece(output, a + 3, b - a - 3))]


def inverse(table: list[Piece], form: str) -> list[Piece]:
    """Prefix, middle and suffix of arranged descriptors, without sentinels."""
    of = {part: table[2 * n + 1] for n, (_, part) in enumerate(FORMS[form])}
    return [of[0], of[2], of[1]]


def laid(table: list[Piece]) -> bytes:
    return b"".join(x.view() for x in table)


def sha256(table: list[Piece]) -> str:
    h = hashlib.sha256()
    for x in table:
        h.update(x.view())
    return h.hexdigest()


def chars(piece: Piece) -> int:
    """Code points."""
    return int(np.count_nonzero(np.frombuffer(piece.view(), np.uint8) & 0xC0 != 0x80)) if piece.length else 0


def drawn(key: object, seed: int) -> tuple[int, ...]:
    """The first four numbers that a key's hash gives."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[n : n + 8], 16) for n in range(0, 32, 8))


def made(text: bytes, key: object, seed: int, rate: int, spm: int) -> tuple[list[Piece], str, int, int | None, int | None]:
    """(descriptors of the output, form, tokens, characters of the prefix, of the middle)."""
    ends = token_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = drawn(key, seed)
    whole = [Piece(text, 0, len(text))]
    if not text or any(MARKS[m : m + 3] in text for m in (P, S, M)) or h3 % 100 >= rate:
        return whole, "plain", n, None, None
    at = lambda units: int(ends[units - 1]) if units else 0
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    table = cut(cut(whole, at(last)), at(first))
    form = "spm" if h4 % 100 < spm else "psm"
    return arranged(table, form), form, n, chars(table[0]), chars(table[1])


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, name: str = "fim") -> DataFrame:
    """Adds `fim` (the output text), `form`, `n` (tokens), `prefix_chars`, `middle_chars` (null if plain) and `output_sha256`.

    Of 100 documents about `rate` are cut, of these about `spm` put the suffix first.
    """
    new = [T.StructField(name, T.StringType()), T.StructField("form", T.StringType()), T.StructField("n", T.LongType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output_sha256", T.StringType())]
    names = [x.name for x in new]
    if {key.lower(), text.lower()} & {x.lower() for x in names}:
        raise ValueError("key and text need names other than the new columns'")
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            rows = [made(x, k, seed, rate, spm) for x, k in zip(texts(batch.column(text)), batch.column(key).to_pylist())]
            table, form, n, prefix, middle = zip(*rows)
            out = [None if null else laid(x) for x, null in zip(table, batch.column(text).is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()).cast(pa.string()), pa.array(form), pa.array(n, pa.int64()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array([sha256(x) for x in table])], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


def restore(made: DataFrame, output: str = "fim", form: str = "form", name: str = "restored") -> DataFrame:
    """Adds the text that output and form make; null where the output is. Nothing else is read."""
    kept = made.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, output):
            null = batch.column(output).is_null().to_pylist()
            out = [None if no else x if f == "plain" else laid(inverse(parsed(x, f), f)) for x, f, no in zip(texts(batch.column(output)), batch.column(form).to_pylist(), null)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()).cast(pa.string())], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    (text,) = fresh(docs.select("doc_id"), "text")
    out = restore(transform(docs.select("doc_id", F.col("text").alias(text)))).drop(text)
    sha = F.sha2(F.coalesce("restored", F.lit("")), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", sha.alias("restored_sha256"))
