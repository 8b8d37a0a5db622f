"""Operators of the subpackage against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from cases import clashing, documents, unclashed
from pyspark.sql import functions as F

from vigil.llm import bpe, calibration, graph, knn, language, mixing, orderminhash, quality, repeats, simhash, suffixes, toxicity, windows

SF = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def key(row):
    return tuple((x is None, x) for x in row)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def words_of(text):
    return (text or "").encode().split()


# --- 1: Order MinHash


def test_order_minhash(spark):
    docs = documents(spark).drop("lang", "source", "n_chars")
    rows = sorted(((d, t or "") for d, t in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = collections.Counter(map(tuple, orderminhash.digests(docs).select("doc_id", "n_chars", "edited_sha256").collect()))
    want = collections.Counter()
    for n, (d, t) in enumerate(rows):
        following, third = rows[(n + 1) % len(rows)][1], len(t) // 3
        want[d, len(t), hashlib.sha256((t[: len(t) - third] + following[:third]).encode()).hexdigest()] += 1
    assert got == want


def test_order_minhash_likeness(spark):
    out = orderminhash.digests(table(spark, "documents")).toPandas()
    assert ((out.near_edited >= 0) & (out.near_edited <= 1) & (out.near_next >= 0) & (out.near_next <= 1)).all()
    assert (out.near_edited > out.near_next).mean() > 0.97
    texts = table(spark, "documents").toPandas().merge(out, on="doc_id")
    assert texts.groupby("text").fingerprint.nunique().max() == 1
    assert texts.fingerprint.nunique() > 0.99 * texts.text.nunique()


def test_order_minhash_hears_order_and_repeats(spark):
    base = [f"w{n}" for n in range(60)]
    variants = [base, base[30:] + base[:30], base + base, base[:50] + ["new"] * 10, [], None]
    df = spark.createDataFrame([(n, None if v is None else " ".join(v)) for n, v in enumerate(variants)], "doc_id long, text string")
    sig = {r["doc_id"]: r["order_minhash"] for r in orderminhash.fingerprints(df).collect()}
    like = lambda a, b: np.mean(np.array(sig[a]) == np.array(sig[b]))
    assert like(0, 0) == 1 and like(4, 5) == 1 and like(0, 4) == 0
    assert 0.2 < like(0, 3) < 1 and like(0, 2) < 1
    assert like(0, 1) < 1  # the same k-mers but for the seam, in another order


def plain_order_minhash(text, size=64, k=3, tuple_size=2):
    """Order MinHash as its docstring says, one order after the other."""
    import re

    import xxhash

    def chained(*values, seed=42):  # as xxhash64 takes several values
        for v in values:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v % (1 << 64)).to_bytes(8, "little"), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    small = lambda *values: signed(xxhash.xxh64_intdigest(values[1].to_bytes(4, "little"), xxhash.xxh64_intdigest(values[0].to_bytes(4, "little"), 42)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [chained(t) for t in re.findall(r"[^\x20\x09-\x0D]{1,8}", text or "")]
    if not h:
        return [0] * size
    grams = [chained(*h[i : i + k]) for i in range(len(h) - k + 1)] if len(h) >= k else [chained(*h)]
    seen, numbered = collections.Counter(), []
    for i, g in enumerate(grams):
        n = seen[g]
        seen[g] += 1
        again = (chained(g) if n else g) if n == 0 else signed(xxhash.xxh64_intdigest(n.to_bytes(4, "little"), xxhash.xxh64_intdigest((g % (1 << 64)).to_bytes(8, "little"), 42)))
        numbered.append((again, i))
    cell = lambda g: min(size - 1, (g + (1 << 63)) // ((1 << 64) // size))
    out = []
    for j in range(size):
        rank = lambda c: -(1 << 63) if c == j else small(j, c)  # noqa: E731, B023
        least = sorted(numbered, key=lambda x: (rank(cell(x[0])), cell(x[0]), *x))[:tuple_size]
        out.append(chained(*(g for g, _ in sorted(least, key=lambda x: (x[1], x[0])))) % 65535 + 1)
    return out


@pytest.mark.parametrize("tuple_size", [2, 3])
def test_order_minhash_against_python(spark, tuple_size):
    rng = random.Random(12)
    texts = [None, "", "one", "one two", "a a a a a a", "longer words than eight letters", "été 日本語 😀"]
    texts += [" ".join(rng.choices(["x", "y", "zeta", "omega", "extraordinary", "né"], k=rng.choice([3, 5, 9, 40, 200, 900]))) for _ in range(40)]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["order_minhash"] for r in orderminhash.fingerprints(df, tuple_size=tuple_size).collect()}
    for n, t in enumerate(texts):
        assert got[n] == plain_order_minhash(t, tuple_size=tuple_size), t


def test_order_minhash_orders_are_independent(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for n in range(100):
        a = [word() for _ in range(8)]
        rows.append((n, " ".join(a), " ".join([*a[:6], word(), word()])))
    df = spark.createDataFrame(rows, "n int, a string, b string").select(orderminhash.signature(F.col("a")).alias("a"), orderminhash.signature(F.col("b")).alias("b")).toPandas()
    assert np.mean([len(set(x)) for x in df.a]) > 12  # of 15 pairs of six k-mers
    assert np.std([np.mean(np.array(x) == np.array(y)) for x, y in zip(df.a, df.b)]) < 0.1


def test_order_minhash_digests_against_python(spark):
    docs = documents(spark, 30).where("doc_id IS NOT NULL AND doc_id < 900").dropDuplicates(["doc_id"])
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    like = lambda a, b: np.mean(np.array(a) == np.array(b))
    sign = {t: plain_order_minhash(t) for _, t in rows}
    got = {r["doc_id"]: r for r in orderminhash.digests(docs).collect()}
    for n, (d, t) in enumerate(rows):
        after, third = rows[(n + 1) % len(rows)][1], len(t) // 3
        edited = plain_order_minhash(t[: len(t) - third] + after[:third])
        assert got[d]["fingerprint"] == "".join(f"{x:04x}" for x in sign[t])
        assert got[d]["edited_fingerprint"] == "".join(f"{x:04x}" for x in edited)
        assert got[d]["near_edited"] == pytest.approx(like(sign[t], edited)) and got[d]["near_next"] == pytest.approx(like(sign[t], sign[after]))


def test_order_minhash_hard_cases(spark):
    docs = documents(spark)
    assert orderminhash.digests(docs.limit(0)).count() == 0
    assert orderminhash.digests(docs.limit(1)).count() == 1
    unclashed(orderminhash.fingerprints(clashing(docs)), ["order_minhash"])
    mixed = clashing(docs).drop("next_text")
    out = orderminhash.with_next(mixed, lambda x: x, ["text"])
    assert out.count() == docs.count() and set(out.columns) == {*mixed.columns, "next_text"}
    unclashed(out, ["next_text"])


def test_neighbours_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(orderminhash, "GROUP", 2)
    monkeypatch.setattr(orderminhash, "RANGES", 4)
    ids = random.Random(1).sample(range(10**12), 300)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    out = {r["doc_id"]: r["next_text"] for r in orderminhash.with_next(df, lambda x: x, ["text"]).collect()}
    order = sorted(ids, reverse=True)
    assert out == {a: str(b) for a, b in zip(order, order[1:] + order[:1])}


# --- 2, 8, 9: classifiers


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_classifier(spark, module, label, least):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    out = module.predictions(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert (out.held_out == [held(d) for d in out.doc_id]).all() and (out.predicted == (out.score >= least)).all()
    known = out[out.held_out].merge(labels.toPandas(), on="doc_id")
    y = known[label]
    order = known.score.rank()
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.95 and (known.predicted == y).mean() > 0.95


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifier_never_learns_held_out_labels(spark, module):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    lied = labels.withColumns({c: F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    a, b = (sorted(map(tuple, module.predictions(docs, x).select("doc_id", "score").collect())) for x in (labels, lied))
    assert a == b


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifier_hard_cases(spark, module):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(60)] + [(None, 1, 1), (3, None, None), (4, 7, 7), (903, 1, 0)], "doc_id long, quality int, toxic int")
    for x in (labels, labels.limit(0), labels.where("quality = 1 AND toxic = 1")):
        out = module.predictions(docs, x)
        assert out.count() == docs.count() and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert module.predictions(docs.limit(0), labels).count() == 0
    mixed = clashing(docs)
    unclashed(module.score(mixed, module.train(mixed, labels)), ["score"])


def test_toxic_documents_go(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    left = kept.join(labels, "doc_id").groupBy("toxic").count().collect()
    total = {r["toxic"]: r["count"] for r in docs.join(labels, "doc_id").groupBy("toxic").count().collect()}
    left = {r["toxic"]: r["count"] for r in left}
    assert left[0] > 0.98 * total[0] and left.get(1, 0) < 0.25 * total[1]


def plain_ftrl(rows, labels, epochs, seed, alpha=1.0, beta=1.0, l1=6.0, l2=1.0):
    """FTRL-proximal for one coordinate after the other."""
    import math

    z, n, bias = collections.defaultdict(float), collections.defaultdict(float), 1 << toxicity.BITS

    def weight(i):
        low = 0.0 if i == bias else l1
        return 0.0 if abs(z[i]) <= low else -(z[i] - math.copysign(low, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at = [*rows[k].tolist(), bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - labels[k]
            for i in at:
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - s * w[i]
                n[i] += g * g
    return {i: weight(i) for i in n if n[i] > 0}


def test_ftrl_against_python():
    rng = random.Random(4)
    rows = [np.array(sorted(rng.sample(range(300), rng.randint(0, 25))), np.int64) for _ in range(400)]
    labels = np.array([float(len({3, 7, 11} & set(x.tolist())) > 0) for x in rows])
    at, w, seen = toxicity.ftrl(rows, labels, 3, 5)
    want = plain_ftrl(rows, labels, 3, 5)
    assert set(at.tolist()) == set(want) and seen.min() == 1
    assert np.allclose(w, [want[i] for i in at.tolist()])
    assert (w == 0).sum() > 50 and w[np.searchsorted(at, 3)] > 0


def test_features_against_python():
    kept = toxicity.WordHashes()
    texts = ["Toxic words, toxic WORDS again", None, "", "one", "a b"]
    found, at = toxicity.features(texts, kept)

    def hashed(w):
        return zlib.crc32(w.encode())

    def top(x):
        return x % (1 << 64) >> (64 - toxicity.BITS)

    one, near, gap, stems = (int(x) for x in (toxicity.ONE, toxicity.NEXT, toxicity.GAP, toxicity.STEMS))
    for n, t in enumerate(texts):
        w = toxicity.WORD.findall((t or "").lower())
        want = [top((hashed(x) + 1) * one) for x in w] + [top((hashed(x[: toxicity.STEM]) ^ stems) * one) for x in w]
        for apart, by in ((1, near), (2, gap)):
            want += [top((((hashed(x) * near + hashed(y) + 1) % (1 << 64)) ^ by) * one) for x, y in zip(w, w[apart:])]
        assert sorted(found[at[n] : at[n + 1]].tolist()) == sorted(want)


def test_language_against_python(spark):
    docs = documents(spark, 60).unionByName(spark.createDataFrame([(960 + i, "пример текста " * (i + 1), "ru", None, 1) for i in range(4)], documents(spark).schema))
    dim, names = language.DIM, None

    def vector(text):
        codes = [0]
        for c in f" {text} ":
            x = language.letter_code(ord(c)) if c.isalpha() else 0
            if x or codes[-1]:
                codes.append(x)
        codes = codes if codes[-1] == 0 else [*codes, 0]
        out = np.zeros(dim)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            out += np.roll(language.signs(a), 2).astype(int) * np.roll(language.signs(b), 1) * language.signs(c)
        return out

    has = lambda t: any(c.isalpha() for c in t or "")
    norm = lambda v: v / max(np.linalg.norm(v), 1e-9)
    rows, sums = docs.collect(), collections.defaultdict(lambda: np.zeros(dim))
    for r in rows:
        if r["lang"] is not None and r["doc_id"] is not None and not held(r["doc_id"]):
            sums[r["lang"]] += norm(vector(r["text"])) if has(r["text"]) else 0
    names = sorted(sums)
    prototypes = np.array([norm(sums[x]) for x in names])
    got = collections.Counter((r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in language.predictions(docs).collect())
    want = collections.Counter()
    for r in rows:
        cosine = prototypes @ norm(vector(r["text"])) if has(r["text"]) else None
        soft = None if cosine is None else np.exp(language.SHARP * (cosine - cosine.max()))
        want[(r["doc_id"], "und" if soft is None else names[int(cosine.argmax())], 0.0 if soft is None else round(float(soft.max() / soft.sum()), 3))] += 1
    assert got == want


def test_quality_differences_against_python(spark):
    import zstandard

    docs = documents(spark, 40)
    good, bad = b"the of and alpha beta gamma " * 60, "été löwe x1 Delta ".encode() * 60
    got = {(r["doc_id"], r["text"]): r["x"] for r in quality.differences(docs, (bad, good), "text", "x").collect()}
    for (_, t), x in got.items():
        raw, sizes = (t or "").encode(), []
        for content in (bad, good):
            by = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(by.compress(raw[a : a + quality.CHUNK])) for a in range(0, len(raw), quality.CHUNK)))
        assert x == pytest.approx((sizes[0] - sizes[1]) / max(1, len(raw)))


def test_dictionary_samples_are_chosen_by_hash(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} text {i} " * 400) for i in range(400)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    monkeypatch.setattr(quality, "SAMPLES", 100)
    (bad, good), knots, values = quality.train(docs, labels)
    seen = {int(x) for x in __import__("re").findall(rb"text (\d+) ", good)}
    assert len(seen) > 10 and max(seen) > 200 and min(seen) < 200  # from all over the table


def test_language(spark):
    docs = table(spark, "documents")
    out = language.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.held_out == [held(d) for d in out.doc_id]).all() and out.score.between(0, 1).all()
    assert (out[out.held_out].lang == out[out.held_out].lang_pred).mean() > 0.98


def test_language_hard_cases(spark):
    docs = documents(spark).unionByName(spark.createDataFrame([(950, "123 !?", "en", None, 1), (951, "😀 12", None, None, 1), (952, "𝔘𝔫", None, None, 1)], documents(spark).schema))
    out = {r["doc_id"]: r for r in language.predictions(docs).collect()}
    assert len(language.predictions(docs).collect()) == docs.count()
    for d in (902, 903, 905, 950, 951):
        assert out[d]["lang_pred"] == "und" and out[d]["score"] == 0
    assert out[906]["lang_pred"] in ("en", "fr") and out[952]["lang_pred"] in ("en", "fr")
    assert language.predictions(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.predictions(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    unclashed(language.identify(clashing(docs), (["en"], np.ones((1, language.DIM), np.float32))), ["lang_pred", "score"])


def test_ngram_vectors_are_bound_letters():
    table_ = language.ngram_vectors().reshape(language.SYMBOLS, language.SYMBOLS, language.SYMBOLS, language.DIM)
    signs = np.random.default_rng(language.SEED).integers(0, 2, (language.SYMBOLS, language.DIM)) * 2 - 1
    assert (table_[3, 7, 5] == np.roll(signs[3], 2) * np.roll(signs[7], 1) * signs[5]).all()
    made, some = language.vectors(["ab", "", "b a"])
    a, b = (language.codes()[ord(c)] for c in "ab")
    assert (made[0] == table_[0, a, b].astype(int) + table_[a, b, 0]).all()
    assert some.tolist() == [True, False, True]
    assert (made[2] == table_[0, b, 0].astype(int) + table_[b, 0, a] + table_[0, a, 0]).all()


def test_curves():
    x = np.array([0.0, 1, 2, 3, 4, 5])
    knots, values = calibration.rising(x, np.array([0.0, 1, 0, 1, 1, 1]))
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all() and values.min() > 0 and values.max() < 1
    scale, offset = calibration.platt(x, (x > 2.5).astype(float))
    p = 1 / (1 + np.exp(-(scale * x + offset)))
    assert (np.diff(p) > 0).all() and p[2] < 0.5 < p[3]
    assert calibration.platt(x, np.ones(6))[0] == 0


# --- 3: BPE


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def hard_texts():
    rng = random.Random(1)
    letters = [*"ab 'st\n\t  12!é<|end", "<|endoftext|>", "՘", "\x1c", "\x85", " ", "😀", "ﬁ", "́", "日"]
    made = ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(3000)]
    return made + ["", "x" * 3000, "ab" * 2000 + "  ", "don't we'll '", "  a  b\n c \t\td", "<|endoftext|><|endoftext|>", "e" * 201, " " * 500 + "a"]


def test_bpe_codec(reference):
    codec = bpe.Codec(open(VOCABULARY, "rb").read())
    texts = hard_texts()
    for text, want in zip(texts, reference.encode_batch(texts, add_special_tokens=False)):
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert codec.decode(ids) == text == reference.decode(want.ids, skip_special_tokens=False)


def test_bpe_long_words_by_heap_equal_short_ones(monkeypatch):
    codec = bpe.Codec(open(VOCABULARY, "rb").read())
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choices("abcdet hineaoXé", k=rng.randint(1, 150))).encode()
        assert codec.merged(word) == codec._merged_long(word)


def test_bpe_digests(spark, reference):
    docs = documents(spark)
    want = []
    for r in docs.collect():
        ids = reference.encode(r["text"] or "", add_special_tokens=False).ids
        text = reference.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert collected(bpe.digests(docs, VOCABULARY), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=key)
    out = bpe.encode(clashing(docs), VOCABULARY)
    unclashed(out, ["ids", "n_tokens"])
    assert bpe.decode(out, VOCABULARY).where("decoded <> coalesce(text, '')").count() == 0
    assert bpe.digests(docs.limit(0), VOCABULARY).count() == 0


# --- 4, 10: repeated substrings and windows


def brute_bytes(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    keys = [[hash(x[i : i + length]) for i in range(len(x) - length + 1)] for _, x in texts]
    count = collections.Counter(itertools.chain(*keys))
    out = []
    for (d, x), own in zip(texts, keys):
        gone = bytearray(len(x))
        for i, k in enumerate(own):
            if count[k] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((d, len(x), sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


def brute_words(rows, length):
    texts = [(d, words_of(t)) for d, t in rows]
    keys = [[hash(tuple(x[i : i + length])) for i in range(len(x) - length + 1)] for _, x in texts]
    count = collections.Counter(itertools.chain(*keys))
    out = []
    for (d, x), own in zip(texts, keys):
        gone = [False] * len(x)
        for i, k in enumerate(own):
            if count[k] > 1:
                gone[i : i + length] = [True] * length
        kept = b" ".join(w for w, g in zip(x, gone) if not g)
        out.append((d, len(x), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


def sha(c):
    return F.sha2(F.col(c).cast("binary"), 256)


def small(spark):
    rng = random.Random(2)
    rows = [(i, None if i % 17 == 0 else "".join(rng.choices("abé ", k=rng.randint(0, 60)))) for i in range(200)]
    rows += [(None, "ababab"), (5, "xyzab"), (5, "xyzab"), (None, None), (7, "a" * 3000), (8, "a b " * 900)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("length", [2, 9, 17, 30])
def test_repeated_bytes_small(spark, length):
    df = small(spark)
    got = suffixes.removed_bytes(df, length=length)
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", sha("kept")) == brute_bytes(df.collect(), length)


@pytest.mark.parametrize("length", [2, 3, 5, 9])
def test_repeated_words_small(spark, length):
    df = small(spark)
    got = windows.removed_words(df, length=length)
    assert collected(got, "doc_id", "n_words", "n_removed", sha("kept")) == brute_words(df.collect(), length)


def test_repeated_bytes_whole_table(spark):
    docs = table(spark, "documents").select("doc_id", "text").repartition(5)
    assert collected(suffixes.digests(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(docs.collect(), 400)


def test_repeated_words_whole_table(spark):
    docs = table(spark, "documents").select("doc_id", "text").repartition(5)
    assert collected(windows.digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(docs.collect(), 35)


def test_repeats_hard_cases(spark):
    docs = documents(spark)
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert collected(suffixes.digests(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(plain, 400)
    assert collected(windows.digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(plain, 35)
    unclashed(suffixes.removed_bytes(clashing(docs)), ["kept"])
    out = windows.drop_repeated_windows(clashing(docs))
    assert out.columns == clashing(docs).columns and out.count() == docs.count()
    unclashed(out, ["kept"])
    assert windows.digests(docs.limit(0)).count() == 0 == suffixes.digests(docs.limit(0)).count()


def shared_passage(spark, n=400):
    """Texts of which two of three hold one passage of 45 words, each at another place among words of its own; some twice."""
    rng = random.Random(8)
    own = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    passage = own(45)
    rows = []
    for i in range(n):
        words = own(rng.randrange(40, 120))
        if i % 3:
            at = rng.randrange(len(words))
            words[at:at] = passage[rng.randrange(3) : 45 - rng.randrange(3)]
        rows.append((i, " ".join(words)))
    rows += [(n + i, rows[7 * i][1]) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("sample, often", [(16_000, 8), (60, 3), (16_000, 10**9)])
def test_hot_passages_lose_nothing(spark, monkeypatch, sample, often):
    monkeypatch.setattr(repeats, "SAMPLE", sample)
    monkeypatch.setattr(repeats, "OFTEN", often)
    docs = shared_passage(spark)
    rows = docs.collect()
    assert collected(suffixes.digests(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, 400)
    assert collected(windows.digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(rows, 35)
    for length in (60, 150):
        got = suffixes.removed_bytes(docs, length=length).select("doc_id", F.length("text").cast("long"), "n_removed", "n_spans", F.sha2("kept", 256))
        assert sorted(map(tuple, got.collect())) == brute_bytes(rows, length)


def largest_share(spark, monkeypatch, work):
    """The largest part of the loads of one exchange of runs that one bucket of 32 gets."""
    shares, met = [0.0], repeats.met

    def watched(dealt, repeated):
        loads = [r.n for r in dealt.groupBy("bucket").agg(F.sum(F.length("load")).alias("n")).collect()]
        if sum(loads):
            shares.append(max(loads) / sum(loads))
        return met(dealt, repeated)

    monkeypatch.setattr(repeats, "met", watched)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        work()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        monkeypatch.setattr(repeats, "met", met)
    return max(shares)


def test_hot_anchors_are_split(spark, monkeypatch):
    """One short passage in two thirds of the texts, between other words: its runs are dealt to many buckets."""
    docs = shared_passage(spark, 900)
    work = {"words": lambda: windows.removed_words(docs, length=50), "bytes": lambda: suffixes.removed_bytes(docs, length=400)}
    split = {k: largest_share(spark, monkeypatch, w) for k, w in work.items()}
    monkeypatch.setattr(repeats, "OFTEN", 10**9)
    whole = {k: largest_share(spark, monkeypatch, w) for k, w in work.items()}
    assert all(split[k] < 0.2 < whole[k] for k in work), (split, whole)


def test_known_pairs():
    known = repeats.Known([(-1, 2), (5, 7), (5, 1 << 63), (5, -3)])
    one = np.array([5, 5, 5, 4, (1 << 64) - 1, 5], np.uint64)
    two = np.array([7, 1 << 63, 8, 7, 2, (1 << 64) - 3], np.uint64)
    assert known.holds(one, two).tolist() == [True, True, False, False, True, True]
    assert not repeats.Known([]).holds(one, 7).any()


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 700).astype(np.uint8)
    data[300:450] = data[20:170]
    ends = np.full(700, 700)
    for length in (8, 40, 100):
        order = suffixes.suffix_array(suffixes.eights(data), ends, length)
        whole = [p for p in order.tolist() if p + length <= 700]
        assert whole == sorted(range(700 - length + 1), key=lambda p: (bytes(data[p : p + length]), p))
        common = suffixes.common_prefixes(suffixes.eights(data), ends, np.array(whole), length)
        for a, b in zip(whole, whole[1:]):
            n = 0
            while a + n < 700 and b + n < 700 and data[a + n] == data[b + n]:
                n += 1
            assert min(n, length) == min(common[b], length)


def test_strings_are_told_apart_by_their_bytes(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(0, 3, 6000).astype(np.uint8)  # with zero bytes
    data[4000:4700] = data[100:800]
    data[5000:5100] = 0
    places, length = np.arange(len(data) - 59), 60
    count = collections.Counter(bytes(data[p : p + length]) for p in places)
    want = np.array([count[bytes(data[p : p + length])] > 1 for p in places])
    key = repeats.rolled(suffixes.VALUE[data], length)
    for cut in (1 << 20, length * 40):
        monkeypatch.setattr(suffixes, "SLICE", cut)
        for clash in (1, 7, 1000):  # that many different hashes only
            assert (suffixes.looked_up(data, places, key % np.uint64(clash), length) == want).all()
        assert (suffixes.looked_up(data, places, key, length) == want).all()


@pytest.mark.parametrize(("length", "sizes"), [(35, [9, 18, 35]), (9, [3, 5, 9]), (2, [1, 2]), (3, [1, 2, 3])])
def test_levels_double(length, sizes):
    assert windows.levels(length) == sizes
    assert all(short < long <= 2 * short for short, long in zip(sizes, sizes[1:]))


def test_windows_climb_by_content_alone():
    rng = np.random.default_rng(2)
    x = repeats.mixed(rng.integers(0, 40, 500).astype(np.uint64))
    x[300:420] = x[50:170]
    starts, places, _ = windows.climbed(x, np.array([0, 500]), [9, 18, 35])
    for n in range(86):
        assert all(p[300 + n] - (300 + n) == p[50 + n] - (50 + n) for p in places)
    for short, long, sizes in ((places[0], places[1], (9, 18)),):
        assert ((long <= short) & (short + sizes[0] <= long + sizes[1])).all() and ((starts <= long) & (long + sizes[1] <= starts + 35)).all()


def test_anchors_depend_on_content_alone():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, 400).astype(np.uint64)
    x[200:300] = x[30:130]
    place = repeats.anchors(repeats.rolled(repeats.mixed(x), 6), 20)
    for n in range(75):
        assert place[200 + n] - (200 + n) == place[30 + n] - (30 + n)


@pytest.mark.parametrize("alphabets", [("абв", "где"), ("αβγ", "δεζ"), ("山川木", "人月日"), ("𐌰𐌱𐌲", "𐌳𐌴𐌵")])
def test_languages_of_one_script_are_told_apart(spark, alphabets):
    rng = random.Random(6)
    # the n-th letters of both leave the same rest by 3, and words are dealt alike
    alphabets = [sorted(x, key=lambda c: ord(c) % 3) for x in alphabets]
    rows = [(i, " ".join("".join(rng.choices(alphabets[i % 2], k=rng.randint(2, 6))) for _ in range(20)), f"l{i % 2}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["lang_pred"] for r in language.predictions(docs).collect()}
    assert all(out[i] == lang for i, _, lang in rows)
    made, _ = language.vectors([rows[0][1], "a" + rows[0][1]])
    grams = [f" {rows[0][1]} "[n : n + 3] for n in range(len(rows[0][1]))]
    code = lambda c: int(language.letter_codes(np.array([ord(c)], np.uint32))[0])
    bound = [np.roll(language.signs(code(a)), 2) * np.roll(language.signs(code(b)), 1) * language.signs(code(c)) for a, b, c in grams]
    assert (made[0] == np.sum(bound, axis=0, dtype=int)).all()


def test_rare_languages_are_learnt(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(4000)] + [(i, "le chat et le chien", "fr") for i in range(4001, 4007)], "doc_id long, text string, lang string")
    assert language.train(docs, most=40)[0] == ["en", "fr"]


# --- 5: kNN


def brute_knn(rows, every, k=5):
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for n, (i, q) in enumerate(fine):
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(fine) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def found(df, every):
    return sorted(tuple(r) for r in knn.search(df, every=every).select("query_id", "rank", "vec_id", "score").collect())


def test_knn_whole_table(spark):
    df = table(spark, "embeddings").select("vec_id", "embedding")
    assert found(df, 50) == brute_knn(df.collect(), 50)


def test_knn_hard_cases(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 1.0, -1.0, 0.3]) for _ in range(3)]) for i in range(200)] + [(50, [1.0, 0.0, 0.0])] * 3 + [(i, [1.0, 1.0, 1.0]) for i in range(1000, 1150)]
    rows += [(None, [1.0, 1.0, 1.0]), (7, None), (50, [None, 1.0, 1.0]), (100, [float("nan"), 1.0, 1.0]), (150, [float("inf"), 0.0, 0.0]), (200, [1.0]), (250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit("x"), "v": F.lit(1), "label": F.lit(None)})
    want = {e: brute_knn([(r["vec_id"], r["embedding"]) for r in df.collect()], e) for e in (50, 10)}
    assert found(df, 50) == want[50]
    monkeypatch.setattr(knn, "GROUP", 16)
    monkeypatch.setattr(knn, "BLOCK", 100)
    assert found(df.repartition(3), 10) == want[10]
    assert found(df.limit(0), 10) == []


@pytest.mark.parametrize("which", ["long", "wider"])
def test_knn_large_finite_values(spark, monkeypatch, which):
    rng = random.Random(8)
    if which == "long":  # scores that a long holds and a float does not
        rows = [(i, [2.0**22 + i % 7, 2.0**23 - i % 5, 1.0 * i, float(rng.choice([0, 1, -70_000]))]) for i in range(300)]
    else:
        some = [0.0, 1.0, -1.0, 65_537.0, -70_000.0, 3.0e9, 3.0e9 + 256, 1e20, -1e20, 3.4e38, -3.4e38]
        rows = [(i, [rng.choice(some[: 2 + i % 10]) for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_knn([(r["vec_id"], r["embedding"]) for r in df.collect()], 10)
    want = [(q, r, j, s if -(2**63) <= s < 2**63 else None) for q, r, j, s in want]
    assert any(s > 2**53 for *_, s in want) if which == "long" else any(s is None for *_, s in want)
    assert found(df, 10) == want
    monkeypatch.setattr(knn, "GROUP", 8)
    monkeypatch.setattr(knn, "BLOCK", 50)
    assert found(df.repartition(3), 10) == want


def test_knn_clusters_are_pruned_without_loss(spark):
    rows = [(i, [float(x) for x in np.eye(8)[i % 8] * 5 + np.random.default_rng(i).normal(0, 0.1, 8)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(df, 10) == brute_knn(rows, 10)


def test_knn_doubles_of_any_size(spark, monkeypatch):
    rng = random.Random(13)
    some = [0.0, 0.3, -1.0, 77.0, 1e20, -1e150, 1e200, -1e200, 1.7e308, -1.7e308]
    rows = [(i, [rng.choice(some[: 3 + i % 8]) for _ in range(3)]) for i in range(200)] + [(i, [0.5, 1.0 * (i % 9), 2.0]) for i in range(200, 400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [int(np.floor(x * 256)) if abs(x) < 2**40 else int(x) * 256 for x in e]) for i, e in rows]
    want = []
    for n, (i, q) in enumerate(whole):
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(whole) if m != n)[:5]
            want += [(i, r + 1, j, -s if -(2**63) <= -s < 2**63 else None) for r, (s, j) in enumerate(best)]
    assert found(df, 10) == sorted(want, key=key)
    monkeypatch.setattr(knn, "GROUP", 8)
    monkeypatch.setattr(knn, "BLOCK", 50)
    assert found(df.repartition(3), 10) == sorted(want, key=key)
    huge = df.where("vec_id = 0").select("vec_id", F.array(F.lit(1e300)).alias("embedding"))
    assert found(huge.unionByName(huge.withColumn("vec_id", F.lit(7).cast("bigint"))), 10) == [(0, 1, 7, None)]


def test_knn_reach_holds_every_neighbour():
    """All wanted rows of a query lie within its cell's reach, and of clustered data few others do."""
    rng = np.random.default_rng(4)
    k = 6
    for spread in (0.1, 3.0):
        centres = rng.normal(0, 20, (12, 8))
        x = np.floor(256 * (centres[rng.integers(0, 12, 800)] + rng.normal(0, spread, (800, 8))))
        q = np.floor(256 * (centres[rng.integers(0, 12, 100)] + rng.normal(0, spread, (100, 8))))
        most = knn.squares(x).max()
        lx, lq = knn.lifted(x, most), knn.flat(q)
        p = lx[rng.choice(800, 28, replace=False)]
        low, high = knn.distances(lx, knn.squares(lx), p, knn.squares(p))
        cell = high.argmin(axis=1)
        near = {j: sorted(high[cell == j, j])[:k] for j in np.unique(cell).tolist()}
        q_low, q_high = knn.distances(lq, knn.squares(lq), p, knn.squares(p))
        of = q_high.argmin(axis=1)
        asked = {i: q_high[of == i, i].max() for i in np.unique(of).tolist()}
        apart = knn.distances(p, knn.squares(p), p, knn.squares(p))[1]
        reach = knn.reaches(apart, asked, near, k)
        for n, i in enumerate(of.tolist()):
            best = np.argsort(-(x @ q[n]), kind="stable")[:k]
            assert (low[best, i] <= reach[i]).all()
        assert np.array_equal(np.argsort(-(x @ q[0]))[:1], np.argsort(((lx - lq[0]) ** 2).sum(axis=1))[:1])


# --- 6: SimHash


def brute_fingerprint(text, words=3):
    import xxhash

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("which", ["table", "hard"])
def test_simhash(spark, which):
    docs = table(spark, "documents") if which == "table" else documents(spark)
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    root = components_of({f for _, f in rows}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for d, f in rows:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    want = sorted(((d, f"{f:016x}", least.get(root[f])) for d, f in rows), key=key)
    assert collected(simhash.digests(docs), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("most", [1, 2])
def test_links_of_crowded_lists(spark, most):
    rng = random.Random(5)
    nodes = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(150):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(32)
            nodes.add(x)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in nodes}
    df = spark.createDataFrame([(x,) for x in signed.values()], "f long")
    got = {r["node"]: r["root"] for r in graph.components(simhash.links(df, most)).collect()}
    want = components_of(set(signed.values()), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= most)
    assert {n: got.get(n, n) for n in want} == want


def test_components_of_chains_and_none(spark):
    rng = random.Random(1)
    chain = list(range(100))
    rng.shuffle(chain)
    edges = [*zip(chain, chain[1:]), (200, 201), (201, 202), (300, 300), (200, 201)]
    out = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{n: 0 for n in chain}, 200: 200, 201: 200, 202: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, words=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def true_groups(texts, least=0.8):
    """The root of each text; links are likenesses of shingle sets, found through every shared shingle."""
    sets = list({shingle_set(t) for t in texts})
    with_it = collections.defaultdict(list)
    for n, s in enumerate(sets):
        for x in s:
            with_it[x].append(n)
    shared = collections.Counter()
    for own in with_it.values():
        if len(own) < 200:
            shared.update(itertools.combinations(own, 2))
    links = {(a, b) for (a, b), n in shared.items() if n >= least * (len(sets[a]) + len(sets[b]) - n)}
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return {s: find(n) for n, s in enumerate(sets)}, len(links)


def test_one_document_of_each_group_stays(spark):
    docs = clashing(documents(spark))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    unclashed(kept)
    roots, _ = true_groups([r["text"] for r in docs.collect()])
    assert kept.count() == len(set(roots.values()))
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_by_likeness(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, n = [], 0
    for _ in range(60):  # a text, one with a few words changed, one with many
        base = [word() for _ in range(rng.choice([30, 120, 600]))]
        for share in (0, 0.005, 0.015, 0.1):
            own = [word() if rng.random() < share else w for w in base]
            rows.append((n := n + 1, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    roots, links = true_groups([t for _, t in rows])
    of = {d: roots[shingle_set(t)] for d, t in rows}
    least = {r: min(d for d in of if of[d] == r) for r in set(of.values())}
    assert links > 60 and set(least.values()) <= kept
    gone = len(rows) - len(least)
    assert len(kept) - len(least) <= 0.1 * gone  # of those that should go


def test_near_copies_of_a_crowded_group(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(300)]
    rows = [(0, " ".join(base))]
    for n in range(1, 1200):
        own = list(base)
        for p in rng.sample(range(300), rng.randint(0, 4)):
            own[p] = word()
        rows.append((n, " ".join(own)))
    rows += [(2000 + n, " ".join(base[:60] + [word() for _ in range(100)])) for n in range(200)]  # share a passage only
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2000 + n for n in range(200)} <= kept and 0 in kept
    assert len(kept) <= 201 + 12


def test_texts_that_repeat_one_passage_are_no_copies(spark):
    """The passage decides most shingles, not most distinct ones; what is not alike stays."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    line = " ".join(word() for _ in range(12))
    rows = [(n, " ".join([line] * 80 + [word() for _ in range(300)])) for n in range(50)]
    own = [word() for _ in range(40)]
    rows += [(100, " ".join([line] * 80 + own)), (101, " ".join([line] * 80 + own[::-1]))]
    rows += [(200, " ".join([line] * 80)), (201, " ".join([line] * 81))]  # the same set of shingles
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {*range(50), 100, 101, 200}


def test_equal_fingerprints_are_verified(spark, monkeypatch):
    """Should fingerprints say nothing at all, only texts that are alike go."""
    rng = random.Random(10)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(20)]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts + texts[:5])], "doc_id long, text string")
    real = simhash.profiled

    def blind(docs, words):
        out = real(docs, words)
        return out.withColumns({"bits": F.lit(0).cast("bigint"), "wide": F.lit(bytes(simhash.WIDE))})

    monkeypatch.setattr(simhash, "profiled", blind)
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()} == set(range(20))


# --- 7: mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {x: (5, 2, 1)[n % 3] for n, x in enumerate(order)}
    target, free, left = {x: 0.0 for x in order}, set(order), 1.5 * sum(sizes.values())
    while left > 1e-9 and free:
        total = sum(weight[x] for x in free)
        for x in free:
            target[x] += left * weight[x] / total
        left = 0
        for x in list(free):
            if target[x] >= 2 * sizes[x]:
                left += target[x] - 2 * sizes[x]
                target[x] = 2 * sizes[x]
                free.discard(x)
    return target


@pytest.mark.parametrize("which", ["table", "hard"])
def test_mixing(spark, which):
    docs = table(spark, "documents") if which == "table" else documents(spark)
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in out:
        assert r["size"] == len(words_of(r["text"])) and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], abs=1e-6)
        assert all(r["source_size"] == sizes[s] for r in out if r["source"] == s)
        if which == "table":
            assert abs(taken[s] - target[s]) <= 1


def test_fit_is_the_best_subset_sum(monkeypatch):
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 60) * rng.choice([1, 1, 2, 3]): rng.randint(1, 6) for _ in range(rng.randint(1, 10))}
        budget = rng.randint(0, sum(s * c for s, c in counts.items()))
        sums = {0}
        for s, c in counts.items():
            for _ in range(c):
                sums |= {v + s for v in sums if v + s <= budget}
        monkeypatch.setattr(mixing, "WIDE", rng.choice([16, 200, 1 << 14]))
        monkeypatch.setattr(mixing, "ITEMS", rng.choice([2, 64]))
        monkeypatch.setattr(mixing, "SPAN", rng.choice([0, 1 << 20]))
        got = mixing.fit(counts, budget)
        assert all(0 < n <= counts[s] for s, n in got.items())
        assert sum(s * n for s, n in got.items()) == max(sums)


def test_fit_by_residues_is_the_best_subset_sum():
    rng, fitted = random.Random(6), 0
    for _ in range(1500):
        sizes = rng.sample(range(1, 30), rng.randint(1, 5))
        counts = {s * rng.choice([1, 1, 2, 6]): rng.choice([rng.randint(1, 5), rng.randint(20, 150)]) for s in sizes}
        budget = rng.randint(1, sum(s * c for s, c in counts.items()))
        sums = 1
        for s, c in counts.items():
            for _ in range(c):
                sums |= sums << s
        got = mixing.by_residues(counts, budget)
        if got is not None:
            fitted += 1
            assert all(0 < n <= counts[s] for s, n in got.items())
            assert sum(s * n for s, n in got.items()) == (sums & ((1 << (budget + 1)) - 1)).bit_length() - 1
    assert fitted > 500


@pytest.mark.parametrize("n", [10**5, 10**9])
def test_fit_of_pieces_of_one_length_takes_no_memory(n):
    import tracemalloc

    tracemalloc.start()
    for budget in (400 * n, 100 * n + 3, 512 * n + 776, 512 * n + 777, 12_345):
        got = mixing.fit({512: n, 777: 1}, budget)
        want = max(v for v in (512 * min(n, budget // 512), 777 + 512 * min(n, (budget - 777) // 512)) if v <= budget)
        assert sum(s * c for s, c in got.items()) == want
    got = mixing.fit({512 * j: n for j in range(1, 60)} | {777: 1}, 500_000 * n + 5)
    assert sum(s * c for s, c in got.items()) == max(v for v in range(500_000 * n - 1000, 500_000 * n + 6) if v % 512 in (0, 777 % 512))
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()


def test_taken_is_the_best_that_documents_allow(spark):
    rows = [(i, "w " * n, "a") for i, n in enumerate([50, 70, 90, 110, 70])] + [(10 + i, "w " * n, "b") for i, n in enumerate([500, 900, 1300, 3])]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for name in ("a", "b"):
        own = [r for r in out if r["source"] == name]
        total, target = own[0]["source_size"], own[0]["target"]
        sums = {0}
        for r in own:
            sums |= {v + r["size"] for v in sums}
        rest = round(target - target // total * total)
        assert sum(r["taken"] for r in own) == target // total * total + max(v for v in sums if v <= rest)


def test_fit_reaches_exact_sums():
    rng = random.Random(9)
    for _ in range(60):
        counts = {rng.randint(1, 200): rng.randint(1, 30) for _ in range(rng.randint(1, 60))}
        total = sum(s * c for s, c in counts.items())
        budget = rng.randint(0, total)
        got = mixing.fit(counts, budget)
        assert all(0 < n <= counts[s] for s, n in got.items())
        reached = sum(s * n for s, n in got.items())
        assert reached <= budget and budget - reached <= max(counts)
        if len(counts) > 30:
            assert budget - reached <= 2


def test_mix_is_drawn(spark):
    docs = clashing(documents(spark))
    out = mixing.drawn(docs)
    assert out.columns == docs.columns
    unclashed(out)
    assert sum(len(words_of(r["text"])) for r in out.collect()) == mixing.mix(docs).agg(F.sum("taken")).first()[0]
    assert mixing.drawn(docs.limit(0)).count() == 0


# --- the pipeline


def test_pipeline(spark):
    import corpus_pipeline as pipeline
    from vigil.llm.common import written

    docs = table(spark, "documents")
    columns, seen = docs.columns, [docs]
    for _, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        seen.append(docs)
    assert all(d.columns == columns for d in seen[:-1])
    whole, clean, single, cut, mixed, ids = seen
    assert clean.join(whole, columns, "left_anti").count() == 0
    labels = table(spark, "labels")
    assert clean.join(labels.where("toxic = 0"), "doc_id", "left_semi").count() > 0.98 * whole.join(labels.where("toxic = 0"), "doc_id", "left_semi").count()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    roots, _ = true_groups(texts.values())
    of = {d: roots[shingle_set(t)] for d, t in texts.items()}
    left = {r["doc_id"] for r in single.collect()}
    assert single.join(clean, columns, "left_anti").count() == 0
    assert {min(d for d in of if of[d] == r) for r in set(of.values())} <= left  # none goes without one of its group
    assert len(left) - len(set(of.values())) <= 0.1 * (len(of) - len(set(of.values())))
    got = {r["doc_id"]: (r["text"] or "").split() for r in cut.collect()}
    lost = dict((d, n) for d, _, n, _ in brute_words([(r["doc_id"], r["text"]) for r in single.collect()], 35))
    for r in single.collect():
        assert len(got[r["doc_id"]]) == len(words_of(r["text"])) - lost[r["doc_id"]]
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in cut.collect()}
    assert ids.count() == mixed.count() and ids.where("n_tokens * 4 <> length(ids)").count() == 0
    assert pipeline.run(spark, SF).count() == ids.count()


def test_pipeline_hard_cases(spark, tmp_path):
    import corpus_pipeline as pipeline
    from vigil.llm.common import written

    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    own = ["_h", "f", "shingles", "_group", "taken", "kept", "toxicity", "score"]
    for docs in (documents(spark), documents(spark).limit(0), documents(spark).where("text IS NULL")):
        docs = docs.withColumns({c: F.lit(f"own {c}") for c in own})
        columns, docs = docs.columns, written(docs)
        for n, (_, stage) in enumerate(pipeline.STAGES):
            before, docs = docs, written(stage(spark, docs, str(tmp_path)))
            assert docs.columns == (columns if n < 4 else [*columns, "ids", "n_tokens"])
            assert docs.where(" OR ".join(f"{c} <> 'own {c}' OR {c} IS NULL" for c in own)).count() == 0
            if n in (2, 4):
                assert docs.count() == before.count()


def test_queries_are_registered():
    from vigil.llm.queries import QUERIES

    assert [int(q[2:].split("_")[0]) for q in QUERIES] == list(range(1, 14))
