"""Source divergence, fill-in-the-middle and URL filters against plain Python versions and small hard cases."""

import collections
import hashlib
import random
import re

import pyarrow as pa
import pytest
from cases import clashing, documents, unclashed
from pyspark.sql import functions as F

from vigil.llm import divergence, infill, urls

SF = "/root/testdata/sf0.01"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rows(df):
    return collections.Counter(map(tuple, df.collect()))


# --- 11: source divergence


def plain_audit(docs, least=10, top=10):
    """docs: (text, lang, source). Rows as the contract has them, by plain dictionaries."""
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = {n: n + 32 for n in range(65, 91)}
    seen, count = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in docs:
        found = term.findall((text or "").translate(lower))
        seen[lang or ""].update(set(found))
        count[lang or "", source or ""].update(found)
    out = collections.Counter()
    for lang, docs_with in seen.items():
        kept = [t for t, n in docs_with.items() if n >= least]
        of = {s: c for (g, s), c in count.items() if g == lang}
        whole = sum(of.values(), collections.Counter())

        def shares(c):
            size = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (size + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: shares(c) for s, c in of.items()}
        q = shares(whole)
        for s in of:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in of if o != s), key=lambda x: (x[0], x[1].encode()))
            out.update((lang, s, "pair", o, -v, n + 1) for n, (v, o) in enumerate(pairs))
            terms = sorted(((-f(p[s][t], q[t]), t) for t in kept if of[s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))
            out.update((lang, s, "term", t, -v, n + 1) for n, (v, t) in enumerate(terms[:top]))
    return out


def audited(docs, **more):
    return rows(divergence.audit(docs, **more).select("lang", "source", "part", "item", "value", "rank"))


@pytest.mark.parametrize(("words", "cells", "tile"), [(200_000, 1 << 21, 1024), (50, 64, 3)])
def test_divergence(spark, monkeypatch, words, cells, tile):
    for name, value in (("WORDS", words), ("CELLS", cells), ("TILE", tile), ("STRETCH", 500), ("HELD", 100)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdéß日", k=rng.randint(1, 4))) for _ in range(300)]
    weights = [1 / (n + 1) for n in range(len(vocabulary))]
    docs = []
    for n in range(400):
        text = rng.choice([" ", "_1", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(vocabulary, weights, k=rng.choice([0, 3, 40, 90])))
        docs.append((text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "d", "é", "z", None, ""])))
    docs += [("x y z", "few", "a"), (None, "few", "b"), ("", "none", "a"), (None, None, "only nulls"), ("123 !?", "en", "no terms")]
    assert audited(spark.createDataFrame(docs, "text string, lang string, source string"), least=5) == plain_audit(docs, least=5)


def test_divergence_hard_cases(spark):
    docs = documents(spark)
    want = plain_audit([tuple(r) for r in docs.select("text", "lang", "source").collect()])
    assert audited(docs) == want and want
    assert audited(clashing(docs)) == want
    assert divergence.audit(docs.limit(0)).count() == 0
    one = spark.createDataFrame([("a b", "en", "s")] * 12, "text string, lang string, source string")
    assert divergence.audit(one).count() == 0  # no other source, and no term that it has more often than its language
    two = one.unionByName(spark.createDataFrame([("!", "en", "t")], one.schema))
    assert {r[:4] for r in audited(two)} == {("en", "s", "pair", "t"), ("en", "t", "pair", "s")}
    tied = spark.createDataFrame([("b a", "en", "s")] * 10 + [("c", "en", "t")] * 10, "text string, lang string, source string")
    assert [r["item"] for r in divergence.audit(tied).where("source = 's' AND part = 'term'").orderBy("rank").collect()] == ["a", "b"]


def test_divergence_is_exact_beyond_doubles(spark):
    """Counts of a trillion: p in decimals, as whole numbers in Python."""
    cases = [(10**13 + 7, 3 * 10**13, 10**6), (0, 0, 1), (5, 7, 0), (2**40, 2**40, 3)]
    df = spark.createDataFrame(cases, "n long, size long, terms long").select(divergence.share(F.col("n"), F.col("size"), F.col("terms")).alias("p"))
    assert [r["p"] for r in df.collect()] == [1 + 10**9 * (n + 2) // (s + 2 * v) if v else None for n, s, v in cases]


def test_long_texts_are_split_between_terms():
    rng = random.Random(2)
    text = b" ".join(bytes(rng.choices(b"ab\xc3\xa9", k=rng.randint(1, 30))) for _ in range(500)) + b"x" * 5000
    parts = list(divergence.stretches(text, 64))
    assert b"".join(parts) == text and sum((p.split() for p in parts), []) == text.split() and len(parts) > 50


def test_divergence_sums_of_joint_cells_by_hand():
    levels = pa.table({"lang": ["l"] * 3, "no": [0, 0, 1], "block": [0, 0, 0], "bits": pa.array([0b0111, 0b1000, 0b0101], pa.int64()), "p": [40, 90, 60]})
    groups = pa.table({"no": [0, 1], "p0": [20, 30], "mine": [True, True]})
    f = lambda p, q: (p - q) ** 2 // (p + q)
    whole = 2 * f(40, 60) + f(40, 30) + f(90, 30)  # terms 0 and 2 have both, 1 and 3 only the first
    assert divergence.met(levels, groups).column("value").to_pylist() == [whole - 4 * f(20, 30)]


# --- 12: fill-in-the-middle


def plain_infill(doc_id, text):
    text = text or ""
    tokens = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[n : n + 8], 16) for n in range(0, 32, 8)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def infill_cases(spark):
    rng = random.Random(3)
    pieces = ["<", ">", "P>", "<S", "<M", "M>", " ", "\n", "\t\t", "\x0b", "é", "日本", "😀", "word", "\u00a0", "\u2003", "<<P", "P", "S"]
    made = [(5000 + n, "".join(rng.choices(pieces, k=rng.randint(0, 40)))) for n in range(600)]
    made += [(7000 + n, t) for n, t in enumerate(["<P>", "a <S> b", "x<M>", " ", "\n\n", " a ", "a", "a ", "<P", "P>"] * 6)]
    return documents(spark).unionByName(spark.createDataFrame([(*r, None, None, None) for r in made], documents(spark).schema))


def test_infill(spark):
    docs = infill_cases(spark)
    got, want, forms = rows(infill.digests(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")), collections.Counter(), collections.Counter()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in docs.select("doc_id", "text").collect():
        n, form, prefix, middle, out = plain_infill(*r)
        want[r[0], n, form, prefix, middle, sha(out), sha(r[1] or "")] += 1
        forms[form] += 1
    assert got == want and min(forms.values()) > 20 and len(forms) == 3


def test_infill_round_trip_of_texts(spark):
    docs = infill_cases(spark)
    out = infill.restore(infill.transform(docs, rate=100, spm=50))
    assert out.where("NOT (restored <=> text)").count() == 0
    assert out.where("form <> 'plain' AND fim = text").count() == 0
    assert {r["form"] for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert infill.transform(docs, rate=0).where("form <> 'plain'").count() == 0


def test_infill_hard_cases(spark):
    docs = documents(spark)
    assert infill.digests(docs.limit(0)).count() == 0
    assert rows(infill.digests(clashing(docs))) == rows(infill.digests(docs))
    new = ["fim", "form", "n", "prefix_chars", "middle_chars", "output_sha256"]
    mixed = clashing(docs)
    out = infill.transform(mixed)
    unclashed(out, new)
    assert out.count() == docs.count() and [c for c in out.columns if c not in new] == mixed.columns
    assert out.where("text IS NULL AND NOT (fim IS NULL AND form = 'plain' AND n = 0)").count() == 0
    own = docs.withColumns({c: F.lit("own") for c in new})
    assert rows(infill.transform(own).select("doc_id", *new)) == rows(infill.transform(docs).select("doc_id", *new))


def test_piece_table():
    text = "one two  three".encode()
    whole = [infill.Piece(text, 0, len(text))]
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            table = infill.cut(infill.cut(whole, b), a)
            assert [infill.laid([x]) for x in table] == [text[:a], text[a:b], text[b:]]
            for form in ("psm", "spm"):
                out = infill.arranged(table, form)
                assert all(x.buffer is text or x.buffer is infill.MARKS for x in out)  # descriptors only, nothing copied
                assert infill.laid(infill.inverse(out, form)) == text
                assert infill.laid(infill.inverse(infill.parsed(infill.laid(out), form), form)) == text
                assert infill.sha256(out) == hashlib.sha256(infill.laid(out)).hexdigest()
    assert infill.token_ends(b"").tolist() == [] and infill.token_ends(b" a\n\nb ").tolist() == [2, 5, 6]


# --- 13: URL filters


def judged(spark, pages, redirects=None):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    sent = redirects and spark.createDataFrame(redirects, "from_url string, to_url string")
    out = urls.judged(df, urls.rules_table(spark, urls.RULES), redirects=sent or None)
    return {r["page_id"]: r for r in out.collect()}


def plain_rule(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host, tail = re.match(r"([^/?#]*)(.*)", rest, re.S).groups()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = re.match(r"[^?#]*", tail).group()
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


HARD_URLS = [
    "http://a.net/", "http://a.net", "HTTP://A.NET/x?y=/en/", "https://example.net/en/1", "https://m.Example.Net/en/", "https://example.net/en", "https://badexample.net/en/1", "net://net/", "x://.net/", "http://net/",
    "http://example.com/de/", "http://www.example.com/de", "http://example.com/DE/1", "http://xexample.com/de/1", "http://o.org/fr/2#x", "http://org/fr/", "http://a.org/en/", "http://a.net:80/x", "http://u@a.net/x", "http://a.net?x",
    "http://a.net#/x", "no scheme", "", None, "http://", "://a.net/x", "a://b://c.net/", "http://a.com/://b.net/", "http://É.NET/ÉA", "http://a.net/\nx", "mailto:x@a.net", "http://a..net/x", "http://a.net./x",
]


def test_rules(spark):
    got = judged(spark, [(n, u, None) for n, u in enumerate(HARD_URLS)])
    for n, u in enumerate(HARD_URLS):
        assert (got[n]["host"], got[n]["path"], got[n]["rule"], got[n]["verdict"]) == plain_rule(u), u


def test_many_rules_meet_by_equal_hosts_and_paths(spark):
    rng = random.Random(5)
    label, step = ["a", "b", "c"], ["x", "y", "/", "xy/"]
    rules = list({("".join(rng.choices(label, k=1)) + "".join("." + x for x in rng.choices(label, k=rng.randint(0, 2))), "/" + "".join(rng.choices(step, k=rng.randint(0, 3)))): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(*k, v) for k, v in rules]
    pages = [(".".join(rng.choices(label, k=rng.randint(1, 4))), "/" + "".join(rng.choices(step, k=rng.randint(0, 5)))) for _ in range(300)]
    df = spark.createDataFrame(sorted(set(pages)), "host string, path string")
    got = {(r["host"], r["path"]): (r["rule"], r["decision"]) for r in urls.decided(df, urls.rules_table(spark, rules)).collect()}
    for host, path in set(pages):
        fits = [(len(h + p), len(h), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got.get((host, path)) == (max(fits)[3:] if fits else None)


def canonical(href):
    return f'<html><head><LINK title="a" REL="alternate Canonical" href="{href}"></head></html>'


def test_blocks_propagate_to_aliases(spark):
    pages = [
        (1, "http://bad.net/x", None),
        (2, "http://a.com/1", canonical("https://BAD.net/x#part")),  # alias of a blocked page
        (3, "http://b.com/1", canonical("http://a.com/1")),  # through another
        (4, "https://b.com/1#top", None),  # the same address
        (5, "http://b.com/1?q=1", None),  # another address
        (6, "http://o.org/fr/1", canonical("http://a.com/1")),  # own allow
        (7, "http://c.com/1", canonical("http://www.example.com/de/7")),  # a blocked address that is no page
        (8, "http://d.com/a/b", '<meta content="0; URL=\'../x\'" http-equiv=refresh><meta http-equiv="Refresh" content="5;url=/y">'),
        (9, "http://d.com/y", None),
        (10, "http://d.com/a/../x?k", canonical("//bad.net/x")),
        (11, "http://d.com/a/../x", None),
        (12, "http://e.com/1", canonical("http://o.org/fr/1")),  # an alias of an allowed one that is an alias of a blocked one
        (13, "http://f.com/1", canonical("http://m.org/fr/1")),  # of an allowed one only
        (14, "http://g.com/1", canonical("mailto:a@bad.net") + canonical("#x") + canonical("") + "<link rel=stylesheet href=http://bad.net/x>"),
        (15, None, canonical("http://bad.net/x")),
        (16, "http://h.com/?a=1&b=2", None),
        (17, "http://h.com/p", canonical("/?a=1&amp;b=2") + "<link rel=canonical href=http://bad.net/x />"),
        (18, "http://i.com/1", None),
        (19, "http://j.com", canonical("?q")),
        (20, "http://j.com/z", canonical("http://j.com?q")),
    ]
    got = judged(spark, pages, [("http://i.com/1", "http://bad.net/x"), ("http://j.com/z", "http://bad.net/x"), (None, "http://x.com/"), ("http://x.com/", None)])
    blocked = {n for n, r in got.items() if r["verdict"] == "block"}
    assert blocked == {1, 2, 3, 4, 7, 10, 12, 16, 17, 18, 19, 20}
    assert {n for n, r in got.items() if r["by_alias"]} == blocked - {1} and got[6]["rule"] == "org/fr/"
    assert got[2]["rule"] is None and len(got) == len(pages)


def test_long_chains_and_hubs_of_aliases(spark):
    chain = [(n, f"http://c{n}.com/", canonical(f"http://c{n + 1}.com/")) for n in range(200)] + [(200, "http://c200.com/", canonical("http://x.net/"))]
    hub = [(1000 + n, f"http://h{n}.com/", canonical("http://hub.com/")) for n in range(500)] + [(2000, "http://hub.com/", canonical("http://fine.com/"))]
    got = judged(spark, chain + hub)
    assert {n for n, r in got.items() if r["verdict"] == "block"} == set(range(201))


def test_url_filter_hard_cases(spark):
    pages = table(spark, "pages")
    assert urls.verdicts(pages.limit(0)).count() == 0
    names = ["host", "path", "rule", "verdict", "node", "_rest", "_key", "_links", "root", "decision", "ID", "key", "k", "a", "b"]
    twice = pages.unionByName(pages.limit(5)).unionByName(spark.createDataFrame([(None, None, None), (None, "http://a.net/", ""), (3, None, "<link")], pages.schema))
    out = urls.verdicts(twice.withColumns({c: F.lit("own") for c in names}))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"] and out.count() == twice.count()
    assert rows(out) == rows(urls.verdicts(twice))
    want = collections.Counter((r["page_id"], *plain_rule(r["url"])) for r in twice.collect())
    assert rows(out) == want


def test_url_filter_stays_in_spark(spark):
    plan = urls.verdicts(table(spark, "pages"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD.*rule", plan) and "NestedLoop" not in plan and "Cartesian" not in plan
