"""Divergence of sources against plain counting with Python's integers."""

import collections
import random
import re

import pytest
from mapfold.llm import divergence
from mapfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def expected(rows, least=3, ranks=200):
    """rows: (lang, source, text)."""
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        words = [w.translate(LOWER) for w in TERM.findall(text)]
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = collections.Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(found[: ranks if part == "term" else None], 1)]
    return sorted(out)


def corpus(sources=12, docs=150, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for _ in range(300)] + ["Été", "É", "漢字", "ſ", "K", "x y", "A"]
    rows = []
    for _ in range(docs):
        s = min(int(r.expovariate(0.25)), sources - 1)
        own = words[s * 9 : s * 9 + 60] + words[:20]
        rows.append((r.choice(["en", "en", "fr"]), f"s{s}", " ".join(r.choice(own).title() if r.random() < 0.2 else r.choice(own) for _ in range(r.randint(0, 60))) + r.choice(["", "1two,three\nfour\x00five"])))
    rows += [("en", "quiet", None), ("en", "quiet", ""), (None, None, "a b c"), ("xx", "one", "lonely words"), ("xx", "two", None), ("en", None, "abc " * 50), ("fr", "s1", "the"), *[("de", "same", "gleich gleich")] * 3, ("de", "other", "gleich")]
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame([(*x, 1, "y", 2) for x in rows], "lang string, source string, text string, n int, item string, block int").repartition(5)
    return sorted(map(tuple, divergence.audit(df, **options).collect()))


@pytest.mark.parametrize("heavy", [0.0, 1 / 3, 1.0])
def test_heavy_and_light(spark, heavy):
    rows = corpus()
    assert run(spark, rows, heavy=heavy) == expected(rows)


def test_blocks_tiles_and_ranks(spark, monkeypatch):
    """Many blocks of sources and tiles of terms, and counts handed on often."""
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "TILE", 20)
    rows = corpus(sources=20, docs=200, seed=5)
    assert run(spark, rows, term_ranks=4) == expected(rows, ranks=4)
    assert run(spark, rows, heavy=0.1, least_docs=1, term_ranks=4) == expected(rows, least=1, ranks=4)


def test_counts_that_are_handed_on(spark):
    rows = corpus(docs=60)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(2)
    got = [sorted(map(str, divergence.term_counts(df, most).collect())) for most in (1, 40, 10**6)]
    assert got[0] == got[1] == got[2]


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_long_texts_are_counted_in_steps(monkeypatch):
    text = ("Äb c1d " * 1000).encode()
    whole = [w for part in divergence.words_of(text) for w in part]
    monkeypatch.setattr(divergence, "STEP", 7)
    assert [w for part in divergence.words_of(text) for w in part] == whole == "Äb c d ".encode().split() * 1000


def test_large_counts(spark):
    """Shares are exact beyond 64 bits."""
    df = spark.createDataFrame([(9_000_000_000_000, 9_000_000_000_007), (0, 1), (5, 0)], "n long, total long").select(divergence.share("n", "total"))
    assert [r[0] for r in df.collect()] == [1 + 1_000_000_000 * 9_000_000_000_001 // 9_000_000_000_007, 1_000_000_001, 1]


def test_op13(spark):
    df = QUERIES["op13_divergence"](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == "lang string, source string, part string, item string, value bigint, rank int"
    rows = [(r["lang"], r["source"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, df.collect())) == expected(rows)
