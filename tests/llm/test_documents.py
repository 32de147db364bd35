"""Operators on documents against brute force, on a small table with every awkward row."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mapfold.llm import fingerprint, line_dedup, mixing, near_copies, packing, sharding, simhash, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, h string, shard int, block string, key long, score string"


def corpus():
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, texts = words(60), []
    for i in range(40):
        w = words(r.randint(1, 300))
        if i % 3 == 0:
            at = r.randint(0, len(w))
            w = w[:at] + passage + w[at:]
        texts.append("\n".join(" ".join(w[j : j + 12]) for j in range(0, len(w), 12)) + ("\nshared line of the sites" if i % 2 else ""))
    near = texts[5].split(" ")
    near[len(near) // 2] = "changed"
    texts += [texts[3], texts[3], " ".join(near), None, "", " \t\n ", "one", "one two", "the " * 200, " ".join(words(6000)), "Ünïcode 漢字 😀 <|endoftext|> x y z's", passage and " ".join(passage), " ".join(passage * 2)]
    rows = [(i, t, "en", f"s{i % 7}" if i % 11 else None, len(t or ""), 1, "x", 3, "b", 9, "y") for i, t in enumerate(texts)]
    rows.append(rows[2])  # a repeated row
    rows.append((None, texts[8], None, None, None, None, None, None, None, None, None))
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return (text or "").encode().split()


def stripped(rows, window):
    count = collections.Counter(tuple(t[i : i + window]) for _, x, *_ in rows for t in [tokens(x)] for i in range(len(t) - window + 1))
    out = []
    for doc, text, *_ in rows:
        t = tokens(text)
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if count[tuple(t[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(t, gone, strict=True) if not g)
        out.append((doc, len(t), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,k", [(35, 8), (12, 4)])
def test_repeated_passages_go(docs, window, k):
    found = substring_dedup.remove_repeats(docs, window, k).collect()
    assert sorted(map(tuple, found), key=str) == stripped(ROWS, window)


def test_repeated_passages_text(docs, none):
    for r in substring_dedup.remove_repeats(docs, keep_text=True).collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]
    assert substring_dedup.remove_repeats(none).count() == 0


def test_branching_passages(spark):
    """Passages that part and meet again, a ring of words, a passage inside another, and one that repeats in one text."""
    r = random.Random(6)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    a, b, c, ring = words(90), words(120), words(70), words(9)
    texts = [a + words(5) + b, a + words(5) + b, a + words(8) + c + b[:60], a[20:80] + c, words(40) + b[30:100] + a[:50], ring * 12, ring * 9, words(60), c + words(3) + c + a, a[:44] + b[44:] + c[:40]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 35, 8).collect()
    assert sorted(map(tuple, found), key=str) == stripped(rows, 35)


def test_paths_compact(spark):
    """A chain of 40 that another leaves at 20 and one enters at 30, a ring, and an edge that follows itself."""
    links = [(i, i + 1) for i in range(40)] + [(20, 100), (100, 101), (200, 30)] + [(300 + i, 300 + (i + 1) % 5) for i in range(5)] + [(400, 400)]
    df = spark.createDataFrame([(a, -a, b, -b) for a, b in links], "s1 long, s2 long, n1 long, n2 long")
    got = {x["s1"]: (x["p1"], x["place"]) for x in substring_dedup.compact_paths(df).collect()}
    want = {i: (0, i) for i in range(1, 21)} | {i: (21, i - 21) for i in range(22, 30)} | {i: (30, i - 30) for i in range(31, 41)} | {101: (100, 1)}
    assert got == want


def test_compaction_joins_spans(spark, monkeypatch):
    """Two copies of 1,500 words on a path that doesn't branch: their spans are looked up by the path, not edge by edge, and both ways find the same."""
    r = random.Random(8)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    a = words(1500)
    rows = [(i, " ".join(words(50) + a + words(50))) for i in range(2)]
    docs, looked, write = spark.createDataFrame(rows, "doc_id long, text string"), [], substring_dedup.materialize

    def kept(df, name):
        out = write(df, name)
        if name in ("placed", "words"):
            looked.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "materialize", kept)
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs).collect())) == stripped(rows, 35)
    edges, spans = looked
    assert edges > 80 and 2 * edges / substring_dedup.CUT <= spans <= 2 * edges / substring_dedup.CUT + 8
    none = spark.createDataFrame([], "s1 long, s2 long, p1 long, p2 long, place long")
    monkeypatch.setattr(substring_dedup, "compact_paths", lambda links: none)
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs).collect())) == stripped(rows, 35)
    assert looked[2:] == [edges, 2 * edges]


def test_windows_are_told_by_their_words():
    text = b"one two three one two three"
    found = substring_dedup.digests_of(text, np.array([0, 14, 4]), np.array([7, 21, 13]))
    assert found.tolist() == [list(substring_dedup.digest_of(w)) for w in (b"one two", b"one two", b"two three")]


def test_texts_are_read_together(monkeypatch):
    """Anchors of texts read side by side are those of each by itself, and no word's hash is asked for in Python."""
    r = random.Random(5)
    gap = lambda: r.choice([" ", " ", " ", "\n", " \t", "\x0b\x0c\r "])
    word = lambda: r.choice(["a", "b", "é\xa0ü", "c" * 8, "d" * 9, "long-word-of-more-than-sixteen-bytes", str(r.randrange(40))])
    texts = ["", None, "  ", "x", " a b ", *["".join(word() + gap() for _ in range(r.choice([3, 34, 35, 36, 90, 400]))) for _ in range(60)], "end", None]
    joined, starts, ends, first = substring_dedup.read_words(pa.array(["cut off", *texts]).slice(1))
    words = [joined[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    assert [words[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)] == [(t or "").encode().split() for t in texts]
    hashes = substring_dedup.hash_words(joined, starts, ends)
    assert len(set(hashes.tolist())) == len(set(words)) == len(set(zip(words, hashes.tolist(), strict=True)))
    assert hashes.tolist() == substring_dedup.Hasher().words(words).tolist()
    monkeypatch.setattr(substring_dedup.Hasher, "words", lambda *_: 1 / 0)
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(texts)], ["doc_id", "d", "t", "text"])
    together = pa.Table.from_batches(substring_dedup._scan(35, 8)(iter([batch]))).to_pylist()
    alone = pa.Table.from_batches(substring_dedup._scan(35, 8)(batch.slice(i, 1) for i in range(len(texts)))).to_pylist()
    assert together == alone and sum(len(x["pos"]) for x in alone) > 200
    assert [(x["n_words"], x["digest"]) for x in alone] == [(len(w), hashlib.sha256(b" ".join(w)).hexdigest()) for w in ((t or "").encode().split() for t in texts)]


def test_word_sequence_hashes_depend_on_content_only():
    h = substring_dedup.Hasher()
    t = [b"a", b"b", b"c", b"a", b"b", b"c", b"d"]
    sums = h.sums(h.words(t), 0)
    at = np.arange(5)
    s = h.spans(sums, at, at + 3)
    assert s[0] == s[3] and len(set(s.tolist())) == 4


def simple_hash(text, k=3):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = b.split()
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] * bool(w)
    hs = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("budget", [2, 3, 6])
def test_simhash_components(docs, budget):
    rows = [r for r in ROWS if r[0] is not None]
    fps = {d: simple_hash(t) for d, t, *_ in rows}
    low = {d: d for d in fps}
    for _ in fps:
        low = {a: min(low[b] for b in fps if bin(fps[a] ^ fps[b]).count("1") <= budget) for a in fps}
    found = simhash.simhash_components(docs.where("doc_id is not null"), budget).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["fp"] % (1 << 64), r["component_id"]) == (fps[r["doc_id"]], low[r["doc_id"]])


def test_near_copies_keep_one(docs, none):
    kept = near_copies.drop_near_copies(docs).collect()
    ids = [r["doc_id"] for r in kept]
    assert kept[0].asDict().keys() == set(docs.columns) and len(ids) == len(set(ids)) and 3 in ids and 40 not in ids and 41 not in ids
    assert len([r for r in kept if not tokens(r["text"])]) == 1
    assert simhash.simhash_components(none).count() == near_copies.drop_near_copies(none).count() == 0


@pytest.mark.parametrize("block", [16, 1024])
def test_near_copies_of_four_fifths_link(spark, block):
    """Against brute force over all pairs of fingerprints, and over all pairs of shingle sets."""
    r = random.Random(8)
    word = lambda: str(r.randint(0, 5000))
    texts = []
    for size, copies in [(120, 60), (400, 12)] + [(r.randint(6, 500), 3) for _ in range(25)]:
        base = [word() for _ in range(size)]
        for c in range(copies):
            w = list(base)
            for _ in range(c % 3 * max(1, size // 150)):
                w[r.randrange(size)] = word()
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    low = {x["d"]: x["low_d"] for x in near_copies.near_copies(df, block=block).collect()}
    prints = np.array([near_copies.wide_fingerprint(t)[0] for t in texts], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= near_copies.BITS
    root = np.arange(len(texts))
    for _ in texts:
        root = np.where(near, root[None], len(texts)).min(axis=1)
    assert sum(low[i] != root[i] for i in low) <= 2  # a pair may share no key
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    assert len(alike) > 500 and np.mean([low[a] == low[b] for a, b in alike]) > 0.97
    unlike = [(a, b) for a in range(len(texts)) for b in range(a) if not shingles[a] & shingles[b]]
    assert not any(low[a] == low[b] for a, b in unlike)


@pytest.mark.parametrize("block", [16, 1024])
def test_exact_copies_are_those_of_four_fifths(spark, block):
    """Against the components of all pairs of shingle sets; many pairs lie a little under 0.8."""
    r = random.Random(9)
    word = lambda: str(r.randint(0, 5000))
    texts = [None, "", " ", "a b", "A  b", "a b c d e f g h i", "a b c d e f g h"]  # the last two: 4 of 5 shingles
    for size, copies, step in [(200, 60, 2), (400, 30, 5), (300, 40, 6)] + [(r.randint(8, 400), 3, r.randint(1, 5)) for _ in range(40)]:
        base = [word() for _ in range(size)]
        for c in range(copies):
            w = list(base)
            for _ in range(c % 4 * step):
                w[r.randrange(size)] = word()
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    low = {x["d"]: x["low_d"] for x in near_copies.exact_copies(df, 0.8, block=block).collect()}
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()} for w in ((t or "").lower().split() for t in texts)]
    like = np.array([[len(a & b) / len(a | b) for a in shingles] for b in shingles])
    assert ((like >= 0.65) & (like < 0.8)).sum() > 500
    root = np.arange(len(texts))
    for _ in texts:
        root = np.where(like >= 0.8, root[None], len(texts)).min(axis=1)
    assert [low[i] for i in range(len(texts))] == root.tolist()


def test_exact_copies_keep_one(docs, none):
    ids = [r["doc_id"] for r in near_copies.drop_near_copies(docs, similarity=0.8).collect()]
    assert len(ids) == len(set(ids)) and 3 in ids and 40 not in ids and 41 not in ids
    assert near_copies.drop_near_copies(none, similarity=0.8).count() == 0


def test_components_are_followed():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, (30, 4), dtype=np.uint64)
    rows = np.concatenate([base ^ (np.uint64(1) << r.integers(0, 64, base.shape, dtype=np.uint64)) for _ in range(6)])
    a, b = near_copies.chains(rows, 8)
    assert len(a) == len(rows) - 30 and (a % 30 == b % 30).all()


def test_near_copies_meet_in_tries():
    """A trie finds what all pairs of fingerprints give, rows of one fingerprint too, and components come out whole."""
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, (20, 4), dtype=np.uint64)
    prints = np.concatenate([base ^ (r.integers(0, 1 << 63, base.shape, dtype=np.uint64) & r.integers(0, 1 << 63, base.shape, dtype=np.uint64) & r.integers(0, 1 << 63, base.shape, dtype=np.uint64)) for _ in range(5)] + [base[:8]] * 3)
    far = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    for bits in (0, 40, 60, 256):
        rows = near_copies.sorted_rows(prints, np.zeros(len(prints)))
        a, b = near_copies.trie_search(prints, rows, rows, np.arange(len(rows)) + 1, np.full(len(rows), len(rows)), bits)
        want = np.argwhere(np.triu(far <= bits, 1))
        assert sorted(map(sorted, zip(a.tolist(), b.tolist(), strict=True))) == want.tolist() and len(want) >= 24
        for size in (6, 124):  # groups that are compared together, and one that is followed
            starts = np.append(np.arange(0, len(prints), size), len(prints))
            group = np.searchsorted(starts, np.arange(len(prints)), side="right")
            a, b = near_copies.joined(prints, starts, bits)
            assert (group[a] == group[b]).all() and (far[a, b] <= bits).all()
            found, root = np.eye(len(prints), dtype=bool), np.arange(len(prints))
            found[a, b] = found[b, a] = True
            near, low = (far <= bits) & (group[:, None] == group[None]), root
            for _ in prints:
                root, low = np.where(found, root[None], len(prints)).min(axis=1), np.where(near, low[None], len(prints)).min(axis=1)
            assert root.tolist() == low.tolist()


def test_near_copies_meet_under_bits_of_their_own(spark):
    """Texts whose first words differ in two bits meet, even if they have no smallest shingle hash in common."""
    rows = [(1, 0, 5, 6, 7, 1, 2, 3, 4), (2, (1 << 40) + 8, 5, 6, 3, 5, 6, 7, 8), (3, (1 << 40) + (1 << 20) + 24, 5, 6, 7, 9, 10, 11, 12)]
    df = spark.createDataFrame(rows, "node long, f0 long, f1 long, f2 long, f3 long, k0 long, k1 long, k2 long, k3 long")
    assert {(x["src"], x["dst"]) for x in near_copies.wide_links(df).collect()} == {(1, 2), (2, 3)}


def test_trie_pairs_are_all_pairs():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.concatenate([base ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)])
    v = np.unique(np.concatenate((base, near)))
    for budget in (0, 1, 2, 4):
        a, b = simhash.trie_pairs(v, budget)
        want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= budget}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)


def test_packing_is_a_round_trip(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_path())
    found = packing.pack_documents(docs).collect()
    want = collections.Counter()
    for d, text, *_ in ROWS:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for p, s in enumerate(range(0, len(ids), 2048)):
            want[d, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    by = collections.defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in by.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none).count() == 0


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    b = packing.BestFit(10, 2)
    assert [b.place(n) for n in (6, 5, 5, 4, 7, 8)] == [(0, 0), (1, 0), (1, 5), (0, 6), (2, 0), (3, 0)]
    assert b.place(3) == (2, 7) and b.place(2) == (3, 8)
    b = packing.BestFit(10, 2)
    assert [b.place(n)[0] for n in (6, 7, 9, 4, 3)] == [0, 1, 2, 0, 3]  # 7 was the fullest when 9 came


def test_shards_hold_the_law(docs, none):
    out = sharding.shard_documents(docs, [1.0] * 5, 1.0).collect()
    assert len(out) == len(ROWS)
    for s in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    six = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, [1.0] * 6).collect()}
    for r in out:
        assert r["grown_shard"] in (5, r["shard"]) and six[r["doc_id"]] == r["grown_shard"]
    sizes = {d: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS}
    assert all((r["size"], r["text_crc32"]) == sizes[r["doc_id"]] for r in out)
    assert sharding.shard_documents(none, [1.0]).count() == 0


def test_shard_weights(spark):
    keys = spark.range(20000).select(sharding.rendezvous_shard(F.col("id"), [1.0, 2.0, 5.0]).alias("s"))
    n = {r["s"]: r["count"] for r in keys.groupBy("s").count().collect()}
    assert abs(n[0] / 20000 - 0.125) < 0.02 and abs(n[2] / 20000 - 0.625) < 0.02


def test_fingerprints(docs, none):
    ids = [r for r in ROWS if r[0] is not None][:-1]
    out = {r["doc_id"]: r for r in fingerprint.fingerprint_edits(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    for (d, t, *_), (_, n, *_) in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n = t or "", n or ""
        c = len(t) // 4
        assert out[d]["edited"] == t[: len(t) - c] + n[:c]
        words = tokens(t)
        assert words or not out[d]["sketch"]
        assert len(out[d]["sketch"]) <= max(1, len(words))
    assert out[3]["sketch"] == out[40]["sketch"] == out[41]["sketch"]
    assert fingerprint.fingerprint_edits(none).count() == 0
    assert fingerprint.fingerprint_edits(docs).count() == len(ROWS)


def test_sketches_estimate_containment(spark):
    r = random.Random(2)
    long = [str(r.random()) for _ in range(8000)]
    df = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[2000:4000])), (3, " ".join(long[:4000] + [str(r.random()) for _ in range(4000)]))], "i int, text string")
    s = {x["i"]: x["sketch"] for x in fingerprint.with_sketch(df, "text", "sketch").collect()}
    held = lambda a, b: len(set(s[a]) & set(s[b])) / len(s[a])
    assert held(2, 1) > 0.98 and abs(held(1, 2) - 0.25) < 0.03 and abs(held(3, 1) - 0.5) < 0.04


def test_lines_of_many_sites_go(docs, none):
    out = line_dedup.dedup_lines(docs, sites=4).collect()
    assert len(out) == len(ROWS)
    home, site = {}, collections.defaultdict(set)
    for _, t, _, s, *_ in ROWS:
        home[t] = min(home.get(t, "~"), s or "\x00")
    for t, s in home.items():
        for line in (t or "").split("\n"):
            if line.strip():
                site[line.strip(" \t\n\r\v\f")].add(s)
    bad = {x for x, s in site.items() if len(s) >= 4}
    assert "shared line of the sites" in bad
    clean = lambda x: x.strip(" \t\n\r\v\f")
    text = {(d, t): t for d, t, *_ in ROWS}
    for d, t in text:
        row = next(r for r in out if r["doc_id"] == d and r["n_lines"] == (0 if t is None else t.count("\n") + 1))
        if t is None:
            assert row["text"] is None
            continue
        assert row["text"] == "\n".join(x for x in t.split("\n") if clean(x) not in bad)
    assert line_dedup.dedup_lines(none).count() == 0


def test_copies_count_once_and_short_lines_of_their_own_save_nothing(spark):
    """A line on 40 sites goes from all its texts, whatever else they hold; one text on 40 sites proves nothing; texts stand for their smallest site."""
    rows = [(f"shared line\nown {i}", f"s{i}") for i in range(40)] + [("shared line", "s0"), ("  shared line \n\n", None)]
    rows += [("a copied text\nof two lines", f"s{i}") for i in range(40)]
    rows += [(f"four sites\n{i}", f"s{i % 4}") for i in range(9)] + [("four sites\nand copies", f"s{i}") for i in range(9)]
    rows += [(f"five sites\n{i}", f"s{i % 5}") for i in range(9)] + [(None, "s3"), ("", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    out = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(df).collect()}
    want = [(f"own {i}", 1) for i in range(40)] + [("", 1), ("\n", 1)] + [(rows[42][0], 0)] * 40
    want += [(r[0], 0) for r in rows[82:100]] + [(f"{i}", 1) for i in range(9)] + [(None, 0), ("", 0)]
    assert [out[i] for i in range(len(rows))] == want
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_a_mix_is_the_same_however_it_is_dealt(spark):
    """Null and repeated doc_ids with unlike texts."""
    r = random.Random(3)
    rows = [(None if i % 3 == 0 else i % 5, " ".join("w" * r.randint(1, 9) for _ in range(r.randint(1, 40))) + f" {i}", f"s{int(r.expovariate(0.6))}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixes = [sorted(map(str, mixing.mix_sources(df.repartition(n), entropy=0.9, budget_share=0.7, block_tokens=400).collect())) for n in (1, 3, 7)]
    assert mixes[0] == mixes[1] == mixes[2]
    blocks = mixing.mix_sources(df.where("doc_id is null"), max_repeats=2.0, block_tokens=100).select("source", "block").distinct().count()
    assert blocks > df.where("doc_id is null").select("source").distinct().count()


def test_no_likeness_from_nothing(spark):
    df = spark.createDataFrame([(1, "one two three", "four five six"), (2, "one two three", "one two three"), (3, "", "")], "i int, a string, b string")
    out = fingerprint.with_sketch(fingerprint.with_sketch(df, "a", "x", 1 << 40), "b", "y", 1 << 40)
    got = out.orderBy("i").select(fingerprint.jaccard(F.col("x"), F.col("y")), fingerprint.jaccard(F.col("x"), F.col("y"), F.col("a") == F.col("b")), fingerprint.containment(F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in got] == [(None, 0.0, None), (None, 1.0, None), (None, 1.0, None)]


def test_mixing_repeats(docs, none):
    out = mixing.mix_sources(docs, max_repeats=2.0).collect()
    n = collections.Counter(r["doc_id"] for r in out)
    have = collections.Counter(r[0] for r in ROWS if tokens(r[1]))
    assert all(n[d] >= c for d, c in have.items())
    token = {s: sum(len(tokens(t)) for _, t, _, x, *_ in ROWS if x == s) for s in {r[3] for r in ROWS}}
    mixed = collections.Counter()
    for r in out:
        mixed[r["source"]] += len(tokens(r["text"]))
    assert all(mixed[s] <= 2.001 * token[s] for s in token) and max(mixed[s] / token[s] for s in token if token[s]) > 1.5
    assert mixing.mix_sources(none, max_repeats=2.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs)


def test_mixing_entropy(spark):
    shares = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10), ("d", 0), (None, 5)], "source string, tokens long")
    a = mixing.bisect_exponent(shares, entropy=0.9)
    p = np.array([900, 90, 10, 5.0]) ** a
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() / np.log(4) - 0.9) < 1e-6
    assert abs(900**a and mixing.bisect_exponent(shares, max_repeats=180.0)) < 1e-6


def test_toxicity_learns_words_and_spelling(spark):
    r = random.Random(7)
    plain = ["".join(r.choice("abdefgh") for _ in range(6)) for _ in range(300)]
    bad = ["zzk" + "".join(r.choice("abdefgh") for _ in range(3)) for _ in range(200)]

    def text(toxic):
        w = [r.choice(plain) for _ in range(r.randint(5, 300))]
        for _ in range(4 if toxic else 0):
            w.insert(r.randint(0, len(w)), r.choice(bad))
        return " ".join(w)

    y = [i % 4 == 0 for i in range(400)]
    rows = [(i, text(t), "x") for i, t in enumerate(y)] + [(900, None, ""), (901, "", ""), (902, "zzkabc " * 3000, ""), (None, "abc", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(y)] + [(901, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = {x["doc_id"]: x["score"] for x in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.5) == y[i] for i in held]) > 0.9
    assert out[900] == out[901] < 0.5 and all(0 <= v <= 1 for v in out.values())
    no_labels = toxicity.toxicity(docs, labels.where("false"))
    assert no_labels.agg(F.max("score")).first()[0] < 0.01
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_toxicity_gradients():
    """The network's and the vectors' gradients against finite differences."""
    model, r = toxicity.Model(3), np.random.default_rng(4)
    model.w = {k: w.astype(np.float64) for k, w in model.w.items()}
    words = [b"abcd", b"bcde", b"zzz", b"q"]
    table, rows = toxicity.Vectors(model, words), r.integers(0, 4, (7, 5))
    mask, y = (np.arange(7)[:, None] < np.array([7, 5, 3, 1, 6])).astype(float), np.array([0, 1, 0, 1, 1])
    x = np.zeros((1, 4, 2 * toxicity.DIM + 1))
    x[0] = model.inputs(words)

    def loss():
        table.refresh(x, np.arange(4))
        v = x[0][rows]
        out = model.gradients(np.stack([v @ model.w[f"x{s}"] + model.w[f"c{s}"] for s in "fb"]), mask, y)
        return out

    g, d_x, _ = loss()
    picked, d = toxicity.input_gradients(model, rows, d_x)
    checks = [(model.w[k], i, g[k][i]) for k in ("uf", "ub") for i in [(0, 1), (3, 20), (7, 12)]] + [(model.w[k], i, g[k][i]) for k in ("a", "v") for i in [(2,), (11,)]]
    for name, (at, grad) in table.gradients(picked, d).items():
        checks += [(model.w[name], (at[i], k + 1), grad[i, k]) for i in (0, len(at) - 1) for k in (0, toxicity.DIM - 2)]
    for w, i, want in checks:
        own, ends = w[i], []
        for step in (1e-4, -1e-4):
            w[i] = own + step
            ends.append(loss()[2])
        w[i] = own
        assert abs((ends[0] - ends[1]) / 2e-4 - want) < 1e-4 + 1e-2 * abs(want)


CLASHING = ["n_full", "h1", "h2", "pos", "line", "u1", "bad", "at", "_d", "_t", "d", "t", "low_d", "node", "_source", "_tokens", "_s", "_b", "_whole", "_rest", "_key", "_sum", "target", "blocks", "stop", "host2"]


def test_columns_of_clashing_names_are_kept(spark):
    rows = [(i, f"own text {i} of some words\nshared line", f"s{i % 6}", *[f"{c}{i}" for c in CLASHING]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHING))
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    kept = {"lines": line_dedup.dedup_lines(df), "near": near_copies.drop_near_copies(df, similarity=0.8), "wide": near_copies.drop_near_copies(df), "mix": mixing.mix_sources(df, max_repeats=2.0), "toxic": toxicity.toxicity(df, labels)}
    for name, out in kept.items():
        out = out.collect()
        assert len({r["doc_id"] for r in out}) == 12 and all(r[c] == f"{c}{r['doc_id']}" for r in out for c in CLASHING), name
    assert all(r["n_removed"] == 1 for r in kept["lines"].collect())
    # of a row that is repeated with other columns, one stays, always the same
    twice = df.unionByName(df.withColumn("pos", F.lit("other")))
    found = [sorted((r["doc_id"], r["pos"]) for r in near_copies.drop_near_copies(twice.repartition(n), similarity=0.8).collect()) for n in (1, 5)]
    assert len(found[0]) == 12 and found[0] == found[1]


def test_texts_of_megabytes(spark):
    r = random.Random(3)
    vocabulary = [f"word{i}" for i in range(5000)]
    long = " ".join(r.choice(vocabulary) + ("\n" if i % 15 == 0 else "") for i in range(250_000))
    rows = [(1, long, "a"), (2, long + " end", "b"), (3, "short", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(map(tuple, substring_dedup.remove_repeats(df).select("doc_id", "n_removed").collect())) == [(1, 250_000), (2, 250_000), (3, 0)]
    assert {x["doc_id"]: x["component_id"] for x in simhash.simhash_components(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert sorted(x["doc_id"] for x in near_copies.drop_near_copies(df, similarity=0.8).collect()) == [1, 3]
    assert line_dedup.dedup_lines(df, sites=2).where("doc_id < 3 and n_removed > 16000").count() == 2
    copies = df.withColumn("text", F.expr("if(doc_id = 2, left(text, length(text) - 4), text)"))
    assert line_dedup.dedup_lines(copies, sites=2).where("doc_id < 3 and n_lines > 16000 and n_removed = 0").count() == 2  # one text
    paged = df.unionByName(df.selectExpr("doc_id + 10 AS doc_id", "concat(text, chr(10), 'head') AS text", "source"))
    assert line_dedup.dedup_lines(paged, sites=3).where("n_lines > 16000 and n_removed = 1 and doc_id > 10").count() == 2
    assert mixing.mix_sources(df, max_repeats=2.0).where("n_tokens >= 250000").count() >= 2
    packed = {x["doc_id"]: (x["n"], x["m"]) for x in packing.pack_documents(df).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("m")).collect()}
    assert packed[1][0] > 250_000 and packed[1][1] == 2048
    assert sharding.shard_documents(df, [1.0] * 3).where(F.col("size") > 1_500_000).count() == 2
    near = fingerprint.fingerprint_edits(df).select("doc_id", fingerprint.jaccard(F.col("sketch"), F.col("next_sketch")).alias("j")).collect()
    assert {x["doc_id"]: x["j"] > 0.99 for x in near} == {1: True, 2: False, 3: False}


def test_windows_cover_all():
    for n in (0, 1, 63, 64, 65, 96, 97, 1000):
        w = toxicity.windows_of(n)
        assert set().union(*[range(a, b) for a, b in w]) == set(range(n)) and all(b - a <= toxicity.SPAN for a, b in w)


def test_values_of_lists_and_texts_that_need_no_hashes(monkeypatch):
    """Slices of lists with nulls; what is only shown or sliced of a text is looked up without hashing its words."""
    lists = pa.array([[1, 2], None, [], [3], [4, 5, 6]], pa.list_(pa.int32()))
    assert [v.tolist() for v in substring_dedup.values_of(lists)] == [[1, 2], [], [], [3], [4, 5, 6]]
    assert [v.tolist() for v in substring_dedup.values_of(lists.slice(1, 3))] == [[], [], [3]]
    monkeypatch.setattr(substring_dedup.Hasher, "words", lambda *_: 1 / 0)
    ints, text = pa.list_(pa.int32()), " ".join(map(str, range(50)))
    columns = [pa.array([7]), pa.array([8]), pa.array([text]), pa.array([None], ints), pa.array([[]], ints), pa.array([[]], ints), pa.array([[2]], ints), pa.array([[4]], ints), pa.array([[{"a": 1, "n": 3}]])]
    rows = pa.RecordBatch.from_arrays(columns, list("abcdefghi"))
    found = pa.Table.from_batches(substring_dedup._windows(35, 8)(iter([rows]))).to_pylist()
    assert [(r["start"], r["n"], r["what"]) for r in found] == [(2, 1, substring_dedup.SHOW), (3, 1, substring_dedup.SHOW), (1, 3, substring_dedup.SLICE)]
    want = [" ".join(map(str, range(a, b))).encode() for a, b in ((2, 37), (3, 38), (1, 38))]
    assert [(r["w1"], r["w2"]) for r in found] == [substring_dedup.digest_of(w) for w in want]
