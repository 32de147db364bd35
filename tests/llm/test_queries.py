"""The registered queries by name: columns, types, and rows against brute force on the small tables."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mapfold.llm import fingerprint
from mapfold.llm.queries import QUERIES
from mapfold.llm.sharding import rendezvous_score

from .test_documents import simple_hash, stripped, tokens

SF = "/root/testdata/sf0.001"
TYPES = {
    "op1_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op6_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op7_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, held_by_edited double",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    df = QUERIES[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == TYPES[name]
    return df.collect()


def test_op1(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    got, hits = run(spark, "op1_ann"), []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -9
        own = sorted((r for r in got if r["query_id"] == ids[i]), key=lambda r: r["rank"])
        hits.append(len({r["vec_id"] for r in own} & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20)
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert all(abs(r["score"] - x[i] @ x[ids == r["vec_id"]][0]) < 1e-12 for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
    assert np.mean(hits) >= 0.9


def test_op2(spark, texts):
    got = run(spark, "op2_toxicity")
    assert {r["doc_id"] for r in got} == set(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)


def test_op3(spark, texts):
    assert sorted(map(tuple, run(spark, "op3_substring_dedup")), key=str) == stripped([(d, t) for d, t in texts.items()], 35)


def test_op6(spark, texts):
    got = run(spark, "op6_packing")
    assert {r["doc_id"] for r in got} == set(texts) and all(0 <= r["offset"] <= 2048 - r["length"] for r in got)


def test_op7(spark, texts):
    """Winners by all scores of all shards."""
    ids = spark.createDataFrame([(d, s) for d in texts for s in range(41)], "d long, s int")
    best = {}
    for r in ids.select("d", "s", rendezvous_score(F.col("d"), F.col("s"), F.lit(1.0)).alias("v")).collect():
        for many in (40, 41):
            if r["s"] < many:
                best[r["d"], many] = max(best.get((r["d"], many), (-1, 0)), (r["v"], -r["s"]))
    got = run(spark, "op7_sharding")
    for r in got:
        t = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(t) + 16, zlib.crc32(t), "key")
        assert (r["shard"], r["grown_shard"]) == (-best[r["doc_id"], 40][1], -best[r["doc_id"], 41][1])
    for s in range(40):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len(got) == len(texts)


def test_op8(spark, texts):
    fps = {d: simple_hash(t) for d, t in texts.items()}
    low = {d: d for d in fps}
    for _ in range(20):
        low = {a: min(low[b] for b in fps if (fps[a] ^ fps[b]).bit_count() <= 2) for a in fps}
    got = run(spark, "op8_simhash")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{fps[d]:016x}", low[d]) for d in fps}


def sketch(text):
    """Every five-word shingle hash under half of the range, as the query makes it: hashes of words, hashed on."""
    h = [xxhash.xxh64_intdigest(w, seed=42) for w in tokens(text)]
    out = set()
    for s in [h[i : i + 5] for i in range(len(h) - 4)] if len(h) >= 5 else [h] if h else []:
        seed = 42
        for x in s:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", x), seed=seed)
        out.add(seed)
    return {x for x in out if x < (1 << 64) // fingerprint.SCALE}


def test_op10(spark, texts):
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in run(spark, "op10_fingerprints")}
    alike = lambda a, b, same: len(a & b) / len(a | b) if a | b else float(same)
    shown = lambda s: "".join(f"{x:016X}" for x in sorted(s))
    assert set(got) == set(ids)
    for d, n in zip(ids, ids[1:] + ids[:1], strict=True):
        t, cut = texts[d], len(texts[d]) // 4
        edited = t[: len(t) - cut] + texts[n][:cut]
        a, b, c = sketch(t), sketch(edited), sketch(texts[n])
        want = (len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), alike(a, b, t == edited), alike(a, c, t == texts[n]))
        assert tuple(got[d])[1:7] == want


@pytest.mark.parametrize("parts", [2, 7, 200])
def test_next_rows(spark, parts):
    """The row next by id, with ids of very many rows, nulls among them, against a sorted list."""
    rows = [(None if i % 5 == 0 else 7 if i % 3 == 0 else i, f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "i long, t string").repartition(4)
    got = fingerprint.with_next(df, "i", ["t"], parts)
    order = [(r["i"], r["t"]) for r in df.select("i", "t", F.xxhash64("t").alias("h")).orderBy(F.col("i").asc_nulls_first(), "h").collect()]
    want = sorted((*a, b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True) if a[0] is not None)
    assert sorted((r["i"], r["t"], r["next_t"]) for r in got.where("i is not null").collect()) == want
    assert sorted(r["next_t"] for r in got.collect()) == sorted(t for _, t in rows)
