"""Centroid clustering, importance resampling and byte-level BPE against brute force, and every registered query with SQL against it."""

import hashlib
import math
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, centroids, resampling
from quarry.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import ODD, SF, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain(frame):
    return sorted(str([None if pd.isna(x) else x if isinstance(x, str) else int(x) for x in row]) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_registered_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and plain(got) == plain(want)


# centroid clustering


def brute_clusters(rows, k, count, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == k and all(x is not None and math.isfinite(x) for x in v)]
    centre = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:count]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centre))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        centre = [[sum(c) // len(c) for c in zip(*members, strict=True)] if (members := [v for (_, v), o in zip(kept, own, strict=True) if o == j]) else centre[j] for j in range(len(centre))]
    return sorted((str(i), near(v)[1], near(v)[0]) for i, v in kept), centre


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "c", 3) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int")


def random_rows(n, k, seed, spread=2.0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=k) * spread).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("n", "k", "count", "rounds"), [(200, 5, 6, 3), (300, 64, 16, 3), (3, 2, 5, 2), (60, 1, 4, 4), (50, 3, 1, 1)])
def test_clusters_by_brute_force(spark, n, k, count, rounds):
    rows = random_rows(n, k, n)
    found, centre = centroids.clusters(vectors(spark, rows).repartition(3), k, count, rounds)
    want, want_centre = brute_clusters(rows, k, count, rounds)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == want
    assert centre.tolist() == want_centre


def test_clusters_of_odd_rows(spark):
    good = random_rows(40, 3, 1)
    rows = [*good, (7, None), (8, [1.0, 2.0]), (9, [1.0, 2.0, None]), (10, [float("nan"), 0.0, 0.0]), (11, [float("inf"), 0.0, 0.0]), (None, [0.5, 0.5, 0.5]), (5, good[5][1]), (5, [-9.0, 3.0, 0.25]), (12, [])]
    want, centre = brute_clusters(rows, 3, 4, 3)
    got = centroids.clustering(vectors(spark, rows), 3, 4).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == want
    total = sum(d for _, _, d in want)
    for r in got:
        assert (r.inertia, r.cluster_inertia) == (total, sum(d for _, c, d in want if c == r.cluster))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centre[r.cluster])).encode()).hexdigest()


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)]
    want, centre = brute_clusters(rows, 2, 8, 3)
    found, got = centroids.clusters(vectors(spark, rows), 2, 8, 3)
    assert got.tolist() == centre and sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == want


def test_no_vectors_and_too_large_ones(spark):
    assert centroids.clustering(vectors(spark, [])).collect() == []
    assert centroids.clustering(vectors(spark, [(1, [1.0]), (2, None)])).collect() == []
    with pytest.raises(Exception, match="might not fit a long"):
        centroids.clustering(vectors(spark, [(1, [1e9, 0.0])]), 2).collect()


def test_inequalities_reject_and_lose_nothing():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (4000, 8)) + rng.integers(-900, 900, (4000, 1))
    centre = x[rng.permutation(len(x))[:50]]
    search = centroids.Search(centre)
    number, best = search.found(x)
    d = ((x[:, None] - centre[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (number == d.argmin(axis=1)).all()
    assert search.tried < len(x) * len(centre) / 4


# importance resampling

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, buckets, grams):
    w = W.findall((text or "").translate(LOW))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, grams + 1) for i in range(len(w) - n + 1)]


def brute_resampling(docs, target, buckets, grams, least, percent):
    own = [(i, *features(t, buckets, grams)) for i, t in docs]
    s = np.bincount(np.array([b for _, _, f in own for b in f], int), minlength=buckets)
    t = np.zeros(buckets, int)
    for x in target:
        for b in features(x, buckets, grams)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (int(s.sum()) + buckets) / ((x + 1) * (int(t.sum()) + buckets)))) for x, y in zip(s.tolist(), t.tolist(), strict=True)]
    rows = []
    for i, n, f in own:
        weight = sum(gain[b] for b in f)
        h = None if i is None else int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = [r for r in rows if r[1] >= least]
    drawn = sorted((r for r in long if r[4] is not None), key=lambda r: (-r[4], r[0]))[: len(long) * percent // 100]
    rank = {}
    for k, r in enumerate(drawn):
        rank.setdefault(r, []).append(k + 1)
    return sorted(str([r[0], *r[2:], rank[r].pop(0) if rank.get(r) else None]) for r in rows)


def drawn_rows(df):
    return sorted(str([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in df.collect())


@pytest.mark.parametrize(("buckets", "grams", "percent"), [(50, 3, 40), (10_000, 2, 5), (97, 1, 100), (31, 5, 30)])
def test_resampling_by_brute_force(spark, buckets, grams, percent):
    texts = [*ODD, *[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(80).collect()], "w" * 700 + " x " + "y" * 300, "Same words here"] + ["Same words here"] * 3
    target = ["same words HERE again", None, "日本語 x", ""]
    docs = list(enumerate(texts))
    got = resampling.resampled(table(spark, texts).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), buckets, grams, 3, percent)
    assert drawn_rows(got) == brute_resampling(docs, target, buckets, grams, 3, percent)


def test_resampling_of_odd_rows(spark):
    texts, ids = ["a b c d", "a b c d", "x y z", None, "q r s t", "a b c d e f"], [3, 3, 4, 5, None, 3]
    target = spark.createDataFrame([("a b",)], "text string")
    got = resampling.resampled(table(spark, texts, ids), target, 50, 2, 3, 60)
    assert drawn_rows(got) == brute_resampling(list(zip(ids, texts, strict=True)), ["a b"], 50, 2, 3, 60)
    assert resampling.resampled(table(spark, []), target).collect() == []
    empty = resampling.resampled(table(spark, texts), target.where(F.lit(False)), 50, 2, 3, 60)
    assert empty.count() == 6


def test_ngrams_do_not_run_over_two_texts():
    found = resampling.Features(pa.array(["a b", "c", "", "d e f"]), 3)
    crc = lambda *words: [zlib.crc32(w.encode()) for w in words]
    assert [c.tolist() for c in found.crcs] == [crc("a", "b", "c", "d", "e", "f"), crc("a b", "d e", "e f"), crc("d e f")]
    assert [t.tolist() for t in found.texts] == [[0, 0, 1, 3, 3, 3], [0, 3, 3], [3]]


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def some_texts(spark):
    rng = np.random.default_rng(5)
    signs = list("ab c  \t\n'sé ü\xa0\x85　 中字1½²👍🏽é.,-_ЯžA")
    made = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(3000)]
    return [*ODD, *made, *[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], "aaa" * 3000, " " * 500 + "x"]


def test_byte_bpe_as_the_library(spark, library):
    texts = some_texts(spark)
    for r in byte_bpe.encoded_digests(table(spark, texts), RANKS).collect():
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()), text[:80]
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_places_and_decoding(spark, library):
    texts = some_texts(spark)
    own = byte_bpe.byte_bpe(RANKS, public_tokenizers.PATTERN)
    rows = byte_bpe.encode_documents(table(spark, texts), RANKS)
    for r in rows.collect():
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text)
        assert [*zip(r.starts, r.ends, strict=True)] == own.library.encode(text).offsets  # of whole characters, also for parts of them
    assert all(r.text == (texts[r.doc_id] or "") for r in byte_bpe.decode_documents(rows, RANKS).collect())


def test_decoding_of_split_characters(spark, library):
    ids = library.encode_ordinary("👍🏽")
    assert len(ids) > 2
    assert byte_bpe.decode([ids, ids[:1], [], ids[1:]], RANKS) == [library.decode_bytes(x) for x in (ids, ids[:1], [], ids[1:])]
    got = byte_bpe.decode_documents(spark.createDataFrame([(1, ids[:1]), (2, None), (3, ids)], "doc_id long, ids array<int>"), RANKS)
    assert {r.doc_id: r.text for r in got.collect()} == {1: library.decode_bytes(ids[:1]).decode("utf-8", "replace"), 2: "", 3: "👍🏽"}


def test_byte_bpe_of_odd_rows(spark):
    assert byte_bpe.encoded_digests(table(spark, []), RANKS).collect() == []
    got = byte_bpe.encoded_digests(table(spark, ["x y", None, "x y", "x y"], [1, 1, None, 1]), RANKS).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 0), ("1", 2), ("1", 2), ("None", 2)]


def test_chunks_are_cut_where_no_match_runs_on():
    texts = ["", "a b", " é ü ", "", "中 字", "x  y z"]
    chunks, edges = byte_bpe.cut(pa.array(texts))
    assert ["".join(chunks.to_pylist()[a:b]) for a, b in zip(edges, edges[1:], strict=False)] == texts
    assert {" b", " z"} <= set(chunks.to_pylist()) and " y" not in chunks.to_pylist()
    assert byte_bpe.pair_of(b"abc", {b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"abc": 4}) == (b"a", b"bc")
