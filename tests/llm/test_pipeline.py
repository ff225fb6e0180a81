"""The pipeline's stages on their own inputs, against brute force where they are exact."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm.queries import OP2_SQL, OP8_SQL
from tests.llm.test_near_copies import staying
from tests.llm.test_operators import fingerprint, normal, roots

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import duckdb

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    con = duckdb.connect()
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(path := str(tmp_path / str(k)))
        after = spark.read.parquet(path)
        rows = {r.doc_id: r.text for r in before.collect()}
        kept = {r.doc_id for r in after.collect()}
        con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/{k - 1}/*.parquet'" if k else f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        if name == "exact dedup":
            assert kept == {r[0] for r in con.sql(f"SELECT keep_id FROM ({OP2_SQL})").fetchall()}
            assert len({normal(rows[i]) for i in kept}) == len(kept)
        elif name == "simhash near-dedup":
            ids = sorted(rows)
            first = [ids[r] for r in sorted(set(roots([fingerprint(rows[i], 5) for i in ids])))]
            assert kept == {first[k] for k in staying([rows[i] for i in first])}
        elif name == "benchmark decontamination":
            assert kept == {r[0] for r in con.sql(f"SELECT doc_id FROM ({OP8_SQL}) WHERE NOT contaminated").fetchall()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        before = after
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in before.collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, t.encode(rows[r.doc_id], add_special_tokens=False).ids)).encode()).hexdigest()


def test_odd_tables(spark, tmp_path):
    """Nulls, repeated rows and ids, a very long text, clashing names; and empty tables."""
    long = " ".join(f"w{i}" for i in range(30_000))
    item = " ".join(f"b{i}" for i in range(12))
    texts = [None, "", "one text", "one text", "one  text", long, long + " end", f"x {item}", "clean row of the same id", "another row without id", f"y {item}"]
    ids = [None, 1, 2, 2, 3, 4, 5, 7, 7, None, None]
    rows = [(i, t, "en", "s", 1, 1, 1, 1) for i, t in zip(ids, texts, strict=True)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, own long, component long"
    for name, data in (("odd", rows), ("empty", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, item)][: len(data)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        n = lambda text: len(t.encode(text, add_special_tokens=False).ids)
        want = [(1, 0), (3, n("one text")), (4, n(long)), (7, n("clean row of the same id")), (None, n("another row without id"))]
        assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == (sorted(want, key=str) if data else [])
