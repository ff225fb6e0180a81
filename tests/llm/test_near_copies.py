"""Near copies by word shingles against brute force over all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import near_copies
from quarry.llm.exact_dedup import middle_id, without_copies
from tests.llm.test_operators import ODD, SF, real, table


def runs_of(text):
    parts = (text or "").encode("utf-8").lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def staying(texts):
    """Places of the texts that stay, by all pairs."""
    sets, root = [runs_of(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [i for i in range(len(texts)) if find(i) == i]


def edited(r, words, n):
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = f"x{r.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize(("sample", "following", "block"), [(20_000, 8, 2000), (20_000, 1, 4), (1, 1, 2000)])
def test_near_copies_by_brute_force(spark, monkeypatch, sample, following, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    monkeypatch.setattr(near_copies, "NEXT", following)
    r = random.Random(3)
    texts = ODD + [x.text for x in real(spark).orderBy("doc_id").limit(60).collect()]
    for n in (1, 4, 5, 6, 9, 30, 200):
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        texts += [edited(r, base, r.randint(0, min(n, 1 + n // 20))) for _ in range(25)] + [" ".join(base).upper(), " ".join(base[: n * 4 // 5])]
    line = " ".join(f"common{i}" for i in range(12))
    texts += [line + " " + " ".join(f"own{k}-{i}" for i in range(k % 5)) for k in range(40)]
    assert len(want := staying(texts)) < len(texts) - 60
    assert sorted(x.doc_id for x in near_copies.one_of_each(table(spark, texts)).collect()) == want


def test_rows_without_doc_id_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " end"
    rows = near_copies.one_of_each(table(spark, [text, near, "another text of some words here", near, near, None, None], [1, 2, 2, None, None, 3, 4])).collect()
    assert sorted((x.doc_id or 0, x.text or "") for x in rows) == sorted([(1, text), (2, "another text of some words here"), (3, ""), (4, "")])
    assert near_copies.one_of_each(table(spark, [])).collect() == []


def test_pipeline_leaves_no_near_copies(spark):
    """What the stages that drop copies keep has no two texts of similarity 0.8 or more."""
    docs = real(spark)
    docs = without_copies(docs, middle_id(docs))
    for name, stage in corpus_pipeline.STAGES:
        if "near-dedup" in name:
            docs = stage(spark, docs, SF)
    kept = [x.text for x in docs.collect()]
    assert len(staying(kept)) == len(kept)


def test_class_counts_lose_no_similar_pair():
    r = random.Random(5)
    for _ in range(300):
        n = r.choice([1, 3, 10, 100, 3000])
        a = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
        b = np.unique(np.concatenate((a[: len(a) - r.randint(0, len(a) // 4)], np.array([r.getrandbits(64) for _ in range(r.randint(0, n // 4))], np.uint64))))
        (kept,) = near_copies.may_be_near([near_copies.class_counts(a)], [near_copies.class_counts(b)])
        assert kept or not near_copies.near(a, b)
    same = np.arange(300, dtype=np.uint64) * np.uint64(256)
    assert near_copies.class_counts(same) is None and near_copies.may_be_near([None, b"\0" * 256], [None, None]).all()
