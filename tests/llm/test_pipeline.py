"""The pipeline from end to end against a plain chain of its five stages."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from rowloom.llm import quality
from tests.llm.test_operators import brute_classes, overlap, shingles, words

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good and bad documents, copies, repeated ids, benchmark passages and addresses."""
    draw = random.Random(21)
    vocabulary = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("an", "er", "ion", "el", "ou", "ive", "y")]

    def prose(n):
        return " ".join(draw.choice(vocabulary) + draw.choice(["", "", "s", "ed"]) for _ in range(n)) + "."

    passages = [(i, prose(24)) for i in range(4)] + [(9, None), (10, "")]
    rows = [(i, prose(draw.choice([60, 120, 250]))) for i in range(40)]
    rows += [(100 + i, prose(70) + f" write to user{i}@mail.example.org now") for i in range(6)]
    rows += [(200 + i, prose(60) + " " + passages[i % 4][1] + " " + prose(40)) for i in range(6)]
    near = rows[3][1].split(" ")
    near[7] = "changed"
    rows += [(300, rows[3][1]), (301, " ".join(near)), (302, rows[4][1].upper())]
    rows += [(3, prose(80)), (5, rows[5][1]), (310, rows[6][1]), (310, prose(90))]  # repeated ids
    rows += [(400, "too short"), (401, ""), (402, None), (403, "a b c " * 60), (None, prose(75)), (404, "*** " * 80)]
    docs = spark.createDataFrame(
        [(i, t, "en", "w", len(t or "")) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int")
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, [t for _, t in passages if t]


def plain_chain(rows, passages, cutoffs):
    """ids and texts that are left, by brute force."""
    measured = quality.measure(pa.array([t for _, t in rows], pa.string()))
    rows = [r for r, kept in zip(rows, cutoffs.verdict(measured).tolist()) if kept]
    # One document of each class: the smallest id. Texts, not ids, are linked.
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault((i, " ".join(words(t))), t)
    keys = sorted(texts)
    of = brute_classes({n: texts[k] for n, k in enumerate(keys)})
    first = {}
    for n in range(len(keys)):
        first.setdefault(of[n], n)
    kept = [(keys[n][0], texts[keys[n]]) for n in sorted(first.values())]
    kept += [(i, t) for i, t in rows if i is None]
    # A passage in any window of a document's words.
    clean = []
    for i, t in kept:
        w, found = words(t), False
        for p in passages:
            own, n = shingles(p), len(words(p))
            for size in range(max(5, int(0.75 * n)), int(1.3 * n) + 1):
                found = found or any(
                    overlap(shingles(" ".join(w[at : at + size])), own) >= 0.8 for at in range(max(1, len(w) - size + 1))
                )
        if not found:
            clean.append((i, re.sub(EMAIL, "[EMAIL]", t)))
    return clean


def test_pipeline_equals_a_plain_chain(spark, corpus):
    import tiktoken

    folder, rows, passages = corpus
    got = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    cutoffs = quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    left = plain_chain(rows, passages, cutoffs)
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in left:
        ids = encoder.encode_ordinary(t)
        names = ",".join(map(str, ids)).encode()
        want[i, len(ids), hashlib.sha256(names).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want
    ids = [r["doc_id"] for r in got]
    # Copies and passages are gone, both texts of a repeated id are looked at.
    assert {300, 301, 302} & set(ids) == set() and not {200, 201, 202, 203} & set(ids)
    assert ids.count(3) == 2 and ids.count(5) == 1 and ids.count(310) == 1 and None in ids
    assert not {400, 401, 402, 403} & set(ids) and np.sum([100 <= (i or 0) < 106 for i in ids]) == 6


def test_stages_keep_columns_and_rows_of_empty_tables(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_dedup", "decontamination", "personal_data", "byte_bpe",
    ]
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0
        if name != "byte_bpe":
            assert out.columns == docs.columns
