"""The pipeline's stages on a driver table: each against its own input."""

import os
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from waypost.llm import quality, simhash

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + 3]).encode(), 42)
              for k in range(max(len(words) - 2, 1))] if words else []
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def _firsts(lines):
    """The smallest doc_id of every chain of fingerprints within two bits, by comparing all."""
    bits = {doc_id: _fingerprint(text) for doc_id, text in zip(lines.doc_id, lines.text)}
    left, firsts = set(bits), set()
    while left:
        first = min(left)
        firsts.add(first)
        front = {first}
        while front:
            left -= front
            front = {d for d in left if any((bits[d] ^ bits[f]).bit_count() <= 2 for f in front)}
    return firsts


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = quality.fit(docs, labels)
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, steps[-1], SF_DIR).write.parquet(path)
        steps.append(spark.read.parquet(path))
        if name != "encoding":
            assert steps[-1].columns == docs.columns
    raw, good, lines, single, mixed, encoded = [step.toPandas() for step in steps]
    scores = quality.scored(docs, model).toPandas()
    assert set(good.doc_id) == set(scores[scores.predicted == 1].doc_id)
    assert sorted(lines.doc_id) == sorted(good.doc_id)
    seen, want = set(), {}
    for row in good.sort_values("doc_id").itertuples():
        kept = []
        for line in row.text.split("\n"):
            if not line.strip(" \t\n\r\x0b\x0c") or line not in seen:
                kept.append(line)
                seen.add(line)
        want[row.doc_id] = "\n".join(kept)
    assert dict(zip(lines.doc_id, lines.text)) == want
    assert (lines.n_chars == lines.text.str.len()).all()
    assert single.doc_id.is_unique and set(single.doc_id) == _firsts(lines)
    assert set(mixed.doc_id) <= set(single.doc_id) and mixed.groupby("doc_id").size().max() <= 3
    assert sorted(encoded.doc_id) == sorted(mixed.doc_id)
    texts = steps[4].select("doc_id", F.md5("text").alias("md5")).distinct().toPandas()
    assert dict(zip(encoded.doc_id, encoded.decoded_md5)) == dict(zip(texts.doc_id, texts.md5))
    assert (encoded.ids.str.len() == encoded.n_pieces).all()


def test_near_dedup_keeps_one_row_of_each_group(spark):
    """Repeated rows, a doc_id with two texts, and groups without ids beside each other."""
    rng = random.Random(3)
    a, b, c, d = (" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(80)) for _ in range(4))
    rows = [(4, a), (4, a), (4, a), (9, a), (None, a), (4, b), (6, b), (None, c), (None, c), (None, d), (7, d)]
    docs = spark.createDataFrame([(1, k, t, "x") for k, t in rows], "size int, doc_id long, text string, id string")
    got = corpus_pipeline.one_of_each(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted(
        [("4", a), ("4", b), ("None", c), ("7", d)])
    assert corpus_pipeline.one_of_each(spark, docs.limit(0), "").count() == 0
