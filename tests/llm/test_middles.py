"""Fill-in-middle cuts against a plain split of the text, and exact round trips."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from waypost.llm import middles

SCHEMA = "n int, doc_id long, text string, form string, id string"


def brute(doc_id, text, rate=100, spm_rate=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def corpus():
    rng = random.Random(2)
    letters = ["a", "é", "日", "😀", " ", "\n", "\n", "\r\n", "<P", "<", "S>", "\x85", " "]
    for k in range(250):
        yield k * 7 - 30, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 40, 3000])))
    yield from [(5000, None), (5001, ""), (None, "a\nb\nc"), (None, None), (5002, "\n"), (5003, "\n\n\n"),
                (5004, "has <P> inside\nit"), (5005, "x<S>"), (5006, "<M>"), (5007, "no newline " * 900),
                (5008, "😀\n" * 4000), (5009, "long\nline\n" * 60_000), (5008, "😀\n" * 4000)]


def test_cuts_forms_and_round_trip(spark):
    made = list(corpus())
    frame = spark.createDataFrame([(1, d, t, "z", "i") for d, t in made], SCHEMA).repartition(3)
    for rate, spm_rate in ((100, 50), (40, 90)):
        got = middles.fill_in_middle(frame, rate=rate, spm_rate=spm_rate).withColumn(
            "restored", middles.restored(F.col("output"), F.col("form")))
        assert got.columns[:3] == ["doc_id", "text", "id"]
        rows = got.collect()
        assert len(rows) == len(made)
        for r in rows:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text, rate, spm_rate)
            assert r.restored == (r.text or "")
    assert middles.fill_in_middle(frame.limit(0)).count() == 0


def test_descent_finds_every_cut():
    rng = random.Random(4)
    for block in (1, 3, 8, 64):
        text = "".join(rng.choice("ab\nß日") for _ in range(200))
        data = np.frombuffer(text.encode(), np.uint8)
        blocks = middles.Blocks(data, block)
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert blocks.n == len(units)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert blocks.cut(k) == (len(head.encode()), len(head))
