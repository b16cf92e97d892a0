import itertools

import pytest
from pyspark.sql import functions as F

from waypost.functions.scoring import (
    INTENT_LABELS, adjusted_confidence, confidence_tier, intent_conflict,
)

T, C, I, N, D = "transactionnelle", "commerciale", "informationnelle", "navigationnelle", "divers"
CONFLICTS = {(T, I), (T, D), (C, I), (C, D), (I, T)}


@pytest.mark.parametrize("kind, score, tier", [
    ("exact", 100.0, "high"), ("cosine", 0.70, "high"), ("cosine", 0.69999, "medium"),
    ("cosine", 0.40, "medium"), ("cosine", 0.39999, "low"), ("fuzzy", 85.0, "high"),
    ("fuzzy", 84.999, "medium"), ("fuzzy", 70.0, "medium"), ("fuzzy", 69.9, "low"),
    ("hierarchical_L1", 40.0, "medium"), ("hierarchical_L2", 25.0, "low"),
    ("hierarchical_L3", 15.0, "low"), ("hierarchical_root", 5.0, "low"), ("fallback", 0.0, "low"),
])
def test_tiers(spark, kind, score, tier):
    df = spark.range(1).select(confidence_tier(F.lit(kind), F.lit(score)).alias("t"))
    assert df.first().t == tier


def test_every_label_pair_and_tier(spark):
    labels = [*INTENT_LABELS, "", None]
    rows = list(itertools.product(["high", "medium", "low"], labels, labels))
    df = spark.createDataFrame(rows, "tier string, s string, t string")
    for r in df.select("*", adjusted_confidence(F.col("tier"), F.col("s"), F.col("t")).alias("out"),
                       intent_conflict(F.col("s"), F.col("t")).alias("mismatch")).collect():
        raised = {"low": "medium", "medium": "high", "high": "high"}
        if not r.s or not r.t:
            want = (r.tier, False)
        elif (r.s, r.t) in CONFLICTS:
            want = ("low", True)
        elif r.s == r.t and r.s != D:
            want = (raised[r.tier], False)
        else:
            want = (r.tier, False)
        assert (r.out, r.mismatch) == want, r
