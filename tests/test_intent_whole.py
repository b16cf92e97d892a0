"""Intent over more terms than the former limit of 5,000."""

import math

from waypost.operators.intent import class_features, class_terms, classify_intent
from waypost.functions.text import build_vocabulary

SCHEMA = ("page_id long, url string, site string, title string, h1 string, description string, "
          "body_text string")


def page(i, body):
    return i, f"u{i}", "source", "", "", "", body


def test_rare_terms_decide_clusters(spark):
    # 6,000 terms on twelve pages of one kind; two kinds live on rarer terms alone.
    common = [" ".join(f"a{k} a{k}" for k in range(6000)) for _ in range(12)]
    rows = [page(i, text) for i, text in enumerate(common)]
    rows += [page(20 + i, "zebra zinc zone") for i in range(6)] + [page(30 + i, "yacht yeast yodel") for i in range(4)]
    found = {r.page_id: r.cluster_label for r in classify_intent(
        spark.createDataFrame(rows, SCHEMA), n_clusters=3).collect()}
    assert [sorted({found[i] for i in found if low <= i < low + 12}) for low in (0,)] == [[0]]
    assert {found[20 + i] for i in range(6)} == {1} and {found[30 + i] for i in range(4)} == {2}


def test_features_equal_brute_force(spark):
    rows = [page(i, f"{'un ' * (i % 3)} deux{i % 4} trois{i % 2} trois{i % 2} seul{i}") for i in range(9)]
    rows.append(page(9, "alone"))
    terms = class_terms(spark.createDataFrame(rows, SCHEMA))
    got = {r.page_id: r.weights for r in class_features(
        terms, build_vocabulary(terms, 10, min_df=2, max_df=0.85)).collect()}
    texts = {i: body.split() for i, *_, body in rows}
    df = {t: sum(t in own for own in texts.values()) for own in texts.values() for t in own}
    listed = {t for t, n in df.items() if 2 <= n <= 8.5}
    assert len(got) == 10 and got[9] is None
    for i, own in texts.items():
        raw = sorted(own.count(t) * (math.log(11 / (1 + df[t])) + 1) for t in listed & set(own))
        norm = math.sqrt(sum(x * x for x in raw))
        mine = sorted(got[i] or [])
        assert len(mine) == len(raw) and all(abs(a - b / norm) < 1e-9 for a, b in zip(mine, raw))
