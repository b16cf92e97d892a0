from waypost.functions.scoring import INTENT_LABELS
from waypost.operators.intent import classify_intent
from waypost.plans.migration import ensure_classified

SCHEMA = ("page_id long, url string, site string, title string, h1 string, description string, "
          "body_text string")
TOPICS = ["robot cuiseur soupe recette", "livraison panier paiement commande",
          "guide conseil article tutoriel"]


def corpus(spark, n=60):
    rows = [(i, f"u{i}", "source" if i % 2 else "target", "", "", "",
             "" if i % 10 == 9 else f"{TOPICS[i % 3]} {TOPICS[i % 3]} le la {i}") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_page_with_text_gets_a_stable_label(spark):
    pages = corpus(spark)
    first = sorted(tuple(r) for r in classify_intent(pages, n_clusters=3).collect())
    again = sorted(tuple(r) for r in classify_intent(pages.repartition(3), n_clusters=3).collect())
    assert first == again
    assert [r[0] for r in first] == [i for i in range(60) if i % 10 != 9]
    assert {r[1] for r in first} == {0, 1, 2}
    assert all(r[2] == INTENT_LABELS[r[1] % 5] for r in first)
    topics = {}
    for page_id, cluster, _ in first:
        topics.setdefault(page_id % 3, set()).add(cluster)
    assert all(len(clusters) == 1 for clusters in topics.values())


def test_site_and_small_inputs(spark):
    pages = corpus(spark)
    assert {r.page_id % 2 for r in classify_intent(pages, n_clusters=2, site="source").collect()} == {1}
    assert classify_intent(pages.limit(2)).count() == 0
    assert classify_intent(pages, n_clusters=1).select("cluster_label").distinct().count() == 1


def test_existing_labels_are_kept(spark):
    pages = corpus(spark)
    labels = spark.createDataFrame([(i, 0, "divers") for i in range(40)],
                                   "page_id long, cluster_label int, intention string")
    assert ensure_classified(pages, labels) is labels
    assert ensure_classified(pages, labels.limit(3), n_clusters=2).count() == 54
