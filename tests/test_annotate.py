"""Annotation and agreement: latest label, export, cursor wrap-around, kappa."""

import datetime as dt

from corpusforge.operators import agreement as G
from corpusforge.operators import annotate as A

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame(
        [(i, T0 + dt.timedelta(minutes=m), item, ann, s, t, a) for i, (m, item, ann, s, t, a) in enumerate(rows)],
        "event_id long, ts timestamp, item long, annotator int, sent int, tox int, sta int")


def test_latest_label_and_export(spark):
    ev = events(spark, [(0, 1, 0, 0, 0, 0), (5, 1, 0, 2, 1, 1), (6, 2, 0, 1, 1, None)])
    lab = {r.item: (r.sent, r.tox, r.sta) for r in A.latest_labels(ev).collect()}
    assert lab == {1: (2, 1, 1)}                      # re-label wins, incomplete ignored
    corpus = spark.createDataFrame([(1, "a"), (2, "b")], "item long, text string")
    ex = {r.item: r for r in A.export_annotations(corpus, A.latest_labels(ev), 0, "ann",
                                                  export_date="2024-02-01").collect()}
    assert ex[1].sentiment_label == "neutral" and ex[1].toxicity_numeric == "1" and ex[1].annotated == "true"
    assert ex[2].sentiment_label == "" and ex[2].annotated == "false"
    assert ex[1].annotation_date == ex[2].annotation_date == "2024-02-01"   # every row stamped
    assert ex[2].annotated_by == "ann"


def test_code_zero_exported(spark):
    ev = events(spark, [(0, 1, 0, 0, 0, 0)])
    corpus = spark.createDataFrame([(1, "a")], "item long, text string")
    r = A.export_annotations(corpus, A.latest_labels(ev), 0, "ann").first()
    assert (r.sentiment_numeric, r.toxicity_label, r.stance_label) == ("0", "not_toxic", "support")


def test_next_unannotated_wraps(spark):
    corpus = spark.createDataFrame([(i,) for i in range(5)], "item long")
    ev = events(spark, [(0, 1, 0, 0, 0, 0), (1, 4, 0, 0, 0, 0)])      # cursor at last item 4
    nxt = A.next_unannotated(corpus, A.latest_labels(ev), ev, [0]).first().next_item
    assert nxt == 0
    ev_all = events(spark, [(i, i, 0, 0, 0, 0) for i in range(5)])
    assert A.next_unannotated(corpus, A.latest_labels(ev_all), ev_all, [0]).first().next_item == -1


def test_distribution_zeros_and_pct(spark):
    ev = events(spark, [(0, 1, 0, 0, 1, 2), (1, 2, 0, 0, 1, 2), (2, 3, 0, 1, 1, 2)])
    d = {(r.task, r.code): (r.n, r.pct) for r in A.label_distribution(A.latest_labels(ev)).collect()}
    assert d[("sentiment", 0)] == (2, 67) and d[("sentiment", 1)] == (1, 33) and d[("sentiment", 2)] == (0, 0)
    assert len(d) == 9


def test_kappa_textbook_and_degenerate(spark):
    # 50 items: both yes 20, a yes b no 5, a no b yes 10, both no 15 -> kappa 0.4
    pairs = [(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15
    df = spark.createDataFrame([(i, a, b, "t") for i, (a, b) in enumerate(pairs)], "item long, a int, b int, task string")
    assert G.cohens_kappa(df).first().kappa == 0.4
    one = spark.createDataFrame([(i, 1, 1, "t") for i in range(5)], "item long, a int, b int, task string")
    assert G.cohens_kappa(one).first().kappa is None
    m = {r.a: (r.b_0, r.b_1) for r in G.agreement_matrix(df, (0, 1)).collect()}
    assert m == {0: (15, 10), 1: (5, 20)}


def test_milestone(spark):
    ev = events(spark, [(i, i, 0, 0, 0, 0) for i in range(5)] + [(10, 0, 0, 1, 1, 1)])
    r = A.milestone_reached(ev, 3).first()
    assert (r.item, r.n_labeled) == (2, 3)


def test_next_unannotated_random_vs_loop(spark):
    import random
    rnd = random.Random(9)
    corpus_items = sorted(rnd.sample(range(200), 60))
    corpus = spark.createDataFrame([(i,) for i in corpus_items], "item long")
    ev_rows, labeled = [], {}
    for a in range(40):
        k = rnd.choice([0, 1, 5, 30, 59, 60])
        chosen = set(rnd.sample(corpus_items, k))
        labeled[a] = chosen
        for i in sorted(chosen):
            ev_rows.append((len(ev_rows), i, a))
        cur = rnd.choice(corpus_items + list(range(0, 260, 7)))   # cursors also between / past corpus items
        ev_rows.append((len(ev_rows) + 10_000, cur, a))     # latest accepted submission = cursor
        ev_rows.append((len(ev_rows) + 90_000, rnd.choice(corpus_items), a))   # rejected: moves nothing
        labeled[a].add(cur)
    ev = spark.createDataFrame(
        [(eid, T0 + dt.timedelta(seconds=eid), item, a, 0 if eid < 90_000 else None, 0, 0) for eid, item, a in ev_rows],
        "event_id long, ts timestamp, item long, annotator int, sent int, tox int, sta int")
    got = {r.annotator: r.next_item for r in A.next_unannotated(corpus, A.latest_labels(ev), ev).collect()}
    for a in range(40):
        cur = [i for e, i, b in ev_rows if b == a and 10_000 <= e < 90_000][0]
        free = [i for i in corpus_items if i not in labeled[a]]
        after = [i for i in free if i > cur]
        expect = after[0] if after else (free[0] if free else -1)
        assert got[a] == expect, (a, cur, sorted(labeled[a])[:5])


def test_rejected_submission_and_foreign_labels(spark):
    """A rejected submission does not move the cursor; labels of items outside the corpus are no progress."""
    ev = spark.createDataFrame([(1, T0, 1, 0, 0, 0, 0), (2, T0 + dt.timedelta(seconds=1), 5, 0, None, 0, 0)],
                               "event_id long, ts timestamp, item long, annotator int, sent int, tox int, sta int")
    corpus = spark.createDataFrame([(i,) for i in range(1, 8)], "item long")
    assert A.next_unannotated(corpus, A.latest_labels(ev), ev).first().next_item == 2
    labels = spark.createDataFrame([(0, 1), (0, 5)], "annotator int, item long")
    got = A.annotation_progress(corpus.where("item <= 3"), labels).first()
    assert (got.done, got.total, got.remaining) == (1, 3, 2)


def test_kappa_takes_two_aggregates_over_the_pairs(spark):
    import contextlib
    import io

    from corpusforge.operators import agreement as G
    rows = [("t", i % 3, (i * i) % 3) for i in range(50)] + [("one", 1, 1)] * 4 + [("t", None, 1), ("t", 2, None)]
    pairs = spark.createDataFrame(rows, "task string, a int, b int")
    got = {r.task: r for r in G.cohens_kappa(pairs).collect()}
    both = [r[1:] for r in rows if r[0] == "t" and None not in r]
    n, agree = len(both), sum(a == b for a, b in both)
    pe = sum(sum(a == k for a, _ in both) * sum(b == k for _, b in both) for k in range(3)) / n ** 2
    assert (got["t"].n, got["t"].p_o, got["t"].p_e) == (n, round(agree / n, 6), round(pe, 6))
    assert abs(got["t"].kappa - (agree / n - pe) / (1 - pe)) < 1e-6
    assert got["one"].kappa is None and not got["one"].meets_target
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        G.cohens_kappa(pairs).explain()
    assert out.getvalue().count("Exchange hashpartitioning") == 2


def test_paired_ratings_need_both_raters(spark):
    from corpusforge.operators import agreement as G
    labels = spark.createDataFrame([(0, 1, 0, 1, 2), (1, 1, 0, 2, None), (0, 2, 1, 1, 1), (2, 2, 1, 1, 1)],
                                   "annotator int, item long, sent int, tox int, sta int")
    got = sorted((r["item"], r.task, r.a, r.b) for r in G.paired_ratings(labels).collect())
    assert got == [(1, "sentiment", 0, 0), (1, "toxicity", 1, 2)]
