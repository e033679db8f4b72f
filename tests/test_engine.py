"""The ratings engine on hand-made fixtures, one for each decision, and its text forms."""

import os
import random
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnrank.operators import aggregates, evaluation, factorisation, itemsets, neighbours, similarity
from tarnrank.plans import catalog
from tarnrank.sources import readers, sinks

RATED = "user long, item long, rating double"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def brute_itemsets(baskets, support, max_k=9):
    sets, out = {}, {}
    for b, i in baskets:
        sets.setdefault(b, set()).add(i)
    for own in sets.values():
        for k in range(1, min(max_k, len(own)) + 1):
            for c in combinations(sorted(own), k):
                out[c] = out.get(c, 0) + 1
    return {c: n for c, n in out.items() if n >= support}


def test_means_and_order(spark):
    rated = spark.createDataFrame([(1, 2, 4.0), (2, 2, 2.0), (1, 1, 5.0), (1, 1, 1.0)], RATED)
    tags = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (9, "c")], "item long, tag string")
    assert rows_of(aggregates.mean_rating_per_item(rated)) == [(1, 3.0), (2, 3.0)]
    assert rows_of(aggregates.mean_rating_per_tag(rated, tags)) == [("b", 3.0), ("a", 3.0)]
    assert sorted(rows_of(aggregates.centred(rated, "user").select("item", "c"))) == [(1, pytest.approx(-7 / 3)), (1, pytest.approx(5 / 3)), (2, 0.0), (2, pytest.approx(2 / 3))]


def test_itemsets_equal_brute_force(spark):
    r = random.Random(5)
    baskets = [(b, r.randrange(9)) for b in range(60) for _ in range(r.randrange(1, 8))]
    frame = spark.createDataFrame(baskets + baskets[:20], "basket long, item long").repartition(3)
    for support in (6, 15, 40):
        want = brute_itemsets(baskets, support)
        assert {tuple(r["items"]): r["n"] for r in itemsets.frequent_itemsets(frame, support).collect()} == want
        assert {tuple(r["items"]): r["n"] for r in itemsets.frequent_by_growth(frame, support).collect()} == want
        assert {tuple(r["items"]): r["n"] for r in itemsets.frequent_two_pass(frame, support, block=7).collect()} == want
    assert {tuple(r["items"]) for r in itemsets.frequent_two_pass(frame, 6, 2).collect()} == {c for c in brute_itemsets(baskets, 6) if len(c) <= 2}


def test_dense_itemsets_by_bitmaps_shuffle_no_occurrences(spark, monkeypatch):
    r = random.Random(23)
    for names, total in (([-3, 4, 9, 12, 15, 20, 21, 30], 150), (list("abcdef"), 4_300)):
        rows = [(b, i) for b in range(total) for i in r.sample(names, r.randrange(2, 6))]
        baskets = spark.createDataFrame(rows + rows[:5], f"basket long, item {'long' if total == 150 else 'string'}")
        own = {b: set() for b in range(total)}
        for b, i in rows:
            own[b].add(i)
        for support, top in (((total // 20, None),) if total == 150 else ((total // 8, 3),)):
            want = {(c, n) for k in range(1, (top or 5) + 1) for c in combinations(names, k) if (n := sum(own[b] >= set(c) for b in own)) >= support}
            with monkeypatch.context() as m:
                m.setattr(itemsets, "level_candidates", None)  # before: occurrences are joined level by level
                got = itemsets.frequent_itemsets(baskets, support, top).collect()
            assert len(got) == len(want) and {(tuple(x["items"]), x["n"]) for x in got} == want and all(x["k"] == len(x["items"]) for x in got)


def test_levels_of_a_partition_are_pruned():
    rows = [{1, 2, 3}, {1, 2}, {1, 3}, {4}]
    assert itemsets.partition_levels(rows, 2) == [(1,), (2,), (3,), (1, 2), (1, 3)]
    assert itemsets.partition_candidates(rows, 3, 1, {(1, 2), (1, 3)}) == set()
    assert itemsets.partition_candidates(rows, 3, 1, {(1, 2), (1, 3), (2, 3)}) == {(1, 2, 3)}


def test_itemsets_without_a_frequent_item_and_at_the_support(spark):
    frame = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "basket long, item long")
    assert itemsets.frequent_itemsets(frame, 3).count() == 0
    assert rows_of(itemsets.frequent_itemsets(frame, 2)) == [([1], 1, 2)]
    assert rows_of(itemsets.frequent_two_pass(frame, 2)) == [([1], 1, 2)] and itemsets.frequent_two_pass(frame.limit(0), 1).count() == 0
    for miner in (itemsets.frequent_itemsets, itemsets.frequent_two_pass):
        with pytest.raises(ValueError):
            miner(frame, 0)


def test_orientation(spark):
    rated = spark.createDataFrame([(1, 2, 4.0)], RATED)
    assert rows_of(readers.orient(rated, 1)) == [(1, 2)] and rows_of(readers.orient(rated, 2)) == [(2, 1)]
    with pytest.raises(ValueError):
        readers.orient(rated, 3)


def test_signatures_equal_the_definition(spark):
    r = random.Random(2)
    sets = [(i, e) for i in range(12) for e in r.sample(range(900), r.randrange(1, 60))] + [(50, 0)]
    rank = {e: k for k, e in enumerate(sorted({e for _, e in sets}))}
    p = similarity.LshParams()
    frame = spark.createDataFrame(sets, "id long, element long")
    got = {r["id"]: r["signature"] for r in similarity.signatures(frame).collect()}
    for i in {i for i, _ in sets}:
        own = [rank[e] for k, e in sets if k == i]
        assert got[i] == [min((3 * u + j) % 671 for u in own) for j in range(400)]
    band = {(r["id"], r["band"]): r["bucket"] for r in similarity.buckets(similarity.signatures(frame)).collect()}
    assert all(band[i, b] == sum(w * x for w, x in zip(p.weights, got[i][10 * b : 10 * b + 10])) % 9066 for i in got for b in range(40))
    wide = similarity.LshParams(hashes=700, bands=70)
    assert len(similarity.signatures(frame, wide).first()["signature"]) == 700
    with pytest.raises(ValueError):
        similarity.LshParams(hashes=401)


def test_similar_pairs_exact_and_hashed(spark):
    r = random.Random(8)
    base = [set(r.sample(range(200), 20)) for _ in range(15)]
    sets = base + [set(list(s)[: r.randrange(8, 20)]) | set(r.sample(range(200), r.randrange(4))) for s in base] + [{1, 2}, {1, 2, 3, 4}]
    frame = spark.createDataFrame([(i, e) for i, s in enumerate(sets) for e in s], "id long, element long")
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(range(len(sets)), 2)}
    for threshold in (0.5, 0.3, 1.0):
        got = {(r["a"], r["b"]): r["sim"] for r in similarity.jaccard_exact(frame, threshold).collect()}
        assert got == pytest.approx({k: v for k, v in want.items() if v >= threshold})
    assert want[30, 31] == 0.5
    hashed = {(r["a"], r["b"]) for r in similarity.jaccard_lsh(frame).collect()}
    assert hashed <= {k for k, v in want.items() if v >= 0.5} and len(hashed) >= 0.9 * sum(v >= 0.5 for v in want.values())


def dense_user_prediction(train, user, item, k=5, skip=1):
    users = sorted({u for u, _, _ in train})
    mean = {u: np.mean([r for x, _, r in train if x == u]) for u in users}
    vector = {u: {i: r - mean[u] for x, i, r in train if x == u} for u in users}
    norm = {u: np.sqrt(sum(c * c for c in v.values())) for u, v in vector.items()}

    def sim(a, b):
        dot = sum(c * vector[b].get(i, 0) for i, c in vector[a].items())
        return dot / (norm[a] * norm[b]) if norm[a] * norm[b] else 0.0

    near = sorted(((-round(sim(user, n), 12), n, sim(user, n)) for n in users if n != user and item in vector[n]))[skip : skip + k]
    below = sum(s for *_, s in near)
    return mean[user] if not near or below == 0 else max(0, min(5, mean[user] + sum(s * vector[n][item] for _, n, s in near) / below))


@pytest.mark.parametrize("skip", [0, 1])
def test_user_based_prediction_equals_dense_evaluation(spark, skip):
    r = random.Random(7)
    rated = [(u, i, float(r.randrange(1, 11)) / 2) for u in range(14) for i in range(9) if r.random() < 0.7]
    rated += [(20, i, 3.0) for i in range(9)] + [(21, 0, 2.0), (21, 77, 4.0)]
    test = [x for k, x in enumerate(rated) if k % 6 == 0] + [(99, 1, 3.0), (1, 99, 2.0)]
    pairs = spark.createDataFrame([x[:2] for x in test] + [(500, 500)], "user long, item long")
    train, held = neighbours.split(spark.createDataFrame(rated + test[-2:], RATED), pairs)
    left = [x for x in rated if x[:2] not in {t[:2] for t in test}]
    assert train.count() == len(left) and held.count() == len(test)
    got = {(r["user"], r["item"]): r["prediction"] for r in neighbours.predict_user_based(train, held, skip_top=skip).collect()}
    users, items = {x[0] for x in left}, {x[1] for x in left}
    want = {(u, i): dense_user_prediction(left, u, i, skip=skip) for u, i, _ in test if u in users and i in items}
    assert got == pytest.approx(want)


def test_cosines_of_listed_pairs_and_split_items(spark):
    r = random.Random(9)
    rated = spark.createDataFrame([(u, i, float(r.randrange(6))) for u in range(25) for i in r.sample(range(12), 6)], "user long, item long, rating double")
    close = lambda df: {(a, b): pytest.approx(sim, abs=1e-12) for a, b, sim in rows_of(df)}
    every = close(neighbours.user_cosine(rated))
    asked = spark.createDataFrame([(a, b) for a, b in every if (a + b) % 3], "a long, b long")
    assert close(neighbours.user_cosine(rated, asked)) == {k: v for k, v in every.items() if sum(k) % 3}
    split = neighbours.meetings(neighbours.directions(rated), "item", "user", "c", block=4)
    assert close(split.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")))) == every
    test = rated.where("user < 4")
    assert sorted(rows_of(neighbours.user_candidates(rated, test).select("user", "item", "neighbour"))) == sorted(rows_of(neighbours.user_candidates(rated, test, neighbours.user_cosine(rated)).select("user", "item", "neighbour")))
    assert neighbours.pairs_are_fewer(rated, test.limit(0)) and not neighbours.pairs_are_fewer(rated, rated)


def test_a_sum_that_cancels_is_zero(spark):
    noise = spark.createDataFrame([(0.3 - 0.1 * 3, ), (1e-18,), (-7.2e-18,), (2e-12,), (-0.25,)], "x double")
    assert [x for x, in rows_of(noise.select(neighbours.settled(F.col("x"))))] == [0.0, 0.0, 0.0, 2e-12, -0.25]
    test = spark.createDataFrame([(1, 1, 4.0)], RATED)
    means = spark.createDataFrame([(1, 3.0)], "user long, mean double")
    chosen = spark.createDataFrame([(1, 1, 5, 0.1, 2.0), (1, 1, 6, 0.2, -1.0), (1, 1, 7, -0.3, 0.5)], "user long, item long, neighbour long, sim double, c double")
    assert 0.1 + 0.2 - 0.3 != 0
    assert rows_of(neighbours._combine(test, chosen.coalesce(1), means, "user")) == [(1, 1, 4.0, 3.0)]


def test_errors_do_not_hold_what_cancels(spark, monkeypatch):
    # users 1 and 2 have centred rows (.1, .2, -.3) and (c, c, c'), whose products cancel but for noise
    rated = [(1, 0, 2.1), (1, 1, 2.2), (1, 2, 1.7), (2, 0, 3.7), (2, 1, 3.7), (2, 2, 3.7 + 0.0), (3, 0, 1.0), (3, 3, 2.0), (2, 9, 1.0), (3, 9, 4.5), (4, 9, 5.0), (4, 8, 0.5)]
    train = spark.createDataFrame(rated, RATED)
    held = spark.createDataFrame([(1, 9, 2.0)], RATED)
    sims = {(a, b): sim for a, b, sim in rows_of(neighbours.user_cosine(train))}
    assert sims[1, 2] == 0.0
    assert rows_of(neighbours.predict_user_based(train, held, k=1, skip_top=0)) == [(1, 9, 2.0, pytest.approx(2.0))]
    assert rows_of(evaluation.error_histogram(neighbours.predict_user_based(train, held, k=1, skip_top=0)).where("n > 0")) == [(0, 1)]


def test_item_similarities_equal_the_join_by_prefixes(spark):
    r = random.Random(11)
    rated = spark.createDataFrame([(u, i, 1.0) for u in range(30) for i in r.sample(range(15), r.randrange(1, 7))], "user long, item long, rating double")
    exact = rows_of(similarity.jaccard_exact(rated.select(F.col("item").alias("id"), F.col("user").alias("element")), 0.2))
    assert sorted(rows_of(neighbours.item_similarities(rated, rated, 0.2))) == sorted(exact) and exact
    assert sorted(rows_of(neighbours.item_similarities(rated, rated.where("item = 3"), 0.2))) == sorted(x for x in exact if 3 in x[:2])


def test_item_similarities_by_passes_and_blocks(spark):
    r = random.Random(12)
    rated = spark.createDataFrame([(u, i, 1.0) for u in range(40) for i in r.sample(range(20), r.randrange(1, 12))] + [(0, 1, 2.0), (0, 1, 3.0)], RATED)
    exact = rows_of(similarity.jaccard_exact(rated.select(F.col("item").alias("id"), F.col("user").alias("element")).distinct(), 0.2))
    for test in (rated, rated.where("item % 5 = 2")):
        asked = {x["item"] for x in test.select("item").distinct().collect()}
        want = sorted(x for x in exact if asked & {*x[:2]})
        assert sorted(rows_of(neighbours.item_similarities(rated, test, 0.2, block=4, per_pass=150))) == want and want
        assert sorted(rows_of(neighbours.item_similarities(rated, test, 0.2, per_pass=400))) == want


def test_item_candidates_by_either_way(spark, monkeypatch):
    r = random.Random(15)
    rated = spark.createDataFrame([(u, i, float(r.randrange(6))) for u in range(30) for i in r.sample(range(15), r.randrange(2, 9))], RATED)
    test = rated.where("(user + item) % 4 = 0")
    sims = neighbours.item_similarities(rated, test, 0.1)
    found = []
    for fewer in (True, False):
        monkeypatch.setattr(neighbours, "similar_are_fewer", lambda *_, fewer=fewer: fewer)
        found.append(sorted(rows_of(neighbours.item_candidates(rated, test, sims))))
    assert found[0] == found[1] != []


def test_a_stored_table_leaves_no_shuffle_files(spark):
    roots = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in roots for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before = files()
    stored = similarity.durable(spark.range(1_000).groupBy((F.col("id") % 7).alias("x")).count())
    until = time.monotonic() + 5
    while files() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not files() - before and stored.count() == 7


def test_large_buckets_are_cut_and_hashes_independent(spark):
    r = random.Random(13)
    rows = [(i, b, r.randrange(3)) for i in range(60) for b in range(2)]
    frame = spark.createDataFrame(rows, "id long, band int, bucket long")
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1:] == y[1:]}
    assert set(rows_of(similarity.candidates(frame, block=5))) == set(rows_of(similarity.candidates(frame))) == want
    base = [[f"w{r.randrange(4_000)}" for _ in range(50)] for _ in range(40)]
    sets = [(i, w) for i, own in enumerate(base + [x[:48] + ["new", "other"] for x in base[:20]]) for w in set(own)]
    frame = spark.createDataFrame(sets, "id long, element string")
    params = similarity.LshParams.sized()
    assert sorted(rows_of(similarity.jaccard_lsh(frame, 0.8, params))) == sorted(rows_of(similarity.jaccard_exact(frame, 0.8)))
    assert similarity.candidates(similarity.buckets(similarity.signatures(frame, params), params)).count() < 100


def test_hashed_pairs_are_told_apart_and_checked_in_passes(spark):
    r = random.Random(17)
    base = [set(r.sample(range(900), r.randrange(5, 160))) for _ in range(12)]
    sets = base + [set(list(s)[: len(s) - len(s) // 5]) | set(r.sample(range(900), 2)) for s in base for _ in range(3)]
    frame = spark.createDataFrame([(i, e) for i, s in enumerate(sets) for e in s], "id long, element long").repartition(3)
    for params in (similarity.LshParams(), similarity.LshParams.sized()):
        signed = similarity.signatures(frame, params)
        want = sorted(rows_of(similarity.candidates(similarity.buckets(signed, params))))
        assert sorted(rows_of(similarity.banded_candidates(signed, params))) == sorted(rows_of(similarity.banded_candidates(signed, params, block=7))) == want
        rows = similarity.durable(similarity.vectors(signed, params)).join(similarity.sketches(similarity.hashed(frame)), "id")
        rows = rows.select("id", "buckets", similarity.packed(F.col("buckets"), params).alias("v"), "n", "sketch")
        whole = sorted(rows_of(similarity.verified(frame, spark.createDataFrame(want, "a long, b long"), 0.5, per_pass=1)))
        sims = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in want}
        assert whole == sorted((*k, v) for k, v in sims.items() if v >= 0.5) != []
        for block in (5_000, 7):
            near = [x for k in range(0, 40, 20) for x in rows_of(similarity.near_in_bands(rows, params, range(k, k + 20), 0.5, block))]
            assert len(near) == len(set(near)) and {x[:2] for x in whole} <= set(near) <= set(want)
        assert sorted(rows_of(similarity.jaccard_lsh(frame, 0.5, params))) == whole


def test_exact_pairs_are_not_stored_before_they_are_told_apart(spark, monkeypatch):
    r = random.Random(19)
    alike = [set(range(10, 22))] * 30 + [set(range(10, 23))] * 3
    sets = alike + [{1} | set(r.sample(range(100, 400), 20)) for _ in range(40)]
    frame = spark.createDataFrame([(i, e) for i, s in enumerate(sets) for e in s] + [(None, 1), (900, None)], "id long, element long").repartition(3)
    asked, check = [], similarity.verified
    monkeypatch.setattr(similarity, "verified", lambda sets, pairs, *more, **named: asked.append(pairs.count()) or check(sets, pairs, *more, **named))
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(range(len(sets)), 2)}
    got = rows_of(similarity.jaccard_exact(frame))
    assert len(got) == len(set(got)) and {x[:2]: x[2] for x in got} == pytest.approx({k: v for k, v in want.items() if v >= 0.5})
    assert asked[0] < 20  # before: each pair of the equal sets, and those of the rest that share an element of their prefixes
    pieces = similarity.classes(spark.createDataFrame([(i, i % 2) for i in range(25)], "id long, k long"), "k")
    monkeypatch.setattr(similarity, "pieces", lambda same, cut=similarity.pieces: cut(same, 4))
    assert sorted(rows_of(similarity.among(pieces))) == [(a, b) for a, b in combinations(range(25), 2) if a % 2 == b % 2]
    met = sorted(rows_of(similarity.members(spark.createDataFrame([(0, 1), (0, 99)], "a long, b long"), pieces)))
    assert met == sorted([(min(a, b), max(a, b)) for a in range(0, 25, 2) for b in range(1, 25, 2)] + [(a, 99) for a in range(0, 25, 2)])


def test_prefixes_meet_in_passes_that_send_a_part_of_the_sketches(spark, monkeypatch):
    r = random.Random(23)
    base = [set(r.sample(range(700), r.randrange(1, 200))) for _ in range(30)]
    sets = base + [set(list(s)[: len(s) - len(s) // 4]) | set(r.sample(range(700), 2)) for s in base]
    frame = spark.createDataFrame([(i, e) for i, s in enumerate(sets) for e in s], "id long, element long").repartition(3)
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    stored, store = [], similarity.durable
    monkeypatch.setattr(similarity, "durable", lambda df: stored.append(df.columns) or store(df))
    monkeypatch.setattr(similarity, "PER_ROW", 500)
    whole = similarity.hashed(frame)
    found = rows_of(similarity.near_by_prefixes(whole, 0.5, per_task=300, at_once=3))
    assert len(found) == len(set(found)) and want <= set(found)
    assert stored.count(["a", "b"]) > 2  # before: one shuffle of every set and sketch to every task
    assert set(found) == set(rows_of(similarity.near_by_prefixes(whole, 0.5)))


def test_candidates_are_made_once_without_a_shuffle_of_pairs(spark, monkeypatch):
    r = random.Random(29)
    base = [set(r.sample(range(900), r.randrange(3, 120))) for _ in range(20)] + [set(range(40))] * 30
    sets = base + [set(list(s)[: len(s) - 1]) for s in base[:20]]
    frame = spark.createDataFrame([(i, e) for i, s in enumerate(sets) for e in s], "id long, element long").repartition(3)
    signed = similarity.signatures(frame)
    want = sorted(rows_of(similarity.candidates(similarity.buckets(signed))))
    for more in ({}, {"block": 7, "per_task": 11}):
        found = similarity.banded_candidates(signed, **more)
        assert sorted(rows_of(found)) == want and len(want) > 435
    monkeypatch.setattr(catalog.views, "document_tokens", lambda spark, sf_dir: frame)
    plan = catalog.lsh_candidates(spark, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan  # before: pairs were made distinct by a shuffle of them all
    v, zero = np.array([[5, 1], [5, 2], [6, 3], [7, 3]] * 10), np.zeros(40, np.int64)
    for cells in (1, 50, 4_000_000):
        pairs = [(min(x), max(x)) for i, j in similarity.shared_first(v, zero, zero, zero, zero, cells) for x in zip(i.tolist(), j.tolist())]
        assert sorted(pairs) == [(i, j) for i, j in combinations(range(40), 2) if (v[i] != v[j]).all()]


def test_neighbour_ranks_drop_the_nearest_and_break_ties(spark):
    rows = [(1, 1, n, s, 0.0) for n, s in [(5, 0.9), (4, 0.9), (3, 0.5), (2, -0.1), (9, 0.0), (8, 0.0), (7, 0.0), (6, 0.4)]] + [(2, 1, 3, 0.7, 0.0)]
    found = neighbours.nearest(spark.createDataFrame(rows, "user long, item long, neighbour long, sim double, c double"))
    assert sorted((r["rank"], r["neighbour"]) for r in found.collect()) == [(2, 5), (3, 3), (4, 6), (5, 7), (6, 8)]


def test_item_based_prediction(spark):
    train = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (1, 3, 5.0), (2, 1, 2.0), (2, 2, 3.0), (2, 4, 4.0), (3, 4, 2.0), (3, 3, 1.0)], RATED)
    test = spark.createDataFrame([(1, 4, 3.0), (3, 1, 2.0)], RATED)
    sims = spark.createDataFrame([(1, 4, 0.9), (2, 4, 0.8), (3, 4, 0.5)], "a long, b long, sim double")
    got = {(r["user"], r["item"]): r["prediction"] for r in neighbours.predict_item_based(train, test, sims).collect()}
    assert got[1, 4] == pytest.approx(3 + (0.8 * (2 - 2.5) + 0.5 * (5 - 3)) / 1.3)
    assert got[3, 1] == 3.0  # one neighbour, which is passed over: the item's mean


def test_evaluation(spark):
    rows = spark.createDataFrame([(0.0, e) for e in (0.0, 1.0, 2.5, 3.0, 4.0, 5.0)], "rating double, prediction double")
    assert rows_of(evaluation.error_histogram(rows).orderBy("bucket")) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 2)]
    total = evaluation.errors(rows).first()
    assert total["mse"] == pytest.approx(57.25 / 6) and total["rmse"] == pytest.approx((57.25 / 6) ** 0.5)
    assert evaluation.report(rows)[4] == ">=4: 2"
    assert rows_of(evaluation.error_histogram(rows.limit(0)).select(F.sum("n"))) == [(0,)]


def test_factorisation_is_seeded_and_clamped(spark):
    r = np.random.default_rng(0)
    u, v = r.uniform(0.5, 1.5, (20, 2)), r.uniform(0.5, 1.5, (15, 2))
    rated = [(i, j, float(u[i] @ v[j])) for i in range(20) for j in range(15)]
    train = spark.createDataFrame([x for x in rated if (x[0] + x[1]) % 5], RATED)
    test = spark.createDataFrame([x for x in rated if (x[0] + x[1]) % 5 == 0] + [(99, 1, 1.0)], RATED)
    first = factorisation.predict(factorisation.fit(train), test)
    assert first.count() == 60 and evaluation.errors(first).first()["rmse"] < 0.5
    again = {(r["user"], r["item"]): r["prediction"] for r in factorisation.predict(factorisation.fit(train), test).collect()}
    assert again == pytest.approx({(r["user"], r["item"]): r["prediction"] for r in first.collect()})
    assert all(0 <= p <= 5 for p in again.values())


def test_csv_sources(spark, tmp_path):
    path = f"{tmp_path}/r.csv"
    with open(path, "w") as f:
        f.write("userId,movieId,rating,timestamp\n1,2,4.5,7\nx,2,1.0,7\n3,4,2.0,8\n")
    assert sorted(rows_of(readers.read_ratings(spark, path, "DROPMALFORMED"))) == [(1, 2, 4.5, 7), (3, 4, 2.0, 8)]
    with pytest.raises(Exception):
        readers.read_ratings(spark, path).collect()
    assert readers.read_csv(spark, path, mode="PERMISSIVE").columns == ["userId", "movieId", "rating", "timestamp"]
    with open(f"{tmp_path}/t.csv", "w") as f:
        f.write('userId,movieId,tag,timestamp\n1,2,"a, b",7\n1,3,"say ""hi""",7\n')
    assert sorted(rows_of(readers.read_tags(spark, f"{tmp_path}/t.csv", escape='"'))) == [(1, 2, "a, b"), (1, 3, 'say "hi"')]
    with open(f"{tmp_path}/p.csv", "w") as f:
        f.write("userId,movieId\n1,2\n1,2\n3,4\n")
    assert sorted(rows_of(readers.read_test_pairs(spark, f"{tmp_path}/p.csv"))) == [(1, 2), (3, 4)]
    lines = readers.without_header(spark.read.text(f"{tmp_path}/p.csv"))
    assert sorted(r[0] for r in lines.collect()) == ["1,2", "1,2", "3,4"]
    rated = spark.createDataFrame([(1, 2, 4.0), (1, 2, 2.0)], RATED)
    assert rows_of(readers.one_rating(rated)) == [(1, 2, 3.0)]


def test_text_sinks(spark, tmp_path):
    sims = spark.createDataFrame([(3, 4, 0.5), (1, 10, 1.0), (1, 2, 0.75)], "a long, b long, sim double")
    path = f"{tmp_path}/sims.txt"
    for _ in range(2):  # overwrites
        sinks.write_triples(sims, path)
    assert open(path).read() == "1, 2, 0.75\n1, 10, 1.0\n3, 4, 0.5\n"
    assert len(rows_of(readers.read_similarities(spark, path))) == 6
    found = spark.createDataFrame([([10], 1, 3), ([2], 1, 3), ([2, 10], 2, 3)], "items array<long>, k int, n long")
    sinks.write_itemsets(found, f"{tmp_path}/sets.txt")
    assert open(f"{tmp_path}/sets.txt").read() == "(2), (10)\n\n(2, 10)\n\n"
    sinks.write_csv_file(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "tag string, rating_avg double"), f"{tmp_path}/o.csv", F.desc("tag"))
    assert open(f"{tmp_path}/o.csv").read() == "tag,rating_avg\nb,2.0\na,1.0\n"
    assert [f for f in os.listdir(tmp_path) if "tmp-" in f] == []
    assert [f for f in os.listdir(tmp_path) if ".old-" in f] == []
    assert sinks.output_name("app", "/x/Small2.csv", 1, 3, "out") == "out/app_Small2.case1-3.txt"


def test_a_move_that_fails_keeps_the_output_and_the_older_file(spark, tmp_path):
    frame = spark.createDataFrame([("new",)], "line string")
    sinks.write_text_file(frame, f"{tmp_path}/missing/folder/o.txt", "line")  # the parent is made
    assert open(f"{tmp_path}/missing/folder/o.txt").read() == "new\n"
    blocked = tmp_path / "file"
    blocked.write_text("x")
    with pytest.raises(Exception):
        sinks.write_text_file(frame, f"{blocked}/o.txt", "line")
    assert blocked.read_text() == "x"
    path = tmp_path / "old.txt"
    path.write_text("old")
    frame.coalesce(1).write.text(f"{tmp_path}/parts")
    part = next(f for f in os.listdir(f"{tmp_path}/parts") if f.startswith("part-"))
    os.makedirs(f"{tmp_path}/parts2")
    os.symlink("/nonexistent", f"{tmp_path}/parts2/{part}")  # a source that cannot be moved
    with pytest.raises(Exception):
        sinks._promote(spark, f"{tmp_path}/parts2", str(path))
    assert path.read_text() == "old" and os.path.lexists(f"{tmp_path}/parts2/{part}")


def test_many_rows_are_written_as_a_folder_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SINGLE", 3)
    path = f"{tmp_path}/many"
    sinks.write_text_file(spark.createDataFrame([(f"{i:02}",) for i in range(20)], "line string").repartition(4), path, "line")
    lines = [x for f in sorted(os.listdir(path)) if f.startswith("part-") for x in open(f"{path}/{f}").read().split()]
    assert lines == [f"{i:02}" for i in range(20)]


def test_programs(spark, tmp_path, capsys):
    from tarnrank import __main__ as programs

    r = random.Random(3)
    rated = [(u, i, r.randrange(1, 6), 0) for u in range(12) for i in r.sample(range(8), 5)]
    (tmp_path / "ratings.csv").write_text("userId,movieId,rating,timestamp\n" + "".join(f"{u},{i},{x}.0,{t}\n" for u, i, x, t in rated))
    (tmp_path / "tags.csv").write_text("userId,movieId,tag,timestamp\n" + "".join(f"1,{i},t{i % 2},0\n" for i in range(8)))
    pairs = [x[:2] for x in rated if x[0] % 4 == 0 and x[1] % 2] + [(99, 1)]
    (tmp_path / "pairs.csv").write_text("userId,movieId\n" + "".join(f"{u},{i}\n" for u, i in pairs))
    at = lambda name: str(tmp_path / name)
    run = lambda *a: (programs.main([str(x) for x in a]), capsys.readouterr().out)[1]
    assert "Time: " in run("mean-by-item", at("ratings.csv"), at("items.csv"))
    lines = open(at("items.csv")).read().split()
    assert lines[0] == "item,rating_avg" and len(lines) == 9
    run("mean-by-tag", at("ratings.csv"), at("tags.csv"), at("tagged.csv"))
    assert [x.split(",")[0] for x in open(at("tagged.csv")).read().split()] == ["tag", "t1", "t0"]
    for case, method in ((1, "levels"), (2, "two-pass")):
        run("itemsets", case, at("ratings.csv"), 4, "--folder", at("out"), "--method", method)
        want = brute_itemsets([(x[0], x[1]) if case == 1 else (x[1], x[0]) for x in rated], 4)
        first = open(f"{at('out')}/itemsets_ratings.case{case}-4.txt").read().split("\n")[0]
        assert first == ", ".join(f"({c[0]})" for c in sorted(want) if len(c) == 1)
    assert "|sim" in run("--preview", 2, "similar-items", at("ratings.csv"), at("similar.txt"), "--threshold", 0.3, "--method", "exact")
    for program, extra in (("predict-users", []), ("predict-items", [at("similar.txt")]), ("predict-factors", [])):
        out = run(program, at("ratings.csv"), at("pairs.csv"), *extra, at(f"{program}.txt"))
        assert "RMSE: " in out and "Dropped test pairs: 1" in out and len(open(at(f"{program}.txt")).read().split("\n")) == len(pairs)
    with pytest.raises(SystemExit):
        programs.main(["itemsets", "3", "x", "1"])


@pytest.fixture(scope="module")
def brands_dir(spark, tmp_path_factory):
    """Two orders, one of three brands and one of two of them: the support is 1."""
    folder = str(tmp_path_factory.mktemp("brands"))
    spark.createDataFrame([(i, f"Brand#{i}") for i in range(1, 4)], "p_partkey long, p_brand string").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(1, i) for i in range(1, 4)] + [(2, i) for i in range(1, 3)], "l_orderkey long, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_itemset_report_has_every_level(spark, brands_dir):
    got = dict(rows_of(catalog.itemset_report(spark, brands_dir)))
    assert got == {k: ", ".join(f"({', '.join(map(str, c))})" for c in combinations(range(1, 4), k)) for k in range(1, 4)}


def test_case1_and_growth_are_not_cut(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"Brand#{i}") for i in range(1, 6)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, i) for i in range(1, 6)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = sorted((",".join(map(str, c)), k, 1) for k in range(1, 6) for c in combinations(range(1, 6), k))
    assert sorted(rows_of(catalog.frequent_by_growth(spark, str(tmp_path)))) == want
    limits, growth = [], itemsets.frequent_by_growth
    monkeypatch.setattr(itemsets, "frequent_itemsets", lambda baskets, support, max_k=None: limits.append(max_k) or growth(baskets, support))
    assert sorted(rows_of(catalog.frequent_itemsets_case1(spark, str(tmp_path)))) == want and limits == [None]


def test_catalog_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"predict_als", "rmse_als"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
