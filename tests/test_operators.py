import math

import pytest
from pyspark.sql import functions as F

from siftline.operators import evaluation as E
from siftline.operators import features as X
from siftline.operators import fusion as U
from siftline.operators import geo as G
from siftline.operators import ranker
from siftline.operators import retrieval as R
from siftline.operators import sampling as S


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bm25_by_hand(spark):
    items = frame(spark, [(1, ["a", "a", "b"]), (2, ["b"]), (3, [])], "item_id long, terms array<string>")
    queries = frame(spark, [(7, ["a", "a", "zz"])], "query_id long, terms array<string>")
    row = R.bm25(items, queries).collect()
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    want = 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / (4 / 3))) * idf
    assert [(r.query_id, r.item_id) for r in row] == [(7, 1)] and row[0].score == pytest.approx(want)


def test_bm25f_with_one_field_has_its_own_saturation(spark):
    items = frame(spark, [(1, ["a", "a"]), (2, ["b"])], "item_id long, title array<string>")
    queries = frame(spark, [(7, ["a"])], "query_id long, terms array<string>")
    got = R.bm25f(items, queries, {"title": 2.0}, {"title": 0.9}).first()
    t = 2.0 * 2 / (1 - 0.9 + 0.9 * 2 / 1.5)
    assert got.score == pytest.approx(t * 2.2 / (t + 1.2) * math.log(1 + 1.5 / 1.5))


def test_ties_go_by_id_and_share_an_expected_rank(spark):
    scored = frame(spark, [(1, i, 0.5) for i in (3, 1, 2)], "query_id long, item_id long, score double")
    assert [(r.item_id, r["rank"]) for r in R.top_k(scored, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert {r.expected_rank for r in R.expected_rank(scored).collect()} == {2.0}


def test_nearest_is_exact_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    vec = lambda i: [math.cos(i), math.sin(i)]
    items = frame(spark, [(i, vec(i)) for i in range(50)], "item_id long, vector array<double>").repartition(5)
    queries = frame(spark, [(100 + i, vec(i + 0.3)) for i in range(8)], "query_id long, vector array<double>")
    got = {(r.query_id, r["rank"]): r.item_id for r in R.nearest(items, queries, 3).collect()}
    for q in range(8):
        best = sorted(range(50), key=lambda i: (-round(sum(a * b for a, b in zip(vec(i), vec(q + 0.3))), 6), i))[:3]
        assert [got[100 + q, k] for k in (1, 2, 3)] == best
    assert R.nearest(items, queries.limit(0), 3).count() == 0


def test_fill_gives_unmatched_items_by_id(spark):
    items = frame(spark, [(i,) for i in range(5)], "item_id long")
    channel = frame(spark, [(1, 3, 2.0, 1)], "query_id long, item_id long, score double, rank int")
    got = R.fill(channel, frame(spark, [(1,), (2,)], "query_id long"), items, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.item_id) for r in got] == [(1, 3), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]


def test_penalty_is_met_by_any_value(spark):
    pairs = frame(spark, [(1, 5), (1, 6)], "query_id long, item_id long")
    filters = frame(spark, [(1, "k", "a"), (1, "k", "b"), (1, "z", "c")], "query_id long, key string, value string")
    kv = frame(spark, [(5, "k", "b")], "item_id long, key string, value string")
    got = {r.item_id: r.penalty for r in R.filter_penalty(pairs, filters, kv, {"k": 2.0}, 0.5).collect()}
    assert got == {5: 0.5, 6: 2.5}


def test_penalized_scores(spark):
    scored = frame(spark, [(1, 1, 5.0), (1, 2, 4.0), (2, 1, 3.0)], "query_id long, item_id long, score double")
    filters = frame(spark, [(1, "k", "a"), (1, "k", "b"), (1, "m", "x")], "query_id long, key string, value string")
    kv = frame(spark, [(1, "k", "b"), (2, "m", "x")], "item_id long, key string, value string")
    unmet = R.unmet_filters(scored, filters, kv)
    assert sorted(map(tuple, unmet.collect())) == [(1, 1, "m"), (1, 2, "k")]
    get = lambda p: {(r.query_id, r.item_id): r.score for r in R.penalized(scored, unmet, p).collect()}
    assert get({}) == {(1, 1): 5.0, (1, 2): 4.0, (2, 1): 3.0}
    assert get({"k": 2.0}) == {(1, 1): 5.0, (1, 2): 2.0, (2, 1): 3.0}
    assert get({"k": 2.0, "m": 0.5}) == {(1, 1): 4.5, (1, 2): 2.0, (2, 1): 3.0}


def test_log_geo_floors(spark):
    pairs = frame(spark, [(1, 1), (1, 2), (1, 3)], "search_location_id long, item_location_id long")
    trans = G.transitions(frame(spark, [(1, 1)] + [(1, 2)] * 9, "search_location_id long, item_location_id long"))
    got = {r.item_location_id: r.log_geo for r in G.log_geo(pairs, trans).collect()}
    assert got[1] == pytest.approx(math.log(0.5)) and got[2] == pytest.approx(math.log(0.9)) and got[3] == pytest.approx(math.log(1e-6))


def test_smoothed_prior_keeps_denominators(spark):
    search = frame(spark, [(1, "city", 0.0, 0.0, 0.0), (9, "unknown", 0.0, 0.0, 0.0)], "search_location_id long, kind string, lat double, lon double, d75 double")
    items = frame(spark, [(1, 4, 0.0, 0.0), (2, 1, 0.5, 0.5)], "item_location_id long, w long, lat double, lon double")
    trans = G.transitions(frame(spark, [(1, 1), (1, 7)], "search_location_id long, item_location_id long"))
    got = {(r.search_location_id, r.item_location_id): r.p for r in G.smoothed_prior(search, items, trans).collect()}
    nat = 4**0.75 / (4**0.75 + 1)
    assert got[1, 1] == pytest.approx((1 + 20 * (0.2 * 0.1 * nat + 0.8)) / 22) and got[9, 1] == pytest.approx(nat)
    assert got[1, 1] + got[1, 2] < 1


def test_spreads_are_by_the_nearest_value(spark):
    points = frame(spark, [("a", 0.0, float(x)) for x in (4, 1, 3, 2, 3, 3)] + [("b", 0.0, 1.0), ("b", None, None)], "k string, lat double, lon double")
    centres = frame(spark, [("a", 0.0, 0.0), ("b", 0.0, 0.0)], "k string, lat double, lon double")
    got = {r.k: [round(x / 111.19492664) for x in (r.d50, r.d75, r.d90)] for r in G.spreads(points, centres, "k").collect()}
    assert got == {"a": [3, 3, 4], "b": [1, 1, 1]}


def test_ranking_with_a_prior_is_that_of_all_pairs(spark):
    import math
    import random

    rng = random.Random(4)
    items = [(i, rng.choice([1, 2, 3, 4, 5, 6])) for i in range(120)]
    queries = [(q, rng.choice([1, 2, 3, 9])) for q in range(12)]
    scored = [(q, i, round(rng.uniform(0.1, 9), 3)) for q, _ in queries for i, _ in items if rng.random() < 0.04 * (q % 4)]
    p = {(1, 1): 0.01, (1, 2): 0.7, (1, 3): 0.29, (2, 5): 1.0, (9, 4): 0.4, (9, 3): 0.6}
    trans = frame(spark, [(s, i, v) for (s, i), v in p.items()], "search_location_id long, item_location_id long, p double")
    got = G.rank_with_prior(
        frame(spark, scored, "query_id long, item_id long, score double"), frame(spark, queries, "query_id long, search_location_id long"), frame(spark, items, "item_id long, item_location_id long"), trans, 2.0, 15
    )
    have = {(q, i): v for q, i, v in scored}
    want = set()
    for q, s in queries:
        prior = lambda at, s=s: math.log(max(p.get((s, at), 1e-6), 0.5 if at == s else 1e-6))
        best = sorted((-round(have.get((q, i), 0) + 2 * prior(at), 6), i) for i, at in items)[:15]
        want |= {(q, i, -v) for v, i in best}
    assert {(r.query_id, r.item_id, r.score) for r in got.collect()} == want


def test_holders_are_those_that_contain(spark):
    text = "one two three four five six seven eight nine"
    docs = [(1, text), (2, "x" + text + "y"), (3, text[:-4]), (4, None), (5, "seven eight"), (6, text.replace(" ", "  ")), (7, f"a\n{text}\n{text}"), (8, "")]
    q = [(10, text), (11, "ne two three four five six seven ei"), (12, "seven eight"), (13, None), (14, "eight nine")]
    got = E.holders(frame(spark, docs, "item_id long, text string"), frame(spark, q, "query_id long, text string")).collect()
    want = {(i, j) for i, p in q for j, t in docs if p and t is not None and p in t}
    assert {(r.query_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_raking_checks_the_targets_size(spark, monkeypatch):
    monkeypatch.setattr(E, "RAKE_CELLS", 3)
    with pytest.raises(ValueError, match="target"):
        E.rake(frame(spark, [("a", 1)], "c string, n long"), frame(spark, [(str(k),) for k in range(9)], "c string"), ["c"])


def test_pool_takes_scores_from_whole_channels(spark):
    schema = "query_id long, item_id long, score double, rank int"
    a = frame(spark, [(1, 10, 5.0, 1), (1, 11, 4.0, 2), (1, 12, 3.0, 3)], schema)
    b = frame(spark, [(1, 12, 9.0, 1), (1, 10, 8.0, 2)], schema)
    pool = U.pool_union([a, b], [2, 1])
    got = {r.item_id: (r.c0_rank, r.c1_rank) for r in pool.collect()}
    assert got == {10: (1, 2), 11: (2, None), 12: (3, 1)}
    fused = {r.item_id: r.rrf for r in U.fuse(pool, 2).collect()}
    assert fused[11] == pytest.approx(1 / 62 + 1 / 2061, abs=1e-9)
    assert [r.item_id for r in U.cap(U.fuse(pool, 2), 2).orderBy("pool_rank").collect()] == [10, 12]
    gaps = {r.item_id: (r.c1_score, r.c1_score_gap, r.c1_rank) for r in X.channel_features(pool, 2).collect()}
    assert gaps[11] == (-100.0, -109.0, 2001) and gaps[12][1] == 0


def test_quota():
    assert [U.dynamic_quota(n) for n in (2, 4, 10, 40)] == [350, 350, 166, 100]


def test_distance_without_a_place(spark):
    df = frame(spark, [(None, None, 1.0, 1.0)], "q_lat double, q_lon double, lat double, lon double")
    assert X.distance_feature(df).first().log_km == 15.0


def test_recall_rules(spark):
    ids = [f"{i:016x}" for i in range(60)]
    qrels = frame(spark, [("a", ids[0]), ("a", ids[55]), ("b", ids[1])], "query_id string, item_id string")
    answer = frame(spark, [("a", " ".join([ids[0], ids[0], *ids[1:]]))], "query_id string, answer string")
    got = {r.query_id: (r.n_rel, r.n_hit) for r in E.recall(qrels, E.answer_items(answer)).collect()}
    assert got == {"a": (2, 1), "b": (1, 0)}


def test_answer_rules(spark):
    good = [f"{i:016x}" for i in range(51)]
    q = "q" * 16
    queries, items = frame(spark, [(q,)], "query_id string"), frame(spark, [(g,) for g in good], "item_id string")

    def broken(rows, strict=True):
        rules = E.check_answer(frame(spark, rows, "query_id string, answer string"), queries, items, strict=strict)
        return {r.rule for r in rules.collect() if r.n and r.severity == "error"}

    assert broken([(q, " ".join(good[:50]))]) == set()
    assert broken([(q, good[0])]) == set()
    assert "too_many" in broken([(q, " ".join(good))])
    assert "bad_ids" in broken([(q, good[0] + "  " + good[1])]) and "bad_ids" in broken([(q, "A" * 16)])
    assert "duplicated_ids" in broken([(q, f"{good[0]} {good[0]}")])
    assert "unknown_ids" in broken([(q, "f" * 16)])
    assert broken([(q, ""), (q, "")]) == {"duplicated_queries"}
    assert {"query_id_length", "unknown_queries", "missing_queries"} <= broken([("x", "")])
    assert "missing_queries" not in broken([("x", "")], strict=False)
    assert E.check_answer(queries, queries, items).first().rule == "columns"


def test_raking_skips_values_without_target(spark):
    cells = frame(spark, [("a", "x", 10), ("b", "x", 30)], "c string, d string, n long")
    target = frame(spark, [("a", "x")] * 3 + [("z", "x")], "c string, d string")
    got = {r.c: r.w for r in E.rake(cells, target, ["c", "d"], 5).collect()}
    plain = E.rake_on_driver([(10, "a", "x"), (30, "b", "x")], [{"a": 0.75, "z": 0.25}, {"x": 1.0}], 5)
    assert got["a"] == pytest.approx(plain[0]) and got["b"] == pytest.approx(plain[1])
    assert (10 * got["a"] + 30 * got["b"]) / 40 == pytest.approx(1)


def test_bootstrap_brackets_the_mean(spark):
    values = frame(spark, [(i, float(i % 2)) for i in range(40)], "idx long, x double")
    r = E.bootstrap(values, "x", 100).first()
    assert r.mean == 0.5 and r.lo <= 0.5 <= r.hi and r.n == 40


@pytest.mark.parametrize("n", [0, 1, 7, 100])
def test_allocation_sums_up(spark, n):
    cells = frame(spark, [("a", 3), ("b", 3), ("c", 1)], "cell string, size long")
    assert sum(r.k for r in S.allocate(cells, n).collect()) == n


def test_leaks(spark):
    schema = "search long, place string, item_id long, norm_q string"
    train = frame(spark, [(1, "p", 1, "t"), (2, "p", 2, "u"), (3, "p", None, "v"), (4, "p", 9, "w"), (5, "p", 5, "z"), (None, "p", 6, "y")], schema)
    taken = train.where("search = 1")
    out = S.without_leaks(train, taken, frame(spark, [(9,)], "item_id long"), frame(spark, [("z",)], "norm_q string"), ["search", "place"])
    assert sorted(r.item_id for r in out.collect()) == [2, 6]


def test_selection_shares_no_item(spark):
    rows = [(i, i, [i % 7, 100 + i], "1" if i % 2 else "0", "x", i % 3) for i in range(40)]
    cand = frame(spark, rows, "id long, position int, rel array<long>, f string, g string, seen int")
    got = S.select_stratified(cand, ["f", "g"], {"val": [(("0", "x"), 2), (("1", "x"), 1)], "tst": [(("0", "x"), 2)]}, seen="seen").collect()
    rel = dict((r[0], r[2]) for r in rows)
    used = [x for r in got for x in rel[r.id]]
    assert len(used) == len(set(used)) and len({r.id for r in got}) == len(got) == 5
    assert [r.split for r in got].count("val") == 3


def test_converted_texts_are_the_rarest(spark):
    rows = [(k, k, [100 + k], "5", 30 - k) for k in range(8)]  # later positions are rarer
    cand = frame(spark, rows, "id long, position long, rel array<long>, f string, seen long")
    got = S.select_stratified(cand, ["f"], {"val": [(("0",), 3)]}, seen="seen").collect()
    assert sorted(r.id for r in got) == [5, 6, 7] and all(r.converted for r in got)


def test_sample_weights_use_all_qrels(spark):
    pairs = frame(spark, [(1, 1, 1), (1, 2, 0)], "query_id long, item_id long, label int")
    qrels = frame(spark, [(1, 1), (1, 77)], "query_id long, item_id long")
    assert {r.item_id: r.weight for r in S.sample_weights(pairs, qrels).collect()} == {1: 30.0, 2: 1.0}


def test_line_search():
    best, score = ranker.line_search(lambda c: -((c["a"] - 2) ** 2) - (c["b"] + 1) ** 2, {"a": 0, "b": 0}, {"a": [0, 1, 2, 3], "b": [-2, -1, 0]})
    assert best == {"a": 2, "b": -1} and score == 0


def test_lists_of_repeated_and_missing_ids(spark):
    """Rows of one id are summed as SQL sums them, and lists equal all pairs' best."""
    docs = [(1, "a b a"), (1, "a b a"), (1, "a c"), (None, "a"), (None, "b b"), (2, "c d"), (3, None), (4, "")]
    items = frame(spark, docs, "item_id long, terms string")
    queries = frame(spark, [(7, ["a", "b", "a"]), (7, ["b"]), (8, ["c", "zz"]), (9, [])], "query_id long, terms array<string>")
    lists = R.bm25_lists(items, queries)
    got = {(r.query_id, r.item_id): round(r.score, 6) for r in lists.pairs().collect()}
    from math import log

    n, avg = 8, (3 + 3 + 2 + 1 + 2 + 2) / 8
    w = lambda tf, dl, df: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg)) * log(1 + (n - df + 0.5) / (df + 0.5))
    want = {(7, 1): w(4, 3, 3) + w(2, 3, 2) + w(1, 2, 3), (7, None): w(1, 1, 3) + w(2, 2, 2), (8, 1): w(1, 2, 2), (8, 2): w(1, 2, 2)}
    assert got == {k: round(v, 6) for k, v in want.items()}
    best = sorted((r.query_id, r["rank"], r.item_id) for r in lists.best(1).collect())
    assert best == [(7, 1, 1), (8, 1, 1)]


def test_lists_by_blocks_of_queries(spark, monkeypatch):
    items = frame(spark, [(i, " ".join(f"t{j}" for j in range(1 + i % 7))) for i in range(60)], "item_id long, terms string")
    queries = frame(spark, [(q, [f"t{q % 5}", "t0"]) for q in range(20)], "query_id long, terms array<string>")
    get = lambda: sorted(map(tuple, R.bm25_lists(items, queries).best(3).select("query_id", "rank", "item_id", "score").collect()))
    whole = get()
    assert len(whole) == 60
    assert whole == sorted((r.query_id, r["rank"], r.item_id, r.score) for r in R.top_k(R.bm25(items, queries), 3).collect())
    monkeypatch.setattr(R, "QUERY_BLOCK", 6)
    assert get() == whole


def test_models_do_not_hang_on_partitions(spark):
    """Training rows are put in order, in as few partitions as they need, whatever they came in."""
    from siftline.operators import ranker

    rows = spark.range(400).selectExpr("id % 4 as query_id", "id as item_id", "cast(id % 37 as double) as x", "cast(id % 11 as double) as y", "cast(id % 37 > 20 and id % 3 > 0 as int) as label", "1.0D as weight")
    get = lambda n: sorted(map(tuple, ranker.predict(rows, ranker.fit(rows.repartition(n), ["x", "y"], [1, 2], rounds=2), ["x", "y"]).collect()))
    assert get(1) == get(7)


def test_tokens_in_bulk_are_those_of_the_expression(spark):
    """Of texts with every character that has a neighbour, and of slices with nulls and empty texts."""
    import pyarrow as pa

    from siftline.functions import text as T

    every = [chr(c) for c in range(1, 0x3000)] + ["\U0001f600", "\ufb01", "\uff21"]
    texts = [None, "", "a", *[f"Б{c}z" for c in every], "", *["".join(every[i : i + 9]) for i in range(0, len(every), 9)], None, "ё Ё", "x" * 70_000, "y"]
    rows = frame(spark, [(i, t) for i, t in enumerate(texts)], "i long, t string")
    want = [r.t for r in rows.select("i", T.tokens(F.col("t")).alias("t")).orderBy("i").collect()]
    for a, b in ((0, len(texts)), (1, 3), (2, 500), (0, 2), (5, 5)):
        words, lens = R.tokenized(pa.array(texts, pa.string()).slice(a, b - a))
        assert words.to_pylist() == [w for x in want[a:b] for w in x] and lens.tolist() == [len(x) for x in want[a:b]]


def test_index_counts_texts_as_arrays(spark, monkeypatch):
    """Texts that are cut to pieces have the counts of their arrays of terms, in two fields."""
    from siftline.functions import text as T

    monkeypatch.setattr(R, "TEXT_BYTES", 20)
    texts = frame(spark, [(1, "a b a Ё", "b"), (2, None, "c c"), (3, "", None), (4, "d " * 40 + "a", "a")], "item_id long, x string, y string")
    queries = frame(spark, [(1, ["a", "b", "е"]), (2, ["c", "d"])], "query_id long, terms array<string>")
    both = texts, texts.withColumns({c: T.tokens(F.col(c)) for c in "xy"})
    found = [R.index(t, queries, ["x", "y"]) for t in both]
    flat = [sorted((r.item_id, list(r.lens), sorted(zip(r.code, r.tf, r.dl))) for r in ix.rows.collect()) for ix in found]
    assert flat[0] == flat[1] and found[0].avg == found[1].avg
    assert found[0].df().tolist() == found[1].df().tolist() == [2.0, 1.0, 1.0, 1.0, 1.0]
    assert found[0].only("y").df().tolist() == [1.0, 1.0, 1.0, 0.0, 0.0]
