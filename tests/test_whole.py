"""Jobs that are done on all rows, where they used to be cut."""

import pytest

from siftline.plans import catalog, features
from siftline.plans.workflow import Search


def tables(spark, folder, **rows):
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """One passage, and 300 documents that hold it."""
    text = "the quick brown fox jumps over the lazy dog beside the old stone bridge at dawn"
    docs = [(i, f"{text} {i}", "en", "web", len(text)) for i in range(300)] + [(i, f"other words {i}", "en", "web", 14) for i in range(300, 900)]
    return tables(spark, tmp_path_factory.mktemp("copies"), documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"), benchmark=([(1, text)], "item_id long, text string"))


@pytest.mark.parametrize("name", ["pool_union_quota", "rrf_fusion", "pool_cap", "pair_features", "coverage_jaccard"])
def test_all_copies_are_in_the_pool(spark, copies, name):
    assert catalog.QUERIES[name](spark, copies).count() == 300


def test_all_copies_are_labelled(spark, copies):
    assert features.labelled_pairs(spark, copies).where("label = 1").count() == 300


def test_bodies_are_read_to_their_end(spark, tmp_path):
    text = "silver otters swim under the frozen harbour while seven grey lanterns burn all night long"
    docs = [(1, "word " * 900 + text, "en", "web", 4590), (2, "word " * 900, "en", "web", 4500), (3, None, "en", "web", 0), (4, text[:70] + " otherwise", "en", "web", 80)]
    folder = tables(spark, tmp_path, documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"), benchmark=([(1, text)], "item_id long, text string"))
    assert {r.item_id for r in catalog.QUERIES["bm25f_topk"](spark, folder).collect()} == {1, 4}
    assert {r.item_id for r in features.labelled_pairs(spark, folder).where("label = 1").collect()} == {1}


def test_workflow_reads_descriptions_to_their_end(spark):
    class OneItem:
        def corpus(self, columns=None):
            rows = spark.createDataFrame([("a", "t", "word " * 900 + "lantern", None, 1, 1, 1)], "item_id string, item_title_raw string, item_description_raw string, item_infm_params_text string, item_category_id long, item_microcat_id long, item_location_id long")
            return rows.select(*columns) if columns else rows

        def queries(self, split):
            return spark.createDataFrame([("q", "lantern", 1)], "query_id string, search_query string, search_location_id long")

    search = Search(OneItem())
    search._with_geo = lambda channel, *_: channel
    assert search.bm25f_channel("val").count() == 1


def test_penalties_reach_all_parts(spark, tmp_path):
    parts = [(50, "steel", "a"), (51, "steel", "b"), (5000001, "steel", "a"), (9000001, "tin", "b")]
    folder = tables(spark, tmp_path, part=(parts, "p_partkey long, p_type string, p_brand string"))
    got = {r.item_id: (r.penalty, r.vid_match, r.tip_match) for r in catalog.QUERIES["filter_unmet_penalty"](spark, folder).collect()}
    assert got == {50: (0.0, 1, 1), 51: (1.5, 1, -1), 5000001: (0.0, 1, 1), 9000001: (4.5, -1, -1)}


def test_ranker_is_fully_trained(spark, monkeypatch, copies):
    """200 rounds and three seeds by default, and negatives down to rank 300."""
    from inspect import signature

    from siftline import cli
    from siftline.operators import ranker, sampling

    assert signature(ranker.fit).parameters["rounds"].default == signature(Search.train).parameters["rounds"].default == 200
    seen = {}

    def train(self, channels, rounds):
        raise InterruptedError(rounds)

    monkeypatch.setattr(Search, "train", train)
    with pytest.raises(InterruptedError, match="^200$"):
        cli.main(["--store", copies, "train", "--channels", "a/b", "--models", f"{copies}/m"])

    def fit(pairs, names, seeds, rounds=200, **more):
        seen.update(seeds=seeds, rounds=rounds, more=more)
        raise InterruptedError

    def negatives(pairs, **more):
        seen.update(least=more.get("top", 300))
        return pairs

    monkeypatch.setattr(ranker, "fit", fit)
    monkeypatch.setattr(sampling, "negatives", negatives)
    with pytest.raises(InterruptedError):
        catalog.QUERIES["gbt_rank_top50"](spark, copies)
    assert seen == {"seeds": [1, 2, 3], "rounds": 200, "more": {}, "least": 300}


def test_history_is_all_other_rows(spark, tmp_path):
    rows = [(i, 1, "view") for i in range(100)]
    folder = tables(spark, tmp_path, events=(rows, "event_id long, user_id long, event_type string"))
    got = catalog.QUERIES["history_features"](spark, folder).collect()
    assert len(got) == 20 and {r.text_rows_in_history for r in got} == {80}


def test_raking_and_resampling_run_to_their_defaults(spark, monkeypatch):
    from siftline.operators import evaluation as E

    seen = {}
    monkeypatch.setattr(E, "bootstrap", lambda rows, value, resamples: seen.setdefault(value, resamples) and spark.range(1))
    monkeypatch.setattr(E, "rake", lambda cells, target, names, passes: seen.setdefault("passes", passes) and cells.selectExpr("*", "1.0 as w"))
    for name in ("bootstrap_ci", "paired_bootstrap", "rake_weights"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == {"r": 2000, "d": 2000, "passes": 50}


def test_penalty_pairs_are_not_shuffled(spark, tmp_path):
    """The pairs of all queries and all parts come last in the plan; a null type is met by nothing."""
    parts = [(50, "steel", "a"), (51, None, "a"), (100, None, "b")]
    folder = tables(spark, tmp_path, part=(parts, "p_partkey long, p_type string, p_brand string"))
    out = catalog.QUERIES["filter_unmet_penalty"](spark, folder)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Aggregate" not in plan
    assert {(r.query_id, r.item_id): r.penalty for r in out.collect()} == {(50, 50): 0.0, (50, 51): 3.0, (50, 100): 4.5, (100, 50): 4.5, (100, 51): 4.5, (100, 100): 3.0}


def _captured(monkeypatch, of):
    """The function that a query sends to its tasks."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, schema, *a: seen.append(f) or real(self, f, schema, *a))
    of()
    return seen[-1]


@pytest.mark.parametrize("with_prior", [False, True])
def test_nearest_holds_little(spark, monkeypatch, with_prior):
    """A batch of 10,000 vectors against 1,000 queries, without a table of all their products."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from siftline.operators import retrieval as R

    queries = spark.createDataFrame([(i, [float(i), 1.0], "a") for i in range(1000)], "query_id long, vector array<double>, search_location_id string")
    items = spark.createDataFrame([(0, [0.0, 1.0], "a")], "item_id long, vector array<double>, item_location_id string")
    prior = spark.createDataFrame([("a", "a", -1.0)], "search_location_id string, item_location_id string, log_p double") if with_prior else None
    run = _captured(monkeypatch, lambda: R.nearest(items, queries, 5, prior, 0.1))
    vectors = np.random.default_rng(1).standard_normal((10_000, 2))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 20_001, 2), pa.int32()), pa.array(vectors.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), lists, pa.array(["a"] * 10_000)], names=["item_id", "vector", "place"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch] * 3)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 5000 and peak < 80e6


def test_nearest_lists_are_cut_early(spark, monkeypatch):
    """A full block of queries with lists of 50: no pile of a million candidates, and ties at the end of a list go by id."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from siftline.operators import retrieval as R

    queries = spark.createDataFrame([(i, [1.0, float(i % 7)], "a") for i in range(2048)], "query_id long, vector array<double>, search_location_id string")
    items = spark.createDataFrame([(0, [0.0, 1.0], "a")], "item_id long, vector array<double>, item_location_id string")
    prior = spark.createDataFrame([("a", "a", -1.0)], "search_location_id string, item_location_id string, log_p double")
    run = _captured(monkeypatch, lambda: R.nearest(items, queries, 50, prior, 0.1))
    rng = np.random.default_rng(1)
    vectors, places = np.round(rng.standard_normal((8000, 2)), 1), ["a" if x else "b" for x in rng.integers(0, 2, 8000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7999, -1, -1)), pa.ListArray.from_arrays(pa.array(np.arange(0, 16_001, 2), pa.int32()), pa.array(vectors.ravel())), pa.array(places)], names=["item_id", "vector", "place"])
    tracemalloc.start()
    got = pa.Table.from_batches(list(run(iter([batch])))).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    bonus = 0.1 * np.where(np.array(places) == "a", -1.0, np.log(1e-6))
    for q in (0, 1, 6, 2047):
        score = np.round(np.round(vectors @ [1.0, float(q % 7)], 6) + bonus, 6)
        want = sorted(zip(-score, range(7999, -1, -1)))[:50]
        mine = got[got["query_id"] == q].sort_values(["score", "item_id"], ascending=[False, True])
        assert list(zip(-mine["score"], mine["item_id"])) == want
    assert len(got) == 2048 * 50 and peak < 40e6


def _peak(run, batches):
    """Rows, and the most bytes that were allocated while they came."""
    import tracemalloc

    tracemalloc.start()
    got = list(run(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return got, peak


def test_texts_are_counted_in_small_pieces():
    """8 MB of texts of 8 KB, without work tables of many times a piece of 4 MB."""
    import pyarrow as pa

    from siftline.operators import retrieval as R

    texts = [f"alpha {i} beta gamma-Delta ё " * 300 for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], names=["item_id", "text"])
    got, peak = _peak(R._counted(["text"], {"alpha": 0, "delta": 1, "е": 2, "none": 3}, 0), [batch])
    rows = pa.Table.from_batches(got).to_pylist()
    assert [r["item_id"] for r in rows] == list(range(1000))
    assert all(r["lens"] == [1800] and r["code"] == [0, 1, 2] and r["tf"] == [300] * 3 and r["dl"] == [1800] * 3 for r in rows)
    assert peak < 30e6


@pytest.mark.parametrize("negative", [False, True])
def test_lists_hold_few_candidates_and_are_exact(negative):
    """200 queries with common and rare terms, lists of 500, many ties, against all pairs; signed parts may cancel."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from siftline.operators import retrieval as R

    rng = np.random.default_rng(2)
    n_items, n_terms, n_queries = 20_000, 60, 200
    has = rng.random((n_items, n_terms)) < 0.2
    tf = np.where(has, rng.integers(1, 4, has.shape), 0)
    asks = rng.random((n_terms, n_queries)) < np.where(np.arange(n_terms) < 20, 0.3, 0.01)[:, None]
    at = np.argwhere(asks)
    first = np.searchsorted(at[:, 0], np.arange(n_terms + 1))
    item, code = np.nonzero(has)
    offsets = pa.array(np.searchsorted(item, np.arange(n_items + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (code, tf[has], np.ones(len(code)))]
    table = pa.Table.from_arrays([pa.array(range(n_items - 1, -1, -1)), *lists, pa.array(["a"] * n_items)], names=["item_id", "code", "tf", "dl", "place"])
    sign = np.where(np.arange(n_terms) % 2 == 1, -1.0, 1.0) if negative else np.ones(n_terms)
    ix = SimpleNamespace(terms=range(n_terms), fields=["f"], picked=["f"], repeated=False)
    how = R.Lexical(ix, lambda field, tf, dl: tf, lambda total, term: total * sign[term])
    got, peak = _peak(R._scoring(how, pa.array(range(n_queries)), first, at[:, 1], 500, None), table.to_batches(max_chunksize=4000))
    got = pa.Table.from_batches(got).to_pandas()
    score, shared = (tf * sign) @ asks, (has.astype(int) @ asks.astype(int)) > 0
    for q in (0, 1, 7, 199):
        want = sorted((-score[i, q], n_items - 1 - i) for i in np.flatnonzero(shared[:, q]))[:500]
        mine = got[got["query_id"] == q].sort_values(["score", "item_id"], ascending=[False, True])
        assert list(zip(-mine["score"], mine["item_id"])) == want
    assert peak < 60e6
    every = pa.Table.from_batches(list(R._scoring(how, pa.array(range(n_queries)), first, at[:, 1], None, None)(iter(table.to_batches()[:1])))).num_rows
    assert every == shared.sum()


def test_history_is_joined_once(spark, monkeypatch):
    """The prior reads written transitions."""
    from siftline import staging

    plans, real = {}, staging.stage
    monkeypatch.setattr(staging, "stage", lambda df, name: plans.update({name: _plan(df)}) or real(df, name))
    assert catalog.QUERIES["bm25_geo_topk"](spark, "/root/testdata/sf0.001").count() > 0
    assert "l_suppkey" in plans["transitions"] and "l_suppkey" not in plans["prior"]


def test_whole_texts_are_not_shuffled_to_the_pool(spark, monkeypatch, copies):
    """Even where the pool's items are more than a lookup of several columns may have."""
    import re

    from siftline import staging
    from siftline.plans import features

    monkeypatch.setattr(staging, "SMALL_ROWS", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = features._pairs(spark, copies)
        text = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    keyed = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)\nArguments: hashpartitioning", text)
    assert keyed and not any(re.search(r"\btext#", x) for x in keyed), keyed


@pytest.mark.parametrize("name", ["ordered_answer_concat", "recall_at_k", "pool_recall_curve"])
def test_one_channel_is_made_for_one(spark, monkeypatch, copies, name):
    """What takes one channel doesn't index the other."""
    from siftline import staging

    seen, real = [], staging.stage
    monkeypatch.setattr(staging, "stage", lambda df, name: seen.append(name) or real(df, name))
    assert catalog.QUERIES[name](spark, copies).count() == 1
    assert [x for x in seen if x.startswith("channel")] == ["channel-text"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pool_cap", "rrf_fusion", "pair_features", "coverage_jaccard", "channel_gap", "answer_pipeline", "bm25_geo_topk", "bm25f_geo_topk"])
def test_tokens_are_not_rows(spark, monkeypatch, name):
    """An index counts the terms of a text where the text is: no row a token, and no shuffle of all pairs that share a term."""
    from siftline import staging

    plans, real = {}, staging.stage
    monkeypatch.setattr(staging, "stage", lambda df, name: plans.setdefault(name, []).append(_plan(df)) or real(df, name))
    _plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert all("Generate" not in p and "HashAggregate" not in p for x in ("index-rows", "channel-text", "channel-title") for p in plans.get(x, []))
    assert plans["index-rows"]


@pytest.mark.parametrize("name", ["bm25_geo_topk", "bm25f_geo_topk"])
def test_history_and_scores_are_read_once(spark, monkeypatch, name):
    """The prior and the ranking are written before they are used several times."""
    from siftline import staging

    read, real = [], staging.stage
    monkeypatch.setattr(staging, "stage", lambda df, what: read.append("lineitem" in _plan(df)) or real(df, what))
    out = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "lineitem" not in _plan(out) and "MapInArrow" not in _plan(out) and sum(read) == 1


@pytest.mark.parametrize("name", ["coverage_jaccard", "answer_pipeline"])
def test_only_the_items_of_the_pool_are_analysed(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "MapInArrow" not in plan


def test_postings_are_stored_as_bytes(spark, monkeypatch):
    """Spark copies an item's numbers, without a step for each; the arrays are a view of them."""
    from siftline import staging
    from siftline.operators import retrieval as R

    kinds, real = {}, staging.stage
    monkeypatch.setattr(staging, "stage", lambda df, name: kinds.update({name: dict(df.dtypes)}) or real(df, name))
    queries = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "d"])], "query_id long, terms array<string>")
    for ids in ((1, 2, 3), (1, 1, 3)):  # the second time rows of one item are merged
        items = spark.createDataFrame([(ids[0], "a b a", "c"), (ids[1], "x " * 70_000 + "d " * 70_000, None), (ids[2], None, "")], "item_id long, x string, y string")
        ix = R.index(items, queries, ["x", "y"])
        name = "index-merged" if ix.repeated else "index-rows"
        assert ix.repeated == (ids[0] == ids[1]) and kinds[name]["code"] == kinds[name]["tf"] == "binary" and "dl" not in kinds[name]
        got = sorted((r.item_id, c, tf, dl) for r in ix.rows.collect() for c, tf, dl in zip(r.code, r.tf, r.dl))
        assert got == sorted([(ids[0], 0, 2, 3), (ids[0], 1, 1, 3), (ids[0], 6, 1, 1), (ids[1], 3, 70_000, 140_000)])
        assert ix.only("x").df().tolist() == [1, 1, 0, 1] and ix.only("y").df().tolist() == [0, 0, 1, 0] and ix.df().tolist() == [1, 1, 1, 1]


def test_fields_are_counted_in_one_pass(spark, monkeypatch, copies):
    """Both channels' document frequencies come from one reading of the index."""
    from siftline.operators import retrieval as R

    seen, real = [], R._held_by
    monkeypatch.setattr(R, "_held_by", lambda *x: seen.append(x) or real(*x))
    assert catalog.QUERIES["channel_gap"](spark, copies).count() > 0
    assert len(seen) == 1


def test_what_lies_near_brings_its_prior(spark, monkeypatch):
    """No item of the corpus is looked for once more to rank it."""
    from siftline import staging

    plans, real = {}, staging.stage
    monkeypatch.setattr(staging, "stage", lambda df, name: plans.update({name: _plan(df)}) or real(df, name))
    catalog.QUERIES["bm25_geo_topk"](spark, "/root/testdata/sf0.001")
    assert "doc_id" in plans["near"] and "doc_id" not in plans["ranked"]


def test_words_are_found_without_strings(monkeypatch):
    """Words of 16 bytes or fewer are looked up as numbers, also where several terms want one slot; longer ones as strings."""
    import random

    import pyarrow as pa

    from siftline.operators import retrieval as R

    made, real, rng = [], R._words, random.Random(3)
    monkeypatch.setattr(R, "_words", lambda joined, sizes: made.append(sizes) or real(joined, sizes))
    monkeypatch.setattr(R._Vocabulary, "_slots", lambda self, a, b: (a % 7).astype("int64"))  # seven slots are wanted by all
    word = lambda: "".join(rng.choice("abя") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 30])))
    terms = sorted({word() for _ in range(300)} | {"a" * 8, "a" * 9, "a" * 16, "a" * 17, "я" * 8})
    texts = [" ".join(rng.choice(terms) if rng.random() < 0.6 else word() for _ in range(50)) for _ in range(40)] + [None, "", "A" * 16, "aaaaaaaaa"]
    for mine in (terms, [t for t in terms if len(t.encode()) <= 16], []):
        del made[:]
        row, code, n, lens = R._text_counts(pa.array(texts), R._Vocabulary(mine))
        want = [(i, t) for i, x in enumerate(texts) for t in (x or "").lower().split()]
        assert lens.tolist() == [len((x or "").split()) for x in texts]
        found = sorted((i, mine.index(t)) for i, t in want if t in mine)
        assert sorted((i, c) for i, c, k in zip(row.tolist(), code.tolist(), n.tolist()) for _ in range(k)) == found
        assert not made or (mine is terms and all(s > 16 for x in made for s in x))
