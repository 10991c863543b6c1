"""The whole split against plain Python, and in a store."""

import dataclasses
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftline import cli
from siftline.operators import sampling as S
from siftline.plans import split_build as B
from siftline.sources import tables

PLAN = B.Plan(rounds=({"val": 12, "test": 12}, {"rtrain": 250}))


@pytest.fixture(scope="module")
def inputs(spark):
    train, corpus, bench = B._from_tables(spark, "/root/testdata/sf0.001")
    train = train.withColumn("item_id", F.col("train_row_id") % 700)  # items enough for conversions, few enough for clashes
    train = train.withColumn("search_query", F.concat(F.substring_index("search_query", " ", 1), F.lit(" "), (F.col("train_row_id") % 97).cast("string")))  # most texts are in several searches
    corpus = spark.range(690).select(F.col("id").alias("item_id"), (F.col("id") % 20).alias("item_location_id"), F.when(F.col("id") % 9 > 0, F.col("id")).alias("item_rating_reviews_count"))
    return train.persist(), corpus.persist(), bench.persist()


@pytest.fixture(scope="module")
def split(inputs):
    return B.build(*inputs, PLAN)


def greedy(rows, sizes, cells, used):
    """The selection as nested loops: who is next in a cell is looked up anew each time."""
    total, chosen, need = sum(cells.values()), {}, {}
    for s, n in sizes.items():
        raw = {c: n * k / total for c, k in cells.items()}
        need[s] = {c: int(x) for c, x in raw.items()}
        for c in sorted(raw, key=lambda c: (-round(raw[c] - int(raw[c]), 9), c))[: n - sum(need[s].values())]:
            need[s][c] += 1
    for depth in range(4, -1, -1):
        for place in sorted({c[:depth] for s in need for c, n in need[s].items() if n}):
            natural = sorted((r for r in rows if r.cell[:depth] == place), key=lambda r: r.position)
            as_new = lambda r: (r.cell[0], "0", *r.cell[2:])
            rare = sorted((r for r in rows if 1 <= r.seen <= 30 and as_new(r)[:depth] == place), key=lambda r: (r.seen, r.position))
            turn = 0
            for r, converted in [(r, False) for r in natural] + [(r, True) for r in rare]:
                names = list(sizes)[turn:] + list(sizes)[:turn]
                free = [s for s in names if any(n and c[:depth] == place for c, n in need[s].items())]
                if not free:
                    break
                if r.id in chosen or used & set(r.rel):
                    continue
                chosen[r.id] = (free[0], converted)
                used |= set(r.rel)
                need[free[0]][min(c for c, n in need[free[0]].items() if n and c[:depth] == place)] -= 1
                turn = (list(sizes).index(free[0]) + 1) % len(sizes)
    return chosen


def test_selection_equals_plain_loops(spark, inputs, split):
    train, corpus, bench = inputs
    rows = B._keyed(train)
    locations = S.location_table(train, corpus, B.NAMED)
    _, pool = B.candidates(rows, corpus, locations, PLAN)

    class Row:
        def __init__(self, r):
            self.id, self.position, self.seen, self.rel = r.id, r.position, r.seen, list(r.rel)
            self.cell = tuple(r[c] for c in B.STRATA)

    pool = [Row(r) for r in pool.collect()]
    meta = split.meta.where("split = 'bench'").collect()
    cells = Counter(tuple("" if r[c] is None else str(r[c]).lower() if c == "has_filter" else str(r[c]) for c in B.STRATA) for r in meta)
    used = set()
    want = greedy(pool, PLAN.rounds[0], cells, used)
    want |= greedy([r for r in pool if r.id not in want], PLAN.rounds[1], cells, used)
    got = split.queries.select("search_query", "split").collect()
    assert len(got) == len(want) > 20
    assert {r.search_query: r.split for r in got} == {k: s for k, (s, _) in want.items()}
    assert split.manifest["counts"]["converted_texts"] == sum(c for _, c in want.values()) > 0


def test_no_leaks(inputs, split):
    train, corpus, _ = inputs
    key = lambda r: tuple(r[c] for c in B.KEY)
    queries, qrels = split.queries.collect(), defaultdict(set)
    for r in split.qrels.collect():
        qrels[r.query_id].add(r.item_id)
    used = [x for q in queries for x in qrels[q.query_id]]
    assert len(used) == len(set(used))
    searched, converted = {key(q) for q in queries}, split.manifest["counts"]["converted_texts"]
    in_corpus, rows = {r.item_id for r in corpus.collect()}, train.collect()
    for q in queries:
        assert qrels[q.query_id] == {r.item_id for r in rows if key(r) == key(q) and r.item_id in in_corpus}
    hist = {r.train_row_id for r in split.hist.collect()}
    clean = {r.train_row_id for r in rows if key(r) not in searched and r.item_id not in set(used)}
    texts = Counter(r.search_query for r in rows if r.train_row_id in hist)
    gone = {r.search_query for r in rows if r.train_row_id in clean - hist}
    assert hist <= clean and len(gone) <= converted and not gone & set(texts)
    removed = split.manifest["removed_rows"]
    assert removed["converted_text_rows"] == len(clean - hist) and sum(removed.values()) == len(rows) - len(hist)
    meta = {r.query_id: r for r in split.meta.where("split <> 'bench'").collect()}
    by_id = {q.query_id: q for q in queries}
    reviews = {r.item_id: r.item_rating_reviews_count or 0 for r in corpus.collect()}
    for i, m in meta.items():
        assert m.text_rows_in_history == texts[by_id[i].search_query] and m.n_rel == len(qrels[i])
        assert m.pos_reviews_min == min(reviews[x] for x in qrels[i])
        assert m.has_filter == bool(by_id[i].search_infm_params_text)
    for s, p in B.PREFIX.items():
        ids = sorted(q.query_id for q in queries if q.split == s)
        assert ids == [f"{p}{k:013d}" for k in range(len(ids))]


def test_few_candidates_a_cell_give_the_same_split(inputs, split):
    few = B.build(*inputs, B.Plan(rounds=PLAN.rounds, per_cell=1))
    assert few.manifest["hashes"] == split.manifest["hashes"]


def test_split_in_a_store(spark, inputs, split, tmp_path, monkeypatch):
    """What is built is built once above; another seed's differs in its hashes."""
    other = dataclasses.replace(split, manifest=split.manifest | {"hashes": {}})
    monkeypatch.setattr(B, "build", lambda train, corpus, bench, plan: split if plan.seed == 1 else other)
    store = tables.Store(spark, f"file://{tmp_path}/store")
    train, corpus, bench = inputs
    train.write.parquet(f"{store.root}/train")
    corpus.write.parquet(f"{store.root}/items")
    store.save_split("queries", "bench", bench)
    run = lambda *a: cli.main(["--store", store.root, "split", "--evaluation", "12", "--ranker", "250", *a])
    assert run("--dry-run") == 0 and not (tmp_path / "store/hist").exists()
    assert run() == 0 and store.queries("val").count() == 12 and store.queries("bench").count() == bench.count()
    assert store.qrels("rtrain").count() > 0 and store.meta("bench").count() == bench.count()
    assert run() == 0  # verified
    with pytest.raises(ValueError, match="differs"):
        B.build_in_store(store, B.Plan(rounds=PLAN.rounds, seed=5))
    assert B.build_in_store(store, B.Plan(rounds=PLAN.rounds, seed=5), force=True)[0] == "written"
    assert store.queries("val").count() == 12


def test_an_empty_train_table_gives_no_queries(inputs):
    train, corpus, bench = inputs
    out = B.build(train.where("false"), corpus, bench, PLAN)
    assert out.queries.count() == 0 and out.hist.count() == 0 and out.meta.count() == bench.count()
