import pytest

from siftline.sources import tables as S
from siftline.streaming import log


@pytest.fixture
def store(spark, tmp_path):
    out = S.Store(spark, f"file://{tmp_path}/store")
    spark.createDataFrame([("i1",), ("i2",)], "item_id string").write.parquet(f"{out.root}/items")
    for split in S.SPLITS:
        out.save_split("queries", split, spark.createDataFrame([("q1",)], "query_id string"))
    return out


def test_channel_contract(spark, store):
    rows = lambda *x: spark.createDataFrame(list(x), "query_id string, item_id string, score double, rank long")
    for split in S.SPLITS:
        store.save_channel("baseline", "bm25", split, rows(("q1", "i2", 2.0, 1), ("q1", "i1", 1.0, 2)))
    got = store.channel("baseline", "bm25", "val")
    assert got.schema == S.CHANNEL and [r.item_id for r in got.orderBy("rank").collect()] == ["i2", "i1"]
    for bad in (rows(("q1", "i1", 1.0, 2)), rows(("q1", "i1", 1.0, 1), ("q1", "i1", 1.0, 2)), rows(("zz", "i1", 1.0, 1)), rows(("q1", "zz", 1.0, 1))):
        with pytest.raises(S.ContractError):
            store.save_channel("baseline", "bad", "val", bad)
    with pytest.raises(S.ContractError):
        store.save_channel("..", "x", "val", rows(("q1", "i1", 1.0, 1)))
    store.save_meta("baseline", "bm25", "channel", "text", True)
    store.save_meta("other", "half", "channel", "text", True)
    assert {(r.owner, r.name, r.fit_only) for r in store.catalog().collect()} == {("baseline", "bm25", True), ("other", "half", True)}
    assert store.complete_channels() == [("baseline", "bm25")]


def test_splits_are_checked(store):
    for f in (store.queries, store.qrels, store.train_rows):
        with pytest.raises(ValueError):
            f("dev")
    with pytest.raises(ValueError):
        store.qrels("bench")


def test_train_rows_by_split(spark, store):
    spark.createDataFrame([(1, 5)], "a long, train_row_id long").write.parquet(f"{store.root}/hist")
    spark.createDataFrame([(1,), (2,)], "a long").write.parquet(f"{store.root}/train")
    assert store.train_rows("val", ["a"]).columns == ["a", "train_row_id"] and store.train_rows("bench", ["a"]).count() == 2


def test_vectors(spark, store):
    good = spark.createDataFrame([("i1", [0.6, 0.8])], "id string, vector array<double>")
    store.save_vectors("o", "v", "items", good, 1)
    assert store.vectors("o", "v", "items").first().vector == pytest.approx([0.6, 0.8])
    with pytest.raises(S.ContractError):
        store.save_vectors("o", "v", "items", good, 2)
    with pytest.raises(S.ContractError):
        store.save_vectors("o", "v", "items", spark.createDataFrame([("i1", [1.0, 1.0])], "id string, vector array<double>"), 1)


def test_answers_keep_ids_as_strings(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    S.write_answers(spark.createDataFrame([("0001", "00a 00b"), ("0002", "")], "query_id string, answer string"), path)
    assert {tuple(r) for r in S.read_answers(spark, path).collect()} == {("0001", "00a 00b"), ("0002", "")}


def test_log_batch_and_stream(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for k in range(3):
        S.append_log(spark, path, {"exp": f"e{k % 2}", "recall": k / 10})
    (tmp_path / "log" / "blank.txt").write_text("\n \n")
    schema = "exp string, recall double, ts string"
    assert S.read_log(spark, path, schema).count() == 3
    log.append_to(log.follow(spark, path, schema), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    log.append_to(log.follow(spark, path, schema), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_content_hash_ignores_order(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    assert S.content_hash(a) == S.content_hash(a.orderBy("a", ascending=False)) != S.content_hash(a.limit(1))
    (tmp_path / "f").write_bytes(b"abc")
    assert S.file_digests(spark, f"file://{tmp_path}").first().sha256.startswith("ba7816bf")
