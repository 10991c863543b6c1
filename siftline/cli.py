"""python -m siftline COMMAND ...: the pipeline and its evaluation from the command line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftline.operators import evaluation as E
from siftline.plans import split_build
from siftline.plans.workflow import Search
from siftline.sources import tables


def _channels(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split("/", 1)) for x in text.split(",")]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftline")
    p.add_argument("--store", required=True, help="folder of the tables")
    p.add_argument("--keys", help="Parquet table (key, kind) of further parameter keys")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("bm25", "bm25f", "dense"):
        c = sub.add_parser(name, help=f"build the {name} channel")
        c.add_argument("split")
        c.add_argument("--owner", default="baseline")
        c.add_argument("--name", default=name)
        c.add_argument("--alpha", type=float)
        c.add_argument("--k", type=int, default=2000)
        if name == "dense":
            c.add_argument("--vectors", required=True, help="owner/name of the vectors")
    c = sub.add_parser("split", help="build the evaluation and training splits")
    c.add_argument("--dry-run", action="store_true", help="print the manifest, write nothing")
    c.add_argument("--force", action="store_true", help="replace a split that differs")
    c.add_argument("--evaluation", type=int, default=2000, help="searches of val and of test")
    c.add_argument("--ranker", type=int, default=6000, help="searches of rtrain")
    c.add_argument("--seed", type=int, default=1)
    c = sub.add_parser("geo", help="publish the smoothed geography table")
    c.add_argument("split")
    c.add_argument("out")
    c = sub.add_parser("params", help="publish the items' structured parameters")
    c.add_argument("out")
    c = sub.add_parser("filters", help="publish the queries' filters")
    c.add_argument("split")
    c.add_argument("out")
    c = sub.add_parser("train", help="train the ranker")
    c.add_argument("--channels", type=_channels, required=True)
    c.add_argument("--models", required=True)
    c.add_argument("--rounds", type=int, default=200)
    c = sub.add_parser("predict", help="answer a split's queries")
    c.add_argument("split")
    c.add_argument("out")
    c.add_argument("--channels", type=_channels, required=True)
    c.add_argument("--models", required=True)
    for name in ("answer", "pool"):
        c = sub.add_parser(name, help=f"score an {name}")
        c.add_argument("file")
        c.add_argument("split")
        c.add_argument("--log")
        c.add_argument("--exp", default="")
    c = sub.add_parser("compare", help="paired comparison of two answers")
    c.add_argument("a")
    c.add_argument("b")
    c.add_argument("split")
    c = sub.add_parser("check", help="validate an answer file")
    c.add_argument("file")
    c.add_argument("split", nargs="?", default="bench")
    c = sub.add_parser("board", help="the latest record of each experiment in a log")
    c.add_argument("log")
    sub.add_parser("artifacts", help="list artifacts")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("siftline").getOrCreate()
    store = tables.Store(spark, a.store)
    extra = {r.key: r.kind for r in spark.read.parquet(a.keys).select("key", "kind").collect()} if a.keys else None
    search = Search(store, extra)
    if a.command in ("bm25", "bm25f", "dense"):
        given = {} if a.alpha is None else {"alpha": a.alpha}
        build = {"bm25": search.bm25_channel, "bm25f": search.bm25f_channel, "dense": lambda s, **k: search.dense_channel(s, *a.vectors.split("/", 1), **k)}[a.command]
        store.save_channel(a.owner, a.name, a.split, build(a.split, k=a.k, **given))
        store.save_meta(a.owner, a.name, "channel", a.command, fit_only=False)
    elif a.command == "split":
        plan = split_build.Plan(rounds=({"val": a.evaluation, "test": a.evaluation}, {"rtrain": a.ranker}), seed=a.seed)
        done, manifest = split_build.build_in_store(store, plan, write=not a.dry_run, force=a.force)
        print(json.dumps({"split": done, **manifest}, ensure_ascii=False))
    elif a.command == "geo":
        search.geo_table(a.split).write.mode("overwrite").parquet(a.out)
    elif a.command == "params":
        search.items_params().write.mode("overwrite").parquet(a.out)
    elif a.command == "filters":
        search.query_filters(a.split).write.mode("overwrite").parquet(a.out)
    elif a.command == "train":
        models, names = search.train(a.channels, rounds=a.rounds)
        for j, model in enumerate(models):
            model.write().overwrite().save(f"{a.models}/{j}")
        spark.createDataFrame([(json.dumps({"features": names, "models": len(models)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.models}/about")
    elif a.command == "predict":
        about = json.loads(spark.read.text(f"{a.models}/about").first().value)
        models = [PipelineModel.load(f"{a.models}/{j}") for j in range(about["models"])]
        tables.write_answers(search.predict(a.split, a.channels, models, about["features"]), a.out)
    elif a.command == "answer":
        result = search.score(tables.read_answers(spark, a.file), a.split)
        print(json.dumps(result, ensure_ascii=False))
        if a.log:
            tables.append_log(spark, a.log, {"exp": a.exp, "split": a.split, "kind": "answer", **{k: v for k, v in result.items() if k != "segments"}})
    elif a.command == "pool":
        curve = E.recall_curve(store.qrels(a.split), spark.read.parquet(a.file), [50, 100, 200, 500, 1000, 2000]).first().asDict()
        print(json.dumps(curve))
        if a.log:
            tables.append_log(spark, a.log, {"exp": a.exp, "split": a.split, "kind": "pool", **curve})
    elif a.command == "compare":
        print(json.dumps(search.compare(tables.read_answers(spark, a.a), tables.read_answers(spark, a.b), a.split)))
    elif a.command == "check":
        rules = E.check_answer(tables.read_answers(spark, a.file), store.queries(a.split), store.corpus(["item_id"]), strict=a.split == "bench").where("n > 0").collect()
        for r in rules:
            print(f"{r.severity}: {r.rule}: {r.n}")
        return int(any(r.severity == "error" for r in rules))
    elif a.command == "board":
        log = tables.read_log(spark, a.log)
        E.latest(log, ["exp", "split", "kind"], [F.desc("ts") if "ts" in log.columns else F.desc("id")]).orderBy(F.desc("recall") if "recall" in log.columns else "exp").show(100, False)
    elif a.command == "artifacts":
        store.catalog().show(100, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
