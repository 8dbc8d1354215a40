"""python -m vecquarry run | build | export | list: the suite from a command line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecquarry.plans import export, grid, runner, suite
from vecquarry.session import local_session, materialize
from vecquarry.sources import recipes
from vecquarry.sources.datasets import read_dataset, read_learn, write_results


def positive(text: str) -> int:
    number = int(text)
    if number < 1:
        raise argparse.ArgumentTypeError(f"{text} is not above 0")
    return number


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vecquarry", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    shown = commands.add_parser("list", help="names of algorithms, with their point types and metrics, and of datasets")
    run = commands.add_parser("run", help="run what is not finished of a grid on a dataset")
    for p in (shown, run):
        p.add_argument("--definitions", metavar="FOLDER", help="folder of */config.yml; without it the built-in grids")
    run.add_argument("--dataset", required=True, metavar="NAME")
    run.add_argument("--data", default="data", metavar="FOLDER", help="where datasets are")
    run.add_argument("--results", default="results", metavar="FOLDER")
    run.add_argument("-k", "--count", type=positive, default=100, help="neighbours to search for")
    run.add_argument("--algorithm", metavar="NAME")
    run.add_argument("--module", metavar="NAME")
    run.add_argument("--force", action="store_true", help="run again what is finished")
    run.add_argument("--runs", type=positive, default=5, help="times each search is run; the best counts")
    run.add_argument("--gpu", action="store_true", help="algorithms of the batch mode")
    run.add_argument("--max-n-algorithms", type=int, default=-1, help="definitions to run; below 0: all")
    run.add_argument("--run-disabled", action="store_true")
    run.add_argument("--dry", action="store_true", help="show what would run")
    built = commands.add_parser("build", help="derive a quantized dataset from one that is there")
    built.add_argument("--dataset", required=True, metavar="NAME")
    built.add_argument("--data", default="data", metavar="FOLDER")
    built.add_argument("-k", "--count", type=positive, default=100)
    out = commands.add_parser("export", help="summary and detail of all results")
    out.add_argument("--results", default="results", metavar="FOLDER")
    out.add_argument("--data", default="data", metavar="FOLDER")
    out.add_argument("--datasets", nargs="+", required=True, metavar="NAME")
    out.add_argument("--output", default="export", metavar="FOLDER")
    return top


def specifications(spark: SparkSession, folder: str | None) -> DataFrame:
    return grid.specifications(spark, grid.load(folder) if folder else suite.documents())


def planned(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The runs of a command line: (algorithm, arguments, query, path, parameters, marker, ...)."""
    dimension, metric, point = recipes.shape(args.dataset)
    defs = grid.definitions(specifications(spark, args.definitions), point, metric, dimension, args.count)
    chosen = grid.chosen(defs, module=args.module, algorithm=args.algorithm, run_disabled=args.run_disabled, limit=args.max_n_algorithms, gpu=args.gpu)
    runs = grid.runs(chosen, args.dataset, args.count, args.gpu)
    if args.force:
        return runs
    done = export._read(spark, f"{args.results}/finished")
    return runs if done is None else grid.unfinished(runs, done.select("path", "marker"))


def named(name: str, given: list, slots: list[str]) -> dict:
    """Arguments by name: those after the base arguments, in the order of the grid's keys."""
    return dict(zip(slots, given[len(given) - len(slots) :])) if slots else {}


def _keys(documents: list[dict]) -> dict[str, tuple[list[str], list[str]]]:
    """The names of the build and query arguments of each algorithm whose grids are mappings."""
    out = {}
    for document in documents:
        for metrics in document.values():
            for algorithms in metrics.values():
                for a in algorithms:
                    g = next(iter(a["run_groups"].values()))
                    out[a["name"]] = tuple(list(g.get(n, {})) if isinstance(g.get(n), dict) else [] for n in ("args", "query_args"))
    return out


def run_all(spark: SparkSession, args: argparse.Namespace) -> int:
    runs = planned(spark, args)
    if args.dry:
        runs.select("algorithm", "path", "parameters").orderBy("path", "parameters").show(1000, truncate=False)
        return 0
    _, metric, _ = recipes.shape(args.dataset)
    path = f"{args.data}/{args.dataset}"
    train, test, _ = read_dataset(spark, path)
    learn, near = read_learn(spark, path)
    learn = None if learn is None else learn.withColumnRenamed("vec_id", "qid")
    near = None if near is None else near.withColumnRenamed("learn_id", "qid")
    queries = materialize(test.select(F.col("vec_id").alias("qid"), "embedding"))
    keys, failed = _keys(grid.load(args.definitions) if args.definitions else suite.documents()), 0
    todo = runs.groupBy("algorithm", "path", "arguments").agg(F.collect_list(F.struct("query", "parameters", "marker")).alias("queries")).orderBy("path").collect()  # the plan, a row per definition
    for d in todo:
        try:
            own, asked = keys.get(d["algorithm"], ([], []))
            index, seconds = runner.build(d["algorithm"], metric, named(d["algorithm"], [json.loads(a) for a in d["arguments"]], own), train, learn, near)
            size = runner.index_size(index)
            for q in d["queries"]:
                done = runner.run(index, d["algorithm"], named(d["algorithm"], [json.loads(a) for a in q["query"] or []], asked), queries, args.count, seconds, args.runs)
                rows = runner.padded(done.results, queries, args.count)
                facts = {"dataset": args.dataset, "k": args.count, "algorithm": d["algorithm"], "run": q["marker"] or "none", "params": q["parameters"] or "", "best_search_time": done.best_search_time, "build_time": seconds, "index_size": size}
                write_results(rows.withColumns({n: F.lit(v) for n, v in facts.items()}).withColumn("time", F.lit(done.best_search_time)), f"{args.results}/raw")
                spark.createDataFrame([(d["path"], q["marker"])], "path string, marker string").write.mode("append").parquet(f"{args.results}/finished")
        except (ValueError, NotImplementedError) as e:  # one definition that cannot run does not stop the others
            failed += 1
            print(f"{d['path']}: {e}")
    return failed


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or local_session()
    if args.command == "list":
        grid.capabilities(specifications(spark, args.definitions)).orderBy("name").show(1000, truncate=False)
        recipes.recipes(spark).orderBy("dataset").show(1000, truncate=False)
        return 0
    if args.command == "build":
        recipes.build(spark, args.data, args.dataset, count=args.count)
        return 0
    if args.command == "export":
        truth = None
        for name in args.datasets:
            one = spark.read.parquet(f"{args.data}/{name}/neighbours").select(F.lit(name).alias("dataset"), "qid", "rank", "distance")
            truth = one if truth is None else truth.unionByName(one)
        export.export(spark, f"{args.results}/raw", truth, args.output).skipped.show(1000, truncate=False)
        return 0
    return run_all(spark, args)


if __name__ == "__main__":
    raise SystemExit(main())
