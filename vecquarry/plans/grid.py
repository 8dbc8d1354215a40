"""From configuration documents to the runs that are still to be done, as DataFrames.

A document is point type -> metric (or any) -> list of algorithms. Driver-side code only reads the documents; expansion of
the parameter grids, substitution, merging and filtering are Spark operations on one row per algorithm and group.
"""

from __future__ import annotations

import glob
import json
import os
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecquarry.functions.names import marker, slug

NEEDED = ["image", "module", "constructor"]
SPEC = (
    "point_type string, metric string, name string, source int, place int, image string, module string, constructor string, disabled boolean, ood boolean, gpu boolean, "
    "base array<string>, grp string, slots array<array<string>>, query_slots array<array<string>>"
)


def load(folder: str, skip: tuple[str, ...] = ("base",)) -> list[dict]:
    """The config.yml documents of the sub-folders in order of name, without `skip`; what is no YAML is left out with a message."""
    import yaml

    out = []
    for path in sorted(glob.glob(os.path.join(folder, "*", "config.yml"))):
        if os.path.basename(os.path.dirname(path)) in skip:
            continue
        try:
            with open(path) as f:
                out.append(yaml.safe_load(f) or {})
        except yaml.YAMLError as e:
            print(f"{path} is left out: {e}")
    return out


def _listed(value: Any) -> list:
    return value if isinstance(value, list) else [value]


def slots_of(spec: Any, plain: bool = True) -> list[list[str]]:
    """A parameter grid as slots, each with its alternatives as JSON. A mapping has a slot per key, in their order; a list
    one per element, a scalar being its only alternative. A mapping among the alternatives becomes the list of its values
    (unless plain is off)."""
    if isinstance(spec, dict):
        return [[json.dumps(v, sort_keys=True) for v in _listed(values)] for values in spec.values()]
    if isinstance(spec, list):
        flat = lambda v: list(v.values()) if plain and isinstance(v, dict) else v
        return [[json.dumps(flat(v), sort_keys=True) for v in _listed(values)] for values in spec]
    raise TypeError(f"a grid is a list or a mapping, not {type(spec).__name__}")


def _grouped(groups: list) -> list[list[str]]:
    """Slots of argument groups: a mapping stands for all combinations of its values."""
    from itertools import product

    spread = [[dict(zip(g, c)) for c in product(*map(_listed, g.values()))] if isinstance(g, dict) else g for g in groups]
    return slots_of(spread, plain=False)


def rows_of(documents: list[dict]) -> list[tuple]:
    """One row per algorithm and run group of the documents (SPEC)."""
    out = []
    for source, document in enumerate(documents):
        for point_type, metrics in document.items():
            for metric, algorithms in metrics.items():
                for place, a in enumerate(algorithms):
                    a = {"image" if k == "singularity_image" else k: v for k, v in a.items()}
                    if missing := [p for p in NEEDED if p not in a]:
                        raise ValueError(f"{a['name']} lacks {', '.join(missing)}")
                    for group, g in a["run_groups"].items():
                        if "args" not in g and "arg_groups" not in g:
                            raise ValueError(f"{a['name']}: {group} has no args")
                        slots = _grouped(g["arg_groups"]) if "arg_groups" in g else slots_of(g["args"])
                        queries = _grouped(g["query_arg_groups"]) if "query_arg_groups" in g else slots_of(g["query_args"]) if "query_args" in g else None
                        out.append(
                            (point_type, metric, a["name"], source, place, a["image"], a["module"], a["constructor"], a.get("disabled", False), a.get("ood", False), a.get("gpu", False), [json.dumps(v) for v in a.get("base_args", [])], str(group), slots, queries)
                        )
    return out


def specifications(spark: SparkSession, documents: list[dict]) -> DataFrame:
    return spark.createDataFrame(rows_of(documents), SPEC)


def merged(specs: DataFrame, point_type: str, metric: str) -> DataFrame:
    """The algorithms of a point type and metric: those for any metric, then the metric's own, of equal names the last."""
    rows = specs.filter((F.col("point_type") == point_type) & F.col("metric").isin("any", metric))
    order = F.struct("source", F.col("metric") != "any", "place")
    last = rows.groupBy("name").agg(F.max(order).alias("__last"))
    return rows.join(last, "name").filter(order == F.col("__last")).drop("__last")


def combinations(slots: Column) -> Column:
    """All ways to take one alternative per slot, the last slot changing fastest."""
    none = F.array(F.array().cast("array<string>"))
    return F.aggregate(slots, none, lambda done, slot: F.flatten(F.transform(done, lambda d: F.transform(slot, lambda v: F.concat(d, F.array(v))))))


def substitute(argument: Column, values: dict[str, Any]) -> Column:
    """Strings that are a variable's name, anywhere in the JSON but as keys, become its value."""
    for name, value in values.items():
        argument = F.regexp_replace(argument, rf'"{name}"(?!\s*:)', json.dumps(value))
    return argument


def definitions(specs: DataFrame, point_type: str, metric: str, dimension: int, count: int) -> DataFrame:
    """(algorithm, image, module, constructor, disabled, ood, gpu, arguments, query_arguments): one row per combination of
    build arguments, each with all combinations of query arguments."""
    values = {"@count": count, "@metric": metric, "@dimension": dimension}
    rows = merged(specs, point_type, metric).withColumn("a", F.explode(combinations(F.col("slots"))))
    arguments = F.transform(F.concat("base", "a"), lambda x: substitute(x, values))
    queries = F.when(F.col("query_slots").isNull(), F.array().cast("array<array<string>>")).otherwise(combinations(F.col("query_slots")))
    return rows.select(F.col("name").alias("algorithm"), "image", "module", "constructor", "disabled", "ood", "gpu", arguments.alias("arguments"), queries.alias("query_arguments"))


def json_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))


def runs(defs: DataFrame, dataset: str, count: int, gpu: bool = False) -> DataFrame:
    """defs with a row per query combination: query, path (folder of the results), parameters and marker. Without query
    arguments there is one run with none."""
    each = defs.withColumn("query", F.explode_outer("query_arguments")).drop("query_arguments")
    name = F.concat("algorithm", F.lit("-gpu" if gpu else ""))
    path = F.concat_ws("/", F.lit("results"), F.lit(dataset), F.lit(str(count)), name, slug(json_list(F.col("arguments"))))
    parameters = F.when(F.col("query").isNotNull(), slug(json_list(F.col("query"))))
    return each.withColumns({"path": path, "parameters": parameters}).withColumn("marker", F.when(F.col("parameters") != "", marker(F.col("parameters"))))


def unfinished(all_runs: DataFrame, finished: DataFrame) -> DataFrame:
    """Runs not in finished (path, marker). A run without parameters is finished once its path is there."""
    paths = finished.select("path").distinct()
    marked = finished.select("path", "marker").filter("marker IS NOT NULL").distinct()
    with_marker = all_runs.filter("marker IS NOT NULL").join(marked, ["path", "marker"], "left_anti")
    return with_marker.unionByName(all_runs.filter("marker IS NULL").join(paths, "path", "left_anti"))


def chosen(
    defs: DataFrame, *, module: str | None = None, algorithm: str | None = None, available: DataFrame | None = None, run_disabled: bool = False, limit: int = -1, gpu: bool = False, seed: int = 1
) -> DataFrame:
    """The definitions to run: shuffled by a seed, filtered by module, algorithm, available images (image) and disabled
    ones, limited (negative: all), and only then by device, so that a limit may leave fewer."""
    rows = defs if module is None else defs.filter(F.col("module") == module)
    rows = rows if algorithm is None else rows.filter(F.col("algorithm") == algorithm)
    rows = rows if available is None else rows.join(available.select("image").distinct(), "image", "left_semi")
    rows = rows if run_disabled else rows.filter(~F.col("disabled"))
    if limit >= 0:
        rows = rows.orderBy(F.xxhash64("algorithm", json_list(F.col("arguments")), F.lit(seed)), "algorithm", json_list(F.col("arguments"))).limit(limit)
    return rows.filter(F.col("gpu") if gpu else ~F.col("gpu"))


def missing_images(defs: DataFrame, available: DataFrame) -> DataFrame:
    return defs.select("image").distinct().join(available.select("image"), "image", "left_anti")


def capabilities(specs: DataFrame) -> DataFrame:
    """(name, point_type, metrics)"""
    once = specs.groupBy("name", "point_type", "metric").agg(F.min(F.struct("source", "place")).alias("at"))
    return once.groupBy("name", "point_type").agg(F.array_sort(F.collect_list("metric")).alias("metrics"))


def evaluation_counts(defs: DataFrame) -> DataFrame:
    """(algorithm, definitions, evaluations): how many there are and how many with their query arguments."""
    return defs.groupBy("algorithm").agg(F.count("*").alias("definitions"), F.sum(F.greatest(F.size("query_arguments"), F.lit(1))).alias("evaluations"))


def replaced(df: DataFrame, **fields: Any) -> DataFrame:
    """df with columns replaced; a column that is not there is an error."""
    if unknown := set(fields) - set(df.columns):
        raise TypeError(f"no columns {', '.join(sorted(unknown))}")
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()})


def keep_last(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
