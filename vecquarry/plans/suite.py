"""Parameter grids of the suite, for use without configuration files."""

from __future__ import annotations

#: Effort parameters that several grids share.
PROBES = [1, 2, 4, 8, 16, 32, 64, 128, 256, 512]
BEAMS = [10, 20, 30, 40, 50, 60, 80, 100, 150, 200, 300, 400, 500, 600, 800, 1000]
RECALLS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.925, 0.95, 0.97, 0.98, 0.99, 0.995]
DEGREES = [4, 8, 16, 32, 64, 128]


def _algorithm(name: str, constructor: str, groups: dict, base: tuple[str, ...] = ("@metric",), **flags) -> dict:
    return {"name": name, "image": name, "module": name, "constructor": constructor, "base_args": list(base), "run_groups": groups, **flags}


def _lists(args: dict, query: dict) -> dict:
    """A group for each number of lists, with probes up to an eighth of them."""
    return {f"base-{n}": {"args": {"n_list": [n], **args}, "query_args": {"n_probe": [p for p in PROBES if p <= n // 8], **query}} for n in (512, 1024, 2048, 4096)}


def documents() -> list[dict]:
    """Grids of seven families: inverted lists with and without codes, two hierarchical and one fixed-degree graph, trees
    with a recall target, and partitioned scans."""
    graph = {"base": {"args": {"M": [12, 16, 24, 36, 4, 48, 64, 8, 96], "efConstruction": [500]}, "query_args": {"ef": BEAMS}}}
    projected = {"efConstruction": [500], "targetDegree": [32, 64, 128], "projectionLevels": [16, 32, 64, 128], "maxSearchK": [100]}
    scanned = {"index_type": ["tree_sq8"], "num_clusters": [0], "num_meso_clusters": [0], "sampling_fraction": [0.0], "kmeans_iters": [10]}
    fixed = {f"degree-{d}": {"args": {"graph_degree": [d], "intermediate_graph_degree": [i for i in DEGREES if i >= d]}, "query_args": {"itopk": [128, 256, 384, 512], "search_width": [1, 2, 4, 8, 16, 32, 64]}} for d in DEGREES}
    every = [
        _algorithm("hnswlib", "HnswLib", graph),
        _algorithm("ivf(faiss)", "FaissIVF", _lists({}, {})),
        _algorithm("ivfpqfs(faiss)", "FaissIVFPQfs", _lists({"dim_reduction": [0]}, {"k_factor": [0, 2, 4, 8, 16]})),
        _algorithm("mrpt", "MRPT", {"mrpt": {"args": {"count": "@count"}, "query_args": {"target_recall": RECALLS}}}, ood=True),
        _algorithm("pag", "PAG", {"base": {"args": projected, "query_args": {"ef": [100, 150, 200, 300, 400, 500, 600, 800, 1000]}}}),
        _algorithm("pdx", "PDX", {"tree-sq8": {"args": scanned, "query_args": {"n_probe": PROBES}}}, ("@metric", "@dimension")),
        _algorithm("cuvs-cagra", "cuVSCAGRA", fixed, gpu=True),
    ]
    return [{"float": {"any": [a]}} for a in every]
