"""The configurations of the suite by name, as members of the eight index families."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from vecquarry.operators.index import IVF, AxisCodes, Flat, Graph, Hashing, Index, LowRank, ProductCodes, ScalarCodes, SignCodes, Trees

FLOAT = ("euclidean", "cosine", "normalized", "ip")
ANGLE = ("cosine", "normalized", "ip")


@dataclass(frozen=True)
class Entry:
    """build: (metric, build arguments by name) -> Index; query: query arguments by name -> those of the family."""

    family: str
    metrics: tuple[str, ...]
    build: Callable[[str, dict], Index]
    query: Callable[[dict], dict]
    #: Needs a sample of queries with their neighbours.
    ood: bool = False
    #: Answers queries in batches on a GPU in the suite; here like the others.
    gpu: bool = False


def _ivf(codes: Callable[[dict], object] | None = None, lists: str = "n_list", probe: str = "n_probe") -> dict:
    return {
        "build": lambda m, a: IVF(metric=m, n_list=a.get(lists) or 64, codes=codes(a) if codes else None),
        "query": lambda a: {"n_probe": a.get(probe, 1), **({"k_factor": a["k_factor"]} if "k_factor" in a else {})},
    }


def _graph(degree: str, beam: str, codes: Callable[[dict], object] | None = None, descent: int = 0, alpha: str = "alpha", bipartite: bool = False) -> dict:
    return {
        "build": lambda m, a: Graph(metric=m, degree=a.get(degree, 16), alpha=max(1.0, a.get(alpha) or 1.0), candidates=_wider(a), codes=codes(a) if codes else None, descent=descent, bipartite=bipartite),
        "query": lambda a: {"beam": int(a.get(beam, 32))},
    }


#: Most neighbours among which pruning chooses, whatever effort of construction is asked for.
MOST_CANDIDATES = 128


def _wider(a: dict) -> int:
    """Neighbours among which pruning chooses: the effort of construction, by its names in the suite."""
    return min(MOST_CANDIDATES, max([int(a[n]) for n in ("efConstruction", "ef_construction", "complexity", "L", "intermediate_graph_degree") if a.get(n)], default=0))


def _axes(a: dict) -> AxisCodes:
    return AxisCodes(a.get("reduced_dimensions") or a.get("leanvec_dims") or 16)


def _anisotropic(a: dict) -> ProductCodes:
    return ProductCodes(words=16, block=a.get("dims_per_block", 2), threshold=a.get("avq_threshold", 0.2))


def _sq(a: dict) -> ScalarCodes:
    return ScalarCodes(8)


def _pq(a: dict) -> ProductCodes:
    return ProductCodes(a.get("parts", 16), 16, bool(a.get("dim_reduction")))


def _bits(a: dict) -> SignCodes:
    return SignCodes()


def _turned(a: dict) -> ScalarCodes:
    return ScalarCodes(a.get("n_bits", 4), rotate=True)


_trees = {"build": lambda m, a: Trees(metric=m, trees=a.get("n_trees", 8), depth=a.get("depth", 5)), "query": lambda a: {"target_recall": a["target_recall"]} if "target_recall" in a else {"votes": a.get("votes", 1)}}
_lorann = {
    "build": lambda m, a: LowRank(metric=m, rank=a.get("global_dim") or 16, n_list=a.get("n_clusters", 64)),
    "query": lambda a: {"n_probe": a.get("clusters_to_search", 8), "rerank": a.get("points_to_rerank", 100)},
}
_hash = {"build": lambda m, a: Hashing(metric=m, tables=a.get("numTables", 8), bits=a.get("bits", 8)), "query": lambda a: {"recall": a["recall"]} if "recall" in a else {"probes": a.get("qProbes", 4)}}

REGISTRY: dict[str, Entry] = {
    "flat(faiss)": Entry("flat", (*FLOAT, "hamming"), lambda m, a: Flat(metric=m), lambda a: {}),
    "bruteforce(cuvs)": Entry("flat", FLOAT, lambda m, a: Flat(metric=m), lambda a: {}, gpu=True),
    "ivf(faiss)": Entry("ivf", (*FLOAT, "hamming"), **_ivf()),
    "ivfsq(faiss)": Entry("ivf", FLOAT, **_ivf(_sq)),
    "ivfpqfs(faiss)": Entry("ivf", FLOAT, **_ivf(_pq)),
    "ivfrabitq(faiss)": Entry("ivf", FLOAT, **_ivf(_bits)),
    "ivftq(faiss)": Entry("ivf", FLOAT, **_ivf(_turned)),
    "hnsw(faiss)": Entry("graph", (*FLOAT, "hamming"), **_graph("M", "ef")),
    "hnswq(faiss)": Entry("graph", FLOAT, **_graph("M", "ef", _sq)),
    "nsg(faiss)": Entry("graph", FLOAT, **_graph("degree", "search_L", descent=4)),
    "nsgq(faiss)": Entry("graph", FLOAT, **_graph("degree", "search_L", _sq, descent=4)),
    "annoy": Entry("trees", (*FLOAT, "hamming"), **_trees),
    "mrpt": Entry("trees", ("euclidean", "cosine", "normalized"), **_trees),
    "mlann-rf": Entry("trees", FLOAT, lambda m, a: Trees(metric=m, trees=a.get("n_trees", 8), depth=a.get("depth", 5), supervised=True), lambda a: {"votes": a.get("voting_threshold", 1)}, ood=True),
    "falconnpp": Entry("hashing", ANGLE, **_hash),
    "puffinn": Entry("hashing", ("cosine", "normalized"), **_hash),
    "hnswlib": Entry("graph", FLOAT, **_graph("M", "ef")),
    "flatnav": Entry("graph", FLOAT, **_graph("max_edges_per_node", "ef")),
    "glass": Entry("graph", FLOAT, **_graph("R", "ef", _sq)),
    "vamana(diskann)": Entry("graph", FLOAT, **_graph("graph_degree", "search_complexity")),
    "vamana(parlayann)": Entry("graph", FLOAT, **_graph("R", "Q")),
    "vamana(svs)": Entry("graph", FLOAT, **_graph("degree", "search_window_size")),
    "vamana-lvq(svs)": Entry("graph", FLOAT, **_graph("degree", "search_window_size", _sq)),
    "vamana-leanvec(svs)": Entry("graph", FLOAT, **_graph("degree", "search_window_size", _axes)),
    "ngt-qg": Entry("graph", FLOAT, **_graph("degree", "result_expansion", _pq)),
    "ngt-onng": Entry("graph", (*FLOAT, "hamming"), **_graph("out", "edge_size")),
    "pynndescent": Entry("graph", (*FLOAT, "hamming"), **_graph("n_neighbors", "beam", descent=6)),
    "roargraph": Entry("graph", ANGLE, **_graph("M_pjbp", "L_pq", bipartite=True), ood=True),
    "symphonyqg": Entry("graph", ("euclidean", "cosine", "normalized"), **_graph("degree_bound", "beam_size", _bits)),
    "ivf(rabitq)": Entry("ivf", FLOAT, **_ivf(_bits, "num_clusters", "nprobe")),
    "hnsw(rabitq)": Entry("graph", FLOAT, **_graph("M", "ef", _bits)),
    "symqg(rabitq)": Entry("graph", FLOAT, **_graph("degree_bound", "beam_size", _bits)),
    "pag": Entry("graph", FLOAT, **_graph("targetDegree", "ef")),
    "pdx": Entry("ivf", FLOAT, **_ivf(_sq, "num_clusters")),
    "scann": Entry("ivf", FLOAT, lambda m, a: IVF(metric=m, n_list=a.get("n_leaves", 64), codes=_anisotropic(a)), lambda a: {"n_probe": a.get("leaves_to_search", 1), "k_factor": a.get("reorder", 4)}),
    "lorann": Entry("lowrank", FLOAT, **_lorann),
    "lorann(gpu)": Entry("lowrank", FLOAT, **_lorann, gpu=True),
    "cuvs-ivf": Entry("ivf", FLOAT, **_ivf(), gpu=True),
    "cuvs-ivfpq": Entry("ivf", FLOAT, **_ivf(_pq), gpu=True),
    "cuvs-cagra": Entry("graph", FLOAT, **_graph("graph_degree", "itopk_size"), gpu=True),
    "ivf(faiss-gpu)": Entry("ivf", FLOAT, **_ivf(), gpu=True),
    "ivfpq(faiss-gpu)": Entry("ivf", FLOAT, **_ivf(_pq), gpu=True),
    "ggnn": Entry("graph", ("euclidean", "cosine", "normalized"), **_graph("k_build", "max_iterations"), gpu=True),
    "jasper": Entry("graph", FLOAT, **_graph("n_neighbors", "beam_size"), gpu=True),
    "jasper-cph": Entry("graph", FLOAT, **_graph("n_neighbors", "beam_size", _bits), gpu=True),
    "jasper-pq": Entry("graph", FLOAT, **_graph("n_neighbors", "beam_size", _pq), gpu=True),
}


def instantiate(name: str, metric: str, build: dict | None = None) -> Index:
    """The index of a configuration; an unknown name or a metric it does not serve is an error."""
    if name not in REGISTRY:
        raise ValueError(f"no configuration {name}")
    entry = REGISTRY[name]
    if metric not in entry.metrics:
        raise ValueError(f"{name} does not serve {metric}")
    return entry.build(metric, build or {})


def available(name: str) -> bool:
    return name in REGISTRY
