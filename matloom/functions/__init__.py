"""The public functions, in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame

from matloom.operators.archetypes import analysis as archetypal_analysis  # noqa: F401
from matloom.operators.archetypes import collect as collect_archetypes  # noqa: F401
from matloom.operators.archetypes import merge as merge_archetypes  # noqa: F401
from matloom.operators.archetypes import pipeline as run_archetypes  # noqa: F401
from matloom.operators.archetypes import trace as archetype_trace  # noqa: F401
from matloom.operators.color import node_colors  # noqa: F401
from matloom.operators.convex import archetypes as archetypes_by_passes  # noqa: F401
from matloom.operators.convex import coreset, frank_wolfe  # noqa: F401
from matloom.operators.convex import online as archetypes_of_stream  # noqa: F401
from matloom.operators.coo import aligned, grouped, mean_center, normalize, normalize_graph, normalize_scores, one_hot, rank, robust_zscore, scale, symmetric, tf_idf, times_dense, times_sparse, times_vector, transposed, zscore  # noqa: F401
from matloom.operators.dense import correlations  # noqa: F401
from matloom.operators.density import hdbscan, spanning_tree  # noqa: F401
from matloom.operators.factors import nndsvd, underapproximations  # noqa: F401
from matloom.operators.fuzzy import fuzzy_union, placed, smooth_weights  # noqa: F401
from matloom.operators.graph import centrality, coreness, dense_regions, diffuse, diffuse_chebyshev, diffuse_solved, label_enrichment, propagate, sweep  # noqa: F401
from matloom.operators.knn import approximate as approximate_neighbours  # noqa: F401
from matloom.operators.knn import bipartite as bipartite_network  # noqa: F401
from matloom.operators.knn import build as build_network  # noqa: F401
from matloom.operators.knn import descend as neighbours_of_neighbours  # noqa: F401
from matloom.operators.knn import neighbours  # noqa: F401
from matloom.operators.layout import find_ab, layout  # noqa: F401
from matloom.operators.linalg import deflate, orthogonalize_basal, orthogonalize_batch, perturbed, reduce_kernel, svd  # noqa: F401
from matloom.operators.matching import hungarian  # noqa: F401
from matloom.operators.simplex import regression as simplex_regression  # noqa: F401
from matloom.operators.simplex import spa  # noqa: F401
from matloom.operators.sparse import reduce_kernel as reduce_kernel_sparse  # noqa: F401
from matloom.operators.sparse import svd as svd_sparse  # noqa: F401
from matloom.operators.stats import geary, label_weights, marker_scores, moran, moran_parametric, permuted, rank_one_match, set_enrichment, set_enrichments, signature, specificity, xicor, xicor_matrix  # noqa: F401
from matloom.operators.views import consensus  # noqa: F401


def network_diffusion(g: DataFrame, nodes: DataFrame, x0: DataFrame, alpha: float = 0.85, rounds: int = 5, approx: bool = False, method: int = 0, tol: float = 1e-8) -> DataFrame:
    """Diffusion of seeds, exactly or by Chebyshev's recurrence; the latter does not make the seeds sum to one, so the two differ in scale."""
    return diffuse_chebyshev(g, nodes, x0, alpha, rounds, method, tol) if approx else diffuse(g, nodes, x0, alpha, rounds, method)


def marker_signature(s: DataFrame, x: DataFrame, ids: DataFrame, m: int, g: DataFrame | None = None, alpha: float = 0.85, rounds: int = 5, method: int = 2) -> DataFrame:
    """Depth-adjusted marker scores, spread over a graph where one is given and alpha is not 0."""
    z = signature(s, x, ids, m)
    return diffuse(g, ids, z, alpha, rounds, method) if g is not None and alpha else z


def clamp_to_simplex(x: DataFrame, by: str = "id") -> DataFrame:
    """Entries clamped to [0, 1], then divided by their group's sum."""
    from pyspark.sql import functions as F

    return normalize(x.withColumn("value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "value"))), by)


def binarize(m: DataFrame) -> DataFrame:
    """Ones where entries are not zero."""
    from pyspark.sql import functions as F

    return m.where("value <> 0").withColumn("value", F.lit(1.0))
