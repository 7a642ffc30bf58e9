"""A matrix from counts to clusters and markers, stage by stage.

Two matrices are kept apart: geometry (variable genes, components, neighbours) comes from counts resampled to one depth and
log1p; reports and markers come from log-normalised counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.operators import embedding as E
from siltbed.operators import matrix as X
from siltbed.operators import molecules as M
from siltbed.operators import ranking as R
from siltbed.operators.receptors import gene_class
from siltbed.operators.sampling import resample
from siltbed.operators.summaries import group_means
from siltbed.scratch import stored


@dataclass(frozen=True)
class Settings:
    min_surviving: int = 200
    variable_genes: int = 2000
    components: int = 30
    neighbours: int = 15
    markers: int = 50
    seed: int = 42
    exclude_vdj: bool = True


def analyse(counts: DataFrame, settings: Settings = Settings(), genes: DataFrame | None = None) -> dict[str, DataFrame]:
    """qc, normalised, variable, pcs, neighbours, clusters, means and markers of counts (cell, feature = gene name, value).

    genes (feature) restricts the matrix before anything else. Cells under min_surviving molecules outside mitochondrial,
    ribosomal and receptor genes are left out; the boundary counts.
    """
    if genes is not None:
        counts = M.retain_features(counts, genes)
    kind = gene_class(F.col("feature"))
    classes = {"mito": kind == "mito", "ribo": kind == "ribo"} | ({"vdj": kind == "vdj"} if settings.exclude_vdj else {})
    qc = stored(M.qc(counts, classes), "qc")
    cells = qc.where(F.col("surviving") >= settings.min_surviving).select("cell")
    kept = ["other"] if settings.exclude_vdj else ["other", "vdj"]
    surviving = stored(counts.join(cells, "cell", "left_semi").where(kind.isin(kept)), "surviving")
    normalised = stored(X.log_normalise(surviving, qc.select("cell", F.col("surviving").alias("s"))), "normalised")
    even = resample(surviving, settings.min_surviving, settings.seed).withColumn("value", F.log1p(F.col("value").cast("double")))
    even = stored(even, "resampled")
    moments = X.feature_moments(even.where(gene_class(F.col("feature")) != "vdj"), cells)
    variable = stored(R.variable_features(moments, settings.variable_genes), "variable")
    z = X.zscores(even.join(variable, "feature", "left_semi"), cells)
    order = variable.where("variance > 0").select("feature").orderBy("feature")
    rows = z.join(F.broadcast(order), "feature", "left_semi").groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "z"))), lambda x: x["z"]).alias("v"))
    pcs, _ = E.pca(stored(rows, "z"), "cell", "v", settings.components)
    pcs = stored(pcs, "pcs")
    near = stored(E.knn(pcs, pcs, "cell", "pcs", settings.neighbours), "neighbours")
    clusters = E.communities(E.scaled_graph(near, "cell")).select(F.col("node").alias("cell"), F.col("community").alias("cluster"))
    clusters = stored(clusters, "clusters")
    means = stored(group_means(normalised, clusters, "cluster"), "means")
    return {"qc": qc, "normalised": normalised, "variable": variable, "pcs": pcs, "neighbours": near, "clusters": clusters, "means": means, "markers": X.markers(means, "cluster", settings.markers)}
