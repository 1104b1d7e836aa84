"""Track graphs: vertices are elements with ids, edges their exploded links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import IncompatibleTracksError, NotSupportedError

MOST_MATRIX_NODES = 5_000


def edge_list(track: DataFrame, undirected: bool = False) -> DataFrame:
    """(src, dst, weight) of all links; of an undirected graph each link once (src <= dst)."""
    weights = F.col("weights") if "weights" in track.columns else F.transform("edges", lambda _: F.lit(None).cast("double"))
    rows = track.select(F.col("id").alias("src"), F.explode(F.arrays_zip(F.col("edges").alias("dst"), weights.alias("weight"))).alias("e"))
    rows = rows.select("src", F.col("e.dst").alias("dst"), F.col("e.weight").alias("weight")).where(F.col("dst").isNotNull() & (F.col("dst") != ""))
    return rows.where(F.col("src") <= F.col("dst")) if undirected else rows


def edge_key(undirected: bool):
    """Identity of an edge: ordered ends, or sorted ones if undirected."""
    ends = (F.least("src", "dst"), F.greatest("src", "dst")) if undirected else (F.col("src"), F.col("dst"))
    return F.struct(ends[0].alias("a"), ends[1].alias("b"), F.col("weight").alias("weight"))


def closed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (column ``id``)."""
    ids = nodes.select("id").where(F.col("id").isNotNull()).distinct()
    return edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")


def subgraph(nodes: DataFrame, edges: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """Induced sub-graph of the nodes that meet the condition ``keep``."""
    kept = nodes.where(keep)
    return kept, closed(edges, kept)


def neighbours(edges: DataFrame, nodes: DataFrame, undirected: bool = False) -> DataFrame:
    """(id, neighbour, weight) inside the node set."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "weight")
    if undirected:
        back = edges.where(F.col("src") != F.col("dst")).select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), "weight")
        out = out.unionByName(back)
    ids = nodes.select(F.col("id").alias("__id")).distinct()
    return out.join(ids, out["id"] == F.col("__id"), "left_semi").join(ids, out["neighbour"] == F.col("__id"), "left_semi")


def weight_matrix(edges: DataFrame, complete: bool = False, rows_as_from: bool = True, missing: float = 0.0) -> DataFrame:
    """Long form (row_id, col_id, weight) of the matrix; of repeated edges the largest weight.

    ``complete`` lists the absent cells too, one row of cells per node: for graphs whose node
    number is small, since a complete matrix has its square in cells."""
    r, c = ("src", "dst") if rows_as_from else ("dst", "src")
    cells = edges.groupBy(F.col(r).alias("row_id"), F.col(c).alias("col_id")).agg(F.max("weight").alias("weight"))
    if not complete:
        return cells
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    if nodes.count() > MOST_MATRIX_NODES:
        raise NotSupportedError(f"a complete matrix is for at most {MOST_MATRIX_NODES} nodes")
    ids = nodes.agg(F.array_sort(F.collect_list("id")).alias("ids"))
    grid = ids.select(F.explode("ids").alias("row_id"), "ids").select("row_id", F.explode("ids").alias("col_id"))
    return grid.join(cells, ["row_id", "col_id"], "left").withColumn("weight", F.coalesce("weight", F.lit(missing)))


def binary_matrix(edges: DataFrame, rows_as_from: bool = True) -> DataFrame:
    return weight_matrix(edges, rows_as_from=rows_as_from).select("row_id", "col_id", F.lit(1).alias("weight"))


def merge_graphs(*graphs: DataFrame, undirected: tuple[bool, ...] = ()) -> DataFrame:
    """Union of node sets; of nodes with one id the one of the last graph stays. ``undirected`` may
    say of each graph whether it is: they must agree."""
    if len(set(undirected)) > 1:
        raise IncompatibleTracksError("directed and undirected graphs can't be merged")
    tagged = None
    for i, g in enumerate(graphs):
        g = g.withColumn("__g", F.lit(i))
        tagged = g if tagged is None else tagged.unionByName(g, allowMissingColumns=True)
    # With partial aggregation: no id gathers its nodes in one task. Null ids are one node.
    columns = [c for c in tagged.columns if c != "__g"]
    return tagged.groupBy(F.col("id").alias("__id")).agg(F.max_by(F.struct(*columns), "__g").alias("r")).select("r.*")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is no node."""
    ids = nodes.select(F.col("id").alias("__id")).distinct()
    return edges.join(ids, edges["dst"] == F.col("__id"), "left_anti")


def asymmetric(edges: DataFrame) -> DataFrame:
    """Edges without a counterpart of equal weight, self-links apart (NaN equals NaN)."""
    back = edges.select(F.col("dst").alias("__s"), F.col("src").alias("__d"), F.col("weight").alias("__w")).distinct()
    on = (F.col("src") == F.col("__s")) & (F.col("dst") == F.col("__d")) & F.col("weight").eqNullSafe(F.col("__w"))
    return edges.where(F.col("src") != F.col("dst")).join(back, on, "left_anti")


def random_node(nodes: DataFrame, seed: int) -> DataFrame:
    return nodes.orderBy(F.xxhash64(F.col("id"), F.lit(seed)), "id").limit(1)
