"""Hierarchical clusters by density: mutual reachability, its minimum spanning tree, the condensed tree and what is stable in it.

The tree grows by rounds: each component takes its lightest edge to another one, out of all pairs. Where lists of the nearest rows already tell which that is, nothing is looked through; else the rows that may have a lighter edge are held
against all others in a grid of blocks, as for exact neighbours, but for those of the largest component, which the others find. Components but the largest at least halve. Edges are
then ranked by weight over range partitions and merged in that order, `EDGES` at a time: a step holds the components that its edges touch, not the points, but for those of components below the least
size. What a cluster is worth is summed up as it grows, so the hierarchy itself is one row a cluster; which of a branch is chosen is found by doubling steps towards the root.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.operators.dense import rows_of
from matloom.operators.knn import BLOCK, ROWS, TILE, _nearer, exact, neighbours, tile
from matloom.plans.components import components
from matloom.plans.materialize import cut
from matloom.plans.prefix import running

#: Edges merged in one step; nearest rows listed; the least distance, which equal points have.
EDGES, LISTED, LEAST = 1_000_000, 16, 1e-10


class _Held:
    """Some rows of a block, and the lightest edge of each of their components so far (w, a, b); `bound` is a weight that the lightest does not exceed."""

    def __init__(self, ids: np.ndarray, comp: np.ndarray, core: np.ndarray, bound: np.ndarray, x: np.ndarray):
        self.ids, self.core, self.x = ids, core, x
        self.comps, self.at = np.unique(comp, return_inverse=True)
        self.bound = np.full(len(self.comps), np.inf)
        np.minimum.at(self.bound, self.at, bound)
        self.best: dict[int, tuple] = {}

    def look(self, ids: np.ndarray, comp: np.ndarray, core: np.ndarray, x: np.ndarray) -> None:
        """Takes in rows of all components, fewer at once for rows without any bound yet."""
        some = np.flatnonzero(np.isfinite(self.bound)[self.at])
        rest = np.flatnonzero(~np.isfinite(self.bound)[self.at])
        for part in [some, *(rest[i : i + 64] for i in range(0, len(rest), 64))]:
            if len(part):
                self._part(part, ids, comp, core, x)

    def _part(self, rows: np.ndarray, ids: np.ndarray, comp: np.ndarray, core: np.ndarray, x: np.ndarray) -> None:
        own, limit = self.x[rows], self.bound[self.at[rows]] ** 2
        near = _nearer(own, x, "l2", limit * (1 + 1e-12)) if np.isfinite(limit).all() else None
        if near is None:
            d, error = tile(own, x, "l2")
            near = d - error <= limit[:, None] * (1 + 1e-12)
        near &= self.comps[self.at[rows]][:, None] != comp[None, :]
        i, j = np.divmod(np.flatnonzero(near.ravel()), len(ids))
        for at in range(0, len(i), 8 * TILE):
            r, c = rows[i[at : at + 8 * TILE]], j[at : at + 8 * TILE]
            w = np.maximum(np.maximum(np.sqrt(exact(self.x[r], x[c], "l2")), self.core[r]), core[c])
            keep = w <= self.bound[self.at[r]]
            r, c, w = r[keep], c[keep], w[keep]
            low, high, mine = np.minimum(self.ids[r], ids[c]), np.maximum(self.ids[r], ids[c]), self.at[r]
            order = np.lexsort((high, low, w, mine))
            for e in order[np.flatnonzero(np.diff(mine[order], prepend=-1))].tolist():
                edge = (float(w[e]), int(low[e]), int(high[e]))
                if mine[e] not in self.best or edge < self.best[mine[e]]:
                    self.best[mine[e]] = edge
                    self.bound[mine[e]] = edge[0]


def _lightest(cells: DataFrame) -> DataFrame:
    """comp, w, a, b: of each cell (cell, side, id, comp, core, bound, vec) the lightest edge from the rows of side 0 of a component to rows of side 1 in others, unless all are heavier than its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, held, best = None, [], [], {}

        def begin() -> None:
            parts = [np.concatenate([w[i] for w in waiting]) for i in range(5)]
            held.extend(_Held(*(p[i : i + BLOCK] for p in parts)) for i in range(0, len(parts[0]), BLOCK))
            waiting.clear()

        def end() -> None:
            for h in held:
                for c, edge in h.best.items():
                    c = int(h.comps[c])
                    best[c] = min(best.get(c, edge), edge)
            held.clear()
            waiting.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, side, *parts = (batch.column(i).to_numpy() for i in range(6))
            parts.append(rows_of(batch.column(6)))
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                if cell[a] != at:
                    end()
                    at = cell[a]
                part = [p[a:b] for p in parts]
                if side[a] == 0:
                    waiting.append(part)
                    continue
                if waiting:
                    begin()
                for h in held:
                    h.look(part[0], part[1], part[2], part[4])
        end()
        rows = [(c, *e) for c, e in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["comp", "w", "a", "b"])

    return cells.select("cell", "side", "id", "comp", "core", "bound", "vec").mapInArrow(run, "comp long, w double, a long, b long")


def _searched(asking: DataFrame, rows: DataFrame) -> DataFrame:
    """comp, w, a, b: the lightest edges that the rows `asking` (id, comp, core, bound, vec) have to rows (id, comp, core, vec) of other components, by cells."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(asking.count() / ROWS))
    shares = max(1, math.ceil(2 * cores / blocks))
    dealt = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = asking.select(F.lit(0).alias("side"), dealt(blocks).alias("block"), every(shares).alias("share"), "id", "comp", "core", "bound", "vec")
    past = rows.select(F.lit(1).alias("side"), every(blocks).alias("block"), dealt(shares).alias("share"), "id", "comp", "core", F.lit(0.0).alias("bound"), "vec")
    cells = own.union(past).withColumn("cell", (F.col("block") * shares + F.col("share")).cast("int"))
    return _lightest(cells.repartitionById(blocks * shares, F.col("cell")).sortWithinPartitions("cell", "side"))


def spanning_tree(v: DataFrame, min_points: int = 5) -> DataFrame:
    """w, a, b: a minimum spanning tree of the rows (id, vec) by mutual reachability, the largest of two rows' Euclidean distance and of their core distances, that is, to their (min_points - 1)th nearest row. Ties go to the smaller ids."""
    v = cut(v.select("id", "vec"), "points")
    width = max(LISTED, min_points - 1)
    lists = cut(neighbours(v, width, "l2").select("id", "nbr", "pos", F.sqrt("dist").alias("d")), "lists")
    # No row that is not listed is nearer than `reach`.
    own = lists.groupBy("id").agg(F.max(F.when(F.col("pos") < min_points, F.col("d"))).alias("core"), F.when(F.count(F.lit(1)) >= width, F.max("d")).alias("reach"))
    core = F.coalesce("core", F.lit(0.0))
    points = cut(v.join(own, "id", "left").select("id", "vec", core.alias("core"), F.greatest(core, F.coalesce("reach", F.lit(float("inf")))).alias("reach")), "cores")
    cores = points.select("id", "core")
    known = lists.join(cores, "id").join(cores.select(F.col("id").alias("nbr"), F.col("core").alias("far")), "nbr")
    known = cut(known.select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b"), F.greatest("d", "core", "far").alias("w")).distinct(), "known")
    comp = cut(points.select("id", F.col("id").alias("comp")), "trees")
    tree = None
    while True:
        sizes = comp.groupBy("comp").count().orderBy(F.desc("count"), "comp").limit(2).collect()
        if len(sizes) < 2:
            break
        most = sizes[0]["comp"]
        # Listed edges between components; those within one are of no more use.
        known = cut(known.select("a", "b", "w").join(comp.select(F.col("id").alias("a"), F.col("comp").alias("u")), "a").join(comp.select(F.col("id").alias("b"), F.col("comp").alias("v")), "b").where("u <> v").select("a", "b", "w", "u", "v"), "known", known)
        both = known.select(F.col("u").alias("comp"), "w", "a", "b").union(known.select(F.col("v").alias("comp"), "w", "a", "b"))
        listed = cut(both.groupBy("comp").agg(F.min(F.struct("w", "a", "b")).alias("e")), "listed")
        rows = cut(points.join(comp, "id").join(listed.select("comp", F.col("e.w").alias("bound")), "comp", "left").select("id", "comp", "core", "reach", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), "vec"), "rows")
        asking = rows.where(F.col("reach") <= F.col("bound")).where(F.col("comp") != F.lit(most))
        settled = listed.select("comp", "e.w", "e.a", "e.b").where(F.col("comp") != F.lit(most))
        found = cut(_searched(asking.drop("reach"), rows.drop("reach")), "found")
        best = settled.union(found).groupBy("comp").agg(F.min(F.struct("w", "a", "b")).alias("e"))
        chosen = cut(best.select("e.w", "e.a", "e.b").distinct(), "chosen")
        if not chosen.limit(1).count():
            break
        tree = chosen if tree is None else tree.union(chosen)
        ends = chosen.join(comp.select(F.col("id").alias("a"), F.col("comp").alias("u")), "a").join(comp.select(F.col("id").alias("b"), F.col("comp").alias("v")), "b").select("u", "v")
        joined = components(ends, "trees").select(F.col("node").alias("comp"), F.col("component").alias("new"))
        comp = cut(comp.join(joined, "comp", "left").select("id", F.coalesce("new", "comp").alias("comp")), "trees", comp)
    return v.sparkSession.createDataFrame([], "w double, a long, b long") if tree is None else tree


STEP = "kind int, label long, size long, members array<long>, cluster long, s double, best double, top double, parent long, own boolean, birth double, point long, place long, a long, b long, w double"
NAMES = [f.split()[0] for f in STEP.split(", ")]


def _merged(rows: DataFrame, least: int) -> DataFrame:
    """One step: from components (kind 0), then edges in order (kind 1; a and b are labels), in one task: the labels' new ones (2), the components they make (0), points that join a cluster (3), and clusters that end in another (4)."""
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(n, types[t]) for n, t in (f.split() for f in STEP.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comps: dict[int, dict] = {}
        up: dict[int, int] = {}
        out: list[dict] = []

        def root(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        def join(members: list[int], into: dict, level: float) -> None:
            """Points of a component below the least size join a cluster, which they leave at this level."""
            out.extend({"kind": 3, "point": p, "cluster": into["cluster"], "w": level} for p in members)
            into["s"] += level * len(members)
            into["top"] = max(into["top"], level)

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    comps[r["label"]] = r
                    continue
                x, y = comps[root(r["a"])], comps[root(r["b"])]
                if y["size"] > x["size"]:
                    x, y = y, x
                level = 1.0 / max(r["w"], LEAST)
                both = x["size"] + y["size"]
                if y["size"] >= least:
                    # Two clusters end here, and one begins that holds them.
                    for c in (x, y):
                        worth = c["s"] - c["size"] * level
                        own = worth >= c["best"]
                        out.append({"kind": 4, "cluster": c["cluster"], "parent": r["place"] + 1, "own": own, "birth": level, "top": c["top"], "size": c["size"]})
                        c["worth"] = worth if own else c["best"]
                    x.update(cluster=r["place"] + 1, s=both * level, best=x.pop("worth") + y.pop("worth"), top=max(x["top"], y["top"]), members=[])
                elif both < least:
                    x["members"] = x["members"] + y["members"]
                else:
                    if x["size"] < least:
                        x.update(cluster=r["place"] + 1, s=0.0, best=0.0, top=0.0)
                        join(x["members"], x, level)
                    join(y["members"], x, level)
                    x["members"] = []
                x["size"] = both
                up[y["label"]] = x["label"]
                del comps[y["label"]]
                if len(out) > 10_000:
                    yield given()
        out += [{"kind": 2, "label": x, "cluster": root(x)} for x in list(up) if root(x) != x]
        out += [{k: c[k] for k in NAMES if k in c} | {"kind": 0} for c in comps.values()]
        yield given()

    return rows.select(*NAMES).coalesce(1).sortWithinPartitions("kind", "place").mapInArrow(run, STEP)


def hdbscan(v: DataFrame, min_points: int = 5, min_size: int = 5) -> DataFrame:
    """id, label, probability, outlier of the rows (id, vec).

    Going up the single-linkage tree of mutual reachability, components of `min_size` points or more are clusters, which gain points and, where two meet, end in a larger one. A cluster is worth the sum, over its points, of how much
    earlier in 1 / distance they have come than it ends; where it is worth as much as its best descendants together, it is chosen in their place, but never the one that holds all. Labels are numbered from 1 by the
    clusters' least ids, and noise has 0. The probability is a point's 1 / distance when it came, over the largest in its chosen cluster; the outlier score is one less the same share in the cluster that it came to. Without any cluster all is noise with zeros.
    """
    if min_size < 2:
        raise ValueError("a cluster has two points at least")
    none = [F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in STEP.split(", "))]
    fill = lambda df, **given: df.select(*[given[n].alias(n) if n in given else c for n, c in zip(NAMES, none)])
    ids = v.select("id")
    tree = spanning_tree(v, min_points)
    edges = cut(running(tree.withColumn("one", F.lit(1)), ["w", "a", "b"], {"one": "place"}), "edges")
    labels = cut(ids.select("id", F.col("id").alias("label")), "labels")
    comps = cut(fill(ids, kind=F.lit(0), label=F.col("id"), size=F.lit(1).cast("long"), members=F.array("id"), s=F.lit(0.0), best=F.lit(0.0), top=F.lit(0.0)), "comps")
    events, ended = [], []
    for k in range(-(-edges.count() // EDGES)):
        own = edges.where((F.col("place") >= k * EDGES) & (F.col("place") < (k + 1) * EDGES))
        own = own.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
        own = cut(fill(own, kind=F.lit(1), place=F.col("place").cast("long"), a=F.col("la"), b=F.col("lb"), w=F.col("w")), "own")
        touched = own.select(F.explode(F.array("a", "b")).alias("label")).distinct()
        step = cut(_merged(comps.join(touched, "label", "left_semi").select(*NAMES).union(own), min_size), "step")
        events.append(step.where("kind = 3").select(F.col("point").alias("id"), "cluster", F.col("w").alias("level")))
        ended.append(step.where("kind = 4").select("cluster", "parent", "own", "top"))
        moved = step.where("kind = 2").select("label", F.col("cluster").alias("new"))
        labels = cut(labels.join(moved, "label", "left").select("id", F.coalesce("new", "label").alias("label")), "labels", labels)
        comps = cut(comps.join(touched, "label", "left_anti").select(*NAMES).union(step.where("kind = 0").select(*NAMES)), "comps", comps)
    if not events:
        return ids.select("id", F.lit(0).alias("label"), F.lit(0.0).alias("probability"), F.lit(0.0).alias("outlier"))
    root = comps.where(F.col("size") >= min_size).select("cluster", F.lit(None).cast("long").alias("parent"), F.lit(False).alias("own"), "top")
    for more in ended:
        root = root.union(more)
    clusters = cut(root, "clusters")
    # The chosen cluster nearest to the root, by steps that double.
    paths = cut(clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("own"), F.col("cluster")).alias("pick")), "paths")
    while paths.where("up IS NOT NULL").limit(1).count():
        far = paths.select(F.col("cluster").alias("up"), F.col("up").alias("far"), F.col("pick").alias("higher"))
        paths = cut(paths.join(far, "up", "left").select("cluster", F.col("far").alias("up"), F.coalesce("higher", "pick").alias("pick")), "paths", paths)
    points = events[0]
    for more in events[1:]:
        points = points.union(more)
    tops = clusters.select("cluster", "top")
    found = points.join(paths.select("cluster", "pick"), "cluster").join(tops, "cluster")
    found = found.join(tops.select(F.col("cluster").alias("pick"), F.col("top").alias("most")), "pick", "left")
    found = cut(found.select("id", "pick", F.coalesce(F.col("level") / F.col("most"), F.lit(0.0)).alias("probability"), (1 - F.col("level") / F.col("top")).alias("outlier")), "found")
    firsts = found.where("pick IS NOT NULL").groupBy("pick").agg(F.min("id").alias("first"), F.lit(1).alias("one"))
    numbers = running(firsts, ["first"], {"one": "label"}).select("pick", (F.col("label") + 1).cast("int").alias("label"))
    got = ids.join(found, "id", "left").join(numbers, "pick", "left")
    return got.select("id", F.coalesce("label", F.lit(0)).alias("label"), F.coalesce("probability", F.lit(0.0)).alias("probability"), F.coalesce("outlier", F.lit(0.0)).alias("outlier"))
