"""Near-duplicate documents by HyperMinHash bands and exact verification.

A document's set is its distinct five-word shingles, as 64-bit hashes. Its registers are, for
each of `BUCKETS` hash buckets, the leading zeros of the least hash in the bucket and the
`MANTISSA` bits after its first one. Documents with equal sets are one node (the least
doc_id). Nodes that agree on a band of registers share a band bucket; a band whose registers are all
empty makes none. A band has as many registers as leave a pair at the threshold a probability of at most
`MISS` to meet in no band: 25 bands of five at 0.85 (4e-7), 32 bands of four at 0.8 (5e-8).

No bucket is expanded into pairs. A bucket's hub is its least node, and members are compared with
it: first with the least of all hubs they have, later, where that leaves a bucket in several components, with the bucket's own. A pair that meets in buckets of two only is dropped first when the collision-corrected
Jaccard estimate of its registers is five deviations below the threshold; all others are verified on full
sets, and keep how they differ from their hub: which of its shingles they lack, and which they add.
Members that the hub does not link are then compared with each other exactly through those differences
(what two members share follows from what each lacks and adds), as blocked matrix products
among the members of one hub, for different components only. So every link between nodes that
share a bucket is found, or both ends are already in one component. A hub's members are cut into blocks, however many they are, and pairs of blocks
are spread over tasks.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. Fewer than five words are one shingle;
null, empty and blank texts have none and are linked with nothing. Rows that repeat a doc_id
count as one document: copies share a class, different texts of one id link whatever either does.
A null doc_id takes no part: its component is null. An empty table gives no rows. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matloom.llm.workers import tidy
from matloom.plans.components import Forest, components
from matloom.plans.joins import broadcast_if_small, maybe_among, split_among
from matloom.plans.materialize import cut

BUCKETS, MANTISSA = 128, 10
SHINGLE = 5
EMPTY = np.uint16(0xFFFF)
THRESHOLD, MISS = 0.85, 1e-6
BLOCK_ROWS, BLOCK_BYTES, STRIP = 1024, 16 << 20, 128
U = np.uint64
#: The seed of the letters' and the base's numbers, the golden-ratio step, and (in mixed) the public multipliers of a 64-bit finaliser.
_RNG = np.random.Generator(np.random.PCG64(20240607))
LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = int(_RNG.integers(2**40, 2**62)) * 8 + 5
BASE_INVERSE = pow(BASE, -1, 2**64)
STEP = U(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STARTS = np.arange(BUCKETS, dtype=np.uint64) << U(64 - 7)


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 18)
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))
        return cls.up, cls.down


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; words of all texts are hashed together."""
    raw = b"\n".join([t.lower() for t in texts])
    a = np.frombuffer(raw, np.uint8)
    if not len(a):
        return [np.zeros(0, np.uint64) for _ in texts]
    space = SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = Powers.of(len(a) + 1)
    total = np.concatenate([[U(0)], np.cumsum(LETTER[a] * up[: len(a)], dtype=np.uint64)])
    words = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, np.cumsum([0, *[len(t) + 1 for t in texts]]))
    n = len(words) - SHINGLE + 1
    five = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE):
        five = five * STEP + words[k : k + len(five)]
    five = mixed(five)
    out = []
    for i in range(len(texts)):
        x, y = int(first[i]), int(first[i + 1])
        if y - x >= SHINGLE:
            out.append(np.unique(five[x : y - SHINGLE + 1]))
        elif y > x:
            h = U(y - x)
            with np.errstate(over="ignore"):
                for w in words[x:y]:
                    h = h * STEP + w
            out.append(mixed(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set: 6 bits of leading zeros, then the mantissa; EMPTY where no hash fell."""
    at = np.searchsorted(hashes, STARTS)
    padded = np.append(hashes, U(0))
    least = padded[np.minimum(at, len(hashes))]
    has = (at < len(hashes)) & (least >> U(57) == np.arange(BUCKETS, dtype=np.uint64))
    value = least - STARTS
    zeros = np.clip(57 - 8 - np.frexp((value >> U(8)).astype(np.float64))[1], 0, 49)
    mantissa = ((value << (zeros + 1).astype(np.uint64)) & U((1 << 57) - 1)) >> U(57 - MANTISSA)
    return np.where(has, (zeros.astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16), EMPTY).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers, less the matches that chance gives (equal zeros once in three, equal mantissas once in 2^MANTISSA), and the registers in use."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(1)
    same = ((a == b) & (a != EMPTY)).sum(1)
    chance = 1 / (3 * 2**MANTISSA)
    return (same / np.maximum(used, 1) - chance) / (1 - chance), used


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as UTF-8 in runs of about a quarter of a megabyte, with the place of the first."""
    at, held, size = 0, [], 0
    for i, t in enumerate(batch.column(column)):
        raw = (t.as_py() or "").encode()
        if held and size + len(raw) > most:
            yield at, held
            at, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield at, held


SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("sig", T.BinaryType())])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (shingles), fp (of the whole set), sig (registers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch, 1):
                sets = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(texts)).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([registers(s).tobytes() for s in sets], pa.binary()),
                ], names=SKETCH.names)

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def band_rows(threshold: float) -> int:
    """The most registers a band can have for a pair at the threshold to meet in none with a probability of `MISS` at most; one where no number does."""
    return max((r for r in range(1, BUCKETS + 1) if (1 - threshold**r) ** (BUCKETS // r) <= MISS), default=1)


def bands(nodes: DataFrame, threshold: float) -> DataFrame:
    """key, node: a row for each band of a node with a register in use."""
    size = band_rows(threshold)
    width = 2 * size
    part = F.expr(f"substring(sig, band * {width} + 1, {width})")
    rows = nodes.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS // size - 1))).alias("band")).withColumn("part", part)
    return rows.where(F.col("part") != F.lit(EMPTY.tobytes() * size)).select(F.xxhash64("band", "part").alias("key"), "node")


def likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """hub, node of the pairs whose estimate is not five deviations below the threshold."""
    wanted = cut(pairs.select("hub").union(pairs.select("node")).distinct().select(F.col("hub").alias("node")), "wanted")
    sigs = maybe_among(nodes, "node", wanted).join(wanted.hint("merge"), "node").select("node", "sig")
    both = pairs.join(sigs.hint("merge"), "node").join(sigs.select(F.col("node").alias("hub"), F.col("sig").alias("hub_sig")).hint("merge"), "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BUCKETS) for i in (2, 3)]
                j, used = estimate(a, b)
                yield batch.select([0, 1]).filter(pa.array(j + 5 * np.sqrt(least * (1 - least) / np.maximum(used, 1)) >= least))

    return both.select("hub", "node", "sig", "hub_sig").mapInArrow(run, "hub long, node long")


def full_sets(docs: DataFrame, wanted: DataFrame, sketch: DataFrame) -> DataFrame:
    """node, set (sorted hashes) of the wanted documents, once for each text of a doc_id. Only bits of the wanted ids are broadcast, at any size; a semi-join would be pushed below them."""
    rows = maybe_among(docs.select("doc_id", "text"), "doc_id", wanted).join(wanted.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)).cast(pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], names=["node", "set"])

    sets = rows.mapInArrow(run, "node long, set binary")
    found = sketch.select("doc_id").hint("merge").join(broadcast_if_small(wanted).withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    return sets if found.count() == wanted.count() else sets.dropDuplicates(["node", "set"])


CHECKED = T.StructType([
    T.StructField("hub", T.LongType()), T.StructField("node", T.LongType()), T.StructField("link", T.BooleanType()), T.StructField("n_hub", T.LongType()), T.StructField("n_node", T.LongType()), T.StructField("lacks", T.BinaryType()), T.StructField("adds", T.BinaryType()),
])


def linked(shared, a, b, threshold: float):
    least = Fraction(str(threshold))
    return least.denominator * shared >= least.numerator * (a + b - shared)


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Each pair's link on full sets, and the node's difference from its hub: places of hub hashes it lacks (uint32), hashes it adds (uint64)."""
    hubs = cut(pairs.select(F.col("hub").alias("node")).distinct(), "hubs")
    hub_sets = maybe_among(sets, "node", hubs).select(F.col("node").alias("hub"), F.col("set").alias("hub_set"))
    both = maybe_among(sets, "node", pairs.select("node")).join(pairs.hint("merge"), "node").join(hub_sets.hint("merge"), "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for own, hub in zip(part.column(2), part.column(3)):
                    x, h = np.frombuffer(own.as_py(), np.uint64), np.frombuffer(hub.as_py(), np.uint64)
                    place = np.searchsorted(h, x)
                    place[place == len(h)] = 0
                    inside = h[place] == x if len(h) else np.zeros(len(x), bool)
                    missing = np.ones(len(h), bool)
                    missing[place[inside]] = False
                    rows.append((bool(linked(int(inside.sum()), len(x), len(h), threshold)), len(h), len(x), np.flatnonzero(missing).astype(np.uint32).tobytes(), x[~inside].tobytes()))
                kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=CHECKED.names)

    return both.select("hub", "node", "set", "hub_set").mapInArrow(run, CHECKED)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], wide: int = 2048) -> np.ndarray:
    """How many values each array on the left shares with each on the right, by matrix products over blocks of values that occur on both sides."""
    out = np.zeros((len(left), len(right)), np.float32)
    size = lambda side: np.repeat(np.arange(len(side)), [len(x) for x in side])
    a, b = np.concatenate([*left, np.zeros(0, np.uint64)]), np.concatenate([*right, np.zeros(0, np.uint64)])
    common = np.intersect1d(a, b)
    rows_a, rows_b = size(left), size(right)
    at_a, at_b = np.searchsorted(common, a), np.searchsorted(common, b)
    in_a = (at_a < len(common)) & (common[np.minimum(at_a, len(common) - 1)] == a) if len(common) else np.zeros(len(a), bool)
    in_b = (at_b < len(common)) & (common[np.minimum(at_b, len(common) - 1)] == b) if len(common) else np.zeros(len(b), bool)
    for at in range(0, len(common), wide):
        width = min(wide, len(common) - at)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        for m, rows, inside, places in ((x, rows_a, in_a, at_a), (y, rows_b, in_b, at_b)):
            some = inside & (places >= at) & (places < at + width)
            m[rows[some], places[some] - at] = 1
        out += x @ y.T
    return out


def cross_links(checked: DataFrame, component: DataFrame, threshold: float) -> DataFrame:
    """u, v: components to join, by comparing all nodes of a hub that are in different components (node, component; a node without a row is its own)."""
    # Places are worked out on narrow rows; differences are shuffled to them once, at any size.
    members = checked.select("hub", "node", (F.octet_length("lacks") + F.octet_length("adds")).alias("bytes")).hint("merge").join(broadcast_if_small(component), "node", "left").withColumn("component", F.coalesce("component", "node"))
    size = members.groupBy("hub").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).where("a < b")
    blocks = cut(size.select("hub", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")), "blocks")
    placed = cut(members.select("hub", "node", "component").distinct().hint("merge").join(broadcast_if_small(blocks), "hub"), "placed")
    rows = checked.drop("link").join(placed.hint("merge"), ["hub", "node"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("*", other).select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "component", "n_hub", "n_node", "lacks", "adds")
    rows = rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")

    def compare(own: list[tuple], same: bool, forest: Forest, i: int, j: int) -> None:
        left = [r for r in own if r[0] == i]
        right = left if same else [r for r in own if r[0] == j]
        if not left or not right:
            return
        for strip in range(0, len(left), STRIP):
            some = left[strip : strip + STRIP]
            lacks, adds = [[np.frombuffer(r[4], np.uint32).astype(np.uint64) for r in side] for side in (some, right)], [[np.frombuffer(r[5], np.uint64) for r in side] for side in (some, right)]
            number = lambda side, k: np.array([r[k] for r in side], np.float64)
            less = [np.array([len(x) for x in side], np.float64) for side in lacks]
            shared = shared_counts(*lacks) + shared_counts(*adds) + (some[0][2] - less[0][:, None] - less[1][None, :])
            ok = linked(shared, number(some, 3)[:, None], number(right, 3)[None, :], threshold)
            ok &= np.array([r[1] for r in some])[:, None] != np.array([r[1] for r in right])[None, :]
            for x, y in zip(*[p.tolist() for p in np.nonzero(ok)]):
                forest.join(some[x][1], right[y][1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, at, held = Forest(), None, []
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(9)]):
                if row[:3] != at:
                    if held:
                        compare(held, at[1] == at[2], forest, at[1], at[2])
                    at, held = row[:3], []
                held.append(row[3:])
        if held:
            compare(held, at[1] == at[2], forest, at[1], at[2])
        found = [(x, r) for x in forest.up if (r := forest.root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["u", "v"])
        held.clear()
        tidy()

    return rows.mapInArrow(run, "u long, v long")


def _joined(component: DataFrame, more: DataFrame, name: str) -> DataFrame:
    """node, component after components were joined (more: component, joined). A component of a single node is no row of `component`."""
    some = component.hint("merge").join(broadcast_if_small(more), "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    lone = more.join(component.select("node").hint("merge"), more["component"] == component["node"], "left_anti").select(F.col("component").alias("node"), F.col("joined").alias("component"))
    return cut(some.union(lone), name)


def _links(pairs: DataFrame, sets: DataFrame, known: DataFrame | None, threshold: float) -> DataFrame:
    """node, component: what the pairs link, and what their hubs' members link among each other, on top of what is known."""
    checked = cut(verify(pairs, sets, threshold), "checked")
    edges = checked.where("link").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    if known is not None:
        edges = edges.union(known.select("node", "component"))
    first = cut(components(edges), "first")
    more = components(cross_links(checked, first, threshold)).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return _joined(first, cut(more, "more"), "classes")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of `docs`. Jaccard similarities of `threshold` or more are links.

    A node's first hub is the least of those it may be linked with (or itself), and all nodes of a first hub are compared first, each difference standing once.
    Only band buckets that still hold nodes of several first hubs and of several components are compared around their own hub.
    """
    sketch = cut(sketches(docs), "sketches")
    nodes = cut(sketch.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")), "nodes")
    keyed = bands(nodes, threshold)
    shared = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.count(F.lit(1)).alias("m")).where("top > hub").drop("top")
    members = cut(keyed.join(shared.hint("merge"), "key").select("key", "hub", "m", "node"), "members")
    pairs = cut(members.where("node <> hub").groupBy("hub", "node").agg(F.max("m").alias("m")), "pairs")
    few = likely(pairs.where("m = 2").select("hub", "node"), nodes, threshold)
    pairs = cut(pairs.where("m > 2").select("hub", "node").union(few), "likely")
    wanted = cut(pairs.select("node").union(pairs.select("hub")).distinct(), "wanted")
    sets = cut(full_sets(docs, wanted, sketch), "sets")
    near = cut(pairs.groupBy("node").agg(F.min("hub").alias("hub")).select("hub", "node"), "near")
    component = _links(near, sets, None, threshold)
    placed = members.select("key", "node").hint("merge").join(broadcast_if_small(near.withColumnRenamed("hub", "first")), "node", "left").hint("merge").join(broadcast_if_small(component), "node", "left")
    placed = placed.select("key", F.coalesce("first", "node").alias("first"), F.coalesce("component", "node").alias("component"))
    mixed_keys = placed.groupBy("key").agg(F.min("first").alias("a"), F.max("first").alias("b"), F.min("component").alias("c"), F.max("component").alias("d")).where("a < b AND c < d").select("key")
    rest = members.join(mixed_keys.hint("merge"), "key").where("node <> hub").groupBy("hub", "node").agg(F.max("m").alias("m"))
    rest = rest.join(near.withColumn("done", F.lit(True)).hint("merge"), ["hub", "node"], "left").where("m > 2 OR done IS NULL").select("hub", "node")
    rest = cut(rest.join(pairs.hint("merge"), ["hub", "node"], "left_semi"), "rest")
    if rest.limit(1).count():
        component = _links(rest, sets, component, threshold)
    rows = sketch.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(nodes.select("fp", "node").hint("merge"), "fp", "left")
    rows = rows.hint("merge").join(broadcast_if_small(component), "node", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return rows.select("doc_id", "n_shingles", found.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` less the documents that are not the least of their class. Only those that may be such are shuffled, at any size."""
    name = f"gone_{uuid.uuid4().hex}"
    gone = cut(classes(docs, threshold).where("NOT kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    maybe, others = split_among(docs, "doc_id", gone)
    # An anti-join would be pushed below the bits, and shuffle all.
    return others.union(maybe.join(gone.hint("merge"), F.col("doc_id") == F.col(name), "left").where(F.col(name).isNull()).drop(name))
