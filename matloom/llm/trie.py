"""The prefix trie of conversations, as a Cartesian tree over the common prefixes of sorted neighbours.

Conversations become keys, 16 bytes of a digest for each turn (role, text), and are sorted by range. Within a range each neighbour's common prefix and each
conversation's own length form one array of depths, whose Cartesian tree, with equal neighbours merged, is the trie without its unbranched
stretches: a value's nearest smaller values on both sides bound the node, and the larger of the two is its parent's depth.
A stack finds them within a range, in one pass over it, and sums up members, leaves and sizes on the way. What the range alone cannot bound (a value without a smaller one before it, or after it)
is left as one record each, falling to the range's minimum and rising from it; the records of many ranges, with the common prefixes between ranges, are the next level's array, until one is left.
A level's array has two records a depth and range at most. Unbranched stretches are then rows of their own, one a depth.

Memory: a task holds one conversation, the open nodes and a bounded number of rows that wait for their parent; a conversation of n turns takes 24 n bytes.
Members that end at a node are digested as they pass; long runs of equal conversations, and those that a range's border cuts, go on as pieces and are digested in order.

Turns are ordered by number (null first), then role, then the first characters of the text, then digest. Nulls: a null role or text is the empty one; rows without a conv_id belong to no
conversation. Repeated rows are turns of their own. An empty table has no nodes. Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matloom.llm.sums import crc32_sql
from matloom.plans.joins import broadcast_if_small
from matloom.plans.materialize import cut

DIGEST, START = 16, 32
#: Rows that wait for a parent, members of one piece, rows a batch, ranges of a level's group.
WAITING, PIECE, BATCH, FAN = 20_000, 8_192, 20_000, 64
EMPTY = hashlib.sha256(b"").hexdigest()
KEYS = "conv_id long, key binary, sizes binary"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
#: kind 0: a node (ref: where its parent's least member will stand; ends_of: pieces of its ends). 1: a record of the next level.
#: 2: the least member of the node that `ref` stands for. 3: a piece of a run's members.
OUT = (
    "kind int, part long, at long, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, ends_of array<long>, ref long, refs array<long>, sizes binary, piece string"
)
FIELDS = pa.schema(
    [("kind", pa.int32()), ("part", pa.int64()), ("at", pa.int64()), ("depth", pa.int32())]
    + [(c, pa.int64()) for c in ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("ends_of", pa.list_(pa.int64())), ("ref", pa.int64()), ("refs", pa.list_(pa.int64())), ("sizes", pa.binary()), ("piece", pa.string())]
)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, start, digest, size of every turn (conv_id, turn, role, text): what the trie needs of it."""
    c = {n: conversations[n] for n in ("conv_id", "turn", "role", "text")}
    role, text = F.coalesce(c["role"], F.lit("")), F.coalesce(c["text"], F.lit(""))
    # The length of the role keeps (role, text) apart from other pairs of the same characters.
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, DIGEST)
    return conversations.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].alias("turn"), role.alias("role"), F.substring(text, 1, START).alias("start"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).where("conv_id IS NOT NULL")


def keys(rows: DataFrame, heads: int = 1, most: int = 0) -> DataFrame:
    """conv_id, key (the digests of its turns), sizes (of their texts, 8 bytes each) of every conversation.

    With `heads` above 1, conversation c begins with the first h turns of conversation c - c % heads (all if fewer, none if it is absent) and goes on with its own turns
    after its first h, where h is the CRC-32 of the decimal c modulo most + 1. The turns of `heads` conversations are dealt together and sorted on disk; they pass in one stream.
    """
    base = F.expr(f"conv_id - conv_id % {heads}L")
    dealt = rows.select(base.alias("base"), "conv_id", (F.col("conv_id") != base).alias("later"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1)).cast("int").alias("h"), "turn", "role", "start", "digest", "size")
    dealt = dealt.repartition("base").sortWithinPartitions("base", "later", "conv_id", "turn", "role", "start", "digest").select("base", "conv_id", "h", "digest", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, head, conv, h, digests, sizes = None, (b"", b""), None, 0, [], []
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            nonlocal head
            key, size = b"".join(digests), b"".join(sizes)
            if conv == owner:
                head = key[: DIGEST * most], size[: 8 * most]
            if heads > 1:
                key, size = head[0][: DIGEST * h] + key[DIGEST * h :], head[1][: 8 * h] + size[8 * h :]
            for column, value in zip(out, (conv, key, size)):
                column.append(value)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["conv_id", "key", "sizes"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            bases, convs, hs = (batch.column(i).to_numpy() for i in range(3))
            all_digests, size = b"".join(batch.column(3).to_pylist()), np.ascontiguousarray(batch.column(4).to_numpy(), "<i8").tobytes()
            cuts = [0, *(np.flatnonzero(convs[1:] != convs[:-1]) + 1).tolist(), len(convs)]
            for a, b in zip(cuts, cuts[1:]):
                if convs[a] != conv:
                    if conv is not None:
                        close()
                    if bases[a] != owner:
                        owner, head = int(bases[a]), (b"", b"")
                    conv, h, digests, sizes = int(convs[a]), int(hs[a]), [], []
                digests.append(all_digests[DIGEST * a : DIGEST * b])
                sizes.append(size[8 * a : 8 * b])
            yield flush()
        if conv is not None:
            close()
            yield flush()

    return dealt.mapInArrow(run, KEYS)


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax()) // DIGEST


class _Open:
    """A node whose members still come. `rows` are children's first rows that wait for its least member, `refs` what stands for it in rows already given out."""

    __slots__ = ("depth", "sizes", "n", "least", "leaves", "saved", "kids", "ends", "sha", "rows", "refs")

    def __init__(self, depth: int, sizes: bytes):
        self.depth, self.sizes = depth, sizes
        self.n, self.least, self.leaves, self.saved, self.kids = 0, None, 0, 0, 0
        self.ends, self.sha, self.rows, self.refs = [], None, [], []

    def add(self, n, least, leaves, saved, kids) -> None:
        self.n += n
        if least is not None and (self.least is None or least < self.least):
            self.least = least
        self.leaves += leaves
        self.saved += saved
        self.kids += kids


class _Tree:
    """The stack over one array of depths; collects rows of OUT. `part` and a running number name what stands for its nodes. A `whole` array stands between values below all of its own."""

    def __init__(self, part: int, level: int, whole: bool = False):
        self.part, self.level, self.whole, self.names, self.at = part, level, whole, 0, 0
        self.stack: list[_Open] = []
        self.rows: list[tuple] = []
        self.chains: list[pa.RecordBatch] = []

    def name(self) -> int:
        """A number no other node has: 36 bits for the range, 24 for what it names (two a depth and range, or one for WAITING rows), 3 for the level."""
        self.names += 1
        return (self.level << 60) | (self.part << 24) | self.names

    def reach(self, depth: int, sizes: bytes) -> _Open:
        """The open node at a depth, after closing all below it."""
        below = None
        while self.stack and self.stack[-1].depth > depth:
            node = self.stack.pop()
            if below is not None:
                self.close(below, node)
            below = node
        if self.stack and self.stack[-1].depth == depth:
            top = self.stack[-1]
            if below is not None:
                self.close(below, top)
            return top
        top = _Open(depth, sizes)
        if below is not None and (self.stack or self.whole):
            self.close(below, top)
        elif below is not None:
            self.leave(below)
        self.stack.append(top)
        return top

    def close(self, node: _Open, parent: _Open | None) -> None:
        """Gives out the rows of a bounded node, one a depth down from its parent's, and adds it to its parent."""
        above = parent.depth if parent is not None else -1
        leaf = node.kids == 0
        leaves = 1 if leaf else node.leaves
        for row in node.rows:
            self.node(row[:3] + (node.least,) + row[4:])
        for ref in node.refs:
            self.rows.append((2, None, None, None, node.least, None, None, None, None, None, None, None, ref, None, None, None))
        ends = (node.sha or EMPTY, None) if not node.ends else (None, node.ends)
        first = max(above + 1, 1)
        own = np.frombuffer(node.sizes, "<i8", node.depth)[first - 1 :] * (node.n - 1)
        down = node.saved + own[::-1].cumsum()[::-1]
        length = node.depth - above
        if above < 0:
            down = np.concatenate([[down[0] if len(down) else node.saved], down])
        total = int(down[0])
        if length == 1:
            top = (node.depth, node.least, None, None, node.n, node.kids, leaves, total, *ends)
        else:
            top = (above + 1, node.least, None, None, node.n, 1, leaves, total, EMPTY, None)
            if length > 3:
                self.chain(node, above + 2, node.depth - 1, leaves, down[1:-1])
            else:
                for k in range(1, length - 1):
                    self.node((above + 1 + k, node.least, None, node.least, node.n, 1, leaves, int(down[k]), EMPTY, None))
            self.node((node.depth, node.least, None, node.least, node.n, node.kids, leaves, int(down[-1]), *ends))
        if parent is None:
            self.node(top)
            return
        parent.add(node.n, node.least, leaves, total, 1)
        parent.rows.append(top)
        if len(parent.rows) >= WAITING:
            self.let_go(parent)

    def node(self, row: tuple, ref: int | None = None) -> None:
        depth, least, _, parent, n, kids, leaves, saved, sha, ends_of = row
        self.rows.append((0, None, None, depth, least, parent, n, kids, leaves, saved, sha, ends_of, ref, None, None, None))

    def chain(self, node: _Open, first: int, last: int, leaves: int, saved: np.ndarray) -> None:
        """The rows between the ends of a long unbranched stretch, as columns."""
        for a in range(first, last + 1, BATCH):
            n = min(BATCH, last + 1 - a)
            columns = {"kind": pa.array(np.zeros(n, np.int32)), "depth": pa.array(np.arange(a, a + n, dtype=np.int32)), "saved_tokens": pa.array(saved[a - first : a - first + n].astype(np.int64))}
            for c, v in (("conv_id", node.least), ("parent_conv_id", node.least), ("n_convs", node.n), ("n_children", 1), ("n_leaves", leaves)):
                columns[c] = pa.array(np.full(n, v, np.int64))
            columns["ends_sha256"] = pa.array([EMPTY], pa.string()).take(pa.array(np.zeros(n, np.int32)))
            self.chains.append(pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in FIELDS], schema=FIELDS))

    def let_go(self, node: _Open) -> None:
        """Gives out the rows that wait, under a name that the node's least member will be told by."""
        if node.rows:
            ref = self.name()
            node.refs.append(ref)
            for row in node.rows:
                self.node(row, ref)
            node.rows = []

    def leave(self, node: _Open) -> None:
        """A node that this array does not bound: a record of the next level's."""
        self.let_go(node)
        self.at += 1
        self.rows.append((1, self.part, self.at, node.depth, node.least, None, node.n, node.kids, node.leaves, node.saved, node.sha, node.ends, None, node.refs, node.sizes[: 8 * node.depth], None))

    def end(self) -> None:
        """The end of the array: of a whole one, a smaller value than all; of others, all that is open is left, from the least depth on."""
        if not self.whole:
            for node in self.stack:
                self.leave(node)
            self.stack = []
            return
        while self.stack:
            node = self.stack.pop()
            self.close(node, self.stack[-1] if self.stack else None)

    def given(self, all: bool = False) -> Iterator[pa.RecordBatch]:
        yield from self.chains
        self.chains = []
        if self.rows and (all or len(self.rows) >= BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), FIELDS)], schema=FIELDS)
            self.rows = []


class _Run:
    """The members of equal neighbours, in order. A run is digested at once if it is short and lies within its range."""

    def __init__(self, node: _Open, first: bool):
        self.node, self.whole, self.ids, self.pieces, self.ref = node, not first, [], 0, None

    def piece(self, tree: _Tree) -> None:
        if self.ref is None:
            self.ref = tree.name()
            self.node.ends.append(self.ref)
        self.pieces += 1
        tree.rows.append((3, None, self.pieces, None, None, None, None, None, None, None, None, None, self.ref, None, None, ",".join(map(str, self.ids))))
        self.ids = []

    def add(self, conv: int, tree: _Tree) -> None:
        if len(self.ids) >= PIECE:
            self.piece(tree)
        self.ids.append(conv)

    def end(self, tree: _Tree, last: bool) -> None:
        if self.ref is None and self.whole and not last:
            self.node.sha = hashlib.sha256(",".join(map(str, self.ids)).encode()).hexdigest()
        else:
            self.piece(tree)


def _ranges(sorted_keys: DataFrame) -> DataFrame:
    """The first level: rows of OUT from conversations (part, conv_id, key, sizes) sorted by key and conv_id within each part; kind 4 holds a part's first and last key (in sizes and piece's place: refs stay empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = members = before = None
        first = None

        def finish() -> Iterator[pa.RecordBatch]:
            members.end(tree, True)
            tree.end()
            for at, key, sizes in ((0, *first), (1, before, b"")):
                tree.rows.append((4, tree.part, at, None, None, None, None, None, None, None, key.hex(), None, None, None, sizes, None))
            yield from tree.given(True)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for part, conv, key, sizes in zip(*columns):
                if tree is None or part != tree.part:
                    if tree is not None:
                        yield from finish()
                    tree, before, first = _Tree(part, 0), None, (key, sizes)
                depth = len(key) // DIGEST
                if before is not None and key != before:
                    members.end(tree, False)
                    tree.reach(common(before, key), sizes)
                if before is None or key != before:
                    members = _Run(tree.reach(depth, sizes), before is None)
                    before = key
                members.node.add(1, conv, 0, 0, 0)
                members.add(conv, tree)
                yield from tree.given()
        if tree is not None:
            yield from finish()

    return sorted_keys.select("part", "conv_id", "key", "sizes").mapInArrow(run, OUT)


def _level(records: DataFrame, level: int, whole: bool) -> DataFrame:
    """The next level: rows of OUT from the records of many parts (group, part, at, ...), in order; group becomes their part."""
    names = [f.name for f in FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for r in batch.to_pylist():
                if tree is None or r["group"] != tree.part:
                    if tree is not None:
                        tree.end()
                        yield from tree.given(True)
                    tree = _Tree(r["group"], level, whole)
                node = tree.reach(r["depth"], r["sizes"])
                node.add(r["n_convs"], r["conv_id"], r["n_leaves"], r["saved_tokens"], r["n_children"])
                node.sha = r["ends_sha256"] or node.sha
                node.ends += r["ends_of"] or []
                node.refs += r["refs"] or []
                yield from tree.given()
        if tree is not None:
            tree.end()
            yield from tree.given(True)

    return records.repartition("group").sortWithinPartitions("group", "part", "at").select("group", *names).mapInArrow(run, OUT)


def _between(edges: DataFrame) -> DataFrame:
    """The common prefix of each part's first key with the last of the part before, as a record before its others. Two rows a part."""
    both = edges.groupBy("part").agg(F.max(F.when(F.col("at") == 0, F.col("ends_sha256"))).alias("first"), F.max(F.when(F.col("at") == 1, F.col("ends_sha256"))).alias("last"), F.max(F.when(F.col("at") == 0, F.col("sizes"))).alias("sizes"))
    both = both.withColumn("previous", F.lag("last").over(Window.orderBy("part"))).where("previous IS NOT NULL")

    @F.arrow_udf("int")
    def shared(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([common(bytes.fromhex(x), bytes.fromhex(y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    zero = lambda c: F.lit(0).cast("long").alias(c)
    found = both.select("part", shared("previous", "first").alias("depth"), "sizes")
    return found.select(
        F.lit(1).alias("kind"), "part", zero("at"), "depth", F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), zero("n_convs"), zero("n_children"), zero("n_leaves"), zero("saved_tokens"),
        F.lit(None).cast("string").alias("ends_sha256"), F.lit(None).cast("array<long>").alias("ends_of"), F.lit(None).cast("long").alias("ref"), F.lit(None).cast("array<long>").alias("refs"),
        F.expr("substring(sizes, 1, 8 * depth)").alias("sizes"), F.lit(None).cast("string").alias("piece"),
    )


def _digests(nodes: DataFrame, pieces: DataFrame) -> DataFrame:
    """ends (the first piece's name), sha256 of the members of the nodes whose runs came in pieces; each digest is one stream over its pieces."""
    wanted = nodes.where("ends_of IS NOT NULL").select(F.col("ends_of")[0].alias("ends"), F.posexplode("ends_of").alias("place", "ref"))
    rows = wanted.join(pieces.select("ref", "at", "piece"), "ref").repartition("ends").sortWithinPartitions("ends", "place", "at").select("ends", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()], pa.string())], names=["ends", "sha256"])
        for batch in batches:
            for ends, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
                if ends != now:
                    if sha is not None:
                        yield out()
                    now, sha = ends, hashlib.sha256(piece.as_py().encode())
                else:
                    sha.update(b"," + piece.as_py().encode())
        if sha is not None:
            yield out()

    return rows.mapInArrow(run, "ends long, sha256 string")


def of_keys(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, key, sizes): conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    # Written first: ranges are fitted by reading the keys once more.
    placed = cut(conversations, "keys").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id().cast("long"))
    got = cut(_ranges(placed), "trie")
    levels = [got]
    records, between = got.where("kind = 1"), cut(_between(got.where("kind = 4")), "between")
    top = got.where("kind = 4").agg(F.max("part")).first()[0]
    records, level = records.unionByName(between), 1
    while top is not None:
        last = top < FAN
        now = cut(_level(records.withColumn("group", F.expr(f"part div {FAN}")), level, last), "trie")
        levels.append(now)
        if last:
            break
        records, top, level = now.where("kind = 1"), top // FAN, level + 1
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    nodes = every.where("kind = 0")
    told = cut(every.where("kind = 2").select("ref", F.col("conv_id").alias("told")), "told")
    ends = cut(_digests(nodes, every.where("kind = 3")), "ends")
    own = [c for c in COLUMNS if c not in ("parent_conv_id", "ends_sha256")]
    plain = nodes.where("ref IS NULL AND ends_of IS NULL").select(*COLUMNS)
    rest = nodes.where("ref IS NOT NULL OR ends_of IS NOT NULL").withColumn("ends", F.col("ends_of")[0])
    rest = rest.hint("merge").join(broadcast_if_small(told), "ref", "left").hint("merge").join(broadcast_if_small(ends), "ends", "left")
    rest = rest.select(*own, F.coalesce("parent_conv_id", "told").alias("parent_conv_id"), F.coalesce("ends_sha256", "sha256").alias("ends_sha256"))
    return plain.unionByName(rest).withColumn("depth", F.col("depth").cast("long"))


def trie(conversations: DataFrame, heads: int = 1, most: int = 0) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turn, role, text), rebuilt from the first turns of others where `heads` is above 1 (see `keys`)."""
    return of_keys(keys(turns(conversations), heads, most))


def sql(heads: int = 5, most: int = 8) -> str:
    """The same rows in DuckDB, by grouping every prefix."""
    crc = crc32_sql("encode(conv_id::VARCHAR)")
    return f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {heads} AS base, {crc} % {most + 1} AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = base WHERE i < h
    UNION ALL SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE i >= h),
s AS (SELECT conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY i) FILTER (i IS NOT NULL), []) AS seq FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
p AS (SELECT conv_id, d, seq[:d] AS node, len(seq) AS l FROM s, unnest(range(0, len(seq) + 1)) AS u(d)),
n AS (SELECT d, node, count(*) AS n, min(conv_id) AS conv_id, coalesce(strlen(node[d].text), 0) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (l = d), '')) AS ends_sha256 FROM p GROUP BY d, node),
k AS (SELECT d - 1 AS d, node[:d - 1] AS node, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (d, node)),
a AS (SELECT u.d, node[:u.d] AS node, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * bytes) AS saved FROM m, unnest(range(0, m.d + 1)) AS u(d) GROUP BY ALL)
SELECT m.conv_id, m.d::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n AS n_convs, m.kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN a ON m.d = a.d AND m.node = a.node LEFT JOIN n q ON q.d = m.d - 1 AND q.node = m.node[:m.d - 1]
"""
