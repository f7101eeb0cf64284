"""Conversation prefix trie: adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is a digest of its role and text, ``WIDTH`` bytes, most significant first; a
conversation is the bytes of its turns' ids one after another.  A task puts its conversations
into adaptive radix trees: nodes of 4, 16, 48 or 256 children that grow from one layout to the
next, with every chain of single children kept as one run of bytes (path compression).  Only
byte depths that are multiples of ``WIDTH`` are depths of turns; each of them, inside a run too,
is emitted as a node with its members counted, so what leaves a task is one row for each of its
prefixes.  The trees of all tasks meet in a grouped sum by the prefix.

A prefix is named by ``LIMBS`` sums, over its turns, of digests of (place, turn id).  Sums can be
taken in any order, so a conversation of any length is cut into segments of ``SEGMENT`` turns
that go to different tasks, each with the name of the prefix before it.

Sums over subtrees go up by doubling: after k rounds each node holds the sum of its descendants
less than 2^k below it and the name of its ancestor 2^k above, so a tree of depth d takes log2 d
rounds of a grouped sum and a join.  The ids of the conversations that end at a node are dealt
by range, joined to strings of up to ``CHUNK`` ids, and hashed in order as a stream, so a node
where very many end costs memory for one string only.

Defined results: turns are ordered by turn (null first), then by id; a null role or text is empty; rows without a conv_id belong to no conversation; equal rows are turns of their own; a
conversation that is left without turns ends at the root; an empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigflow.llm.common import numbered
from rigflow.session import materialize

WIDTH = 16               # bytes of a turn id
LIMBS = 4                # sums of 32-bit parts that name a prefix
SEGMENT = 256            # turns of a row that goes into a tree
TREE = 50_000            # segments of one tree; a task starts another beyond that
CHUNK = 4_096            # conversation ids of one string
NAME = [f"k{i}" for i in range(LIMBS)]


# ---------------------------------------------------------------- the tree

class _Few:
    """Up to ``room`` children: their first bytes, ascending, beside the nodes."""

    __slots__ = ("room", "bytes", "nodes")

    def __init__(self, room: int):
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node) -> bool:
        """False if there is no room."""
        at = self.bytes.find(byte)
        if at >= 0:
            self.nodes[at] = node
            return True
        if len(self.nodes) == self.room:
            return False
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return True

    def items(self):
        return list(zip(self.bytes, self.nodes))

    def grown(self):
        bigger = _Few(16) if self.room == 4 else _Indexed()
        for byte, node in self.items():
            bigger.put(byte, node)
        return bigger


class _Indexed:
    """Up to 48 children, found through a table of 256 places."""

    __slots__ = ("places", "nodes")
    room = 48

    def __init__(self):
        self.places, self.nodes = bytearray(256), []

    def get(self, byte: int):
        at = self.places[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node) -> bool:
        if self.places[byte]:
            self.nodes[self.places[byte] - 1] = node
            return True
        if len(self.nodes) == self.room:
            return False
        self.nodes.append(node)
        self.places[byte] = len(self.nodes)
        return True

    def items(self):
        return [(b, self.nodes[at - 1]) for b, at in enumerate(self.places) if at]

    def grown(self):
        bigger = _Full()
        for byte, node in self.items():
            bigger.put(byte, node)
        return bigger


class _Full:
    """A node for every byte."""

    __slots__ = ("nodes",)
    room = 256

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> bool:
        self.nodes[byte] = node
        return True

    def items(self):
        return [(b, n) for b, n in enumerate(self.nodes) if n is not None]


class _Node:
    """``run``: the bytes from its parent to it, the first of them included; members: the keys through it."""

    __slots__ = ("run", "children", "members", "least")

    def __init__(self, run: bytes, members: int, least: int):
        self.run, self.children, self.members, self.least = run, _Few(4), members, least

    def add(self, child: _Node) -> None:
        if not self.children.put(child.run[0], child):
            self.children = self.children.grown()
            self.children.put(child.run[0], child)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common start of two byte strings."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n                                   # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class RadixTree:
    """Keys are bytes; each adds one member, with a number of which the least is kept, to every prefix."""

    def __init__(self):
        self.root = _Node(b"", 0, 0)

    def insert(self, key: bytes, number: int) -> None:
        node, at = self.root, 0
        node.least = min(node.least, number) if node.members else number
        node.members += 1
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.add(_Node(key[at:], 1, number))
                return
            same = _shared(child.run, key[at:at + len(child.run)])
            if same < len(child.run):               # the run is cut where the keys part, or where this one ends
                upper = _Node(child.run[:same], child.members, child.least)
                child.run = child.run[same:]
                upper.add(child)
                node.add(upper)
                child = upper
            child.members += 1
            child.least = min(child.least, number)
            node, at = child, at + same

    def prefixes(self, width: int = WIDTH):
        """(length in ids, the last id, members, least, path) of every prefix of whole ids, parents
        first; path is the list of the ids up to the last, which the next step may change."""
        stack = [(self.root, 0, b"")]
        path: list[bytes] = []
        while stack:
            node, depth, rest = stack.pop()         # rest: the bytes since the last whole id
            own = rest + node.run
            del path[depth:]
            while len(own) >= width:
                path.append(own[:width])
                own = own[width:]
                yield len(path), path[-1], node.members, node.least, path
            for _, child in reversed(node.children.items()):
                stack.append((child, len(path), own))


# ---------------------------------------------------------------- the conversations

def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, id, chars, at (place in its conversation, from 0) and at_of (its turns) of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.unhex(F.substring(digest, 1, 2 * WIDTH)).alias("id"), F.length(text).cast("long").alias("chars"))
    rows, _ = materialize(rows, "turns")
    return numbered(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("id")], "at").select("conv_id", "id", "chars", "at", "at_of")


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Every conversation with the head of its block's first one: the turns (conv_id, at, id, chars),
    and one row for each conversation.  ``turns`` is a written table."""
    conversations = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("base"),
                                                              F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).alias("head"))
    conversations, _ = materialize(conversations, "conversations")
    heads = turns.where((F.col("at") < most) & (F.col("conv_id") % block == 0)).select(F.col("conv_id").alias("base"), "at", "id", "chars", F.col("at_of").alias("length"))
    heads, _ = materialize(heads, "heads")          # at most ``most`` rows for each block
    taken = conversations.join(heads, "base").where(F.col("at") < F.col("head")).select("conv_id", "at", "id", "chars")
    lengths = heads.where("at = 0").select("base", "length")
    own = turns.withColumn("head", F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))).where(F.col("at") >= F.col("head"))
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(lengths, "base", "left")
    place = F.least(F.col("head"), F.coalesce("length", F.lit(0))) + F.col("at") - F.col("head")
    return taken.unionByName(own.select("conv_id", place.alias("at"), "id", "chars")), conversations


def _parts(place: Column, id_: Column) -> list[Column]:
    digest = F.sha2(F.concat(place.cast("string"), F.lit(":"), F.hex(id_)), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(LIMBS)]


def _step(name: tuple, place: int, id_: bytes) -> tuple:
    """The name of a prefix with one more turn (as ``_parts`` in the sums of Spark)."""
    digest = hashlib.sha256(f"{place}:{id_.hex().upper()}".encode()).digest()
    return tuple((k + int.from_bytes(digest[4 * i:4 * i + 4], "big")) & 0xFFFFFFFF for i, k in enumerate(name))


def segments(turns: DataFrame) -> DataFrame:
    """Rows of up to ``SEGMENT`` turns: conv_id, segment, ids and chars in order, and the name of the prefix before them."""
    rows = turns.withColumn("segment", F.floor(F.col("at") / SEGMENT)).withColumns(dict(zip(NAME, _parts(F.col("at"), F.col("id")))))
    packed = rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("at", "id", "chars"))).alias("turns"), *[F.sum(k).alias(k) for k in NAME])
    earlier = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    names = [F.pmod(F.coalesce(F.sum(k).over(earlier), F.lit(0)), F.lit(1 << 32)).alias(f"before_{k}") for k in NAME]
    return packed.select("conv_id", "segment", "turns.id", "turns.chars", *names, *NAME)


_NODES = [*[(k, pa.int64()) for k in NAME], *[(f"up_{k}", pa.int64()) for k in NAME], ("depth", pa.int64()), ("chars", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64())]


def _trees(length: int, most: int):
    """A task that puts segments of ``length`` turns into adaptive radix trees, one for each prefix
    before them, and gives their nodes; after ``most`` segments it begins new trees."""

    def run(batches):
        trees: dict[tuple, RadixTree] = {}
        chars: dict[bytes, int] = {}
        held = 0
        for b in batches:
            for conv, segment, ids, sizes, *before in zip(*[b.column(c).to_pylist() for c in ("conv_id", "segment", "id", "chars", *[f"before_{k}" for k in NAME])]):
                tree = trees.get((segment, *before))
                if tree is None:
                    tree = trees[(segment, *before)] = RadixTree()
                tree.insert(b"".join(ids), conv)
                chars.update(zip(ids, sizes))
                held += 1
                if held == most:
                    yield from _emit(trees, chars, length)
                    trees, chars, held = {}, {}, 0
        yield from _emit(trees, chars, length)

    return run


def _emit(trees: dict, chars: dict, length: int):
    rows: list[tuple] = []
    for (segment, *before), tree in trees.items():
        names = [tuple(before)]
        for depth, last, members, least, _ in tree.prefixes():
            del names[depth:]
            names.append(_step(names[-1], segment * length + depth - 1, last))
            rows.append((*names[-1], *names[-2], segment * length + depth, chars[last], members, least))
            if len(rows) == 50_000:
                yield _batch(rows)
                rows = []
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_NODES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _NODES)], [n for n, _ in _NODES])


def nodes_of(packed: DataFrame, conversations: DataFrame) -> DataFrame:
    """Every node once: its name, its parent's, depth, chars of its last turn, n_convs, conv_id."""
    near = packed.repartitionByRange("conv_id", "segment")                   # conversations of a block share their heads
    made = near.mapInArrow(_trees(SEGMENT, TREE), ", ".join(f"{n} long" for n, _ in _NODES))
    every = made.groupBy(*NAME, *[f"up_{k}" for k in NAME], "depth").agg(F.max("chars").alias("chars"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nothing = [F.lit(0).cast("long").alias(k) for k in NAME]
    root = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        *nothing, *[F.lit(None).cast("long").alias(f"up_{k}") for k in NAME], F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "n_convs", "conv_id")
    return every.unionByName(root)


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """conv_id, depth and the sums of ``values`` over each node's subtree.

    ``nodes``: conv_id and depth (which name a node), parent_conv_id, values.  A written table.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = nodes.select("conv_id", "depth", F.col("parent_conv_id").alias("up"), *values)
    reach = 1
    while reach <= deepest:
        below = sums.where(F.col("depth") >= reach).groupBy(F.col("up").alias("conv_id"), (F.col("depth") - reach).alias("depth")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        added = sums.join(below, ["conv_id", "depth"], "left").select("conv_id", "depth", "up", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
        above = sums.where(F.col("depth") >= reach).select(F.col("conv_id").alias("up"), F.col("depth").alias("_at"), F.col("up").alias("_next"))
        far = F.col("depth") >= 2 * reach                                    # whose ancestor's ancestor exists
        moved = added.where(far).withColumn("_at", F.col("depth") - reach).join(above, ["up", "_at"]).select("conv_id", "depth", F.col("_next").alias("up"), *values)
        sums, _ = materialize(added.where(~far).withColumn("up", F.lit(None).cast("long")).unionByName(moved), "sums")
        reach *= 2
    return sums.drop("up")


_ENDS = "k0 long, k1 long, k2 long, k3 long, ends_sha256 string"


def _chunks(most: int):
    """A task that joins the ids of each name, as they come, to strings of up to ``most``."""

    def row(name, ids):
        return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in name], pa.array(ids[:1], pa.int64()), pa.array([",".join(map(str, ids))])], [*NAME, "first", "ids"])

    def run(batches):
        name, ids = None, []
        for b in batches:
            for *own, conv in zip(*[b.column(c).to_pylist() for c in (*NAME, "conv_id")]):
                if own != name or len(ids) == most:
                    if ids:
                        yield row(name, ids)
                    name, ids = own, []
                ids.append(conv)
        if ids:
            yield row(name, ids)

    return run


def _hashes(batches):
    """One hash for each name, of its strings in order, joined by commas."""
    name, state = None, None

    def row():
        return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in name], pa.array([state.hexdigest()])], [*NAME, "ends_sha256"])

    for b in batches:
        for *own, ids in zip(*[b.column(c).to_pylist() for c in (*NAME, "ids")]):
            if own != name:
                if state:
                    yield row()
                name, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state:
        yield row()


def ends_of(packed: DataFrame, conversations: DataFrame) -> DataFrame:
    """The hash of the ids of the conversations that end at a node, by its name."""
    last = packed.groupBy("conv_id").agg(*[F.pmod(F.sum(k), F.lit(1 << 32)).alias(k) for k in NAME])
    ends, _ = materialize(conversations.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in NAME]), "ends")
    dealt = ends.repartitionByRange(*NAME, "conv_id").sortWithinPartitions(*NAME, "conv_id")
    strings, _ = materialize(dealt.select(*NAME, "conv_id").mapInArrow(_chunks(CHUNK), "k0 long, k1 long, k2 long, k3 long, first long, ids string"), "end-strings")
    return strings.repartition(*NAME).sortWithinPartitions(*NAME, "first").mapInArrow(_hashes, _ENDS)


def prefix_trie(conversations: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations (conv_id, turn, role, text)."""
    turns, _ = materialize(turns_of(conversations), "numbered-turns")
    again, named = rebuilt(turns, block, most)
    packed, _ = materialize(segments(again), "segments")
    nodes, _ = materialize(nodes_of(packed, named), "trie")
    up = [F.col(k).alias(f"up_{k}") for k in NAME]
    children = nodes.where("depth > 0").groupBy(*[f"up_{k}" for k in NAME], F.col("depth").alias("below")).agg(F.count("*").alias("n_children"))
    own = nodes.select(*up, (F.col("depth") + 1).alias("below"), F.col("conv_id").alias("parent_conv_id"))
    key = [f"up_{k}" for k in NAME]
    joined = nodes.withColumn("below", F.col("depth")).join(own, [*key, "below"], "left").drop("below", *key)
    counted = children.select(*[F.col(f"up_{k}").alias(k) for k in NAME], (F.col("below") - 1).alias("depth"), "n_children")
    ends = ends_of(packed, named)
    full = joined.join(counted, [*NAME, "depth"], "left").join(ends, NAME, "left")
    n_children = F.coalesce("n_children", F.lit(0).cast("long"))
    full, _ = materialize(full.select("conv_id", "depth", "parent_conv_id", "n_convs", n_children.alias("n_children"), (n_children == 0).cast("long").alias("n_leaves"),
                                      ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "nodes")
    sums = subtree_sums(full, ["n_leaves", "saved_tokens"])
    return full.drop("n_leaves", "saved_tokens").join(sums, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


OP11_SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT),
      lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
        lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))) % 6 AS h FROM ids),
lists AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST,
    sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT a.conv_id, coalesce(b.turns, [])[1:a.h] || l.turns[a.h + 1:] AS turns
  FROM heads a JOIN lists l USING (conv_id) LEFT JOIN lists b ON b.conv_id = a.base),
hashed AS (SELECT conv_id, turns, list_transform(turns, lambda t: md5(length(t.r)::VARCHAR || ':' || t.r || t.t)) AS marks FROM rebuilt),
prefixes AS (
  SELECT conv_id, d, len(marks) AS ends, array_to_string(marks[1:d], '') AS p, array_to_string(marks[1:d - 1], '') AS up,
         CASE WHEN d > 0 THEN length(turns[d].t) ELSE 0 END AS chars
  FROM (SELECT *, unnest(range(0, len(marks) + 1)) AS d FROM hashed)),
nodes AS (
  SELECT p, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = ends), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d),
children AS (SELECT up, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up, d),
full_nodes AS (
  SELECT a.*, coalesce(c.n, 0) AS n_children FROM nodes a LEFT JOIN children c ON c.up = a.p AND c.d = a.d),
sums AS (
  SELECT q.p, q.d, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n - 1) * f.chars) AS saved
  FROM full_nodes f JOIN prefixes q ON q.conv_id = f.conv_id AND q.d <= f.d GROUP BY q.p, q.d)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s ON s.p = f.p AND s.d = f.d LEFT JOIN nodes u ON f.d > 0 AND u.p = f.up AND u.d = f.d - 1
"""
