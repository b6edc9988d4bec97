"""Operator 12: the prefix trie of conversations, by a skeleton of splitters.

A conversation is the sequence of its turns' digests. Sequences are dealt out by ranges between
splitters, sequences of a sample, and sorted, so a subtree lies in one shard unless it has members
on both sides of a splitter; then its top is a prefix of the splitter. The trie of the splitters, the
skeleton, is broadcast. A shard walks its sorted sequences with a stack and finishes every node
off the skeleton; what it saw of nodes on it are partial sums, which are added up.

Long conversations are cut into storeys of STOREY turns. The turn that ends a storey is the root of
a trie in the next one, known by a digest of all before it, so a sequence of any length is the work of
many tasks, and no row or skeleton path is longer than a storey. What lies below a storey comes to
it by way of owners: a node belongs to its smallest member, each conversation carries the sums of
the nodes that it owns below, and the members of a node together own its whole subtree.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.shared import materialize, partitions, range_buckets, running_total, ship, united

#: Turns of a storey.
STOREY = 64
#: Sequences a shard is made for; sequences of the sample for each shard, and at most in all.
SHARD, SAMPLED, SAMPLE = 100_000, 20, 400_000
#: Characters of ids that travel together to be hashed.
BLOCK = 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()

KEY = "s int, root string, path array<binary>, conv long"
SEGMENT = f"{KEY}, chars array<int>, head int, door string, low_leaves long, low_saved long"
NODE = "kind int, key binary, up array<binary>, parent_key binary, parent_conv long, conv long, depth long, n long, children long, leaves long, saved long, own long, chars long, door boolean, spine boolean, ends string, block string"


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of SHA-256 of role and text, each known apart."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv, pos from 0, digest, chars; written.

    Order: turn, null first, then the digest of role and text. Conversations are dealt out by
    ranges of that order, so one of any length is the work of many tasks. Rows of null conv_id take no part.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    light = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", turn_digest(role, text).alias("digest"), F.length(text).alias("chars"), F.monotonically_increasing_id().alias("_row")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("_row")]
    dealt = range_buckets(light, [F.col("conv"), *order], "turns")
    return materialize(running_total(dealt, ["conv"], order, F.lit(1).cast("long"), "pos").select("conv", "pos", "digest", "chars"), "numbered-turns")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """numbered_turns -> (conv, d from 1, digest, chars) of the rebuilt conversations, and (conv, length) of all.

    Conversation c begins with the first h turns of c - c % group, h = crc32(c) % most, and goes on with
    its own turns after the first h.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    asked = sizes.withColumns({"base": F.col("conv") - F.col("conv") % group, "h": F.crc32(F.col("conv").cast("string")) % most})
    bases = sizes.where(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    taken = F.least("h", F.coalesce("base_own", F.lit(0).cast("long")))
    convs = asked.join(bases, "base", "left").select("conv", "base", "h", "own", taken.alias("taken"))
    convs = materialize(convs.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    heads = turns.where((F.col("conv") % group == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv", "base")
    first = convs.select("conv", "base", "h").join(heads, "base").where(F.col("pos") < F.col("h"))
    first = first.select("conv", (F.col("pos") + 1).alias("d"), "digest", "chars")
    h = F.crc32(F.col("conv").cast("string")) % most
    rest = turns.where(F.col("pos") >= h).join(convs.select("conv", "h", "taken"), "conv")
    rest = rest.select("conv", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("d"), "digest", "chars")
    return united(first, rest), convs.select("conv", "length")


def segments(turns: DataFrame, convs: DataFrame, storey: int = STOREY) -> DataFrame:
    """(conv, d, digest, chars), (conv, length) -> SEGMENT rows, written: one a conversation and storey, of `storey` turns at most.

    A conversation that ends with a storey has an empty one after it, so each has its end in the trie where it is a
    member. root tells apart what comes before a storey, door what comes before the next; head has
    the characters of the turn at the root.
    """
    own = turns.withColumn("s", F.floor((F.col("d") - 1) / storey).cast("int"))
    held = own.groupBy("conv", "s").agg(F.sort_array(F.collect_list(F.struct("d", "digest", "chars"))).alias("t"))  # a storey at most
    held = held.select("conv", "s", F.col("t.digest").alias("path"), F.col("t.chars").alias("chars"))
    ended = convs.where(F.col("length") % storey == 0).select("conv", F.floor(F.col("length") / storey).cast("int").alias("s"))
    none = ended.select("conv", "s", F.array().cast("array<binary>").alias("path"), F.array().cast("array<int>").alias("chars"))
    plain = materialize(united(held, none), "segments")
    full = plain.where(F.size("path") == storey).select("conv", "s", F.element_at("chars", -1).alias("last"), *[F.xxhash64(F.lit(i), "s", "path").cast("decimal(20,0)").alias(f"z{i}") for i in (0, 1)])
    dealt = range_buckets(full, [F.col("conv"), F.col("s")], "storeys")
    for i in (0, 1):
        dealt = running_total(dealt, ["conv"], [F.col("s")], F.col(f"z{i}"), f"b{i}")
    name = F.concat_ws("/", *[(F.col(f"b{i}") + F.col(f"z{i}")).cast("string") for i in (0, 1)])
    doors = materialize(dealt.select("conv", "s", name.alias("door"), "last"), "doors")
    roots = doors.select("conv", (F.col("s") + 1).alias("s"), F.col("door").alias("root"), F.col("last").alias("head"))
    met = plain.join(doors.select("conv", "s", "door"), ["conv", "s"], "left").join(roots, ["conv", "s"], "left")
    zero = F.lit(0).cast("long")
    rows = met.select("s", F.coalesce("root", F.lit("")).alias("root"), "path", "conv", "chars", F.coalesce("head", F.lit(0)).alias("head"), "door", zero.alias("low_leaves"), zero.alias("low_saved"))
    return materialize(rows, "rooted-segments")


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _key(s: int, root: str, path: list[bytes]) -> bytes:
    return hashlib.blake2b(f"{s}|{root}|".encode() + b"".join(path), digest_size=16).digest()


class Frame:
    """A node whose subtree is being read."""

    __slots__ = ("chars", "children", "conv", "door", "ends", "held", "key", "leaves", "n", "rows", "saved", "size", "spine", "start")

    def __init__(self, chars: int, spine: bool, door: bool, key: bytes | None):
        self.chars, self.spine, self.door, self.key = chars, spine, door, key
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends = None  # the hash of the ids of members that end here
        self.held, self.size, self.start = [], 0, None  # of a partial node, the ids themselves
        self.rows: list[dict] = []  # finished children, until it is known whose node this is


class Shard:
    """Walks the sorted segments between two splitters."""

    def __init__(self, low: tuple | None, high: tuple | None, storey: int):
        self.bounds = [x for x in (low, high) if x is not None]
        self.storey = storey
        self.s, self.root, self.path = None, None, []
        self.stack: list[Frame] = []
        self.keys: list[bytes] = []  # of the nodes on the stack that have one
        self.out: list[dict] = []

    def add(self, s: int, root: str, path: list[bytes], conv: int, chars: list[int], head: int, door: str | None, leaves: int, saved: int) -> None:
        if (s, root) != (self.s, self.root):
            self.close()
            self.s, self.root, self.path = s, root, []
            self.splits = [x[2] for x in self.bounds if x[:2] == (s, root)]
            self.stack = [Frame(head, s == 0 or bool(self.splits), False, _key(s, root, []))]
        same = _common(self.path, path)
        while len(self.stack) > same + 1:
            self._pop()
        spine = max((_common(split, path) for split in self.splits), default=-1)
        for i in range(same, len(path)):
            last = i + 1 == self.storey
            on = i < spine
            key = _key(s + 1, door, []) if last else _key(s, root, path[: i + 1]) if on else None
            self.stack.append(Frame(chars[i], on, last, key))
        self.path = path
        top = self.stack[-1]
        top.n += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        top.leaves += leaves
        top.saved += saved
        if not top.door:
            self._end(top, conv)

    def _end(self, top: Frame, conv: int) -> None:
        if top.key is None:
            if top.ends is None:
                top.ends = hashlib.sha256(str(conv).encode())
            else:
                top.ends.update(f",{conv}".encode())
            return
        if top.start is None:
            top.start = conv
        top.held.append(str(conv))
        top.size += len(top.held[-1]) + 1
        if top.size >= BLOCK:
            self._block(top)

    def _block(self, top: Frame) -> None:
        if top.held:
            self.out.append({"kind": 2, "key": top.key, "conv": top.start, "block": ",".join(top.held)})
        top.held, top.size, top.start = [], 0, None

    def _pop(self) -> None:
        node = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        depth = self.s * self.storey + len(self.stack)
        row = {"kind": 0 if node.key is None else 1, "key": node.key, "depth": depth, "conv": node.conv, "n": node.n, "children": node.children, "door": node.door, "spine": node.spine, "chars": node.chars, "parent_key": None, "up": []}
        row["own"] = 0 if node.door else (node.n - 1) * node.chars
        if node.key is not None:
            self._block(node)
        else:
            node.leaves += node.children == 0
            node.saved += row["own"]
            row["ends"] = node.ends.hexdigest() if node.ends else NOTHING
        row["leaves"], row["saved"] = node.leaves, node.saved
        for child in node.rows:
            child["parent_conv"] = node.conv
        self.out += node.rows
        if above is not None:
            if above.spine:
                row["parent_key"] = above.key
                row["up"] = [f.key for f in self.stack] if node.spine else []
                self.out.append(row)
            else:
                above.rows.append(row)
            above.n += node.n
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
            if not node.spine:
                above.children += 1
                above.leaves += node.leaves
                above.saved += node.saved
        else:
            self.out.append(row)

    def close(self) -> None:
        while self.stack:
            self._pop()


def splitters(segs: DataFrame, shards: int, rows: int) -> list[tuple]:
    """At most shards - 1 segments of a sample, of SAMPLED for a shard and about SAMPLE in all, that part the others evenly."""
    share = min(1.0, min(SAMPLED * shards, SAMPLE) / max(rows, 1))
    drawn = segs.select("s", "root", "path", "conv").sample(share, seed=12).toArrow().to_pylist()
    order = sorted((r["s"], r["root"], r["path"], r["conv"]) for r in drawn)
    return sorted({(s, root, tuple(path), conv) for s, root, path, conv in (order[len(order) * i // shards] for i in range(1, shards) if order)})


def walked(segs: DataFrame, storey: int = STOREY) -> DataFrame:
    """SEGMENT rows, written -> NODE rows, written: kind 0 finished nodes, 1 partial nodes, 2 ids of members that end in partial nodes."""
    spark = segs.sparkSession
    ship(spark)
    rows = segs.count()
    shards = max(partitions(spark), -(-rows // SHARD))
    split = [(s, root, list(path), conv) for s, root, path, conv in splitters(segs, shards, rows)]
    skeleton = spark.sparkContext.broadcast(split)  # a storey's path for each shard at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = skeleton.value
        for batch in batches:
            keys = zip(*[batch.column(i).to_pylist() for i in range(4)])
            at = pa.array([bisect_right(known, (s, root, path, conv)) for s, root, path, conv in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, at], names=[*batch.schema.names, "shard"])

    kind = pa.schema(
        [("kind", pa.int32()), ("key", pa.binary()), ("up", pa.list_(pa.binary())), ("parent_key", pa.binary())]
        + [(c, pa.int64()) for c in ("parent_conv", "conv", "depth", "n", "children", "leaves", "saved", "own", "chars")]
        + [("door", pa.bool_()), ("spine", pa.bool_()), ("ends", pa.string()), ("block", pa.string())]
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at, shard = skeleton.value, None, None
        for batch in batches:
            made = []
            for *segment, number in zip(*[c.to_pylist() for c in batch.columns]):
                if number != at:
                    if shard:
                        shard.close()
                        made += shard.out
                    at = number
                    shard = Shard(known[at - 1] if at else None, known[at] if at < len(known) else None, storey)
                shard.add(*segment)
            made, shard.out = made + shard.out, []
            yield pa.RecordBatch.from_pylist(made, schema=kind)
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pylist(shard.out, schema=kind)

    dealt = segs.mapInArrow(deal, f"{SEGMENT}, shard int").repartitionById(shards, "shard")
    ordered = dealt.sortWithinPartitions("shard", "s", "root", "path", "conv")
    return materialize(ordered.mapInArrow(walk, NODE), "trie-nodes")


def joined_ends(blocks: DataFrame) -> DataFrame:
    """blocks(key, conv, block) -> key, ends: the hash of a node's blocks in order, read as they come, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            keys, ends = [], []
            for k, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        ends.append(digest.hexdigest())
                    key, digest = k, hashlib.sha256(block.encode())
                else:
                    digest.update(b"," + block.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], names=["key", "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "ends"])

    dealt = blocks.repartition("key").sortWithinPartitions("key", "conv")
    return dealt.select("key", "block").mapInArrow(run, "key binary, ends string")


def joined_nodes(found: DataFrame) -> DataFrame:
    """walked() -> conv, depth, parent_conv, n, children, leaves, saved, own, ends: all nodes; partial ones are added up."""
    partial = found.where("kind = 1")
    seen = partial.where("not door").groupBy("key").agg(
        F.first("up").alias("up"), F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n").alias("n"),
        F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.first("chars").alias("chars"), F.first("spine").alias("spine"),
    )
    doors = partial.where("door").groupBy("key").agg(
        F.first("up").alias("up"), F.first("parent_key").alias("parent_key"), F.first("parent_conv").alias("parent_conv"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.first("spine").alias("spine")
    )
    seen, doors = materialize(seen, "partial-nodes"), materialize(doors, "doors")
    inner = seen.where(F.col("parent_key").isNotNull()).select("parent_key")
    kids = united(inner, doors.where("spine").select("parent_key")).groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("kids"))
    whole = seen.join(kids, "key", "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0))).withColumn("own", (F.col("n") - 1) * F.col("chars"))
    whole = materialize(whole.drop("kids"), "whole-nodes")
    # what each node on the skeleton has beside other such nodes goes to all above it: a path's length of rows
    leaf = F.when(F.col("children") == 0, 1).otherwise(0)
    given = whole.select(F.explode(F.concat("up", F.array("key"))).alias("key"), (F.col("leaves") + leaf).alias("leaves"), (F.col("saved") + F.col("own")).alias("saved"))
    given = united(given, doors.where("spine").select(F.explode("up").alias("key"), "leaves", "saved"))
    sums = given.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    spine = F.broadcast(whole.where("spine").select(F.col("key").alias("parent_key"), F.col("conv").alias("_spine")))  # a storey's path for each shard at most
    ends = joined_ends(found.where("kind = 2"))
    roots = doors.join(spine, "parent_key", "left").select("key", F.coalesce("parent_conv", "_spine").alias("_before"))
    met = whole.drop("leaves", "saved").join(sums, "key").join(ends, "key", "left").join(roots, "key", "left").join(spine, "parent_key", "left")
    columns = ["conv", "depth", "parent_conv", "n", "children", "leaves", "saved", "own", "ends"]
    met = met.withColumns({"parent_conv": F.coalesce("_spine", "_before"), "ends": F.coalesce("ends", F.lit(NOTHING))}).select(*columns)
    finished = found.where("kind = 0").join(spine, "parent_key", "left").withColumn("parent_conv", F.coalesce("parent_conv", "_spine"))
    return united(finished.select(*columns), met)


def carried(segs: DataFrame, storey: int = STOREY) -> DataFrame:
    """segs with low_leaves and low_saved: what their conversation owns in the storeys below.

    The tries below the first storey are walked once for that. If there are none, nothing is carried.
    """
    deep = segs.where("s > 0")
    if deep.isEmpty():
        return segs
    nodes = joined_nodes(walked(materialize(deep, "deep-segments"), storey))
    owned = nodes.groupBy("conv", F.floor(F.col("depth") / storey).cast("int").alias("s")).agg(
        F.sum(F.when(F.col("children") == 0, 1).otherwise(0)).alias("w0"), F.sum("own").alias("w1")
    )
    several = segs.where((F.col("s") > 0) | F.col("door").isNotNull()).select("conv", "s")
    rows = several.join(owned, ["conv", "s"], "left").na.fill(0, ["w0", "w1"])
    order = [F.col("s").desc()]
    dealt = range_buckets(rows, [F.col("conv"), *order], "carried")
    for i, out in enumerate(("low_leaves", "low_saved")):
        dealt = running_total(dealt, ["conv"], order, F.col(f"w{i}"), out)
    low = dealt.select("conv", "s", *[F.col(c).alias(f"_{c}") for c in ("low_leaves", "low_saved")])
    # only to the last row of a storey that another follows: its door
    met = segs.join(low, ["conv", "s"], "left")
    return materialize(met.select("s", "root", "path", "conv", "chars", "head", "door", *[F.coalesce(f"_{c}", c).alias(c) for c in ("low_leaves", "low_saved")]), "carrying-segments")


def prefix_trie(turns: DataFrame, convs: DataFrame, storey: int = STOREY) -> DataFrame:
    """turns(conv, d from 1, digest, chars), convs(conv, length) -> the nodes of their trie.

    conv, depth, parent_conv, n, children, leaves, saved, own, ends: as the query names them.
    """
    return joined_nodes(walked(carried(segments(turns, convs, storey), storey), storey))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations. Null roles and texts are empty. Rows of equal turn go by the
    digest of role and text; rows that repeat each other are turns of their own. Rows of null conv_id
    belong to no conversation. Conversations and texts of any length; other columns are not read. No
    conversations: no rows."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    nodes = prefix_trie(*rebuilt(numbered_turns(turns)))
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLE_SQL: dict[str, str] = {
    "op12_prefix_trie": """
WITH t AS (
    SELECT conv_id, length(x) AS chars, sha256(length(r) || ':' || r || x) AS one,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) - 1 AS pos
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
),
b AS (
    SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
           [4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS bits
    FROM t
),
c AS (
    SELECT conv_id, base,
           xor(list_reduce(bits, lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 6 AS h
    FROM b
),
turns AS (
    SELECT c.conv_id, 0 AS part, pos, one, chars FROM c JOIN t ON t.conv_id = c.base AND pos < h
    UNION ALL SELECT c.conv_id, 1, pos, one, chars FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h
),
paths AS (
    SELECT conv_id, row_number() OVER w AS depth, chars, string_agg(one, '/') OVER w AS path
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT conv_id, 0, 0, '' FROM c
),
linked AS (
    SELECT *, lag(path) OVER w AS parent, lead(path) OVER w IS NULL AS last FROM paths WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
),
nodes AS (
    SELECT path, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS own,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
    FROM linked GROUP BY path, depth
),
kids AS (SELECT parent, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
whole AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.parent = nodes.path),
below AS (
    SELECT l.path, sum(CASE WHEN w.conv_id = l.conv_id THEN own ELSE 0 END) OVER v AS saved,
           sum(CASE WHEN w.conv_id = l.conv_id AND n_children = 0 THEN 1 ELSE 0 END) OVER v AS leaves
    FROM linked l JOIN whole w ON w.path = l.path WINDOW v AS (PARTITION BY l.conv_id ORDER BY l.depth DESC ROWS UNBOUNDED PRECEDING)
),
sums AS (SELECT path, sum(saved)::BIGINT AS saved_tokens, sum(leaves)::BIGINT AS n_leaves FROM below GROUP BY path)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM whole w JOIN sums ON sums.path = w.path LEFT JOIN whole p ON p.path = w.parent
"""
}
