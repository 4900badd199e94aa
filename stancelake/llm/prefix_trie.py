"""Prefix trie of conversations in minimal-perfect-hash node tables.

Turns are long; only their digests travel.  The steps:

1. Each turn becomes a 120-bit digest of role and text.  Turns are range
   partitioned by (conversation, turn), so a long conversation spans many
   chunks; a scan numbers them inside a chunk, and one carried row a chunk
   (at most one conversation reaches into it) makes the numbers whole.
2. Conversations are rebuilt by their shared heads.  The digest of a prefix is
   the exclusive-or of position-keyed turn digests: again a scan by chunks and
   one carried row a chunk.  A prefix is a node; nodes are counted with map-side
   combine, so a prefix shared by a third of all rows is one row a task.  Every
   node is checked to have one parent digest and one last turn, which proves by
   induction over depth that equal prefix digests are equal prefixes.
3. A node with more than ``unit_rows`` turns at or below it is heavy.  All below a
   heavy node hangs in units (subtrees with at most ``unit_rows`` nodes), and
   units are dealt to shards.  A shard enumerates its digests, gives each a slot
   by a minimal perfect hash verified against the digest stored in the slot,
   scatters the counts into flat arrays, and accumulates leaves and savings
   through the parent-slot array, deepest level first.
4. Unit roots add their totals to their heavy parents (an aggregate), and heavy
   nodes, disjoint by depth, are folded the same way in bands of levels that
   hold at most ``unit_rows`` of them, from the deepest band up.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

UNIT_ROWS = 1 << 18
SHARD_NODES = 1 << 17
PIECE_BYTES = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()
LANES = ((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9), (0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB))


def mixed(*keys: np.ndarray, lane: int = 0) -> np.ndarray:
    """64 well-stirred bits of some whole numbers."""
    a, b = (np.uint64(x) for x in LANES[lane])
    h = np.full(len(keys[0]), a ^ b, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in keys:
            h = (h ^ k.astype(np.int64).view(np.uint64)) * a
            h ^= h >> np.uint64(29)
            h *= b
            h ^= h >> np.uint64(32)
    return h


class SlotTable:
    """Minimal perfect hash of distinct two-part digests, checked against the digest kept in each slot.

    Level by level, keys that are alone in their cell take the cell's rank as
    slot; those that collide go to the next level.
    """

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        n = len(k1)
        self.levels, self.k1, self.k2 = [], np.zeros(n, np.int64), np.zeros(n, np.int64)
        left, first = np.arange(n), 0
        while len(left):
            level = len(self.levels)
            cells = 2 * len(left) + 1
            at = self._cell(k1[left], k2[left], level, cells)
            alone = np.bincount(at, minlength=cells) == 1
            rank = np.cumsum(alone) - 1 + first
            self.levels.append((cells, alone, rank))
            placed = alone[at]
            slots = rank[at[placed]]
            self.k1[slots], self.k2[slots] = k1[left[placed]], k2[left[placed]]
            first += len(slots)
            left = left[~placed]

    @staticmethod
    def _cell(k1, k2, level: int, cells: int) -> np.ndarray:
        return (mixed(np.full(len(k1), level), k1, k2) % np.uint64(cells)).astype(np.int64)

    def slots(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for a key that is not in the table."""
        out = np.full(len(k1), -1, dtype=np.int64)
        left = np.arange(len(k1))
        for level, (cells, alone, rank) in enumerate(self.levels):
            at = self._cell(k1[left], k2[left], level, cells)
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        known = out >= 0
        same = (self.k1[out[known]] == k1[known]) & (self.k2[out[known]] == k2[known])
        out[np.flatnonzero(known)[~same]] = -1
        return out


# ---- scans over chunks -------------------------------------------------------

def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, t1, t2, n_bytes) with their chunk and their number inside (conversation, chunk)."""
    chunk, last, n = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        if conv[0] != last:
            n = 0
        before = np.repeat(starts, np.diff(np.r_[starts, len(conv)]))
        idx = np.arange(len(conv)) - before + 1
        idx[before == 0] += n
        last, n = conv[-1], int(idx[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), chunk, np.int32)), b.column(0), pa.array(idx), *(b.column(i) for i in (1, 2, 3))],
                                         names=["chunk", "conv_id", "idx", "t1", "t2", "n_bytes"])


def _prefixes(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, last, carry = TaskContext.get().partitionId(), None, [np.uint64(0), np.uint64(0)]
        for b in batches:
            if not b.num_rows:
                continue
            conv, depth, t1, t2 = (b.column(i).to_numpy() for i in range(4))
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            sizes = np.diff(np.r_[starts, len(conv)])
            cols = []
            for lane in (0, 1):
                m = mixed(np.full(len(conv), seed), depth, t1, t2, lane=lane)
                acc = np.bitwise_xor.accumulate(m)
                before = np.r_[np.uint64(0), acc[starts[1:] - 1]]      # all before each conversation
                if conv[0] == last:
                    before[0] = carry[lane]
                p = acc ^ np.repeat(before, sizes)
                carry[lane] = p[-1]
                cols += [pa.array(m.view(np.int64)), pa.array(p.view(np.int64))]
            last = conv[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), chunk, np.int32)), *(b.column(i) for i in range(6)), *cols],
                                             names=["chunk", "conv_id", "depth", "t1", "t2", "n_bytes", "length", "m1", "p1", "m2", "p2"])
    return run


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, t1, t2, n_bytes); a null role or text is empty, a null conv_id has no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda i: F.conv(F.substring("digest", i, 15), 16, 10).cast("long")
    return (conversations.filter("conv_id is not null")
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                    digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
            .select("conv_id", "turn", part(1).alias("t1"), part(16).alias("t2"), "n_bytes"))


def numbered_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with pos, from 1 by (turn, digest), nulls first; (conv_id, n) of all conversations)."""
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("t1"), F.col("t2")]
    sorted_ = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "t1", "t2", "n_bytes")
    rows = staged(sorted_.mapInArrow(_numbered, "chunk int, conv_id long, idx long, t1 long, t2 long, n_bytes long"), "trie-turns")
    spans = rows.groupBy("conv_id", "chunk").agg(F.max("idx").alias("n"))
    w = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    spans = staged(spans.select("conv_id", "chunk", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset")), "trie-spans")
    # at most one conversation reaches into a chunk from the one before: a row a chunk
    carried = F.broadcast(spans.filter("offset > 0").select("conv_id", "chunk", "offset"))
    pos = (F.col("idx") + F.coalesce("offset", F.lit(0))).alias("pos")
    rows = rows.join(carried, ["conv_id", "chunk"], "left").select("conv_id", pos, "t1", "t2", "n_bytes")
    return rows, spans.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(rows (conv_id, depth, t1, t2, n_bytes, length), conversations (conv_id, length)) after the exchange of heads."""
    rows, convs = numbered_turns(turns)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = (convs.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
            .join(bases, "base", "left")
            .withColumn("kept", F.least("h", F.coalesce("n_base", F.lit(0))))
            .withColumn("length", F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    plan = staged(plan.select("conv_id", "base", "h", "kept", "length"), "trie-plan")
    own = (rows.join(plan.select("conv_id", "h", "kept", "length"), "conv_id").filter("pos > h")
           .select("conv_id", (F.col("kept") + F.col("pos") - F.col("h")).alias("depth"), "t1", "t2", "n_bytes", "length"))
    head = rows.filter(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    lent = (head.join(plan.filter("kept > 0"), "base").filter("pos <= kept")
            .select("conv_id", F.col("pos").alias("depth"), "t1", "t2", "n_bytes", "length"))
    return staged(own.unionByName(lent), "trie-rebuilt"), plan.select("conv_id", "length")


def prefix_digests(rows: DataFrame, seed: int = 0) -> DataFrame:
    """(conv_id, depth, length, n_bytes, t1, t2, d1, d2, up1, up2): digest of each prefix and of the one before."""
    scanned = rows.select("conv_id", "depth", "t1", "t2", "n_bytes", "length").repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    schema = ("chunk int, conv_id long, depth long, t1 long, t2 long, n_bytes long, length long, m1 long, p1 long, m2 long, p2 long")
    scanned = staged(scanned.mapInArrow(_prefixes(seed), schema), "trie-prefixes")
    at = F.struct("conv_id", "depth")
    ends = scanned.groupBy("chunk").agg(F.min(at).alias("first"), F.max(F.struct("conv_id", "depth", "p1", "p2")).alias("last"))
    carry, state = [], (None, 0, 0)
    for r in ends.orderBy("chunk").toLocalIterator():       # one row a chunk
        if r.first.depth > 1 and state[0] == r.first.conv_id:
            carry.append((r.chunk, r.first.conv_id, state[1], state[2]))
        through = bool(carry) and carry[-1][0] == r.chunk and r.last.conv_id == r.first.conv_id
        state = (r.last.conv_id, r.last.p1 ^ (state[1] if through else 0), r.last.p2 ^ (state[2] if through else 0))
    carried = rows.sparkSession.createDataFrame(carry, "chunk int, conv_id long, c1 long, c2 long")
    out = scanned.join(F.broadcast(carried), ["chunk", "conv_id"], "left")
    for k in ("1", "2"):
        out = out.withColumn("d" + k, F.col("p" + k).bitwiseXOR(F.coalesce("c" + k, F.lit(0).cast("long"))))
        out = out.withColumn("up" + k, F.col("d" + k).bitwiseXOR(F.col("m" + k)))
    return out.select("conv_id", "depth", "length", "n_bytes", "t1", "t2", "d1", "d2", "up1", "up2")


def trie_nodes(prefixes: DataFrame) -> DataFrame:
    """One row a node below the root: digests, depth, n_convs, first_conv, n_bytes, weight (turns at or below it) and same."""
    checked = ("depth", "up1", "up2", "t1", "t2")
    return (prefixes.groupBy("d1", "d2")
            .agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("first_conv"), F.max("n_bytes").alias("n_bytes"),
                 F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
                 *(F.min(c).alias(c) for c in checked), *(F.max(c).alias(c + "_") for c in checked))
            .withColumn("same", F.forall(F.array(*(F.col(c) == F.col(c + "_") for c in checked)), lambda x: x))
            .select("d1", "d2", "up1", "up2", "depth", "n_convs", "first_conv", "n_bytes", "weight", "same"))


# ---- shards ------------------------------------------------------------------

FOLDED = ("d1 long, d2 long, up1 long, up2 long, depth long, conv_id long, parent_conv_id long, n_convs long, "
          "n_children long, n_leaves long, saved_tokens long, top boolean")


def folded(t: pa.Table) -> pa.Table:
    """Node rows of one shard with their subtree sums; ``top`` where the parent lies elsewhere."""
    col = lambda c: t.column(c).to_numpy().astype(np.int64)
    d1, d2 = col("d1"), col("d2")
    table = SlotTable(d1, d2)
    slot, n = table.slots(d1, d2), len(d1)

    def scattered(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[slot] = values
        return out

    depth, n_convs, first, up1, up2 = (scattered(col(c)) for c in ("depth", "n_convs", "first_conv", "up1", "up2"))
    children, leaves, saved = (scattered(col(c)) for c in ("base_children", "base_leaves", "base_saved"))
    saved += (n_convs - 1) * scattered(col("n_bytes"))
    parent = table.slots(up1, up2)
    inner = parent >= 0
    children += np.bincount(parent[inner], minlength=n)
    leaves += children == 0
    order = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in reversed(np.split(order, cuts)):
        level = level[inner[level]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    names = [c.split()[0] for c in FOLDED.split(", ")]
    above = pa.array(first[np.maximum(parent, 0)], mask=~inner)
    return pa.table([pa.array(table.k1), pa.array(table.k2), pa.array(up1), pa.array(up2), pa.array(depth), pa.array(first), above,
                     pa.array(n_convs), pa.array(children), pa.array(leaves), pa.array(saved), pa.array(~inner)], names=names)


def _fold(nodes: DataFrame, shard) -> DataFrame:
    return nodes.withColumn("shard", shard).groupBy("shard").applyInArrow(folded, FOLDED)


def _tops(done: DataFrame) -> DataFrame:
    """What subtrees whose parent lies elsewhere add to it."""
    return (done.filter("top").groupBy("up1", "up2")
            .agg(F.sum("n_leaves").alias("base_leaves"), F.sum("saved_tokens").alias("base_saved"), F.count(F.lit(1)).alias("base_children")))


def _with_base(nodes: DataFrame, added: DataFrame) -> DataFrame:
    added = added.select(F.col("up1").alias("d1"), F.col("up2").alias("d2"), "base_leaves", "base_saved", "base_children")
    return nodes.join(added, ["d1", "d2"], "left").fillna(0, ["base_leaves", "base_saved", "base_children"])


def subtree_sums(prefixes: DataFrame, nodes: DataFrame, unit_rows: int = UNIT_ROWS, shard_nodes: int = SHARD_NODES) -> tuple[DataFrame, DataFrame]:
    """(all nodes with subtree sums, what depth-1 nodes add to the root)."""
    heavy = nodes.filter(F.col("weight") > unit_rows)
    light = nodes.filter(F.col("weight") <= unit_rows)
    n_light, n_heavy, rows = nodes.agg(F.count_if(F.col("weight") <= unit_rows), F.count_if(F.col("weight") > unit_rows), F.sum("n_convs")).first()
    units = prefixes.select(F.col("conv_id").alias("first_conv"), "depth", F.col("d1").alias("u1"), F.col("d2").alias("u2"))
    if n_heavy:     # the unit of a node is the first light prefix of a member
        deepest = prefixes.join(heavy.select("d1", "d2"), ["d1", "d2"]).groupBy(F.col("conv_id").alias("first_conv")).agg(F.max("depth").alias("heavy_depth"))
        units = units.join(deepest, "first_conv", "left").filter("depth = coalesce(heavy_depth, 0) + 1").drop("heavy_depth")
    else:
        units = units.filter("depth = 1")
    units = units.drop("depth")
    zero = [F.lit(0).cast("long").alias(c) for c in ("base_leaves", "base_saved", "base_children")]
    shards = max(1, math.ceil((n_light or 0) / shard_nodes))
    done = staged(_fold(light.join(units, "first_conv").select("*", *zero), F.pmod(F.xxhash64("u1", "u2"), F.lit(shards))), "trie-folded")
    added = _tops(done)
    if n_heavy:
        # heavy nodes of one depth share no rows, so a depth has at most rows / unit_rows of them
        width = max(1, unit_rows // max(1, rows // unit_rows))
        heavy = staged(heavy.withColumn("band", F.floor(F.col("depth") / width)), "trie-heavy")
        added = staged(added, "trie-added")
        for band in range(heavy.agg(F.max("band")).first()[0], -1, -1):
            part = staged(_fold(_with_base(heavy.filter(F.col("band") == band), added), F.lit(0)), "trie-band")
            more = added.unionByName(_tops(part)).groupBy("up1", "up2").agg(*(F.sum(c).alias(c) for c in ("base_leaves", "base_saved", "base_children")))
            added = staged(more, "trie-added")
            done = done.unionByName(part)
        above = heavy.select(F.col("d1").alias("up1"), F.col("d2").alias("up2"), F.col("first_conv").alias("above"))
        keyed = [F.when(F.col("top"), F.col(c)).alias(c) for c in ("up1", "up2")]
        rest = [c for c in done.columns if c not in ("up1", "up2")]
        done = (done.select(*rest, *keyed).join(above, ["up1", "up2"], "left")
                .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).drop("above"))
    return done, added.filter("up1 = 0 and up2 = 0")


# ---- ends --------------------------------------------------------------------

def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (d1, d2, conv_id) as comma-joined pieces of bounded size."""
    schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("conv_id", pa.int64()), ("ids", pa.string())])
    node, held, size = None, [], 0

    def piece():
        return (*node, held[0], ",".join(map(str, held)))

    out: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(3))):
            if held and (row[:2] != node or size >= PIECE_BYTES):
                out.append(piece())
                held, size = [], 0
            node = row[:2]
            held.append(row[2])
            size += 12
            if len(out) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
    if held:
        out.append(piece())
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of one node after the other -> its SHA-256."""
    names = ["d1", "d2", "ends_sha256"]
    node, state = None, None
    for b in batches:
        out = []
        for d1, d2, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
            if (d1, d2) != node:
                if state is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (d1, d2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=names)


def ends(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of nodes at which a conversation ends."""
    zero = F.lit(0).cast("long")
    last = prefixes.filter("depth = length").select("d1", "d2", "conv_id").unionByName(
        convs.filter("length = 0").select(zero.alias("d1"), zero.alias("d2"), "conv_id"))
    order = ["d1", "d2", "conv_id"]
    pieces = last.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "d1 long, d2 long, conv_id long, ids string")
    return (pieces.repartition("d1", "d2").sortWithinPartitions(*order).mapInArrow(_hashed, "d1 long, d2 long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, group: int = 5, heads: int = 9, unit_rows: int = UNIT_ROWS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, the root included.

    ``conversations`` has conv_id, turn, role and text; other columns are ignored.
    Conversation c takes the first h turns of conversation c - c % group (h is
    the CRC-32 of the decimal c modulo ``heads``) and its own turns after its
    first h.  Turns are ordered by turn, null first; rows with the same turn, repeated
    rows included, are turns of their own, ordered by the digest of role and text.  A null
    role or text is empty; a row with a null conv_id belongs to no conversation.  Texts of
    any length count by their digest.  A rebuilt conversation may have no turn: it
    ends at the root.  An empty table has no conversation, so no root and no rows.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    turns = staged(turn_digests(conversations), "trie-digests")
    rows, convs = rebuilt(turns, group, heads)
    for seed in range(3):
        prefixes = prefix_digests(rows, seed)
        nodes = staged(trie_nodes(prefixes), "trie-nodes")
        if nodes.filter("not same or (d1 = 0 and d2 = 0)").isEmpty():
            break
    else:
        raise RuntimeError("prefix digests collide under every seed")
    done, to_root = subtree_sums(prefixes, nodes, unit_rows, shard_nodes)
    every = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()
    added = to_root.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("base_children", "base_leaves", "base_saved"))).first()
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, d1 long, d2 long"
    root = [(every.conv_id, 0, None, every.n_convs, added[0], added[1] if added[0] else 1, added[2], 0, 0)] if every.n_convs else []
    root = rows.sparkSession.createDataFrame(root, schema)
    below = done.withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(every.conv_id).cast("long")))
    out = below.select(*root.columns).unionByName(root).join(ends(prefixes, convs), ["d1", "d2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
