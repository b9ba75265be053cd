"""Prefix trie of conversations: a table of nodes in the slots of minimal perfect hashes.

Every distinct prefix of turns is a node, named by a 128-bit digest. Nodes of two and more
conversations are dealt to shards; a node with one conversation needs no sums of others.
In a shard each digest gets a slot of its own among as many slots as there are nodes
(levels of hashing; what collides goes on to the next level; found slots are verified by the
digest that lies there). Counts are scattered into flat arrays by slot and added up through
an array of parent slots, from the deepest nodes to the highest.

A shard holds whole subtrees: those below the highest nodes under which no more than a
bounded number of turns lie. The few nodes above them, the crown, are added up afterwards in
bands of depths, each of which is small.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskmart.llm import arrays
from riskmart.llm.storing import kept, partitions
from riskmart.operators.keys import HOT_SHARE, join_many_to_one
from riskmart.operators.ordering import ROW_BITS, running_sums

PIECE_TURNS = 1 << 18       # turns below the top of a subtree that stays in one shard, at most
SHARD_NODES = 1 << 19       # nodes of a shard, about
BAND_NODES = 1 << 20        # nodes of the crown added up at once, about
BLOCK_TURNS = 4096          # turns of a conversation whose digests are chained in one window
DIGEST = ["hi", "lo"]


# -- order and digests -------------------------------------------------------

def ordered_turns(turns: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(id, place, a, b, bytes), stored: each conversation's turns numbered from 1.

    By turn, null first; turns of one number by the first 32 characters of the role, then the
    first 256 of the text, then a digest of both. Null roles and texts count as empty; rows
    without an id are left out. a and b hash role and whole text, bytes is the text's length.
    Rows are dealt by ranges of the whole order, so a conversation may fill many tasks.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
        F.monotonically_increasing_id().alias("row"),
    ).select(
        "id", "turn", F.substring("role", 1, 32).alias("r"), F.substring("text", 1, 256).alias("t"),
        F.md5(F.concat("role", F.lit("\0"), "text")).alias("m"), "row",
        F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("b"), "text", "role").alias("b"),
        F.octet_length("text").cast("long").alias("bytes"),
    )
    order = ["id", "turn", "r", "t", "m", "row"]
    dealt = named.repartitionByRange(partitions(turns), *order).sortWithinPartitions(*order)
    rows = kept(dealt.select("id", "a", "b", "bytes", F.monotonically_increasing_id().alias("at")))
    rows = rows.withColumn("part", F.shiftright("at", ROW_BITS))
    earlier = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("id", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(earlier))
    before = before.where("before > 0").select("id", "part", "before")        # one conversation per partition at most
    inside = F.row_number().over(Window.partitionBy("id", "part").orderBy("at"))
    placed = rows.withColumn("inside", inside).join(F.broadcast(before), ["id", "part"], "left")
    return kept(placed.select(
        "id", (F.col("inside") + F.coalesce("before", F.lit(0))).cast("long").alias("place"), "a", "b", "bytes"
    ))


def hot_ids(sizes: DataFrame, key, count, rows) -> list:
    """Keys with more than a fraction of a partition's share of the rows; few, as they share the rows."""
    least = rows / (HOT_SHARE * partitions(sizes))
    return [r[0] for r in sizes.where(F.col(count) > least).select(key).collect()]


def prefix_rows(turns: DataFrame, members: DataFrame) -> DataFrame:
    """(id, depth, length, bytes, hi, lo, phi, plo): a row per prefix of each conversation, the
    empty one included, with the digests of the prefix and of the one before it.

    A digest is the XOR of two 64-bit hashes of each turn and its place; blocks of turns are
    chained on their own and joined with what comes before, so long conversations are spread.
    """
    own = turns.select(
        "id", F.col("place").alias("depth"), "length", "bytes",
        F.floor((F.col("place") - 1) / BLOCK_TURNS).alias("block"),
        F.xxhash64("place", "a", "b").alias("x"), F.xxhash64("b", F.lit("y"), "place", "a").alias("y"),
    )
    upto = Window.partitionBy("id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    chained = own.withColumns({"hi": F.bit_xor("x").over(upto), "lo": F.bit_xor("y").over(upto)})
    earlier = Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = sums.select("id", "block", F.bit_xor("x").over(earlier).alias("bx"), F.bit_xor("y").over(earlier).alias("by"))
    chained = chained.join(before.where("block > 0"), ["id", "block"], "left")
    none = F.lit(0).cast("long")
    deep = chained.select(
        "id", "depth", "length", "bytes",
        F.col("hi").bitwiseXOR(F.coalesce("bx", none)).alias("hi"), F.col("lo").bitwiseXOR(F.coalesce("by", none)).alias("lo"), "x", "y",
    ).select("id", "depth", "length", "bytes", "hi", "lo", F.col("hi").bitwiseXOR(F.col("x")).alias("phi"), F.col("lo").bitwiseXOR(F.col("y")).alias("plo"))
    absent = F.lit(None).cast("long")
    top = members.select("id", none.alias("depth"), "length", none.alias("bytes"), none.alias("hi"), none.alias("lo"), absent.alias("phi"), absent.alias("plo"))
    return deep.unionByName(top)


# -- slots and sums ----------------------------------------------------------

class Slots:
    """A minimal perfect hash of distinct 128-bit digests.

    Each level hashes the digests that are left into twice as many places; those alone in
    their place get the next slots, the others go on. `find` verifies the digest in the slot.
    """

    def __init__(self, hi, lo):
        n = len(hi)
        self.levels, self.slot = [], np.empty(n, np.int64)
        self.hi, self.lo = np.empty(n, np.uint64), np.empty(n, np.uint64)
        left, given = np.arange(n), 0
        while len(left):
            size = 2 * len(left) + 8
            at = self._place(hi[left], lo[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            slots = np.where(alone, given - 1 + np.cumsum(alone), -1)
            settled = alone[at]
            self.slot[left[settled]] = slots[at[settled]]
            self.levels.append(slots)
            given += int(settled.sum())
            left = left[~settled]
        self.hi[self.slot], self.lo[self.slot] = hi, lo

    @staticmethod
    def _place(hi, lo, level, size):
        seed = np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
        return (arrays.mixed(arrays.mixed(hi + seed) + lo) % np.uint64(size)).astype(np.int64)

    def find(self, hi, lo):
        """The slot of each digest, -1 for those that have none."""
        out, left = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for level, slots in enumerate(self.levels):
            out[left] = slots[self._place(hi[left], lo[left], level, len(slots))]
            left = left[out[left] < 0]
        there = out >= 0
        there[there] = (self.hi[out[there]] == hi[there]) & (self.lo[out[there]] == lo[there])
        return np.where(there, out, -1)


def subtree_sums(hi, lo, phi, plo, depth, leaves, saved):
    """(leaves, saved, parent is elsewhere) of each node with all below it that is given."""
    slots = Slots(hi, lo)
    parent, level = np.empty(len(hi), np.int64), np.empty(len(hi), np.int64)
    parent[slots.slot], level[slots.slot] = slots.find(phi, plo), depth
    sums = []
    for values in (leaves, saved):
        flat = np.empty(len(hi), np.int64)
        flat[slots.slot] = values
        sums.append(flat)
    order = np.argsort(-level, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(level[order]) != 0))
    for a, b in zip(heads, np.append(heads[1:], len(order))):
        below = order[a:b][parent[order[a:b]] >= 0]
        for flat in sums:
            np.add.at(flat, parent[below], flat[below])
    return sums[0][slots.slot], sums[1][slots.slot], parent[slots.slot] < 0


SUMS = "hi long, lo long, phi long, plo long, leaves long, saved long, top boolean"


def _summed(nodes: DataFrame) -> DataFrame:
    """Sums of each group of nodes that share a `shard`, stored."""

    def add(table):
        table = table.combine_chunks()
        # the root has no parent: a digest that no node has stands for it
        hi, lo = (table.column(c).to_numpy().view(np.uint64) for c in DIGEST)
        phi, plo = (table.column(c).fill_null(-1).to_numpy().view(np.uint64) for c in ("phi", "plo"))
        depth, leaves, saved = (table.column(c).to_numpy() for c in ("depth", "leaves", "saved"))
        leaves, saved, top = subtree_sums(hi, lo, phi, plo, depth, leaves, saved)
        top &= depth > 0
        columns = [table.column(c) for c in ("hi", "lo", "phi", "plo")] + [pa.array(leaves), pa.array(saved), pa.array(top)]
        return pa.Table.from_arrays(columns, names=["hi", "lo", "phi", "plo", "leaves", "saved", "top"])

    return kept(nodes.select("shard", *DIGEST, "phi", "plo", "depth", "leaves", "saved").groupBy("shard").applyInArrow(add, SUMS))


def _with_tops(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Adds the sums of subtrees that hang below some of the nodes."""
    hung = tops.groupBy(F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(
        F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
    )
    return nodes.join(hung, DIGEST, "left").withColumns({
        "leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)),
        "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)),
    }).drop("more_leaves", "more_saved")


def _all_sums(shared: DataFrame, limit) -> DataFrame:
    """(hi, lo, leaves, saved) of all nodes with two and more conversations."""
    count = shared.agg(F.count_if(F.col("below") <= limit), F.count_if(F.col("below") > limit)).first()
    shards = max(partitions(shared), math.ceil(count[0] / SHARD_NODES))
    done = _summed(shared.where(F.col("below") <= limit).withColumn("shard", F.pmod(F.xxhash64("piece_hi", "piece_lo"), F.lit(shards))))
    crown = shared.where(F.col("below") > limit)
    bands = 1
    if count[1] > BAND_NODES:
        widths = crown.groupBy("depth").agg(F.count("*").alias("n"))
        placed, _ = running_sums(widths, "depth", ("n",))
        band = kept(placed.select("depth", F.floor(F.col("n_above") / BAND_NODES).cast("int").alias("shard")))
        crown = kept(crown.join(band, "depth"))
        bands = band.agg(F.max("shard")).first()[0] + 1
    else:
        crown = crown.withColumn("shard", F.lit(0))
    tops, out = done.where("top"), done
    for band in range(bands if count[1] else 0):           # the deepest band first
        sums = _summed(_with_tops(crown.where(F.col("shard") == band), tops))
        tops, out = tops.unionByName(sums.where("top")), out.unionByName(sums)
    return out.select(*DIGEST, "leaves", "saved")


# -- members that end at a node ----------------------------------------------

def ends_digests(ends: DataFrame) -> DataFrame:
    """(hi, lo, sha): SHA-256 of the ids at each digest, ascending and joined by commas.

    Ids are sorted and joined in pieces over all tasks; a digest's pieces then pass through one
    running hash, which keeps no more than its state.
    """
    n = partitions(ends)

    def joined(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, ids = (batch.column(i).to_numpy() for i in range(3))
            heads = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
            texts = [",".join(map(str, part.tolist())) for part in np.split(ids, heads[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(hi[heads]), pa.array(lo[heads]), pa.array(ids[heads]), pa.array(texts)], names=["hi", "lo", "first", "ids"])

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for hi, lo, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if key == (hi, lo):
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (hi, lo), hashlib.sha256()
                state.update(text.encode())
            yield made(out)
        if key is not None:
            yield made([(*key, state.hexdigest())])

    def made(rows):
        return pa.RecordBatch.from_pylist(
            [dict(zip(("hi", "lo", "sha"), r)) for r in rows], pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("sha", pa.string())])
        )

    order = [*DIGEST, "id"]
    pieces = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        joined, "hi long, lo long, first long, ids string"
    )
    return pieces.repartition(n, *DIGEST).sortWithinPartitions(*DIGEST, "first").mapInArrow(hashed, "hi long, lo long, sha string")


# -- the trie ----------------------------------------------------------------

def _named(hi="hi", lo="lo"):
    return F.concat_ws(".", F.hex(hi), F.hex(lo))


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per distinct prefix of turns: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.

    `turns` has (id, place, length, a, b, bytes): the places of a conversation count from 1 to
    its length, a and b hash the turn; `members` has (id, length) once for every conversation,
    also for those without turns. Ids are whole numbers. conv_id is the smallest id that starts
    with the prefix; together with the depth it names the node. Without members there is no
    row, otherwise the root is there.
    """
    rows = kept(prefix_rows(turns, members))
    total = rows.count()
    nodes = kept(rows.groupBy(*DIGEST).agg(
        F.count("*").alias("n"), F.min("id").alias("owner"), F.max("phi").alias("phi"), F.max("plo").alias("plo"),
        F.sum(F.col("length") - F.col("depth")).alias("below"),
    ))
    limit = max(1, min(PIECE_TURNS, math.ceil(total / (4 * partitions(rows)))))
    children = nodes.where("phi is not null").groupBy(F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n") == 1).alias("single")
    )
    # every row with its node; nodes of very many rows meet theirs over salts
    known = nodes.select(_named().alias("node"), "n", "owner", "below")
    hot = hot_ids(known, "node", "n", total)
    met = kept(join_many_to_one(rows.withColumn("node", _named()), known, "node", hot=hot).drop("node"))
    mine = F.col("owner") == F.col("id")
    small = (F.col("n") > 1) & (F.col("below") <= limit)
    paths = met.groupBy("id").agg(
        F.min(F.when(mine, F.col("depth"))).alias("first_own"),
        F.max(F.when(~mine, F.struct("depth", "owner")))["owner"].alias("above"),
        F.min(F.when(small, F.struct("depth", *DIGEST))).alias("piece"),
        F.max(F.struct("depth", *DIGEST)).alias("end"),
        F.count("*").alias("rows"),
    )
    paths = kept(paths)
    # a node once: as the row of its owner
    own = join_many_to_one(
        met.where(mine), paths.select("id", "first_own", "above", "piece"), "id", hot=hot_ids(paths, "id", "rows", total)
    ).withColumn("parent", F.when(F.col("depth") == F.col("first_own"), F.col("above")).otherwise(F.col("id")))
    own = kept(own.join(children, DIGEST, "left").select(
        "id", "depth", *DIGEST, "phi", "plo", "bytes", "n", "below", "parent",
        F.col("piece.hi").alias("piece_hi"), F.col("piece.lo").alias("piece_lo"),
        F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("single", F.lit(0)).alias("single"),
    ))
    shared = own.where("n > 1").withColumns({
        "leaves": F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("single")).cast("long"),
        "saved": (F.col("n") - 1) * F.col("bytes"),
    })
    ends = ends_digests(paths.select("id", "end.hi", "end.lo"))
    whole = own.join(_all_sums(shared, limit), DIGEST, "left").join(ends, DIGEST, "left")
    return whole.select(
        F.col("id").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def with_lengths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of ordered turns, as `prefix_trie` takes them."""
    members = kept(turns.groupBy("id").agg(F.count("*").alias("length")))
    return join_many_to_one(turns, members, "id", hot=hot_ids(members, "id", "length", turns.count())), members
