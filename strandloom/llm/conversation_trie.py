"""The prefix trie of conversations: which first turns they share, and what sharing them saves.

A turn is its role and text, held as two 64-bit hashes.  Turns are numbered by a range sort, whatever the length of a
conversation; a prefix is known by the sum of hashes of its (place, turn) pairs, which are added up in blocks and
carried from block to block.  Equal prefixes are one node.  Totals of subtrees come from tree contraction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialise
from .contraction import subtree_totals

#: Places whose sums are added up in one window; longer conversations carry sums from block to block.
BLOCK_BITS = 10
#: Turns of one conversation that meet one copy of its plan.
PLAN_BITS = 16
#: Characters of role and text by which turns of one number are ordered, before their hashes.
TIE_CHARS = 64
#: Bytes of ids that are handed to the hash at once where a list of ids spans partitions.
PIECE_BYTES = 1 << 20

_SUMS = ["k0", "k1", "k2", "k3"]
_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each conversation inside a sorted partition, from 1."""
    part = TaskContext.get().partitionId()
    last, count = None, 0
    for batch in batches:
        conv = np.asarray(batch.column(0))
        if not len(conv):
            continue
        starts = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
        number = np.arange(1, len(conv) + 1) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
        if conv[0] == last:
            end = starts[1] if len(starts) > 1 else len(conv)
            number[:end] += count
        last, count = conv[-1], int(number[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(conv), part, np.int32)), pa.array(number.astype(np.int64))], names=["conv", "h0", "h1", "n_bytes", "part", "number"])


def ranked_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """conv, h0, h1, n_bytes, rank of every turn, and conv, total of every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = df.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.substring(role, 1, TIE_CHARS).alias("role"), F.substring(text, 1, TIE_CHARS).alias("begin"),
        F.xxhash64(F.lit(1), role, text).alias("h0"), F.xxhash64(F.lit(2), role, text).alias("h1"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    # Rows that are equal in all else are told apart by their place in the written table, so that any number of them can be dealt out.
    placed = materialise(turns).withColumn("place", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "begin", "h0", "h1", "place"]
    numbered = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "h0", "h1", "n_bytes").mapInArrow(lean(_numbered), "conv long, h0 long, h1 long, n_bytes long, part int, number long")
    numbered = materialise(numbered)
    per_part = materialise(numbered.groupBy("conv", "part").agg(F.max("number").alias("n")))
    totals = materialise(per_part.groupBy("conv").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("parts")))
    # Conversations in several partitions: two rows a partition at most.
    spread = per_part.join(totals.filter("parts > 1").select("conv"), "conv", "left_semi")
    before = spread.select("conv", "part", (F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")).alias("before"))
    ranked = numbered.join(F.broadcast(before), ["conv", "part"], "left")
    return ranked.select("conv", "h0", "h1", "n_bytes", (F.col("number") + F.coalesce("before", F.lit(0))).alias("rank")), totals.select("conv", "total")


def _blocks(total: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.greatest(total - 1, F.lit(0).cast("long")), PLAN_BITS)))


def shared_heads(ranked: DataFrame, totals: DataFrame, group: int = 5, longest: int = 8) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations rebuilt on the first turns of the first one of each `group` of ids.

    Conversation c takes the first h turns of c - c % group, h being crc32(c) % (longest + 1), and keeps its own after its first h.
    Gives conv, place, size, h0, h1, n_bytes and conv, size.
    """
    plan = totals.select("conv", "total", (F.crc32(F.col("conv").cast("string")) % (longest + 1)).alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    plan = plan.join(totals.select(F.col("conv").alias("base"), F.col("total").alias("base_total")), "base", "left")
    head = F.least("h", F.coalesce("base_total", F.lit(0)))
    plan = materialise(plan.select("conv", "base", "total", "h", head.alias("head"), (head + F.greatest(F.col("total") - F.col("h"), F.lit(0).cast("long"))).alias("size")))
    begun = ranked.filter(F.col("rank") <= longest).withColumnRenamed("conv", "base").join(plan.select("conv", "base", "h", "size"), "base").filter("rank <= h")
    # A plan is copied for every 2**PLAN_BITS turns of its conversation: no key of the join has more.
    copies = plan.select("conv", "h", "head", "size", _blocks(F.col("total")).alias("block"))
    own = ranked.withColumn("block", F.shiftright(F.col("rank") - 1, PLAN_BITS)).join(copies, ["conv", "block"]).filter("rank > h")
    turns = begun.select("conv", F.col("rank").alias("place"), "size", "h0", "h1", "n_bytes").unionByName(own.select("conv", (F.col("rank") - F.col("h") + F.col("head")).alias("place"), "size", "h0", "h1", "n_bytes"))
    return turns, plan.select("conv", "size")


def prefix_sums(df: DataFrame, key: str, place: str, sums: list[str], longest: int, bits: int = BLOCK_BITS) -> DataFrame:
    """`df` with each of `sums` added up along `place` (from 0, at most `longest`) within `key`.

    No window has more than 2**bits places: blocks are added up by themselves, and their totals, added up in the same way,
    are carried on.
    """
    block = F.shiftright(place, bits)
    blocked = df.withColumn("_block", block)
    window = Window.partitionBy(key, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    kept = [c for c in df.columns if c not in sums]
    within = blocked.select(*kept, "_block", *[F.sum(c).over(window).alias(c) for c in sums])
    if longest >> bits == 0:
        return within.drop("_block")
    totals = blocked.groupBy(key, F.col("_block").alias("_place")).agg(*[F.sum(c).alias(c) for c in sums])
    carried = prefix_sums(totals, key, "_place", sums, longest >> bits, bits).select(key, (F.col("_place") + 1).alias("_block"), *[F.col(c).alias(f"_{c}") for c in sums])
    return within.join(carried, [key, "_block"], "left").select(*kept, *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums])


def _key(place: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", place, *sums)))


def _prefixes(turns: DataFrame, sizes: DataFrame, bits: int) -> DataFrame:
    """conv, depth, key, parent, n_bytes, last for every prefix of every conversation, the empty one included."""
    low = F.lit((1 << 32) - 1)
    both = [F.xxhash64(F.lit(s), "place", "h0", "h1") for s in (3, 4)]
    # Halves of 32 bits: sums of 2**31 of them don't overflow.
    halves = [h for x in both for h in (F.shiftrightunsigned(x, 32), x.bitwiseAND(low))]
    hashed = turns.select("conv", (F.col("place") - 1).alias("place"), "size", "n_bytes", *[h.alias(f"p{i}") for i, h in enumerate(halves)], *[h.alias(k) for k, h in zip(_SUMS, halves, strict=True)])
    longest = sizes.agg(F.max("size")).first()[0] or 0
    summed = prefix_sums(hashed, "conv", "place", _SUMS, max(longest - 1, 0), bits)
    keyed = summed.select(
        "conv", (F.col("place") + 1).alias("depth"), _key(F.col("place") + 1, [F.col(k) for k in _SUMS]).alias("key"),
        _key(F.col("place"), [F.col(k) - F.col(f"p{i}") for i, k in enumerate(_SUMS)]).alias("parent"), "n_bytes", (F.col("place") + 1 == F.col("size")).alias("last"),
    )
    zero = F.lit(0).cast("long")
    return keyed.unionByName(sizes.select("conv", zero.alias("depth"), _key(zero, [zero] * 4).alias("key"), F.lit(None).cast("binary").alias("parent"), zero.alias("n_bytes"), (F.col("size") == 0).alias("last")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each key of a sorted partition joined by commas, in pieces of bounded size."""
    schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("piece", pa.binary())])
    key, first, held, size = None, None, [], 0
    for batch in batches:
        found: dict[str, list] = {"key": [], "first": [], "piece": []}

        def put(found: dict[str, list] = found) -> None:
            for name, value in zip(found, (key, first, ",".join(held).encode()), strict=True):
                found[name].append(value)

        for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (own != key or size >= PIECE_BYTES):
                put()
                held = []
            if not held:
                key, first, size = own, conv, 0
            held.append(str(conv))
            size += len(held[-1]) + 1
        yield pa.RecordBatch.from_pydict(found, schema)
    if held:
        yield pa.RecordBatch.from_pydict({"key": [key], "first": [first], "piece": [",".join(held).encode()]}, schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of the pieces of each key, which come in order."""
    key, digest = None, hashlib.sha256()
    for batch in batches:
        found: dict[str, list] = {"key": [], "sha": []}
        for k, piece in zip(batch.column(0), batch.column(1), strict=True):
            if (own := k.as_py()) != key:
                if key is not None:
                    found["key"].append(key)
                    found["sha"].append(digest.hexdigest())
                key, digest = own, hashlib.sha256(piece.as_buffer())
            else:
                digest.update(b",")
                digest.update(piece.as_buffer())
        yield pa.RecordBatch.from_pydict(found, pa.schema([("key", pa.binary()), ("sha", pa.string())]))
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key": [key], "sha": [digest.hexdigest()]}, pa.schema([("key", pa.binary()), ("sha", pa.string())]))


def _ends(prefixes: DataFrame) -> DataFrame:
    """key and the SHA-256 of the ids that end there.

    A hash runs through its list in order, so the pieces of one list meet in one task, which holds one piece at a time.
    """
    ordered = prefixes.filter("last").select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    pieces = ordered.mapInArrow(lean(_pieces), "key binary, first long, piece binary")
    return pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "piece").mapInArrow(lean(_joined), "key binary, sha string")


def trie_nodes(turns: DataFrame, sizes: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """The nodes of the trie of `turns` (conv, place from 1, size, h0, h1, n_bytes) and `sizes` (conv, size)."""
    prefixes = materialise(_prefixes(turns, sizes, bits))
    nodes = prefixes.groupBy("key").agg(F.min("conv").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"))
    nodes = materialise(nodes)
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    full = nodes.join(kids, "key", "left").join(_ends(prefixes), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("ends_sha256", F.coalesce("sha", F.lit(none)))
    full = materialise(full.join(above, "parent", "left"))
    weighed = full.select(F.col("key").alias("id"), "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    totals = subtree_totals(weighed, ["n_leaves", "saved_tokens"]).withColumnRenamed("id", "key")
    return full.join(totals, "key").select(*_RESULT)


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", share: bool = False) -> DataFrame:
    """One row for each different beginning of the conversations of `df`, the empty one included.

    conv_id (the smallest that begins so), depth (turns), parent_conv_id, n_convs, n_children, n_leaves and saved_tokens
    (over the subtree: UTF-8 bytes of each node's last text, for all its conversations but one) and ends_sha256 (of the ids
    that end here, ascending, joined by commas).  With `share`, conversations are first rebuilt by `shared_heads`.

    Turns are in order of their number, null first; of turns with one number those with the smaller role, then the smaller
    beginning of the text, then the smaller hash come first, so repeated rows are turns one after the other.  A null role or text is
    the empty one, rows without a conv_id belong to no conversation and are left out.  Texts of any length are read
    whole.  An empty table gives no rows; other columns are ignored.
    """
    ranked, totals = ranked_turns(df, conv_col, turn_col, role_col, text_col)
    if share:
        return trie_nodes(*shared_heads(ranked, totals))
    copies = totals.select("conv", F.col("total").alias("size"), _blocks(F.col("total")).alias("block"))
    turns = ranked.withColumn("block", F.shiftright(F.col("rank") - 1, PLAN_BITS)).join(copies, ["conv", "block"]).select("conv", F.col("rank").alias("place"), "size", "h0", "h1", "n_bytes")
    return trie_nodes(turns, totals.select("conv", F.col("total").alias("size")))
