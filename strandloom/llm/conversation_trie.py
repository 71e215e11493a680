"""Prefix trie of conversations, its subtree totals found by parallel tree contraction.

Turns are ordered by one range sort over all of them and numbered from counts of
the sorted pieces; a prefix is named by the exclusive-or of a salted SHA-256 of
each of its turns with its place (128 bits), summed up in pieces of
``PIECE_TURNS`` turns.  No task or window holds a whole conversation.  A node is
a group of equal names; its id is its smallest member with its depth.

Subtree totals come from rounds of joins over what is left of the tree.  A round
*rakes* all leaves (their totals are final and go to their parents by a group-by
with map-side sums) and *compresses* unary chains: a node with one child left is
taken out if its coin is up and its child's is down, its child takes over its
parent and carries its sum on the edge.  Coins are bits of the depth at first,
so that a chain halves in each round, and of a hash after that.  Rounds are
logarithmic in the nodes, also for chains and for very long conversations.  The
nodes that were compressed are *re-expanded* from the last round to the first:
each gets its child's total and what was on the way.  Every round is a table in
the shared folder; the driver sees counts only.

Nulls and edge cases: rows without a conversation take no part; a null role or
text is empty; null turns come first; turns of one number are ordered by the
SHA-256 of role and text, so repeated rows are repeated turns; an empty table
gives no nodes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.shared import remove, write_table, written

#: Turns of a conversation that one window sums up; member ids that one row of digests lists.
PIECE_TURNS, PIECE_IDS_LOG2 = 512, 8

WORD = r"[^\x20\x09-\x0D]+"


def ordered_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns numbered within conversations, and the conversations.

    ``conv_id, place, said, words`` (places from 0; ``said`` is the SHA-256 of
    role and text) and ``conv_id, n_turns``.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        said.alias("said"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("copy"),
    )
    order = ["conv_id", "turn", "said", "copy"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = write_table(rows.select("conv_id", "said", "words", F.monotonically_increasing_id().alias("at")), "turns")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    parts = parts.select("conv_id", "part", (before - F.col("first")).alias("shift"), "n")
    placed = rows.join(parts.drop("n"), ["conv_id", "part"])
    placed = placed.select("conv_id", (F.col("at") + F.col("shift")).cast("int").alias("place"), "said", "words")
    return placed, parts.groupBy("conv_id").agg(F.sum("n").cast("int").alias("n_turns"))


def rebuilt(placed: DataFrame, convs: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Each conversation with the first h turns of the first of its family in place of its own first h.

    h is the CRC-32 of the conversation's decimal id modulo ``heads``; a family
    is ``family`` consecutive ids.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    each = convs.select("conv_id", "n_turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("origin"))
    origins = convs.select(F.col("conv_id").alias("origin"), F.col("n_turns").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    each = each.join(origins, "origin", "left").withColumn("taken", taken)
    each = write_table(each.withColumn("n_turns", F.col("taken") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))), "rebuilt")
    first = placed.where(F.col("place") < heads - 1).select(F.col("conv_id").alias("origin"), "place", "said", "words")
    borrowed = each.where("taken > 0").join(first, "origin").where("place < taken").select("conv_id", "place", "said", "words")
    own = placed.join(each.select("conv_id", "h", "taken"), "conv_id").where("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "said", "words")
    return borrowed.unionByName(own), each.select("conv_id", "n_turns")


def _long(digest: Column, begin: int) -> Column:
    return F.conv(F.substring(digest, begin, 16), 16, -10).cast("long")


def paths(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, depth, a, b, up_a, up_b, words, ends``: the name of each prefix and of the one before it.

    ``ends``: the conversation has no more turns.  Conversations without turns
    end at the root, whose name is 0, 0.
    """
    salt = uuid.uuid4().hex
    digest = F.sha2(F.concat_ws(":", F.lit(salt), F.col("place").cast("string"), "said").cast("binary"), 256)
    rows = placed.withColumn("digest", digest).select(
        "conv_id", "place", F.expr(f"place div {PIECE_TURNS}").alias("piece"), _long(F.col("digest"), 1).alias("x"), _long(F.col("digest"), 17).alias("y"), "words"
    )
    rows = write_table(rows, "places")
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    long_ones = rows.where("piece > 0").select("conv_id").distinct()
    pieces = rows.join(long_ones, "conv_id", "left_semi").groupBy("conv_id", "piece").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    pieces = pieces.select("conv_id", "piece", F.bit_xor("x").over(before).alias("px"), F.bit_xor("y").over(before).alias("py"))
    order = Window.partitionBy("conv_id", "piece").orderBy("place")
    rows = rows.withColumns({"a": F.bit_xor("x").over(order), "b": F.bit_xor("y").over(order)})
    rows = rows.join(pieces, ["conv_id", "piece"], "left")
    for name, base in (("a", "px"), ("b", "py")):
        rows = rows.withColumn(name, F.col(name).bitwiseXOR(F.coalesce(base, F.lit(0).cast("long"))))
    rows = rows.select(
        "conv_id", (F.col("place") + 1).alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("up_a"), F.col("b").bitwiseXOR(F.col("y")).alias("up_b"), "words"
    )
    rows = rows.join(convs, "conv_id").withColumn("ends", F.col("depth") == F.col("n_turns")).drop("n_turns")
    zero = F.lit(0).cast("long")
    roots = convs.select(
        "conv_id", F.lit(0).alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("up_a"), zero.alias("up_b"), zero.alias("words"), (F.col("n_turns") == 0).alias("ends")
    )
    return write_table(rows.unionByName(roots), "paths")


def trie_nodes(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, own`` of each node, and ``node_conv, depth, conv_id`` of the ends.

    ``own``: tokens that the node saves, without its subtree.
    """
    named = steps.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b")
    )
    named = write_table(named, "prefixes")
    ups = named.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    nodes = named.join(ups, ["depth", "up_a", "up_b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("own")
    )
    nodes = write_table(nodes, "linked")
    kids = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    last = steps.where("ends").select("depth", "a", "b", "conv_id")
    ends = last.join(named.select("depth", "a", "b", F.col("conv_id").alias("node_conv")), ["depth", "a", "b"])
    return write_table(nodes, "nodes"), ends.select("node_conv", "depth", "conv_id")


def _coin(conv: str, depth: str, turn: int, bits: int) -> Column:
    """A bit of the node: of its depth in the first rounds, of a hash later on."""
    if turn < bits:
        return F.shiftright(F.col(depth), turn).bitwiseAND(1) == 1
    return F.xxhash64(F.col(conv), F.col(depth), F.lit(turn)).bitwiseAND(1) == 1


def subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """``conv_id, depth`` and, for each of ``sums``, its total over the node's subtree.

    ``nodes`` has ``conv_id, depth, parent_conv_id, n_children`` and the columns
    of ``sums``; the parent is one level above, and the root's is null.
    """
    spark = nodes.sparkSession
    edge = {s: f"edge_{s}" for s in sums}
    state, path = written(
        nodes.select(
            "conv_id",
            "depth",
            F.col("parent_conv_id").alias("up_conv"),
            F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1).alias("up_depth"),
            F.col("n_children").alias("left"),
            *[F.col(s).cast("long").alias(s) for s in sums],
            *[F.lit(0).cast("long").alias(e) for e in edge.values()],
        ),
        "tree",
    )
    deepest = state.agg(F.max("depth").alias("d"), F.count("*").alias("n")).first()
    bits, left, turn = (deepest["d"] or 0).bit_length(), deepest["n"], 0
    tables, used = [], [path]  # of each round: raked leaves, and the nodes compressed after them
    while left:
        leaf = F.col("left") == 0
        raked = state.where(leaf).select("conv_id", "depth", *sums)
        told = state.where("up_conv is not null").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).agg(
            F.count(F.when(~leaf, 1)).alias("inner"),
            F.min(F.when(~leaf, F.struct("conv_id", "depth"))).alias("only"),
            *[F.sum(F.when(leaf, F.col(s) + F.col(edge[s]))).alias(f"of_{s}") for s in sums],
        )
        rest = state.where(~leaf).join(told, ["conv_id", "depth"])
        rest = rest.select(
            "conv_id", "depth", "up_conv", "up_depth", F.col("inner").alias("left"), "only", *[(F.col(s) + F.coalesce(f"of_{s}", F.lit(0))).alias(s) for s in sums], *edge.values()
        )
        rest = rest.withColumn("only", F.when(F.col("left") == 1, F.col("only"))).withColumns({"only_conv": F.col("only.conv_id"), "only_depth": F.col("only.depth")})
        out = F.col("up_conv").isNotNull() & F.col("only").isNotNull() & _coin("conv_id", "depth", turn, bits) & ~_coin("only_conv", "only_depth", turn, bits)
        rest = rest.withColumn("out", F.coalesce(out, F.lit(False))).drop("only")
        rest, path = written(rest, "raked")
        used.append(path)
        counted = rest.agg(F.count("*").alias("n"), F.count(F.when(F.col("out"), 1)).alias("out")).first()
        left, gone = counted["n"] - counted["out"], None
        if counted["out"]:
            # The child takes its parent's place; what the parent had gathered goes onto the child's edge.
            chain = rest.where("out").select(
                F.col("only_conv").alias("conv_id"),
                F.col("only_depth").alias("depth"),
                F.struct("conv_id", "depth", "up_conv", "up_depth", *[(F.col(s) + F.col(edge[s])).alias(edge[s]) for s in sums], *sums).alias("over"),
            )
            kept = rest.where("not out").join(chain, ["conv_id", "depth"], "left")
            moved = F.col("over").isNotNull()
            state, path = written(
                kept.select(
                    "conv_id",
                    "depth",
                    *[F.when(moved, F.col(f"over.{c}")).otherwise(F.col(c)).alias(c) for c in ("up_conv", "up_depth")],
                    "left",
                    *sums,
                    *[(F.col(edge[s]) + F.coalesce(f"over.{edge[s]}", F.lit(0))).alias(edge[s]) for s in sums],
                    F.when(moved, F.struct("over.conv_id", "over.depth", *[(F.col(edge[s]) + F.col(f"over.{s}")).alias(s) for s in sums])).alias("gone"),
                ),
                "compressed",
            )
            used.append(path)
            gone = state.where("gone is not null").select("conv_id", "depth", "gone")
        else:
            state = rest
        tables.append((raked, gone))
        turn += 1
    known: DataFrame | None = None
    for raked, gone in reversed(tables):  # a compressed node's child was raked or compressed in a later round
        if gone is not None:
            back = gone.join(known, ["conv_id", "depth"]).select(
                F.col("gone.conv_id").alias("conv_id"), F.col("gone.depth").alias("depth"), *[(F.col(s) + F.col(f"gone.{s}")).alias(s) for s in sums]
            )
            back, path = written(back, "expanded")
            used.append(path)
            known = known.unionByName(back)
        known = raked if known is None else known.unionByName(raked)
    if known is None:
        return state.select("conv_id", "depth", *sums)
    totals = write_table(known, "subtrees")
    for path in used:
        remove(spark, path)
    return totals


def listed_digests(ends: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256`` of nodes where conversations end.

    Members are listed in rows of at most ``2 ** PIECE_IDS_LOG2`` ids, and a
    node's rows pass one after the other through a running digest: a task never
    holds a node's list.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    lists = ends.groupBy("node_conv", "depth", F.shiftright("conv_id", PIECE_IDS_LOG2).alias("piece")).agg(ids.alias("ids"))
    rows = lists.repartition("node_conv", "depth").sortWithinPartitions("node_conv", "depth", "piece").select("node_conv", "depth", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running = None, None
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for conv, depth, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv, depth) == at:
                    running.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, running.hexdigest()))
                at, running = (conv, depth), hashlib.sha256(ids.encode())
            yield _digests(out)
        if at is not None:
            yield _digests([(*at, running.hexdigest())])

    return rows.mapInArrow(digest, "conv_id long, depth int, ends_sha256 string")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    types = (pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["conv_id", "depth", "ends_sha256"])


def conversation_trie(turns: DataFrame, family: int | None = None) -> DataFrame:
    """One row a node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    With ``family`` the conversations are rebuilt first (:func:`rebuilt`).
    """
    placed, convs = ordered_turns(turns)
    if family:
        placed, convs = rebuilt(placed, convs, family)
    nodes, ends = trie_nodes(paths(placed, convs))
    sums = nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("own").alias("saved_tokens")
    )
    totals = subtree_sums(sums, ["n_leaves", "saved_tokens"])
    out = nodes.join(totals, ["conv_id", "depth"]).join(listed_digests(ends), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
