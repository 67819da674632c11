"""Conversation prefix trie by van Emde Boas recursion.

Every conversation is a sequence of turns; the trie's nodes are the distinct prefixes. The recursion cuts all sequences
at half depth, names each cut prefix by a digest of what lies before the cut, and goes on with the upper halves (under the
name that they had) and the lower halves (under the name of their cut prefix) side by side. After log2(depth) cuts
every turn stands under the name of the prefix before it, and equal names with equal turns are one node. Totals come back
the other way: the totals of the lower tries' roots are grafted on the cut nodes and from there on the nodes above them
in the upper trie, from small tries to large ones.

A conversation of any length spreads: its turns are cut into blocks of ``BLOCK`` turns, inside which the recursion
runs on a row; above them it runs as joins on block numbers. A node of any number of members is only met in
partial counts and minima. One round exchanges no rows with the driver, which learns the greatest depth alone.

Defined results: null role and text count as empty; turns of one number are ordered by the digest of role and text, and
repeated rows are turns each; rows without conv_id belong to no conversation and are left out; an empty
table gives an empty result; other columns are ignored. ``%`` is the remainder with the sign of the id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, stored

#: Turns whose recursion runs on one row, and steps of a path that meet in one group; powers of two.
BLOCK, STRETCH = 64, 4096
#: Members' ids that are joined to one text on a row.
ID_BLOCK = 4096
ROOT = b""
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _name(before: bytes, turns: list[bytes]) -> bytes:
    return hashlib.sha256(before + b"".join(turns)).digest()[:16]


def prefix_names(before: bytes, turns: list[bytes], size: int = BLOCK) -> list[bytes]:
    """The name of the prefix before each turn; ``before`` is the one before the first, ``size`` a power of two."""
    if len(turns) <= 1:
        return [before] * len(turns)
    half = size // 2
    if len(turns) <= half:
        return prefix_names(before, turns, half)
    upper, lower = turns[:half], turns[half:]
    return prefix_names(before, upper, half) + prefix_names(_name(before, upper), lower, half)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, size): the digest of role and text, and the text's code points."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull())
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text), 256), 1, 32))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("size"))


def rebuilt_turns(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv_id, pos, digest, size) of their turns, and (conv_id, length) of all.

    Conversation c starts with the first crc32(c) % most turns of the conversation c - c % group.
    """
    numbered = stored(ranked(turns, ["conv_id"], ["conv_id", "turn", "digest"]).select("conv_id", F.col("rank").cast("long").alias("pos"), "digest", "size"))
    convs = numbered.groupBy("conv_id").agg(F.count("*").alias("n"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("head")
    convs = convs.select("conv_id", "n", head, (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    first = numbered.where((F.col("conv_id") % group == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    sizes = first.groupBy("base").agg(F.count("*").alias("base_n"))
    convs = stored(convs.join(sizes, "base", "left").withColumn("given", F.least("head", F.coalesce("base_n", F.lit(0)))).drop("base_n"))
    taken = convs.where("given > 0").select("conv_id", "base", "given").join(first, "base").where(F.col("pos") < F.col("given"))
    own = numbered.join(convs.select("conv_id", "head", "given"), "conv_id").where(F.col("pos") >= F.col("head"))
    own = own.withColumn("pos", F.col("pos") - F.col("head") + F.col("given"))
    columns = ["conv_id", "pos", "digest", "size"]
    length = (F.col("given") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).cast("long")
    return own.select(*columns).unionByName(taken.select(*columns)), convs.select("conv_id", length.alias("length"))


def _block_names(blocks: DataFrame, most: int) -> DataFrame:
    """(conv_id, block, before): the name of the prefix before each block, for conversations of several blocks."""
    several = blocks.where("n_blocks > 1")
    digest = F.unhex(F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""), 256))
    levels = [stored(several.select("conv_id", F.col("block").alias("part"), digest.alias("digest")))]
    while 1 << (len(levels) - 1) < most:  # digests of ever larger halves, kept by side
        side = lambda odd: F.max(F.when(F.col("part") % 2 == odd, F.col("digest")))
        pairs = levels[-1].groupBy("conv_id", F.shiftright("part", 1).alias("part")).agg(side(0).alias("left"), side(1).alias("right"))
        both = F.unhex(F.sha2(F.concat("left", F.coalesce("right", F.lit(b""))), 256))
        levels.append(stored(pairs.withColumn("digest", both)))
    named = levels[-1].select("conv_id", "part", F.lit(ROOT).alias("before"), "left", "right")
    for below in reversed(levels[:-1]):
        lower = F.unhex(F.substring(F.sha2(F.concat("before", "left"), 256), 1, 32))
        upper = F.struct((F.col("part") * 2).alias("part"), F.col("before").alias("before"))
        cut = F.array(upper, F.when(F.col("right").isNotNull(), F.struct((F.col("part") * 2 + 1).alias("part"), lower.alias("before"))))
        halves = named.select("conv_id", F.explode(F.filter(cut, lambda x: x.isNotNull())).alias("x")).select("conv_id", "x.*")
        keep = ["left", "right"] if "left" in below.columns else []
        named = stored(halves.join(below.select("conv_id", "part", *keep), ["conv_id", "part"]))
    return named.select("conv_id", F.col("part").alias("block"), "before")


def named_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, before, digest, after, size): each turn with the names of the prefixes before and after it;
    ``after`` is null at the conversation's end."""
    part = F.floor(F.col("pos") / BLOCK).cast("long")
    packed = F.sort_array(F.collect_list(F.struct("pos", "digest", "size")))
    blocks = turns.groupBy("conv_id", part.alias("block")).agg(packed.alias("turns"))
    counts = turns.groupBy("conv_id").agg(F.max(part).alias("last"))
    blocks = stored(blocks.join(counts, "conv_id").withColumn("n_blocks", F.col("last") + 1))
    most = blocks.agg(F.max("n_blocks")).first()[0] or 1
    if most == 1:
        blocks = blocks.select("conv_id", "turns", F.lit(ROOT).alias("before"), F.lit(None).cast("binary").alias("next"))
    else:
        names = stored(_block_names(blocks, most))
        after = names.select("conv_id", (F.col("block") - 1).alias("block"), F.col("before").alias("next"))
        blocks = blocks.join(names, ["conv_id", "block"], "left").join(after, ["conv_id", "block"], "left")
        blocks = blocks.select("conv_id", "turns", F.coalesce("before", F.lit(ROOT)).alias("before"), "next")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for conv, turns, before, follows in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                digests = [t["digest"] for t in turns]
                names = prefix_names(before, digests)
                for column, values in zip(out, ([conv] * len(turns), [t["pos"] for t in turns], names, digests, [*names[1:], follows], [t["size"] for t in turns]), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names_)

    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    names_ = ["conv_id", "pos", "before", "digest", "after", "size"]
    return blocks.mapInArrow(run, "conv_id long, pos long, before binary, digest binary, after binary, size long")


def _grafted(nodes: DataFrame, paths: DataFrame, depth: int) -> DataFrame:
    """(conv_id, pos, parent, n_leaves, saved): totals over subtrees, from the nodes' own values.

    In round k the tries of 2**k levels are whole: the totals of the roots of every lower trie are summed on their cut node
    and added to the nodes on the way to it in the upper trie, which are those of its conversation's path.
    """
    totals, level = nodes, 0
    while 1 << level < depth:
        half = 1 << level
        step = min(half, STRETCH)
        roots = totals.where(F.col("pos") % (2 * half) == half)
        cut = roots.groupBy(F.col("parent").alias("path"), "pos").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        pieces = F.sequence(F.floor((F.col("pos") - half) / step), F.floor((F.col("pos") - 1) / step))
        cut = cut.select("path", F.explode(pieces).alias("piece"), "n_leaves", "saved")
        way = paths.withColumn("piece", F.floor(F.col("pos") / step).cast("long"))
        grafts = way.join(cut, ["path", "piece"]).select("conv_id", "pos", F.lit(None).cast("long").alias("parent"), "n_leaves", "saved")
        met = totals.unionByName(grafts).groupBy("conv_id", "pos")
        totals = stored(met.agg(F.max("parent").alias("parent"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")))
        level += 1
    return totals


def _ends(members: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) from (conv_id, depth, member): the digest of the comma-joined member ids.

    Ids are joined in blocks by rank; the blocks of a node with several go through the digest as a stream.
    """
    rows = ranked(members, ["conv_id", "depth"], ["conv_id", "depth", "member"])
    block = F.floor(F.col("rank") / ID_BLOCK).cast("long").alias("block")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda x: x.cast("string")), ",")
    texts = stored(rows.groupBy("conv_id", "depth", block).agg(ids.alias("ids"), F.count("*").alias("n")))
    several = texts.where("block > 0").select("conv_id", "depth").distinct()
    single = texts.where("block = 0").join(several, ["conv_id", "depth"], "left_anti").select("conv_id", "depth", F.sha2("ids", 256).alias("ends_sha256"))
    streamed = texts.select("conv_id", "depth", "block", "ids").join(several, ["conv_id", "depth"], "left_semi")
    streamed = streamed.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], ["conv_id", "depth", "ends_sha256"])

        for batch in batches:
            for conv, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if key == (conv, depth):
                    state.update(b",")
                else:
                    if key:
                        yield row()
                    key, state = (conv, depth), hashlib.sha256()
                state.update(ids.encode())
        if key:
            yield row()

    return single.unionByName(streamed.mapInArrow(run, "conv_id long, depth long, ends_sha256 string"))


def trie_of(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node of the trie of (conv_id, pos, digest, size); ``lengths`` has (conv_id, length) of all conversations."""
    placed = stored(named_turns(turns))
    key = ["pos", "before", "digest"]
    found = stored(placed.groupBy(*key).agg(F.min("conv_id").alias("least"), F.count("*").alias("n_convs"), F.max("after").alias("after"), F.max("size").alias("size")))
    children = found.groupBy((F.col("pos") - 1).alias("pos"), F.col("before").alias("after")).agg(F.count("*").alias("n_children"))
    parents = found.where("after is not null").select((F.col("pos") + 1).alias("pos"), F.col("after").alias("before"), F.col("least").alias("parent"))
    ended = found.where("after is null").withColumn("n_children", F.lit(0).cast("long"))  # no child, and no key to share
    found = found.where("after is not null").join(children, ["pos", "after"]).select(*ended.columns).unionByName(ended)
    # The root's children need no join: their parent has the least id of all.
    least, n_all = lengths.agg(F.min("conv_id"), F.count("*")).first()
    least = F.lit(least).cast("long")
    below = found.where("pos > 0").join(parents, ["pos", "before"])
    top = found.where("pos = 0").withColumn("parent", least)
    nodes = stored(below.unionByName(top.select(*below.columns)))

    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    own = nodes.select(F.col("least").alias("conv_id"), "pos", "parent", leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    led = nodes.select(F.col("least").alias("path")).distinct()  # only paths of least members lead to cut nodes
    met = placed.select(F.col("conv_id").alias("path"), *key).join(led, "path", "left_semi").join(found.select(*key, F.col("least").alias("conv_id")), key)
    paths = stored(met.select("path", "pos", "conv_id"))
    depth = (nodes.agg(F.max("pos")).first()[0] or 0) + 1
    totals = stored(_grafted(own, paths, depth))

    last = lengths.withColumn("pos", F.col("length") - 1)
    at = placed.join(last.select("conv_id", "pos"), ["conv_id", "pos"]).join(found.select(*key, F.col("least")), key)
    members = at.select(F.col("least").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.col("conv_id").alias("member"))
    bare = lengths.where("length = 0").select(least.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("member"))
    ends = _ends(members.unionByName(bare))

    inner = nodes.withColumnRenamed("least", "conv_id").join(totals.drop("parent"), ["conv_id", "pos"])
    inner = inner.select("conv_id", (F.col("pos") + 1).alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"))
    sums = totals.where("pos = 0").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    bottom = sums.where(F.lit(n_all > 0)).select(
        least.alias("conv_id"),
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(n_all).cast("long").alias("n_convs"),
        "n_children",
        F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
    )
    rows = inner.unionByName(bottom).join(ends, ["conv_id", "depth"], "left")
    return rows.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


def conversation_trie(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """The trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, lengths = rebuilt_turns(turn_rows(conversations), group, most)
    return trie_of(stored(turns), stored(lengths))
