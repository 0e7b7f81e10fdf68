"""Merkle manifest of a dataset: one tree per group, a tree over the groups, proofs by pointer jumping.

A node is a row ``(tree, level, pos)``; ``seg`` holds the siblings on its way towards an
ancestor, 33 bytes a level: the side of the sibling (``L``, ``R``, or ``-`` for none) and
its digest. Steps:

1. *Positions.* Leaves are range-partitioned by (group, order, digest) and written;
   a row's place is its partition's offset plus its number there, so no group is ever
   ordered in one task.
2. *Trees.* Aligned runs of 2^RUN_BITS nodes are hashed together; their tops are the
   next round's nodes. A group of any size so spreads over many small runs.
3. *Pointer jumping.* After a round of span ``s`` a node holds its siblings on ``s``
   levels. A round joins the nodes table with itself, every node on a level divisible
   by ``2s`` with its ancestor ``s`` levels up (other nodes are no longer needed), and
   concatenates the segments. A group's top holds the group's own proof in the tree over
   the groups, so the jumps end at the root of the dataset. An ancestor shared by more
   than 2^FAN_BITS nodes is keyed by its descendants FAN_BITS levels above these, so that
   no join key is hotter than that.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripletframe.llm.common import stash

#: Levels hashed in one round, and levels over which ancestors may be shared in a join.
RUN_BITS, FAN_BITS = 10, 16
ENTRY = 33  #: bytes of a level in a segment

_OWN = "id long, leaf binary, changed binary"
_NODE = f"tree long, n long, level int, pos long, seg binary, digest binary, {_OWN}"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated strings."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value (integers in decimal)."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``place``, the position in ``order`` over all rows, and ``part``, the range partition (both long)."""
    number = F.monotonically_increasing_id()  # partition << 33 | row in the partition
    rows = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", number), name)
    part = F.shiftright("_at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (rows.withColumn("part", part).join(F.broadcast(sizes), "part")  # bounded by the number of partitions
            .withColumn("place", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_before"))


def _hash_run(start: int, step: int, bits: int):
    """Arrow function over one aligned run: siblings of its nodes on up to ``bits`` levels, then its top with its digest."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("pos")
        n = group.column("n")[0].as_py()
        height = (n - 1).bit_length()
        base = group.column("pos")[0].as_py()
        cur = group.column("digest").to_pylist()
        level, pos, seg, top = [], [], [], []
        at = start
        for at in range(start, min(height, start + bits)):
            words = [d.hex() for d in cur]
            for i, d in enumerate(cur):
                other = i ^ 1
                seg.append(b"-" + bytes(32) if other >= len(cur) else (b"L" if i & 1 else b"R") + cur[other])
            level += [at] * len(cur)
            pos += range(base, base + len(cur))
            top += [None] * len(cur)
            cur = [hashlib.sha256("".join(words[i : i + 2]).encode()).digest() for i in range(0, len(cur), 2)]
            base >>= 1
            at += 1
        level.append(at)
        pos.append(base)
        seg.append(None)
        top.append(cur[0])
        size = len(level)
        own = []
        for name, kind in (("id", pa.int64()), ("leaf", pa.binary()), ("changed", pa.binary())):
            got = group.column(name).combine_chunks().cast(kind) if step == 0 else pa.nulls(0, kind)
            own.append(pa.concat_arrays([x for x in (*(got.chunks if isinstance(got, pa.ChunkedArray) else [got]), pa.nulls(size - len(got), kind))]))
        tree = group.column("tree")[0].as_py()
        return pa.table([pa.array([tree] * size, pa.int64()), pa.array([n] * size, pa.int64()), pa.array(level, pa.int32()), pa.array(pos, pa.int64()),
                         pa.array(seg, pa.binary()), pa.array(top, pa.binary()), *own],
                        names=["tree", "n", "level", "pos", "seg", "digest", "id", "leaf", "changed"])

    return run


def grow(leaves: DataFrame, bits: int = RUN_BITS) -> tuple[DataFrame, DataFrame, int]:
    """Trees over ``leaves(tree, n, pos, digest, id, leaf, changed)``: inner nodes and leaves with a parent, tops, greatest height."""
    most = leaves.agg(F.max("n")).first()[0] or 1
    height = (most - 1).bit_length()
    nodes, tops, step = None, None, 0
    rows = leaves
    while True:
        run = F.shiftright("pos", bits).alias("run")
        made = stash(rows.groupBy("tree", run).applyInArrow(_hash_run(step * bits, step, bits), _NODE), "nodes")
        mine, top = made.where("digest is null"), made.where("digest is not null")
        done = F.expr(f"n <= shiftleft(1L, {(step + 1) * bits})")
        nodes = mine if nodes is None else nodes.unionByName(mine)
        tops = top.where(done) if tops is None else tops.unionByName(top.where(done))
        step += 1
        if height <= step * bits:
            return nodes, tops, height
        rows = top.where(~done).drop("level", "seg")


def jump(nodes: DataFrame, height: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """Leaves (level 0) with ``seg`` up to the root and ``top``, from nodes with one sibling each and tops that know the rest."""
    span = 1
    while span <= height:
        near = nodes.where(F.col("level") % (2 * span) == 0)
        far = nodes.where(F.col("level") % (2 * span) == span)
        fan = min(span, fan_bits)
        key = F.col("pos")
        if fan < span:  # one row for every descendant `span - fan` levels below
            width = F.lit(1 << (span - fan))
            size = F.expr(f"(n - 1) div shiftleft(1L, level - {span} + {fan})")  # last position on that level
            key = F.explode(F.sequence(F.col("pos") * width, F.least((F.col("pos") + 1) * width - 1, size)))
        far = far.select(F.col("tree").alias("_tree"), F.col("level").alias("_level"), key.alias("_key"), F.col("seg").alias("_seg"), F.col("top").alias("_top"))
        on = (F.col("tree") == F.col("_tree")) & (F.col("level") + span == F.col("_level")) & (F.shiftright("pos", fan) == F.col("_key"))
        nodes = near.join(far, on, "left").withColumns(
            {"seg": F.concat("seg", F.coalesce("_seg", F.lit(b""))), "top": F.coalesce("top", "_top")}).drop("_tree", "_level", "_key", "_seg", "_top")
        span *= 2
        nodes = stash(nodes, "jump")
    return nodes.where("level = 0")


def fold(leaf: Column | str, proof: Column | str) -> Column:
    """Root (hex) recomputed from a leaf digest and its proof (both binary)."""
    return F.expr(f"""case when length({proof}) = 0 then lower(hex({leaf})) else
        aggregate(sequence(0, length({proof}) div {ENTRY} - 1), lower(hex({leaf})), (d, i) -> sha2(cast(
            case substring({proof}, {ENTRY} * i + 1, 1)
                when X'4C' then concat(lower(hex(substring({proof}, {ENTRY} * i + 2, 32))), d)
                when X'52' then concat(d, lower(hex(substring({proof}, {ENTRY} * i + 2, 32)))) else d end as binary), 256)) end""")


def siblings(proof: str) -> Column:
    """Hex digests of the siblings of a proof, from the leaf upwards, concatenated."""
    return F.expr(f"""case when length({proof}) = 0 then '' else array_join(transform(
        filter(sequence(0, length({proof}) div {ENTRY} - 1), i -> substring({proof}, {ENTRY} * i + 1, 1) <> X'2D'),
        i -> lower(hex(substring({proof}, {ENTRY} * i + 2, 32)))), '') end""")


def merkle_manifest(rows: DataFrame, group: str = "lang", order: str = "doc_id", leaf: str = "leaf", changed: str | None = None,
                    bits: int = RUN_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """``rows`` with a leaf digest (hex) -> one row a leaf: id, leaf, changed, subroot, root, proof (all digests binary).

    Leaves of a ``group`` (string) ascend by ``order`` (long; nulls after all others), then by digest; equal leaves
    are interchangeable. Groups ascend bytewise, the null group first; an empty string is a group of its own.
    ``changed`` names a second digest that is carried along (null: as ``leaf``). Other columns of ``rows`` are not
    read, so their names cannot clash; repeated rows are leaves of their own. An empty table gives no rows.
    """
    own = rows.select(F.col(group).cast("string").alias("grp"), F.col(order).cast("long").alias("id"), F.unhex(F.col(leaf)).alias("leaf"),
                      (F.unhex(F.col(changed)) if changed else F.lit(None).cast("binary")).alias("changed"), F.monotonically_increasing_id().alias("tie"))
    own = stash(own, "leaves")
    asc = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_last(), F.col("leaf").asc(), F.col("tie").asc()]
    at = placed(own, asc, "placed")
    runs = stash(at.groupBy("part", "grp").agg(F.min("place").alias("first"), F.count("*").alias("c")), "runs")  # partitions + groups rows
    groups = runs.groupBy("grp").agg(F.min("first").alias("first"), F.sum("c").alias("n"))
    trees = stash(placed(groups, [F.col("first").asc()], "groups").select("grp", "first", "n", F.col("place").alias("tree")), "trees")
    same = lambda a, b: F.col(f"{a}.grp").eqNullSafe(F.col(f"{b}.grp"))
    known = runs.alias("r").join(trees.alias("t"), same("r", "t")).select("r.part", "r.grp", "t.first", "t.n", "t.tree")
    leaves = at.alias("a").join(known.alias("k"), (F.col("a.part") == F.col("k.part")) & same("a", "k")).select(
        "k.tree", "k.n", (F.col("a.place") - F.col("k.first")).alias("pos"), F.col("a.leaf").alias("digest"), "a.id", "a.leaf", "a.changed")
    nodes, tops, height = grow(leaves, bits)

    # The tree over the groups, its leaves being the subroots.
    none = [F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("leaf", "binary"), ("changed", "binary"))]
    over = tops.select(F.lit(0).cast("long").alias("tree"), F.lit(trees.count()).cast("long").alias("n"), F.col("tree").alias("pos"), "digest", *none)
    inner, root, up = grow(over, bits)
    start = inner.withColumn("top", F.lit(None).cast("binary")).unionByName(root.withColumns({"seg": F.lit(b""), "top": F.col("digest")}))
    above = jump(start, up, fan_bits).select(F.col("pos").alias("tree"), F.col("seg").alias("_seg"), F.col("top").alias("_root"))

    ends = tops.join(above, "tree").withColumns({"seg": F.col("_seg"), "top": F.concat("digest", "_root")}).drop("_seg", "_root")
    proofs = jump(nodes.withColumn("top", F.lit(None).cast("binary")).unionByName(ends), height, fan_bits)
    return proofs.select("id", "leaf", F.coalesce("changed", "leaf").alias("changed"), F.substring("top", 1, 32).alias("subroot"), F.substring("top", 33, 32).alias("root"),
                         F.col("seg").alias("proof"))


def tampered_manifest(docs: DataFrame, every: int = 7, bits: int = RUN_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """Manifest of ``docs(doc_id, text, lang, source, n_chars)`` checked against a tampered copy.

    In the copy rows whose crc32 of the decimal doc_id is divisible by ``every`` have n_chars one higher (null ids and
    null n_chars stay). Result: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Nulls count as ``-`` in
    a leaf, empty texts as ``0:``; texts are hashed whole. See :func:`merkle_manifest` for ties and order.
    """
    names = ("doc_id", "source", "lang", "n_chars", "text")
    value = {c: F.col(c) for c in names}
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    leaf = digest(*(field(value[c]) for c in names))
    other = F.when(hit & F.col("n_chars").isNotNull(), digest(*(field(more if c == "n_chars" else value[c]) for c in names)))
    found = merkle_manifest(docs.select("lang", "doc_id", leaf.alias("leaf"), other.alias("changed")), changed="changed", bits=bits, fan_bits=fan_bits)
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    folded = found.select(F.col("id").alias("doc_id"), hexed("leaf"), hexed("subroot"), hexed("root"), F.sha2(siblings("proof").cast("binary"), 256).alias("proof_sha256"),
                          fold("changed", "proof").alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
