"""Prefix trie of conversations by splitters and a skeleton.

Each conversation is a path of turn digests (16 bytes of role and text; texts are never shuffled). Paths, the smallest id
last, are dealt out by range to sorted shards. A node lies in two shards only if it is a prefix of a splitter between
them, so the trie of the splitter paths, the skeleton, is all that shards share: it is broadcast, each shard finishes
every other node in one pass over its sorted rows, and the skeleton's nodes combine the shards' partial counts by a
reduction. Its size is at most shards times ``segment``. Because the id closes the sort key, any number of equal
conversations is split like any other rows.

A conversation longer than ``segment`` turns is cut into segments, each a path of a trie of its own that is rooted at a hash of
the turns before it, so no row grows with a conversation. What lies below a segment's end is counted first, carried by
the smallest conversation of each node, and added where the conversation passes. Turns are numbered without a window over
a whole conversation: by range partitions, chunks, and the chunks' sizes.

The ids of conversations that end at a node are hashed in order as they are met. At a skeleton node each shard leaves
blocks of ids, which one pass per node hashes in order; SHA-256 of a list is sequential, so that pass reads a node's
blocks one after another and holds none of them.

Defined results: turns of one number are ordered by their digest; a null role or text is empty; rows without conv_id belong to
no conversation and go; repeated rows are turns of their own; digests of 128 bits stand for turns; an empty table has no
node; extra columns are left behind.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrade.sources.staging import cut, table

from .common import bounded_batches

#: Bytes of a turn's digest and of its size in a path.
WIDE, SIZE = 16, 8
#: Turns of a segment.
SEGMENT = 256
#: Rows of a shard, about, and rows sampled for each splitter.
SHARD, SAMPLED = 500_000, 20
#: Ids of one block at a skeleton node.
BLOCK = 4096
#: Turns that a base conversation can lend, one more than the longest loan.
MOST_LENT, FAMILY = 9, 5
PIECE = "conv_id long, part long, seq long, n long, path binary, sizes binary"
ROW = "kind string, key binary, parent_key binary, level long, depth long, bytes long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string"
NODE = ["level", "depth", "bytes", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
NONE = hashlib.sha256().hexdigest()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], [f for f, _ in fields])


def pieces(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Runs of at most ``segment`` turns in order, as PIECE says: part and seq order the pieces of a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    order = ["conv_id", "turn", "digest"]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "size", F.spark_partition_id().cast("long").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, seq, path, sizes = None, 0, 0, [], array("q")

        def piece() -> tuple:
            return conv, part, seq, len(path), b"".join(path), sizes.tobytes()

        for b in batches:
            out = []
            for c, digest, size, part in zip(*[b.column(x).to_pylist() for x in ("conv_id", "digest", "size", "part")], strict=True):
                if path and (c != conv or len(path) == segment):
                    out.append(piece())
                    path, sizes, seq = [], array("q"), seq + 1
                conv = c
                path.append(digest)
                sizes.append(size)
            if out:
                yield _batch(out, PIECE)
        if path:
            yield _batch([piece()], PIECE)

    return bounded_batches(dealt).mapInArrow(run, PIECE)


def rebuilt(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, level, path, sizes and goes_on: each conversation with the first turns of its family's base, as segments.

    A conversation c borrows the first h turns of the conversation c - c % 5 and goes on with its own after its first h; h is the
    CRC-32 of its decimal id modulo 9.
    """
    run = cut(pieces(conversations, segment), "trie-pieces").withColumn("base", F.expr(f"conv_id - conv_id % {FAMILY}"))
    own = Window.partitionBy("base", "conv_id")
    before = own.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = run.withColumns({"start": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(own)})
    joined = "aggregate(array_sort(collect_list(struct(at, path, sizes))), struct(X'' AS path, X'' AS sizes), (a, x) -> struct(concat(a.path, x.path) AS path, concat(a.sizes, x.sizes) AS sizes))"
    lent = placed.where(f"conv_id = base AND start < {MOST_LENT}").selectExpr("base", "start AS at", f"substring(path, 1, {WIDE} * ({MOST_LENT} - start)) AS path", f"substring(sizes, 1, {SIZE} * ({MOST_LENT} - start)) AS sizes")
    heads = lent.groupBy("base").agg(F.expr(joined).alias("head"))
    lends = placed.join(heads, "base", "left").withColumn("h", F.expr(f"crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % {MOST_LENT}"))
    lends = lends.withColumn("n_head", F.expr(f"least(h, coalesce(octet_length(head.path), 0) DIV {WIDE})"))
    lends = lends.withColumns({"skip": F.expr("greatest(h - start, 0)"), "last": F.expr(f"greatest(n_head + greatest(total - h, 0) - 1, 0) DIV {segment}")})
    borrowed = f"IF(start = 0, array(struct(CAST(0 AS BIGINT) AS at, n_head AS n, coalesce(substring(head.path, 1, CAST({WIDE} * n_head AS INT)), X'') AS path, coalesce(substring(head.sizes, 1, CAST({SIZE} * n_head AS INT)), X'') AS sizes)), array())"
    rest = f"IF(skip < n, array(struct(n_head + greatest(start, h) - h AS at, n - skip AS n, substring(path, CAST({WIDE} * skip AS INT) + 1) AS path, substring(sizes, CAST({SIZE} * skip AS INT) + 1) AS sizes)), array())"
    parts = lends.select("base", "conv_id", "last", F.explode(F.expr(f"concat({borrowed}, {rest})")).alias("x")).select("base", "conv_id", "last", "x.*")
    level = parts.select("*", F.explode(F.expr(f"sequence(at DIV {segment}, greatest(at, at + n - 1) DIV {segment})")).alias("level"))
    level = level.withColumns({"a": F.expr(f"CAST(greatest(level * {segment} - at, 0) AS INT)"), "z": F.expr(f"CAST(least((level + 1) * {segment} - at, n) AS INT)")})
    sliced = level.selectExpr("base", "conv_id", "last", "level", "at", f"substring(path, {WIDE} * a + 1, {WIDE} * (z - a)) AS path", f"substring(sizes, {SIZE} * a + 1, {SIZE} * (z - a)) AS sizes")
    whole = sliced.groupBy("base", "conv_id", "level").agg(F.expr(joined).alias("x"), F.max("last").alias("last"))
    return whole.select("conv_id", "level", "x.path", "x.sizes", (F.col("level") < F.col("last")).alias("goes_on"))


class _Node:
    __slots__ = ("children", "conv", "depth", "ends", "key", "leaves", "n", "pending", "saved", "size")

    def __init__(self, depth: int, size: int, key: bytes | None) -> None:
        self.depth, self.size, self.key = depth, size, key
        self.n, self.conv, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends, self.pending = None, []


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with together."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i : i + WIDE] == b[i : i + WIDE]:
        i += WIDE
    return i // WIDE


class _Pass:
    """One pass over a shard's rows in order; rows of the result gather in ``out``.

    A node with a key belongs to the skeleton, and its row ("s") is partial. Other nodes' rows ("n") wait for the smallest
    conversation of their parent, or name the parent's key where that belongs to the skeleton.
    """

    def __init__(self, low: tuple | None, high: tuple | None) -> None:
        self.walls = [w for w in (low, high) if w]
        self.root, self.path, self.level, self.parent_min, self.stack, self.out = None, b"", 0, None, [], []

    def close(self, depth: int) -> None:
        """Finish the open nodes deeper than depth."""
        while self.stack and self.stack[-1].depth > depth:
            x, parent = self.stack.pop(), self.stack[-1] if self.stack else None
            self.out += [(*row[:7], x.conv, *row[8:]) for row in x.pending]
            top = self.level > 0 and x.depth == 1
            if self.level and not x.depth:  # the end of the segment before, which has its row there
                continue
            if x.key:
                self.leave_block(x)
                above = parent.key if parent and not top else None
                self.out.append(("s", x.key, above, self.level, x.depth, x.size, x.conv, self.parent_min if top else None, x.n, x.children, x.leaves, x.saved, None))
            else:
                x.leaves = x.leaves if x.children else 1
                x.saved += (x.n - 1) * x.size
                row = ("n", None, None if top else parent.key, self.level, x.depth, x.size, x.conv, self.parent_min if top else None, x.n, x.children, x.leaves, x.saved, x.ends.hexdigest() if x.ends else NONE)
                (self.out if top or parent.key else parent.pending).append(row)
                parent.children += 1
            if parent:
                parent.n, parent.conv = parent.n + x.n, x.conv if parent.conv is None else min(parent.conv, x.conv)
                parent.leaves, parent.saved = parent.leaves + x.leaves, parent.saved + x.saved

    def leave_block(self, x: _Node) -> None:
        if x.ends:
            self.out.append(("e", x.key, None, self.level, x.depth, 0, x.ends[0], None, len(x.ends), 0, 0, 0, ",".join(map(str, x.ends))))
            x.ends = None

    def add(self, root: bytes, level: int, path: bytes, sizes: bytes, conv: int, goes_on: bool, parent_min: int | None, children: int, leaves: int, saved: int) -> None:
        if root != self.root:
            self.close(-1)
            self.root, self.level, self.path, self.parent_min = root, level, b"", parent_min
        same = _shared(self.path, path) if self.stack else -1
        self.close(same)
        common = max([_shared(path, w[1]) for w in self.walls if w[0] == root], default=0 if not level else -1)
        for depth in range(same + 1, len(path) // WIDE + 1):
            key = hashlib.md5(root + b"/" + path[: WIDE * depth]).digest() if depth <= common else None
            self.stack.append(_Node(depth, int.from_bytes(sizes[SIZE * (depth - 1) : SIZE * depth], "little") if depth else 0, key))
        self.path, x = path, self.stack[-1]
        x.n, x.conv = x.n + 1, conv if x.conv is None else min(x.conv, conv)
        x.children, x.leaves, x.saved = x.children + children, x.leaves + leaves, x.saved + saved
        if goes_on:
            return
        if x.key:
            x.ends = x.ends or []
            x.ends.append(conv)
            if len(x.ends) == BLOCK:
                self.leave_block(x)
        elif x.ends:
            x.ends.update(b",%d" % conv)
        else:
            x.ends = hashlib.sha256(b"%d" % conv)


def splitters(segments: DataFrame, shards: int, rows: int) -> list[tuple]:
    """At most shards - 1 (root, path, conv_id) that deal rows out evenly; SAMPLED rows for each come to the driver, none longer than a segment."""
    every = max(1, rows // (SAMPLED * shards))
    sample = segments.where(F.pmod(F.xxhash64("conv_id", "level"), F.lit(every)) == 0).select("root", "path", "conv_id").collect()
    keys = sorted((bytes(r["root"]), bytes(r["path"]), r["conv_id"]) for r in sample)
    return sorted({keys[i * len(keys) // shards] for i in range(1, shards)}) if keys else []


def nodes(segments: DataFrame, shard: int = SHARD) -> DataFrame:
    """Nodes of the tries of segments, with the columns of NODE; depth counts from the segment's root.

    segments: conv_id, root, level, path, sizes, goes_on, parent_min (the smallest conversation at the root, where level isn't 0),
    and the children, leaves and saved bytes that lie below the end of the path. A row's saved includes its subtree, n_leaves too.
    """
    spark, rows = segments.sparkSession, segments.count()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // shard))
    walls = spark.sparkContext.broadcast(splitters(segments, shards, rows))
    columns = ["root", "level", "path", "sizes", "conv_id", "goes_on", "parent_min", "children", "leaves", "saved"]
    flat = segments.select(*columns)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(*[b.column(c).to_pylist() for c in ("root", "path", "conv_id")], strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bisect_right(walls.value, k) for k in keys], pa.int32())], [*columns, "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            for *row, number in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if at is None:
                    at = _Pass(walls.value[number - 1] if number else None, walls.value[number] if number < len(walls.value) else None)
                at.add(*row)
            if at and at.out:
                yield _batch(at.out, ROW)
                at.out = []
        if at:
            at.close(-1)
            if at.out:
                yield _batch(at.out, ROW)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema)
    dealt = bounded_batches(flat).mapInArrow(deal, f"{kinds}, shard int")
    # A shard is one partition: its number is the partition's, so rows of one shard never share a task with another's.
    found = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("root", "path", "conv_id").mapInArrow(run, ROW)
    found = cut(found, "trie-rows")
    skeleton = combined(found)
    smallest = skeleton.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("of_parent"))
    local = found.where("kind = 'n'").join(F.broadcast(smallest), "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "of_parent"))
    shared = skeleton.join(digests(found.where("kind = 'e'")), "key", "left").withColumn("ends", F.coalesce("ends", F.lit(NONE)))
    return local.select(*NODE).unionByName(shared.select(*NODE))


def combined(found: DataFrame) -> DataFrame:
    """The skeleton's nodes, from their partial rows: counts are summed by node in Spark, subtrees from the deepest node up.

    The skeleton has at most shards times ``segment`` nodes, so its tree is walked on the driver.
    """
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    least = [F.min(c).alias(c) for c in ("parent_key", "level", "depth", "bytes", "conv_id", "parent_conv_id")]
    rows = {bytes(r["key"]): r.asDict() for r in found.where("kind = 's'").groupBy("key").agg(*least, *total).collect()}
    for r in rows.values():
        if r["parent_key"] is not None:
            rows[bytes(r["parent_key"])]["n_children"] += 1
    for r in rows.values():
        r["more"] = [int(r["n_children"] == 0), (r["n_convs"] - 1) * r["bytes"]]
    for r in sorted(rows.values(), key=lambda r: -r["depth"]):
        r["n_leaves"], r["saved"] = r["n_leaves"] + r["more"][0], r["saved"] + r["more"][1]
        if r["parent_key"] is not None:
            above = rows[bytes(r["parent_key"])]
            above["more"] = [a + b for a, b in zip(above["more"], r["more"], strict=True)]
            r["parent_conv_id"] = above["conv_id"]
    names = ["key", *NODE[:-1]]
    return found.sparkSession.createDataFrame([tuple(r[c] for c in names) for r in rows.values()], ", ".join(f"{c} {'binary' if c == 'key' else 'long'}" for c in names))


def digests(blocks: DataFrame) -> DataFrame:
    """key and ends: the digest of each node's ids, hashed block after block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for k, text in zip(b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    out += [(key, state.hexdigest())] if state else []
                    key, state = k, hashlib.sha256()
                state.update(text.encode())
            if out:
                yield _batch(out, "key binary, ends string")
        if state:
            yield _batch([(key, state.hexdigest())], "key binary, ends string")

    return blocks.select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends string")


def _rooted(long_ones: DataFrame) -> DataFrame:
    """Segments of conversations of at least one full segment, with root and next_root: hashes of the turns before and up to here."""
    upto = Window.partitionBy("conv_id").orderBy("level")
    word = [F.xxhash64(F.lit(salt), "level", "path") for salt in (1, 2)]

    def hashed(frame, level) -> Column:
        parts = [F.lpad(F.hex(level), 16, "0"), *[F.lpad(F.hex(F.coalesce(F.bit_xor(w).over(frame), F.lit(0))), 16, "0") for w in word]]
        return F.unhex(F.concat(*parts))

    return long_ones.withColumns({"root": hashed(upto.rowsBetween(Window.unboundedPreceding, -1), F.col("level")), "next_root": hashed(upto.rowsBetween(Window.unboundedPreceding, 0), F.col("level") + 1)})


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    segments = cut(rebuilt(conversations, segment), "trie-segments")
    nothing = {c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")}
    long_ones = segments.where((F.col("level") > 0) | (F.octet_length("path") == WIDE * segment))
    if long_ones.where("level > 0").isEmpty():
        whole = segments.withColumns({"root": F.lit(b""), "parent_min": F.lit(None).cast("long"), **nothing})
    else:
        rooted = cut(_rooted(long_ones), "trie-rooted")
        at_root = rooted.where(F.octet_length("path") == WIDE * segment).groupBy("next_root").agg(F.min("conv_id").alias("parent_min"))
        lower = cut(rooted.where("level > 0").drop("next_root").join(at_root.withColumnRenamed("next_root", "root"), "root"), "trie-lower")
        first = nodes(lower.withColumns({**nothing, "children": F.col("goes_on").cast("long")}), shard)
        own = first.groupBy("conv_id", "level").agg(F.sum((F.col("depth") == 1).cast("long")).alias("children"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
        deeper = Window.partitionBy("conv_id").orderBy(F.desc("level"))
        below = deeper.rowsBetween(Window.unboundedPreceding, -1)
        sums = rooted.select("conv_id", "level").join(own, ["conv_id", "level"], "left")
        sums = sums.select("conv_id", "level", F.coalesce(F.lag("children").over(deeper), F.lit(0)).alias("children"), *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(c) for c in ("leaves", "saved")])
        sums = cut(sums.where("children + leaves + saved > 0"), "trie-below")
        upper = segments.where("level = 0").withColumns({"root": F.lit(b""), "parent_min": F.lit(None).cast("long")})
        whole = upper.unionByName(lower).join(sums, ["conv_id", "level"], "left").fillna(0, ["children", "leaves", "saved"])
        whole = cut(whole, "trie-whole")
    found = nodes(whole, shard)
    depth = (F.col("level") * segment + F.col("depth")).alias("depth")
    return found.select("conv_id", depth, "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH own AS (
  SELECT conv_id AS c, strlen(coalesce(text, '')) AS size, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_md5, turn FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, turn_md5) AS i FROM own),
sized AS (SELECT c, max(i) AS n FROM numbered GROUP BY c),
hashed AS (
  SELECT c, n, c - c % 5 AS base, (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, range(8 * length(c::VARCHAR))), lambda crc, k:
    xor((xor(crc, CASE WHEN k % 8 = 0 THEN ascii(substr(c::VARCHAR, (k // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT) >> 1),
        3988292384 * (xor(crc, CASE WHEN k % 8 = 0 THEN ascii(substr(c::VARCHAR, (k // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT) & 1)))) % 9 AS h
  FROM sized),
ids AS (SELECT h.c, h.base, h.h, least(h.h, coalesce(b.n, 0)) AS lent FROM hashed h LEFT JOIN sized b ON b.c = h.base),
turns AS (
  SELECT ids.c, i AS pos, turn_md5, size FROM ids JOIN numbered o ON o.c = ids.base AND o.i <= ids.h
  UNION ALL SELECT ids.c, lent + i - h, turn_md5, size FROM ids JOIN numbered o ON o.c = ids.c AND o.i > ids.h),
paths AS (SELECT ids.c, coalesce(list(turn_md5 ORDER BY pos) FILTER (WHERE turn_md5 IS NOT NULL), []) AS p, coalesce(list(size ORDER BY pos) FILTER (WHERE size IS NOT NULL), []) AS sizes FROM ids LEFT JOIN turns USING (c) GROUP BY ids.c),
steps AS (SELECT c, p, sizes, unnest(range(len(p) + 1)) AS depth FROM paths),
nodes AS (
  SELECT array_to_string(p[1:depth], ',') AS k, depth, any_value(p[1:depth]) AS p, min(c) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END) AS size,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(steps.p) = depth), '')) AS ends_sha256
  FROM steps GROUP BY k, depth),
linked AS (SELECT n.*, a.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes a ON n.depth > 0 AND a.depth = n.depth - 1 AND a.k = array_to_string(n.p[1:n.depth - 1], ',')),
fans AS (SELECT array_to_string(p[1:depth - 1], ',') AS k, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
above AS (SELECT n.*, coalesce(n_children, 0) AS n_children, unnest(range(n.depth + 1)) AS up FROM nodes n LEFT JOIN fans USING (k, depth)),
subtrees AS (SELECT array_to_string(p[1:up], ',') AS k, up AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM above GROUP BY ALL)
SELECT conv_id, l.depth, parent_conv_id, n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM linked l JOIN subtrees USING (k, depth) LEFT JOIN fans USING (k, depth)
"""
