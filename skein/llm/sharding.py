"""Sharding by a k-d tree over metadata, cut at weighted medians.

Each document is a point: dimensions of its metadata as whole numbers from 0 to SCALE - 1. A node that has to hold k
leaves is cut along its widest dimension where its left side holds floor(k / 2) / k of its bytes, until each leaf holds
the target, all bytes / shards. Ties along the dimension are ordered by a hash of the text, so a cut may fall between
documents with the same metadata.

Documents with equal texts are one point: the dimensions are taken from the text (its length, its bytes a character,
its lines, its words), so copies share a shard wherever they come from, and no copies have to be brought together.

Cuts are found by histograms: a node's keys fall into BINS bins, the bin in which the cut lies is divided again, and so
on to single keys. Each pass is one aggregation over all nodes of a level; the driver gets sums of bins, at most
BINS * shards rows, whatever the table's size. Assigning rows is then a nested CASE; no row is moved for it.

Slots number a shard's rows from 0 in the order of a hash bucket, then doc_id; counts of (shard, bucket) give each
bucket's first slot, so a shard is never sorted in one task. Rows without doc_id are dealt to buckets by where they were
read, so many equal ones do not share a bucket; which of them gets which slot is open.

Defined cases: a null text has size 1, crc32 0 and the dimensions of the empty text; null ids count and get slots;
repeated rows get slots of their own; one text that outweighs a shard's target fills a shard alone or in part, since
copies stay together; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.storage import stored

SCALE, HASHES, BINS = 1 << 16, 1 << 44, 4096
#: Rows of a slot bucket that are aimed at, and buckets at least.
BUCKET_ROWS, BUCKETS = 200_000, 64
DIMENSIONS = ("length", "width", "lines", "words")


class Node(NamedTuple):
    """A node with its leaves: cut along `dimension` at `key` (keys up to it go left), or leaf number `shard`."""

    leaves: int
    shard: int
    dimension: str | None = None
    key: int = 0
    left: Node | None = None
    right: Node | None = None


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions, and tie (a hash of the text below HASHES)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n_bytes, n_chars = F.octet_length(text), F.length(text)
    ratio = lambda a, b: F.least(F.floor(a.cast("long") * (SCALE - 1) / F.greatest(b, F.lit(1))), F.lit(SCALE - 1)).cast("long")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (n_bytes.cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        # a factor of two in length is a sixteenth of the scale and more
        F.least(F.floor(F.log2(n_bytes.cast("double") + 1) * (SCALE / 40)), F.lit(SCALE - 1)).cast("long").alias("length"),
        ratio(n_bytes - n_chars, n_bytes).alias("width"),
        ratio(lines * 16, n_chars).alias("lines"),
        ratio(spaces * 2, n_chars).alias("words"),
        F.pmod(F.xxhash64(text), F.lit(HASHES)).alias("tie"),
    )


def _key(dimension: str) -> Column:
    return F.col(dimension) * HASHES + F.col("tie")


def _assigned(node: Node) -> Column:
    """The number of the leaf, or of the open node, that a row falls into."""
    if node.dimension is None:
        return F.lit(node.shard)
    return F.when(_key(node.dimension) <= node.key, _assigned(node.left)).otherwise(_assigned(node.right))


def _open(node: Node) -> list[Node]:
    if node.dimension is not None:
        return _open(node.left) + _open(node.right)
    return [node] if node.leaves > 1 else []


def _replaced(node: Node, by: dict[int, Node]) -> Node:
    if node.dimension is not None:
        return node._replace(left=_replaced(node.left, by), right=_replaced(node.right, by))
    return by.get(node.shard, node) if node.leaves > 1 else node


def _cuts(rows: DataFrame, wanted: dict[int, tuple[str, float, float]]) -> dict[int, tuple[int, float]]:
    """For each node the key up to which its rows hold the wanted bytes most nearly, and these bytes.

    rows: node, size, dimensions, tie; wanted: node -> (dimension, bytes on the left, bytes of the node).
    """
    span = {k: (0, SCALE * HASHES, 0.0) for k in wanted}  # the keys that are still open, and the bytes below them
    out: dict[int, tuple[int, float]] = {}
    key = F.coalesce(*[F.when(F.col("node") == k, _key(d)) for k, (d, _, _) in wanted.items()])
    rows = rows.withColumn("key", key)
    while span:
        low = F.coalesce(*[F.when(F.col("node") == k, F.lit(a)) for k, (a, _, _) in span.items()])
        width = F.coalesce(*[F.when(F.col("node") == k, F.lit(max(1, -(-(b - a) // BINS)))) for k, (a, b, _) in span.items()])
        high = F.coalesce(*[F.when(F.col("node") == k, F.lit(b)) for k, (_, b, _) in span.items()])
        inside = rows.withColumns({"low": low, "width": width}).where((F.col("key") >= F.col("low")) & (F.col("key") < high))
        bins = inside.groupBy("node", F.expr("(key - low) div width").alias("bin")).agg(F.sum("size").alias("size")).collect()
        by_node: dict[int, list[tuple[int, int]]] = {}
        for x in bins:
            by_node.setdefault(x.node, []).append((x.bin, x["size"]))
        after = {}
        for k, (a, b, below) in span.items():
            step, aim = max(1, -(-(b - a) // BINS)), wanted[k][1]
            for n, size in sorted(by_node.get(k, [])):
                if below + size >= aim:
                    if step == 1:
                        whole = wanted[k][2]
                        # before or after this key, whichever is nearer, as long as neither side is empty
                        take = (below + size - aim <= aim - below or below == 0) and below + size < whole
                        out[k] = (a + n, below + size) if take else (a + n - 1, below)
                    else:
                        after[k] = (a + n * step, min(a + (n + 1) * step, b), below)
                    break
                below += size
            else:
                out[k] = (b - 1, below)
        span = after
    return out


def grown(rows: DataFrame, shards: int) -> Node:
    """The tree over the rows of points(), with `shards` leaves where there are as many different texts."""
    tree = Node(shards, 0)
    full = {d: x for d, x in zip(DIMENSIONS, _spans(rows.withColumn("node", F.lit(0))).get(0, ([0] * len(DIMENSIONS), 0))[0], strict=True)}
    while nodes := _open(tree):
        placed = rows.withColumn("node", _assigned(tree)).where(F.col("node").isin([n.shard for n in nodes]))
        spans, wanted, by = _spans(placed), {}, {}
        for n in nodes:
            wide, total = spans.get(n.shard, ([0] * len(DIMENSIONS), 0))
            # widths are held against those of all rows
            d = max(range(len(DIMENSIONS)), key=lambda i: (wide[i] / max(full[DIMENSIONS[i]], 1), -i))
            if total:
                wanted[n.shard] = (DIMENSIONS[d], total * (n.leaves // 2) / n.leaves, total)
        cuts = _cuts(placed, wanted) if wanted else {}
        for n in nodes:
            key, left = cuts.get(n.shard, (0, 0))
            total = wanted[n.shard][2] if n.shard in wanted else 0
            if not 0 < left < total:
                by[n.shard] = n._replace(leaves=1)
                continue
            # leaves go where the bytes went
            k = min(max(round(n.leaves * left / total), 1), n.leaves - 1)
            by[n.shard] = Node(n.leaves, n.shard, wanted[n.shard][0], key, Node(k, n.shard), Node(n.leaves - k, n.shard + k))
        tree = _replaced(tree, by)
    return tree


def _spans(rows: DataFrame) -> dict[int, tuple[list[int], int]]:
    """For each node the widths of its dimensions, and its bytes."""
    wide = [(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]
    return {x.node: ([x[d] for d in DIMENSIONS], x["size"]) for x in rows.groupBy("node").agg(*wide, F.sum("size").alias("size")).collect()}


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row."""
    # rows without id are told apart by where they were read, which is stored with them
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)))
    rows = stored(points(docs).withColumn("salt", salt), "points")
    tree = grown(rows, shards)
    n = rows.count()
    buckets = max(BUCKETS, -(-n // (BUCKET_ROWS * shards)))
    placed = rows.select("doc_id", "size", "text_crc32", _assigned(tree).alias("shard"), F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "salt"), F.lit(buckets)).cast("int").alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32"))
    out = placed.withColumn("number", number).join(first, ["shard", "bucket"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
