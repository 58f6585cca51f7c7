"""N-gram Jaccard join: documents whose word 5-gram sets overlap by 0.8 or more.

1. Every text becomes a set of n-gram hashes; texts of equal sets collapse into
   one *node* before anything is compared, so exact copies cost one row each.
2. MinHash signatures are cut into bands (``choose_bands`` picks the counts for
   a target recall); nodes are shuffled on band hashes. A bucket never lists its
   pairs: each node is tied to the bucket's least node only.
3. Nodes tied together are verified on their full n-gram sets. A large candidate
   class is split into blocks; each pair of blocks is one group of bounded size
   in which overlaps are counted by matrix products. A group returns one row
   per node (its links and a spanning edge), never the pairs.
4. Verified spanning edges give the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .components import components
from .hashed import numbered
from .store import cut


def choose_bands(threshold: float = 0.8, recall: float = 0.999, rows: int = 7) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` values that catch a pair at ``threshold`` with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def gram_sets(batches: Iterator[pa.RecordBatch], text: str, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Per row the sorted distinct n-gram hashes. A text without words has the hash of its raw bytes as its only gram."""
    for rows, offsets, data in tv.pieces(batches, text):
        _, _, first, h = tv.text_words(offsets, data)
        sh, off = tv.shingles(h, first, n)
        raw = tv.hash_ranges(data, offsets[:-1], offsets[1:], tv.EXACT) ^ tv.U64(0x5851F42D4C957F2D)
        yield rows, [np.unique(sh[off[i] : off[i + 1]]) if off[i + 1] > off[i] else raw[i : i + 1] for i in range(len(off) - 1)]


def node_of(grams: np.ndarray) -> bytes:
    """16 bytes that stand for a set of grams."""
    with np.errstate(over="ignore"):
        a = tv.mix(grams ^ tv.U64(0x2545F4914F6CDD1D)).sum(dtype=tv.U64)
        b = tv.mix(grams + tv.U64(0x632BE59BD9B4E019)).sum(dtype=tv.U64) + tv.U64(len(grams))
    return a.byteswap().tobytes() + b.byteswap().tobytes()


def _signer(text: str, n: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(99)
        a = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[:, None] | np.uint32(1)
        b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[:, None]
        salt = rng.integers(1, 1 << 63, (bands, rows), dtype=np.uint64) | tv.U64(1)
        for part, sets in gram_sets(batches, text, n):
            out = np.empty((len(sets), bands), np.uint64)
            nodes = []
            for i, g in enumerate(sets):
                x = (g >> tv.U64(32)).astype(np.uint32)
                low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
                for at in range(0, len(x), 2048):
                    h = x[None, at : at + 2048] * a
                    h += b
                    np.minimum(low, h.min(axis=1), out=low)
                out[i] = (low.reshape(bands, rows).astype(np.uint64) * salt).sum(axis=1, dtype=np.uint64)
                nodes.append(node_of(g))
            counts = pa.array([len(g) for g in sets], pa.int64())
            out = tv.mix(out).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, bands, dtype=np.int32), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(c for k, c in zip(part.schema.names, part.columns) if k != text), pa.array(nodes, pa.binary()), counts, lists], [*(k for k in part.schema.names if k != text), "node", "n_grams", "bands"])

    return sign


def _gram_rows(text: str, n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in gram_sets(batches, text, n):
            yield pa.RecordBatch.from_arrays([pa.array([node_of(g) for g in sets], pa.binary()), pa.array([g.tobytes() for g in sets], pa.binary())], ["node", "grams"])

    return rows


def _overlaps(grams: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from matrix products over the grams that occur twice or more."""
    m = len(grams)
    who = np.repeat(np.arange(m), [len(g) for g in grams])
    _, col, n = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    often = np.cumsum(n > 1) - 1
    keep = n[col] > 1
    who, col, total = who[keep], often[col[keep]], int((n > 1).sum())
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    out = np.zeros((m, m), np.float32)
    width = max(256, (1 << 22) // m)
    for c in range(0, total, width):
        a, b = np.searchsorted(col, [c, c + width])
        x = np.zeros((m, min(width, total - c)), np.float32)
        x[who[a:b], col[a:b] - c] = 1
        out += x @ x.T
    return out


def verify(grams: list[np.ndarray], side: np.ndarray, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node and the least index of its linked class within one group."""
    size = np.array([len(g) for g in grams], float)
    both = _overlaps(grams)
    link = np.empty(both.shape, bool)
    for a in range(0, len(grams), 256):
        part = both[a : a + 256].astype(float)
        link[a : a + 256] = part >= threshold * (size[a : a + 256, None] + size[None, :] - part) - 1e-9
    np.fill_diagonal(link, False)
    if cross:
        link &= side[:, None] != side[None, :]
    root = np.arange(len(grams))
    while True:
        low = np.minimum(root, np.where(link, root[None, :], len(grams)).min(axis=1))
        low = low[low]
        if (low == root).all():
            return link.sum(axis=1), root
        root = low


def _verifier(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        node, side = t.column("node").to_pylist(), t.column("side").to_numpy()
        order = sorted(range(len(node)), key=node.__getitem__)
        grams = [np.frombuffer(g, np.uint64) for g in t.column("grams").to_pylist()]
        links, root = verify([grams[i] for i in order], side[order], bool(t.column("cross")[0].as_py()), threshold)
        return pa.table({"node": pa.array([node[i] for i in order], pa.binary()), "links": pa.array(links.astype(np.int64)), "root": pa.array([node[order[r]] for r in root], pa.binary())})

    return run


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 1024, block_grams: int = 4_000_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, class_id, n_links, n_copies, class_node, and the columns of ``carry``.

    class_id is the least id among the documents of the class (null if all its
    ids are null); a candidate class is split so that a block has about ``block``
    texts or ``block_grams`` n-grams, whichever is less; n_links counts the other different texts that share 0.8 of
    their n-grams with it; n_copies the rows whose n-gram set is the same, itself
    included. Words are runs of ASCII letters, digits and non-ASCII characters,
    A-Z lower-cased. A text of fewer than ``n`` words is one gram of all its
    words; a null text counts as empty, and a text without words is linked with
    its exact copies only. Repeated rows and repeated ids stay as they are, and
    an empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    bands, rows = choose_bands(threshold, recall)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *carry)
    kept = "".join(f"{c} {src.schema[c].dataType.simpleString()}, " for c in ("id", *carry))
    signed = cut(src.mapInArrow(_signer("text", n, bands, rows), f"{kept}node binary, n_grams bigint, bands array<bigint>"))
    nodes = signed.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n_copies"), F.any_value("n_grams").alias("n_grams"), F.any_value("bands").alias("bands"))
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    hubs = keyed.groupBy("band", "h").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1")
    ties = keyed.join(hubs, ["band", "h"]).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    cand = cut(components(ties).withColumnRenamed("root", "cand"))
    cand = cand.join(nodes.select("node", "n_grams"), "node")
    sizes = cand.groupBy("cand").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_grams") / block_grams)).cast("int").alias("nb"))
    placed = cand.drop("n_grams").join(sizes, "cand")
    placed = placed.withColumn("side", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    grams = src.select("text").mapInArrow(_gram_rows("text", n), "node binary, grams binary").join(placed, "node").groupBy("node").agg(*(F.first(c).alias(c) for c in ("cand", "side", "nb", "grams")))
    groups = grams.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "cand", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "side", (F.col("side") != F.col("other")).alias("x"), "grams"
    )
    groups = groups.select("cand", "i", "j", "node", "side", (F.col("i") != F.col("j")).alias("cross"), "grams")
    seen = cut(groups.groupBy("cand", "i", "j").applyInArrow(_verifier(threshold), "node binary, links bigint, root binary"))
    links = seen.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(seen.select(F.col("node").alias("a"), F.col("root").alias("b")))
    small = nodes.select("node", "least", "n_copies")
    named = roots.join(small.select("node", "least"), "node")
    least = named.groupBy("root").agg(F.min("least").alias("class_least"))
    linked = roots.join(least, "root").join(links, "node").select("node", F.col("root").alias("class_node"), "class_least", "n_links")
    per_node = small.join(linked, "node", "left")
    return signed.drop("bands", "n_grams").join(per_node, "node").select(
        F.col("id").alias(id_col), F.coalesce("class_least", "least").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", F.coalesce("class_node", "node").alias("class_node"), *carry
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of every class kept: the least id (null last), then the least row hash.

    Of rows equal in every column one stays. A null text counts as an empty one,
    so of all null and empty texts one stays. All columns are returned as they
    were, whatever their names; an empty table gives an empty result.
    """
    src = numbered(docs)
    name, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    keyed = src.withColumn("row_key", F.xxhash64(*src.columns))
    rows = jaccard_classes(keyed, name, text, carry=("row_key",), **options)
    best = F.struct(F.col(name).isNull().alias("n"), F.col(name).alias("id"), F.col("row_key").alias("k"))
    kept = rows.groupBy("class_node").agg(F.min(best).alias("b")).select(F.col("b.id").alias("id"), F.col("b.k").alias("k"))
    repeats = rows.groupBy(F.col(name).alias("rid"), F.col("row_key").alias("rk")).agg(F.count("*").alias("repeats"))
    kept = kept.join(repeats, F.col("id").eqNullSafe(F.col("rid")) & (F.col("k") == F.col("rk"))).select("id", "k", "repeats")
    picked = keyed.join(kept, F.col(name).eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("k")))
    once = picked.where("repeats = 1").select(*src.columns)
    again = picked.where("repeats > 1").dropDuplicates(["id", "k"]).select(*src.columns)
    return once.union(again).toDF(*docs.columns)
