"""Token windows: hashes of all runs of a length, and which of them repeat."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

#: Tokens of the run that stands for a window until it is known to repeat, and tokens taken at a time.
GRAM, PORTION = 8, 500_000


def hashed(streams: DataFrame, tokens: str) -> DataFrame:
    """``streams`` with ha and hb: two 64-bit hashes of every token of an array."""
    return streams.withColumn("ha", F.transform(tokens, lambda t: F.xxhash64(t))).withColumn("hb", F.transform(tokens, lambda t: F.xxhash64(F.lit(1), t)))


def doubled(streams: DataFrame, step: int, a: str = "ha", b: str = "hb", to_a: str = "ha", to_b: str = "hb") -> DataFrame:
    """``streams`` with the hashes of all runs of 2 * ``step`` tokens, from those of ``step`` tokens; streams without one have none."""
    at = F.when(F.size(a) > step, F.sequence(F.lit(0), F.size(a) - (step + 1))).otherwise(F.expr("cast(array() as array<int>)"))

    def join(h: str) -> Column:
        return F.transform(at, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + step)))

    return streams.select(*(c for c in streams.columns if c not in (to_a, to_b)), join(a).alias(to_a), join(b).alias(to_b))


def windows(streams: DataFrame, stream: str, tokens: str, size: int, stated: str | None = None) -> DataFrame:
    """(stream, at, key): every run of ``size`` tokens of an array, by position from 0 and 128-bit key. With ``stated``, a parallel array of flags, only runs that hold a true one."""
    # Hashes of runs of 1, 2, 4, ... tokens; a window is made of one for each bit of its size, so a longer window costs no more for each place.
    kept = [stream, *([stated] if stated else [])]
    rows = hashed(streams.where(F.size(tokens) >= size).select(*kept, F.col(tokens).alias("__t")), "__t").select(*kept, F.col("ha").alias("__a0"), F.col("hb").alias("__b0"))
    top = size.bit_length() - 1
    for k in range(top):
        rows = doubled(rows, 1 << k, f"__a{k}", f"__b{k}", f"__a{k + 1}", f"__b{k + 1}")
    parts, done = [], 0
    for k in range(top, -1, -1):
        if size >> k & 1:
            parts.append((k, done))
            done += 1 << k
    at = F.sequence(F.lit(0), F.size("__a0") - size)
    if stated is not None:
        # How many flags are set before each place would need a running sum; the next set one at or after it is as good.
        rows = rows.withColumn("__set", F.filter(F.transform(stated, lambda f, i: F.when(f, i)), lambda i: i.isNotNull()))
        near = F.flatten(F.transform("__set", lambda i, j: F.sequence(F.greatest(i - (size - 1), F.when(j > 0, F.get("__set", j - 1) + 1).otherwise(0)), i)))
        at = F.filter(near, lambda i: i <= F.size("__a0") - size)
        rows = rows.where(F.size("__set") > 0)

    def window(i: Column) -> Column:
        return F.struct(i.alias("at"), F.xxhash64(*(F.get(f"__a{k}", i + o) for k, o in parts)).alias("k1"), F.xxhash64(*(F.get(f"__b{k}", i + o) for k, o in parts)).alias("k2"))

    out = rows.select(stream, F.explode(F.transform(at, window)).alias("w"))
    return out.select(stream, F.col("w.at").alias("at"), F.struct("w.k1", "w.k2").alias("key"))


def in_band(found: DataFrame, low: int = 2, high: int = 64) -> DataFrame:
    """Keys that occur ``low`` to ``high`` times, with their count: rarer ones repeat nothing, commoner ones are tables."""
    return found.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n").between(low, high))


def counted(found: DataFrame) -> DataFrame:
    """``found`` with n: how many rows have its key."""
    return found.withColumn("n", F.count("*").over(Window.partitionBy("key")))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x7F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _joined(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` hashes, from those of runs of 1, 2, 4, ..."""
    count, step, done, out = len(hashes) - size + 1, 1, 0, None
    while True:
        if size & step:
            part = hashes[done : done + count]
            out = part if out is None else _mixed(out, part)
            done += step
        if 2 * step > size:
            return out
        hashes, step = _mixed(hashes[:-step], hashes[step:]), 2 * step


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Where the first least of every run of ``size`` values is."""

    def lesser(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(values[x] <= values[y], x, y)

    at, step = np.arange(len(values)), 1
    while 2 * step <= size:
        at, step = lesser(at[:-step], at[step:]), 2 * step
    return lesser(at[: len(values) - size + 1], at[size - step :])


def _portions(batch: pa.RecordBatch, size: int) -> Iterator[tuple]:
    """Streams of a batch in portions: the rows, where each starts, the hashes of their tokens, their windows' starts and anchors, and the hashes of runs of a gram."""
    lengths = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    portion = (np.cumsum(lengths) - lengths) // PORTION
    for cut_at in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(portion)) + 1):
        if not len(cut_at) or lengths[cut_at].max() < size:
            continue
        rows = batch.slice(int(cut_at[0]), len(cut_at))
        n = lengths[cut_at]
        ends = np.cumsum(n)
        hashes = rows.column(1).flatten().to_numpy().view(np.uint64)
        grams = _joined(hashes, min(GRAM, size))
        ok = np.flatnonzero(np.repeat(ends, n) - np.arange(len(hashes)) >= size)
        yield rows, ends - n, hashes, ok, _least(grams, size - min(GRAM, size) + 1)[ok], grams


def _anchors(size: int, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, starts, _, _, anchors, grams in _portions(batch, size):
                at = np.unique(anchors)
                row = np.searchsorted(starts, at, "right") - 1
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), pa.array((at - starts[row]).astype(np.int32)), pa.array(grams[at].view(np.int64))], names)

    return run


def _marked(size: int, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, starts, hashes, ok, anchors, _ in _portions(batch, size):
                marks = rows.column(3)
                spots = np.repeat(starts, marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) + marks.flatten().to_numpy()
                held = np.zeros(len(hashes), bool)
                held[spots[spots < len(hashes)]] = True  # of rows that share a name, another's marks may lie beyond
                at = ok[held[anchors]]
                row = np.searchsorted(starts, at, "right") - 1
                keys = [_joined(h, size)[at].view(np.int64) for h in (hashes, rows.column(2).flatten().to_numpy().view(np.uint64))]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), pa.array((at - starts[row]).astype(np.int32)), *map(pa.array, keys)], names)

    return run


def repeating(streams: DataFrame, stream: str, tokens: Column, size: int) -> DataFrame:
    """(stream, at, key): the runs of ``size`` tokens that occur more than once, and few that do not. tokens: an array of columns of ``streams``.

    The run of 8 tokens of the least hash in a window, the first of such, stands
    for it: equal windows have equal ones, at the same place of the window, so a
    window whose least run occurs once in all streams is left out before any
    window is dealt out by its key.
    """
    kind = streams.schema[stream].dataType.simpleString()
    rows = hashed(streams.withColumn("__t", tokens), "__t")
    anchors = cut(rows.select(stream, "ha").mapInArrow(_anchors(size, [stream, "at", "gram"]), f"`{stream}` {kind}, at int, gram bigint"))
    often = anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    marks = anchors.join(often, "gram").groupBy(F.col(stream).alias("__s")).agg(F.collect_list("at").alias("__marks"))
    rows = hashed(streams.join(marks, F.col(stream) == F.col("__s")).withColumn("__t", tokens), "__t").select(stream, "ha", "hb", "__marks")
    found = rows.mapInArrow(_marked(size, [stream, "at", "k1", "k2"]), f"`{stream}` {kind}, at int, k1 bigint, k2 bigint")
    return found.select(stream, "at", F.struct("k1", "k2").alias("key"))
