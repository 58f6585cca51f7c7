"""Hashed word features and linear models in numpy, shared by the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def word_units(offsets: np.ndarray, data: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """(first, word hashes, and one after another per length the hashes of the words' first bytes; shorter words repeat the word's hash)."""
    start, end, first = tv.runs(offsets, tv.WORD_BYTES[data])
    return first, tv.hash_ranges(data, start, end), (tv.hash_ranges(data, start, np.minimum(start + k, end)) ^ tv.U64(k) for k in lengths)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1 and so on, so that no name clashes or needs quotes."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def map_texts(df: DataFrame, text: str, schema: str, row: object) -> DataFrame:
    """Apply ``row(rows, offsets, data) -> RecordBatch`` to pieces of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, data in tv.pieces(batches, text):
            yield row(rows, offsets, data)

    return df.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, limit: int, *key: Column) -> DataFrame:
    """At most ``limit`` rows, those of the least hash, so reruns agree; ties by the key itself."""
    return df.orderBy(F.xxhash64(*key), *key).limit(limit)
