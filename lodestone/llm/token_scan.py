"""Token counts of flat, unindexed token files by a separator scan.

A token file is a stream of little-endian identifiers in which every document
ends with a separator; nothing says where documents begin. Ranges of the files,
each a block of a fixed number of tokens cut anywhere, are read on the executors,
so a file may have any size. Each block is searched for separators in one
vectorised comparison; running sums and a running maximum over the blocks of a
file then carry positions and the last separator before each block across the
boundaries, so a document may span any number of blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .store import new_path, removed, stored

#: Files of the public vocabulary, and the identifier that is free for the end of a document.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
END = 50256
#: How the public vocabulary splits text before merging (fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The public byte-level vocabulary as a tiktoken encoding; one per process."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("public", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _opened(uri: str):
    """(file system, path) of a file on storage that all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", uri))


def _writer(folder: str, path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(path), TaskContext.get()
        # An attempt that fails leaves a file that no row names.
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}.tokens"
        out, ordinal = None, 0
        try:
            for rows, _, _ in tv.pieces(batches, "text"):
                if out is None:
                    store, where = _opened(f"{folder}/{name}")
                    store.create_dir(where.rsplit("/", 1)[0])
                    out = store.open_output_stream(where)
                for text in rows.column(1):
                    t = enc.encode_ordinary(text.as_py() or "")
                    t.append(end)
                    out.write(np.array(t, "<u2").tobytes())
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), rows.column(0)], ["file", "ordinal", "id"])
                ordinal += n
        finally:
            if out is not None:
                out.close()

    return run


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{TOKENIZER_DIR}/{VOCABULARY}", end: int = END) -> DataFrame:
    """(file, ordinal, id): every partition of ``docs`` written as one flat file of 16-bit tokens in ``folder``.

    The table says which document is the how-manieth of which file; the files
    hold no index. Nothing is written until it is read, and it must be read once,
    so store it. A null text counts as empty: it has the separator only.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(_writer(folder, vocabulary, end), f"file string, ordinal bigint, id {src.schema['id'].dataType.simpleString()}")


def _range_reader(step: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                store, path = _opened(row.column(0)[0].as_py())
                with store.open_input_file(path) as f:
                    data = f.read_at(step, row.column(1)[0].as_py() * step)
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.array([data[: len(data) // width * width]], pa.binary())], ["file", "block", "tokens"])

    return run


def read_token_files(spark: SparkSession, path: str, width: int = 2, block: int = 1 << 20, names: DataFrame | None = None) -> DataFrame:
    """(file, block, tokens) of files of little-endian identifiers of ``width`` bytes. Spark lists the files; each range is read by itself. Bytes after the last whole identifier are left out. With ``names`` (file) only files of these names are read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where(F.col("length") >= width)
    if names is not None:
        # Before anything is read, so that no tokens are shuffled.
        files = files.join(names.select(F.col("file").alias("name")).distinct(), F.element_at(F.split("file", "/"), -1) == F.col("name"), "left_semi")
    step = block * width
    last = F.floor((F.col("length") - 1) / step).cast("bigint")
    ranges = files.select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    return ranges.repartition("file", "block").mapInArrow(_range_reader(step, width), "file string, block bigint, tokens binary")


def _searcher(end: int, width: int):
    dtype = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(t or b"", dtype) for t in batch.column(batch.schema.get_field_index("tokens")).to_pylist()]
            ends = [np.flatnonzero(t == end) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(t) for t in tokens], pa.int64()), pa.ListArray.from_arrays(np.append(0, np.cumsum([len(e) for e in ends])).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *ends])))],
                ["file", "block", "n", "ends"],
            )

    return run


def scan_blocks(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """(file, block, start, ends, n_tokens, first_ordinal): per block the documents that end in it.

    ``ends`` are positions of separators in the file and ``n_tokens`` the lengths
    of the documents before them, without the separator. A last document without
    separator is given in a row of its own with block null. Empty documents have
    length 0; a file without any token gives nothing.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    found = stored(blocks.select("file", "block", "tokens").mapInArrow(_searcher(end, width), f"file {kind}, block bigint, n bigint, ends array<bigint>"))
    # The scan moves a few numbers for each block, not its separators.
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    each = found.select("file", "block", "n", F.size("ends").alias("k"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    each = each.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0).cast("bigint"))).withColumn("first_ordinal", F.coalesce(F.sum("k").over(order), F.lit(0).cast("bigint")))
    each = each.withColumn("last", F.col("last") + F.col("base")).withColumn("carry", F.coalesce(F.max("last").over(order), F.lit(-1).cast("bigint")))
    rows = found.where(F.size("ends") > 0).select("file", "block", "ends").join(each.select("file", "block", "base", "first_ordinal", "carry"), ["file", "block"])
    rows = rows.select("file", "block", "first_ordinal", "carry", F.transform("ends", lambda e: e + F.col("base")).alias("ends"))
    lengths = F.zip_with("ends", F.concat(F.array("carry"), F.slice("ends", 1, F.size("ends") - 1)), lambda e, p: e - p - 1)
    whole = rows.select("file", "block", "first_ordinal", "ends", lengths.alias("n_tokens"))
    tail = each.groupBy("file").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.sum("k").cast("bigint").alias("first_ordinal"))
    tail = tail.withColumn("rest", F.col("n") - 1 - F.coalesce("last", F.lit(-1))).where("rest > 0")
    return whole.unionByName(tail.select("file", F.lit(None).cast("bigint").alias("block"), "first_ordinal", F.array("n").alias("ends"), F.array("rest").alias("n_tokens")))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 20, **options) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens): tokens of each row of ``docs``, counted from flat files.

    The files are written to the shared folder, read in ranges of ``block``
    tokens and removed once they are scanned. A null text counts as empty and has no token;
    rows that repeat are counted each; other columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    names = stored(write_token_files(docs, folder, id_col, text_col, **options))
    if names.isEmpty():
        return names.select(F.col("id").alias("doc_id"), "file", "ordinal", F.col("ordinal").alias("start"), F.col("ordinal").alias("n_tokens"))
    blocks = read_token_files(spark, folder, block=block, names=names).withColumn("file", F.element_at(F.split("file", "/"), -1))
    # The scan has read the files when it returns.
    scanned = scan_blocks(blocks)
    removed(spark, folder)
    counted = scanned.select("file", "first_ordinal", F.posexplode(F.arrays_zip("ends", "n_tokens")).alias("k", "d"))
    counted = counted.select("file", (F.col("first_ordinal") + F.col("k")).alias("ordinal"), (F.col("d.ends") - F.col("d.n_tokens")).alias("start"), F.col("d.n_tokens").alias("n_tokens"))
    return counted.join(names, ["file", "ordinal"]).select(F.col("id").alias("doc_id"), "file", "ordinal", "start", "n_tokens")
