"""Vector code compression: product quantisation in integers with partial-distance search.

Vectors become integers and are cut into parts; each part has a codebook whose
entries are refined in rounds. The search for the nearest entry takes the
dimensions of a part in descending variance of its codebook and accumulates
squared differences. The entry that leads after the first dimensions is completed
at once, which gives each row a complete distance; entries whose accumulated
distance strictly exceeds it are dropped by masks, those that lead among the rest
are completed in turn, and only what is left after the last dimension is compared.
Ties stay alive, so the lowest index wins them.

Codebooks are models of a fixed size (entries by dimensions) and travel with each
round; vectors never leave their partitions. A task gives one sum and count for
each entry it used.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

#: Rows that are searched at once; bounds the matrix of accumulated distances.
AT_ONCE = 512
#: Dimensions added between two uses of the masks.
STEP = 8
#: Share of entries that are alive above which the masks are not yet applied.
MANY = 0.05
#: Above this many labels their errors are joined by a shuffle instead of a broadcast.
BROADCAST_LABELS = 100_000
#: How many ways the rows of one label are dealt out in that shuffle.
SALTS = 32

Codebooks = list[np.ndarray]


def limit(dim: int) -> int:
    """Largest magnitude of a component at which the squared distance of two vectors still is a long."""
    return math.isqrt((1 << 62) // max(dim, 1)) // 2


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); components beyond ``limit`` are set to it."""
    most = float(limit(vectors.shape[1]))
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -most, most).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of ``book`` for each row of ``x``, both integers; of equal ones the lowest entry."""
    rows, dim = len(x), book.shape[1]
    # The largest difference there can be tells whether floating point holds every sum exactly; it adds several dimensions at once.
    width = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))) * 2
    kind = np.float64 if width * width * dim < 1 << 53 else np.int64
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    x, book = np.ascontiguousarray(x[:, order].T, kind), np.ascontiguousarray(book[:, order].T, kind)

    def rest(r: np.ndarray, e: np.ndarray, start: int, stop: int) -> np.ndarray:
        out = np.zeros(len(r), kind)
        for j in range(start, stop):
            d = x[j][r] - book[j][e]
            d *= d
            out += d
        return out

    def added(start: int, stop: int) -> np.ndarray:
        a, b = x[start:stop], book[start:stop]
        return (a * a).sum(axis=0)[:, None] - 2 * (a.T @ b) + (b * b).sum(axis=0)[None, :]

    stop = min(STEP, dim)
    acc = added(0, stop)
    every = np.arange(rows)
    lead = acc.argmin(axis=1)
    best = acc[every, lead] + rest(every, lead, stop, dim)
    # While most entries are alive, adding to all of them is cheaper than picking them out.
    while stop < dim and np.count_nonzero(acc <= best[:, None]) > MANY * acc.size:
        start, stop = stop, min(stop + STEP, dim)
        acc += added(start, stop)
    r, e = np.nonzero(acc <= best[:, None])
    acc = acc[r, e]
    while stop < dim:
        start, stop = stop, min(stop + STEP, dim)
        acc = acc + rest(r, e, start, stop)
        alive = acc <= best[r]
        r, e, acc = r[alive], e[alive], acc[alive]
        if stop < dim:
            at = np.flatnonzero(acc == _least(r, acc))
            np.minimum.at(best, r[at], acc[at] + rest(r[at], e[at], stop, dim))
            alive = acc <= best[r]
            r, e, acc = r[alive], e[alive], acc[alive]
    # Complete now; entries ascend within a row.
    hit = acc == _least(r, acc)
    r, e, acc = r[hit], e[hit], acc[hit]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    return e[first], acc[first].astype(np.int64)


def _least(r: np.ndarray, acc: np.ndarray) -> np.ndarray:
    """For each place the least of its row; every row has a place, since the entry of its best distance stays."""
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    return np.repeat(np.minimum.reduceat(acc, first), np.diff(np.r_[first, len(r)]))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows that are kept, their integer vectors) in blocks of ``AT_ONCE``; the vector is the last column."""
    for batch in batches:
        for a in range(0, batch.num_rows, AT_ONCE):
            rows = batch.slice(a, AT_ONCE)
            vectors = rows.column(rows.num_columns - 1)
            rows = rows.filter(pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False))
            if not rows.num_rows:
                continue
            flat = rows.column(rows.num_columns - 1).flatten()
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # null components come out as NaN
            good = np.isfinite(values).all(axis=1)
            if good.any():
                yield rows.filter(pa.array(good)), integers(values[good], scale)


def _summer(books: Codebooks, dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        size = dim // len(books)
        for _, x in _blocks(batches, dim, scale):
            for p, book in enumerate(books):
                part = x[:, p * size : (p + 1) * size]
                entry, _ = nearest(part, book)
                order = np.argsort(entry, kind="stable")
                used, first = np.unique(entry[order], return_index=True)
                sums[p][used] += np.add.reduceat(part[order], first, axis=0)
                counts[p] += np.bincount(entry, minlength=len(book))
        for p in range(len(books)):
            used = np.flatnonzero(counts[p])
            at = np.arange(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used) * size, p, np.int32)), pa.array(np.repeat(used, size).astype(np.int32)), pa.array(np.tile(at, len(used)).astype(np.int32)), pa.array(sums[p][used].ravel()), pa.array(np.repeat(counts[p][used], size))],
                ["part", "entry", "at", "total", "n"],
            )

    return run


def _coder(books: Codebooks, dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = dim // len(books)
        for rows, x in _blocks(batches, dim, scale):
            codes = np.empty((len(x), len(books)), np.uint8)
            error = np.zeros(len(x), np.int64)
            for p, book in enumerate(books):
                codes[:, p], e = nearest(x[:, p * size : (p + 1) * size], book)
                error += e
            code = [c.hex() for c in map(bytes, codes)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(code), pa.array(error)], [*rows.schema.names[:-1], "code", "error"])

    return run


def _valid(vector: Column) -> Column:
    """A vector that is there and holds finite numbers only."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks:
    """One integer codebook (entries by dimensions) for each part; an empty list where no vector is kept.

    Codebooks start as the parts of the vectors of the least ids; fewer vectors
    give fewer entries. Each round takes all vectors. Sums of a task come as one
    row for each dimension of a used entry; the driver receives the new
    codebooks, whose size does not depend on the data.
    """
    if entries > 256:
        raise ValueError("a code byte tells 256 entries apart")
    vector = F.col(f"`{vector_col}`")
    wide = vectors.select(F.col(f"`{id_col}`").alias("id"), vector.cast("array<double>").alias("v"))
    first = wide.where(_valid(F.col("v")) & (F.size("v") > 0)).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return []
    dim = len(first[0].v)
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    start = integers(np.array([r.v for r in first if len(r.v) == dim], np.float64), scale)
    books = [np.ascontiguousarray(x) for x in np.split(start, parts, axis=1)]
    source = vectors.select(vector.alias("v")).where("v is not null")
    for _ in range(rounds):
        sums = source.mapInArrow(_summer(books, dim, scale), "part int, entry int, at int, total bigint, n bigint")
        mean = sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        for r in mean.collect():
            books[r.part][r.entry, r["at"]] = r.total // r.n
    return books


def digest(books: Codebooks) -> str:
    """sha256 of all components in order of part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 1024) -> DataFrame:
    """(vec_id, label, code, error) of the vectors that are kept: two hex digits a part, and the squared distance to what the code stands for."""
    src = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:2]) + ", code string, error bigint"
    dim = sum(b.shape[1] for b in books)
    return src.where("v is not null").mapInArrow(_coder(books, dim, scale), schema) if books else src.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) for every vector that is null neither as a whole nor in a component and is finite.

    Vectors of another length than the one of the least id are left out like
    invalid ones. Components whose integer exceeds ``limit`` are set to it.
    Rows that repeat are coded each and pull on the codebooks each; of rows that
    share an id the lesser vector comes first; null ids come last. The null
    label is a label. Other columns are ignored; a table without a valid vector
    gives an empty result. The table is read once for the start, once for each
    round and once for the codes, so it should be one that rereads alike.
    """
    books = train(vectors, id_col, vector_col, **options)
    # Codes are needed for their label's sum and for themselves.
    coded = stored(encode(vectors, books, id_col, vector_col, label_col, options.get("scale", 1024)))
    sums = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("l"))
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        out = coded.join(F.broadcast(sums), same)
    else:
        # One label may hold much of the table.
        dealt = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
        copies = sums.withColumn("s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        out = dealt.join(copies, same & (F.col("salt") == F.col("s")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same codes in DuckDB; rounds are written out, every distance is complete."""
    out = [
        """WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024.0::DOUBLE * x) AS BIGINT)) AS v FROM {vectors}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """p AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS x FROM v, range(4) AS r(part))""",
        """b0 AS MATERIALIZED (SELECT part, CAST(rank() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS INT) AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256))""",
    ]
    for k in range(5):
        out.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT vec_id, p.part, x, entry, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN b{k} ON b{k}.part = p.part) GROUP BY vec_id, part)""")
        if k < 4:
            out.append(f"""m{k} AS (SELECT part, entry, list(CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY pos) AS c FROM (
  SELECT part, entry, pos, sum(x[pos]) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS pos) GROUP BY ALL) GROUP BY part, entry)""")
            out.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, entry))")
    out.append("h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b4)")
    out.append("e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id)")
    return ",\n".join(out) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), h"


SQL = _sql()
