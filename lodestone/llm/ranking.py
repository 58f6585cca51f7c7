"""Quality classifier by Bradley-Terry pairwise ranking.

Every text is measured once (shares of symbols, capitals, bars, repeated words
and lines, word lengths and the like, each also as a few steps so that a linear
score can turn). Preference pairs of a better and a worse labelled document teach
weights by logistic loss on the difference of their features: the document
scores of a Bradley-Terry model. The cut is the score quantile that leaves the
labelled share of good documents above it.

Nothing is sampled. The measures of all labelled documents are packed into blocks
that executors sweep: steps are exact quantiles, the loss is that of all pairs of
a good and a bad document, and the cut is taken among the scores of all of them.
What one document adds over all its pairs depends on its score alone, so the sum
over pairs is a convolution of the two classes' scores, which are laid on a fine
grid by cubic weights; Newton's method finds the least loss in a few sweeps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .hashed import map_texts, numbered, remainder, sigmoid
from .line_crf import measure
from .store import new_path, removed

#: Labelled rows of a block, about, and rows that are expanded at once.
BLOCK = 1 << 16
SLICE = 1 << 12
STEPS = 6
RAW = 17
#: Nodes of the score grid per unit, and its cells in a bin of the second derivative.
NODES = 32
BIN = 8
MAX_BINS = 128
#: Sums over blocks are whole multiples of 1 / UNIT, so that their order does not matter.
UNIT = 2.0**40

#: ``sweep(work, add)`` applies ``work(good, raw)`` to every block: the list of results in block order, or their sum.
Sweep = Callable[..., object]


def raw_features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """(texts, RAW) measures of whole texts; an empty text is all zero but for its length."""
    got = measure(offsets, data)
    x, first = got["x"], got["first"]
    n, w = len(offsets) - 1, np.maximum(got["n_words"], 1).astype(float)
    lines = np.diff(first)
    lw = got["line_words"].astype(float)
    owner = np.repeat(np.arange(n), lines)
    per = lambda v: np.bincount(owner, weights=v * lw, minlength=n) / w  # noqa: E731  word-weighted means over lines
    ws, we, wfirst, h = tv.text_words(offsets, data, tv.VISIBLE_BYTES, tv.FOLDED)
    who = np.repeat(np.arange(n), np.diff(wfirst))
    key = np.unique(tv.mix(h + who.astype(tv.U64) * tv.U64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(who[key], minlength=n)
    length = (we - ws).astype(float)
    mean = np.bincount(who, weights=length, minlength=n) / w
    var = np.bincount(who, weights=length**2, minlength=n) / w - mean**2
    long = np.bincount(who, weights=length > 20, minlength=n) / w
    bytes_ = np.diff(offsets)
    high = np.concatenate([[0], np.cumsum(data >= 128, dtype=np.int64)])
    foreign = (high[offsets[1:]] - high[offsets[:-1]]) / np.maximum(bytes_, 1)
    return np.column_stack([
        np.log1p(got["n_words"]), got["n_symbols"] / w, got["n_dup_lines"] / np.maximum(lines, 1), got["n_repeat_words"] / w,
        per(x[:, 2]), per(x[:, 3]), per(x[:, 4]), per(x[:, 5]), per(x[:, 13]), per(x[:, 7]), per(x[:, 9]),
        distinct / w, mean / 10, np.sqrt(np.maximum(var, 0)) / 10, long, foreign, w / np.maximum(lines, 1) / 100,
    ])


@dataclass
class QualityModel:
    """Steps, weights and scale of a fitted ranking; ``cut`` is the score that becomes ``threshold``."""

    edges: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float
    threshold: float

    def expand(self, raw: np.ndarray) -> np.ndarray:
        steps = (raw[:, :, None] > self.edges[None]).reshape(len(raw), -1).astype(float)
        linear = np.clip((raw - self.mean) / self.spread, -4, 4)
        return np.hstack([linear, steps])

    def rank(self, raw: np.ndarray) -> np.ndarray:
        return self.expand(raw) @ self.weights

    def score(self, raw: np.ndarray) -> np.ndarray:
        shift = np.log(self.threshold / (1 - self.threshold))
        return sigmoid((self.rank(raw) - self.cut) * self.scale + shift)


def _ordered(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the floats."""
    u = (v + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def order_statistics(sweep: Sweep, columns: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], ranks: np.ndarray, bits: int = 8) -> np.ndarray:
    """The values that hold the given ranks (from 0) of each column over all blocks: (columns, ranks). Exact, by one digit of ``bits`` a sweep."""
    left, found = ranks.astype(np.int64), np.zeros(ranks.shape, np.uint64)
    for shift in range(64 - bits, -1, -bits):
        known = [np.unique(f) for f in found]

        def work(good: np.ndarray, raw: np.ndarray, shift: int = shift, known: list = known) -> np.ndarray:
            out = []
            for values, tops in zip(columns(good, raw), known, strict=True):
                key = _ordered(values) >> np.uint64(shift)
                top, digit = key >> np.uint64(bits), (key & np.uint64((1 << bits) - 1)).astype(np.int64)
                out += [np.bincount(digit[top == t], minlength=1 << bits) for t in tops]
            return np.concatenate(out).astype(float)

        counts = sweep(work, add=True).reshape(-1, 1 << bits).astype(np.int64)
        base = 0
        for c, tops in enumerate(known):
            upto = np.cumsum(counts[base : base + len(tops)], axis=1)
            base += len(tops)
            for j, t in enumerate(np.searchsorted(tops, found[c])):
                d = min(int(np.searchsorted(upto[t], left[c, j], "right")), (1 << bits) - 1)
                left[c, j] -= upto[t][d - 1] if d else 0
                found[c, j] = (found[c, j] << np.uint64(bits)) | np.uint64(d)
    sign = np.uint64(1 << 63)
    return np.where(found & sign, found ^ sign, ~found).view(float)


def _quantiles(sweep: Sweep, columns: Callable, sizes: list[int], qs: np.ndarray, bits: int = 8) -> np.ndarray:
    """Quantiles of columns of the given sizes, linear between ranks."""
    at = np.outer(np.asarray(sizes) - 1, qs)
    low = np.floor(at).astype(np.int64)
    got = order_statistics(sweep, columns, np.hstack([low, np.minimum(low + 1, np.asarray(sizes)[:, None] - 1)]), bits)
    a, b = got[:, : len(qs)], got[:, len(qs) :]
    return a + (b - a) * (at - low)


def _moments(good: np.ndarray, raw: np.ndarray) -> np.ndarray:
    mean = raw.mean(axis=0)
    return np.concatenate([[len(raw), good.sum()], mean, ((raw - mean) ** 2).sum(axis=0)])


def _weights4(f: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cubic weights of the nodes -1, 0, 1, 2 for a place ``f`` between nodes 0 and 1."""
    return -f * (f - 1) * (f - 2) / 6, (f + 1) * (f - 1) * (f - 2) / 2, -(f + 1) * f * (f - 2) / 2, (f + 1) * f * (f - 1) / 6


def _slices(model: QualityModel, good: np.ndarray, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(0, len(raw), SLICE):
        x = model.expand(raw[i : i + SLICE])
        yield good[i : i + SLICE], x, x @ model.weights


def _scores(model: QualityModel, raw: np.ndarray) -> np.ndarray:
    return np.concatenate([s for _, _, s in _slices(model, np.zeros(len(raw), bool), raw)])


def _pair_sums(density: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray], step: float) -> np.ndarray:
    """Per node k the sum over nodes l of ``density[l] * kernel((l - k) * step)``."""
    n = len(density)
    size = 1 << (3 * n).bit_length()
    k = kernel(np.arange(n - 1, -n, -1) * step)
    return np.fft.irfft(np.fft.rfft(density, size) * np.fft.rfft(k, size), size)[n - 1 : 2 * n - 1]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class _AllPairs:
    """Loss of all pairs of a good and a bad row, and its derivatives, at the weights of ``model``."""

    def __init__(self, sweep: Sweep, model: QualityModel, n_good: int, n_bad: int, decay: float):
        self.sweep, self.model, self.decay = sweep, model, decay
        self.share = np.array([1 / n_bad, 1 / n_good])
        w, share = model.weights, self.share
        reach = np.where(np.arange(len(w)) < RAW, 4, 1) * np.abs(w)
        lo = -int(np.ceil(reach.sum() * NODES)) - 2
        n = 1 - 2 * lo + 4

        def work(good: np.ndarray, raw: np.ndarray) -> np.ndarray:
            out = np.zeros((2, 2, n))
            for y, _, s in _slices(model, good, raw):
                at = s * NODES
                cell = np.floor(at).astype(np.int64)
                for c in (0, 1):
                    k, f = cell[y == c] - lo, (at - cell)[y == c]
                    out[c, 1] += np.bincount(k, minlength=n)
                    for j, part in enumerate(_weights4(f)):
                        out[c, 0] += np.bincount(k + j - 1, part, minlength=n)
            return np.rint(out * share[:, None, None] * UNIT).ravel()

        got = sweep(work, add=True).reshape(2, 2, n) / UNIT
        used = np.flatnonzero(got[:, 1].any(axis=0))
        a, b = used[0] - 1, used[-1] + 3  # every node that the cubic weights of a cell in use name
        self.lo = lo + a
        (bad, self.bad_cells), (good, self.good_cells) = got[:, :, a:b]
        step = 1 / NODES
        # What a good row at a node gains from all bad ones, and what a bad row loses to all good ones.
        self.pull = _pair_sums(bad, sigmoid, step), _pair_sums(good, lambda z: sigmoid(-z), step)
        self.loss = float(good @ _pair_sums(bad, _softplus, step) + decay / 2 * w @ w)

    def derivatives(self) -> tuple[np.ndarray, np.ndarray]:
        """Gradient, and second derivatives with scores taken at the middles of bins (both are of a convex function)."""
        model, lo, share = self.model, self.lo, self.share
        up, down = self.pull
        d, cells = len(model.weights), BIN
        while -(-len(up) // cells) > MAX_BINS:
            cells *= 2
        bins = -(-len(up) // cells)
        bad, good = (np.bincount(np.arange(len(h)) // cells, h, minlength=bins) for h in (self.bad_cells, self.good_cells))
        p = sigmoid(np.subtract.outer(np.arange(bins), np.arange(bins)) * (cells / NODES))
        near = p * (1 - p)
        curve = near @ good, near @ bad
        signed = down, -up

        def work(y: np.ndarray, raw: np.ndarray) -> np.ndarray:
            g, outer, sums = np.zeros(d), np.zeros((d, d)), np.zeros((2, bins, d))
            for yes, x, s in _slices(model, y, raw):
                at = s * NODES
                cell = np.floor(at).astype(np.int64)
                k, parts = cell - lo, _weights4(at - cell)
                for c in (0, 1):
                    m = yes == c
                    if not m.any():
                        continue
                    xc, kc = x[m] * share[c], k[m]
                    g += sum(signed[c][kc + j - 1] * part[m] for j, part in enumerate(parts)) @ xc
                    b = kc // cells
                    outer += x[m].T @ (xc * curve[c][b][:, None])
                    order = np.argsort(b, kind="stable")
                    held, first = np.unique(b[order], return_index=True)
                    sums[c][held] += np.add.reduceat(xc[order], first, axis=0)
            return np.rint(np.concatenate([g, outer.ravel(), sums.ravel()]) * UNIT)

        got = self.sweep(work, add=True) / UNIT
        g, outer, (xb, xg) = got[:d], got[d : d + d * d].reshape(d, d), got[d + d * d :].reshape(2, bins, d)
        cross = xg.T @ near @ xb
        return g + self.decay * model.weights, outer - cross - cross.T + self.decay * np.eye(d)


def _least_loss(sweep: Sweep, model: QualityModel, n_good: int, n_bad: int, decay: float, tolerance: float = 1e-8) -> np.ndarray:
    """Weights of the least loss over all pairs; Newton steps, halved while the loss does not fall."""
    at = lambda w: _AllPairs(sweep, replace(model, weights=w), n_good, n_bad, decay)
    here = at(model.weights)
    while True:
        g, h = here.derivatives()
        step = np.linalg.solve(h, g)
        if g @ step < tolerance:
            return here.model.weights
        step *= min(1.0, 10 / np.linalg.norm(step))
        there = at(here.model.weights - step)
        while not there.loss < here.loss:
            step /= 2
            if np.abs(step).max() < 1e-6:
                return here.model.weights
            there = at(here.model.weights - step)
        here = there


def fit_ranking(sweep: Sweep, threshold: float = 0.3, decay: float = 2e-4) -> QualityModel:
    """Fit on all measured texts and 0/1 labels that ``sweep`` goes over. With labels of one class only, every score is the constant of that class."""
    n, n_good, mean, square = 0, 0, np.zeros(RAW), np.zeros(RAW)
    for part in sweep(_moments):
        k, m, s = int(part[0]), part[2 : 2 + RAW], part[2 + RAW :]
        square += s + (m - mean) ** 2 * (n * k / (n + k))
        mean += (m - mean) * (k / (n + k))
        n, n_good = n + k, n_good + int(part[1])
    if n == 0:
        return QualityModel(np.zeros((RAW, STEPS)), mean, np.ones(RAW), np.zeros(RAW * (1 + STEPS)), -4.0, 1.0, threshold)
    # Steps lie where the classes differ: quantiles of each class alone.
    sizes = [(c, size) for c, size in ((True, n_good), (False, n - n_good)) if size]
    columns = lambda good, raw: [raw[good == c][:, k] for c, _ in sizes for k in range(RAW)]
    edges = _quantiles(sweep, columns, [size for _, size in sizes for _ in range(RAW)], np.linspace(0.02, 0.98, STEPS))
    edges = np.hstack(edges.reshape(len(sizes), RAW, STEPS))
    spread = np.sqrt(square / n)
    model = QualityModel(edges, mean, np.where(spread > 1e-9, spread, 1.0), np.zeros(RAW + edges.size), 0.0, 1.0, threshold)
    if len(sizes) == 1:
        model.cut = -4.0 if n_good else 4.0
        return model
    model.weights = _least_loss(sweep, model, n_good, n - n_good, decay)
    model.cut, model.scale = _cut(sweep, model, n, (n - n_good) / n)
    return model


def _cut(sweep: Sweep, model: QualityModel, n: int, share: float) -> tuple[float, float]:
    """The middle of the widest gap near the quantile ``share`` of all scores, and the scale that their spread gives."""
    scores = lambda good, raw: [_scores(model, raw)]
    low, high = _quantiles(sweep, scores, [n], np.array([0.02, 0.9]), 16)[0]
    scale = 8 / max(high - low, 1e-6)
    k = share * n
    lo, hi = max(int(k - 0.01 * n) - 1, 0), min(int(k + 0.01 * n) + 2, n - 1)
    if hi <= lo:
        lo = hi = min(int(k), n - 1)
    a, b = order_statistics(sweep, scores, np.array([[lo, hi]]), 16)[0]

    def between(good: np.ndarray, raw: np.ndarray) -> np.ndarray:
        s = _scores(model, raw)
        return np.unique(s[(s >= a) & (s <= b)])

    s = np.unique(np.concatenate(sweep(between)))
    if len(s) < 2:
        return float(a), float(scale)
    at = int(np.argmax(np.diff(s)))
    return float((s[at] + s[at + 1]) / 2), float(scale)


def _measured(rows: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    raw = raw_features(offsets, data)
    lists = pa.ListArray.from_arrays(np.arange(0, raw.size + 1, RAW, dtype=np.int32), pa.array(raw.ravel()))
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), lists], ["doc_id", "h", "raw"])


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, a hash of the text, and its RAW measures. A null text is measured like an empty one."""
    text = F.col(f"`{text_col}`")
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return map_texts(src, "text", f"doc_id {src.schema['doc_id'].dataType.simpleString()}, h bigint, raw array<double>", _measured)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, RAW)


def _packed(rows: pa.Table) -> pa.Table:
    """The rows of a block as one, in an order that does not depend on how they came."""
    y, raw = rows.column("y").to_numpy() == 1, _matrix(rows.column("raw"))
    order = np.lexsort((*raw.T, y))
    return pa.table({"block": rows.column("block")[:1], "good": [y[order].tobytes()], "raw": [raw[order].tobytes()]})


def _sweeper(blocks: DataFrame) -> Sweep:
    def sweep(work: Callable[[np.ndarray, np.ndarray], np.ndarray], add: bool = False) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for rows in batches:
                for k, good, raw in zip(*rows.columns, strict=True):
                    got = work(np.frombuffer(good.as_py(), bool), np.frombuffer(raw.as_py(), float).reshape(-1, RAW))
                    if add:
                        total = got if total is None else total + got
                    else:
                        yield pa.record_batch({"block": [k.as_py()], "part": [got.tobytes()]}, schema)
            if total is not None:
                yield pa.record_batch({"block": [0], "part": [total.tobytes()]}, schema)

        schema = pa.schema([("block", pa.int64()), ("part", pa.binary())])
        rows = blocks.mapInArrow(run, "block bigint, part binary").collect()
        parts = [np.frombuffer(r.part, float) for r in sorted(rows, key=lambda r: r.block)]
        return sum(parts) if add else parts

    return sweep


def fit_measures(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3) -> QualityModel:
    """Fit on all labelled rows of ``measures`` outside the held-out fold.

    Null labels are left out, and the least label of an id counts. Of documents
    that repeat an id the one of the least text hash is used. Blocks of measures
    are written in the shared folder, swept by executors, and removed. An empty
    table or no label gives the constant score of a good text.
    """
    spark = measured.sparkSession
    one = labels.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(F.min(f"`{label}`").cast("int").alias("y"))
    one = one.where(remainder(F.col("doc_id"), folds) != held)
    n = max(-(-one.count() // BLOCK), 1)
    rows = measured.join(one.hint("merge"), "doc_id").groupBy("doc_id").agg(F.min(F.struct("h", "y", "raw")).alias("x"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("bigint").alias("block"), "x.y", "x.raw")
    path = new_path(spark, "ranking")
    try:
        rows.groupBy("block").applyInArrow(_packed, "block bigint, good binary, raw binary").write.parquet(path)
        return fit_ranking(_sweeper(spark.read.parquet(path)), threshold)
    finally:
        removed(spark, path)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3) -> QualityModel:
    """``fit_measures`` on the measures of ``docs``."""
    return fit_measures(measures(docs, id_col, text_col), labels, id_col, label, folds, held, threshold)


def score_measures(measured: DataFrame, model: QualityModel, folds: int = 5, held: int = 0) -> DataFrame:
    """Per row of ``measures``: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.score(_matrix(rows.column(1))))], ["doc_id", "score"])

    src = measured.select("doc_id", "raw")
    out = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= model.threshold).cast("int").alias("predicted"))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. A null text is scored like an empty one; rows that repeat are scored each; other columns are ignored."""
    return score_measures(measures(docs, id_col, text_col), model, folds, held)


def filter_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns as they were, whatever their names.

    A null text is scored like an empty one; rows that repeat are judged each; an
    empty table gives an empty result.
    """
    at = docs.columns.index(text_col)

    def run(rows: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        return rows.filter(pa.array(model.score(raw_features(offsets, data)) >= model.threshold))

    src = numbered(docs)
    return map_texts(src, f"c{at}", src.schema, run).toDF(*docs.columns)
