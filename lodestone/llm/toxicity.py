"""Toxicity by weak supervision.

Voters: lexicons (a fixed list, and words and word beginnings mined from labelled
training rows) and patterns (density, shouting, repeated marks, length). Each votes
toxic (1), clean (0) or abstains (-1) on a text. The votes of all documents are
counted by pattern of votes; a generative label model is fitted to those counts
by expectation-maximisation without labels: a hidden label, each voter's
accuracies given it, and correlations as a maximum-weight tree of voters whose
votes depend on each other given the label. The model's posteriors are then the
labels from which a linear classifier over hashed words and word beginnings
learns. Scores come from that classifier.

Lexicons and classifier are fitted on one bounded sample of labelled rows. Its
texts stay on the executors: units are counted and chosen there, and the driver
gets the chosen units, one number for each of the 2**BITS slots, and of each text
a sketch and the chosen slots it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .hashed import bounded_sample, map_texts, remainder, sigmoid, word_units
from .store import cut, stored

#: Insults in plain words (fixed values).
LEXICON = ("idiot", "idiots", "moron", "morons", "stupid", "scum", "trash", "garbage", "loser", "losers", "pathetic", "worthless", "disgusting", "clown", "filthy", "vermin", "imbecile", "dumbass")
#: Labelled rows that a fit uses at most, half of them toxic if there are as many.
MAX_LABELLED = 6_000
#: Hashes of a text by which near copies are found; a text of fewer different words is compared whole.
SKETCH = 2_048
#: Slots that the classifier keeps.
KEEP = 4_096
#: Bytes of word beginnings; mined beginnings of each length are one voter.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
BITS = 20
VOTERS = ("fixed", "words", *(f"begin{k}" for k in BEGINNINGS), "dense", "shouting", "marks", "tiny", "none")


def _hash_words(words: tuple[str, ...]) -> np.ndarray:
    raw = [w.encode() for w in words]
    off = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    return np.sort(word_units(off, data, ())[1])


@dataclass
class Lexicons:
    """Sorted hashes per voter: the fixed list, mined words and mined beginnings by length."""

    fixed: np.ndarray
    mined: list[np.ndarray]

    def votes(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """(texts, voters) in {-1, 0, 1}."""
        n = len(offsets) - 1
        first, whole, begins = word_units(offsets, data, BEGINNINGS)
        count = np.diff(first)
        owner = np.repeat(np.arange(n), count)
        inside = lambda h, lex: np.bincount(owner[_member(h, lex)], minlength=n)
        hits = [inside(whole, self.fixed), inside(whole, self.mined[0]), *(inside(h, lex) for h, lex in zip(begins, self.mined[1:], strict=True))]
        out = np.full((n, len(VOTERS)), -1, np.int8)
        for k, h in enumerate(hits):
            out[:, k] = np.where((h >= 2) & (h > 0.002 * count) | (h == 1) & (count < 60), 1, np.where((h == 0) | (h < 0.001 * count), 0, -1))
        any_ = np.maximum.reduce(hits)
        density = any_ / np.maximum(count, 1)
        k = len(hits)
        out[:, k] = np.where(density > 0.008, 1, np.where(any_ == 0, 0, -1))
        upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90), dtype=np.int64)])
        marks = np.concatenate([[0], np.cumsum(data == 33, dtype=np.int64)])
        part = lambda t: t[offsets[1:]] - t[offsets[:-1]]
        size = np.maximum(np.diff(offsets), 1)
        out[:, k + 1] = np.where(part(upper) > 0.5 * size, 1, -1)
        out[:, k + 2] = np.where(part(marks) > 0.02 * size, 1, -1)
        out[:, k + 3] = np.where(count < 5, 0, -1)
        out[:, k + 4] = np.where(any_ == 0, 0, -1)
        return out


def _member(h: np.ndarray, lex: np.ndarray) -> np.ndarray:
    if not len(lex):
        return np.zeros(len(h), bool)
    return lex[np.minimum(np.searchsorted(lex, h), len(lex) - 1)] == h


def mined_units(counts: DataFrame, toxic: int, clean: int, least: int = 3, ratio: float = 40.0) -> DataFrame:
    """(kind, unit) of units (kind, unit, pos, neg) that occur in ``least`` toxic texts or more and at ``ratio`` times the rate of the clean texts."""
    p, q = max(toxic, 1), max(clean, 1)
    rate = (F.col("pos") / p) / ((F.col("neg") + 0.5) / q)
    return counts.where((F.col("pos") >= max(least, 0.004 * p)) & (rate >= ratio)).select("kind", "unit")


def near_copies(sets: list[np.ndarray], least: float = 0.8) -> np.ndarray:
    """Class of each set of different hashes: equal sets, and sets linked by pairs whose Jaccard similarity is ``least`` or more.

    Similar sets share one of their rarest members, so none is missed; every pair is compared whole.
    """
    keys: dict[bytes, int] = {}
    which = np.array([keys.setdefault(np.sort(s).tobytes(), len(keys)) for s in sets], int)
    if not keys:
        return which
    size = np.array([len(k) // 8 for k in keys])
    first = np.append(0, np.cumsum(size))
    _, at, count = np.unique(np.frombuffer(b"".join(keys), tv.U64), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    member = rank[at]
    member = member[np.lexsort((member, np.repeat(np.arange(len(size)), size)))]
    parent = list(range(len(size)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    here, holders = np.zeros(len(count), bool), {}
    for i in np.argsort(size, kind="stable").tolist():
        own = member[first[i] : first[i + 1]]
        rare = own[: len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1].tolist()
        here[own] = True
        for j in sorted({j for t in rare for j in holders.get(t, ()) if size[j] >= least * len(own) - 1e-9}):
            if root(i) != root(j):
                both = int(here[member[first[j] : first[j + 1]]].sum())
                if both >= least * (len(own) + size[j] - both) - 1e-9:
                    parent[root(i)] = root(j)
        here[own] = False
        for t in rare:
            holders.setdefault(t, []).append(i)
    return np.array([root(i) for i in range(len(size))])[which]


@dataclass
class LabelModel:
    """P(toxic | votes) from class-conditional tables over a tree of voters."""

    prior: float
    parent: list[int]
    table: np.ndarray  # (2, voters, parent vote, vote)

    def log_likelihood(self, votes: np.ndarray) -> np.ndarray:
        v = votes.astype(int) + 1
        out = np.tile(np.log([1 - self.prior, self.prior]), (len(v), 1))
        for j, p in enumerate(self.parent):
            given = v[:, p] if p >= 0 else np.zeros(len(v), int)
            out += np.log(self.table[:, j, given, v[:, j]]).T
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        ll = self.log_likelihood(votes)
        return sigmoid(ll[:, 1] - ll[:, 0])

    def accuracies(self, votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Per voter the expected share of its votes that agree with the hidden label."""
        p = self.posterior(votes)[:, None]
        right = np.where(votes == 1, p, np.where(votes == 0, 1 - p, 0))
        return (weight[:, None] * right).sum(axis=0) / np.maximum((weight[:, None] * (votes >= 0)).sum(axis=0), 1e-9)


def _tables(v: np.ndarray, w: np.ndarray, p: np.ndarray, parent: list[int], smooth: float) -> np.ndarray:
    table = np.zeros((2, len(parent), 3, 3))
    for y, wy in enumerate((w * (1 - p), w * p)):
        for j, q in enumerate(parent):
            given = v[:, q] if q >= 0 else np.zeros(len(v), int)
            np.add.at(table[y, j], (given, v[:, j]), wy)
    table += smooth
    return table / table.sum(axis=3, keepdims=True)


def _tree(v: np.ndarray, w: np.ndarray, p: np.ndarray, least: float) -> list[int]:
    """Parents of a maximum spanning forest over mutual information given the label; links under ``least`` are left out."""
    m = v.shape[1]
    info = np.zeros((m, m))
    total = w.sum()
    for wy in (w * (1 - p), w * p):
        for a in range(m):
            for b in range(a):
                t = np.zeros((3, 3))
                np.add.at(t, (v[:, a], v[:, b]), wy)
                t += 1e-9
                s = t.sum()
                info[a, b] += s / total * (t / s * np.log(t * s / (t.sum(1, keepdims=True) * t.sum(0, keepdims=True)))).sum()
    info += info.T
    parent, seen = [-1] * m, {0}
    while len(seen) < m:
        gain, a, b = max((info[a, b], -a, -b) for a in seen for b in range(m) if b not in seen)
        a, b = -a, -b
        seen.add(b)
        if gain >= least:
            parent[b] = a
    return parent


def fit_label_model(votes: np.ndarray, weight: np.ndarray, rounds: int = 60, least: float = 1e-4, smooth: float = 0.5) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and their counts: first independent voters, then the tree."""
    v, w = votes.astype(int) + 1, weight.astype(float)
    if not len(v):
        return LabelModel(0.5, [-1] * len(VOTERS), np.full((2, len(VOTERS), 3, 3), 1 / 3))
    ones, zeros = (votes == 1).sum(axis=1), (votes == 0).sum(axis=1)
    p = np.clip((ones + 0.05) / (ones + zeros * 0.5 + 0.5), 0.02, 0.98)
    parent = [-1] * v.shape[1]
    for step in range(rounds):
        if step == rounds // 2:
            parent = _tree(v, w, p, least)
        prior = float(np.clip((w * p).sum() / w.sum(), 1e-4, 0.5))
        model = LabelModel(prior, parent, _tables(v, w, p, parent, smooth))
        p = model.posterior(votes)
    return model


@dataclass
class ToxicModel:
    lexicons: Lexicons
    labels: LabelModel
    weights: np.ndarray
    bias: float
    threshold: float

    def score(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        first, whole, begins = word_units(offsets, data, BEGINNINGS)
        total = np.zeros(len(whole))
        for h in chain([whole], begins):
            total += self.weights[(h >> tv.U64(64 - BITS)).astype(np.int64)]
        count = np.diff(first)
        owner = np.repeat(np.arange(n), count)
        return sigmoid(np.bincount(owner, weights=total, minlength=n) / _scale(count) + self.bias)


def _scale(count: np.ndarray) -> np.ndarray:
    return np.sqrt(count + 4.0)


def _slots(first: np.ndarray, whole: np.ndarray, begins: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every unit of every word."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    slots = [(h >> tv.U64(64 - BITS)).astype(np.int32) for h in chain([whole], begins)]
    return np.tile(owner, len(slots)), np.concatenate(slots)


def choose_slots(slot: np.ndarray, pos: np.ndarray, neg: np.ndarray, p: float, q: float, keep: int = KEEP) -> np.ndarray:
    """Ascending slots that tell the classes apart best. pos, neg: occurrences weighted by the posteriors; p, q: texts of each class."""
    odds = np.log(((pos + 0.2) / (p + 1e-9)) / ((neg + 0.2) / (q + 1e-9)))
    gain = np.abs(odds) * np.maximum(pos / (p + 1e-9), neg / (q + 1e-9))
    # Only units of toxic texts carry weight: what clean texts share says nothing about a text.
    gain = np.where((odds > 1.5) & (pos + neg >= 2) & (pos >= max(2.5, 0.002 * p)), gain, 0)
    chosen = np.lexsort((slot, -gain))[:keep]
    return np.sort(slot[chosen[gain[chosen] > 0]])


def fit_linear(owner: np.ndarray, at: np.ndarray, times: np.ndarray, count: np.ndarray, y: np.ndarray, width: int, steps: int = 300, rate: float = 0.3, decay: float = 1e-4, threshold: float = 0.7) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels: weights of ``width`` features and a bias. owner, at, times: text, feature and occurrences."""
    w, b = np.zeros(width), -3.0
    if not width or not len(y):
        return w, b
    val = times / _scale(count)[owner]
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    # Both classes weigh the same.
    each = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1))
    for step in range(1, steps + 1):
        z = np.bincount(owner, weights=w[at] * val, minlength=len(y)) + b
        e = (sigmoid(z) - y) * each
        g = np.bincount(at, weights=e[owner] * val, minlength=width) + decay * w
        gb = e.sum()
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        mb += 0.1 * (gb - mb)
        vb += 0.01 * (gb * gb - vb)
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        np.maximum(w, 0, out=w)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    # The threshold lies in the gap between the classes, nearer to the clean one, whose scores vary less on new texts.
    z = np.bincount(owner, weights=w[at] * val, minlength=len(y)) + b
    if (y > 0.5).any() and (y <= 0.5).any():
        low, high = np.quantile(z[y <= 0.5], 0.998), np.quantile(z[y > 0.5], 0.05)
        if high > low:
            b += np.log(threshold / (1 - threshold)) - (low + 0.4 * (high - low))
    return w, float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, folds: int, held: int, limit: int) -> DataFrame:
    """(n, y, text) of at most ``limit`` labelled documents outside the held-out fold, numbered, as a table.

    Toxic rows are rare: half of the sample is theirs if there are as many. Null
    labels are left out, of repeated label rows the greatest counts, of documents
    that repeat an id the one of the least text hash.
    """
    one = labels.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.max(f"`{label}`").cast("int").alias("y"))
    one = one.where(remainder(F.col("_id"), folds) != held)
    one = bounded_sample(one.where("y = 1"), limit // 2, F.col("_id")).union(bounded_sample(one.where("y <> 1"), limit // 2, F.col("_id")))
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"))
    src = src.join(F.broadcast(one), "_id").groupBy("_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    return stored(src.select(F.row_number().over(Window.orderBy("_id")).alias("n"), "y", F.col("x.text").alias("text")))


def _representatives(sample: DataFrame) -> DataFrame:
    """(n, toxic) of one text of each class of near copies of a label."""

    def sketch(rows: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        first, whole, _ = word_units(offsets, data, ())
        least = [np.unique(whole[a:b])[:SKETCH].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(least, pa.binary())], ["n", "y", "least"])

    got = map_texts(sample, "text", "n int, y int, least binary", sketch).toArrow().sort_by("n")
    n, toxic = got.column("n").to_numpy(), got.column("y").to_numpy() == 1
    least = [np.frombuffer(x, tv.U64) for x in got.column("least").to_pylist()]
    out = []
    for y in (True, False):
        k = np.flatnonzero(toxic == y)
        group = near_copies([least[i] for i in k])
        out += [(int(n[k[i]]), y) for i in np.sort(np.unique(group, return_index=True)[1])]
    return sample.sparkSession.createDataFrame(out, "n int, toxic boolean")


def mine(sample: DataFrame) -> Lexicons:
    """Lexicons of the units of a labelled sample; near copies of one label count once."""

    def units(rows: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        first, whole, begins = word_units(offsets, data, BEGINNINGS)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        toxic = rows.column(0).to_numpy(zero_copy_only=False)[owner] if len(owner) else np.zeros(0, bool)
        kind, unit, pos, neg = [], [], [], []
        for k, h in enumerate(chain([whole], begins)):
            once = np.unique(tv.mix(h + tv.mix(owner.astype(tv.U64) + tv.U64(1))), return_index=True)[1]
            names, inv = np.unique(h[once], return_inverse=True)
            kind.append(np.full(len(names), k, np.int32))
            unit.append(names.view(np.int64))
            pos.append(np.bincount(inv, weights=toxic[once], minlength=len(names)).astype(np.int64))
            neg.append(np.bincount(inv, weights=~toxic[once], minlength=len(names)).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (kind, unit, pos, neg)], ["kind", "unit", "pos", "neg"])

    texts = cut(_representatives(sample))
    sizes = texts.agg(F.count_if("toxic").alias("p"), F.count_if(~F.col("toxic")).alias("q")).first()
    counts = map_texts(sample.join(F.broadcast(texts), "n").select("toxic", "text"), "text", "kind int, unit bigint, pos bigint, neg bigint", units).groupBy("kind", "unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    got = mined_units(counts, sizes.p, sizes.q).toArrow()
    kind, unit = got.column("kind").to_numpy(), got.column("unit").to_numpy().view(np.uint64)
    return Lexicons(_hash_words(LEXICON), [np.sort(unit[kind == k]) for k in range(1 + len(BEGINNINGS))])


def vote_counts(texts: DataFrame, lexicons: Lexicons) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of votes over all ``texts`` and how many texts have each."""
    code = 3 ** np.arange(len(VOTERS), dtype=np.int64)

    def vote(rows: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((lexicons.votes(offsets, data).astype(np.int64) + 1) @ code)], ["votes"])

    counted = map_texts(texts, "text", "votes bigint", vote).groupBy("votes").count().toArrow().sort_by("votes")
    return (counted.column("votes").to_numpy()[:, None] // code % 3 - 1).astype(np.int8), counted.column("count").to_numpy()


def learn(sample: DataFrame, lexicons: Lexicons, labels: LabelModel, threshold: float) -> tuple[np.ndarray, float]:
    """Weights of all slots and a bias, learned from the posteriors of a sample."""
    unit = 1 << 20  # posteriors are summed as integers, so the order of the sums does not matter

    def units(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, slot, occurrences, posterior and words per text)."""
        first, whole, begins = word_units(offsets, data, BEGINNINGS)
        owner, slot = _slots(first, whole, begins)
        pair, times = np.unique(owner * np.int64(1 << BITS) + slot, return_counts=True)
        p = np.rint(labels.posterior(lexicons.votes(offsets, data)) * unit).astype(np.int64)
        return pair >> BITS, pair & ((1 << BITS) - 1), times, p, np.diff(first)

    def weigh(rows: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        owner, slot, _, p, _ = units(offsets, data)
        names, inv = np.unique(np.append(slot, -1), return_inverse=True)
        sums = [np.bincount(inv, weights=np.append(w[owner], w.sum()), minlength=len(names)).astype(np.int64) for w in (p, unit - p)]
        return pa.RecordBatch.from_arrays([pa.array(names), *map(pa.array, sums)], ["slot", "pos", "neg"])

    # The row of slot -1 has the texts themselves.
    summed = map_texts(sample.select("text"), "text", "slot bigint, pos bigint, neg bigint", weigh).groupBy("slot").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow().sort_by("slot")
    slot, pos, neg = (summed.column(k).to_numpy() for k in ("slot", "pos", "neg"))
    weights = np.zeros(1 << BITS, np.float32)
    if not len(slot):
        return weights, -3.0
    chosen = choose_slots(slot[1:], pos[1:] / unit, neg[1:] / unit, pos[0] / unit, neg[0] / unit)

    def kept(rows: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        owner, slot, times, p, n = units(offsets, data)
        ok = np.isin(slot, chosen, assume_unique=False)
        owner, at, times = owner[ok], np.searchsorted(chosen, slot[ok]).astype(np.int32), times[ok].astype(np.int32)
        cuts = np.searchsorted(owner, np.arange(len(n) + 1))
        parts = [pa.array([v[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for v in (at, times)]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(p), pa.array(n.astype(np.int64)), *parts], ["row", "p", "n", "at", "times"])

    got = map_texts(sample.select("n", "text"), "text", "row int, p bigint, n bigint, at binary, times binary", kept).toArrow().sort_by("row")
    at = [np.frombuffer(x, np.int32) for x in got.column("at").to_pylist()]
    times = np.concatenate([np.frombuffer(x, np.int32) for x in got.column("times").to_pylist()])
    owner = np.repeat(np.arange(len(at)), [len(x) for x in at])
    w, b = fit_linear(owner, np.concatenate(at), times, got.column("n").to_numpy(), got.column("p").to_numpy() / unit, len(chosen), threshold=threshold)
    weights[chosen] = w
    return weights, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = 3, held: int = 1, threshold: float = 0.7, limit: int = MAX_LABELLED) -> ToxicModel:
    """Mine lexicons from labelled rows outside the held-out fold, count votes over all of ``docs``, fit the label model, then the classifier.

    Lexicons and classifier use at most ``limit`` labelled rows; held-out rows
    give votes only, and what the classifier learns are posteriors. Without any
    label only the fixed list is a lexicon and every score is that of a clean text.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, label, folds, held, limit)
    lexicons = mine(sample)
    model = fit_label_model(*vote_counts(docs.select(F.col(f"`{text_col}`").alias("text")), lexicons))
    return ToxicModel(lexicons, model, *learn(sample, lexicons, model, threshold), threshold)


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. A null text is scored like an empty one; rows that repeat are scored each; other columns are ignored."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(rows: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.score(offsets, data))], ["doc_id", "score"])

    out = map_texts(src, "text", f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double", run)
    return out.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= model.threshold).cast("int").alias("predicted"))
