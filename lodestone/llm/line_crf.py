"""Quality rules: a linear-chain CRF marks each line as content or boilerplate.

Lines of a whole text are labelled together by Viterbi decoding over features of
their bytes; a document is kept when content lines hold enough of its words and
its own counts pass the base rules. The CRF is trained here, by the exact
gradient of the sequence likelihood, on line sequences that ``example_lines``
makes from a rule: running prose against tables, symbol soup, shouting, menus
and repeated lines. All counts come from Arrow buffers in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
FEATURES = ("bias", "symbols", "upper", "marks", "bars", "digits", "word length", "short", "long", "repeated", "no words", "varied", "first", "stop")
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_IS_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_IS_LETTER = _IS_UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 192)
_IS_MARK = np.isin(np.arange(256), np.frombuffer(b"!?=_~^@+{}[]\\", np.uint8))
_IS_STOP = np.isin(np.arange(256), np.frombuffer(b".,;:", np.uint8))
_IS_BAR = np.arange(256) == 124
#: The first byte of every visible code point.
_IS_POINT = tv.VISIBLE_BYTES & ((np.arange(256) & 0xC0) != 0x80)
_IS_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)


def lines_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per text the index of its first line; every text has one line at least."""
    brk = np.flatnonzero(data == 10)
    n = len(offsets) - 1
    owner = np.concatenate([np.arange(n), np.searchsorted(offsets, brk, "right") - 1])
    at = np.concatenate([offsets[:-1], brk + 1])
    order = np.lexsort((at, owner))
    owner, start = owner[order], at[order]
    first = np.searchsorted(owner, np.arange(n + 1))
    end = np.append(start[1:] - 1, 0)
    last = first[1:] - 1
    end[last] = offsets[1:]
    return start, end, first


def measure(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per text and features per line of one piece."""
    n = len(offsets) - 1
    ws, we, wfirst, h = tv.text_words(offsets, data, tv.VISIBLE_BYTES, tv.EXACT)
    start, end, lfirst = lines_of(offsets, data)
    owner = np.repeat(np.arange(n), np.diff(lfirst))
    # Counts are taken a table at a time, so a long text costs a flag for each byte, not a running sum.
    count = lambda table: tv.sums(table[data], start, end)
    points, sym, up, mark, stop, dig, letter, bar = (count(x) for x in (_IS_POINT, _IS_SYMBOL, _IS_UPPER, _IS_MARK, _IS_STOP, _IS_DIGIT, _IS_LETTER, _IS_BAR))
    per_text = lambda x: np.add.reduceat(x, lfirst[:-1]) if n else np.zeros(0, np.int64)
    out = {"n_words": np.diff(wfirst), "word_chars": per_text(points), "n_symbols": per_text(sym)}
    key = tv.mix(tv.hash_ranges(data, start, end, tv.EXACT) + owner.astype(tv.U64) * tv.U64(0x9E3779B97F4A7C15))
    wa, wb = np.searchsorted(ws, start), np.searchsorted(ws, end)
    del ws, we
    lwords = wb - wa
    _, at, inv = np.unique(key, return_index=True, return_inverse=True)
    first_seen = at[inv]
    has = lwords > 0
    dup = has & (first_seen < np.arange(len(key)))
    out["n_dup_lines"] = np.bincount(owner[dup], minlength=n)

    # Windows of three words, told apart by text; the first of a repeated window counts too.
    m = len(h)
    covered = np.zeros(m + 3, bool)
    if m >= 3:
        wowner = np.repeat(np.arange(n, dtype=np.int32), np.diff(wfirst))
        c = tv._COEF
        key3 = h[:-2] * c[0]
        key3 += h[1:-1] * c[1]
        key3 += h[2:] * c[2]
        key3 += wowner[:-2].astype(tv.U64) * tv.U64(0x9E3779B97F4A7C15)
        i = np.flatnonzero(wowner[:-2] == wowner[2:])
        key3 = tv.mix(key3)[i]
        order = np.argsort(key3, kind="stable")
        key3 = key3[order]
        same = key3[1:] == key3[:-1]
        twice = np.zeros(len(key3), bool)
        twice[1:] |= same
        twice[:-1] |= same
        r = i[order[twice]]
        covered[r] = covered[r + 1] = covered[r + 2] = True
        out["n_repeat_words"] = np.bincount(wowner[covered[:m]], minlength=n)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)

    chars = np.maximum(points, 1)
    w = np.maximum(lwords, 1)
    x = np.zeros((len(start), len(FEATURES)), np.float32)
    x[:, 0] = 1
    x[:, 1] = np.minimum(sym / w, 3)
    x[:, 2] = up / np.maximum(letter, 1)
    x[:, 3] = np.minimum(mark / w, 3)
    x[:, 4] = np.minimum(bar / w, 1)
    x[:, 5] = dig / chars
    x[:, 6] = np.minimum(chars / w, 30) / 10
    x[:, 7] = lwords < 4
    x[:, 8] = lwords > 12
    x[:, 9] = dup
    x[:, 10] = ~has
    x[:, 11] = 1 - tv.sums(covered[:m], wa, wb) / w
    x[lfirst[:-1], 12] = 1
    x[:, 13] = np.minimum(stop / w, 2)
    return out | {"x": x, "first": lfirst, "line_words": lwords}


def viterbi(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best label of every line: emit (lines, 2), texts as ranges of lines, all texts stepping together."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    base, count = first[:-1][order], count[order]
    back = np.zeros((len(emit), 2), np.int8)
    score = emit[base].copy()
    longest = int(count[0]) if len(count) else 0
    for t in range(1, longest):
        live = int(np.searchsorted(-count, -t, "left"))
        cand = score[:live, :, None] + trans[None]
        back[base[:live] + t] = cand.argmax(axis=1)
        score[:live] = cand.max(axis=1) + emit[base[:live] + t]
    label = np.zeros(len(emit), np.int8)
    state = score.argmax(axis=1).astype(np.int8)
    label[base + count - 1] = state
    for t in range(longest - 1, 0, -1):
        live = int(np.searchsorted(-count, -t, "left"))
        # A text enters this walk when t reaches its own last line.
        now = label[base[:live] + t]
        label[base[:live] + t - 1] = back[base[:live] + t, now]
    return label


def example_lines(seed: int = 3, texts: int = 400) -> tuple[list[str], list[list[int]]]:
    """Texts and line labels (1: content) for training, made by rule."""
    rng = np.random.default_rng(seed)
    syllables = ["re", "tion", "an", "le", "ou", "st", "der", "que", "men", "lo", "ka", "in", "or", "es", "pi", "ver", "ö", "é", "ng", "ta"]
    small = ["the", "of", "and", "de", "la", "und", "in", "to", "el", "die"]
    word = lambda: small[rng.integers(len(small))] if rng.random() < 0.35 else "".join(syllables[i] for i in rng.integers(0, len(syllables), rng.integers(1, 5)))

    def prose(n: int) -> str:
        ws = [word() for _ in range(n)]
        for i in range(len(ws)):
            if rng.random() < 0.1:
                ws[i] += rng.choice([",", ".", "."])
        return " ".join(ws).capitalize() + "."

    fixed = {
        "table": lambda: " | ".join(word() for _ in range(rng.integers(4, 60))),
        "soup": lambda: " ".join(word() + rng.choice(["###", "***", "$$$", "%%%", "&&&"]) for _ in range(rng.integers(5, 120))),
        "shout": lambda: " ".join(word().upper() + "!!" for _ in range(rng.integers(3, 40))),
        "markup": lambda: " ".join(rng.choice(["<div>", "<a", "href>", "</p>", "{", "};", "==", "[x]"]) for _ in range(rng.integers(3, 30))),
        "loop": lambda: " ".join([word() + " " + word() + " " + word()] * int(rng.integers(6, 40))),
        "menu": lambda: " » ".join(word().capitalize() for _ in range(rng.integers(3, 8))),
    }
    out, labels = [], []
    for _ in range(texts):
        kind = rng.random()
        lines, marks = [], []
        junk = list(fixed)[rng.integers(len(fixed))]
        for _ in range(int(rng.integers(1, 14))):
            bad = rng.random() < (0.04 if kind < 0.6 else 0.9 if kind < 0.9 else 0.4)
            if bad and lines and rng.random() < 0.3 and marks[-1] == 0:
                line = lines[-1]
            else:
                line = fixed[junk]() if bad else prose(int(rng.integers(1, 90)))
                if not bad and rng.random() < 0.15:
                    line += rng.choice([" +1 (555) 210-3344", " 10.0.0.1", " https://a.example/x", " (c) 2020 Apache License 2.0."])
            lines.append(line)
            marks.append(int(not bad))
        out.append("\n".join(lines))
        labels.append(marks)
    return out, labels


@cache
def train(seed: int = 3, steps: int = 150, rate: float = 0.15, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the features for content, transitions), by Adam on the exact likelihood gradient."""
    texts, labels = example_lines(seed)
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = measure(offsets, np.frombuffer(b"".join(raw), np.uint8))
    x, first = got["x"].astype(float), got["first"]
    y = np.concatenate(labels)
    w, tr = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    seqs = [(a, b) for a, b in zip(first[:-1], first[1:], strict=True)]
    top = max(b - a for a, b in seqs)
    idx = np.full((len(seqs), top), -1)
    for k, (a, b) in enumerate(seqs):
        idx[k, : b - a] = np.arange(a, b)
    mask = idx >= 0
    yy = np.where(mask, y[idx], 0)
    onehot = np.eye(2)[yy] * mask[..., None]
    for step in range(1, steps + 1):
        e = (x @ w)[idx]
        alpha = np.zeros((len(seqs), top, 2))
        beta = np.zeros_like(alpha)
        alpha[:, 0] = e[:, 0]
        lse = lambda v, axis: v.max(axis=axis) + np.log(np.exp(v - v.max(axis=axis, keepdims=True)).sum(axis=axis))
        for t in range(1, top):
            new = lse(alpha[:, t - 1, :, None] + tr[None], 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(top - 2, -1, -1):
            new = lse(tr[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
        z = lse(alpha[:, -1], 1)
        gamma = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pair = np.zeros((2, 2))
        want = np.zeros((2, 2))
        for t in range(1, top):
            live = mask[:, t]
            xi = np.exp(alpha[live, t - 1, :, None] + tr[None] + (e[live, t] + beta[live, t])[:, None, :] - z[live, None, None])
            pair += xi.sum(axis=0)
            want += onehot[live, t - 1].T @ onehot[live, t]
        diff = (onehot - gamma)[mask]
        gw = x[idx[mask]].T @ diff / len(seqs) - decay * w
        gt = (want - pair) / len(seqs) - decay * tr
        for k, (p, g) in enumerate(((w, gw), (tr, gt))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w.astype(np.float32), tr.astype(np.float32)


def _labeller(text: str, w: np.ndarray, tr: np.ndarray, min_share: float, min_words: int, max_repeat: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, data in tv.pieces(batches, text):
            got = measure(offsets, data)
            label = viterbi(got["x"] @ w, got["first"], tr)
            content = np.add.reduceat(np.where(label == 1, got["line_words"], 0), got["first"][:-1])
            n = got["n_words"]
            failed = (n < min_words) | (100 * got["n_repeat_words"] > max_repeat * n)
            share = content / np.maximum(n, 1)
            cols = [got[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            lists = pa.ListArray.from_arrays(got["first"].astype(np.int32), pa.array(label == 1))
            yield pa.RecordBatch.from_arrays(
                [*(c for k, c in zip(rows.schema.names, rows.columns, strict=True) if k != text), *map(pa.array, cols), pa.array(failed), pa.array(~failed & (share >= min_share)), pa.array(share), lists],
                [*(k for k in rows.schema.names if k != text), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "content_lines"],
            )

    return run


def judge_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = 0.5, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed, kept, content_share and content_lines (a flag for each line).

    A null text has no words and fails like an empty one; rows that repeat are
    judged each; other columns are ignored; an empty table gives an empty result.
    """
    w, tr = train()
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    counts = ", ".join(f"{k} bigint" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return src.mapInArrow(_labeller("text", w, tr, min_share, min_words, max_repeat), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {counts}, base_failed boolean, kept boolean, content_share double, content_lines array<boolean>")
