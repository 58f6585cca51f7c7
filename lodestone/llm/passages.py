"""Suffix-array dedup: bytes of texts that lie in a string of ``length`` bytes which also starts earlier.

1. Every window of ``length`` bytes has an anchor, the leftmost least k-gram in
   it, so equal windows have equal anchors wherever they occur. Consecutive
   windows with the same anchor form one *context*, and a text becomes a list of
   contexts; nothing else of it is shuffled. Of a context that occurs several
   times in what a task reads at once only the earliest is compared further; the
   others are repeats already, so a common passage sends a row for each portion
   read, not one for each document.
2. Contexts meet on their anchor's hash, in order of hash, content and place. A
   context that occurred before is a repeat as a whole; anchors of one text only
   are dropped. What remains are contexts that share an anchor but differ.
3. Those are suffix-sorted, group by group, with linear grouping (``lyndon``):
   equal windows are neighbours in the suffix array, and all but the earliest are
   repeats. Contexts that share no long enough piece around the anchor are left
   out first. A group of more than ``SPLIT`` contexts is not held by one task: its
   windows are dealt out one by one and meet as in steps 1 and 2.
4. Repeated windows are united per document and cut out of its text.

Every step reads groups in order with constant state or holds ``SPLIT`` contexts
of a group at most. The suffix order thus decides windows whose surroundings
differ; whole contexts, as in exact copies, and windows of large groups are
decided by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .lyndon import suffix_arrays
from .store import cut, stored

#: Length of an anchor's k-gram in bytes, for windows of 100.
GRAM = 36
#: Bytes of context that are suffix-sorted at once, and contexts above which a group is dealt out by its windows.
AT_ONCE = 4 << 20
SPLIT = 2048
#: Contexts among which a task looks for repeats before it sends them on.
TOGETHER = 400_000
#: Bytes of one text that are read at once.
PORTION = 1 << 19
#: Anchors of large groups that are broadcast; above this they are joined by a shuffle.
BROADCAST_ANCHORS = 200_000


def contexts(offsets: np.ndarray, data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, content hash, start, bytes) of all contexts of a piece; start counts from the text's start."""
    n = len(data)
    ends = offsets[1:]
    w = length - gram + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, tv.U64, tv.U64, np.int64, np.int64))
    if n < length:
        return none
    s = tv.prefix(data, tv.EXACT)
    at = np.arange(n - gram + 1)
    h = tv.range_hash(s, at, at + gram)
    bits = tv.U64(max(20, int(n).bit_length()))
    key = (h >> bits << bits) | at.astype(tv.U64)
    m = len(key)
    pad = np.full((-m) % w, 0xFFFFFFFFFFFFFFFF, tv.U64)
    grid = np.concatenate([key, pad]).reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[: m - w + 1], left[w - 1 : m])
    anchor = (low & ((tv.U64(1) << bits) - tv.U64(1))).astype(np.int64)
    # Windows that leave their text are none.
    text = np.repeat(np.arange(len(ends)), np.diff(offsets))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + length <= ends[text])
    if not len(start):
        return none
    a = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = a[1:] != a[:-1]
    k = np.flatnonzero(new)
    lo, hi = start[k], start[np.append(k[1:], len(start)) - 1]
    p = a[k]
    content = tv.range_hash(s, lo, hi + length) + tv.mix((p - lo).astype(tv.U64) + tv.U64(1))
    return text[lo], h[p], content, lo - offsets[text[lo]], hi - lo + length


class _Together:
    """Contexts of several portions of texts, sent on together."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.ids: list[pa.Array] = []
        self.h: list[np.ndarray] = []
        self.texts = self.size = 0

    def add(self, text: np.ndarray, fp: np.ndarray, ctx: np.ndarray, lo: np.ndarray, size: np.ndarray, ids: pa.Array, h: pa.Array) -> None:
        self.parts.append((text + self.texts, fp, ctx, lo, size))
        self.ids.append(ids)
        self.h.append(h.to_numpy())
        self.texts += len(ids)
        self.size += len(fp)

    def send(self) -> pa.RecordBatch:
        """(fp, ctx, id, h, lo, size): the earliest of equal contexts; for the others ctx is null and fp is any number, for they meet nobody."""
        text, fp, ctx, lo, size = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        ids, h = pa.concat_arrays(self.ids), np.concatenate(self.h)
        self.__init__()
        order = np.argsort(ctx, kind="stable")
        same = ctx[order][1:] == ctx[order][:-1]
        several = np.zeros(len(ctx), bool)
        several[1:] = same
        several[:-1] |= same
        keep, again = np.ones(len(ctx), bool), np.zeros(len(ctx), bool)
        k = order[several]
        if len(k):
            by_id = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="min").to_numpy().astype(np.int64)
            o = k[np.lexsort((lo[k], h[text[k]], by_id[text[k]], ctx[k]))]
            head = np.append(True, ctx[o][1:] != ctx[o][:-1])
            first = o[np.flatnonzero(head)][np.cumsum(head) - 1]
            # The same place again, from a row that repeats, is no repeat of itself.
            twin = ~head & (by_id[text[o]] == by_id[text[first]]) & (h[text[o]] == h[text[first]]) & (lo[o] == lo[first])
            keep[o[twin]] = False
            again[o[~head & ~twin]] = True
            fp = np.where(again, tv.mix(fp + np.arange(len(fp), dtype=tv.U64) * tv.U64(0x9E3779B97F4A7C15)), fp)
        take = pa.array(text[keep])
        return pa.RecordBatch.from_arrays(
            [pa.array(fp[keep].view(np.int64)), pa.array(ctx[keep].view(np.int64), mask=again[keep]), ids.take(take), pa.array(h[text[keep]]), pa.array(lo[keep]), pa.array(size[keep])],
            ["fp", "ctx", "id", "h", "lo", "size"],
        )


def _finder(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold = _Together()
        for rows, offsets, data in tv.pieces(batches, "text", 1 << 18):
            # A long text is read in portions that overlap by a window; a context that is cut there meets its like by its anchor.
            step = max(PORTION, length)
            for a in range(0, len(data), step) if rows.num_rows == 1 else (0,):
                part = data[a : a + step + length - 1] if rows.num_rows == 1 else data
                text, fp, ctx, lo, size = contexts(np.array([0, len(part)]) if rows.num_rows == 1 else offsets, part, length, gram)
                hold.add(text, fp, ctx, lo + a, size, rows.column(0), rows.column(1))
                if hold.size >= TOGETHER:
                    yield hold.send()
        if hold.size:
            yield hold.send()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (fp, ctx, place): repeats of a context (first = false), and the first of each context of an anchor that has several (first = true). Rows without ctx are repeats as they come."""
    last = None  # (fp, ctx, row of the first occurrence, whether it was given out)
    for batch in batches:
        if batch.column(1).null_count:
            again = batch.column(1).is_null()
            part = batch.filter(again)
            yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(k) for k in (2, 3, 4, 5)), pa.array(np.zeros(part.num_rows, bool))], ["fp", "id", "h", "lo", "size", "first"])
            batch = batch.filter(pc.invert(again))
        n = batch.num_rows
        if not n:
            continue
        fp, ctx = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        same_fp, same_ctx = np.zeros(n, bool), np.zeros(n, bool)
        same_fp[1:] = fp[1:] == fp[:-1]
        same_ctx[1:] = same_fp[1:] & (ctx[1:] == ctx[:-1])
        if last is not None:
            same_fp[0] = fp[0] == last[0]
            same_ctx[0] = same_fp[0] and ctx[0] == last[1]
        keys = [batch.column(k) for k in (2, 3, 4)]
        twin = np.zeros(n, bool)  # the same place again, from a row that repeats
        ids = keys[0].to_numpy(zero_copy_only=False) if keys[0].null_count == 0 else None
        h, lo = keys[1].to_numpy(), keys[2].to_numpy()
        if ids is not None:
            twin[1:] = same_ctx[1:] & (h[1:] == h[:-1]) & (lo[1:] == lo[:-1]) & (ids[1:] == ids[:-1])
        else:
            py = keys[0].to_pylist()
            twin[1:] = same_ctx[1:] & (h[1:] == h[:-1]) & (lo[1:] == lo[:-1]) & np.array([a == b for a, b in zip(py[1:], py[:-1], strict=True)], bool)
        place = lambda k: (keys[0][k].as_py(), int(h[k]), int(lo[k]))
        if last is not None and same_ctx[0]:
            twin[0] = place(0) == last[4]
        repeat = same_ctx & ~twin
        # Twins of the first occurrence are first too; twins of a repeat repeat.
        run = np.cumsum(~twin)
        if twin.any():
            lead = np.zeros(run[-1] + 1, bool)
            lead[run[~twin]] = repeat[~twin]
            if twin[0]:
                lead[0] = last[5]
            repeat = np.where(twin, lead[run], repeat)
        head = np.flatnonzero(~same_ctx)
        multi = np.zeros(n, bool)
        out = []
        if len(head):
            follows = same_fp[head]  # another context of the same anchor came before
            precedes = np.zeros(len(head), bool)
            precedes[:-1] = follows[1:]
            multi[head[follows | precedes]] = True
            if follows[0] and last is not None and not last[3]:
                out.append(last[2])
        give = multi | repeat
        keep = np.flatnonzero(give)
        flags = pa.array(multi[keep])
        part = batch.take(pa.array(keep))
        result = pa.RecordBatch.from_arrays([part.column(0), *(part.column(k) for k in (2, 3, 4, 5)), flags], ["fp", "id", "h", "lo", "size", "first"])
        if out:
            one = out[0]
            yield pa.RecordBatch.from_arrays([one.column(0), *(one.column(k) for k in (2, 3, 4, 5)), pa.array([True])], ["fp", "id", "h", "lo", "size", "first"])
        yield result
        row = batch.slice(head[-1], 1) if len(head) else last[2]
        given = bool(multi[head[-1]]) if len(head) else last[3] or bool(len(head))
        last = (fp[-1], ctx[-1], row, given, place(n - 1), bool(repeat[-1]))


def _anchors(texts: list[bytes], fp: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Where the anchor, the k-gram whose hash is ``fp``, lies in each context."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(texts), np.uint8)
    s = tv.prefix(flat, tv.EXACT)
    at = np.arange(len(flat) - gram + 1)
    owner = np.repeat(np.arange(len(texts)), size)[: len(at)]
    inside = at + gram <= (begin + size)[owner]
    hit = np.flatnonzero(inside & (tv.range_hash(s, at, at + gram).view(np.int64) == fp[owner]))
    offset = np.zeros(len(texts), np.int64)
    offset[owner[hit][::-1]] = (hit - begin[owner[hit]])[::-1]
    # The anchor lies in every window, so it is the last match that starts there.
    anchored = hit[(hit - begin[owner[hit]] <= length - gram) & (hit - begin[owner[hit]] >= (size - length)[owner[hit]])]
    offset[owner[anchored][::-1]] = (anchored - begin[owner[anchored]])[::-1]
    return offset


def _listed(column: pa.Array, large: bool) -> tuple[np.ndarray, ...]:
    """(row, fp, lo, size) of a column of lists of wanted contexts, of large groups or of the others."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    row = np.repeat(np.arange(len(column)), sizes)
    x = column.flatten()
    ok = x.field("large").to_numpy(zero_copy_only=False).astype(bool) == large
    return row[ok], *(x.field(k).to_numpy()[ok].astype(np.int64) for k in ("fp", "lo", "size"))


def _contexts_wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted contexts of each text, but for those of large groups."""
    for rows, offsets, data in tv.pieces(batches, "text"):
        every = _listed(rows.column(3), False)
        for at in range(0, len(every[0]), 20_000):
            row, fp, lo, size = (x[at : at + 20_000] for x in every)
            begin = offsets[row] + lo
            out = [data[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(fp), rows.column(0).take(take), rows.column(1).take(take), pa.array(lo), pa.array(out, pa.binary())], ["fp", "id", "h", "lo", "data"])


def _windows_wanted(length: int):
    """Windows of the wanted contexts of large groups, each as an anchor and a context of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold = _Together()
        for rows, offsets, data in tv.pieces(batches, "text", 1 << 18):
            every = _listed(rows.column(3), True)
            for k in range(0, len(every[0]), 2_000):
                row, _, lo, size = (x[k : k + 2_000] for x in every)
                n = size - length + 1
                owner = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                # The contexts one after another, so that a text is hashed where it is wanted only.
                flat = np.cumsum(size) - size
                begin = offsets[row] + lo
                bytes_ = data[np.repeat(begin - flat, size) + np.arange(int(size.sum()))]
                at = flat[owner] + step
                h = tv.mix(tv.range_hash(tv.prefix(bytes_, tv.EXACT), at, at + length))
                hold.add(row[owner], h, h, lo[owner] + step, np.full(len(at), length), rows.column(0), rows.column(1))
                if hold.size >= TOGETHER:
                    yield hold.send()
        if hold.size:
            yield hold.send()

    return run


def repeated_windows(group: np.ndarray, place: np.ndarray, texts: list[bytes], length: int) -> list[np.ndarray]:
    """For contexts of several groups: per context the starts of windows that also occur at a lesser place of the same group.

    group: ascending group of each context; place: rank of its position in the corpus.
    """
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(size) - size
    # One text for each group: its contexts, each followed by a letter below all bytes.
    k = np.arange(len(texts))
    values = np.zeros(len(flat) + len(texts), np.int16)
    values[np.arange(len(flat)) + np.repeat(k, size)] = flat.astype(np.int16) + 1
    starts = begin + k
    new = np.ones(len(texts), bool)
    new[1:] = group[1:] != group[:-1]
    heads = np.flatnonzero(new)
    sa = suffix_arrays(values, np.append(starts[heads], len(values)))
    owner = np.repeat(k, size + 1)
    left = (starts + size)[owner] - np.arange(len(values))
    ok = sa[left[sa] >= length]
    # Neighbours in the suffix array that agree on a whole window.
    s = tv.prefix(flat, tv.EXACT)
    a = ok - owner[ok]
    h = tv.range_hash(s, a, a + length)
    g = group[owner[ok]]
    same = np.zeros(len(ok), bool)
    same[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    run = np.cumsum(~same) - 1
    if not len(ok):
        return [np.zeros(0, np.int64) for _ in texts]
    least = np.minimum.reduceat(place[owner[ok]], np.flatnonzero(~same))
    again = ok[place[owner[ok]] > least[run]]
    again = np.sort(again)
    cut = np.searchsorted(again, np.append(starts, len(values)))
    return [again[cut[j] : cut[j + 1]] - starts[j] for j in k]


def _probes(texts: list[bytes], offset: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """Hashes of pieces around the anchor, one of which two contexts with an equal window share; 0 where the context is too short for a piece."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    s = tv.prefix(np.frombuffer(b"".join(texts), np.uint8), tv.EXACT)
    slack = length - gram
    step = max(slack // 4, 1)
    out = []
    for left in range(0, slack + 1, step):
        right = max(slack - left - step + 1, 0)
        a, b = offset - left, offset + gram + right
        ok = (a >= 0) & (b <= size)
        out.append(np.where(ok, tv.range_hash(s, begin + np.where(ok, a, 0), begin + np.where(ok, b, 0)), tv.U64(0)))
    return out


def _solve(length: int, gram: int):
    def flush(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        fp, lo = rows.column("fp").to_numpy(), rows.column("lo").to_numpy()
        texts = rows.column("data").to_pylist()
        h = rows.column("h").to_numpy()
        ids = rows.column("id")
        name = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        by_id = pc.rank(name, sort_keys="ascending", null_placement="at_end", tiebreaker="min").to_numpy()
        order = np.lexsort((lo, h, by_id))
        place = np.empty(len(order), np.int64)
        key = np.stack([by_id.astype(np.int64), h.astype(np.int64), lo])[:, order]
        place[order] = np.cumsum(np.append(False, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        size = np.array([len(t) for t in texts], np.int64)
        # A context that shares no piece around the anchor shares no window.
        alone = np.ones(len(texts), bool)
        for k, probe in enumerate(_probes(texts, _anchors(texts, fp, length, gram), length, gram)):
            ok = np.flatnonzero(probe != 0)
            if not len(ok):
                continue
            pair = tv.mix(probe[ok] ^ tv.mix(fp[ok].view(np.uint64) + tv.U64(k)))
            _, at, times = np.unique(pair, return_inverse=True, return_counts=True)
            alone[ok[times[at] > 1]] = False
        whole = np.flatnonzero(~alone)
        o = np.argsort(fp[whole], kind="stable")
        member, g = whole[o], np.unique(fp[whole][o], return_inverse=True)[1]
        # Groups of like size are sorted together.
        n = np.bincount(g, weights=size[member]).astype(np.int64)
        rank = np.argsort(np.argsort(n, kind="stable"), kind="stable")
        o = np.argsort(rank[g], kind="stable")
        member, g = member[o], rank[g][o]
        total = np.cumsum(size[member])
        who, start, end = [], [], []
        a = 0
        while a < len(member):
            b = int(np.searchsorted(total, total[a] - size[member[a]] + AT_ONCE, "right"))
            b = max(b, a + 1)
            b = int(np.searchsorted(g, g[b - 1], "right"))
            for j, w in zip(member[a:b], repeated_windows(g[a:b], place[member[a:b]], [texts[j] for j in member[a:b]], length), strict=True):
                if len(w):
                    brk = np.flatnonzero(np.diff(w) > 1)
                    begin, last = w[np.append(0, brk + 1)], w[np.append(brk, len(w) - 1)] + length
                    who += [j] * len(begin)
                    start += (begin + lo[j]).tolist()
                    end += (last + lo[j]).tolist()
            a = b
        take = pa.array(who, pa.int64())
        return pa.RecordBatch.from_arrays([name.take(take), pa.array(h).take(take), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["id", "h", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups of about ``AT_ONCE`` bytes at a time; a group has ``SPLIT`` contexts at most."""
        hold: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                hold.append(rows)
                size += pc.sum(pc.binary_length(rows.column(4))).as_py()
                if size < AT_ONCE:
                    continue
                t = pa.Table.from_batches(hold)
                fp = t.column("fp").to_numpy()
                b = int(np.searchsorted(fp, fp[-1], "left"))
                if b:
                    yield flush(t.slice(0, b))
                    t = t.slice(b)
                hold = t.combine_chunks().to_batches()
                size = sum(pc.sum(pc.binary_length(x.column(4))).as_py() for x in hold)
        if hold:
            yield flush(pa.Table.from_batches(hold))

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each text, united, and what is left without them."""
    for rows, offsets, data in tv.pieces(batches, "text"):
        parts = []
        for column in rows.columns[3:]:
            row = np.repeat(np.arange(rows.num_rows), pc.fill_null(pc.list_value_length(column), 0).to_numpy())
            x = column.flatten()
            parts.append((row, x.field("start").to_numpy(), x.field("end").to_numpy()))
        row, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, row))
        row, start, end = row[order], offsets[row[order]] + start[order], offsets[row[order]] + end[order]
        # Texts follow each other, so one running maximum serves all: a span begins where none before it reaches.
        reach = np.maximum.accumulate(end) if len(end) else end
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] > reach[:-1]) | (row[1:] != row[:-1])
        k = np.flatnonzero(new)
        row, start, end = row[k], start[k], reach[np.append(k[1:], len(new)) - 1] if len(k) else end
        cuts = np.searchsorted(row, np.arange(rows.num_rows + 1))
        kept = []
        for j in range(rows.num_rows):
            left, last = hashlib.sha256(), int(offsets[j])
            for a, b in zip(start[cuts[j] : cuts[j + 1]].tolist(), end[cuts[j] : cuts[j + 1]].tolist(), strict=True):
                left.update(data[last:a])
                last = b
            left.update(data[last : offsets[j + 1]])
            kept.append(left.hexdigest())
        removed = np.bincount(row, weights=end - start, minlength=rows.num_rows).astype(np.int64)
        spans = pa.StructArray.from_arrays([pa.array(start - offsets[row]), pa.array(end - offsets[row])], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), spans)
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(offsets)), pa.array(removed), lists, pa.array(kept, pa.string())], ["id", "h", "n_bytes", "n_removed", "spans", "kept_sha256"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, spans (removed byte ranges, united), kept_sha256.

    Texts are UTF-8 bytes, a null text is empty, and strings never cross texts.
    Earlier means a smaller id, null last, then an earlier start. Rows that repeat
    an id with another text are ordered by a hash of the text; of rows equal in
    both, one is judged and the others repeat it whole. Texts shorter than
    ``length`` lose nothing. Other columns are ignored; an empty table gives an
    empty result.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.hash(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("h"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    found = src.where(F.octet_length("text") >= length).mapInArrow(_finder(length, gram), f"fp bigint, ctx bigint, id {kind}, h int, lo bigint, size bigint")

    def meet(found: DataFrame) -> DataFrame:
        found = found.select("fp", "ctx", "id", "h", F.col("lo").cast("int").alias("lo"), F.col("size").cast("int").alias("size"))
        return found.repartition("fp").sortWithinPartitions("fp", "ctx", F.col("id").asc_nulls_last(), "h", "lo").mapInArrow(_meet, f"fp bigint, id {kind}, h int, lo int, size int, first boolean")

    marks = stored(meet(found))
    span = F.struct(F.col("lo").cast("bigint").alias("start"), (F.col("lo") + F.col("size")).cast("bigint").alias("end"))
    large = cut(marks.where("first").groupBy("fp").count().where(F.col("count") > SPLIT).select("fp", F.lit(True).alias("large")))
    n_large = large.count()
    sized = marks.join(F.broadcast(large) if n_large <= BROADCAST_ANCHORS else large, "fp", "left") if n_large else marks.withColumn("large", F.lit(False))
    per_text = sized.withColumn("large", F.coalesce("large", F.lit(False))).groupBy("id", "h").agg(
        F.collect_set(F.when(~F.col("first"), span)).alias("gone"),
        F.collect_set(F.when(F.col("first"), F.struct("fp", "lo", "size", "large"))).alias("want"),
    ).select(F.col("id").alias("mid"), F.col("h").alias("mh"), "gone", "want")
    marked = F.col("mh").isNotNull()
    joined = src.join(per_text, F.col("id").eqNullSafe(F.col("mid")) & (F.col("h") == F.col("mh")), "left")
    rows = stored(joined.select("id", "h", F.octet_length("text").cast("bigint").alias("n_bytes"), F.when(~marked, F.sha2("text", 256)).alias("sha"), F.when(marked, F.col("text")).alias("text"), "gone", "want"))
    want = rows.where(F.size("want") > 0).select("id", "h", "text", "want")
    bounds = f"id {kind}, h int, start bigint, end bigint"
    solved = want.mapInArrow(_contexts_wanted, f"fp bigint, id {kind}, h int, lo bigint, data binary").repartition("fp").sortWithinPartitions("fp").mapInArrow(_solve(length, gram), bounds)
    if n_large:
        dealt = meet(want.where(F.exists("want", lambda x: x["large"])).mapInArrow(_windows_wanted(length), f"fp bigint, ctx bigint, id {kind}, h int, lo bigint, size bigint"))
        solved = solved.union(dealt.where("not first").select("id", "h", F.col("lo").cast("bigint"), (F.col("lo") + F.col("size")).cast("bigint")))
    more = solved.groupBy("id", "h").agg(F.collect_set(F.struct("start", "end")).alias("more")).select(F.col("id").alias("mid"), F.col("h").alias("mh"), "more")
    touched = rows.where(F.col("sha").isNull()).join(more, F.col("id").eqNullSafe(F.col("mid")) & (F.col("h") == F.col("mh")), "left").select("id", "h", "text", "gone", "more")
    spans = "array<struct<start:bigint,end:bigint>>"
    done = touched.mapInArrow(_united, f"id {kind}, h int, n_bytes bigint, n_removed bigint, spans {spans}, kept_sha256 string")
    clean = rows.where(F.col("sha").isNotNull()).select("id", "h", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), F.expr(f"cast(array() as {spans})").alias("spans"), F.col("sha").alias("kept_sha256"))
    every = done.union(clean)
    again = (F.row_number().over(Window.partitionBy("id", "h").orderBy("n_bytes")) > 1) & (F.col("n_bytes") >= length)
    every = every.withColumn("again", again)
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    return every.select(
        F.col("id").alias("doc_id"), "n_bytes", F.when(F.col("again"), F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(F.col("again"), whole).otherwise(F.col("spans")).alias("spans"),
        F.when(F.col("again"), F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def digest(passages: DataFrame) -> DataFrame:
    """The columns of the suffix-array dedup query."""
    return passages.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")
