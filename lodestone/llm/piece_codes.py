"""SentencePiece encoding and decoding of merge-type models, exact, by backtracking.

A merge-type model joins the neighbouring pieces of best score until none can be
joined. The same result is found from left to right: an Aho-Corasick automaton
over the pieces gives the longest piece that starts at every place; it is tried
first and stands if its predecessor and it are what the two would be merged to
when encoded together. Otherwise the next shorter piece is tried, and if none
stands, the last one is taken back; a bit for each place marks those from which
no way led on, so no place fails twice. Whether a pair stands is found by merging
its text once and kept.

Two characters that no piece holds side by side are never joined across, so a
text is cut there into stretches that are encoded by themselves, and a stretch
that was met before is looked up.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

#: The public model; its path is a parameter.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: How the format writes a space (fixed value).
SPACE = "▁"
#: Stretches and pairs that are remembered by a process; both start anew beyond it.
REMEMBERED = 400_000
#: Longer stretches are not remembered.
LONG = 64
#: Characters that are cut into stretches at once.
AT_ONCE = 1 << 18

# Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Model:
    """A merge-type model: its pieces, and the encoder and decoder they make."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as format

        spec = format.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules = spec.normalizer_spec
        if spec.trainer_spec.model_type != format.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models that fall back to bytes are known")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix or any(p.type in (USER, UNUSED) for p in spec.pieces):
            raise ValueError("only models without character maps, white space removal and pieces of the user are known")
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.end = spec.trainer_spec.eos_id
        self.piece = [p.piece for p in spec.pieces]
        self.size = [len(p) for p in self.piece]
        self.id = {p.piece: k for k, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        self.byte = {int(p.piece[3:5], 16): k for k, p in enumerate(spec.pieces) if p.type == BYTE}
        letters = sorted({c for p in self.id for c in p})
        if any(c not in self.id for c in letters):
            raise ValueError("only models whose characters are pieces are known")
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * len(self.piece)
        for p, k in self.id.items():
            self.automaton.add_word(p, k)
            self.shorter[k] = next((self.id[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id), -1)
        self.automaton.make_automaton()
        # A bit for each two letters that some piece holds side by side; letter 0 is any other character.
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        near = np.zeros(self.letters * self.letters, bool)
        near[[int(self.letter[ord(x)]) * self.letters + int(self.letter[ord(y)]) for p in self.id for x, y in zip(p, p[1:])]] = True
        self.near = np.packbits(near, bitorder="little")
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        # What each id stands for: nothing for control pieces, bytes for byte pieces.
        self.text = [b"" if p.type == CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for p in spec.pieces]
        if spec.trainer_spec.unk_id >= 0:
            self.text[spec.trainer_spec.unk_id] = spec.trainer_spec.unk_surface.encode()
        self.spaced = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in spec.pieces])
        self.is_control = np.array([p.type == CONTROL for p in spec.pieces])

    def merged(self, text: str) -> list[str]:
        """``text`` by joining the neighbours of best score, leftmost first, until none can be joined."""
        piece: list[str | None] = list(text)
        right = [*range(1, len(piece)), -1]
        left = [-1, *range(len(piece) - 1)]
        heap: list[tuple[float, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                both = piece[a] + piece[b]
                if both in self.score:
                    heapq.heappush(heap, (-self.score[both], a, both))

        for k in range(len(piece) - 1):
            offer(k, k + 1)
        while heap:
            _, a, both = heapq.heappop(heap)
            b = right[a]
            # A place whose piece or neighbour has changed since makes no such join any more.
            if piece[a] is None or b < 0 or piece[a] + piece[b] != both:
                continue
            piece[a], piece[b] = both, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in piece if p is not None]

    def stands(self, last: int, k: int) -> bool:
        """Whether encoding the two pieces together gives the two; -1 for ``last`` is the beginning."""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        pair = [self.piece[k]] if last < 0 else [self.piece[last], self.piece[k]]
        got = self.pairs[last << 32 | k] = self.merged("".join(pair)) == pair
        return got

    def pieces(self, text: str) -> list[int]:
        """The pieces of ``text``, all characters of which are pieces, by backtracking."""
        n, size, shorter, pairs = len(text), self.size, self.shorter, self.pairs
        longest = [-1] * n
        for stop, k in self.automaton.iter(text):
            longest[stop - size[k] + 1] = k  # ends ascend, so the longest comes last
        out: list[int] = []
        failed = None
        at, last, k = 0, -1, longest[0]
        while at < n:
            while k >= 0:
                stop = at + size[k]
                if failed is None or not failed[stop >> 3] >> (stop & 7) & 1:
                    stands = pairs.get(last << 32 | k)
                    if self.stands(last, k) if stands is None else stands:
                        break
                k = shorter[k]
            if k >= 0:
                out.append(k)
                at, last = stop, k
                k = longest[at] if at < n else -1
            else:
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                at -= size[last]
                k = shorter[out.pop()]
                last = out[-1] if out else -1
        return out

    def ids(self, stretch: str) -> bytes:
        """The ids of a stretch, four bytes each; a character that no piece holds gives its bytes."""
        if self.letter[ord(stretch[0])]:
            k = self.id.get(stretch) if len(stretch) == 1 else None
            return np.array([k] if k is not None else self.pieces(stretch), np.int32).tobytes()
        return np.array([self.byte[b] for b in stretch.encode()], np.int32).tobytes()

    def seams(self, text: str) -> list[int]:
        """Where stretches of ``text`` end, its own end included."""
        c = self.letter[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)
        pair = c[:-1] * self.letters + c[1:]
        near = self.near[pair >> 3] >> (pair & 7).astype(np.uint8) & 1
        return [*(np.flatnonzero(near == 0) + 1).tolist(), len(text)]

    def encode(self, text: str) -> np.ndarray:
        """The ids of ``text``, the end id included."""
        out: list[bytes] = []
        if text:
            text = self.prefix + text.replace(" ", SPACE)
            known, at, width = self.known, 0, AT_ONCE
            while at < len(text):
                part = text[at : at + width]
                ends = self.seams(part)
                if at + width < len(text):
                    # What follows may belong to the last stretch.
                    ends.pop()
                    if not ends:
                        width *= 2
                        continue
                a = 0
                for b in ends:
                    s = part[a:b]
                    got = known.get(s)
                    if got is None:
                        got = self.ids(s)
                        if b - a <= LONG:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[s] = got
                    out.append(got)
                    a = b
                at += a
                width = AT_ONCE
        out.append(np.int32(self.end).tobytes())
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: the space before it goes, a byte that belongs to no character becomes U+FFFD; control ids give nothing."""
        parts = list(map(self.text.__getitem__, ids.tolist()))
        first = next((k for k, p in enumerate(parts) if p), None)
        if first is not None and self.prefix and self.spaced[ids[first]]:
            parts[first] = parts[first][1:]
        # Bytes on two sides of a control piece never form one character.
        ends = [*np.flatnonzero(self.is_control[ids]).tolist(), len(parts)]
        return "".join(b"".join(parts[a:b]).decode(errors="each") for a, b in zip([0, *ends], ends))


def _each(error: UnicodeDecodeError) -> tuple[str, int]:
    """One U+FFFD for every byte that begins no character."""
    return "�", error.start + 1


_models: dict[str, Model] = {}


def model(path: str = MODEL) -> Model:
    """The model at ``path``; one per process."""
    if path not in _models:
        import codecs

        codecs.register_error("each", _each)
        _models[path] = Model(path)
    return _models[path]


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for rows, _, _ in tv.pieces(batches, "text"):
            ids = [m.encode(t.as_py() or "") for t in rows.column(1)]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.concatenate(ids)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "ids"])

    return run


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """(id, ids): the ids of every text and the end id after them.

    A null text counts as empty and has the end id only. Rows that repeat are
    encoded each, other columns are ignored, an empty table gives an empty
    result. Texts are read whole; long ones are cut into stretches a megabyte at
    a time, and a text that is one stretch takes some 150 bytes a character.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(_encoder(path), f"id {src.schema['id'].dataType.simpleString()}, ids array<int>")


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            n, at = batch.num_rows, 0
            lists = batch.column(batch.schema.get_field_index("ids"))
            where = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            while at < n:
                # About half a megabyte of ids at a time.
                stop = min(n, max(at + 1, int(np.searchsorted(where, where[at] + (1 << 17), "right")) - 1))
                text = [m.decode(flat[where[k] : where[k + 1]]) for k in range(at, stop)]
                part = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], [*part.schema.names, "text"])
                at = stop

    return run


def decode_ids(coded: DataFrame, path: str = MODEL) -> DataFrame:
    """``coded`` (id, ids) with the text of the ids; null ids and no ids give the empty text."""
    src = coded.select("id", F.coalesce("ids", F.expr("cast(array() as array<int>)")).alias("ids"))
    return src.mapInArrow(_decoder(path), f"id {src.schema['id'].dataType.simpleString()}, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (id, ids, text)."""
    return decoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
