"""SentencePiece encoding and decoding by streaming Viterbi over the scores of a piece model.

The best segmentation is found from left to right. Only boundaries within the longest piece of the end can still be
extended, so only their back pointers are kept; as soon as all of them lead through one boundary, the ids before it
are final and leave the window. No piece of the model holds a space after another letter, so paths always converge
before a space: the segmentation of a word does not depend on what stands around it. Workers remember it, and find the
paths of many new short words at a time, one end position after the other; long ones and those with letters outside
the vocabulary go through the stream.

Text is read as the models do: a space is put before it and spaces are written as U+2581. Letters without a piece of
their own are spelled in byte pieces. Of equal scores the longer last piece wins. For models trained by merging, the
result is the segmentation of the highest score, which can differ from the order of merges; decoding is exact either
way, but for a U+2581 in the text, which comes back as a space.

Defined results: null counts as empty; empty texts have no ids; repeated rows are encoded each; an empty table gives
an empty result; result columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import col, packed, unpacked

REMEMBERED = 900_000
#: Stretches up to this length are segmented many at a time.
SHORT = 40
SPACE = "▁"
MADE = ("ids", "n_ids", "decoded")


HASH_BASE = np.uint64(0x9E3779B97F4A7C15)


def text_hash(text: str) -> np.uint64:
    out = 0
    for letter in text:
        out = (out * int(HASH_BASE) + ord(letter) + 1) & ((1 << 64) - 1)
    return np.uint64(out)


#: Marks cuts while a text is split; a text that holds it, or runs of spaces, is split by a pattern.
CUT = "\x1f"


def stretches_of(text: str, spelled: str = "\n") -> list[str]:
    """Runs of spaces, each with the letters up to the next one, the first with the added space; letters of ``spelled``,
    which no piece holds, stand alone."""
    if not text:
        return []
    text = SPACE + text.replace(" ", SPACE)
    if CUT in text or SPACE + SPACE in text:
        return re.findall(f"{SPACE}+[^{SPACE}{spelled}]*|[{spelled}]|[^{SPACE}{spelled}]+" if spelled else
                          f"{SPACE}+[^{SPACE}]*", text)
    text = text.replace(SPACE, CUT + SPACE)
    for letter in spelled:
        text = text.replace(letter, CUT + letter + CUT)
    return list(filter(None, text.split(CUT)))


class Pieces(dict):
    """The model at ``path``: ids of a stretch of text (little-endian 32-bit), remembered by stretch."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        self.bytes_of = [b""] * len(size)
        self.byte_ids = [model.unk_id()] * 256
        self.score: dict[str, tuple[float, int]] = {}
        for i in size:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte = int(piece[1:-1], 16)
                self.byte_ids[byte], self.bytes_of[i] = i, bytes([byte])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[piece], self.bytes_of[i] = (model.get_score(i), i), piece.encode()
        self.longest = max(map(len, self.score), default=1)
        self.heads = {p[:n] for p in self.score for n in range(1, len(p) + 1)}
        self.splits_at_space = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score)
        # Every head of a piece by hash, with the id and score of the piece that it is, if it is one.
        order = sorted((int(text_hash(h)), self.score.get(h, (0.0, -1))) for h in self.heads)
        self.hashes = np.array([h for h, _ in order], np.uint64)
        self.scores = np.array([s for _, (s, _) in order])
        self.ids = np.array([i for _, (_, i) in order], np.int32)
        self.alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.score))
        # A letter spelled in bytes costs more than any way to write it in pieces.
        self.spelled = 10 * min((s for s, _ in self.score.values()), default=-1.0) - 1

    def stream(self, letters: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of letters, each as soon as it is certain."""
        text = ""  # letters from the last committed boundary on
        best, back = [0.0], [(0, ())]  # by boundary: score, and the boundary before with the ids between
        for letter in letters:
            text += letter
            end, top, source, ids = len(text), None, 0, ()
            for start in range(max(0, end - self.longest), end):
                known = self.score.get(text[start:])
                if known and (top is None or best[start] + known[0] > top):
                    top, source, ids = best[start] + known[0], start, (known[1],)
            if top is None:
                top, source = best[end - 1] + self.spelled, end - 1
                ids = tuple(self.byte_ids[b] for b in letter.encode())
            best.append(top)
            back.append((source, ids))
            # Boundaries from which a piece can still end behind this letter: text must go on to be a head of a piece.
            alive = [b for b in range(max(0, end + 1 - self.longest), end) if text[b:] in self.heads] + [end]
            while len({b for b in alive}) > 1:
                alive = sorted({*alive[:-1], back[alive[-1]][0]})
            cut = alive[0]
            if cut:
                yield from self.path(back, cut)
                text = text[cut:]
                base = best[cut]
                best = [s - base for s in best[cut:]]
                back = [(0, ()), *((max(0, s - cut), i) for s, i in back[cut + 1:])]
        yield from self.path(back, len(text))

    @staticmethod
    def path(back: list[tuple[int, tuple[int, ...]]], at: int) -> list[int]:
        out: list[tuple[int, ...]] = []
        while at:
            at, ids = back[at]
            out.append(ids)
        return [i for ids in reversed(out) for i in ids]

    def __missing__(self, stretch: str) -> bytes:
        out = self[stretch] = np.fromiter(self.stream(stretch), "<i4").tobytes()
        return out

    def learn(self, stretches: list[str]) -> None:
        """Best paths of many short stretches, each held in one row of a matrix by place."""
        lengths = np.array([len(s) for s in stretches])
        rows, width = len(stretches), int(lengths.max())
        letters = np.zeros((rows, width), np.uint64)
        letters[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(stretches).encode("utf-32-le"), "<u4")
        best = np.full((rows, width + 1), -np.inf)
        best[:, 0] = 0
        source, piece = np.zeros((rows, width + 1), np.int32), np.zeros((rows, width + 1), np.int32)
        # Places whose letters up to ``size`` are the head of a piece, with the hash of these letters.
        row, at = np.nonzero(np.arange(width) < lengths[:, None])
        code = np.zeros(len(row), np.uint64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for size in range(1, min(self.longest, width) + 1):
            code = code * HASH_BASE + letters[row, at + size - 1] + np.uint64(1)
            k = np.minimum(np.searchsorted(self.hashes, code), len(self.hashes) - 1)
            is_head = self.hashes[k] == code
            row, at, code, k = row[is_head], at[is_head], code[is_head], k[is_head]
            is_piece = self.ids[k] >= 0
            score = np.full((rows, width), -np.inf)
            ids = np.zeros((rows, width), np.int32)
            score[row[is_piece], at[is_piece]] = self.scores[k[is_piece]]
            ids[row[is_piece], at[is_piece]] = self.ids[k[is_piece]]
            found.append((score, ids))
            goes_on = at + size < lengths[row]
            row, at, code = row[goes_on], at[goes_on], code[goes_on]
            if not len(row):
                break
        for end in range(1, width + 1):
            for size in range(min(len(found), end), 0, -1):
                score, ids = found[size - 1]
                here = best[:, end - size] + score[:, end - size]
                better = here > best[:, end]
                best[better, end] = here[better]
                source[better, end], piece[better, end] = end - size, ids[better, end - size]
        out = np.zeros((rows, width), "<i4")
        at, filled = lengths.copy(), np.zeros(rows, np.int64)
        whole = np.isfinite(best[np.arange(rows), lengths])
        while (live := np.flatnonzero((at > 0) & whole)).size:
            filled[live] += 1
            out[live, width - filled[live]] = piece[live, at[live]]
            at[live] = source[live, at[live]]
        for i, s in enumerate(stretches):
            if whole[i]:
                self[s] = out[i, width - filled[i]:].tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        if not self.splits_at_space:
            return [np.fromiter(self.stream(SPACE + t.replace(" ", SPACE)), "<i4").tobytes() if t else b"" for t in texts]
        parts = [stretches_of(t, self.alone) for t in texts]
        if len(self) >= REMEMBERED:
            self.clear()
        new = sorted({s for p in parts for s in p if len(s) <= SHORT}.difference(self), key=len)
        for at in range(0, len(new), 4096):
            self.learn(new[at:at + 4096])
        return [b"".join(map(self.__getitem__, p)) for p in parts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).replace(SPACE.encode(), b" ")
        return raw[1:].decode(errors="replace")


MODELS: dict[str, Pieces] = {}


def model_at(path: str) -> Pieces:
    if path not in MODELS:
        MODELS[path] = Pieces(path)
    return MODELS[path]


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with ids and n_ids."""
    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        pieces = model_at(model)
        found = []
        for at in range(0, len(texts), 600):
            found += pieces.encode_all([t or "" for t in texts.slice(at, 600).to_pylist()])
        bounds = np.cumsum([0, *(len(f) // 4 for f in found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(found), "<i4")))

    rows = packed(docs, text=col(text_col)).withColumn("ids", ids("text"))
    return unpacked(rows.withColumn("n_ids", F.size("ids").cast("long")), docs.columns, "ids", "n_ids")


def decode(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """All rows with the text of their ids as ``decoded``; null ids give null."""
    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        pieces = model_at(model)
        return pa.array([pieces.decode(i.values.to_numpy()) if i.is_valid else None for i in ids], pa.string())

    return unpacked(packed(rows, ids=col(ids_col)).withColumn("decoded", text("ids")), rows.columns, "decoded")
