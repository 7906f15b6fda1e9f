"""LM scoring by logistic mixing of hashed-context bit predictors.

A text is coded as tokens, a token as bits: the CODED most frequent words (lower-cased A-Z), the end of the text and two
escapes have a Huffman code. One escape leads to the other HEAD words, one to the words beyond. Those have shares of
their counts (beyond HEAD by a join; new words have what words that occur once would, and follow letter by letter), to
which the counts after the word before are added: they meet in buckets, by both words or by the one that is beyond HEAD.
A word beyond HEAD after another has its share only. How much the shares weigh is the best of PRIORS over all training
tokens, each without its own count. Every bit of the code is predicted from counts of zeros and ones in several contexts:
the place in the code, with it the word before, with it the two words before; within a spelled word the one, two and three
letters before. Contexts are hashed to 2^20 slots. The predictions are mixed in the logistic
domain by weights chosen by how much is known of the two richest contexts. The weights start from those that fit all
training documents (for letters: all their words without a code, once each), each bit predicted without its own count:
Newton steps, for which tasks sum slope and curvature of each gate, until a step gains less than ENOUGH of the code
length, PASSES at most. The steps start from what fits one in WARM of the texts, which saves passes over all of them and
decides nothing: only a pass over all ends them. From there every document refines its own copy after each chunk of
tokens, first after 16 and whenever their number has doubled, from CHUNK on after as many each; so a document's score
does not depend on others beside it.

Texts are split into words twice, to count them and to write their symbols, 2 bytes each, to a table that all later
passes read, beside the tokens without a code by bucket. Letters are counted as distinct runs of four. Counts cover all
training documents; those of bits are summed by tree merging, 16 tables at a time. Only tables of fixed size and the HEAD
most frequent words are broadcast; counts of rarer words are joined. Each step gets only what it needs of these, and takes
TEXT_BYTES of text or the bits of AT_ONCE tokens at a time, so that workers stay small.

Defined results: null and empty texts are one end token; null ids are in no fold and are learned from; repeated rows
are scored each; without training documents every count is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import col, stage
from gearsight.llm.textwords import MIX_1, MIX_2, mixed

#: Words whose counts are broadcast, and those of them that have a code of their own.
HEAD, CODED = 1 << 17, 1 << 11
SLOT_BITS = 20
ORDERS = 3
#: Words a worker remembers before it starts anew.
REMEMBERED = 400_000
#: Most steps of the weights that all texts start from, the gain that ends them, and the tokens or runs a task takes at
#: once: the arrays of their bits are what its worker needs besides the tables.
PASSES, ENOUGH, AT_ONCE = 8, 1e-4, 1 << 15
#: One in so many texts finds where the steps over all texts start.
WARM = 16
#: Bytes of text whose words a task takes at once.
TEXT_BYTES = 1 << 21
#: Tokens after which a document refines its weights; the curvature that holds its steps back, and the first ones.
CHUNK, HOLD, START_HOLD = 256, 200.0, 20.0
#: Tokens after which it does so before the first whole chunk.
EARLY = np.array([16, 32, 64, 128, 256])
FAN_IN = 16
PIECE = 1 << 16
END, ESCAPE, LISTED = 0, 1, 2
LOG10 = np.log(10.0)
#: Tokens without a code that a bucket holds on average, and that are sent at once.
BUCKET_TOKENS, SENT_TOKENS = 1 << 19, 1 << 19
#: At least as many as the list has words, and a multiple of PIECE.
HEAD_CELLS = 1 << 17
#: Counts that the words' shares are worth beside those of a context; the best is taken. Without end, no context counts.
PRIORS = np.r_[4.0 ** np.arange(-1, 10), np.inf]
#: Weights of each gate before any is learned.
START = np.tile(np.array([0.8, 0.2, 0.2], np.float32), (16, 1))


def contexts(*parts: np.ndarray) -> np.ndarray:
    """Hash of a context, one for each token or letter."""
    key = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        key = mixed(key * MIX_1 + p.astype(np.uint64) + MIX_2)
    return key


def slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Slot of each bit, from the hash of its context and its place in the code."""
    return slots_of(context, node.astype(np.uint64) * MIX_1)


def slots_of(context: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The same from the hash of the place."""
    out = context ^ place
    out *= MIX_2
    out >>= np.uint64(64 - SLOT_BITS)
    return out.view(np.int64)


TABLE = (ORDERS, 1 << SLOT_BITS, 2)


class Code:
    """Huffman code of symbols 0 to n - 1: for each its inner nodes and bits."""

    def __init__(self, counts: list[int]):
        heap = [(c + 1, s) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}
        nodes = len(counts)
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            up[x], up[y] = (nodes, 0), (nodes, 1)
            heapq.heappush(heap, (a + b, nodes))
            nodes += 1
        node, bit, start = [], [], [0]
        for s in range(len(counts)):
            path, at = [], s
            while at in up:
                path.append(up[at])
                at = up[at][0]
            node += [n for n, _ in reversed(path)]
            bit += [b for _, b in reversed(path)]
            start.append(len(node))
        self.node, self.bit, self.start = np.array(node, np.int64), np.array(bit, np.int8), np.array(start, np.int64)
        self.hashed = self.node.astype(np.uint64) * MIX_1

    def bits(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of bits of each of a sequence of symbols, and where the node and bit of each bit are."""
        first = self.start[symbols]
        size = self.start[symbols + 1] - first
        at = np.repeat(first - np.cumsum(size) + size, size)
        at += np.arange(len(at))
        return size, at


def two_before(symbols: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two before each, plus one; 0 before the text. ``place`` is the token's place in its text."""
    one = np.r_[0, symbols[:-1]][:len(symbols)] + 1
    two = np.r_[0, 0, symbols[:-2]][:len(symbols)] + 1
    return np.where(place > 0, one, 0), np.where(place > 1, two, 0)


def bits_after(code: Code, symbols: np.ndarray, one: np.ndarray,
               two: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Number of bits of each token; bit and the slots of each order, for tokens after ``one`` and ``two``."""
    size, at = code.bits(symbols)
    place = np.take(code.hashed, at)
    return size, np.take(code.bit, at), [np.take(code.node, at), *(
        slots_of(np.repeat(c, size), place) for c in (contexts(one), contexts(one, two)))]


def word_bits(code: Code, symbols: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Token, bit and the slots of each order. ``place`` is the token's place in its text."""
    size, bit, found = bits_after(code, symbols, *two_before(symbols, place))
    return np.repeat(np.arange(len(size)), size), bit, found


def word_bits_in_parts(code: Code, symbols: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Bit and slots of AT_ONCE tokens after the other, however long their texts are."""
    one, two = two_before(symbols, place)
    for at in range(0, len(symbols), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        yield bits_after(code, symbols[part], one[part], two[part])[1:]


def letters_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word and run of each letter of words with a space behind: a number of the letter and the three before it."""
    flat = np.frombuffer(b"".join(w + b" " for w in words), np.uint8).astype(np.int64)
    size = np.array([len(w) + 1 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    run = np.zeros(len(flat), np.int64)
    for k in (3, 2, 1):
        run = run * 257 + np.where(place >= k, np.r_[np.zeros(k, np.int64), flat[:-k]][:len(flat)] + 1, 0)
    return word, run * 256 + flat


def run_bits(run: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bit and slots of the last letter of each run, eight bits a letter."""
    flat, before = run % 256, run // 256
    before = [before // 257 ** k % 257 for k in range(3)]
    shift = np.arange(7, -1, -1)
    bit = (flat[:, None] >> shift) & 1
    # Bits read so far, with a leading one.
    node = (flat[:, None] | 256) >> (shift + 1)
    keys = [contexts(*before[:k]) for k in (1, 2, 3)]
    return bit.ravel().astype(np.int8), [slots(np.repeat(k, 8), node.ravel()) for k in keys]


def tally(table: np.ndarray, bit: np.ndarray, found: list[np.ndarray], times: np.ndarray | int = 1) -> None:
    """Add bits to a table (order, slot, bit)."""
    once, times = np.ndim(times) == 0 and times == 1, np.asarray(times, table.dtype)  # of one type with the table: no casts
    for order, at in enumerate(found):
        cell, out = at * 2 + bit, table[order].reshape(-1)
        if once and cell.max(initial=0) < len(cell):  # few cells, as of the code's nodes alone
            n = np.bincount(cell)
            out[:len(n)] += n.astype(table.dtype)
        else:
            np.add.at(out, cell, times)


#: Counts from which on a context is known a little, well, very well.
KNOWN = (1, 4, 32)


def marked(logits: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Predictions whose last two bits say how much is known: one look-up finds both."""
    return ((logits.astype(np.float32).view(np.uint32) & np.uint32(0xFFFFFFFC)) | known.astype(np.uint32)).view(np.float32)


def looked_up(logits: np.ndarray, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Predictions (order, bit) and the gate of each bit."""
    out = np.empty((len(found), len(found[0])), np.float32)
    for k, at in enumerate(found):
        np.take(logits[k], at, out=out[k], mode="clip")  # no slot lies outside; only this mode writes without a copy
    mark = (out[1:3].view(np.uint32) & np.uint32(3)).astype(np.uint8)
    return out, mark[0] * np.uint8(4) + mark[1]


class Predictors:
    """What a table (order, slot, bit) of counts predicts, in the logistic domain, and how much is known."""

    def __init__(self, table: np.ndarray):
        self.logits = np.empty(table.shape[:2], np.float32)
        flat, cells = self.logits.reshape(-1), table.reshape(-1, 2)
        for at in range(0, len(flat), PIECE):
            n0, n1 = cells[at:at + PIECE].T
            flat[at:at + PIECE] = marked(np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4))), np.digitize(n0 + n1, KNOWN))

    def __call__(self, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return looked_up(self.logits, found)


class Known:
    """The same with each bit taken out of its own counts, which come in pieces of a table of ``shape``."""

    def __init__(self, pieces: Iterable[np.ndarray], shape: tuple[int, ...]):
        self.logits = np.empty((shape[0], shape[1] * 2), np.float32)
        flat, at = self.logits.reshape(-1, 2), 0
        for cells in pieces:
            n0, n1 = cells.reshape(-1, 2).T
            out = flat[at:at + len(n0)]
            known = np.digitize(np.maximum(n0 + n1 - 1, 0), KNOWN)
            out[:, 0] = marked(np.log((n1 + np.float32(0.4)) / (np.maximum(n0 - 1, 0) + np.float32(0.4))), known)
            out[:, 1] = marked(np.log((np.maximum(n1 - 1, 0) + np.float32(0.4)) / (n0 + np.float32(0.4))), known)
            at += len(n0)

    def __call__(self, found: list[np.ndarray], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return looked_up(self.logits, [at * 2 + own for at in found])


def inputs_without(table: np.ndarray, found: list[np.ndarray], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the bits ``own`` are predicted from without themselves, and their gates."""
    return Known([table], table.shape)(found, own)


def chance(weights: np.ndarray, logits: np.ndarray) -> np.ndarray:
    """Probability of a one."""
    total = weights[:, 0] * logits[0]
    for k in range(1, ORDERS):
        total += weights[:, k] * logits[k]
    return 1 / (1 + np.exp(-np.clip(total, -14, 14)))


class Shipped:
    """A table of counts that is broadcast compressed, in 4 bytes a count if they fit: copies of it lie on every disk.

    It stays so, in pieces: a worker never holds the whole table beside what it predicts.
    """

    def __init__(self, table: np.ndarray):
        self.kind, self.shape = np.int32 if table.max(initial=0) < 1 << 31 else np.int64, table.shape
        flat = table.reshape(-1)
        self.pieces = [zlib.compress(flat[at:at + PIECE].astype(self.kind).tobytes(), 1) for at in range(0, len(flat), PIECE)]

    @cached_property
    def known(self) -> Known:
        out = Known((np.frombuffer(zlib.decompress(p), self.kind) for p in self.pieces), self.shape)
        self.pieces = None
        return out


#: Sums of a gate: code length, slope (order), curvature (order, order).
SUMS = 1 + ORDERS + ORDERS * ORDERS


def slopes(weights: np.ndarray, logits: np.ndarray, gate: np.ndarray, bit: np.ndarray,
           times: np.ndarray | None = None) -> np.ndarray:
    """Code length of the bits of each gate, and its slope and curvature by the weights."""
    order = np.argsort(gate, kind="stable")
    bounds = np.r_[0, np.cumsum(np.bincount(gate, minlength=16))]
    # Predictions of the bit that came, gate by gate.
    right, sign = np.empty(logits.shape, np.float32), np.where(bit == 1, np.float32(1), np.float32(-1))
    for k in range(ORDERS):
        np.take(logits[k] * sign, order, out=right[k], mode="clip")
    n = None if times is None else np.take(times, order).astype(np.float32)
    out = np.zeros((16, SUMS))
    for g in np.flatnonzero(np.diff(bounds)):
        part = slice(bounds[g], bounds[g + 1])
        x = right[:, part]
        odds = np.exp(-np.clip(weights[g].astype(np.float32) @ x, -14, 14))
        cost = np.log(1 + odds)
        miss = odds / (1 + odds)
        bend = miss * (1 - miss)
        if n is not None:
            bend, miss, cost = bend * n[part], miss * n[part], cost * n[part]
        out[g, 0] = cost.sum(dtype=float)
        out[g, 1:1 + ORDERS] = x @ miss
        out[g, 1 + ORDERS:] = ((x * bend) @ x.T).ravel()
    return out


def learn(sources: Sequence[DataFrame], bits: Callable[[pa.RecordBatch], Iterator[tuple]], table: np.ndarray) -> np.ndarray:
    """Weights (gate, order) that fit all bits of the last source, from where those of the ones before it lead."""
    shared, weights = sources[-1].sparkSession.sparkContext.broadcast(Shipped(table)), START.astype(float)
    for source in sources:
        weights = fitted(source, bits, shared, weights)
    shared.destroy()
    return weights.astype(np.float32)


def fitted(source: DataFrame, bits: Callable[[pa.RecordBatch], Iterator[tuple]], shared: Broadcast,
           weights: np.ndarray) -> np.ndarray:
    """Newton steps from ``weights``. A task sends its sums of each gate, added in tasks' order."""
    best, kept, step = np.full(16, np.inf), weights, np.zeros_like(weights)
    for _ in range(PASSES):
        def add(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            total = np.zeros((16, SUMS))
            for batch in batches:
                for bit, found, times in bits(batch):
                    total += slopes(weights, *shared.value.known(found, bit), bit, times)
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                                              "data": pa.array([total.tobytes()], pa.binary())})

        parts = sorted((r.part, bytes(r.data)) for r in source.mapInArrow(add, "part int, data binary").collect())
        total = sum((np.frombuffer(d).reshape(16, SUMS) for _, d in parts), np.zeros((16, SUMS)))
        curved = total[:, 1 + ORDERS:].reshape(16, ORDERS, ORDERS) + START_HOLD * np.eye(ORDERS)
        newton = np.clip(np.linalg.solve(curved, total[:, 1:1 + ORDERS, None])[..., 0], -1, 1)
        # A gate whose code became longer, by more than rounding, goes back half of its last step.
        worse = total[:, 0] > best * (1 + 1e-6)
        step = np.where(worse[:, None], -step / 2, newton)
        best, kept = np.where(worse, best, total[:, 0]), np.where(worse[:, None], kept, weights)
        weights = weights + step
        if not worse.any() and (newton * total[:, 1:1 + ORDERS]).sum() / 2 <= ENOUGH * total[:, 0].sum():
            return weights
    return kept


def steps(cell: np.ndarray, cells: int, error: np.ndarray, p: np.ndarray, logits: np.ndarray,
          hold: float) -> np.ndarray:
    """Step of the weights of each cell: the slope of the code length over its curvature, half of it, at most 0.2."""
    out = np.empty((cells, ORDERS), np.float32)
    unsure = p * (1 - p)
    for k in range(ORDERS):
        slope = np.bincount(cell, weights=error * logits[k], minlength=cells)
        bend = np.bincount(cell, weights=unsure * logits[k] * logits[k], minlength=cells)
        out[:, k] = np.clip(0.5 * slope / (ORDERS * bend + hold), -0.2, 0.2)
    return out


class Scorer:
    def __init__(self, words: list[bytes], counts: np.ndarray, tokens: int, ends: int, single: int = 0):
        """From the most frequent words with their counts, most frequent first, and the counts of tokens and ends.

        ``single`` words beyond those occur once: as many of the tokens there would be new without their own count.
        """
        self.words = pa.array(words, pa.binary())
        n_coded, n_listed = int(counts[:CODED].sum()), int(counts[CODED:].sum())
        n_rare = tokens - ends - n_coded - n_listed
        self.code = Code([ends, n_rare, n_listed, *counts[:CODED].tolist()])
        # Logarithms: of the chance that a word beyond the list is new, and of what a known one has for each of its counts.
        self.new = np.log((single + 1) / (n_rare + 2)) if n_rare else 0.0
        self.old = np.log((n_rare + 1 - single) / (n_rare + 2) / n_rare) if n_rare else 0.0
        # By place in the list; the last entry is for words that are not in it.
        place = np.arange(len(words))
        self.symbol = np.r_[np.where(place < CODED, place + LISTED + 1, LISTED), ESCAPE]
        self.count = np.r_[counts, 0].astype(np.int64)
        self.log_count = np.log10(self.count + 1.0)
        self.listed = np.r_[np.where(place < CODED, 0.0, np.log(np.maximum(counts, 1) / max(1, n_listed))), 0.0]
        #: Counts of words' bits and of letters', none yet; then what they predict.
        self.tables: tuple = ()
        self.word_weights = self.letter_weights = START
        self.spelled: dict[bytes, float] = {}
        self.buckets = -(-(n_rare + n_listed) // BUCKET_TOKENS) + 15

    def finish(self, weights: Sequence[np.ndarray]) -> None:
        """Weights of words and of letters, if there are any; then predictions take the place of the counts."""
        if len(weights):
            self.word_weights, self.letter_weights = weights
        self.tables = tuple(map(Predictors, self.tables))

    def only(self, table: int, *fields: str) -> Scorer:
        """A copy that has one of the tables and these fields, for workers that need no more."""
        out = object.__new__(Scorer)
        out.__dict__ = {f: getattr(self, f) for f in fields} | {
            "tables": tuple(t if k == table else None for k, t in enumerate(self.tables))}
        return out

    def tokens_of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, place, place in the list of words, and symbol of all tokens; a text ends with an empty word."""
        size = np.array([len(t) for t in texts], np.int64)
        words = pa.array(list(chain.from_iterable(texts)), pa.binary())
        return self.tokens(self.find(words)[0].astype(np.int64), size)

    def tokens(self, listed: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same from the places of all tokens in the list, with their ends, and the texts' numbers of tokens."""
        text = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(listed)) - np.repeat(np.cumsum(size) - size, size)
        symbol = self.symbol[listed]
        symbol[np.cumsum(size) - 1] = END
        return text, place, listed, symbol

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word in the list, or -1, and of the words beyond it a hash of 31 bits."""
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        beyond = words.filter(pa.array(place < 0)).to_pylist()
        return place, np.fromiter(map(zlib.crc32, beyond), np.int64, len(beyond)) >> 1

    def spell(self, words: set[bytes]) -> None:
        new = list(words.difference(self.spelled))
        for at in range(0, len(new), 5000):
            part = new[at:at + 5000]
            word, run = letters_of(part)
            run, which = np.unique(run, return_inverse=True)
            bit, found = run_bits(run)
            logits, gate = self.tables[1](found)
            p = chance(self.letter_weights[gate], logits)
            logs = np.log(np.where(bit == 1, p, 1 - p)).reshape(-1, 8).sum(axis=1)
            self.spelled.update(zip(part, np.bincount(word, weights=logs[which], minlength=len(part)).tolist()))

    def spelled_logs(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of the probability of each word by its letters."""
        if len(self.spelled) > REMEMBERED:
            self.spelled.clear()
        self.spell(set(words))
        return np.fromiter(map(self.spelled.__getitem__, words), float, len(words))

    def score(self, symbols: list[bytes]) -> np.ndarray:
        """Natural logarithm of the probability of each text's symbols."""
        symbol, place, text = laid_out(symbols)
        one, two = two_before(symbol, place)
        chunk = np.where(place < CHUNK, np.searchsorted(EARLY, place, side="right"), len(EARLY) - 1 + place // CHUNK)
        # Tokens by chunk; those of texts that end in it, whose weights are not needed again, last.
        key = chunk * 2 + (chunk == chunk[np.cumsum(np.bincount(text)) - 1][text])
        order = np.argsort(key.astype(np.int16) if key.max() < 1 << 15 else key, kind="stable")  # short ones by digits
        bounds = np.searchsorted(key[order], np.arange(key.max() + 2))
        weights, logs = np.tile(self.word_weights, (len(symbols), 1)), np.zeros(len(symbols))
        for c in range(0, len(bounds) - 1, 2):
            at = order[bounds[c]:bounds[c + 2]]
            size, bit, found = bits_after(self.code, symbol[at], one[at], two[at])
            logits, gate = self.tables[0](found)
            cell = np.repeat(text[at] * 16, size) + gate
            p = chance(np.stack([np.take(weights[:, k], cell) for k in range(ORDERS)]).T, logits)
            logs += np.bincount(cell >> 4, weights=np.log(np.where(bit == 1, p, 1 - p)), minlength=len(symbols))
            on = slice(int(size[:bounds[c + 1] - bounds[c]].sum()))
            if on.stop:
                weights += steps(cell[on], len(weights), bit[on] - p[on], p[on], logits[:, on], HOLD)
        return logs


def laid_out(symbols: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, place and text of all tokens of texts given by their symbols, 2 bytes each."""
    size = np.array([len(x) // 2 for x in symbols], np.int64)
    symbol = np.frombuffer(b"".join(symbols), np.int16).astype(np.int64)
    return symbol, np.arange(len(symbol)) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(len(size)), size)


def after(text: np.ndarray, place: np.ndarray, listed: np.ndarray, symbol: np.ndarray, hashes: np.ndarray,
          start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word and word before of all tokens without a code: places in the list, or below zero a hash of 31 bits.

    ``hashes`` are those of the words beyond the list; the word before the first one is ``start``.
    """
    number = listed.astype(np.int32)
    beyond = symbol == ESCAPE
    number[beyond] = -1 - hashes
    at = np.flatnonzero((symbol == LISTED) | beyond)
    return text[at], number[at], np.where(place[at] > 0, number[at - 1], start).astype(np.int32)


def bucket_of(word: np.ndarray, before: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a token: by the rare one of the two words, the token's own first, or by both if none is rare."""
    by_word, by_before = (word < 0) | (before >= 0), (word >= 0)
    key = contexts(np.where(by_word, word, 0).astype(np.int64), np.where(by_before, before, 0).astype(np.int64))
    return (key % np.uint64(buckets)).astype(np.int32)


def followed(word: np.ndarray, before: np.ndarray, train: np.ndarray, follow: np.ndarray, listed: np.ndarray,
             old: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens of a bucket: count of the word after the one before, over the word's share; count of the context
    (below zero: not known here); the share. Counts are those of the training texts.

    ``follow`` has the counts of contexts in the list, of listed and of rarer words.
    """
    def counts(key: np.ndarray) -> np.ndarray:
        _, which = np.unique(key, return_inverse=True)
        return np.bincount(which, weights=train)[which]

    pair = counts(word.astype(np.int64) << 32 | before.astype(np.int64) & 0xFFFFFFFF)
    rare = word < 0
    share = np.exp(np.take(listed, np.maximum(word, 0)))
    context = np.where(before < 0, -1.0, follow[rare.astype(np.int64), np.maximum(before, 0)])
    some = rare.nonzero()[0]
    if len(some):
        _, which = np.unique(word[some], return_inverse=True)
        share[some] = np.exp(old) * np.maximum(np.bincount(which, weights=train[some])[which], 1)
    some = (~rare & (before < 0)).nonzero()[0]
    if len(some):
        _, which = np.unique(before[some], return_inverse=True)
        context[some] = np.bincount(which, weights=train[some])[which]
    return pair, context, share


def gain(pair: np.ndarray, context: np.ndarray, share: np.ndarray, prior: np.ndarray | float) -> np.ndarray:
    """Logarithm of what the word before makes of a word's share; 0 where the context is not known."""
    return np.where(context < 0, np.float32(0), np.log((pair / share / prior + 1) / (np.maximum(context, 0) / prior + 1)))


def tree_sum(parts: DataFrame, tasks: int, cells: int) -> np.ndarray:
    """Sum of tables sent in pieces (piece, part, data), by rounds of 16.

    Pieces of tasks are of 4-byte counts. Every sum is of 8-byte ones: all tokens meet in the one cell of the code's root.
    """
    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PIECE, np.int64)
        for data in rows["data"]:
            total += np.frombuffer(data, np.int32 if len(data) == 4 * PIECE else np.int64)
        return pd.DataFrame({"piece": [key[0]], "part": [key[1]], "data": [total.tobytes()]})

    while True:
        tasks = -(-tasks // FAN_IN)
        parts = parts.groupBy("piece", (F.col("part") / FAN_IN).cast("int").alias("to")).applyInPandas(
            add, "piece int, part int, data binary")
        if tasks <= 1:
            break
    out = np.zeros(cells, np.int64)
    for piece, _, data in parts.toLocalIterator():
        out[piece * PIECE:(piece + 1) * PIECE] = np.frombuffer(data, np.int64)
    return out


def sent(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    flat, part = table.ravel(), TaskContext.get().partitionId()
    for piece in range(len(flat) // PIECE):
        data = flat[piece * PIECE:(piece + 1) * PIECE]
        if data.any():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "part": pa.array([part], pa.int32()),
                                              "data": pa.array([data.tobytes()], pa.binary())})


def by_bytes(batch: pa.RecordBatch, at: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in parts of so many bytes of text, or of one longer text."""
    size, row = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(), dtype=np.int64), 0
    while row < len(size):
        end = max(row + 1, int(np.searchsorted(size, (size[row - 1] if row else 0) + most, side="right")))
        yield batch.slice(row, end - row)
        row = end


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts, and how many each has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, size = parts.flatten(), np.diff(parts.offsets.to_numpy())
    some = pc.binary_length(words).to_numpy() > 0  # spaces at a text's ends leave empty words
    if not some.all():
        size = np.bincount(np.repeat(np.arange(len(size)), size)[some], minlength=len(size))
        words = words.filter(pa.array(some))
    return words.cast(pa.binary()), size


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the probability),
    bits_per_byte (total bits of the text by its UTF-8 bytes; null where it has none)."""
    spark = docs.sparkSession
    id_ = col(id_col)
    held_out = F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
    rows = docs.select(id_.alias("id"), held_out.alias("held_out"), col(text_col).alias("text"))
    train = rows.filter("NOT held_out").select("text")
    piece_schema = "piece int, part int, data binary"

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's counts of a word are added up before they are sent.
        for batch in batches:
            for part in by_bytes(batch, 0, 2 * TEXT_BYTES):
                found = words_in(part.column(0))[0].value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])
            # The end of a text is counted as the empty word.
            yield pa.RecordBatch.from_arrays([pa.array([b""]), pa.array([batch.num_rows], pa.int64())], names=["word", "n"])

    counts = stage(train.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")),
                   "word-counts")
    total, kinds, ends, single = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(
        F.octet_length("word") == 0, F.col("n"))), F.lit(0)), F.count_if((F.octet_length("word") > 0) & (F.col("n") == 1))
    ).first()
    top = counts.filter(F.octet_length("word") > 0).orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    n = top.column("n").to_numpy()
    scorer = Scorer(top.column("word").to_pylist(), n, total, ends, single - int((n == 1).sum()))
    plan = spark.sparkContext.broadcast(scorer)

    id_type = rows.schema["id"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row, held = plan.value, TaskContext.get().partitionId() << 33, []
        first = row

        def table(n: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in kinds_of],
                                              schema=pa.schema(kinds_of))

        def rest() -> Iterator[pa.RecordBatch]:
            """Tokens without a code, by bucket."""
            doc, word, before = (np.concatenate(x) for x in zip(*held))
            bucket = bucket_of(word, before, m.buckets)
            order = np.argsort(bucket.astype(np.int16) if m.buckets < 1 << 15 else bucket, kind="stable")
            cut = np.r_[np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order)]
            doc, word, before = (x[order] for x in (doc, word, before))
            for at in range(0, len(cut) - 1, 64):
                ends = list(zip(cut[at:at + 64], cut[at + 1:at + 65]))
                yield table(len(ends), bucket=pa.array(bucket[order][[a for a, _ in ends]], pa.int32()),
                            first=pa.array([first] * len(ends), pa.int64()), **{
                                name: pa.array([x[a:b].tobytes() for a, b in ends], pa.binary())
                                for name, x in (("docs", doc), ("words", word), ("before", before))})

        kinds_of = None
        for batch in batches:
            kinds_of = kinds_of or [pa.field("id", batch.column(0).type), *rest_fields]
            for part in by_bytes(batch, 2, TEXT_BYTES):
                words, size = words_in(part.column(2))
                size = size + 1
                ends_at = np.cumsum(size)
                of_words = np.ones(int(ends_at[-1]), bool)
                of_words[ends_at - 1] = False
                listed = np.full(len(of_words), -1)
                listed[of_words], hashes = m.find(words)
                text, place, listed, symbol = m.tokens(listed, size)
                n, logs = m.count[listed], m.log_count[listed]
                n[ends_at - 1], logs[ends_at - 1] = ends, np.log10(ends + 1.0)
                beyond = symbol == ESCAPE
                rare = np.r_[0, np.cumsum(np.bincount(text, weights=beyond, minlength=len(size)))].astype(np.int32)
                sums = [np.bincount(text, weights=w, minlength=len(size))
                        for w in (n > 0, logs, m.listed[listed])]
                yield table(
                    len(size), id=part.column(0), held_out=part.column(1), n_tokens=pa.array(size.astype(np.int64)),
                    n_bytes=pc.coalesce(pc.binary_length(part.column(2)).cast(pa.int64()), pa.scalar(0, pa.int64())),
                    known=pa.array(sums[0].astype(np.int64)), logs=pa.array(sums[1]), plain=pa.array(sums[2]),
                    symbols=pa.Array.from_buffers(pa.binary(), len(size), [None, *map(pa.py_buffer, (
                        (np.r_[0, ends_at] * 2).astype(np.int32), symbol.astype(np.int16)))]),
                    tail=pa.ListArray.from_arrays(pa.array(rare), words.take(pa.array(np.flatnonzero(beyond[of_words])))),
                    row=pa.array(np.arange(row, row + len(size))))
                of, word, before = after(text, place, listed, symbol, hashes, len(m.words))
                # The last bit of a document says that it is held out.
                held.append((((of + row - first) * 2 + part.column(1).to_numpy(zero_copy_only=False)[of]).astype(np.int32),
                             word, before))
                row += len(size)
                if sum(len(h[1]) for h in held) >= SENT_TOKENS:
                    yield from rest()
                    held, first = [], row
        if held:
            yield from rest()

    rest_fields = [pa.field(*f) for f in (
        ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()),
        ("logs", pa.float64()), ("plain", pa.float64()), ("symbols", pa.binary()), ("tail", pa.list_(pa.binary())),
        ("row", pa.int64()), ("bucket", pa.int32()), ("first", pa.int64()), ("docs", pa.binary()), ("words", pa.binary()),
        ("before", pa.binary()))]
    written = stage(rows.mapInArrow(
        code, f"id {id_type}, held_out boolean, n_tokens long, n_bytes long, known long, logs double, plain double, "
        "symbols binary, tail array<binary>, row long, bucket int, first long, docs binary, words binary, before binary"),
        "symbols")
    rest = written.filter("bucket IS NOT NULL").select("bucket", "first", "docs", "words", "before")
    coded = written.filter("bucket IS NULL").drop("bucket", "first", "docs", "words", "before")

    def contexts_of_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, 2 * HEAD_CELLS), np.int32)
        for batch in batches:
            for cells in zip(*batch.columns):
                doc, word, before = (np.frombuffer(c.as_buffer(), np.int32) for c in cells)
                for rare in (0, 1):
                    found = before[(before >= 0) & (doc & 1 == 0) & ((word < 0) == rare)]
                    np.add.at(table[rare], found, np.int32(1))
        yield from sent(table)

    def bucket_arrays(cells: pd.DataFrame, follow: tuple) -> tuple[np.ndarray, ...]:
        doc, word, before = (np.frombuffer(b"".join(cells[c]), np.int32) for c in ("docs", "words", "before"))
        train = (doc & 1 == 0).astype(float)
        return doc, word, train, *followed(word, before, train, *follow)

    def try_priors(cells: pd.DataFrame) -> pd.DataFrame:
        """Gain of each prior over all training tokens, each without its own count; listed words and rarer ones apart."""
        _, word, train, pair, context, share = bucket_arrays(cells, shared.value)
        own = (train > 0) & (context >= 0)
        rare = word[own] < 0
        # Half the bytes do for a choice of priors.
        ratio, context = ((pair[own] - 1) / share[own]).astype(np.float32), (context[own] - 1).astype(np.float32)
        # The same as gain(), by fewer operations.
        found = [[np.log((ratio[at] + prior) / (context[at] + prior)).sum(dtype=float) if prior < np.inf else 0.0
                  for prior in PRIORS.astype(np.float32)] for at in (~rare, rare)]
        return pd.DataFrame({"bucket": [int(cells["bucket"].iloc[0])], "sums": [np.array(found).tobytes()]})

    def gains(cells: pd.DataFrame) -> pd.DataFrame:
        doc, word, _, pair, context, share = bucket_arrays(cells, shared.value)
        found = gain(pair, context, share, np.where(word < 0, *prior[::-1])).astype(np.float32)
        ends = np.r_[0, np.cumsum([len(d) // 4 for d in cells["docs"]])]
        return pd.DataFrame({"first": cells["first"], "docs": cells["docs"],
                             "logs": [found[a:b].tobytes() for a, b in zip(ends, ends[1:])]})

    def by_document(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        doc = np.frombuffer(b"".join(cells["docs"]), np.int32) >> 1
        logs = np.bincount(doc, weights=np.frombuffer(b"".join(cells["logs"]), np.float32))
        return pd.DataFrame({"row": key[0] + np.arange(len(logs)), "rest": logs})

    follow = tree_sum(rest.select("docs", "words", "before").mapInArrow(contexts_of_list, piece_schema),
                      rest.rdd.getNumPartitions(), 4 * HEAD_CELLS).reshape(2, -1)
    shared = spark.sparkContext.broadcast((follow, scorer.listed, scorer.old))
    tried = stage(rest.groupBy("bucket").applyInPandas(try_priors, "bucket int, sums binary"), "priors").orderBy("bucket")
    best = sum((np.frombuffer(r.sums).reshape(2, -1) for r in tried.toLocalIterator()), np.zeros((2, len(PRIORS))))
    prior = PRIORS[best.argmax(axis=1)]
    gained = stage(rest.groupBy("bucket").applyInPandas(gains, "first long, docs binary, logs binary")
                   .groupBy("first").applyInPandas(by_document, "row long, rest double"), "gains")
    shared.destroy()

    plan.unpersist()
    with_code, tree = frozenset([b"", *scorer.words[:CODED].to_pylist()]), spark.sparkContext.broadcast(scorer.code)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w for w in batch.column(0).to_pylist() if w not in with_code]
            for at in range(0, len(words), 100_000):
                run, n = np.unique(letters_of(words[at:at + 100_000])[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(n.astype(np.int64))], names=["run", "n"])

    def bits_of_texts(batch: pa.RecordBatch) -> Iterator[tuple]:
        for at in range(0, batch.num_rows, 400):
            symbol, place, _ = laid_out([x.as_buffer().to_pybytes() for x in batch.column(0).slice(at, 400)])
            for found in word_bits_in_parts(tree.value, symbol, place):
                yield *found, None

    def bits_of_runs(batch: pa.RecordBatch) -> Iterator[tuple]:
        run, n = (c.to_numpy() for c in batch.columns)
        for at in range(0, len(run), AT_ONCE):
            yield *run_bits(run[at:at + AT_ONCE]), np.repeat(n[at:at + AT_ONCE], 8)

    def counted(source: DataFrame, bits: Callable[[pa.RecordBatch], Iterator[tuple]], kind: type) -> np.ndarray:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(TABLE, kind)
            for batch in batches:
                for bit, found, times in bits(batch):
                    tally(table, bit, found, 1 if times is None else times)
            yield from sent(table)

        return tree_sum(source.mapInArrow(count, piece_schema), source.rdd.getNumPartitions(),
                        ORDERS * 2 << SLOT_BITS).reshape(TABLE)

    learned = coded.filter("NOT held_out").select("symbols")
    spelled = stage(counts.select("word").mapInArrow(runs, "run long, n long").groupBy("run").agg(
        F.sum("n").alias("n")), "letter-runs")
    scorer.tables = counted(learned, bits_of_texts, np.int32), counted(spelled, bits_of_runs, np.int64)
    some = stage(learned.filter(F.pmod(F.xxhash64("symbols"), F.lit(WARM)) == 0), "first-steps")
    weights = [learn([some, learned], bits_of_texts, scorer.tables[0]), learn([spelled], bits_of_runs, scorer.tables[1])]
    tree.unpersist()
    scorer.finish(weights)
    # Of tables, codes and lists, workers hold only what their step needs.
    model = spark.sparkContext.broadcast(scorer.only(0, "code", "word_weights"))
    speller = spark.sparkContext.broadcast(scorer.only(1, "letter_weights", "spelled"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                logs = model.value.score([x.as_buffer().to_pybytes() for x in part.column(2)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(logs + part.column(1).to_numpy())],
                                                 names=["row", "coded_logs"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(speller.value.spelled_logs(batch.column(1).to_pylist()))],
                                             names=["row", "logs"])

    scored = stage(coded.select("row", "plain", "symbols").mapInArrow(score, "row long, coded_logs double"), "scored")
    tails = coded.select("row", F.explode("tail").alias("word"))
    rare = counts.filter(F.octet_length("word") > 0).select("word", F.col("n").alias("c"))
    met = stage(tails.join(rare, "word", "left").select("row", F.when(F.col("c").isNull(), F.col("word")).alias("new"), "c"),
                "rare-words")
    known = met.filter("c IS NOT NULL").groupBy("row").agg(
        F.count("c").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_logs"),
        F.sum(F.log(F.col("c")) + F.lit(float(scorer.old))).alias("shares"))
    spelled = met.filter("c IS NULL").select("row", "new").mapInArrow(spell, "row long, logs double").groupBy("row").agg(
        F.sum(F.col("logs") + F.lit(float(scorer.new))).alias("letters"))
    out = coded.drop("tail", "symbols").join(scored, "row")
    for found in (known, spelled, gained):
        out = out.join(found, "row", "left")
    out = out.withColumn("score", sum((F.coalesce(c, F.lit(0.0)) for c in ("shares", "letters", "rest")), F.col("coded_logs"))
                         / float(LOG10))
    per_token = F.log10(F.lit(float(total + kinds + 1)))
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * per_token
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens",
                      (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                      F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
                      (-F.col("score") * float(np.log2(10)) / F.nullif("n_bytes", F.lit(0))).alias("bits_per_byte"))
