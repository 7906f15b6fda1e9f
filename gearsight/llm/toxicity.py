"""Toxicity: two Kneser-Ney models of the letters of words, one of toxic and one of ordinary text, compared per word.

A letter is predicted from up to five letters before it within its word, so inflected and rare forms share what is
known of their stem. Each level interpolates the class's own counts with the next shorter context, the last one with
one Kneser-Ney distribution of both classes (after how many different letters a letter occurs). The weight of the own
counts is (e - D) / (e + BACKOFF), where e is the count that the smaller class would have if the classes were alike: it
is the same in both classes, so a rare expression backs off to the shared counts on both sides alike and tells little.
Counts are hashed to 2^22 slots, so the model has a fixed size whatever the corpus. A text's evidence is the difference
of the two log-likelihoods divided by its number of words. A logistic curve of two parameters, fitted on labelled
documents whose words were not counted, turns it into a score.

At most ``max_train`` labelled documents of each class are used, those of the smallest id hash; this bounds the join of
texts with labels to a broadcast of known size.

Defined results: null and empty texts have no evidence and get the score of evidence 0; null labels and null ids are
not learned from; a document labelled more than once is toxic if any label says so; without labels of both classes
the evidence itself goes through the curve; repeated rows are scored each; an empty table gives an empty result;
result columns replace input columns of the same name.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import col, packed, stage, unpacked
from gearsight.llm.textwords import MIX_1, MIX_2, REMEMBERED, mixed, words_of

SLOT_BITS = 22
#: Letters (bytes) of context at most, and the marks of the start and end of a word.
CONTEXT = 5
OPEN, CLOSE = b"\x01", b"\x02"
DISCOUNT = 0.75
#: Shared counts beside a class's own.
BACKOFF = 4.0
#: Slots with less in both classes together never get an own weight.
LEAST = 3
MADE = ("score", "predicted")
STEP = np.uint64(0x9E3779B97F4A7C15)


def normal(word: bytes) -> bytes:
    text = word.decode().lower()
    return (text.strip(string.punctuation) or text).encode()


def levels(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each context length: word and letter of all places that have it, slots of context + letter and of context."""
    flat = np.frombuffer(b"".join(OPEN + w + CLOSE for w in words), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    context = np.zeros(len(flat), np.uint64)
    power = np.uint64(1)
    for k in range(CONTEXT + 1):
        if k:
            power = power * STEP
            context[k:] += flat[:-k] * power
        at = np.flatnonzero(place >= max(1, k))
        c = context[at] + np.uint64(k + 1) * MIX_2
        yield (at, word[at], slot(c + flat[at] * MIX_1), slot(c))


def slot(x: np.ndarray) -> np.ndarray:
    return (mixed(x) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class Model:
    """Counts of the slots for class 0 (ordinary) and 1 (toxic), and the shared distribution of letters."""

    counts: np.ndarray
    shared: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        self.known: dict[bytes, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def ratios(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihood ratio of each word."""
        letters = np.frombuffer(b"".join(OPEN + w + CLOSE for w in words), np.uint8)
        chance = np.stack([self.shared[letters], self.shared[letters]])
        owner = np.zeros(len(letters), np.int64)
        counted = np.zeros(len(letters), bool)
        for at, word, gram, context in levels(words):
            n, whole = self.counts[:, gram], self.counts[:, context]
            expected = n.sum(axis=0) * whole.min(axis=0) / np.maximum(whole.sum(axis=0), 1)
            own = np.maximum(expected - DISCOUNT, 0) / (expected + BACKOFF)
            chance[:, at] = own * n / np.maximum(whole, 1) + (1 - own) * chance[:, at]
            owner[at], counted[at] = word, True
        return np.bincount(owner[counted], weights=np.log(chance[1] / chance[0])[counted], minlength=len(words))

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Mean log-likelihood ratio per word."""
        texts = [words_of(texts, i) for i in range(len(texts))]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for t in texts for w in t}.difference(self.known))
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            self.known.update(zip(part, self.ratios([normal(w) for w in part]).tolist()))
        get = self.known.__getitem__
        return np.array([sum(map(get, t)) / max(1, len(t)) for t in texts])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -500, 500)))


def fold(id_: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(parts)).cast("int")


def counted(train: DataFrame) -> Model:
    """Model of rows (text, toxic): words are summed over the cluster, then their letters in context."""
    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (Counter(), Counter())
            for i in range(batch.num_rows):
                found[batch.column(1)[i].as_py()].update(map(normal, words_of(batch.column(0), i)))
            for c in (0, 1):
                n = pa.array(list(found[c].values()), pa.int64())
                none = pa.array([0] * len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(found[c]), pa.binary()), *((n, none), (none, n))[c]],
                                                 names=["word", "c0", "c1"])

    def count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: slots of letters in context and of contexts; kind 1: pairs of neighbouring letters."""
        for batch in batches:
            for at in range(0, batch.num_rows, 50_000):
                part = batch.slice(at, 50_000)
                words, n = part.column(0).to_pylist(), [part.column(c).to_numpy() for c in (1, 2)]
                slots, owners = [], []
                for _, word, gram, context in levels(words):
                    slots += [gram, context]
                    owners += [word, word]
                found, which = np.unique(np.concatenate(slots), return_inverse=True)
                sums = [np.bincount(which, weights=c[np.concatenate(owners)]).astype(np.int64) for c in n]
                letters = np.frombuffer(b"".join(OPEN + w + CLOSE for w in words), np.uint8).astype(np.int64)
                pairs = np.unique(letters[:-1] << 8 | letters[1:])
                none = np.zeros(len(pairs), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([0, 1], [len(found), len(pairs)]).astype(np.int32)),
                     pa.array(np.r_[found, pairs].astype(np.int32)), pa.array(np.r_[sums[0], none]),
                     pa.array(np.r_[sums[1], none])], names=["kind", "slot", "c0", "c1"])

    both = (F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    words = train.mapInArrow(count_words, "word binary, c0 long, c1 long").groupBy("word").agg(*both)
    slots = stage(words.mapInArrow(count_slots, "kind int, slot int, c0 long, c1 long").groupBy("kind", "slot").agg(*both)
                  .filter(f"kind = 1 OR c0 + c1 >= {LEAST}"), "letter-counts")
    table = slots.filter("kind = 0").toArrow()
    counts = np.zeros((2, 1 << SLOT_BITS), np.float32)
    for c in (0, 1):
        counts[c, table.column("slot").to_numpy()] = table.column(f"c{c}").to_numpy()
    pairs = slots.filter("kind = 1").select("slot").toArrow().column("slot").to_numpy()
    types = np.bincount(pairs & 255, minlength=256) + 1.0
    return Model(counts, types / types.sum())


def curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps, on the standardised evidence, with a weak pull to 0."""
    if len(set(toxic.tolist())) < 2 or not evidence.std():
        return 1.0, 0.0
    mean, sd = evidence.mean(), evidence.std()
    x = np.stack([(evidence - mean) / sd, np.ones(len(evidence))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + 0.01 * np.eye(2), x @ (toxic - p) - 0.01 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / sd), float(w[1] - w[0] * mean / sd)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
          label_col: str = "toxic", max_train: int = 20_000) -> Model:
    """Counts from folds 1 to 3 of the labelled ids, the curve from fold 4; fold 0 is never looked at."""
    known = labels.select(col(label_id).cast("long").alias("id"), col(label_col).cast("int").alias("toxic")).dropna()
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold(F.col("id"))).filter("fold > 0")
    order = F.xxhash64("id")
    chosen = [known.filter((F.col("toxic") > 0) == toxic).orderBy(order, "id").limit(max_train) for toxic in (True, False)]
    sample = F.broadcast(stage(chosen[0].unionByName(chosen[1]), "labels"))
    texts = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).join(sample, "id")
    toxic = (F.col("toxic") > 0).cast("int").alias("toxic")
    model = counted(texts.filter("fold < 4").select("text", toxic))
    found = evidence_of(texts.filter("fold = 4").select("text", toxic), model, F.col("text")).select(
        "evidence", "toxic").toArrow()
    model.slope, model.shift = curve(found.column("evidence").to_numpy(), found.column("toxic").to_numpy())
    return model


def evidence_of(rows: DataFrame, model: Model, text: Column) -> DataFrame:
    """``rows`` with the column evidence. The model has a fixed size and is broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def evidence(texts: pa.Array) -> pa.Array:
        step = 200
        parts = [shared.value.evidence(texts.slice(at, step)) for at in range(0, len(texts), step)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return rows.withColumn("evidence", evidence(text))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with score (0 to 1) and predicted (1 from 0.5 on)."""
    rows = evidence_of(packed(docs, text=col(text_col)), model, F.col("text"))
    odds = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.lit(model.slope) * F.col("evidence") + model.shift))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-odds)))
    return unpacked(rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), docs.columns, *MADE)
