"""Spelling variants: words one edit apart, each grouped under its far more frequent form.

Words are counted in the tasks before the shuffle. Two words are near when they differ by one inserted, deleted or
replaced code point, which is so when their common prefix and common suffix together reach the longer length minus one.
Such words share the first half of the longer length or the last half, so words are dealt by both halves into blocks.
A tile is a pair of blocks: two padded matrices of code points, one aligned left and one right, are compared position
by position, every word with every word, and each word keeps its number of near words and its best one. Pairs are never
written out. A half that many words share is cut into blocks of its own, and each pair of them is a tile.

A word's form is its near word of largest count, if that is at least ``ratio`` times its own; ties go to the smallest in
code-point order. Counts grow along forms, so following them ends after at most log(largest count) / log(ratio) steps.

Defined results: a null text has no words; texts of any length are read whole; repeated rows count each time; an empty
table gives an empty result; of the input only the words are carried, so no name can clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import attach, col, stage

#: Runs of a-z and of U+00C0 to U+00FF in lower-cased UTF-8.
RUNS = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: Different words that a task holds before it sends their counts.
HELD = 1_000_000
#: Words of small groups that meet in one tile, and words of one block of a large group.
TILE_WORDS, BLOCK_WORDS = 256, 512


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5,
                alter: Callable[[bytes, bytes], bytes] | None = None) -> DataFrame:
    """(word, n) of the words of enough code points and occurrences; only A to Z are lower-cased.

    ``alter`` gets a row's id as text (empty for null) and a word in UTF-8 and gives the word that counts.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in held], pa.string()),
                                               "n": pa.array(list(held.values()), pa.int64())})

        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for i in range(batch.num_rows):
                if not texts[i].is_valid:
                    continue
                own = Counter(RUNS.findall(texts[i].as_buffer().to_pybytes().lower()))
                if alter is not None:
                    doc = ids[i].as_buffer().to_pybytes() if ids[i].is_valid else b""
                    for word, n in own.items():
                        if len(word) >= min_length:
                            held[alter(doc, word)] += n
                else:
                    held.update(own)
                if len(held) >= HELD:
                    yield send()
                    held.clear()
        yield send()

    rows = docs.select(col(id_col).cast("string").alias("id"), col(text_col).alias("text"))
    parts = rows.mapInArrow(count, "word string, n long").filter(F.length("word") >= min_length)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def code_points(words: list[str], width: int, right: bool) -> np.ndarray:
    """A row of ``width`` code points per word, padded with zeros."""
    text = "".join(w.rjust(width, "\0") if right else w.ljust(width, "\0") for w in words)
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(words), width)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows, at how many leading columns they agree."""
    same, out = np.ones((len(a), len(b)), bool), np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        same &= a[:, k, None] == b[None, :, k]
        if not same.any():
            break
        out += same
    return out


def near(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Which words of ``a`` and ``b`` (columns word, size, long, side, half) are near and meet here.

    A pair belongs to the group of the first half of the longer word if it shares that, else to that of the last half.
    """
    width = int(max(a["size"].max(), b["size"].max()))
    wa, wb = a["word"].tolist(), b["word"].tolist()
    prefix = common(code_points(wa, width, False), code_points(wb, width, False))
    suffix = common(code_points(wa, width, True)[:, ::-1], code_points(wb, width, True)[:, ::-1])
    la, lb = a["size"].to_numpy()[:, None], b["size"].to_numpy()[None, :]
    longer = np.maximum(la, lb)
    group = (a["group"].to_numpy()[:, None] == b["group"].to_numpy()[None, :]) & (a["long"].to_numpy()[:, None] == longer)
    group &= (a["side"].to_numpy()[:, None] == 0) | (prefix < longer // 2)
    differs = (la != lb) | (prefix < longer)
    return group & differs & (np.abs(la - lb) <= 1) & (prefix + suffix >= longer - 1)


def best(words: pd.DataFrame, others: pd.DataFrame, hit: np.ndarray) -> list[tuple]:
    """Of each word with hits: their number, and the one of largest count, of equals the smallest."""
    given, names, counts = words["word"].tolist(), others["word"].tolist(), others["n"].tolist()
    order = np.array(sorted(range(len(names)), key=lambda i: (-counts[i], names[i])))
    some = np.flatnonzero(hit.any(axis=1))
    first = order[np.argmax(hit[np.ix_(some, order)], axis=1)]
    return [(given[i], int(n), names[j], counts[j]) for i, n, j in zip(some, hit[some].sum(axis=1), first)]


def compare(tile: pa.Table) -> pa.Table:
    """What the words of a tile find in each other: its left block against its right one, or one block in itself."""
    rows, found = tile.to_pandas(), []
    left = rows[rows["block"] == rows["left"]].reset_index(drop=True)
    right = rows[rows["block"] == rows["right"]].reset_index(drop=True)
    if len(left) and len(right):
        hit = near(left, right)
        found = best(left, right, hit)
        if rows["left"].iat[0] != rows["right"].iat[0]:
            found += best(right, left, hit.T)
    columns = list(zip(*found)) or [[]] * 4
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("word", "n_near", "near", "near_n"), columns, kinds)})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) of the words that have near ones, from ``words`` (word, n), each word once."""
    size = F.length("word")
    sides = [F.struct(long.cast("int").alias("long"), F.lit(side).alias("side"), half.alias("half"))
             for long in (size, size + 1)
             for side, half in ((0, F.substring(F.col("word"), F.lit(1), F.floor(long / 2).cast("int"))),
                                (1, F.right(F.col("word"), long - F.floor(long / 2))))]
    dealt = words.select("word", "n", size.alias("size"), F.explode(F.array(*sides)).alias("s")).select(
        "word", "n", "size", "s.*").withColumn("group", F.concat_ws(":", "long", "side", "half"))
    total = 4 * words.count()
    groups = dealt.groupBy("group").agg(F.count(F.lit(1)).alias("weight"))
    large = groups.filter(F.col("weight") > BLOCK_WORDS).withColumn(
        "blocks", F.ceil(F.col("weight") / BLOCK_WORDS).cast("int"))
    met = attach(dealt, large, "group", "weight", total, F.concat(F.lit("+"), F.col("word")))
    met = met.withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(
        F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")))
    # block i meets every block j once: as the left one when i <= j
    partners = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = max(1, total // TILE_WORDS)
    tile = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("group"), F.lit(tiles)).cast("string")).otherwise(F.col("group"))
    placed = met.withColumn("other", F.explode(partners)).select(
        tile.alias("tile"), F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
        "block", "group", "long", "side", "size", "word", "n")
    parts = placed.groupBy("tile", "left", "right").applyInArrow(
        compare, "word string, n_near long, near string, near_n long")
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("first")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select(
        "word", "n_near", F.col("first.near").alias("near"), (-F.col("first.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last; only words that still move go on to the next step."""
    live, ended = forms.select("word", F.col("form").alias("root")), []
    step = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    while True:
        moved = stage(live.join(step, "root", "left"), "roots")
        ended.append(moved.filter(F.col("next").isNull()).select("word", "root"))
        live = moved.filter(F.col("next").isNotNull()).select("word", F.col("next").alias("root"))
        if live.isEmpty():
            break
    out = ended[0]
    for part in ended[1:]:
        out = out.unionByName(part)
    return out


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``words`` (word, n; each word once) with form, root, n_near and form_n."""
    words = stage(words.select("word", "n"), "words")
    found = words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "near", "near_n")
    far = F.col("near_n") >= ratio * F.col("n")
    found = stage(found.select("word", "n", "n_near", F.when(far, F.col("near")).alias("form"),
                               F.when(far, F.col("near_n")).alias("form_n")), "near-words")
    last = roots(found.filter(F.col("form").isNotNull()).select("word", "form"))
    return found.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
