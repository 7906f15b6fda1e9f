"""Substring dedup: seed and extend over winnowed anchors; every repeat of ``length`` words or more is removed.

Seeds. A window of ``length`` words is anchored at its smallest k-gram, so equal windows have equal anchors at equal
places. Windows with one anchor are neighbours: one row per anchor stands for all of them, with the hash of the k-gram
and the hash of the whole stretch that its windows cover. Anchors whose k-gram occurs once need no further work.

Extension. Where all occurrences of a k-gram lie in equal stretches, they match over the whole stretch: all but the
first are repeats. Where stretches differ (the ends of a repeat), the first occurrence of each stretch is extended both
ways word by word: its windows are compared one by one. Other occurrences of a stretch follow from the first. Marked
stretches of a document are joined to maximal repeats. No step pairs occurrences with each other: each only meets the
first of its group, and groups are reduced before they are shuffled.

Defined results: a null text has no words; rows are ordered by id (null ids first), then by a hash of the text, and
a row that repeats another one's id and text gets the same result as that row; texts shorter than the length are never
touched, nor is the first place of a repeat; an empty table gives an empty result; result columns replace input
columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import col, drop_staged, packed, stage, unpacked
from gearsight.llm.textwords import RangeHash, leftmost_minima, mixed, word_chunks, words_of

MADE = ("kept_text", "n_words", "n_removed", "repeats")
ANCHOR = "id long, text_hash long, place int, back int, reach int, gram long, stretch long"
WINDOW = "id long, text_hash long, place int, gram long, window long"
SPREAD_1, SPREAD_2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def anchors_of(words: np.ndarray, bounds: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """Anchors of flat word hashes: row, first word of the row, anchor, first and last window, hashes."""
    row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][row_of]
    at = np.arange(len(words))
    ranges = RangeHash(words)
    grams = mixed(ranges(at[:max(0, len(at) - k + 1)], at[:max(0, len(at) - k + 1)] + k))
    place = leftmost_minima(grams, length - k + 1)
    windows = np.flatnonzero(at[:len(place)] + length <= end[:len(place)])
    anchor = place[windows]
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]][:len(anchor)])
    last = np.r_[first[1:] - 1, len(anchor) - 1][:len(first)]
    low, high, anchor = windows[first], windows[last], anchor[first]
    back, reach = (anchor - low).astype(np.uint64), (high - low).astype(np.uint64)
    stretch = mixed(ranges(low, high + length) + back * SPREAD_1 + reach * SPREAD_2)
    return {"row": row_of[anchor] if len(anchor) else anchor, "anchor": anchor, "low": low, "high": high,
            "gram": grams[anchor], "stretch": stretch, "ranges": ranges}


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20,
                    k: int = 6) -> DataFrame:
    """All rows of ``docs`` with kept_text (kept words joined by one space), n_words, n_removed and repeats, the
    removed stretches as (start, end) in words."""
    if not 1 <= k <= length:
        raise ValueError("k must lie between 1 and length")
    spark = docs.sparkSession
    id_ = F.coalesce(col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))
    keyed = packed(docs, id=id_, text_hash=F.xxhash64(F.coalesce(col(text_col), F.lit(""))), text=col(text_col))
    texts = keyed.select("id", "text_hash", "text")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, bounds in word_chunks(batches, 2):
            a = anchors_of(words, bounds, length, k)
            ids, hashes = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_pydict({
                "id": ids[a["row"]], "text_hash": hashes[a["row"]],
                "place": (a["anchor"] - bounds[a["row"]]).astype(np.int32),
                "back": (a["anchor"] - a["low"]).astype(np.int32), "reach": (a["high"] - a["low"]).astype(np.int32),
                "gram": a["gram"].view(np.int64), "stretch": a["stretch"].view(np.int64)})

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of the asked anchors, given as a list of places beside each text."""
        for rows, words, bounds in word_chunks(batches, 2):
            a = anchors_of(words, bounds, length, k)
            asked = np.concatenate([np.array([], np.int64), *(bounds[i] + np.array(r[2], np.int64)
                                                              for i, r in enumerate(rows))])
            chosen = np.flatnonzero(np.isin(a["anchor"], asked))
            count = a["high"][chosen] - a["low"][chosen] + 1
            of = np.repeat(chosen, count)
            start = a["low"][of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            row = a["row"][of]
            ids, hashes = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_pydict({
                "id": ids[row], "text_hash": hashes[row], "place": (start - bounds[row]).astype(np.int32),
                "gram": a["gram"][of].view(np.int64),
                "window": mixed(a["ranges"](start, start + length)).view(np.int64)})

    where = F.struct("id", "text_hash", "place")
    anchors = stage(texts.mapInArrow(seeds, ANCHOR), "anchors")
    repeated = stage(anchors.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), (F.min("stretch") != F.max("stretch")).alias("mixed"))
        .filter("n > 1").select("gram", "mixed"), "repeated-grams")
    found = stage(anchors.join(repeated, "gram"), "found-anchors")
    drop_staged(spark, anchors, repeated)
    firsts = stage(found.groupBy("gram", "stretch").agg(
        F.min(where).alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("mixed").alias("mixed"),
        F.any_value("back").alias("back"), F.any_value("reach").alias("reach")), "first-anchors")
    whole = found.select("gram", "stretch", *("id", "text_hash", "place", "back", "reach")).join(
        firsts.filter("n > 1").select("gram", "stretch", "first"), ["gram", "stretch"]).filter(
        F.col("first") != where)
    start = F.col("place") - F.col("back")
    spans = stage(whole.select("id", "text_hash", start.alias("start"), (start + F.col("reach") + length).alias("end")),
                  "stretch-spans")
    ends = stage(firsts.filter("mixed").groupBy(F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash"))
                 .agg(F.collect_list("first.place").alias("places")), "stretch-ends")
    windows = stage(texts.join(ends, ["id", "text_hash"]).mapInArrow(extend, WINDOW), "windows")
    drop_staged(spark, found, firsts, ends)
    first_windows = stage(windows.groupBy("gram", "window").agg(
        F.min(where).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "first-windows")
    single = windows.join(first_windows, ["gram", "window"]).filter(F.col("first") != where).select(
        "id", "text_hash", F.col("place").alias("start"), (F.col("place") + length).alias("end"))
    by_doc = stage(spans.unionByName(single).groupBy("id", "text_hash").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    drop_staged(spark, spans, windows, first_windows)

    @F.arrow_udf("struct<kept_text:string,n_words:long,n_removed:long,repeats:array<struct<start:int,end:int>>>")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        kept, n_words, n_removed, repeats = [], [], [], []
        for i, found in enumerate(spans.to_pylist()):
            words = words_of(text, i)
            out, at, merged = [], 0, []
            for s, e in sorted((f["start"], f["end"]) for f in found or ()):
                if merged and s <= merged[-1]["end"]:
                    merged[-1]["end"] = max(e, merged[-1]["end"])
                else:
                    merged.append({"start": s, "end": e})
            for m in merged:
                out += words[at:m["start"]]
                at = m["end"]
            out += words[at:]
            kept.append(b" ".join(out))
            n_words.append(len(words))
            n_removed.append(len(words) - len(out))
            repeats.append(merged)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()),
             pa.array(n_removed, pa.int64()), pa.array(repeats, kind)], names=list(MADE))

    joined = keyed.join(by_doc, ["id", "text_hash"], "left").withColumn("made", cut("text", "spans"))
    return unpacked(joined.select("row", "made.*"), docs.columns, *MADE)
