"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its 5-word shingles, each labelled with its occurrence number, so that no symbol repeats.
Order MinHash samples the ``sample`` smallest symbols under each of ``functions`` hash functions and keeps them in
text order; texts that agree in one such tuple meet in a bucket. The similarity of two texts is L / (n1 + n2 - L), with
L the longest common subsequence of their symbols, found within the diagonal band that the wanted similarity allows.
Links of ``similarity`` or more make classes by connected components.

Equal texts are one node. In a bucket of up to SMALL nodes all are compared. In a larger one, symbols that only one node
of all larger buckets holds bound the similarity: of n1 and n2 symbols, u1 and u2 of them a node's own, at most
m = min(n1 - u1, n2 - u2) can be common, so the similarity is at most m / (n1 + n2 - m). A mask of MASK_WORDS * 64 bits,
one set for each symbol, bounds it too: a bit that only one of two nodes has is a symbol that the other lacks. (In texts
of several thousand symbols the masks are full and the first bound alone is left.) Only pairs that may reach the
threshold and lie in different components are compared; nodes that can reach it with no other are closed. In each of
ROUNDS rounds the open nodes of a bucket meet a head, the node with the smallest share of own symbols, which is then
done. What is still apart after that meets the others of its bucket, all but the largest component as lookers. A
bucket's rows never multiply, and no node is left out.
At 0.8 a pair of long texts misses all 16 tuples of 4 with a chance of about 2 in 10,000, a pair of short ones more
often: with 4 of 5 symbols shared 2.8 %, with 8 of 10 about 0.15 %.

Defined results: a null text counts as empty; equal texts, empty ones too, share a class; texts of less than five words
have their whole word sequence as the one shingle; the class id is the smallest id, null only if all ids are; repeated
rows are in one class; an empty table gives an empty result; result columns replace input columns of the same name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import attach, col, packed, stage, unpacked
from gearsight.llm.components import components
from gearsight.llm.textwords import MIX_1, RangeHash, mixed, word_chunks

#: Buckets up to this size are compared in full.
SMALL = 8
#: Rounds of comparing a larger bucket with one head, before the nodes still apart meet the others.
ROUNDS = 5
#: 64-bit words of the mask of a node's symbols.
MASK_WORDS = 16
MADE = ("class_id", "class_size", "kept")


def symbols(words: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of the shingles of a text, each with its occurrence number: all different."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(shingle, len(words))
    start = np.arange(len(words) - width + 1)
    grams = mixed(RangeHash(words)(start, start + width) + np.uint64(width))
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    if len(new) == len(grams):
        return grams
    times = np.arange(len(grams)) - np.repeat(new, np.diff(np.r_[new, len(grams)]))
    out = np.empty_like(grams)
    out[order] = mixed(ranked + times.astype(np.uint64) * MIX_1)
    return out


def order_minhash(found: np.ndarray, seeds: np.ndarray, sample: int) -> np.ndarray:
    """One key per seed: the smallest symbols under it, in text order."""
    values = mixed(found[None, :] ^ seeds[:, None])
    if len(found) > sample:
        at = np.sort(np.argpartition(values, sample - 1, axis=1)[:, :sample], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(found)), (len(seeds), len(found)))
    keys = seeds.copy()
    for i in range(at.shape[1]):
        keys = mixed(keys * MIX_1 + found[at[:, i]])
    return keys


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Similarity of two symbol sequences if it is ``least`` or more, else some value below it."""
    longest, n = max(len(a), len(b)), len(a) + len(b)
    if not longest or min(len(a), len(b)) < least * longest:
        return 0.0
    # L of least * n / (1 + least) or more leaves this many symbols unmatched, so no match is further off the diagonal.
    band = n - 2 * least * n / (1 + least)
    _, ia, ib = np.intersect1d(a, b, return_indices=True)
    near = np.abs(ia - ib) <= band
    ia, ib = ia[near], ib[near]
    if len(ia) < least * n / (1 + least) - 1e-9:
        return 0.0
    line = ib[np.argsort(ia)]
    if len(line) > 1 and not (line[1:] > line[:-1]).all():
        tails: list[int] = []
        for x in line.tolist():
            at = bisect_left(tails, x)
            tails[at:at + 1] = [x]
        common = len(tails)
    else:
        common = len(line)
    return common / (n - common)


def mask_of(found: np.ndarray) -> np.ndarray:
    """MASK_WORDS signed words with a bit set for each symbol."""
    bits = np.zeros(MASK_WORDS * 64, np.uint8)
    bits[found % np.uint32(MASK_WORDS * 64)] = 1
    return np.packbits(bits).view(np.int64)


def sequences_of(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(node, seq, mask) of the wanted nodes: their symbols in text order, 4 bytes each, and the mask of them."""

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, bounds in word_chunks(batches, 1):
            found = [(symbols(words[bounds[i]:bounds[i + 1]], shingle) >> np.uint64(32)).astype(np.uint32)
                     for i in range(len(rows))]
            yield pa.RecordBatch.from_pydict({"node": pa.array([r[0] for r in rows], pa.binary()),
                                              "seq": pa.array([f.tobytes() for f in found], pa.binary()),
                                              "mask": pa.array([mask_of(f) for f in found], pa.list_(pa.int64()))})

    return stage(texts.join(nodes, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(
        sequences, "node binary, seq binary, mask array<long>"), "sequences")


def linked(pairs: DataFrame, seqs: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that are similar. A pair carries one text through the shuffle to where the other is."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [aligned(np.frombuffer(batch.column(2)[i].as_buffer(), np.uint32),
                            np.frombuffer(batch.column(3)[i].as_buffer(), np.uint32), similarity) >= similarity
                    for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    pairs = stage(pairs.distinct(), "pairs")
    one = pairs.join(seqs.select(F.col("node").alias("b"), F.col("seq").alias("seq_b")), "b")
    both = one.join(seqs.select(F.col("node").alias("a"), F.col("seq").alias("seq_a")), "a")
    return stage(both.select("a", "b", "seq_a", "seq_b").mapInArrow(align, "a binary, b binary"), "linked")


def ordered(x: str, y: str) -> tuple:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def may_link(x: str, y: str, similarity: float) -> Column:
    """Whether nodes with n symbols, u of them their own, can be similar; one symbol is a margin for rounding."""
    n = F.col(f"{x}.n") + F.col(f"{y}.n")
    most = []
    for one, other in ((x, y), (y, x)):
        lacks = sum(F.bit_count(F.col(f"{one}.mask")[i].bitwiseAND(F.bitwise_not(F.col(f"{other}.mask")[i])))
                    for i in range(MASK_WORDS))
        most.append(F.col(f"{one}.n") - F.greatest(F.col(f"{one}.u").cast("int"), lacks))
    common = F.least(*most)
    return common * (1 + similarity) >= n * similarity - 1


def still_open(members: DataFrame, seqs: DataFrame, similarity: float) -> DataFrame:
    """Members (bucket, label, node, n, mask) with ``u``, their number of own symbols, without those that can have
    no link to another label of their bucket."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = np.frombuffer(batch.column(1)[i].as_buffer(), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), batch.column(0)[i].as_py())), pa.array(found)], names=["k", "sym"])

    held = seqs.join(members.select("node").distinct(), "node", "left_semi").select(
        F.xxhash64("node").alias("k"), "seq")
    own = held.mapInArrow(spread, "k long, sym int").groupBy("sym").agg(
        F.count(F.lit(1)).alias("times"), F.min("k").alias("k")).filter("times = 1").groupBy("k").agg(
        F.count(F.lit(1)).alias("u"))
    counted = stage(members.withColumn("k", F.xxhash64("node")).join(own, "k", "left").select(
        "bucket", "label", "node", "n", "mask", F.coalesce("u", F.lit(0)).alias("u")), "counted")
    # The fewest own symbols of a bucket under any label, and under any label but that one.
    low = counted.groupBy("bucket", "label").agg(F.min("u").alias("u"))
    first = low.groupBy("bucket").agg(F.min(F.struct("u", "label")).alias("first"))
    second = low.join(first, "bucket").filter(F.col("label") != F.col("first.label")).groupBy("bucket").agg(
        F.first("first").alias("first"), F.min("u").alias("second_u"))
    least = F.when(F.col("label") == F.col("first.label"), F.col("second_u")).otherwise(F.col("first.u"))
    return stage(counted.join(second, "bucket").filter(
        F.col("n") - F.col("u") >= similarity * (F.col("n") + least) - 1).select(counted.columns), "open")


def groups_of(sketches: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Components (node, label) of the links between nodes of ``sketches`` (node, n, keys); others may lack."""
    members = sketches.select("node", "n", F.explode("keys").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stage(members.join(sizes, "bucket"), "buckets")
    seqs = sequences_of(members.select("node").distinct(), texts, shingle)
    listed = members.filter(F.col("size") <= SMALL).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct(
        "node", "n"))).alias("all")).select(F.posexplode("all"), "all").select(F.col("col").alias("x"), F.explode(
            F.expr("slice(all, pos + 2, size(all))")).alias("y"))
    pairs = listed.filter(F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1).select(
        *ordered("x.node", "y.node"))
    large = still_open(members.filter(F.col("size") > SMALL).withColumn("label", F.col("node")).join(
        seqs.select("node", "mask"), "node"), seqs, similarity)
    side = F.struct("label", "node", "n", "u", "mask")
    for step in range(ROUNDS + 1):
        if step < ROUNDS:
            heads = large.groupBy("bucket").agg(F.min_by(side, F.struct(F.col("u") / F.col("n"), "node")).alias("y"))
        else:
            # A looker is outside the largest component of its bucket.
            counts = large.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("times"))
            most = counts.groupBy("bucket").agg(F.max_by("label", F.struct("times", "label")).alias("most"))
            heads = large.join(most, "bucket").filter(F.col("label") != F.col("most")).select("bucket", side.alias("y"))
        faced = large.select("bucket", side.alias("x")).alias("l").join(
            heads.alias("h"), (F.col("l.bucket") == F.col("h.bucket")) & (F.col("x.label") != F.col("y.label"))
            & may_link("x", "y", similarity)).select(*ordered("x.node", "y.node"))
        found = linked(faced.unionByName(pairs) if step == 0 else faced, seqs, similarity)
        if step:
            found = found.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        labels = stage(components(found), "labels")
        if step == ROUNDS:
            break
        rest = large.join(heads, "bucket").filter(F.col("node") != F.col("y.node")).select(
            "bucket", "node", "n", "mask").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        large = still_open(stage(rest, "rest"), seqs, similarity)
        if large.isEmpty():
            break
    return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8,
            shingle: int = 5, functions: int = 16, sample: int = 4) -> DataFrame:
    """All rows of ``docs`` with class_id, class_size and kept (the row of the smallest id of its class)."""
    return unpacked(marked(docs, id_col, text_col, similarity, shingle, functions, sample), docs.columns, *MADE)


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8,
              shingle: int = 5, functions: int = 16, sample: int = 4) -> DataFrame:
    """One row of each class, that of the smallest id, ties by the hash of the text.

    A class is known by its label: ids may be null or repeated, so several classes can share a class id.
    """
    kept = marked(docs, id_col, text_col, similarity, shingle, functions, sample).filter("kept")
    several = kept.filter("class_size > 1").groupBy("label").agg(F.min_by("row", "node").alias("row"))
    return unpacked(kept.filter("class_size = 1").select("row").unionByName(several.select("row")), docs.columns)


def marked(docs: DataFrame, id_col: str, text_col: str, similarity: float, shingle: int, functions: int,
           sample: int) -> DataFrame:
    """Rows (row, id, node, label, class_id, class_size, kept); the label is the same for the rows of a class only."""
    text = F.coalesce(col(text_col), F.lit(""))
    node = F.substring(F.unhex(F.sha2(text, 256)), 1, 16)
    rows = packed(docs, id=col(id_col), node=node, text=text)
    seeds = mixed(np.arange(1, functions + 1).astype(np.uint64))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got, words, bounds in word_chunks(batches, 2):
            found = [symbols(words[bounds[i]:bounds[i + 1]], shingle) for i in range(len(got))]
            keys = [order_minhash(f, seeds, sample).view(np.int64) if len(f) else [] for f in found]
            yield pa.RecordBatch.from_arrays([
                pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary()),
                pa.array([len(f) for f in found], pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "node", "length", "keys"])

    sketches = rows.select(F.col("id").cast("long").alias("id"), "node", "text").mapInArrow(
        sketch, "id long, node binary, length int, keys array<long>")
    sketches = stage(sketches.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.any_value(
        "length").alias("length"), F.any_value("keys").alias("keys")), "sketches")
    labels = groups_of(sketches.select("node", F.col("length").alias("n"), "keys"), rows.select("node", "text"), similarity, shingle)
    named = stage(sketches.select("node", "id", "n").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node")), "labels")
    sums = named.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"),
                                      F.count(F.lit(1)).alias("nodes"))
    total = named.agg(F.count(F.lit(1)), F.sum("n")).first()
    spread = F.unhex(F.hex(F.xxhash64("node")))
    named = stage(attach(named.select("node", "n", "label"), sums, "label", "nodes", total[0], spread), "classes")
    spread = F.unhex(F.hex(F.xxhash64("id", F.monotonically_increasing_id())))
    out = attach(rows.select("row", "id", "node"), named, "node", "n", total[1] or 0, spread)
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("class_id")))
