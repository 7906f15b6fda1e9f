"""Byte-level BPE over the distinct words of the whole corpus: every word is encoded once, wherever it stands.

Encoding takes three steps:

1. ``explode``: texts are split into pre-tokens. Inside a block of documents a pre-token's position holds the number of
   its word, and the block lists each of its words once, so frequent words are aggregated before anything is shuffled;
2. the words of all blocks are sorted by word; each run of equal words is encoded once and its ids go back to all blocks
   that asked. A word has one row per block, so no word outgrows its share of a task, however frequent it is;
3. each block meets its words' ids again and its documents are put together by position. The blocks lie in buckets, so
   only the ids are shuffled.

Decoding joins ids with the token-byte table, which has one row per token of the vocabulary and is broadcast.

Defined results: a null text counts as empty and has no ids; repeated rows give rows of their own; text of special
tokens is ordinary text; a text and its ids must fit a task, a text that is longer than a block is a block of its own;
an empty table gives an empty result; result columns replace input columns of the same name, the text is not carried.
Ids that are not in the vocabulary decode to nothing. Null ids decode to null.
"""

from __future__ import annotations

import base64
import ctypes
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gearsight.llm.common import col, packed, stage, unpacked
from gearsight.sources.staging import scratch

#: A block ends at so many pre-tokens or distinct words.
BLOCK_TOKENS, BLOCK_WORDS = 8_000_000, 1_000_000
#: Words that leave a task as one Arrow batch.
SEND_WORDS = 100_000
#: Bytes of cells that are put together at a time.
SLICE_BYTES = 256 << 10
#: Rows whose ids are sent back together.
ANSWER_ROWS = 400_000
#: Most buckets of a table that Spark allows.
MAX_BUCKETS = 100_000
MADE = ("n_tokens", "ids")


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ids: lines of a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def merger(key: tuple[int, int], ranks: Broadcast) -> tiktoken.Encoding:
    """Merges of one pre-token; the worker builds it once. ``key`` tells vocabularies apart."""
    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks.value, special_tokens={})


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: str) -> int:
        out = self[word] = len(self)
        return out


def give_back() -> None:
    """Hand freed memory back to the system: a worker lives on through steps of different needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shortened(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Each part of ``values`` (bounds[i] to bounds[i + 1]) as bytes of 7 bits, the last of a value with its top bit set."""
    most = max(int(values.max()).bit_length() if len(values) else 0, 1)
    more = [values >= 1 << 7 * k for k in range(1, -(-most // 7))]
    size = 1 + sum(m.astype(np.int64) for m in more) if more else np.ones(len(values), np.int64)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    out[end - 1] = (values & 127) | 128
    for k, has in enumerate(more, 1):
        out[end[has] - 1 - k] = (values[has] >> 7 * k) & 127
    at = np.concatenate([[0], end])[bounds]
    return [out[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]


def restored(raw: np.ndarray) -> np.ndarray:
    """The values of ``shortened``, of one part or of several in a row."""
    last = np.flatnonzero(raw & 128)
    reach = np.diff(last, prepend=-1)
    out, place, k = (raw[last] & 127).astype(np.int64), np.flatnonzero(reach > 1), 1
    while len(place):
        out[place] |= raw[last[place] - k].astype(np.int64) << 7 * k
        k += 1
        place = place[reach[place] > k]
    return out


def slices(cells: pa.BinaryArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of cells of about ``most`` bytes."""
    end = np.cumsum(np.array([len(c.as_buffer()) if c.is_valid else 0 for c in cells]))
    start = 0
    while start < len(cells):
        stop = max(start + 1, int(np.searchsorted(end, (end[start - 1] if start else 0) + most)))
        yield start, min(stop, len(cells))
        start = stop


def parts(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary cell for each range of the bytes ``values``."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [
        None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``start``, one range behind the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def token_table(tokens: dict[int, bytes]) -> pa.Array:
    """The token-byte table by id; one empty row more for ids that are not in it."""
    return pa.array([tokens.get(i, b"") for i in range(max(tokens, default=-1) + 2)], pa.large_binary())


def joined_bytes(ids: np.ndarray, bounds: np.ndarray, table: pa.Array) -> pa.Array:
    """The bytes of each part of ``ids``: every id joined with the table, in order."""
    found = table.take(pa.array(np.minimum(ids, len(table) - 1)))
    # the taken tokens lie one behind the other in the result's buffer: only bounds are needed
    offsets = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)
    return parts(np.frombuffer(found.buffers()[2] or b"", np.uint8), offsets[bounds])


def exploded(docs: DataFrame, text_col: str, pattern: str) -> DataFrame:
    """Rows of two kinds: 'doc' (block, row, place: word numbers by position) and 'word' (block, word, at: its number)."""
    others = T.StructType([f for f in docs.schema.fields if f.name != text_col])
    kept = F.struct(*[col(f.name) for f in others]) if len(others) else F.struct(F.lit(None).cast("int").alias("_none"))
    rows = docs.select(F.coalesce(col(text_col), F.lit("")).alias("text"), kept.alias("row"),
                       F.shiftleft(F.spark_partition_id().cast("long"), 33).alias("part"))
    out = T.StructType([T.StructField("kind", T.StringType()), T.StructField("block", T.LongType()),
                        T.StructField("row", rows.schema["row"].dataType), T.StructField("place", T.BinaryType()),
                        T.StructField("word", T.StringType()), T.StructField("at", T.IntegerType())])

    def batch(kind: str, block: int, **cols: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        cols |= {"kind": pa.array([kind] * n, pa.string()), "block": pa.array([block] * n, pa.int64())}
        return pa.RecordBatch.from_arrays([cols.get(name, pa.nulls(n, types[name])) for name in out.names],
                                          schema=pa.schema([(name, types[name]) for name in out.names]))

    types: dict[str, pa.DataType] = {"kind": pa.string(), "block": pa.int64(), "place": pa.binary(), "word": pa.string(),
                                     "at": pa.int32()}

    def words(block: int, numbers: Numbers) -> Iterator[pa.RecordBatch]:
        names = list(numbers)
        for i in range(0, len(names), SEND_WORDS):
            part = names[i:i + SEND_WORDS]
            yield batch("word", block, word=pa.array(part, pa.string()), at=pa.array(range(i, i + len(part)), pa.int32()))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        numbers, block, tokens = Numbers(), None, 0
        for b in batches:
            types["row"] = b.column("row").type
            texts, start = b.column("text"), 0
            if b.num_rows and block is None:
                block = b.column("part")[0].as_py()
            values, bounds = [], [0]
            for i in range(b.num_rows):
                found = split(texts[i].as_py())
                values.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
                bounds.append(bounds[-1] + len(found))
                tokens += len(found)
                full = tokens >= BLOCK_TOKENS or len(numbers) >= BLOCK_WORDS
                if full or bounds[-1] >= SEND_WORDS or i == b.num_rows - 1:
                    yield batch("doc", block, row=b.column("row").slice(start, i + 1 - start), place=pa.array(
                        shortened(np.concatenate(values), np.array(bounds)), pa.binary()))
                    values, bounds, start = [], [0], i + 1
                if full:
                    yield from words(block, numbers)
                    numbers, block, tokens = Numbers(), block + 1, 0
        if numbers:
            yield from words(block, numbers)
        numbers.clear()
        give_back()

    return rows.select("text", "row", "part").mapInArrow(explode, out)


def answered(words: DataFrame, ranks: Broadcast) -> DataFrame:
    """Ids of words sorted by word: (block, at: word numbers, sizes, ids), several words of a block in a row."""
    key = (len(ranks.value), hash(max(ranks.value)))

    def pack(blocks: np.ndarray, at: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(blocks, kind="stable")
        starts = np.cumsum(sizes) - sizes
        size = sizes[order]
        flat, edge = ids[spread(starts[order], size)], np.concatenate([[0], np.cumsum(size)])
        cut = np.flatnonzero(np.diff(blocks[order])) + 1
        cut = np.concatenate([[0], cut, [len(order)]])
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(blocks[order[cut[:-1]]], pa.int64()),
            "at": pa.array(shortened(at[order], cut), pa.binary()), "sizes": pa.array(shortened(size, cut), pa.binary()),
            "ids": pa.array(shortened(flat, edge[cut]), pa.binary())})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = merger(key, ranks).encode_ordinary
        last, ids = None, ()
        held: list[tuple] = []
        rows = 0
        for b in batches:
            sizes, flat = [], []
            for word in b.column("word").to_pylist():
                if word != last:
                    last, ids = word, merge(word)
                sizes.append(len(ids))
                flat.extend(ids)
            held.append((b.column("block").to_numpy(), b.column("at").to_numpy().astype(np.int64), np.array(sizes, np.int64),
                         np.array(flat, np.int64)))
            rows += b.num_rows
            if rows >= ANSWER_ROWS:
                yield from pack(*map(np.concatenate, zip(*held)))
                held, rows = [], 0
        if rows:
            yield from pack(*map(np.concatenate, zip(*held)))

    return words.repartition("word").sortWithinPartitions("word").select("block", "word", "at").mapInArrow(
        answer, "block long, at binary, sizes binary, ids binary")


def reassembled(rows: DataFrame, answers: DataFrame, tokens: Broadcast | None) -> DataFrame:
    """(row, n_tokens, ids) of every document: the ids of its words by position; also decoded, if there are ``tokens``."""
    out = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids", T.BinaryType())])
    if tokens is not None:
        out.add("decoded", T.BinaryType())

    def numbers(cells: pa.ChunkedArray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(restored(np.frombuffer(c.as_buffer(), np.uint8)) for c in cells)])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        at, sizes, ids = (numbers(right.column(name)) for name in ("at", "sizes", "ids"))
        start, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        start[at], size[at] = np.cumsum(sizes) - sizes, sizes
        ids = ids.astype("<u4")
        table = token_table(tokens.value) if tokens is not None else None
        counts, cells, decoded, places = [], [], [], left.column("place").combine_chunks()
        for a, b in slices(places):
            raw = [np.frombuffer(p.as_buffer(), np.uint8) for p in places[a:b]]
            words = np.cumsum([0, *(np.count_nonzero(r & 128) for r in raw)])
            found = restored(np.concatenate(raw))
            edge = np.concatenate([[0], np.cumsum(size[found])])[words]
            counts.append(np.diff(edge))
            flat = ids[spread(start[found], size[found])]
            cells.append(parts(flat.view(np.uint8), edge * 4))
            if table is not None:
                decoded.append(joined_bytes(flat, edge, table))
        give_back()
        made = {"row": left.column("row"), "n_tokens": pa.array(np.concatenate(counts), pa.int64()),
                "ids": pa.chunked_array(cells, pa.binary())}
        return pa.table(made | ({"decoded": pa.chunked_array(decoded, pa.binary())} if tokens is not None else {}))

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, out)


def by_block(df: DataFrame) -> DataFrame:
    """The table written to the shared folder in buckets by block: grouping by block needs no shuffle of it.

    A task has few blocks, so it writes few files. The name in the catalog goes at once, the files stay.
    """
    spark, name = df.sparkSession, f"pre_tokens_{uuid.uuid4().hex}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_BUCKETS)
    df.write.bucketBy(buckets, "block").option("compression", "zstd").option("path", scratch(spark, "pre-tokens")).saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", round_trip: bool = False) -> DataFrame:
    """The columns of ``docs`` but the text, with n_tokens and ids (little-endian 32-bit numbers).

    ``round_trip`` adds decoded, the bytes of the ids as ``decode`` gives them, without a second pass over the ids.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    tokens = spark.sparkContext.broadcast({i: token for token, i in ranks.value.items()}) if round_trip else None
    made = by_block(exploded(docs, text_col, pattern))
    words = made.filter(F.col("kind") == "word").select("block", "word", "at")
    answers = stage(answered(words, ranks), "word-ids")
    rows = made.filter(F.col("kind") == "doc").select("block", "row", "place")
    out = reassembled(rows, answers, tokens)
    made = (*MADE, "decoded") if round_trip else MADE
    return unpacked(out, [f.name for f in docs.schema.fields if f.name != text_col], *made)


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with decoded: the bytes of each row's ids (little-endian 32-bit numbers), joined in order."""
    spark = rows.sparkSession
    table = spark.sparkContext.broadcast({i: token for token, i in read_ranks(ranks_path).items()})
    both, place = packed(rows), rows.columns.index(ids_col)
    out = T.StructType([both.schema["row"], T.StructField("decoded", T.BinaryType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_table(table.value)
        for batch in batches:
            give_back()
            row = batch.column("row")
            held = row.field(place)
            for a, b in slices(held):
                given = [np.frombuffer(c.as_buffer() if c.is_valid else b"", "<u4") for c in held[a:b]]
                cells = joined_bytes(np.concatenate(given), np.cumsum([0, *map(len, given)]), tokens)
                cells = pc.if_else(held[a:b].is_valid(), cells, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([row[a:b], cells], names=["row", "decoded"])

    return unpacked(both.mapInArrow(join, out), rows.columns, "decoded")
