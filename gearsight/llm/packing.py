"""Packing by power-of-two decomposition: every document is cut into pieces of binary length, one piece a sequence.

A document of n tokens gives n // longest pieces of the longest length and one piece for each binary digit of the
rest, longest first. Pieces of one length form a bucket: batches of a bucket need no padding and no mask, and no
sequence crosses documents. The work is one pass over the documents without a shuffle.

Tokens of a word do not depend on its neighbours (the tokenizer splits at white space), so they are kept per word in
each worker. Words of letters take a faster path over the same merges; tests hold it against the library.

Defined results: a null text counts as empty and gives the one piece of its end token; repeated rows give pieces of
their own; an empty table gives no pieces; text of special tokens is tokenized as the library does; of the input only
the id is carried.
"""

from __future__ import annotations

import json
import string
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import col

#: Words a worker remembers before it starts anew.
REMEMBERED = 500_000
#: Documents whose pieces are sent to Spark at a time, and the bytes of ids after which they go earlier.
SEND_DOCS, SEND_BYTES = 512, 4 << 20


class WordTokens(dict):
    """Little-endian 32-bit ids of a word given in UTF-8, from the vocabulary file at ``path``."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = None
        if model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>":
            # The end of a word is written as byte 0, which no word of letters holds.
            letters = byte_letters()
            ranks = {bytes(letters[c] for c in t.removesuffix("</w>")) + b"\0" * t.endswith("</w>"): i
                     for t, i in model["vocab"].items() if all(c in letters for c in t.removesuffix("</w>"))}
            self.merges = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        body = text.rstrip(string.punctuation)
        if self.merges is not None and plain(body):
            ids = self.merges.encode_ordinary(body.lower() + "\0")
            tail = self[text[len(body):].encode()] if len(body) < len(text) else b""
        else:
            ids, tail = self.library.encode(text, add_special_tokens=False).ids, b""
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = struct.pack(f"<{len(ids)}I", *ids) + tail
        return out


def plain(word: str) -> bool:
    """Letters only, also in lower case, in composed form, and none whose lower case depends on its place."""
    return word.isascii() and word.isalpha() or (
        word.isalpha() and word.lower().isalpha() and "Σ" not in word and unicodedata.is_normalized("NFC", word))


def byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


TOKENS: dict[str, WordTokens] = {}


def lengths(n: int, longest: int) -> list[int]:
    """Binary lengths that add up to n, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 2048,
         end_id: int = 1) -> DataFrame:
    """Pieces: id, start, length, bucket (binary logarithm of the length), ids (little-endian 32-bit), doc_tokens,
    sequence_id, offset. ``longest`` is a power of two.

    A sequence is one piece, so offset is 0 and the padding nil. Its id numbers the pieces within the input's
    partitions; a second evaluation of the same input files gives the same ids.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in TOKENS:
            TOKENS[vocabulary] = WordTokens(vocabulary)
        word = TOKENS[vocabulary].__getitem__
        last = struct.pack("<I", end_id)
        out: dict[str, list] = {n: [] for n in kinds}
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                doc, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer()
                ids = b"".join(map(word, text.to_pybytes().split() if text is not None else ())) + last
                n, at = len(ids) // 4, 0
                for length in lengths(n, longest):
                    out["id"].append(doc)
                    out["start"].append(at)
                    out["length"].append(length)
                    out["bucket"].append(length.bit_length() - 1)
                    out["ids"].append(ids[4 * at:4 * (at + length)])
                    out["doc_tokens"].append(n)
                    at += length
                size += len(ids)
                if len(out["id"]) >= 8 * SEND_DOCS or size >= SEND_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], names=list(out))
                    out, size = {k: [] for k in out}, 0
        if out["id"]:
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], names=list(out))

    asked = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    kinds = {"id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "bucket": pa.int32(), "ids": pa.binary(),
             "doc_tokens": pa.int64()}
    pieces = asked.mapInArrow(cut, "id long, start long, length long, bucket int, ids binary, doc_tokens long")
    return pieces.select(F.col("id").alias(id_col), "start", "length", "bucket", "ids", "doc_tokens",
                         F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length, for batches of equal sequences."""
    pieces.write.partitionBy("bucket").parquet(path)
