"""Spelling variants against a brute-force version of the contract."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gearsight.llm import queries, spelling

SMALL = "/root/testdata/sf0.001"


def brute_counts(docs):
    seen = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            seen[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(counts):
    by_hole = {}
    for w in counts:  # near words share the word with one letter left out or masked
        for i in range(len(w) + 1):
            by_hole.setdefault(w[:i] + "*" + w[i:], set()).add(w)
            if i < len(w):
                by_hole.setdefault(w[:i] + "*" + w[i + 1:], set()).add(w)
    near = {w: set() for w in counts}
    for group in by_hole.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    forms = {}
    for w, found in near.items():
        top = min(found, key=lambda b: (-counts[b], [ord(c) for c in b]), default=None)
        forms[w] = top if top and counts[top] >= 5 * counts[w] else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return {w: (forms[w], root(w), counts[w], len(near[w]), counts.get(forms[w])) for w in counts}


def collected(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = brute_variants(brute_counts(docs))
    assert collected(queries.QUERIES["op11_spelling_variants"](spark, SMALL)) == want
    assert sum(v[3] > 0 for v in want.values()) > 20


@pytest.mark.parametrize("tile,block", [(256, 512), (8, 3)])
def test_chains_ties_and_large_groups(spark, monkeypatch, tile, block):
    monkeypatch.setattr(spelling, "TILE_WORDS", tile)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    counts = {"abcdefgh": 1000, "abcdefgi": 100, "abcdefji": 20, "abcdkfji": 4, "abcdefghh": 200, "bcdefgh": 200, "éabcdef": 5,
              "eabcdef": 25, "aabcdef": 25, "aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 24, "zzzzzz": 9, "zzzyzz": 9}
    counts |= {f"prefix{a}{b}": 1 + i for i, a in enumerate("abcdefghij") for b in "klmnop"}
    counts |= {f"{a}{b}suffix": 1 + i for i, a in enumerate("abcdefghij") for b in "klmnop"}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got, want = collected(spelling.variants(words)), brute_variants(counts)
    assert got == want
    assert got["abcdkfji"][1] == "abcdefgh" and got["éabcdef"][0] == "aabcdef"


def test_odd_rows(spark, tables):
    rows = [(1, None, "x"), (None, "", "y"), (2, "STRASSE straße Straße " * 3, "z"), (2, "STRASSE straße Straße " * 3, "z"),
            (3, "longword " * 50000, "w"), (4, "tiny a b", "v"), (None, "nothing × ÷ÀÿÀÿÀÿ", "u")]
    docs = tables(spark, rows, "doc_id long, text string, word string")
    got = {r.word: r.n for r in spelling.count_words(docs, alter=queries.drop_letter).collect()}
    assert got == brute_counts([r[:2] for r in rows])
    plain = {r.word: r.n for r in spelling.count_words(docs, min_count=1).collect()}
    assert plain["longword"] == 50000 and plain["straße"] == 12 and plain["÷àÿàÿàÿ".replace("à", "À")] == 1
    assert spelling.variants(spelling.count_words(docs.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=6), min_size=2, max_size=2, unique=True))
def test_common_lengths_find_single_edits(pair):
    width = max(map(len, pair))
    a, b = ([spelling.code_points([w], width, right) for right in (False, True)] for w in pair)
    both = spelling.common(a[0], b[0])[0, 0] + spelling.common(a[1][:, ::-1], b[1][:, ::-1])[0, 0]
    assert (both >= width - 1 and abs(len(pair[0]) - len(pair[1])) <= 1) == one_edit(*pair)
