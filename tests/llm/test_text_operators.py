"""The text operators on hard rows (nulls, empty and long texts, ties, repeated rows, clashing names) and brute force."""

import hashlib
import pickle
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gearsight.llm import (chat, exact_dedup, mixing, near_dedup, packing, pieces, substring_dedup, topk, toxicity,
                           url_filter)
from gearsight.llm.components import components
from gearsight.llm.textwords import hashes_of

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, kept boolean, row string, id long"
BASE = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, BASE, None, "a", 9), (2, BASE, True, None, 8), (3, None, False, "b", 7), (4, "", None, "c", 6),
        (None, "x y", None, "d", 5), (5, BASE.replace("w30", "other"), None, "e", 4), (5, BASE.replace("w30", "other"), None, "e", 4),
        (6, "idiot\tIdiot É é <|endoftext|> </s>\x0b. 日本 ▁", None, "f", 3), (7, "word " * 30000, None, "g", 2),
        (8, "start " + " ".join(f"w{i}" for i in range(25)) + " end", None, "h", 1)]


@pytest.fixture(scope="module")
def docs(spark, tables):
    return tables(spark, ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark, tables):
    return tables(spark, [], SCHEMA)


def test_exact_dedup(docs, empty):
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == ["doc_id", "text", "row", "id", "keep_id", "group_size", "kept", "text_sha256"]
    got = {(r.doc_id, r.id): (r.keep_id, r.group_size, r.kept) for r in out.collect()}
    assert got[1, 9] == (2, 2, False) and got[2, 8] == (2, 2, True)
    assert got[3, 7] == (4, 2, False) and got[4, 6] == (4, 2, True)
    assert got[None, 5] == (None, 1, True) and got[5, 4] == (5, 2, True)
    assert out.count() == len(ROWS)
    assert exact_dedup.kept_rows(docs).count() == len({t or "" for _, t, *_ in ROWS})
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_filter_passes_every_repeat(spark):
    hashes = spark.range(0, 5000).select((F.col("id") % 4000).alias("x")).select(F.xxhash64("x").alias("h")).repartition(4)
    bitmap = exact_dedup.repeat_filter(hashes, 5000, 1)
    again = np.array([r.h for r in spark.range(0, 1000).select(F.xxhash64("id").alias("h")).collect()])
    assert all(exact_dedup.has_bits(bitmap, c).all() for c in exact_dedup.probes(again, len(bitmap) * 8))


def brute_substrings(rows, length):
    seen, out = {}, {}
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            key = tuple(words[s:s + length])
            if key in seen:
                gone[s:s + length] = [True] * length
            seen.setdefault(key, (doc, s))
        out[doc] = b" ".join(w for w, g in zip(words, gone) if not g).decode()
    return out


def test_substring_dedup(docs, empty):
    got = substring_dedup.substring_dedup(docs)
    assert got.columns == ["doc_id", "text", "kept", "row", "id", *substring_dedup.MADE]
    rows = sorted({(r[0], r[1]) for r in ROWS}, key=lambda r: (r[0] is not None, r[0] or 0))
    want = brute_substrings(rows, 20)
    assert got.count() == len(ROWS)
    assert all(r.kept_text == want[r.doc_id] for r in got.collect())
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_near_dedup(docs, empty):
    got = {(r.doc_id, r.id): r.class_id for r in near_dedup.classes(docs).collect()}
    assert got[1, 9] == got[2, 8] == 1 and got[3, 7] == got[4, 6] == 3 and got[None, 5] is None and got[5, 4] == 1
    assert near_dedup.classes(empty).count() == 0


def test_near_copies_without_an_id_of_their_own(spark, tables):
    """Two groups of near copies without ids, two under one id, two lone texts under one id: each group keeps one row."""
    import corpus_pipeline as pipeline

    groups, rows = [], []
    for g, ids in enumerate([(None, None), (None, None), (7, 7), (7, 8), (9,), (9,)]):
        base = [f"g{g}w{i}" for i in range(60)]
        texts = [" ".join([*base[:59], f"end{i}"]) for i in range(len(ids))]
        groups.append(set(texts))
        rows += zip(ids, texts)
    out = pipeline.drop_near_copies(spark, tables(spark, rows, "doc_id long, text string"), SMALL)
    assert out.columns == ["doc_id", "text"]
    got = out.collect()
    assert [sum(r.text in group for r in got) for group in groups] == [1] * len(groups)
    first = {t: hashlib.sha256(t.encode()).digest() for t in set().union(*groups[:3])}
    assert all(min(group, key=first.get) in {r.text for r in got} for group in groups[:3])
    assert sorted(r.doc_id or 0 for r in got) == [0, 0, 7, 7, 9, 9]


def test_near_dedup_stage_against_brute_force(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").dropDuplicates(["text"])
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    found = [near_dedup.symbols(hashes_of(t.encode().split()), 5) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and near_dedup.aligned(found[a], found[b], 0.8) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    wide = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in pipeline.drop_near_copies(spark, wide, SMALL).collect()}
    assert got == {rows[x][0] for x in set(label)} and len(got) < len(rows)


def test_near_dedup_closes_large_groups(spark, tables):
    """A family, a chain of texts that drift apart, and texts that only share a passage, in buckets beyond the limit."""
    rng = np.random.default_rng(1)
    word = [f"v{i}" for i in range(5000)]
    base = list(rng.choice(word, 150))
    texts = []
    for _ in range(60):
        own = list(base)
        own[rng.integers(150)] = "changed"
        texts.append(own)
    now = list(rng.choice(word, 150))
    for i in range(30):
        now = list(now)
        now[5 * i % 150] = f"drift{i}"
        texts.append(now)
    passage = list(rng.choice(word, 60))
    texts += [passage + list(rng.choice(word, 60)) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = [near_dedup.symbols(hashes_of(t.encode().split()), 5) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if near_dedup.aligned(found[a], found[b], 0.6) >= 0.8 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(tables(spark, rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == label
    assert len(set(label[60:90])) == 1 and len(set(label[90:])) == 60


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200)]
    frame = spark.createDataFrame(links, "a int, b int").select(*(F.encode(F.lpad(F.col(c).cast("string"), 4, "0"), "utf-8").alias(c) for c in "ab"))
    got = defaultdict(set)
    for r in components(frame).collect():
        got[bytes(r.label)].add(int(r.node))
    assert sorted(map(len, got.values())) == [41, 50]


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs, path).collect()
    library, want = Tokenizer.from_file(path), Counter()
    for doc, text, *_ in ROWS:
        want[doc, tuple([*library.encode(text or "", add_special_tokens=False).ids, 1])] += 1
    got = defaultdict(list)
    for r in rows:
        assert r.length == 1 << r.bucket <= 2048 and len(r.ids) == 4 * r.length and r.offset == 0
        got[r.doc_id].append((r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())))
    assert len({r.sequence_id for r in rows}) == len(rows)
    for (doc, ids), times in want.items():
        assert Counter(got[doc])[0, ids[:1 << min(11, len(ids).bit_length() - 1)]] == times
        assert sum(len(i) for _, i in got[doc]) == len(ids) * times
    assert packing.pack(empty, path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, path, longest=1000)


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 9999])
def test_binary_lengths(n):
    found = packing.lengths(n, 2048)
    assert sum(found) == n and all(x & (x - 1) == 0 for x in found) and found == sorted(found, reverse=True)


def test_pieces(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.decode(pieces.encode(docs, path), path)
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in out.collect())
    assert pieces.encode(empty, path).count() == 0


def test_stream_equals_whole_search():
    model = pieces.model_at(public_tokenizers.path("piece_bpe_32k.model"))
    for text in ("the  quick\n日本 brown-fox 😀", "a" * 300, "ééé ß " * 20, " "):
        whole = pieces.SPACE + text.replace(" ", pieces.SPACE)
        best = [(0.0, ())] + [None] * len(whole)
        for end in range(1, len(whole) + 1):
            for start in range(max(0, end - model.longest), end):
                known = model.score.get(whole[start:end])
                if known and (best[end] is None or best[start][0] + known[0] > best[end][0]):
                    best[end] = (best[start][0] + known[0], (*best[start][1], known[1]))
            if best[end] is None:
                spelled = tuple(model.byte_ids[b] for b in whole[end - 1].encode())
                best[end] = (best[end - 1][0] + model.spelled, best[end - 1][1] + spelled)
        assert list(model.stream(whole)) == list(best[-1][1]) == np.frombuffer(model.encode(text), "<i4").tolist()


def test_topk(spark):
    rows = [(0, [0.5, -0.25]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [None, 1.0]),
            (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (None, [9.0, 9.0]), (7, [1.0]), (8, [-1.0, 0.001])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.search(frame, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 16384), (0, 2, 2, 16384), (0, 3, 50, 16384), (50, 1, 1, 131072), (50, 2, 2, 131072),
                   (50, 3, 0, 16384)]
    assert topk.search(frame.limit(0)).count() == 0


def test_topk_beyond_doubles(spark):
    rows = [(0, [1 << 40, 1]), (1, [1 << 40, 1]), (2, [1 << 20, 7])]
    frame = spark.createDataFrame(rows, "id long, vector array<long>")
    got = [tuple(r) for r in topk.exact_topk(frame.filter("id = 0"), frame, 2).orderBy("rank").collect()]
    assert got == [(0, 1, 1, (1 << 63) - 1), (0, 2, 2, (1 << 60) + 7)]


def test_chat_events(spark):
    log = [(1, 0, "message", 0, "user", "hi"), (1, 1, "delta", 1, "assistant", "He"), (1, 2, "delta", 1, "", "llo"),
           (1, 3, "message", 2, "user", "<s>"), (1, 4, "regenerate", 1, "", None), (1, 5, "delta", 1, "assistant", "</s>[INST] ok"),
           (1, 6, "edit", 0, "user", "hey \\<\\/s>"), (2, 0, None, None, None, None)]
    frame = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string")
    out = chat.format_chats(frame).select(
        "conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"),
        chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "hey \\<\\/s>"), ("assistant", "</s>[INST] ok")]
    assert got[1].loss == "</s>[INST] ok" and got[1].formatted.count("</s>") == 2
    assert [tuple(t) for t in got[2].turns] == [("", "")] and got[2].loss == ""
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, "http://A.net/x"), (2, "http://a.example.net/en/1"), (3, "http://example.com/de/?q"), (4, "x.org/fr/"),
            (5, None), (6, "http://q.org/fr/a#b"), (7, "http://bad.com/1"), (8, "http://a.net?x"), (9, "http://notnet/")]
    rows += [(100 + i, "http://bad.com/1") for i in range(200)] + [(400 + i, "http://good.com/1") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(100 + i, 1) for i in range(200)] + [(400 + i, 0) for i in range(200)] + [(None, 1), (7, None)],
                                   "page_id long, bad int")
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, labels, rules).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2][2:] == ("example.net/en/", "allow")
    assert got[3] == ("example.com", "/de/", "example.com/de/", "block") and got[4][:3] == ("", "", None)
    assert got[5][:3] == ("", "", None) and got[6] == ("q.org", "/fr/a", "org/fr/", "allow")
    assert got[7][2:] == (None, "block") and got[8][:3] == ("a.net", "", None) and got[400][3] == "allow"
    assert url_filter.filter_urls(pages.limit(0), labels, rules).count() == 0


def test_toxicity(spark, docs, empty, tables):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice([f"w{j}" for j in range(300)], 60))
        toxic = int(i % 4 == 0)
        if toxic:
            words[10], words[30] = "blorgish", "blorgest"
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    frame = tables(spark, rows, "doc_id long, text string")
    known = tables(spark, [*labels, (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(frame, known)
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, model).collect())
    none = toxicity.train(empty, known.limit(0))
    assert toxicity.score_toxicity(empty, none).count() == 0 and toxicity.score_toxicity(docs, none).count() == len(ROWS)


def test_mixing(spark, docs, empty):
    got = mixing.score_texts(docs).collect()
    tokens = [(d, [*(t or "").encode().lower().split(), b""]) for d, t, *_ in ROWS]
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in tokens}
    count = Counter(w for d, t in tokens if not held[d] for w in t)
    n, kinds = sum(count.values()), len(count)
    want = sorted((d or 0, len(t), round(sum(log10((count[w] + 1) / (n + kinds + 1)) for w in t), 6)) for d, t in tokens)
    assert sorted((r.doc_id or 0, r.n_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.train_tokens == n and r.held_out == held[r.doc_id] for r in got)
    assert mixing.score_texts(empty).count() == 0


@pytest.mark.parametrize("tasks", [3, 20])
def test_tree_sum_beyond_four_bytes(spark, tasks):
    """Counts near 2^31 in several tasks, by one round of merging and by two."""
    data = np.zeros(mixing.PIECE, np.int32)
    data[7], data[9] = (1 << 31) - 1, 5
    parts = spark.createDataFrame([(1, part, bytearray(data.tobytes())) for part in range(tasks)],
                                  "piece int, part int, data binary")
    got = mixing.tree_sum(parts, tasks, 2 * mixing.PIECE)
    assert got[mixing.PIECE + 7] == tasks * ((1 << 31) - 1) and got[mixing.PIECE + 9] == 5 * tasks
    assert not got[:mixing.PIECE].any()
    table = np.zeros((3, 4, 2), np.int64)
    table[:, 0] = got[mixing.PIECE + 7], 1 << 32
    assert np.isfinite(mixing.Predictors(table).logits).all()


def test_weights_fit_all_training_texts(spark, tables, monkeypatch):
    """Hundreds of copies of the text of the lowest hash among others: no other weights code all bits much shorter."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{min(i, 900)}" for i in rng.zipf(1.3, 80)) for _ in range(300)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    texts += [frame.orderBy(F.xxhash64("text")).first().text] * 500
    found, finish = [], mixing.Scorer.finish

    def caught(self, given):
        found.append((self, self.tables))
        finish(self, given)

    monkeypatch.setattr(mixing.Scorer, "finish", caught)
    mixing.score_texts(tables(spark, [(None, t) for t in texts], "doc_id long, text string"))
    scorer, counts = found[0]
    _, place, _, symbol = scorer.tokens_of([[*t.encode().split(), b""] for t in texts])
    _, bit, slots = mixing.word_bits(scorer.code, symbol, place)
    logits, gate = mixing.inputs_without(counts[0], slots, bit)
    lengths, weights = [], scorer.word_weights.copy()
    for _ in range(200):
        p = mixing.chance(weights[gate], logits)
        lengths.append(-np.log(np.where(bit == 1, p, 1 - p), dtype=float).sum())
        weights += mixing.steps(gate, 16, bit - p, p, logits, mixing.START_HOLD)
    assert lengths[0] < 1.001 * min(lengths), (lengths[0], min(lengths))


def test_code_is_a_distribution():
    """The mixed bits give probabilities of all symbols that add up to 1."""
    scorer = mixing.Scorer([f"w{i}".encode() for i in range(40)], np.arange(40, 0, -1), 900, 10)
    scorer.finish([])
    n = 43
    cost = [sum(log10(0.5) for _ in range(scorer.code.start[s + 1] - scorer.code.start[s])) for s in range(n)]
    assert abs(sum(10 ** c for c in cost) - 1) < 1e-9


def test_words_beyond_the_list_cost_a_share_of_their_counts(spark, tables, monkeypatch):
    """Known words have shares of their counts however far down they stand; only new ones are spelled."""
    monkeypatch.setattr(mixing, "HEAD", 8)
    texts = ["often " * 40 + " ".join(f"w{i} " * 9 for i in range(12)), "zq zq zq zq", "zq", "kj", "kj kj"]
    texts += [f"only{i}" for i in range(6)]
    got = {r.doc_id: r for r in mixing.score_texts(tables(spark, [
        (None, t) for t in texts] + [(d, t) for d, t in zip((d for d in range(99) if zlib.crc32(str(d).encode()) % 7 == 2),
                                                           ("zq", "kj", "neverseen"))], "doc_id long, text string")).collect()
           if r.doc_id is not None}
    zq, kj, new = (got[d] for d in sorted(got))
    assert all(r.held_out for r in got.values()) and [r.n_known for r in (zq, kj, new)] == [2, 2, 1]
    assert abs(zq.score - kj.score - log10(5 / 3)) < 1e-6 and new.score < kj.score


@pytest.mark.parametrize("head", [8, 64])
def test_words_without_a_code_are_predicted_by_the_word_before(spark, tables, monkeypatch, head):
    """Right words, listed or beyond the list, follow their left words only: the same words the other way cost more."""
    monkeypatch.setattr(mixing, "HEAD", head)
    monkeypatch.setattr(mixing, "CODED", 2)
    texts = [" ".join(f"l{(i + k) % 6} r{(i + k) % 6} l{(i + k) % 6}" for k in range(6)) for i in range(60)]
    held = [d for d in range(99) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    got = {r.doc_id: r for r in mixing.score_texts(tables(spark, [(None, t) for t in texts] + [
        (held[0], "l2 r2 l3 r3"), (held[1], "l2 r3 l3 r2")], "doc_id long, text string")).collect() if r.doc_id is not None}
    met, apart = (got[d] for d in held)
    assert abs(met.base_score - apart.base_score) < 1e-9 and met.score > apart.score + 1


def test_workers_hold_what_their_step_needs():
    """No empty tables are sent to workers, no whole table beside its predictions, no bits of a whole long text."""
    rng = np.random.default_rng(3)
    words = [f"w{i}".encode() for i in range(3000)]
    scorer = mixing.Scorer(words, np.arange(3000, 0, -1), 5_000_000, 1000)
    assert len(pickle.dumps(scorer)) < 1e6
    symbol = rng.integers(1, mixing.CODED, 300_000)
    symbol[-1] = mixing.END
    _, bit, found = mixing.word_bits(scorer.code, symbol, np.arange(len(symbol)))
    table = np.zeros(mixing.TABLE, np.int64)
    mixing.tally(table, bit, found)
    parts = list(mixing.word_bits_in_parts(scorer.code, symbol, np.arange(len(symbol))))
    assert max(len(b) for b, _ in parts) < len(bit) / 5 and (np.concatenate([b for b, _ in parts]) == bit).all()
    assert all((np.concatenate([f[k] for _, f in parts]) == found[k]).all() for k in range(mixing.ORDERS))

    def peak(work):
        tracemalloc.start()
        out = work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most / 1e6

    want = mixing.inputs_without(table, found, bit)
    sent = pickle.dumps(mixing.Shipped(table))
    known, most = peak(lambda: pickle.loads(sent).known)
    assert most < 2 * 4e-6 * table.size, most
    assert all((a == b).all() for a, b in zip(known(found, bit), want))
    scorer.tables = table, table
    scorer.finish([])
    model = pickle.loads(pickle.dumps(scorer.only(0, "code", "word_weights")))
    assert model.tables[1] is None and not hasattr(model, "index")
    texts = [symbol.astype(np.int16).tobytes(), symbol[-40:].astype(np.int16).tobytes()]
    got, most = peak(lambda: model.score(texts))
    assert most < 60, most
    assert abs(got[0] - model.score(texts[:1])[0]) < 1e-6 * abs(got[0]) and (got < 0).all()


def test_pipeline_stages(spark):
    """Each stage against brute force on what the stage before kept."""
    import corpus_pipeline as pipeline
    from gearsight.llm.common import stage

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, step in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else {}
        docs = stage(step(spark, docs, SMALL), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else {}
        if name == "exact_dedup":
            assert after == {max(d for d, x in before.items() if x == t): t for t in before.values()}
        elif name == "near_dedup":
            assert set(after) <= set(before) and all(before[d] == t for d, t in after.items())
        elif name == "substring_dedup":
            want = brute_substrings(sorted(before.items()), 20)
            assert {d: " ".join(t.split()) for d, t in after.items()} == {d: " ".join(t.split()) for d, t in want.items()}
        elif name == "packing":
            assert {r.doc_id for r in docs.collect()} == set(before)


def test_hash_of_kept_text(spark):
    from gearsight.llm import queries

    got = {r.doc_id: r.kept_sha256 for r in queries.QUERIES["op9_substring_dedup"](spark, SMALL).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in brute_substrings(rows, 20).items()}


def test_masks_never_understate_what_is_common():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 300, 5000):
        a = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        b = np.concatenate([a[: n // 2], rng.integers(0, 1 << 32, n // 3, dtype=np.uint32)])
        for x, y in ((a, b), (b, a), (a, a)):
            only = near_dedup.mask_of(x) & ~near_dedup.mask_of(y)
            assert len(only) == near_dedup.MASK_WORDS
            assert np.bitwise_count(only.view(np.uint64)).sum() <= len(set(x.tolist()) - set(y.tolist()))


def test_words_in_texts():
    """Words split in columns are those of Python's split of bytes; parts of a batch hold all rows in order."""
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \t\n\x0b\x0c\r\x1c\x85\xa0aBÉzÿ日") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    texts += [None, "", " ", "  a  ", "x" * 5000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = list(mixing.by_bytes(batch, 0, 100))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts and len(parts) > 20
    want = [(t or "").encode().lower().split() for t in texts]
    for part, at in zip(parts, np.cumsum([0, *(p.num_rows for p in parts)])):
        words, size = mixing.words_in(part.column(0))
        assert size.tolist() == [len(t) for t in want[at:at + part.num_rows]]
        assert words.to_pylist() == [w for t in want[at:at + part.num_rows] for w in t]
    words, size = mixing.words_in(batch.column(0))
    scorer = mixing.Scorer([b"a", b"b", b"z"], np.array([5, 4, 2]), 40, 5)
    place, hashes = scorer.find(words)
    flat = [w for t in want for w in t]
    assert place.tolist() == [{b"a": 0, b"b": 1, b"z": 2}.get(w, -1) for w in flat]
    assert hashes.tolist() == [zlib.crc32(w) >> 1 for w in flat if w not in (b"a", b"b", b"z")]


def test_sums_of_gates_and_bits():
    """Sums of slopes against plain ones of each gate; counts of bits by either way of adding."""
    rng = np.random.default_rng(5)
    n, weights = 3000, rng.normal(0.4, 0.2, (16, mixing.ORDERS))
    logits, gate = rng.normal(0, 2, (mixing.ORDERS, n)).astype(np.float32), rng.integers(0, 15, n).astype(np.uint8)
    bit, times = rng.integers(0, 2, n).astype(np.int8), rng.integers(1, 9, n)
    for t in (None, times):
        got = mixing.slopes(weights, logits, gate, bit, t)
        for g in range(16):
            x, b, k = logits[:, gate == g].astype(float), bit[gate == g], 1 if t is None else t[gate == g]
            p = 1 / (1 + np.exp(-np.clip(weights[g] @ x, -14, 14)))
            want = np.r_[(-np.log(np.where(b == 1, p, 1 - p)) * k).sum(), ((b - p) * k * x).sum(axis=1),
                         ((p * (1 - p) * k * x) @ x.T).ravel()]
            assert np.allclose(got[g], want, rtol=1e-3, atol=1e-2)
    table, plain = np.zeros((3, 1 << 14, 2), np.int32), np.zeros((3, 1 << 14, 2), np.int32)
    found = [rng.integers(0, top, n) for top in (40, 1 << 14, 1 << 14)]
    mixing.tally(table, bit, found)
    for k in range(3):
        np.add.at(plain[k], (found[k], bit), 1)
    assert (table == plain).all()
