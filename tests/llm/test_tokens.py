"""Encoding, token files, packing and trie counts."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pitchloom.llm import common, packing, token_counts, token_files
from pitchloom.llm.tokens import Encoder, encoder, vocabulary

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


_plain = {path: Tokenizer.from_file(path) for path in (BYTE, WORD)}


def whole(path, text):
    return _plain[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,!'’sdtABCéßΣσİ#|<>12 　​́日"), st.characters(codec="utf-8")), max_size=60))
def test_stretches_equal_whole_texts(path, text):
    assert encoder(path).ids([text])[0].tolist() == whole(path, text)


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=100, deadline=None)
@given(parts=st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "a", "word", ".", "\n", "<|", "|>"]), max_size=12))
def test_special_strings_are_as_in_the_file(path, parts):
    text = "".join(parts)
    assert encoder(path).ids([text])[0].tolist() == whole(path, text)


def test_special_strings_as_text():
    assert Encoder(BYTE).ids(["<|endoftext|>"])[0].tolist() == [50256]
    assert len(Encoder(BYTE, plain=True).ids(["<|endoftext|>"])[0]) > 1


def test_cache_is_emptied_without_effect():
    small = Encoder(BYTE, cache_entries=5)
    texts = [f"word{i} and, more{i}." for i in range(50)]
    for t in texts * 2:
        assert small.ids([t])[0].tolist() == whole(BYTE, t)


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(-(2**62), 2**62), min_size=1, max_size=300))
def test_minimal_perfect_hash(keys):
    k = np.array(sorted(keys), np.int64)
    h = token_files.hashed_keys(k, np.zeros(len(k)))
    slots = token_files.find_slots(h, token_files.build_mph(h), len(k))
    assert sorted(slots.tolist()) == list(range(len(k)))


def test_token_files_round_trip(spark, odd_documents):
    root = common.shared_dir(spark, "t")
    manifest = token_files.write_token_shards(odd_documents, root, BYTE, 2, 3)
    token_files.describe(root, BYTE, 2)
    got = token_files.read_token_shards(manifest, with_ids=True).orderBy("start").collect()
    rows = sorted(odd_documents.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at = 0
    for g, r in zip(got, rows, strict=True):
        ids = [*whole(BYTE, r.text), 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids) == (r.doc_id, at, len(ids), ids)
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_files.lookup(manifest, 5).tolist() == [*whole(BYTE, rows[-1].text and [r for r in rows if r.doc_id == 5][0].text), 2]
    assert len(token_files.lookup(manifest, 8, 2)) > 1 and token_files.lookup(manifest, 99) is None


def test_a_lookup_reads_four_small_ranges(spark, corpus, monkeypatch):
    manifest = token_files.write_token_shards(corpus, common.shared_dir(spark, "t"), BYTE, 2, 6)
    texts = {r.doc_id: r.text for r in corpus.collect()}
    opened, reads = [], []
    open_store = common.open_store

    class Counted:
        def __init__(self, store):
            self.store = store

        def open_input_file(self, path):
            opened.append(path)
            inner = self.store.open_input_file(path)

            class File:
                def read_at(self, n, at):
                    reads.append(n)
                    return inner.read_at(n, at)

            return File()

    monkeypatch.setattr(common, "open_store", lambda uri: (Counted(open_store(uri)[0]), open_store(uri)[1]))
    for k in list(texts)[:20]:
        opened.clear()
        reads.clear()
        ids = [*whole(BYTE, texts[k]), 2]
        assert token_files.lookup(manifest, k).tolist() == ids
        assert len(opened) == 2 and sorted(reads) == sorted([16, 4, 24, 2 * len(ids)])
    assert token_files.lookup(manifest, 10**9) is None and token_files.lookup(manifest, -5) is None


def test_an_id_of_many_rows_fills_several_shards(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(200)] + [(i, f"other {i}") for i in range(20)], "doc_id long, text string")
    manifest = token_files.write_token_shards(docs, common.shared_dir(spark, "t"), BYTE, 2, 6)
    assert max(r.n_docs for r in manifest.collect()) < 100
    got = token_files.read_token_shards(manifest, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in docs.collect())
    assert sorted(r.ids for r in got) == sorted([*whole(BYTE, r.text), 2] for r in docs.collect())
    own = [r.ids for r in got if r.doc_id == 7]
    assert [token_files.lookup(manifest, 7, i).tolist() for i in (0, 1, 99, 100, 199, 200)] == [own[i] for i in (0, 1, 99, 100, 199, 200)]
    assert len(own) == 201 and token_files.lookup(manifest, 7, 201) is None


def test_scans_in_small_blocks(spark, corpus, monkeypatch):
    manifest = token_files.write_token_shards(corpus, common.shared_dir(spark, "t"), BYTE, 2, 3)
    for r in manifest.collect():
        shard = token_files.ShardReader(r["payload"], r["index"], r["width"])
        store, path = common.open_store(r["keys"])
        with store.open_input_stream(path) as f:
            keys = np.frombuffer(f.read(), "<i8")
        offset, length = shard.locate(keys)
        assert (offset == np.cumsum(length) - length).all() and length.sum() == r.n_ids and (r["first"], r["last"]) == (keys[0], keys[-1])


def test_token_files_of_nothing(spark, no_documents):
    manifest = token_files.write_token_shards(no_documents, common.shared_dir(spark, "t"), BYTE, 2, 3)
    assert manifest.count() == 0 and token_files.read_token_shards(manifest).count() == 0


def histogram(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_holds_the_histogram_exactly(lengths):
    h = histogram(lengths, 64)
    made = np.zeros(65, int)
    columns = packing.plan(h, 64)
    for column, times in columns:
        assert sum(k * n for k, n in column.items()) <= 64 and times > 0
        for k, n in column.items():
            made[k] += n * times
    assert (made == h).all()
    place = packing.Placement(columns, h)
    rank, seen = [], {}
    for x in lengths:
        rank.append(seen.get(x, 0))
        seen[x] = rank[-1] + 1
    if lengths:
        sequence, offset = place(np.array(lengths), np.array(rank))
        for s in range(place.sequences):
            own = sorted((o, x) for o, x, q in zip(offset, lengths, sequence, strict=True) if q == s)
            at = 0
            for o, x in own:
                assert o == at
                at += x
            assert 0 < at <= 64


def test_plan_is_near_the_volume_bound():
    rng = np.random.default_rng(1)
    for n in (300, 30_000):
        x = np.minimum(4096, rng.lognormal(6, 1, n).astype(int) + 1)
        h = histogram(x, 4096)
        assert sum(t for _, t in packing.plan(h, 4096)) <= -(-x.sum() // 4096) * 1.002 + 1


def test_pricing_is_the_best_knapsack():
    rng = np.random.default_rng(2)
    left, value = np.zeros(31, int), np.zeros(31)
    left[[3, 5, 7, 11]] = [2, 3, 1, 2]
    value[[3, 5, 7, 11]] = rng.random(4)
    got = max(sum(value[k] * n for k, n in c.items()) for c in packing.price(value, left, 30))
    best = max(a * value[3] + b * value[5] + c * value[7] + d * value[11] for a in range(3) for b in range(4) for c in range(2) for d in range(3) if 3 * a + 5 * b + 7 * c + 11 * d <= 30)
    assert got == pytest.approx(best)


def test_packing(spark, odd_documents, no_documents):
    rows = packing.pack_documents(odd_documents, WORD, 1, 512, with_ids=True).collect()
    texts = sorted(tuple([*whole(WORD, r.text), 1]) for r in odd_documents.collect())
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length <= 512
        assert r.start == 512 * r.piece
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id not in (None, 8):
            by_doc.setdefault(r.doc_id, []).append((r.piece, r.ids))
    for d, pieces in by_doc.items():
        assert tuple(x for _, ids in sorted(pieces) for x in ids) in texts, d
    assert sum(r.length for r in rows) == sum(map(len, texts))
    for placed in by_sequence.values():
        at = 0
        for o, n in sorted(placed):
            assert o == at
            at += n
        assert at <= 512
    assert packing.pack_documents(no_documents, WORD, 1).count() == 0


def brute_segment(word, scores, unknown):
    best = [(0.0, 0)] + [None] * len(word)
    for i in range(1, len(word) + 1):
        size = len(word[i - 1].encode())
        options = [(best[i - 1][0] + size * unknown, -(best[i - 1][1] + size))]
        options += [(best[j][0] + scores[word[j:i]], -(best[j][1] + 1)) for j in range(i) if word[j:i] in scores]
        s, n = max(options)
        best[i] = (s, -n)
    return best[-1][1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcé", max_size=8), max_size=20))
def test_trie_equals_single_words(words):
    scores = token_counts.rank_scores(["a", "b", "ab", "bc", "abc", "ca", "aa"])
    trie = token_counts.Trie(scores, most_nodes=30)
    for w in words:
        assert trie.count(w) == brute_segment(w, scores, trie.unknown)
        trie.room()


def test_trie_shares_prefixes():
    trie = token_counts.Trie(token_counts.rank_scores(["a", "b"]))
    trie.count("aab")
    trie.count("aaba")
    assert len(trie.best) == 5


def test_token_counts(spark, odd_documents, no_documents):
    pieces = token_counts.vocabulary_pieces(vocabulary("piece_bpe_32k.model"))
    rows = token_counts.token_counts(odd_documents, pieces).collect()
    assert len(rows) == 12
    scores = token_counts.rank_scores(pieces)
    unknown = min(scores.values()) - 10
    for g, r in zip(rows, odd_documents.collect(), strict=True):
        words = (r.text or "").split()
        assert g.n_pretokens == len(words)
        if len(words) < 1000:
            assert g.n_tokens == sum(brute_segment(token_counts.SPACE_MARK + w, scores, unknown) for w in words)
    assert token_counts.token_counts(no_documents, pieces).count() == 0
