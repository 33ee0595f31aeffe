"""SimHash near-duplicates and I-Match fingerprints."""

import hashlib
import itertools
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitchloom.llm import fingerprints, simhash


def brute_fingerprint(text, size=4):
    t = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(fps, most):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= most:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def near_family(rng, n, spread):
    """Fingerprints in clusters, chains and dense balls."""
    out = set()
    while len(out) < n:
        x = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(int(rng.integers(1, 12))):
            out.add(x)
            for b in rng.choice(64, int(rng.integers(1, spread)), replace=False):
                x ^= 1 << int(b)
    return sorted(out)


def test_fingerprints(spark, odd_documents):
    got = simhash.fingerprints(odd_documents).collect()
    assert [r.fp for r in got] == [signed(brute_fingerprint(r.text)) for r in odd_documents.collect()]
    # Spark's own hash of a string is the same function
    assert spark.sql("SELECT xxhash64('alpha beta gamma delta') AS h").first().h == signed(xxhash.xxh64_intdigest("alpha beta gamma delta", 42))


@pytest.mark.parametrize("most", [0, 1, 3, 4])
def test_components_equal_brute_force(spark, most):
    fps = near_family(np.random.default_rng(most), 400, 7)
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    edges = simhash.links(nodes, most, 4)
    for r in edges.collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= most
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    order = sorted(signed(x) for x in fps)
    roots = brute_roots([x & (2**64 - 1) for x in order], most)
    assert [found.get(x, x) for x in order] == [order[i] for i in roots]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_every_link_passes_some_chain(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    d = np.array([x ^ y], np.uint64)
    for pieces, depth in ((2, 2), (2, 3), (3, 3), (3, 4)):
        scheme = simhash.Scheme(4, pieces, depth)
        a, b = (simhash.bucket_keys(np.array([v], np.uint64), scheme)[0] for v in (x, y))
        shared = [start for i, (start, _) in enumerate(scheme.keys()) if a[i] == b[i]]
        assert any(len(simhash.linked(d, simhash.chain_masks(i, 4), 4)) for i in shared)


def test_schemes_grow_with_the_fingerprints():
    found = [simhash.scheme_for(n, 4) for n in (10, 10**6, 10**8, 10**10, 10**13)]
    bits = [x.bits for x in found]
    assert bits == sorted(bits) and bits[0] >= 18 and bits[-1] > 28
    assert len(found[0].keys()) == 10 and all(len(x.keys()) < 1 << 12 for x in found)


@pytest.mark.parametrize("pieces, depth", [(2, 3), (3, 3)])
def test_wider_keys_find_the_same_components(spark, pieces, depth):
    fps = near_family(np.random.default_rng(9), 300, 7)
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(nodes, 4, 4, scheme=simhash.Scheme(4, pieces, depth))).collect()}
    order = sorted(signed(x) for x in fps)
    roots = brute_roots([x & (2**64 - 1) for x in order], 4)
    assert [found.get(x, x) for x in order] == [order[i] for i in roots]


def test_a_bucket_of_many_unlike_fingerprints_ends_soon():
    """A hundred thousand that share a key, a few of them linked."""
    rng = np.random.default_rng(3)
    v = np.unique(rng.integers(0, 2**45, 100_000, np.uint64) << np.uint64(19))
    near = v[:50] ^ np.uint64(1 << 40)
    both = np.unique(np.r_[v, near])
    began = time.perf_counter()
    edges = simhash.bucket_forest(both, 0, 4)
    assert time.perf_counter() - began < 30
    found = {frozenset((int(both[a]), int(both[b]))) for a, b in edges}
    forest = simhash.Forest(len(both))
    for a, b in edges:
        forest.join(a, b)
        assert int(both[a] ^ both[b]).bit_count() <= 4
    place = {int(x): i for i, x in enumerate(both)}
    assert found and all(forest.find(place[int(x)]) == forest.find(place[int(x ^ np.uint64(1 << 40))]) for x in v[:50])


def test_large_bucket_forest():
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**64, dtype=np.uint64))
    fps = {base}
    while len(fps) < 300:
        x = base
        for b in rng.choice(np.arange(13, 64), int(rng.integers(0, 7)), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    v = np.array(sorted(fps), np.uint64)
    masks = simhash.chain_masks(0, 4)
    edges = simhash.bucket_forest(v, 0, 4, block=16)
    one, two = simhash.Forest(len(v)), simhash.Forest(len(v))
    for a, b in edges:
        one.join(a, b)
    for i in range(len(v)):
        for j in simhash.linked(v ^ v[i], masks, 4).tolist():
            two.join(i, j)
    assert [one.find(i) for i in range(len(v))] == [two.find(i) for i in range(len(v))]
    assert len(edges) <= 2 * len(v)


def test_a_long_chain_settles(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def path_or_tree(seed):
    """Edges of one path (odd seeds) or tree of 5 to 10 nodes, labelled at random."""
    rng = np.random.default_rng(seed)
    names = rng.permutation(int(rng.integers(5, 11))).tolist()
    over = [i - 1 if seed % 2 else int(rng.integers(0, i)) for i in range(1, len(names))]
    return [tuple(sorted((names[i], names[j]))) for i, j in enumerate(over, 1)]


# one graph at a time: among several, the rounds go on until the slowest has settled
@pytest.mark.parametrize("edges", [[(3, 5), (5, 6), (6, 7), (4, 7)], *map(path_or_tree, range(6))])
def test_one_component_has_one_root(spark, edges):
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    assert found == dict.fromkeys(nodes, min(nodes))


def test_near_duplicates(spark, odd_documents, no_documents, corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_roots(fps, 4)
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        least[r] = min(d, least.get(r, d))
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(corpus).collect()}
    assert got == {d: (signed(f), least[r]) for (d, _), f, r in zip(rows, fps, roots, strict=True)}
    odd = simhash.near_duplicates(odd_documents).collect()
    assert len(odd) == 12 and {r.component_id for r in odd if r.fp == 0} == {2}
    assert simhash.near_duplicates(no_documents).count() == 0


def test_stage_keeps_one_of_each(spark, odd_documents, no_documents):
    kept = simhash.stage(spark, odd_documents, "").collect()
    # two different texts have the id 8: each is its own group, and neither is lost
    assert Counter(r.doc_id for r in kept if r.doc_id is not None) == Counter([1, 2, 4, 6, 8, 8])
    assert Counter(r.text for r in kept) == Counter(dict.fromkeys((r.text for r in kept), 1)) and len(kept) == 7
    assert kept[0].asDict().keys() == odd_documents.first().asDict().keys()
    assert simhash.stage(spark, no_documents, "").count() == 0


def test_lexicon_is_exact(spark, corpus):
    texts = [r.text or "" for r in corpus.collect()]
    df = Counter(h for t in texts for h in fingerprints.terms(t))
    expected = sorted(h for h, n in df.items() if 0.05 * len(texts) <= n <= 0.3 * len(texts))
    for part in (7, 100_000):
        assert fingerprints.lexicon(corpus.repartition(3), 0.05, 0.3, part=part).tolist() == expected


def brute_signatures(text, lexicon, subsets=32, seed=11):
    """From the definition: term by term and subset by subset, with Python's own numbers."""
    seeds = np.random.default_rng(seed).integers(0, 2**63, subsets, np.uint64).tolist()
    most = 2**64 - 1

    def level(term, s):
        x = term ^ s
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & most
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & most
        x ^= x >> 31
        return (x & -x).bit_length() - 1 if x else 64

    words = sorted({xxhash.xxh64_intdigest(w) for w in (text or "").encode().split()})
    listed = [t for t in words if t in lexicon]
    out = {}
    for mark, held, used in (("l", listed, len(listed) >= 4), ("w", words, len(listed) < 4 or len(words) < 32)):
        if used:
            first = max(0, round(np.log2(len(held)))) if held else 0
            for k in range(first, first + 5):
                out[mark, k] = []
                for s in seeds:
                    own = [t for t in held if level(t, s) >= k]
                    out[mark, k].append(f"{xxhash.xxh64_intdigest(b''.join(t.to_bytes(8, 'little') for t in own)) & 0xFFFFFFFF:08x}" if own else "")
    return out


def brute_likeness(x, y):
    same = either = 0
    for k in x:
        if k in y:
            for p, q in zip(x[k], y[k]):
                if p or q:
                    either += 1
                    same += p == q
    return 1.0 if x == y else same / either if either else 0.0


def test_signatures_against_brute_force(spark, corpus, odd_documents):
    lexicon = fingerprints.lexicon(corpus)
    sign, known = fingerprints.Signer(lexicon), set(lexicon.tolist())
    texts = [r.text for r in corpus.limit(25).collect() if len(r.text or "") < 20_000] + [r.text for r in odd_documents.collect() if len(r.text or "") < 9000] + ["", "one", "a b c d"]
    brute = [brute_signatures(t, known) for t in texts]
    marks = [sign(t or "") for t in texts]
    assert [fingerprints.signatures(m) for m in marks] == brute
    for (a, x), (b, y) in itertools.combinations(list(zip(marks, brute)), 2):
        assert fingerprints.likeness(a, b) == pytest.approx(brute_likeness(x, y))


def test_unlike_short_texts_sign_unlike():
    """One to five terms of the lexicon, with or without other words."""
    named = [f"term{i}" for i in range(600)]
    sign = fingerprints.Signer(np.sort(np.fromiter(fingerprints.terms(" ".join(named)), np.uint64)))
    texts = [" ".join(named[i : i + k]) for k in (1, 3, 5) for i in range(0, 600, 5)]
    marks = [sign(t) for t in texts]
    assert len(set(marks)) == len(set(texts))
    assert max(fingerprints.likeness(a, b) for a, b in itertools.combinations(marks[:120], 2)) == 0
    assert sign("term1 other") != sign("term1 else")
    assert sign("") == sign(" ") and fingerprints.likeness(sign(""), sign("")) == 1 and fingerprints.likeness(sign(""), sign("a")) == 0


def test_half_edited_texts_are_nearer_than_the_next(spark):
    """In every band of length, for nine in ten documents; those of a few words lose them to the cut."""
    rows = fingerprints.query(spark, "/root/testdata/sf0.1").collect()
    for low, high, share in ((0, 100, 0.7), (100, 300, 0.9), (300, 1000, 0.9), (1000, 3000, 0.9), (3000, 10_000, 0.9), (10_000, 10**9, 0.9)):
        own = [r for r in rows if low < r.n_chars <= high]
        assert sum(r.near_edited > r.near_next for r in own) / len(own) > share, (low, high)


def test_an_id_of_many_rows_fills_several_ranges(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(300)] + [(i, f"other {i}") for i in range(100, 150)], "doc_id long, text string")
    rows = fingerprints.with_next(docs, 8).collect()
    own = Counter(r.b for r in rows if r.k == 7 and not r.extra)
    assert len(own) >= 5 and sum(own.values()) == 300 and max(own.values()) < 100
    found = fingerprints.fingerprint(docs).collect()
    assert len(found) == 350 and Counter(r.doc_id for r in found)[7] == 300
    texts = sorted(r.text for r in docs.collect())
    assert all(any(hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest() == r.edited_sha256 for t in texts if len(t) == r.n_chars for u in texts) for r in found[:20])


def check_fingerprints(rows, docs):
    order = sorted(docs, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    texts = [r.text or "" for r in order]
    got = {r.doc_id: r for r in rows}
    marks = {}
    for i, r in enumerate(order):
        if r.doc_id is None or sum(x.doc_id == r.doc_id for x in order) > 1:
            continue
        text, nxt = texts[i], texts[(i + 1) % len(texts)]
        half = len(text) // 2
        g = got[r.doc_id]
        assert g.n_chars == len(text)
        if i + 1 < len(order) and order[i + 1].doc_id is not None and sum(x.doc_id == order[i + 1].doc_id for x in order) == 1:
            assert g.edited_sha256 == hashlib.sha256((text[: len(text) - half] + nxt[:half]).encode()).hexdigest()
            assert g.near_next == fingerprints.likeness(g.fingerprint, got[order[i + 1].doc_id].fingerprint)
        assert marks.setdefault(text, g.fingerprint) == g.fingerprint
        assert 0 <= g.near_edited <= 1 and g.near_edited == fingerprints.likeness(g.fingerprint, g.edited_fingerprint)


def test_fingerprint_rows(spark, corpus, odd_documents, no_documents):
    rows = fingerprints.fingerprint(corpus).collect()
    assert len(rows) == corpus.count()
    check_fingerprints(rows, corpus.collect())
    means = [sum(getattr(r, c) for r in rows) / len(rows) for c in ("near_edited", "near_next")]
    assert means[0] > 0.05 > means[1]
    odd = fingerprints.fingerprint(odd_documents).collect()
    assert len(odd) == 12
    check_fingerprints(odd, odd_documents.collect())
    assert fingerprints.fingerprint(no_documents).count() == 0
    single = fingerprints.fingerprint(corpus.where(F.col("doc_id") == 1)).collect()
    assert single[0].near_next == 1


def test_last_is_followed_by_the_first(spark, corpus):
    order = sorted(corpus.collect(), key=lambda r: -r.doc_id)
    last, first = order[-1], order[0]
    half = len(last.text) // 2
    edited = last.text[: len(last.text) - half] + first.text[:half]
    got = fingerprints.fingerprint(corpus).where(F.col("doc_id") == last.doc_id).first()
    assert got.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
