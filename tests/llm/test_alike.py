"""The near-duplicate stage against brute-force Jaccard of five-word shingles."""

import random
from fractions import Fraction

import numpy as np
import pytest

from pitchloom.llm import alike, simhash


def brute_sets(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_groups(texts):
    sets = [brute_sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not either or Fraction(both, either) >= Fraction(4, 5):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited_corpus():
    """Edited copies of nine texts, a passage that all share, exact copies, and lengths where 0.8 is met exactly."""
    r = random.Random(4)
    word = lambda: f"w{r.randrange(5000)}"
    passage, texts = [word() for _ in range(30)], []
    for n in (9, 13, 40, 60, 100, 150, 250, 400, 90):
        base = passage + [word() for _ in range(n)]
        for _ in range(40):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + max(2, len(base) // 40))):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts += [" ".join(base), " ".join(base[: len(base) * 4 // 5 + 1]), " ".join(base).upper()]
    return texts + ["a b c d e f g h i", "a b c d e f g h", "a b c d", "a b c", ""]


@pytest.mark.parametrize("large", [4, 64])
def test_groups_equal_brute_force(spark, large):
    texts = edited_corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {}
    for r in alike.groups(docs, large).collect():
        found.setdefault(r.group, []).append(r.doc_id)
    least = {d: min(own) for own in found.values() for d in own}
    assert [least[i] for i in range(len(texts))] == brute_groups(texts)


def test_stage_leaves_one_of_each_group(spark):
    texts = edited_corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect()) == sorted(set(brute_groups(texts)))


def test_a_large_bucket_reports_a_forest(spark):
    """200 alike nodes of one key, each its own component, and one that fits no other: 199 rows, not 19,900."""
    mark, far = bytes([1] * alike.CLASSES), bytes([9] * alike.CLASSES)
    rows = [(7, i, 64 << alike.PLACE, i, mark) for i in range(200)] + [(7, 200, 64 << alike.PLACE, 200, far)]
    given = spark.createDataFrame(rows, "key long, node long, sp long, root long, sketch binary").coalesce(1)
    found = alike.later_pairs(given.sortWithinPartitions("key", "node")).collect()
    assert len(found) == 199
    assert {r.root for r in simhash.components(spark.createDataFrame([(r.a, r.b) for r in found], "a long, b long")).collect()} == {0}


@pytest.mark.parametrize("most", [1 << 19, 600])
def test_groups_of_candidates_equal_brute_force(spark, most):
    """One group of candidates, most of which are not alike, in one task and in blocks; some nodes are joined before."""
    texts = list(dict.fromkeys(t.lower() for t in edited_corpus() if len(t.split()) >= 43))
    sets = [alike.shingle_set(t) for t in texts]
    nodes = [alike.node_of(h) for h in sets]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    ties = {r.text: r.tie for r in docs.selectExpr("text", "xxhash64(text) AS tie").collect()}
    table = spark.createDataFrame([(n, len(h), ties[t]) for n, h, t in zip(nodes, sets, texts, strict=True)], "node long, size int, tie long")
    pairs = spark.createDataFrame([(min(nodes[0], n), max(nodes[0], n)) for n in nodes[1:]], "a long, b long")
    brute = brute_groups(texts)
    before = {i: next(j for j in range(i + 1) if brute[j] == brute[i]) for i in range(0, len(texts), 3)}
    root = spark.createDataFrame([(nodes[i], nodes[j]) for i, j in before.items()], "node long, root long")
    found = alike.linked_in_groups(pairs, root, table, docs, "text", 4, most).collect()
    forest, at = simhash.Forest(len(nodes)), {n: i for i, n in enumerate(nodes)}
    for i, j in [*before.items(), *((at[r.a], at[r.b]) for r in found)]:
        forest.join(i, j)
    assert forest.labels(np.arange(len(nodes))).tolist() == brute
    if most == 1 << 19:
        assert len(found) < len(nodes)
