import collections
import random
import re

import pytest

from storelens.llm.components import components
from storelens.llm.vertical_jaccard import jaccard_components, keep_one

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, words, percent):
    """(id, set size, least reachable id) of each row, all pairs compared."""
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            o = len(a & b)
            if o and 100 * o >= percent * (len(a) + len(b) - o):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def check(df, words, percent):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, words, percent).collect()]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=key) == sorted(brute([(r.doc_id, r.text) for r in df.collect()], words, percent), key=key)


def family(seed):
    """Copies of a few bases with some words changed, passages in common, and
    a large group whose members share most n-grams but link only partly."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(14)]
    out = []
    for base in range(6):
        text = [word() for _ in range(r.choice([8, 20, 60, 150]))]
        for _ in range(60 if base == 0 else r.randint(1, 8)):
            t = list(text)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])):
                t[r.randrange(len(t))] = word()
            if r.random() < 0.2:
                t = t[: len(t) - r.randint(0, len(t) // 5)]
            out.append(t)
    out += [passage + [word() for _ in range(r.randint(0, 60))] for _ in range(60)]
    return [(i * 7 % 1009, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60), (4, 4, 85)])
def test_planted_families(spark, seed, words, percent):
    check(spark.createDataFrame(family(seed), "doc_id bigint, text string").repartition(4), words, percent)


@pytest.mark.parametrize("percent", [40, 50, 60, 66, 67])
def test_small_sets_at_low_thresholds(spark, percent):
    r = random.Random(percent)
    rows = []
    for group in range(40):  # texts of one to six words, of the group's own
        words = [f"{w}{group}" for w in "abcdef"]
        rows += [(len(rows) + k, " ".join(words[: r.randint(1, 6)])) for k in range(2)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), 1, percent)


def test_documents(docs):
    check(docs, 4, 85)


def test_odd_rows(odd, empty):
    check(odd, 4, 85)
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    rows = sorted(kept.collect(), key=lambda r: r.key or 0)
    # Blank texts stay; of equal or linked rows one stays; texts that share an id are apart.
    assert [r.key for r in rows] == [None, 1, 2, 4, 5, 7, 8, 9, 10, 11, 12]
    assert jaccard_components(empty).count() == 0 and keep_one(empty).count() == 0


def test_keep_one_matches_components(docs):
    c = {(r.doc_id, r.component_id) for r in jaccard_components(docs).collect()}
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == sorted(d for d, k in c if d == k)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 400)] + [(5, 5), (1, 2), (2, 1)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(i, 100) for i in range(100, 161)} | {(7, 7)} | {(k, 7) for k in range(200, 400)} | {(1, 1), (2, 1)}
