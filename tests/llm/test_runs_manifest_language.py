import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm.language_id import UNKNOWN, Letters, family, fit, grams, languages
from storelens.llm.lcp_runs import periodic_runs, run_report, runs
from storelens.llm.merkle_manifest import build, extract, folded, group_name, height, leaf, manifest, positions, proofs, tampering_drill
from storelens.llm.textbatch import U, mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every stretch of every period, grown word by word; the least period of a stretch counts."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, q, length) for (start, length), q in found.items())


def drilled(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def plain_report(doc_id, text):
    words = drilled(doc_id, text)
    found, kept = plain_runs(words), [True] * len(words)
    for s, q, n in found:
        kept[s + q : s + n] = [False] * (n - q)
    best = min(found, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1])) if found else None
    row = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *row, sha("".join(f"{s},{n},{q}\n" for s, q, n in found)), sha(" ".join(w for w, k in zip(words, kept, strict=True) if k)))


def test_runs_of_random_words_equal_grown_ones():
    rnd = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            n, letters = rnd.randint(0, 70), rnd.choice([1, 2, 2, 3, 6])
            words = [rnd.randrange(letters) for _ in range(n)]
            if n and rnd.random() < 0.6:
                a = rnd.randrange(n)
                p = 1 + rnd.randrange(max(1, (n - a) // 3))
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            texts.append(words)
        first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        assert runs(mix(np.array([w for t in texts for w in t], U)), first) == [plain_runs(t) for t in texts]


def test_run_report_equals_brute_force(docs, texts):
    got = {tuple(r) for r in run_report(docs).collect()}
    assert got == {plain_report(i, t) for i, t in texts.items()}
    assert sum(r[1] for r in got) > 10


def test_runs_of_odd_rows(odd, empty):
    got = sorted((tuple(r) for r in run_report(odd).collect()), key=str)
    want = sorted((plain_report(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if len(r.text or "") < 10_000), key=str)
    assert [r for r in got if r[0] != 8 or r[1] == 0] == [r for r in want]
    long = [r for r in got if r[0] == 8 and r[1] > 0]
    assert len(long) == 2 and long[0] == long[1]
    assert run_report(empty).collect() == []


def test_one_word_repeated_very_often_is_one_run():
    n = 100_000
    assert runs(mix(np.zeros(n, U)), np.array([0, n])) == [[(0, 1, n)]]


def test_collapse_keeps_other_words(spark):
    d = spark.createDataFrame([(1, "x " + "a b " * 5 + "y")], "doc_id bigint, text string")
    r = periodic_runs(d).first()
    assert [tuple(x) for x in r.runs] == [(1, 2, 10)] and r.collapsed == "x a b y"


# ---- manifest ----


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = range(at - at % 3, min(len(nodes), at - at % 3 + 3))
        out.append(([nodes[i] for i in run if i < at], [nodes[i] for i in run if i > at]))
        at //= 3
    return out


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in groups[g]])
    top = plain_tree([trees[g][-1][0] for g in order])
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path = plain_path(trees[g], i) + plain_path(top, k)
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = plain_leaf((*r[:4], r[4].replace("\n", ""))) if bad else trees[g][0][i]
            for left, right in path:
                now = sha(*left, now, *right)
            proof = sha(*[h for left, right in path for h in (*left, *right)])
            yield (r[0], trees[g][0][i], trees[g][-1][0], top[-1][0], proof, now, now == top[-1][0])


COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 27, 28, 300])
def test_manifest_of_few_and_many_rows(spark, n):
    rnd = random.Random(n)
    rows = [(i, rnd.choice([None, "a", "a", "a", "é", "Z", ""]), None, i, f"line\nof {i}") for i in range(n)]
    d = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert sorted(map(tuple, tampering_drill(d).collect())) == sorted(plain_manifest(rows))


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "s", "en", 3, None), (1, "s", "en", 3, None), (1, "s", "en", 4, ""), (2, "s", None, None, "a\nb"), (None, "s", "de", 1, "é\n")]
    rows += [(7, "t", "en", 1, "w\n" * 60_000)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS + ", grp string, idx int").repartition(4)
    got = tampering_drill(d).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_manifest(rows), key=str)
    assert tampering_drill(spark.createDataFrame([], COLUMNS)).collect() == []


def test_tampering_is_found_and_nothing_else(docs):
    rows = tampering_drill(docs).collect()
    feeds = {r.doc_id: "\n" in (r.text or "") for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id for r in rows if not r.verified} == {i for i, f in feeds.items() if f and zlib.crc32(str(i).encode()) % 2 == 0}


def test_proofs_hold_for_other_arities_and_strides(spark):
    d = spark.range(700).select(F.lit("one").alias("grp"), F.sha2(F.col("id").cast("string"), 256).alias("sha"), "id")
    roots = set()
    for arity, stride in ((2, 3), (3, 1), (3, 6), (5, 2)):
        tree = build(positions(d, "grp", ["id"]), arity, stride)
        upper = tree.roots.select("grp", F.array().cast("array<struct<l:string,r:string>>").alias("path"))
        p = extract(tree, upper, ["id"])
        wrong = p.where((folded(F.col("sha"), F.col("path")) != F.col("subroot")) | (F.size("path") != height(700, arity)))
        assert p.count() == 700 and wrong.count() == 0
        roots.add((arity, p.first().subroot))
    assert len(roots) == 3  # the stride changes nothing


def test_manifest_carries_what_is_asked_for(spark):
    d = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "k int, source string, url string")
    leaves = d.select("k", "url", group_name(F.col("source")).alias("grp"), leaf([F.col("k"), F.col("url")]).alias("sha"))
    m = manifest(leaves, ["k"])
    p = proofs(m, ["url"]).withColumn("top", folded(F.col("sha"), F.col("path")))
    assert {(r.url, r.top) for r in p.collect()} == {("p", m.root), ("q", m.root)}


# ---- languages ----


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = languages(d).join(d.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.held_out for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2} == {True}
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_of_odd_rows(spark, odd, empty):
    d = odd.withColumn("lang", F.when(F.col("doc_id") < 7, "en").otherwise("de"))
    got = {(r.doc_id, r.lang_pred) for r in languages(d).collect()}
    assert {(1, UNKNOWN), (2, UNKNOWN), (3, UNKNOWN)} <= got
    assert {r.doc_id for r in odd.collect()} == {i for i, _ in got} and len(languages(d).collect()) == odd.count()
    assert languages(empty.withColumn("lang", F.lit("en"))).collect() == []
    unlabelled = languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {(UNKNOWN, 0.0)}


def test_texts_without_letters_are_undetermined(spark, docs):
    more = spark.createDataFrame([(10**6, "12 — 34 … ### !!", "en"), (10**6 + 1, "中文", "en")], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in languages(docs.select("doc_id", "text", "lang").unionByName(more)).where("doc_id >= 1000000").collect()}
    assert got[10**6].lang_pred == UNKNOWN and got[10**6].score == 0
    assert got[10**6 + 1].lang_pred != UNKNOWN


def test_three_languages_of_a_family_and_one_alone():
    rnd = random.Random(2)
    stems = {"en": ["the", "and", "ing"], "nl": ["het", "een", "ij"], "sv": ["och", "att", "är"], "el": ["και", "το", "ου"]}
    texts, langs = [], []
    for lang, parts in stems.items():
        for _ in range(60):
            texts.append(" ".join(rnd.choice(parts) + rnd.choice(parts) for _ in range(12)))
            langs.append(lang)
    order = rnd.sample(range(len(texts)), len(texts))
    model = fit([texts[i] for i in order], [langs[i] for i in order])
    assert sorted(map(sorted, model.languages)) == [["el"], ["en", "nl", "sv"]] and len(model.pairs) == 3
    assert family("el") == "el" and family("xx") == "xx"
    from storelens.llm.language_id import Scorer

    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    names, sure = model.decide(Scorer(model)(np.frombuffer(b"".join(raw), np.uint8), offsets))
    assert np.mean([a == b for a, b in zip(names, langs, strict=True)]) > 0.95 and sure.min() >= 0 and sure.max() <= 1


def test_grams_do_not_depend_on_blocks(monkeypatch):
    from storelens.llm import language_id

    raw = np.frombuffer("Ärger im Büro, weiß nicht: ÉTÉ 1999".encode(), np.uint8)
    w = Letters(raw, np.array([0, len(raw)]))
    whole = sorted((int(a), int(b)) for x, y in grams(w.data, w.start, w.end) for a, b in zip(x, y, strict=True))
    monkeypatch.setattr(language_id, "_BLOCK", 7)
    assert whole == sorted((int(a), int(b)) for x, y in grams(w.data, w.start, w.end) for a, b in zip(x, y, strict=True))
