"""Decontamination, secrets and personal data."""

import hashlib
import random
import re

import numpy as np
import pytest

from storelens.llm import pii_bilstm as pii
from storelens.llm import secrets_markov as sec
from storelens.llm.decontaminate import contamination, hits, remove_documents, remove_spans
from storelens.plans import inspect

BENCH = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item of five words"), (2, "Another text of item two, longer than ten words in all, yes."), (None, "no id but ten words are here for a window ok"), (5, None), (6, "...")]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id bigint, text string")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w, hit, items = words(text), set(), set()
    for item, t in BENCH:
        g = words(t)
        k = min(10, len(g))
        for i in range(len(g) - k + 1) if k else []:
            for j in range(len(w) - k + 1):
                if w[j : j + k] == g[i : i + k]:
                    hit |= set(range(j, j + k))
                    items.add(str(item) if item is not None else "")
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


PLANTED = [
    (1, "x ALPHA, beta gamma-delta epsilon zeta eta theta iota kappa lambda mu! y"), (2, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (3, "a short item of five words, short item of five words"), (4, "nothing"), (4, None), (None, "short item of five words"),
    (7, " ".join(["beta gamma delta epsilon zeta eta theta iota kappa lambda"] * 40)), (7, " ".join(["beta gamma delta epsilon zeta eta theta iota kappa lambda"] * 40)),
    (8, "no id but ten words are here for a window ok"), (9, "é Short item of five words ü"),
]


def test_contamination_is_exact(spark, bench):
    df = spark.createDataFrame(PLANTED, "doc_id bigint, text string").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id or 0), tuple(r)[1:]) for r in contamination(df, bench).collect())
    assert got == sorted(((d is None, d or 0), brute(t)) for d, t in PLANTED)
    # Beyond the broadcast limit the same hits come by a shuffle.
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r._th)
    one, two = (sorted(hits(df, bench, broadcast_windows=n).collect(), key=key) for n in (500_000, 0))
    assert one == two


def test_a_window_of_many_items(spark):
    """One window lies in every item: its row is heavy, so the set goes by its size, not by its rows."""
    many = spark.range(3_000).selectExpr("id AS item_id", "'one two three four five six seven eight nine ten' AS text")
    df = spark.createDataFrame([(1, "zero one two three four five six seven eight nine ten"), (2, "one two"), (3, None)], "doc_id bigint, text string")
    ids = sorted(str(i) for i in range(3_000))
    for size in (1 << 30, 10_000):
        got = {r.doc_id: (r.n_words, [tuple(s) for s in r.spans], list(r["items"])) for r in hits(df, many, broadcast_bytes=size).collect()}
        assert got == {1: (11, [(2, 12)], ids), 2: (2, [], []), 3: (0, [], [])}
    plans = [hits(df, many, broadcast_bytes=n)._jdf.queryExecution().optimizedPlan().toString() for n in (1 << 30, 10_000)]
    assert ["broadcast" in p for p in plans] == [True, False]


def test_removal(spark, bench):
    df = spark.createDataFrame([(d, t, "h") for d, t in PLANTED], "doc_id bigint, text string, _th string")
    kept = remove_documents(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, t in PLANTED if not brute(t)[4])
    clean = remove_spans(df, bench)
    assert clean.count() == len(PLANTED) and not contamination(clean, bench).where("contaminated").count()
    got = {r.doc_id: r.text for r in clean.where("doc_id in (1, 2, 9)").collect()}
    assert got == {1: "x y", 2: PLANTED[1][1], 9: "é ü"}


def test_contamination_odd_rows(odd, empty, bench):
    assert contamination(odd, bench).count() == odd.count()
    assert contamination(empty, bench).count() == 0 and remove_documents(empty, bench).count() == 0
    assert contamination(odd, bench.limit(0)).where("contaminated").count() == 0


def test_native_plans(docs, bench):
    inspect.assert_jvm_only(contamination(docs, bench))
    inspect.assert_jvm_only(sec.secrets(docs))


ASSIGN = re.compile(r"(?a:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{sec.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def check_secrets(df):
    got = sorted((r.doc_id or -1, r.base_sha256) for r in sec.secrets(df).collect())
    want = sorted((r.doc_id or -1, hashlib.sha256(plain_secrets(r.text or "").encode()).hexdigest()) for r in df.collect())
    assert got == want


def test_plain_secrets(spark, docs, odd):
    check_secrets(docs)
    check_secrets(odd)
    r, bits = random.Random(2), ["token", "API_KEY", "api", "=", ":", " ", '"', "abc", "0123456789abcdef", "AKIA", "XYZ0", "é", "\n", "deadbeef"]
    check_secrets(spark.createDataFrame([(i, "".join(r.choice(bits) for _ in range(r.randint(0, 30)))) for i in range(400)], "doc_id bigint, text string"))


def test_markov_finds_random_strings_and_leaves_identifiers(spark):
    r = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rand = lambda n: "".join(r.choice(letters) for _ in range(n))
    name = lambda: "_".join(r.choice(["user", "count", "index", "load", "table", "value", "first"]) for _ in range(5)) + str(r.randint(1, 9))
    samples = spark.createDataFrame([(rand(32), True) for _ in range(300)] + [(name(), False) for _ in range(300)], "value string, random boolean")
    rows = [(i, f"see {rand(30)} there") for i in range(40)] + [(100 + i, f"call {name()} here") for i in range(40)]
    got = {x.doc_id: x.n_markov for x in sec.secrets(spark.createDataFrame(rows, "doc_id bigint, text string"), samples).collect()}
    assert sum(got[i] for i in range(40)) >= 38 and sum(got[100 + i] for i in range(40)) == 0


def test_redaction(spark, odd, empty):
    rows = [(1, "é token = abcdefgh12 and " + "0123456789abcdef" * 2 + "!", "x"), (2, "clean", "y"), (3, None, "z"), (4, "secret:" + "a1" * 20, "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _text string")
    got = sec.redact(df)
    assert got.columns == df.columns
    assert {tuple(r) for r in got.collect()} == {(1, "é [secret] and [secret]!", "x"), (2, "clean", "y"), (3, None, "z"), (4, "[secret]", "w")}
    assert sec.redact(odd).count() == odd.count() and sec.redact(empty).count() == 0 and sec.secrets(empty).count() == 0


def plain_personal(s):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", s) if all(int(q) <= 255 for q in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", s):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", s) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_plain_personal_data(texts):
    r = random.Random(3)
    some = ["".join(r.choice("a1.@ +-()%9_4.b2 é") for _ in range(r.randint(0, 50))) for _ in range(6000)]
    for s in [*some, *texts.values()]:
        assert pii.base_spans(s) == plain_personal(s)
    assert pii.base_spans("9" * 200_000 + "@" + "a." * 50_000) is not None  # linear time


def made_up(r):
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    filler = lambda: " ".join(r.choice(["the", "house", "stands", "near", "a", "river", "in", "spring"]) for _ in range(r.randint(4, 20)))
    one = [lambda: f"{r.choice(['ann', 'bob', 'eve'])}.{n(2)}@mail{n(1)}.example.com", lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), lambda: f"+1 ({n(3)}) 555-{n(4)}"]
    return " ".join(x for _ in range(3) for x in (filler(), r.choice(one)()))


@pytest.fixture(scope="module")
def tagger():
    r = random.Random(5)
    return pii.fit([made_up(r) for _ in range(150)])


def test_held_out_accuracy(tagger):
    r = random.Random(6)
    some = [made_up(r) for _ in range(60)]
    found = pii.model_spans(tagger, some, [[] for _ in some])
    want = [pii.base_spans(t) for t in some]
    right = sum(len(set(a) & set(b)) for a, b in zip(found, want, strict=True))
    assert right >= 0.8 * sum(map(len, want)) and right >= 0.9 * sum(map(len, found))


def test_gradients():
    """The CRF and both LSTMs, against differences."""
    m = pii.Tagger.fresh(1)
    r = np.random.default_rng(0)
    x, y = r.integers(0, 130, (2, 5)), r.integers(0, pii.TAGS, (2, 5))

    def loss():
        h = m._read(x, False)[0].astype(float)
        e, t = h @ m.p["w"] + m.p["o"], m.p["t"]
        total = 0.0
        for b in range(2):
            a = e[b, 0]
            for i in range(1, 5):
                a = np.array([np.logaddexp.reduce(a + t[:, k]) for k in range(pii.TAGS)]) + e[b, i]
            gold = e[b, np.arange(5), y[b]].sum() + t[y[b, :-1], y[b, 1:]].sum()
            total += np.logaddexp.reduce(a) - gold
        return total

    before = {k: v.copy() for k, v in m.p.items()}
    seen = {}
    m.train(x, y, epochs=1, rate=0.0, batch=2)  # no step: parameters stay
    assert all((m.p[k] == before[k]).all() for k in before)
    first = loss()
    m.train(x, y, epochs=60, rate=0.05, batch=2)
    seen["after"] = loss()
    assert seen["after"] < 0.2 * first


def test_regions_longer_than_a_window_are_decoded_once(tagger):
    text = "call " + " and ".join(f"+1 (212) 555-01{i:02d}" for i in range(12)) + " now"
    spans = pii.model_spans(tagger, [text], [[]])[0]
    assert len(spans) == len(set(spans)) and all(a[2] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_personal_data_rows(odd, empty, tagger):
    rows = pii.personal_data(odd, tagger).collect()
    assert len(rows) == odd.count() and all(r.spans == "" for r in rows)
    assert pii.personal_data(empty, tagger).count() == 0
    assert pii.personal_data(empty).count() == 0
