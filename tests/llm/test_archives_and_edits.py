import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from storelens.llm import edit_counts as ec
from storelens.llm.catalog import tokenizer_path
from storelens.llm.encode import WORD_PIECES, Encoder, Vocabulary
from storelens.llm.warc_merkle import archive, aged_replica, audit, record_hashes, roots, tree
from storelens.plans import inspect


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.001/pages.parquet")


def test_equal_replicas_have_equal_roots_and_no_findings(pages):
    a = archive(pages, per_file=10)
    assert audit(a, a, span=4096, fanout=2).count() == 0
    assert sorted(map(tuple, roots(a, 4096, 2).collect())) == sorted(map(tuple, roots(a.repartition(5), 4096, 2).collect()))


def test_findings_are_exact(spark, pages):
    a = archive(pages, per_file=10)
    rows = [tuple(r) for r in a.collect()]
    r = random.Random(1)
    copy, want = [], set()
    for f, o, rec, p in rows:
        how = r.random()
        if how < 0.05:
            want.add((f, o, "missing"))
            continue
        if how < 0.12:
            rec = rec[:-1] + "?"
            want.add((f, o, "changed"))
        copy.append((f, o, rec, p))
    copy.append((0, 999_999_999, "late", 1))
    want.add((0, 999_999_999, "extra"))
    b = spark.createDataFrame(copy, a.schema)
    for span, fanout in ((4096, 2), (1 << 18, 16), (1 << 40, 16)):
        assert {(x.file, x.offset, x.kind) for x in audit(a, b, span, fanout).collect()} == want
    differing = {x.file for x in roots(a).exceptAll(roots(b.where("offset < 999999999"))).collect()}
    assert differing == {f for f, o, _ in want if o < 999_999_999}


def test_tree_hashes_children_in_order(spark):
    recs = spark.createDataFrame([(1, 0, "a"), (1, 5, "b"), (1, 10, "c")], "file bigint, offset bigint, record string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda *rs: sha("\n".join(f"{o:020d}:1:{sha(t)}" for o, t in rs))
    one, two = leaf((0, "a"), (5, "b")), leaf((10, "c"))
    root = sha(f"{0:020d}:{one}\n{1:020d}:{two}")
    got = {(x.level, x.idx): x.sha for x in tree(record_hashes(recs), 1, span=10, fanout=2).collect()}
    assert got == {(0, 0): one, (0, 1): two, (1, 0): root}


def test_archive_odd_rows(spark):
    rows = [(1, None, None, "x"), (2, "u", "é" * 70_000, "y"), (None, "u", "h", "z"), (None, "u", "h", "z"), (3, "u", "", "w")]
    a = archive(spark.createDataFrame(rows, "page_id bigint, url string, html string, sha string"))
    assert a.count() == 5 and audit(a, a).count() == 0 and audit(a, aged_replica(a)).count() == 0
    none = a.limit(0)
    assert audit(none, none).count() == 0 and audit(a, none).where("kind = 'missing'").count() == 5 - 0
    inspect.assert_jvm_only(audit(a, none))


def count_all():
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return lambda s: len(t.encode(s or "", add_special_tokens=False).ids)


def applied(text, edits):
    text = text or ""
    for e in edits or []:
        p = min(max(e["pos"] or 0, 0), len(text))
        text = text[:p] + (e["ins"] or "") + text[p + max(e["del"] or 0, 0) :]
    return text


def test_edits_keep_exact_counts():
    enc, count, r = Encoder(Vocabulary.load(tokenizer_path("word_bpe_49k.json"), WORD_PIECES)), count_all(), random.Random(4)
    make = lambda n: "".join(r.choice("ab,. é'sT!\n—9") for _ in range(n))
    for _ in range(60):
        some = [make(r.choice([0, 3, 80, 3000])) for _ in range(8)]
        raw = [t.encode() for t in some]
        trees = ec._build(enc, np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
        docs = [ec._Document(t, a, b) for t, (a, b) in zip(some, trees, strict=True)]
        edits = [[{"pos": r.randint(-5, 3100), "del": r.choice([0, 1, 5, 300, 4000]), "ins": make(r.choice([0, 1, 7, 2500]))} for _ in range(r.randint(0, 5))] for _ in some]
        ec._apply(enc, docs, edits)
        for t, e, d in zip(some, edits, docs, strict=True):
            want = applied(t, e)
            assert d.text == want and d.tokens[1] == count(want) and d.bytes[1] == len(want.encode())


def test_inserts_beside_a_large_deletion_keep_exact_counts():
    enc, count = Encoder(Vocabulary.load(tokenizer_path("word_bpe_49k.json"), WORD_PIECES)), count_all()
    text = "hous, " * 2_000  # two pieces each; "house" is one token
    raw = np.frombuffer(text.encode(), np.uint8)
    (a, b), = ec._build(enc, raw, np.array([0, len(raw)]))
    left = text[:3000] + text[9000:]
    starts = [p for p in range(2800, 3200) if left[p] in "h,"]
    docs = [ec._Document(text, a.copy(), b.copy()) for _ in starts]
    ec._apply(enc, docs, [[{"pos": 3000, "del": 6000, "ins": ""}, {"pos": p, "del": 0, "ins": "e"}] for p in starts])
    want = [left[:p] + "e" + left[p:] for p in starts]
    assert [d.text for d in docs] == want
    assert [int(d.tokens[1]) for d in docs] == [count(t) for t in want]


def test_a_small_edit_of_a_long_text_encodes_little():
    enc = Encoder(Vocabulary.load(tokenizer_path("word_bpe_49k.json"), WORD_PIECES))
    raw = ec.np.frombuffer(("some words of a text " * 20_000).encode(), np.uint8)
    (a, b), = ec._build(enc, raw, np.array([0, len(raw)]))
    d = ec._Document(raw.tobytes().decode(), a, b)
    ec._apply(enc, [d], [[{"pos": 200_000, "del": 3, "ins": "new"}]])
    assert d.reencoded < 1000


def test_edit_rows(spark, docs, odd, empty):
    count = count_all()
    for df in (docs, odd):
        rows = ec.revision(df).collect()
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens_before, r.n_tokens) for r in ec.edited_counts(df, tokenizer_path("word_bpe_49k.json")).collect())
        edits = [[{"pos": e["pos"], "del": e["del"], "ins": e["ins"]} for e in r.edits] for r in rows]
        assert got == sorted((r.doc_id is None, r.doc_id or 0, count(r.text), count(applied(r.text, e))) for r, e in zip(rows, edits, strict=True))
    assert ec.edited_counts(empty, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_null_edits_change_nothing(spark):
    voc = Vocabulary.load(tokenizer_path("word_bpe_49k.json"), WORD_PIECES).broadcast(spark)
    df = spark.createDataFrame([(1, "a text", None), (2, None, [(0, 0, "new")]), (3, "b", [(None, None, None)])], f"doc_id bigint, text string, edits {ec.EDITS}")
    got = {r.doc_id: (r.text, r.n_tokens) for r in ec.apply_edits(ec.token_trees(df, voc, "edits"), voc).collect()}
    assert got == {1: ("a text", 2), 2: ("new", 1), 3: ("b", 1)}
