"""Encoding, the compressed id files and packing, against whole-text encoding."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from storelens.llm.catalog import tokenizer_path
from storelens.llm.common import scratch
from storelens.llm.encode import BYTE_PIECES, WORD_PIECES, Encoder, Places, Vocabulary, encoded
from storelens.llm.packing import combinations, nnls, packed, plan
from storelens.llm.zdict import compressed_ids, manifest, read_ids, write_ids

FILES = {"word": ("word_bpe_49k.json", WORD_PIECES), "byte": ("byte_bpe_50k.json", BYTE_PIECES)}


def reference(kind):
    t = Tokenizer.from_file(tokenizer_path(FILES[kind][0]))
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("kind", FILES)
def test_pieces_encode_like_whole_texts(kind, texts):
    enc = Encoder(Vocabulary.load(tokenizer_path(FILES[kind][0]), FILES[kind][1]))
    rnd = random.Random(1)
    marks = "aB1'sst  \n\t\x1c\x85\xa0é́ÀΣσς!?.;—中文 ​🎉'll"
    some = ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    some += [*texts.values(), "", None, "<|endoftext|>", "a <|startoftext|> b<|endoftext|>"]
    ids, at = enc.encode_texts(some)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == reference(kind)(some)


def test_places():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(1, 2**63, 20_000).astype(np.uint64))
    r.shuffle(keys)
    p = Places(8)
    for lo in range(0, len(keys), 777):
        p.add(keys[lo : lo + 777])
    assert (p.find(keys) == np.arange(len(keys))).all()
    assert (p.find(r.integers(2**63, 2**64 - 1, 500, dtype=np.uint64)) == -1).all()


def test_id_files_round_trip(spark, docs, texts):
    path = scratch(spark, "test-ids")
    rows = compressed_ids(docs, tokenizer_path("word_bpe_49k.json"), path).collect()
    ids = dict(zip(sorted(texts), reference("word")([texts[d] for d in sorted(texts)]), strict=True))
    start, want = 0, []
    for d in sorted(ids):
        full = [*ids[d], 1]
        want.append((d, start, len(full), crc(full)))
        start += len(full)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want
    few = read_ids(spark, path, [3, 17]).collect()
    assert {r.doc_id: r.ids for r in few} == {d: [*ids[d], 1] for d in (3, 17)}


def test_wrong_dictionary_is_refused(spark, docs):
    path, other = scratch(spark, "test-ids"), scratch(spark, "test-ids")
    enc = encoded(docs.limit(20), Vocabulary.load(tokenizer_path("word_bpe_49k.json"), WORD_PIECES))
    write_ids(enc, path)
    spark.read.parquet(f"{path}/blocks").write.parquet(f"{other}/blocks")
    spark.createDataFrame([("0" * 64, bytearray(b""), 2)], "dict_hash string, dictionary binary, id_bytes int").write.parquet(f"{other}/dictionary")
    with pytest.raises(Exception, match="needs dictionary"):
        manifest(spark, other).collect()


def test_id_files_odd_rows(odd, empty):
    rows = compressed_ids(odd, tokenizer_path("word_bpe_49k.json")).collect()
    whole = [(r.doc_id, r.text) for r in odd.collect()]
    ids = [(d, [*i, 1]) for (d, _), i in zip(whole, reference("word")([t for _, t in whole]), strict=True)]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=key) == sorted(((d, len(i), crc(i)) for d, i in ids), key=key)
    ends = 0
    for r in sorted(rows, key=lambda r: (r.start, r.n_tokens)):
        assert r.start == ends
        ends += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert compressed_ids(empty, tokenizer_path("word_bpe_49k.json")).count() == 0


def check_packing(rows, docs):
    """docs: (doc_id, ids with the end id); every id lies in one piece, sequences are gapless."""
    by_seq, pieces = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    padding = 0
    for s in by_seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        padding += 2048 - at if at & (at - 1) else 0
    for d, ids in docs:
        at = 0
        for start, length, c, n in sorted(pieces[d]):
            assert start == at and n == len(ids) and c == crc(ids[start : start + length])
            at += length
        assert at == len(ids)
    assert len(pieces) == len(docs)
    return padding


def test_packing_covers_every_id(docs, texts):
    ids = [(d, [*i, 1]) for d, i in zip(texts, reference("byte")(list(texts.values())), strict=True)]
    assert check_packing(packed(docs, tokenizer_path("byte_bpe_50k.json")).collect(), ids) == 0


def test_packing_odd_rows(odd, empty):
    once = odd.where("key not in (8, 9, 10)")
    whole = [(r.doc_id, r.text) for r in once.collect()]
    ids = [(d, [*i, 1]) for (d, _), i in zip(whole, reference("byte")([t for _, t in whole]), strict=True)]
    check_packing(packed(once, tokenizer_path("byte_bpe_50k.json")).collect(), ids)
    rows = packed(odd, tokenizer_path("byte_bpe_50k.json")).collect()  # repeated rows are documents of their own
    assert sum(r.length for r in rows) == sum(len(i) + 1 for i in reference("byte")([r.text for r in odd.collect()]))
    assert packed(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_rest_once(seed):
    r = np.random.default_rng(seed)
    hist = np.zeros(256, np.int64)
    hist[1:] = r.poisson(r.choice([0.2, 3, 400]), 255)
    if seed == 5:
        hist[:] = 0
        hist[100] = 1_000_000  # one length only
    p = plan(hist)
    length = np.repeat(np.arange(256), np.minimum(hist, 2000))
    if (hist <= 2000).all():
        rank = np.concatenate([np.arange(h) for h in hist])
        row, start, n, seq, offset = p.place(np.arange(len(length)), length, rank, np.zeros(len(length), np.int64))
        assert (np.bincount(row, n, len(length)) == length).all()
        order = np.lexsort((offset, seq))
        ends = {}
        for s, o, k in zip(seq[order].tolist(), offset[order].tolist(), n[order].tolist(), strict=True):
            assert ends.get(s, 0) == o
            ends[s] = o + k
        assert max(ends.values()) <= 256 and len(ends) == p.n_sequences
        assert sum(256 - e for e in ends.values() if e & (e - 1)) == 0


def test_nnls_meets_a_solvable_histogram():
    hist = np.zeros(64, np.int64)
    hist[[10, 54]] = 500
    hist[16] = 400
    a, k, b = combinations(hist)
    x = nnls(a, k, b, hist)
    model = np.bincount(a, k * x, 64) + np.bincount(b, x, 64)
    assert (x >= 0).all() and np.abs(model - hist).max() < 1
