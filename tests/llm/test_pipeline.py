"""The pipeline against a brute-force version of its stages."""

import re

from tokenizers import Tokenizer

import corpus_pipeline
from storelens.llm.catalog import tokenizer_path
from storelens.llm.vertical_jaccard import PERCENT
from llm.test_ids import check_packing
from llm.test_near_duplicates import brute as components
from llm.test_repetition import brute as repetition
from llm.test_scans import ASSIGN

SF = "/root/testdata/sf0.001"


def windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    k = min(10, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set(), w


def masked(text):
    spans = [m.span() for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    spans += [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    out, at = "", 0
    for s, e in sorted(spans):
        if s >= at:
            out += text[at:s] + "[secret]"
        at = max(at, e)
    return out + text[at:]


def test_stages(spark, docs):
    bench = [windows(r.text)[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect() if repetition(r.text)[6]]
    rows = [(d, t) for (d, t), c in zip(rows, components(rows, 5, 80), strict=True) if c[2] == d]
    clean = []
    for d, t in rows:
        w = windows(t)[1]
        if not any(tuple(w[i : i + k]) in b for b in bench for k in {len(g) for g in b} for i in range(len(w) - k + 1)):
            clean.append((d, masked(t)))
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = [(d, [*e.ids, 1]) for (d, _), e in zip(clean, tok.encode_batch([t for _, t in clean], add_special_tokens=False), strict=True)]
    assert 0 < len(ids) < docs.count()
    assert check_packing(corpus_pipeline.run(spark, SF).collect(), ids) == 0


def test_stage_columns_and_odd_rows(spark, odd, empty):
    for df in (odd, empty):
        d = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, SF)
            assert d.columns == df.columns
        corpus_pipeline.STAGES[-1][1](spark, d, SF).collect()


def test_near_duplicates_states_its_threshold():
    assert f"similarity of {PERCENT / 100} or more" in corpus_pipeline.near_duplicates.__doc__
