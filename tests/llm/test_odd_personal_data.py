import random
import time

import numpy as np
import pytest

from storelens.llm import pii_bilstm as pii
from llm.test_scans import made_up


def card(r):
    d = [4] + [r.randrange(10) for _ in range(14)]
    return "".join(map(str, d)) + next(str(c) for c in range(10) if pii._luhn("".join(map(str, d)) + str(c)))


def texts_with_cards(r):
    return made_up(r) + " paid by " + card(r) + " on file"


@pytest.fixture(scope="module")
def tagger():
    r = random.Random(15)
    return pii.fit([texts_with_cards(r) for _ in range(200)])


def test_odd_forms_are_not_plain_matches():
    r = random.Random(1)
    for _ in range(200):
        text = texts_with_cards(r)
        plain = pii.base_spans(text)
        odd, moved = pii.rewritten(text, plain, r.randrange(9))
        assert len(moved) == len([s for i, s in enumerate(plain) if not any(a < s[0] < e for a, _, e in plain[:i])])
        assert not set(pii.base_spans(odd)) & set(moved)


def test_the_model_adds_held_out_odd_forms(tagger):
    """Of spans in odd forms, in texts not learned from, three fifths and more
    are added; nine in ten of what is added is right, and plain texts get none."""
    r = random.Random(16)
    want, found, right = 0, 0, 0
    for i in range(120):
        text = texts_with_cards(r)
        odd, moved = pii.rewritten(text, pii.base_spans(text), i)
        base = pii.base_spans(odd)
        added = pii.model_spans(tagger, [odd], [base])[0]
        free = [m for m in moved if not any(b[0] < m[2] and m[0] < b[2] for b in base)]
        want, found, right = want + len(free), found + len(added), right + len(set(free) & set(added))
    assert right >= 0.6 * want and right >= 0.9 * found, (want, found, right)
    clean = ["the house stands near a river in spring 1999 with 12 rooms and 3 doors, see page 45 or 7, 8 and 9" for _ in range(5)]
    assert pii.model_spans(tagger, clean, [[] for _ in clean]) == [[] for _ in clean]


def test_long_tables_of_numbers_cost_in_proportion(tagger):
    r = random.Random(2)
    text = " ".join(str(r.randrange(10_000)) for _ in range(200_000))  # about 1 MB, one region
    begun = time.time()
    tags, prob = tagger.tag_regions([pii.codes(text)])[0]
    assert len(tags) == len(prob) == len(text)
    assert time.time() - begun < 90


def test_blocks_agree_with_whole_regions(tagger, monkeypatch):
    r = random.Random(3)
    text = " ".join(made_up(r) for _ in range(12))
    c = pii.codes(text)
    blocks = tagger.tag_regions([c])[0][0]
    monkeypatch.setattr(pii, "BLOCK", 1 << 20)
    whole = tagger.tag_regions([c])[0][0]
    assert len(c) > 1000 and np.mean(blocks != whole) < 0.005
