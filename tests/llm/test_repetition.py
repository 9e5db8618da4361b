import collections
import re

from storelens.llm.repetition import NGRAM_LIMITS, filter_repetitive, repetition_coverage


def brute(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen3 = collections.Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    cover = set()
    for i in range(len(ws) - 2):
        if seen3[tuple(ws[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines, dup, dup_chars = set(), 0, 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            if line in lines:
                dup += 1
                dup_chars += len(re.sub(r"[\x20\x09-\x0D]", "", line))
            lines.add(line)
    chars = sum(map(len, ws))
    failed = len(ws) < 50 or 100 * len(cover) > 50 * len(ws)
    kept = not failed and 100 * dup_chars <= 30 * chars
    for n, limit in NGRAM_LIMITS.items():
        seen, hit = set(), set()
        for i in range(len(ws) - n + 1):
            g = tuple(ws[i : i + n])
            if g in seen:
                hit |= set(range(i, i + n))
            seen.add(g)
        kept = kept and 100 * sum(len(ws[i]) for i in hit) <= round(100 * limit) * chars
    return len(ws), chars, len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover), failed, kept


def check(rows, texts):
    got = sorted(((r.doc_id is None, r.doc_id or 0), tuple(r)[1:8]) for r in rows)
    want = sorted(((d is None, d or 0), (*brute(t)[:5], *brute(t)[5:])) for d, t in texts)
    assert got == want


def test_against_brute_force(docs, texts):
    check(repetition_coverage(docs).collect(), list(texts.items()))


def test_odd_rows(odd):
    check(repetition_coverage(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    kept = filter_repetitive(odd)
    assert kept.columns == odd.columns
    assert sorted(r.key for r in kept.collect()) == sorted(r.key for r in odd.collect() if brute(r.text)[6])


def test_empty(empty):
    assert repetition_coverage(empty).count() == 0 and filter_repetitive(empty).count() == 0


def test_repeats_are_rejected_and_plain_text_is_kept(spark):
    plain = " ".join(f"w{i}" for i in range(300))
    rows = [(1, plain), (2, "the same seven words come again here " * 60), (3, "\n".join(["a line that comes back"] * 30) + plain), (4, plain + " " + plain[:80])]
    got = {r.doc_id: r.kept for r in repetition_coverage(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}
