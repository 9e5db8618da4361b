"""Operator 10, secret scans (DataFrame functions only).

Three plain kinds are matched by expression (assign, access, hex).  A fourth
kind, ``markov``, is found by two character Markov models, one of random
strings and one of ordinary identifiers.  Every token, a run of ``ALPHABET`` in
what the plain matches leave of a text, is scored by the summed log-likelihood
ratio of its character pairs, and is a secret from ``MARGIN`` on.  A pair
counts for at most ``PAIR_MOST``, so a token has to hold several unlikely ones;
tokens too short to reach the margin at all (``shortest``) are not looked at.
Both models are counted with Spark from labelled samples.

Spans are code points, end exclusive.  Where matches lie follows from the text
between them: ``split`` and ``regexp_extract_all`` by one expression alternate;
their running lengths are summed in blocks, so a text with very many matches
costs in proportion to them.

Defined cases: null text is empty and has no spans; rows are scanned one by
one, so repeated rows get equal results; without samples of a class its model
is uniform.  Other columns pass through ``redact`` unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unpacked

ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"  # maximal runs of 16 characters or more
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"  # maximal runs of 32 or more
KINDS = ["assign", "access", "hex", "markov"]

# The characters of tokens, in code order; a pair's place in the models follows from the two codes.
ALPHABET = "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
_TOKEN_CHARS = "[+/0-9=A-Z_a-z-]"
_FIRST = ord(ALPHABET[0])
_CODES = ord(ALPHABET[-1]) - _FIRST + 1
#: Summed log-likelihood ratio (nats) from which a token is a secret, and the most that one pair counts for.
MARGIN = 10.0
PAIR_MOST = 2.0
PRIOR = 20
#: Labelled samples: about so many documents, chosen by the hash of their id.
SAMPLE_DOCS = 2_000
_ANY_BASE = f"(?:{ASSIGN})|(?:{ACCESS})|(?:{HEX})"
#: Matches of a block whose lengths are summed one by one (a power of two).
_BLOCK_BITS = 6
#: Characters of a block of a text from which pieces are cut.
_CHUNK = 4096


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, join, start: Column) -> Column:
    """Running sums (or maxima) of an array: each within its block, on top of
    the block before, whose running value is found the same way."""

    def blocks(x: Column) -> Column:
        width = 1 << _BLOCK_BITS
        n = F.shiftright(F.size(x) + width - 1, _BLOCK_BITS)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda b: F.aggregate(F.slice(x, (b - 1) * width + 1, F.lit(width)), start, join))).otherwise(F.slice(x, 1, 0))

    def on_top(x: Column, before: Column) -> Column:
        def at(v: Column, i: Column) -> Column:
            block, inside = F.shiftright(i, _BLOCK_BITS), i.bitwiseAND((1 << _BLOCK_BITS) - 1)
            own = F.aggregate(F.slice(x, i - inside + 1, inside + 1), start, join)
            return F.when(block == 0, own).otherwise(join(F.element_at(before, block), own))

        return F.transform(x, at)

    def plain(x: Column) -> Column:
        return F.transform(x, lambda v, i: F.aggregate(F.slice(x, F.lit(1), i + 1), start, join))

    return _let(values, lambda x: _let(blocks(x), lambda y: _let(blocks(y), lambda z: _let(on_top(y, plain(z)), lambda before: on_top(x, before)))))


def _total(values: Column) -> Column:
    return _running(values, lambda a, b: a + b, F.lit(0))


_NO_SPANS = "array<struct<s:int,k:int,e:int>>"


def _gaps(text: Column, pattern: str, n: Column) -> Column:
    """The text before each of the n matches."""
    return F.slice(F.split(text, pattern, -1), F.lit(1), n)


def _spans(text: Column, pattern: str, kind: int, matches: Column | None = None, good: Column | None = None) -> Column:
    """Array of struct(s, k, e) of the pattern's matches; ``good`` is an array of booleans beside them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if matches is None else matches

    def walked(m: Column) -> Column:
        size = F.transform(m, lambda x: F.length(x))
        both = F.zip_with(F.transform(_gaps(text, pattern, F.size(m)), lambda g: F.length(g)), size, lambda g, x: g + x)
        span = F.zip_with(_total(both), size, lambda e, n: F.struct((e - n).alias("s"), F.lit(kind).alias("k"), e.alias("e")))
        return span if good is None else _let(good, lambda ok: F.filter(span, lambda x, i: F.element_at(ok, i + 1)))

    empty = F.array().cast(_NO_SPANS)
    some = text.rlike(pattern) if matches is None else F.exists(good, lambda x: x)
    return F.when(some, _let(found, walked)).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Spans of the three plain kinds, by start, then kind."""
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 8)
    return F.array_sort(F.concat(_spans(text, ASSIGN, 0, good=long_enough), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def _left(text: Column) -> Column:
    """The text with its plain matches blanked, character for character."""

    def blanked(t: Column, pattern: str, group: int | None = None) -> Column:
        def whole(m: Column) -> Column:
            fill = F.transform(m, lambda x: F.repeat(F.lit(" "), F.length(x)))
            gaps = F.split(t, pattern, -1)
            return F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), fill, lambda g, f: F.concat(g, f)), ""), F.element_at(gaps, -1))

        return F.when(t.rlike(pattern), _let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), whole)).otherwise(t)

    long_assign = ASSIGN.replace("]+)", "]{8,})")
    return _let(_let(blanked(text, long_assign), lambda a: blanked(a, ACCESS)), lambda b: blanked(b, HEX))


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(value, random): values of plain matches, and strings drawn from a hash
    of each sampled document's id (digits of base 64 and 16, letters alone, of
    both cases and of one), against the other tokens of the sampled documents.
    The share sampled follows from the row count."""
    n = docs.count()
    cut = (1 << 63) - 1 if n <= sample_docs else int((2 * sample_docs / n - 1) * (1 << 63))
    text = F.coalesce(F.col("text"), F.lit(""))
    some = docs.where(F.xxhash64("doc_id") <= F.lit(cut)).select("doc_id", text.alias("text"))
    values = F.concat(
        F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 8),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
    )
    drawn = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 512)
    base64 = F.regexp_replace(F.base64(F.unhex(drawn)), "[\r\n=]", "")
    letters = F.regexp_replace(base64, "[^A-Za-z]", "")
    made = F.array(base64, drawn, letters, F.lower(letters), F.upper(letters), F.upper(F.regexp_replace(base64, "[^A-Za-z0-9]", "")))
    words = F.regexp_extract_all(F.regexp_replace("text", _ANY_BASE, " "), F.lit(_TOKEN_CHARS + "{2,}"), F.lit(0))
    return some.select(F.explode(F.concat(values, made)).alias("value"), F.lit(True).alias("random")).unionByName(
        some.select(F.explode(words).alias("value"), F.lit(False).alias("random"))
    )


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio (random against ordinary) of each pair of character
    codes, row by row, at most ``PAIR_MOST``.  A pair's probability leans on
    its second character's share among all, as if ``PRIOR`` such pairs had been
    seen.  The counts are a Spark aggregate of at most 2 x 67 x 67 rows."""
    codes = F.transform(F.split("value", ""), lambda c: F.ascii(c) - _FIRST)
    pairs = samples.where(F.length("value") > 1).select("random", codes.alias("c"))
    pairs = pairs.select("random", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    places = [ord(c) - _FIRST for c in ALPHABET]
    pairs = pairs.select("random", "p.a", "p.b").where(F.col("a").isin(places) & F.col("b").isin(places))
    counts = {(r.random, r.a, r.b): r["count"] for r in pairs.groupBy("random", "a", "b").count().collect()}

    def log_p(random: bool) -> dict[tuple[int, int], float]:
        after = {b: 1 + sum(counts.get((random, a, b), 0) for a in places) for b in places}
        share = {b: n / sum(after.values()) for b, n in after.items()}
        out = {}
        for a in places:
            row = {b: counts.get((random, a, b), 0) for b in places}
            for b in places:
                out[a, b] = math.log((row[b] + PRIOR * share[b]) / (sum(row.values()) + PRIOR))
        return out

    r, o = log_p(True), log_p(False)
    return [round(min(PAIR_MOST, r[a, b] - o[a, b]), 3) if (a, b) in r else 0.0 for a in range(_CODES) for b in range(_CODES)]


def shortest(margin: float = MARGIN) -> int:
    """Characters below which no token can reach the margin."""
    return int(-(-margin // PAIR_MOST)) + 1


def _ratio(token: Column, model: Column) -> Column:
    """Summed log-likelihood ratio of the token's character pairs."""
    at = F.transform(F.split(token, ""), lambda c: F.ascii(c) - _FIRST)
    pairs = _let(at, lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.element_at(model, a * _CODES + b + 1)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def markov_spans(text: Column, model: list[float], margin: float = MARGIN) -> Column:
    pattern = f"{_TOKEN_CHARS}{{{shortest(margin)},}}"
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded to a literal

    def judged(t: Column, tokens: Column) -> Column:
        return _let(F.transform(tokens, lambda x: _ratio(x, table) >= margin), lambda good: _spans(t, pattern, 3, tokens, good))

    return _let(text, lambda t: _let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda tokens: judged(t, tokens)))


def _scanned(docs: DataFrame, text: str, model: list[float], margin: float) -> DataFrame:
    d = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("_base", base_spans(F.col("_text")))
    left = F.when(F.size("_base") > 0, _left(F.col("_text"))).otherwise(F.col("_text"))
    return d.withColumn("_all", F.array_sort(F.concat("_base", markov_spans(left, model, margin))))


def _listed(spans: str) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"], x["e"])), ",")


def secrets(docs: DataFrame, samples: DataFrame | None = None, margin: float = MARGIN) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    model = train(labelled_samples(docs) if samples is None else samples)
    d = _scanned(docs.select("doc_id", "text"), "text", model, margin)
    count = lambda k: F.size(F.filter("_all", lambda x: x["k"] == k)).cast("long")
    return d.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_listed("_base"), 256).alias("base_sha256"),
        _listed("_all").alias("spans"),
    )


def _cut(chunks: Column, a: Column, b: Column) -> Column:
    """Characters a to b of a text given in chunks of ``_CHUNK`` characters."""
    bits = _CHUNK.bit_length() - 1
    i, j, at = F.shiftright(a, bits), F.shiftright(b, bits), a.bitwiseAND(_CHUNK - 1)
    chunk = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
    across = F.concat(F.substr(chunk(i), at + 1, F.lit(_CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substr(chunk(j), F.lit(1), b.bitwiseAND(_CHUNK - 1)))
    return F.when(i == j, F.substr(chunk(i), at + 1, b - a)).otherwise(across)


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with its spans (by start) replaced; overlapping ones become one."""

    def pieces(chunks: Column, starts: Column, ends: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), ends)  # ends so far, before each span and at last
        kept = F.filter(F.zip_with(F.slice(before, F.lit(1), F.size(starts)), starts, lambda e, s: F.struct(e.alias("e"), s.alias("s"))), lambda x: x["s"] >= x["e"])
        return F.concat(F.transform(kept, lambda x: _cut(chunks, x["e"], x["s"])), F.array(_cut(chunks, F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0)), F.length(text))))

    latest = _running(F.transform(spans, lambda x: x["e"]), lambda a, b: F.greatest(a, b), F.lit(0))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    joined = _let(chunks, lambda c: _let(F.transform(spans, lambda x: x["s"]), lambda s: _let(latest, lambda e: pieces(c, s, e))))
    return F.array_join(joined, mask)


def redact(docs: DataFrame, samples: DataFrame | None = None, mask: str = "[secret]", margin: float = MARGIN) -> DataFrame:
    """All documents; every span (overlapping ones merged) replaced by ``mask``."""
    model = train(labelled_samples(docs) if samples is None else samples)
    d = _scanned(docs.select(F.struct("*").alias("_row")), "_row.text", model, margin)
    return unpacked(d, docs.columns, F.when(F.size("_all") == 0, F.col("_row.text")).otherwise(_masked(F.col("_text"), F.col("_all"), mask)))
