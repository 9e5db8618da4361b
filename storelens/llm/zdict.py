"""Operator 3, token-id output: documents compressed one by one with a shared
zstandard dictionary trained on serialized id arrays.

File format (a folder in the shared store, written and read by Spark):

* ``blocks/``  one row per block: part, block (position in the part),
  dict_hash, payload (the documents' zstandard frames, one after the other)
  and the offset index of the block: arrays doc_id, frame_at, frame_len,
  n_tokens.  Parts and blocks are in ascending doc_id order.
* ``dictionary/``  one row: dict_hash (sha256), dictionary, id_bytes.

A short document is read by fetching its block's row and one frame of it.

Defined cases: a null or empty text holds only the end id; null ids come
first; rows that repeat an id follow each other and stay apart; an empty table
gives an empty folder and no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, ship
from .encode import END_ID, WORD_PIECES, Vocabulary, encoded

#: Dictionary training: so many documents, those with the smallest id hash
#: among the documents of at most SAMPLE_TOKENS ids.  Only the dictionary is
#: fitted on them; every document is compressed.
SAMPLE_DOCS = 2_000
SAMPLE_TOKENS = 4_096
DICT_BYTES = 64 << 10
#: A block is closed when its frames reach this size.
BLOCK_BYTES = 1 << 20
LEVEL = 3


def train_dictionary(enc: DataFrame) -> bytes:
    """The shared dictionary; too few samples give their own bytes as one."""
    import zstandard

    some = enc.where(F.col("n_tokens") <= SAMPLE_TOKENS).withColumn("_h", F.xxhash64("key"))
    n = some.count()
    if n > 2 * SAMPLE_DOCS:  # only about twice the rows wanted reach the sort
        some = some.where(F.col("_h") <= F.lit(int((4 * SAMPLE_DOCS / n - 1) * (1 << 63))))
    rows = some.orderBy("_h", "key").limit(SAMPLE_DOCS).select("ids").collect()
    samples = [bytes(r.ids) for r in rows]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 4), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_ids(enc: DataFrame, path: str) -> None:
    """Writes the file format above from ``encoded`` rows."""
    spark = enc.sparkSession
    raw = train_dictionary(enc)
    dict_hash = hashlib.sha256(raw).hexdigest()
    width = 2 if enc.where(F.length("ids") > 2 * F.col("n_tokens")).isEmpty() else 4
    spark.createDataFrame([(dict_hash, bytearray(raw), width)], "dict_hash string, dictionary binary, id_bytes int").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(raw)  # at most DICT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value))
        part, block = TaskContext.get().partitionId(), 0
        doc, at, size, tokens, frames, held = [], [], [], [], [], 0

        def close() -> pa.RecordBatch:
            row = [[part], [block], [dict_hash], [b"".join(frames)], [list(doc)], [list(at)], [list(size)], [list(tokens)]]
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.list_(id_kind), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(row, kinds, strict=True)], names=names)

        names = ["part", "block", "dict_hash", "payload", "doc_id", "frame_at", "frame_len", "n_tokens"]
        id_kind = pa.int64()
        for b in batches:
            id_kind = b.schema.field(0).type
            for d, ids, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                f = z.compress(ids)
                doc.append(d)
                at.append(held)
                size.append(len(f))
                tokens.append(n)
                frames.append(f)
                held += len(f)
                if held >= BLOCK_BYTES:
                    yield close()
                    block, held = block + 1, 0
                    for x in (doc, at, size, tokens, frames):
                        x.clear()
        if doc:
            yield close()

    kind = enc.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = enc.repartitionByRange(parts, "doc_id", "key").sortWithinPartitions("doc_id", "key")
    blocks = ordered.select("doc_id", "ids", "n_tokens").mapInArrow(
        run,
        f"part int, block bigint, dict_hash string, payload binary, doc_id array<{kind}>, "
        "frame_at array<bigint>, frame_len array<bigint>, n_tokens array<bigint>",
    )
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def _reader(spark: SparkSession, path: str):
    """Dictionary broadcast of a written folder (at most DICT_BYTES)."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    return spark.sparkContext.broadcast((row.dict_hash, bytes(row.dictionary), row.id_bytes))


def read_ids(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """doc_id, part, block, place, ids (array of numbers) of the written
    documents; with ``doc_ids``, of those only, opening just their frames."""
    blocks = spark.read.parquet(f"{path}/blocks")
    if doc_ids is not None:
        blocks = blocks.where(F.arrays_overlap("doc_id", F.array(*[F.lit(d) for d in doc_ids])))
    shared, wanted = _reader(spark, path), None if doc_ids is None else set(doc_ids)
    kind = blocks.schema["doc_id"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _frames(batches, shared.value, wanted):
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip((*r[:4], r[5].tolist()), (pa.int64() if kind == "bigint" else None, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)],
                names=["doc_id", "part", "block", "place", "ids"],
            )

    return blocks.mapInArrow(run, f"doc_id {kind}, part int, block bigint, place bigint, ids array<bigint>")


def _frames(batches, dictionary, wanted=None):
    """(doc_id, part, block, place, frame bytes, ids) of each document."""
    import zstandard

    dict_hash, raw, width = dictionary
    z = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
    for b in batches:
        for row in b.to_pylist():
            if row["dict_hash"] != dict_hash:
                raise ValueError(f"block {row['part']}/{row['block']} needs dictionary {row['dict_hash']}")
            for k, d in enumerate(row["doc_id"]):
                if wanted is not None and d not in wanted:
                    continue
                at, size, n = row["frame_at"][k], row["frame_len"][k], row["n_tokens"][k]
                data = z.decompress(row["payload"][at : at + size], max_output_size=n * width)
                yield d, row["part"], row["block"], k, size, np.frombuffer(data, f"<u{width}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a written folder, from its decoded frames:
    doc_id, start, n_tokens, ids_crc32, part, block, frame_bytes."""
    ship(spark)
    blocks = spark.read.parquet(f"{path}/blocks")
    shared = _reader(spark, path)
    kind = blocks.schema["doc_id"].dataType.elementType.simpleString()
    names = ["doc_id", "part", "block", "place", "frame_bytes", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*r[:5], len(r[5]), zlib.crc32(r[5].astype("<u4").tobytes())) for r in _frames([b], shared.value)]
            cols = list(zip(*rows, strict=True))
            kinds = [b.schema.field("doc_id").type.value_type, pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    rows = blocks.mapInArrow(run, f"doc_id {kind}, part int, block bigint, place bigint, frame_bytes bigint, n_tokens bigint, ids_crc32 bigint")
    # Running totals in two steps: over the parts (one row each), then inside each part.
    inside = W.partitionBy("part").orderBy("block", "place").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("_t"))
    before = totals.select("part", F.coalesce(F.sum("_t").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return rows.join(before, "part").select(
        "doc_id", (F.col("_b") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32", "part", "block", "frame_bytes"
    )


def compressed_ids(docs: DataFrame, vocabulary_path: str, path: str | None = None) -> DataFrame:
    """Encodes ``docs``, writes the folder ``path`` (default: a new one in the
    shared store) and returns the manifest read back from it."""
    spark = docs.sparkSession
    path = path or scratch(spark, "token-ids")
    write_ids(encoded(docs, Vocabulary.load(vocabulary_path, WORD_PIECES)), path)
    return manifest(spark, path)
