"""Token ids as length-delimited binary records with a separate offset index.

Each data file is a run of records: the payload's length (8 bytes), the masked checksum of those
8 bytes, the payload and its masked checksum. The payload is the number of bytes per id, 2 or 4 as
the vocabulary needs, and the ids as little-endian unsigned integers of that size. The checksum is CRC-32 rotated and shifted by a constant, so that a checksum stored inside checksummed
data does not look valid. The index file beside it holds one fixed-size entry per record, so any
record can be read without those before it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lateweave.llm.bpe import ChunkEncoder
from lateweave.llm.common import materialize, text_slices
from lateweave.sources import paths

ENTRY = np.dtype([("has_id", "<i8"), ("doc_id", "<i8"), ("offset", "<u8"), ("n_tokens", "<u8")])
HEAD = "<QI"  # length and its masked checksum
MANIFEST = "part int, file string, records bigint, tokens bigint"
MASK = 0xA282EAD8
REMEMBERED = 400_000  # chunks of text that a worker process remembers
FRAME = struct.calcsize(HEAD) + 4  # bytes of a record besides its payload


def masked(data) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def read_frame(source) -> bytes:
    """The next payload; raises if a length or payload does not fit its checksum."""
    head = source.read(struct.calcsize(HEAD))
    length, check = struct.unpack(HEAD, head)
    if masked(head[:8]) != check:
        raise ValueError("record length does not match its checksum")
    payload = source.read(length)
    if len(payload) != length or struct.unpack("<I", source.read(4))[0] != masked(payload):
        raise ValueError("record does not match its checksum")
    return payload


def unpack_ids(payload: bytes) -> bytes:
    """The ids of a payload as little-endian unsigned 32-bit integers."""
    if payload[0] not in (2, 4):
        raise ValueError("a record's ids have 2 or 4 bytes")
    return np.frombuffer(payload, dtype=f"<u{payload[0]}", offset=1).astype("<u4").tobytes()


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_token_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Encode every text, append ``end_id`` and write record files in ascending ``doc_id`` order.

    ``folder`` is shared by all executors. Returns the manifest: part, file, records, tokens. A
    task that is run again writes files of another name; only files in the manifest count, and
    left-overs of failed attempts are deleted. NULL texts are empty and give the end id alone. NULL
    ids come first; rows that repeat an id are ordered by their text's hash. An empty table writes
    no records. Extra columns are ignored.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ChunkEncoder.of_process(tokenizer_path, REMEMBERED)
        store, root = _store(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        records = tokens = offset = 0
        sink = index = None
        width = 2 if max(encode.tokenizer.get_vocab_size(), end_id) <= 1 << 16 else 4
        kind = bytes([width])
        for batch, texts in text_slices(batches):
            if sink is None:
                store.create_dir(root, recursive=True)
                sink = store.open_output_stream(f"{root}/{name}.rec")
                index = store.open_output_stream(f"{root}/{name}.idx")
            flat, counts = encode(texts)
            entries = np.zeros(len(texts), dtype=ENTRY)
            # All ids of the slice with the end ids put in, in the bytes of the file.
            raw = memoryview(np.insert(flat, np.cumsum(counts), end_id).astype(f"<u{width}").tobytes())
            sizes = (counts + 1) * width
            ends = np.cumsum(sizes)
            frames = [frame(b"".join((kind, raw[e - n:e]))) for n, e in zip(sizes.tolist(), ends.tolist())]
            whole = sizes + len(kind) + FRAME
            entries["offset"] = offset + np.cumsum(whole) - whole
            offset += int(whole.sum())
            ids = batch.column("doc_id")
            entries["has_id"] = ids.is_valid().to_numpy(zero_copy_only=False)
            entries["doc_id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
            entries["n_tokens"] = counts + 1
            sink.write(b"".join(frames))
            index.write(entries.tobytes())
            records += len(texts)
            tokens += int(counts.sum()) + len(texts)
        if sink is not None:
            sink.close()
            index.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "file": [name], "records": [records], "tokens": [tokens]})

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))
    manifest = materialize(ordered.mapInArrow(write, MANIFEST), "manifest")
    valid = {r.file for r in manifest.select("file").toLocalIterator()}
    for path in paths.children(spark, folder):
        if path.rpartition("/")[2].rpartition(".")[0] not in valid:
            paths.delete(spark, path)
    return manifest


def _with_starts(manifest: DataFrame) -> DataFrame:
    """Tokens of all earlier files: one row per file, not per document."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_index(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """The offset index as rows: file, doc_id, offset, start, n_tokens."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with store.open_input_stream(f"{root}/{name}.idx") as source:
                    while raw := source.read(ENTRY.itemsize * 100_000):
                        e = np.frombuffer(raw, dtype=ENTRY)
                        n = e["n_tokens"].astype(np.int64)
                        starts = base + np.cumsum(n) - n
                        base += int(n.sum())
                        yield pa.RecordBatch.from_pydict({
                            "file": pa.array([name] * len(e)),
                            "doc_id": pa.array(e["doc_id"], mask=e["has_id"] == 0),
                            "offset": pa.array(e["offset"].astype(np.int64)), "start": starts, "n_tokens": n})

    return _one_file_per_task(_with_starts(manifest)).mapInArrow(
        rows, "file string, doc_id bigint, offset bigint, start bigint, n_tokens bigint")


def _one_file_per_task(manifest: DataFrame) -> DataFrame:
    """Rows are few and small, files are not: a fixed number of tasks, which Spark does not merge."""
    return manifest.repartition(max(1, manifest.count()))


def read_token_records(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """All records in file order, checksums verified: doc_id, start, ids (binary)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with (store.open_input_stream(f"{root}/{name}.idx") as index,
                      store.open_input_stream(f"{root}/{name}.rec", buffer_size=1 << 20) as source):
                    while raw := index.read(ENTRY.itemsize * 256):
                        e = np.frombuffer(raw, dtype=ENTRY)
                        payloads = [unpack_ids(read_frame(source)) for _ in range(len(e))]
                        n = np.array([len(p) // 4 for p in payloads], dtype=np.int64)
                        if (n != e["n_tokens"]).any():
                            raise ValueError(f"{name}: index and records differ")
                        starts = base + np.cumsum(n) - n
                        base += int(n.sum())
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(e["doc_id"], mask=e["has_id"] == 0), "start": starts,
                            "ids": pa.array(payloads, pa.binary())})

    return _one_file_per_task(_with_starts(manifest)).mapInArrow(
        rows, "doc_id bigint, start bigint, ids binary")


def fetch_records(index: DataFrame, folder: str) -> DataFrame:
    """Shuffled reads: the record behind each index row (file, doc_id, offset), in the given order."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            open_files: dict = {}
            payloads = []
            for name, offset in zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist()):
                if name not in open_files:
                    if len(open_files) >= 64:
                        open_files.pop(next(iter(open_files))).close()
                    open_files[name] = store.open_input_file(f"{root}/{name}.rec")
                open_files[name].seek(offset)
                payloads.append(unpack_ids(read_frame(open_files[name])))
            for f in open_files.values():
                f.close()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(payloads, pa.binary())], names=["doc_id", "ids"])

    return index.select("file", "doc_id", "offset").mapInArrow(rows, "doc_id bigint, ids binary")


def record_digests(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as stored."""
    return records.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))
