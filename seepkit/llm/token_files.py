"""Token-id files: flat unsigned integers plus 64-bit document offsets, to be memory-mapped.

A dataset is a folder of shards ``NNNNN`` in ascending key order, each of three flat files:

* ``NNNNN.ids``: token ids, little-endian unsigned 16 bits if the vocabulary allows it, else 32;
* ``NNNNN.offsets``: n + 1 little-endian unsigned 64-bit places in ``.ids``, counted from the shard's base;
* ``NNNNN.docs``: n signed 64-bit keys (the least value stands for null).

``manifest.json`` lists the shards with their bases: the prefix sums of the shards' token counts. A
document's global offset is base + local offset. Shards are range partitions of the key, written by
the tasks that encode them. A task writes to names of its own attempt and then renames, so a task
that runs twice after a lost executor leaves one shard.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepkit.llm.staging import file_system, new_path
from seepkit.llm.tokens import encoder, largest_id
from seepkit.llm.workers import tidy

NULL_KEY = np.iinfo(np.int64).min
#: Bytes of the table that a shard is made of, at most about; sizes from which Spark means that it knows none.
SHARD, UNKNOWN = 256 << 20, 1 << 60
#: Documents read at a time.
ROWS = 2_000


def write_tokens(docs: DataFrame, encode_path: str, kind: str, end_id: int, path: str | None = None, key: str = "doc_id", text: str = "text", shards: int | None = None) -> str:
    """Encode every whole text, append ``end_id`` and write the dataset; returns its folder.

    Null and empty texts hold ``end_id`` alone; a null key comes first; rows that repeat a key are
    kept, in the order of their texts; other columns are ignored; an empty table gives no shard. Ids are
    as wide as the vocabulary's largest one needs. There are ``shards`` shards, by default one a shuffle
    partition or more, so that one holds about ``SHARD`` bytes. The driver gets one row a shard.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    width = "<u2" if max(largest_id(encode_path), end_id) < 1 << 16 else "<u4"
    fs, inner = file_system(path)
    fs.create_dir(inner, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = None, None
        for batch in batches:
            if not len(batch):
                continue
            enc = enc or encoder(encode_path, kind)
            shard = shard or ShardWriter(path, TaskContext.get().partitionId(), width)
            for lo, hi, ids, at in enc.encode_ended(batch.column(1), end_id):
                shard.add(batch.column(0).slice(lo, hi - lo), ids, at)
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard.number, "n_docs": shard.docs, "n_tokens": shard.tokens}], schema=MANIFEST)

    keyed = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    dealt = keyed.repartitionByRange(shards or shards_for(keyed), "k").sortWithinPartitions("k", "t")
    rows = sorted(dealt.mapInArrow(tidy(write, "encoders"), "shard long, n_docs long, n_tokens long").collect())
    base, shards = 0, []
    for number, n_docs, n_tokens in rows:
        shards.append({"shard": number, "base": base, "n_docs": n_docs, "n_tokens": n_tokens})
        base += n_tokens
    with fs.open_output_stream(f"{inner}/manifest.json") as out:
        out.write(json.dumps({"ids": width, "tokens": base, "shards": shards}).encode())
    return path


def shards_for(df: DataFrame) -> int:
    """Shuffle partitions, or more where Spark knows the size of the table and they would hold over SHARD bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < UNKNOWN else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // SHARD))


MANIFEST = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Appends documents to one shard's three files, each through a stream of its own."""

    ENDS = ("ids", "offsets", "docs")

    def __init__(self, path: str, number: int, width: str):
        self.number, self.width, self.docs, self.tokens = number, width, 0, 0
        self.fs, inner = file_system(path)
        self.final = f"{inner}/{number:05d}"
        self.mine = f"{inner}/_{number:05d}.{TaskContext.get().taskAttemptId()}"
        self.ids, self.offsets, self.keys = (self.fs.open_output_stream(f"{self.mine}.{end}") for end in self.ENDS)
        self.offsets.write(np.zeros(1, "<u8").tobytes())

    def add(self, keys: pa.Array, ids: np.ndarray, at: np.ndarray) -> None:
        """Documents with their flat ids, and n + 1 offsets into them."""
        self.ids.write(ids.astype(self.width).tobytes())
        self.offsets.write((at[1:] + self.tokens).astype("<u8").tobytes())
        self.keys.write(pc.fill_null(keys, NULL_KEY).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        self.docs += len(keys)
        self.tokens += len(ids)

    def close(self) -> None:
        for stream in (self.ids, self.offsets, self.keys):
            stream.close()
        for end in self.ENDS:
            self.fs.move(f"{self.mine}.{end}", f"{self.final}.{end}")


class FlatFile:
    """One of a shard's files: memory-mapped where the file system is local, else read by ranges."""

    def __init__(self, fs, path: str, kind: str):
        from pyarrow.fs import LocalFileSystem

        self.kind, self.width = kind, np.dtype(kind).itemsize
        self.size = fs.get_file_info(path).size // self.width
        local = isinstance(fs, LocalFileSystem)
        self.mapped = np.memmap(path, kind, mode="r") if local and self.size else None
        self.file = None if local else fs.open_input_file(path)

    def __getitem__(self, places: slice) -> np.ndarray:
        if self.file is None:
            return self.mapped[places] if self.size else np.empty(0, self.kind)
        a, b, _ = places.indices(self.size)
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), self.kind)


def manifest(path: str) -> dict:
    fs, inner = file_system(path)
    with fs.open_input_stream(f"{inner}/manifest.json") as f:
        return json.loads(f.read())


def read_shard(path: str, shard: int, width: str, rows: int = ROWS) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(key, local start, ids) of each document; memory holds ``rows`` documents at most."""
    fs, inner = file_system(path)
    ids, offsets, keys = (FlatFile(fs, f"{inner}/{shard:05d}.{end}", kind) for end, kind in (("ids", width), ("offsets", "<u8"), ("docs", "<i8")))
    for lo in range(0, keys.size, rows):
        at = offsets[lo : lo + rows + 1].tolist()
        block = ids[at[0] : at[-1]]
        for k, a, b in zip(keys[lo : lo + rows].tolist(), at[:-1], at[1:], strict=True):
            yield (None if k == NULL_KEY else k), a, block[a - at[0] : b - at[0]]


def read_documents(spark: SparkSession, path: str, made: Callable[[list], list], fields: pa.Schema, schema: str, rows: int = ROWS) -> DataFrame:
    """Map ``made`` over lists of (key, global start, ids), a task a shard."""
    m = manifest(path)
    width = m["ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                some = []
                for k, a, ids in read_shard(path, row["shard"], width):
                    some.append((k, row["base"] + a, ids))
                    if len(some) == rows:
                        yield pa.RecordBatch.from_pylist(made(some), schema=fields)
                        some = []
                if some:
                    yield pa.RecordBatch.from_pylist(made(some), schema=fields)

    listed = [(s["shard"], s["base"]) for s in m["shards"]]
    shards = spark.createDataFrame(listed, "shard long, base long").repartition(max(1, len(listed)))
    return shards.mapInArrow(read, schema)


def token_file_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files.

    A null key comes back null; a document of a null or empty text has the end id alone; documents that
    repeat a key each have a row; a dataset without shards gives no rows.
    """
    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def made(some: list) -> list:
        return [{"doc_id": k, "start": a, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())} for k, a, ids in some]

    return read_documents(spark, path, made, fields, "doc_id long, start long, n_tokens long, ids_crc32 long")
