"""Token ids in files of length-delimited binary records, and an offset index beside them.

A file is a run of records. All numbers are little-endian:

    length   u64   bytes of the payload
    masked   u32   masked crc32 of the eight length bytes
    payload        doc_id i64 (the least i64 for null), start u64 (ids before it in this file), ids as u16 or u32 up to the end
    masked   u32   masked crc32 of the payload
    newline  u8    10, the separator that Spark's text writer puts after each record

A masked checksum is the crc rotated right by 15 bits plus 0xa282ead8, so that a checksum over data that holds checksums stays sound. Files are
written by Spark's own committed writer, so any file system that Spark writes to will do and a lost executor leaves no half file behind.
The index (Parquet) has a row for each record: file, offset, bytes, doc_id, start, n_tokens, ids_crc32, where start counts the ids of all records before
it in all files; a shuffled reader seeks by it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hopline.llm.chunks import cut, gather
from hopline.llm.common import give_back
from hopline.llm.token_counts import Memo, PreTokens
from hopline.session import materialize, shared_dir

NULL_ID = -(1 << 63)
MASK_DELTA = 0xA282EAD8  # fixed value of the masked checksum
#: Payloads of a task go out in batches of about this many bytes.
BATCH_BYTES = 8 << 20
#: Entries of a worker's cache.
CACHE = 1 << 17
#: Rows that a worker encodes at a time; with 500 it holds some 70 MB less, and takes a quarter longer.
SLICE = 2_000
#: Bytes of text in a file, which also bound the memory of the task that writes it: the least, and, once there would be more than FILES files, up to the most.
LEAST_BYTES, MOST_BYTES, FILES = 12 << 20, 128 << 20, 4096

_workers: dict[tuple[str, str], "Encoder"] = {}


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(zlib.crc32(length))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each record of a file; raises on a checksum or length that does not fit."""
    at = 0
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError(f"truncated record at {at}")
        n, check = struct.unpack_from("<QI", data, at)
        end = at + 12 + n + 4
        if check != masked(zlib.crc32(data[at : at + 8])) or end + 1 > len(data):
            raise ValueError(f"bad length at {at}")
        payload = data[at + 12 : end - 4]
        if struct.unpack_from("<I", data, end - 4)[0] != masked(zlib.crc32(payload)) or data[end] != 10:
            raise ValueError(f"bad payload at {at}")
        yield at, payload
        at = end + 1


class Encoder:
    """Ids by the tokenizers library, each distinct pre-token of a batch once, and remembered; see ``chunks`` for why that gives the ids of whole texts."""

    def __init__(self, path: str, dtype: str):
        self.own, self.dtype = PreTokens(path), np.dtype(dtype)
        self.cache = Memo(CACHE)

    @classmethod
    def get(cls, path: str, dtype: str) -> "Encoder":
        if (path, dtype) not in _workers:
            _workers[path, dtype] = cls(path, dtype)
        return _workers[path, dtype]

    def _pre_token(self, token: str) -> bytes:
        ids = array(self.dtype.char, self.own.encode(token)).tobytes()
        self.cache.offer(token, ids)
        return ids

    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each of a batch of non-null texts."""
        width = self.dtype.itemsize
        for c in cut(texts, self.own.special, self.own.find):
            known, own = self.cache.get, self._pre_token
            found = [known(t) or own(t) for t in c.tokens]
            places, upto = gather(np.fromiter(map(len, found), np.int64, len(found)) // width, c.index)
            ids = np.frombuffer(b"".join(found), self.dtype)[places].tobytes()
            bounds = (np.concatenate([[0], upto])[c.bounds] * width).tolist()
            plain = {r: ids[a:b] for r, a, b in zip(c.plain.tolist(), bounds[:-1], bounds[1:], strict=True)}
            for r in range(len(c.texts)):
                yield plain[r] if r in plain else np.array(self.own.whole(c.texts[r].as_py()), self.dtype).tobytes()


def id_dtype(path: str) -> str:
    """Two bytes an id where the vocabulary allows it."""
    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def _framer(path: str, dtype: str, end_id: int, slice_rows: int = SLICE):
    end, width = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = Encoder.get(path, dtype), 0
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch, out, size = whole.slice(at, slice_rows), [], 0
                for doc_id, found in zip(batch.column("doc_id").to_pylist(), enc.batch(batch.column("text")), strict=True):
                    ids = found + end
                    out.append(frame(struct.pack("<qQ", NULL_ID if doc_id is None else doc_id, before) + ids))
                    before += len(ids) // width
                    size += len(out[-1])
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
        give_back()

    return run


def write_records(docs: DataFrame, path: str, out: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", order: tuple[str, ...] | None = None, slice_rows: int = SLICE) -> str:
    """Encode each row of ``docs`` with the tokenizer file ``path``, append ``end_id``, and write records in ascending id order; returns their folder.

    ``order`` names columns to sort by in place of the id: ``("_metadata.file_path", "_metadata.row_index")`` for the order in which files were written.

    A null text has the end id alone; null ids come first; rows that share an id keep a record each, ordered by a hash of the text. An empty table gives
    a folder without records; other columns are ignored. Texts are shuffled once, to be range-sorted by (id, hash of the text, and among equal rows their
    place in the scan, so that copies do not pile up in one task); each task encodes what it has and appends to its file, whose name orders it among the
    others. The number of files follows from the bytes of all texts. Bytes go through Spark's text writer as a string column that is never decoded.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    files = max(1, -(-total // min(MOST_BYTES, max(LEAST_BYTES, total // FILES))))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order or ())))
    by = [f"__o{i}" for i in range(len(order))] if order else ["doc_id", "tie", "place"]
    ranged = slim.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(files, *by).sortWithinPartitions(*by).select("doc_id", "text")
    framed = ranged.mapInArrow(_framer(path, id_dtype(path), end_id, slice_rows), "record binary")
    data = f"{out}/records"
    framed.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(data)
    return data


def read_index(spark: SparkSession, data: str, dtype: str) -> DataFrame:
    """Read all files back, verify every checksum, and return the offset index (see above), with the crc32 of the ids as u32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for at, payload in records(content.as_py()):
                    doc_id, start = struct.unpack_from("<qQ", payload)
                    ids = np.frombuffer(payload, dtype, offset=16)
                    rows.append((path.rpartition("/")[2], at, len(payload) + 17, None if doc_id == NULL_ID else doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                kinds = (pa.string(), *[pa.int64()] * 6)
                cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(cols, ["file", "offset", "bytes", "doc_id", "local", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(data).select("path", "content")
    schema = "file string, offset long, bytes long, doc_id long, local long, n_tokens long, ids_crc32 long"
    found = materialize(files.mapInArrow(run, schema), "index")
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # a row for each file; files are some tens of MB each
    base = totals.select("file", (F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("base"))
    return found.join(base, "file").select(
        "file", "offset", "bytes", "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )


def export_tokens(docs: DataFrame, path: str, out: str | None = None, end_id: int = 0, **cols) -> tuple[DataFrame, str]:
    """Write record files and the index under ``out`` (a new folder in the shared one by default); returns (index, folder)."""
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/hopline/tokens-{uuid.uuid4().hex}"
    data = write_records(docs, path, out, end_id, **cols)
    read_index(spark, data, id_dtype(path)).write.parquet(f"{out}/index")
    return spark.read.parquet(f"{out}/index"), out
