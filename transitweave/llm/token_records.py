"""Token ids as length-delimited binary records, with an index for reads in any order.

A file is a run of records, each framed as

    length of the payload   8 bytes, little-endian
    masked CRC of these 8   4 bytes
    payload                 4 bytes width (2 or 4), then the ids, little-endian, of that width
    masked CRC of it        4 bytes

The CRC is CRC-32, turned right by 15 bits plus a constant, so that a checksum
over data that hold checksums stays sound. Files hold documents in ascending id;
file k has smaller ids than file k + 1. The index, a Parquet table, has for each
record its file, offset, length and tokens. Files go through pyarrow.fs, so the
shared folder may be any store that it knows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, partitions, shared_dir, task_start
from .token_counts import WordRules, byte_characters

_MASK = 0xA282EAD8
_CHUNK = 8 << 20


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def framed(ids: bytes, width: int) -> bytes:
    """A record of little-endian ids of `width` bytes each."""
    body = width.to_bytes(4, "little") + ids
    head = len(body).to_bytes(8, "little")
    return b"".join((head, masked_crc(head).to_bytes(4, "little"), body, masked_crc(body).to_bytes(4, "little")))


def unframed(record: bytes) -> np.ndarray:
    """The ids of one whole record as uint32; ValueError if it is damaged."""
    head, body = record[:8], record[12:-4]
    if int.from_bytes(head, "little") != len(body) or masked_crc(head) != int.from_bytes(record[8:12], "little") or masked_crc(body) != int.from_bytes(record[-4:], "little"):
        raise ValueError("damaged record")
    return np.frombuffer(body, f"<u{int.from_bytes(body[:4], 'little')}", offset=4).astype("<u4")


class FileEncoder:
    """Encodes with the tokenizers library, each word once.

    The library merges inside words only, so the ids of a text are those of its
    words in a row: a word goes straight to the library's model, in the printable
    characters for its bytes. Texts that may hold special tokens go to the
    library whole.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        self.rules = WordRules(json.loads(self.library.to_str()))
        self.model = self.library.model
        size = self.library.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.id_bytes = [k.to_bytes(self.width, "little") for k in range(size)]
        self.characters = dict(enumerate(byte_characters()))
        self.words, self.runs = Memo(self.word), Memo(self.run)

    def packed(self, ids: list[int]) -> bytes:
        return b"".join(map(self.id_bytes.__getitem__, ids))

    def word(self, word: str) -> bytes:
        return self.packed([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.characters))])

    def whole(self, text: str) -> bytes:
        return self.packed(self.library.encode(text, add_special_tokens=False).ids)

    def run(self, text: str) -> bytes:
        if self.rules.doubtful(text):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, self.rules.words(text)))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, of self.width bytes each."""
        if not text:
            return b""
        if self.rules.whole_only(text):
            return self.whole(text)
        return b"".join(map(self.runs.__getitem__, text.split()))


def write_records(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents and returns the written index: doc_id, file, offset, length, n_tokens.

    A null text is written as the end id alone. Rows with equal ids stand in the
    order of their texts' CRC-32; null ids come first. A task that runs again writes a
    file of its own and names it only when it is whole, so each range has one
    whole file, whichever attempt wrote it. An empty table gives an empty index.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    dealt = rows.repartitionByRange(partitions(spark), "doc_id", F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))).sortWithinPartitions("doc_id", F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        e = task_start(FileEncoder, tokenizer_file)
        end = e.packed([end_id])
        name = f"part-{TaskContext.get().partitionId():06d}.rec"
        temporary = f"{root}/.{name}-{uuid.uuid4().hex}"
        out, offset = None, 0
        for batch in batches:
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(temporary)
            offsets, lengths, counts = [], [], []
            for text in batch.column(1).to_pylist():
                ids = e.encode(text) + end
                record = framed(ids, e.width)
                out.write(record)
                offsets.append(offset)
                lengths.append(len(record))
                counts.append(len(ids) // e.width)
                offset += len(record)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(counts), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "file", "offset", "length", "n_tokens"])
        if out is not None:
            out.close()
            store.move(temporary, f"{root}/{name}")

    index = f"{folder}/index.parquet"
    (written := dealt.mapInArrow(write, f"doc_id {id_type}, file string, offset long, length long, n_tokens long")).write.parquet(index)
    return spark.read.schema(written.schema).parquet(index)


def file_starts(index: DataFrame) -> DataFrame:
    """Per file: how many tokens all files before it hold. As many rows as files."""
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("tokens"))
    return totals.select("file", F.coalesce(F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))


def read_records(folder: str, index: DataFrame) -> DataFrame:
    """Reads every file from front to back: doc_id, start, n_tokens, ids_crc32.

    doc_id comes from the index, in whose order the records stand; the rest comes
    from the records. start is the tokens of all records before. A damaged record
    raises. The index rows of a file go to the task that reads it.
    """
    id_type = index.schema["doc_id"].dataType.simpleString()
    keyed = index.join(F.broadcast(file_starts(index)), "file").select("file", "offset", "length", "doc_id", "start")
    dealt = keyed.repartition(partitions(index.sparkSession), "file").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, source, at = None, None, 0
        for batch in batches:
            starts, counts, crcs = [], [], []
            for file, offset, length, start in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if file != name:
                    if source:
                        source.close()
                    name, source, at = file, store.open_input_stream(f"{root}/{file}", buffer_size=_CHUNK), start
                ids = unframed(source.read(length))
                starts.append(at)
                counts.append(len(ids))
                crcs.append(zlib.crc32(ids.tobytes()))
                at += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        if source:
            source.close()

    return dealt.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def read_at(folder: str, wanted: DataFrame) -> DataFrame:
    """Records in any order: for index rows (doc_id, file, offset, length) the ids, each by one seek."""
    id_type = wanted.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            ids = []
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                with store.open_input_file(f"{root}/{file}") as f:
                    f.seek(offset)
                    ids.append(unframed(f.read(length)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.uint32())).cast(pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return wanted.select("doc_id", "file", "offset", "length").mapInArrow(read, f"doc_id {id_type}, ids array<long>")


def record_folder(spark: SparkSession) -> str:
    """A new folder for records in the shared one."""
    return f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
