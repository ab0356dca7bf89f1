"""Token-id files: fixed-width bit packing with block offsets.

An id takes ``bits = ceil(log2(vocabulary))`` bits. A block holds whole documents (about ``BLOCK_IDS`` ids, or one longer
document) as::

    b"QTB1" | bits u8 | 3 zero bytes | n_docs u64 | n_ids u64 | end of each document u64[n_docs] | packed ids, u64 words

all little-endian; id i stands at bit ``i * bits`` of the packed words, so a block unpacks in ``bits``-independent numpy
steps and any id or document is read alone. Blocks are rows ``(shard, block, start, n_ids, doc_ids, data)`` of a Parquet
table in ascending document order: start is the shard's id offset, so (shard, start) finds a block without reading others.

Encoding: the tokenizer splits text by its byte-level pattern and encodes each piece alone, so pieces are encoded once per
worker and looked up afterwards. Texts with characters past U+024F, rare controls or added-token strings are encoded
whole. Both give the tokenizer's own ids (tested).

Defined results: a null text is empty and yields the end id alone; null ids sort first; rows of one id are ordered by text
hash; an empty table gives no blocks. A very long text is a block of its own; Spark holds a value of at most 2 GB, so about 10^9
ids, and a longer document fails the job rather than lose ids. Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MAGIC = b"QTB1"
HEAD = struct.Struct("<4sB3xQQ")
BLOCK_IDS = 1 << 16
END_ID = 2
#: Pieces a worker remembers; when there are more it starts afresh.
CACHE_PIECES = 450_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """64 ids at a time fill ``bits`` whole words; each of the 64 places is one vectorised step."""
    n = -(-len(ids) // 64)
    if bits == 16:  # the same layout, at once
        out = np.zeros(n * 64, "<u2")
        out[: len(ids)] = ids
        return out.tobytes()
    grid = np.zeros((n, 64), np.uint64)
    grid.reshape(-1)[: len(ids)] = ids
    words = np.zeros((n, bits), np.uint64)
    for j in range(64):
        w, off = divmod(j * bits, 64)
        words[:, w] |= grid[:, j] << np.uint64(off)
        if off + bits > 64:
            words[:, w + 1] |= grid[:, j] >> np.uint64(64 - off)
    return words.astype("<u8").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        w, off = divmod(j * bits, 64)
        x = words[:, w] >> np.uint64(off)
        if off + bits > 64:
            x = x | (words[:, w + 1] << np.uint64(64 - off))
        out[:, j] = x & mask
    return out.reshape(-1)[:n]


def encode_block(docs: list[np.ndarray], bits: int) -> bytes:
    ends = np.cumsum([len(d) for d in docs]).astype("<u8")
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    return HEAD.pack(MAGIC, bits, len(docs), len(ids)) + ends.tobytes() + pack(ids, bits)


def decode_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block, and where each document ends in them."""
    magic, bits, n_docs, n_ids = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    ends = np.frombuffer(data, "<u8", n_docs, HEAD.size).astype(np.int64)
    return unpack(memoryview(data)[HEAD.size + 8 * n_docs :], n_ids, bits), ends


def ids_at(data: bytes, start: int, stop: int) -> np.ndarray:
    """Random access: ids start..stop of a block, reading only the words that hold them."""
    _, bits, n_docs, n_ids = HEAD.unpack_from(data)
    first, last = start // 64, -(-min(stop, n_ids) // 64)
    base = HEAD.size + 8 * n_docs
    ids = unpack(memoryview(data)[base + first * bits * 8 : base + last * bits * 8], (last - first) * 64, bits)
    return ids[start - first * 64 : min(stop, n_ids) - first * 64]


LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
BLANK = "\t\n\x0b\x0c\r \xa0"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: Characters whose class the pattern above doesn't know.
OTHER = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ]")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    """Ids of pieces as bytes; a piece not seen yet goes through the library's BPE model."""

    def __init__(self, model, kind: str):
        self.tokenize, self.kind, self.letters = model.tokenize, kind, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self.letters)
        ids = self[piece] = array(self.kind, [t.id for t in self.tokenize(spelled)]).tobytes()
        return ids


class Encoder:
    """Ids of texts as little-endian uint16 or uint32 arrays, through a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        small = self.size <= 1 << 16
        self.dtype = np.dtype("<u2") if small else np.dtype("<u4")
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        parts = json.loads(self.tok.to_str())
        first = parts["pre_tokenizer"] or {}
        #: Texts can be cut into pieces only if the file does no more than split by the byte-level pattern.
        self.plain = parts["normalizer"] is None and first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True) and sys.byteorder == "little"
        self.pieces = Pieces(self.tok.model, "H" if small else "I")

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: list[str | None], end_id: int | None = None) -> list[np.ndarray]:
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        find, get = PIECE.findall, self.pieces.__getitem__
        end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        out = []
        for t in texts:
            if t is None:
                ids = b""
            elif not self.plain or OTHER.search(t) or any(a in t for a in self.added):
                ids = self.whole(t)
            else:
                ids = b"".join(map(get, find(t)))
            out.append(np.frombuffer(ids + end, self.dtype))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write(spark: SparkSession, docs: DataFrame, path: str, vocab: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode whole texts and write the blocks, documents in ascending id order."""
    src = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col).alias("_th"))
    dealt = src.repartitionByRange(C.partitions(spark), id_col, "_th").sortWithinPartitions(id_col, "_th")
    id_field = src.schema[0]
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("block", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_field.dataType)), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), encoder(vocab)
        bits = bits_for(max(enc.size, end_id + 1))
        block, start, have, ids, held = 0, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            row = [[shard], [block], [start], [have]]
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in row), pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids)), pa.array([encode_block(held, bits)], pa.binary())], names=schema.names)

        for batch in batches:
            for b in C.chunks(batch):
                got = enc.encode(b.column(1).to_pylist(), end_id)
                at = 0
                for i, x in enumerate(got):
                    held.append(x)
                    have += len(x)
                    if have >= block_ids:
                        ids.append(b.column(0).slice(at, i + 1 - at))
                        yield flush()
                        block, start, have, ids, held, at = block + 1, start + have, 0, [], [], i + 1
                if at < b.num_rows:
                    ids.append(b.column(0).slice(at))
        if held:
            yield flush()

    dealt.mapInArrow(run, schema).write.parquet(path)


def shard_offsets(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each shard: one total per shard reaches the driver."""
    rows = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    out, total = {}, 0
    for r in sorted(rows, key=lambda r: r["shard"]):
        out[r["shard"]] = total
        total += r["n"]
    return out


def read(spark: SparkSession, path: str, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """Documents of the files: id, start, n_tokens, and the ids (or with ``digest`` only their crc32)."""
    blocks = spark.read.parquet(path)
    offsets = spark.sparkContext.broadcast(shard_offsets(spark, path))
    kind = blocks.schema["doc_ids"].dataType.elementType
    last = T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, _, start, _, _, data = (batch.column(k)[i] for k in range(6))
                ids, ends = decode_block(data.as_buffer())
                at = np.concatenate([[0], ends])
                first = offsets.value[shard.as_py()] + start.as_py()
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    out = pa.array([zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(4)[i].values, pa.array(first + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), out], names=schema.names)

    return blocks.select("shard", "block", "start", "n_ids", "doc_ids", "data").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.new_path(spark, "token-blocks")
    write(spark, C.table(spark, sf_dir, "documents"), path, vocabulary_path())
    return read(spark, path, digest=True)
