"""Token totals kept by deltas.

A batch of changes is summed into signed deltas by source, language and tokenizer version and committed once under its
id: deltas are written to a folder of their own, which one atomic rename makes the batch's (of several drivers that commit
one batch, one wins). Totals are the last snapshot plus the deltas committed since, so inserts, deletes and revised counts
need no second look at the documents, and ``compact`` keeps that sum short.

Changes have the columns op ('insert', 'delete' or 'revise'), source, lang, tokenizer, n_tokens and, for revisions,
old_tokens; other columns are not read, and texts of any length count whole. Defined results: a null count is 0; null sources
and languages are groups of their own; each row of a batch counts, repeated ones too; other operations raise; an empty batch
commits no deltas; groups whose totals are zero vanish. The rename must be atomic, as on HDFS and local disks; object stores
need a committer that makes it so.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import token_files

KEYS = ("source", "lang", "tokenizer")
SCHEMA = T.StructType([*[T.StructField(k, T.StringType()) for k in KEYS], T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])


def deltas(changes: DataFrame) -> DataFrame:
    op, n = F.lower("op"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    old = F.coalesce(F.col("old_tokens"), F.lit(0)).cast("long") if "old_tokens" in changes.columns else F.lit(0).cast("long")
    bad = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(F.col("op"), F.lit("null")))).cast("long")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(bad).cast("long")
    tokens = F.when(op == "insert", n).when(op == "delete", -n).when(op == "revise", n - old).otherwise(bad)
    return changes.groupBy(*[F.col(k).cast("string").alias(k) for k in KEYS]).agg(F.sum(docs).alias("n_docs"), F.sum(tokens).alias("n_tokens"))


class Rollup:
    """Deltas of committed batches, and snapshots of their sums, under one folder of the shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._at(self.path).getFileSystem(self.conf)

    def _move(self, src: str, dst: str) -> bool:
        """Atomic rename that fails if dst is there."""
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self.conf)
        if self._fs().exists(self._at(dst)):
            return False
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            files.rename(self._at(src), self._at(dst), options)
        except Py4JJavaError:
            if self._fs().exists(self._at(dst)):
                return False
            raise
        return True

    def _names(self, start: str) -> list[str]:
        fs = self._fs()
        found = [s.getPath().getName() for s in fs.listStatus(self._at(self.path))] if fs.exists(self._at(self.path)) else []
        return sorted(n for n in found if n.startswith(start))

    def folder(self, batch_id: str) -> str:
        return f"{self.path}/batch-{hashlib.sha256(batch_id.encode()).hexdigest()[:32]}"

    def is_committed(self, batch_id: str) -> bool:
        return self._fs().exists(self._at(self.folder(batch_id)))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """True if the batch was applied, False if it had been before."""
        if self.is_committed(batch_id):
            return False
        attempt = f"{self.path}/attempt-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(attempt)
        if self._move(attempt, self.folder(batch_id)):
            return True
        self._fs().delete(self._at(attempt), True)
        return False

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The last snapshot and the batches that it holds."""
        names = self._names("snapshot-")
        if not names:
            return None, set()
        last = f"{self.path}/{names[-1]}"
        return last, {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{last}/batches").collect()}  # one name a batch

    def _open(self) -> tuple[str | None, set[str], list[str]]:
        # Batches are listed before the snapshot is chosen: what a compaction meanwhile folds in is in the snapshot's own list.
        batches = self._names("batch-")
        last, held = self._snapshot()
        return last, held, [b for b in batches if b not in held]

    def _sum(self, last: str | None, batches: list[str]) -> DataFrame:
        paths = ([f"{last}/totals"] if last else []) + [f"{self.path}/{b}" for b in batches]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        last, _, batches = self._open()
        return self._sum(last, batches)

    def compact(self) -> bool:
        """Fold the batches committed since the last snapshot into a new one; their folders stay, empty, as their marks."""
        last, held, batches = self._open()
        if not batches:
            return False
        attempt = f"{self.path}/attempt-{uuid.uuid4().hex}"
        self._sum(last, batches).write.parquet(f"{attempt}/totals")
        self.spark.createDataFrame([(b,) for b in sorted(held | set(batches))], "batch string").write.parquet(f"{attempt}/batches")
        number = int(last.rsplit("-", 1)[1]) + 1 if last else 1
        if not self._move(attempt, f"{self.path}/snapshot-{number:09d}"):
            self._fs().delete(self._at(attempt), True)
            return False
        fs = self._fs()
        for b in batches:
            for f in fs.listStatus(self._at(f"{self.path}/{b}")):
                fs.delete(f.getPath(), True)
        for old in self._names("snapshot-")[:-2]:
            fs.delete(self._at(f"{self.path}/{old}"), True)
        return True


def counted(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source, lang, n_words, n_bpe): whole texts by white space and by a byte-level BPE file; null texts are empty."""
    src = docs.select(id_col, text_col, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    schema = T.StructType([src.schema[0], src.schema["source"], src.schema["lang"], T.StructField("n_words", T.LongType()), T.StructField("n_bpe", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = token_files.encoder(vocab)
        for batch in batches:
            for b in C.chunks(batch):
                texts = b.column(1).to_pylist()
                words = np.array([len(C.ascii_words(t)) for t in texts], np.int64)
                bpe = np.array([len(x) for x in enc.encode(texts)], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(words), pa.array(bpe)], names=schema.names)

    return src.mapInArrow(run, schema)


def changes(counts: DataFrame, op: str, tokenizer: str, n, old=None) -> DataFrame:
    return counts.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), n.cast("long").alias("n_tokens"), (F.lit(None) if old is None else old).cast("long").alias("old_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted under two tokenizers; those under five words are deleted again, word counts are revised to
    hold an end mark, after a compaction; the first batch is sent twice."""
    counts, _ = C.stored(spark, counted(C.table(spark, sf_dir, "documents"), token_files.vocabulary_path()), "token-counts")
    both = lambda rows, op: changes(rows, op, "words@1", F.col("n_words")).unionByName(changes(rows, op, "byte_bpe_50k@1", F.col("n_bpe")))
    book = Rollup(spark, C.new_path(spark, "token-rollup"))
    few = F.col("n_words") < 5
    book.commit("load", both(counts, "insert"))
    book.commit("drop-short", both(counts.filter(few), "delete"))
    book.compact()
    book.commit("end-marks", changes(counts.filter(~few), "revise", "words@1", F.col("n_words") + 1, F.col("n_words")))
    book.commit("load", both(counts, "insert"))
    return book.totals()
