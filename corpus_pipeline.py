"""A corpus through five stages: quality rules, near-duplicates, benchmark passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import common, decontamination, near_dedup, packing, quality_rules, secrets, token_files


def plainly(docs: DataFrame) -> tuple[DataFrame, str, str, list[str]]:
    """The rows with columns that clash with nothing, the new names of id and text, and all of them in order."""
    new = [f"_c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index
    return docs.toDF(*new), new[at("doc_id")], new[at("text")], new


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy of the rule ledger rejects go. Null and empty texts have too few words and go; repeated
    rows are judged alike and all stay or all go; texts of any length are measured whole; an empty table stays empty."""
    rows, id_col, text_col, names = plainly(docs)
    entries = quality_rules.ledger(rows, id_col, text_col, carry=tuple(names))
    return quality_rules.apply_policy(entries).filter("kept").select(*names).toDF(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 0.8 over five-word shingles the one with the smallest id stays.

    Null ids come last (they stay only in a group without another id); texts without words link with nothing, so each stays; of
    rows that share id and text, the one whose other columns are least as JSON stays; texts that differ under one id are
    judged each; an empty table stays empty."""
    rows, id_col, text_col, names = plainly(docs)
    found = near_dedup.cluster(spark, rows, 5, 80, id_col, text_col)
    kept = found.filter("kept").select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_th")).distinct()
    # Repeated rows are folded before the shuffle, which the join then shares.
    rest = F.to_json(F.struct(F.lit(0).alias("_"), *[c for c in names if c not in (id_col, text_col)]))
    one = rows.withColumn("_h", F.xxhash64(text_col)).groupBy(id_col, "_h").agg(F.min_by(F.struct(*names), rest).alias("_row"))
    one = one.join(kept, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")), "left_semi")
    return one.select("_row.*").select(*names).toDF(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none and stay, repeated rows go or stay
    together, an empty benchmark takes nothing away, an empty table stays empty."""
    rows, id_col, text_col, names = plainly(docs)
    found = decontamination.detect(spark, rows, common.table(spark, sf_dir, "benchmark"), id_col, text_col, carry=tuple(names))
    return found.filter("n_hit = 0").select(*names).toDF(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every document stays, repeated rows too, and ``n_chars`` is counted anew. Null texts stay
    null, an empty table stays empty."""
    out = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, as token ids, with its sequence. Null and empty texts are an end id; repeated rows are
    packed each; an empty table gives no rows."""
    return packing.pack(spark, docs, token_files.vocabulary_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: Near-duplicate components and packing are beyond SQL; tests/llm holds the run against brute force.
ORACLE_SQL = None


#: Rows of a batch between Spark and Python while the stages run: texts of a few kilobytes make megabytes, on both sides.
BATCH_ROWS = 2000


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each one's rows are written to the shared folder and read again. What a stage needed besides is
    deleted once its rows are written."""
    docs = common.table(spark, sf_dir, "documents")
    name_of, had = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(name_of, str(BATCH_ROWS))
    try:
        for name, stage in STAGES:
            before = common.working_tables()
            docs, path = common.stored(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
            common.drop_paths(spark, *[p for p in common.working_tables() if p not in before and p != path])
    finally:
        spark.conf.set(name_of, had)
    return docs
