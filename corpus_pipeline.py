"""A corpus pipeline over ``documents``, made of the operators in ``ledgerline.llm``."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.line_dups import line_removals, without_lines
from ledgerline.llm.mixing import mix, n_words
from ledgerline.llm.near_dups import near_duplicates
from ledgerline.llm.settle import let_go, settled, unused
from ledgerline.llm.ship import ship
from ledgerline.llm.toxicity import fit, score
from ledgerline.llm.word_codes import encode
from ledgerline.operators.spread import number_rows

REJECT_SCORE = 0.5
SHINGLE_WORDS = 5
BATCH_BYTES = "4m"           # of an Arrow batch: texts and packed entries make batches of rows large


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below REJECT_SCORE; a null or empty text has the score of the bias."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels)
    (found,) = unused(docs, "toxicity")
    return score(spark, docs, model, into=found).filter(F.col(found) < REJECT_SCORE).drop(found)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line is like.

    A document that loses all its lines goes. ``n_chars`` is counted anew where lines went.
    """
    (found,) = unused(docs, "kept_text")
    kept = without_lines(docs, line_removals(docs), into=found)
    changed = ~F.col(found).eqNullSafe(F.col("text"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.length(found).cast("long")).otherwise(F.col("n_chars")))
    return kept.withColumn("text", F.col(found)).select(*docs.columns)


def _by_row(docs: DataFrame, key: str, alike: str) -> DataFrame:
    """``docs`` with a number for each text of each id, and whether that is one of a repeated or null id.

    An id that one row has is its own number; so the smallest of a group is the smallest id. The texts
    of other ids are numbered beyond all ids (which stay below 2**62).
    """
    rows = docs.count()
    one, n, body = unused(docs, "one", "n", "body")
    several = settled(
        docs.groupBy("doc_id").agg(F.count("*").alias(n)).filter((F.col(n) > 1) | F.col("doc_id").isNull())
        .select(F.col("doc_id").alias(one), F.lit(True).alias(alike)), "corpus-ids", rows)
    marked = docs.join(several, F.col("doc_id").eqNullSafe(F.col(one)), "left").drop(one).withColumn(
        alike, F.coalesce(alike, F.lit(False)))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    texts = marked.filter(alike).select(F.lit(0).alias(one), F.col("doc_id").alias(n), digest.alias(body)).distinct()
    top = docs.agg(F.max("doc_id")).first()[0] or 0
    numbers = settled(number_rows(texts, [one], [F.col(n).asc_nulls_last(), F.col(body)], key, max(top, 0) + 1), "corpus-numbers")
    mine = marked.filter(alike).withColumn(body, digest).join(
        numbers.select(F.col(n).alias(one), F.col(body).alias(n), key),
        F.col("doc_id").eqNullSafe(F.col(one)) & (F.col(body) == F.col(n))).drop(one, n, body)
    return marked.filter(~F.col(alike)).withColumn(key, F.col("doc_id")).unionByName(mine)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest id.

    Decided by row: rows of one id, or of a null id, are judged each by its own text, and give way to
    documents whose id is theirs alone; of rows alike in id and text one stays.
    """
    key, alike, gone = unused(docs, "key", "alike", "gone")
    keyed = _by_row(docs, key, alike)
    found = near_duplicates(keyed, SHINGLE_WORDS, id_col=key)
    lost = found.filter(~F.col("kept")).select(F.col(key).alias(gone)).distinct()
    kept = keyed.join(lost, F.col(key) == F.col(gone), "left_anti")
    return kept.filter(~F.col(alike)).unionByName(
        kept.filter(alike).dropDuplicates([key])).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows alike in id and size are taken alike."""
    mine, of, copies, time = unused(docs, "mine", "of", "copies", "time")
    taken = (
        mix(docs).groupBy(F.struct("doc_id", "size").alias(of)).agg(F.max("copies").alias(copies))
        .filter(F.col(copies) > 0)
    )
    sized = docs.withColumn(mine, F.struct("doc_id", n_words("text").alias("size")))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    return sized.join(taken, F.col(mine) == F.col(of)).withColumn(time, times).select(*docs.columns)


def word_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, packed ``ids`` and a digest of the text that they decode to."""
    return encode(docs, decoded="decoded").select(
        "doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _stage(function):
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        let_go(spark)                       # of the stage before, which is written
        ship(spark)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return function(spark, docs, sf_dir)

    return run_stage


STAGES = [(f.__name__, _stage(f)) for f in (toxicity, line_dedup, minhash_near_dedup, source_mix, word_bpe)]

#: Trained weights and an exact similarity join over all lines are beyond SQL on whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that ``documents`` become after all stages, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
