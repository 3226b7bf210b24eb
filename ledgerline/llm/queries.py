"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.filter_audit import audit
from ledgerline.llm.language import identify, learn
from ledgerline.llm.line_dups import line_removals
from ledgerline.llm.main_text import main_texts
from ledgerline.llm.mixing import mix
from ledgerline.llm.near_dups import near_duplicates
from ledgerline.llm.registry import ORACLES, QUERIES, query, table
from ledgerline.llm.resample import resample
from ledgerline.llm.rules_ledger import BASE, POLICIES, ablations, ledger, passes
from ledgerline.llm.sql import MIXING, TOP_VECTORS, filter_audit, near_duplicates_sql, quality_rules, resampling, rule_ablations, url_filters
from ledgerline.llm.token_counts import token_counts
from ledgerline.llm.toxicity import fit, remainder, score
from ledgerline.llm.top_vectors import top_k
from ledgerline.llm.url_filters import judge, path_of
from ledgerline.llm.word_codes import encode

__all__ = ["ORACLES", "QUERIES"]

CONTEXT_TOKENS = 512


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it exceeds the context."""
    counts = token_counts(table(spark, folder, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > CONTEXT_TOKENS)


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document, and the numbers of those that an earlier line is like."""
    found = line_removals(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", F.size("removed").alias("n_removed"), "removed")


@query("op2_language_id")
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, folder, "documents")
    fold = remainder("doc_id", 4)
    texts = learn(docs.filter(F.coalesce(fold != 2, F.lit(True))))
    held_out = F.coalesce(fold == 2, F.lit(False))
    return identify(docs, texts).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op3_quality_rules", quality_rules())
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements, failure bits and verdict of every document."""
    entries = ledger(table(spark, folder, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(BASE)).alias("base_failed"), passes(BASE + POLICIES["corpus-2"]).alias("kept"), "failures")


@query("op3_rule_ablations", rule_ablations())
def op3_rule_ablations(spark: SparkSession, folder: str) -> DataFrame:
    """What each rule of each policy rejects, and what it alone does."""
    return ablations(ledger(table(spark, folder, "documents")))


@query("op5_word_bpe")
def op5_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    encoded = encode(table(spark, folder, "documents"), decoded="decoded")
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    fold = remainder("doc_id", 5)
    labels = table(spark, folder, "labels").filter(fold != 0)
    scored = score(spark, docs, fit(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_top_vectors", TOP_VECTORS)
def op4_top_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The five best vectors for every fiftieth."""
    vectors = table(spark, folder, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


@query("op6_source_mix", MIXING)
def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix(table(spark, folder, "documents")).drop("copies")


#: Verdict, host and path of the rules.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@query("op8_url_filters", url_filters(URL_RULES))
def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page; a page is labelled by the document that its url numbers."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    number = F.regexp_extract(path_of("url"), r"/([0-9]{1,18})[^/]*/?$", 1).try_cast("long")
    labels = (
        pages.select("page_id", number.alias("doc_id"))
        .join(table(spark, folder, "labels"), "doc_id")
        .select("page_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    )
    return judge(pages, labels, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template")


@query("op7_near_duplicates", near_duplicates_sql(4))
def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 4-word shingles are near duplicates."""
    return near_duplicates(table(spark, folder, "documents"), n=4)


@query("op12_filter_audit", filter_audit())
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove of every language, in every order."""
    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_importance_resampling", resampling())
def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's texts."""
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op11_html_extraction")
def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The article of every page."""
    found = main_texts(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
