"""The queries ``opN_<name>`` of this package, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.llm import align, bpe, chat, decontaminate, language, lattice, licenses, pieces, quality, repair, simhash, suffixes, urls

#: Folder of the public tokenizer files; found through their package where this is None.
TOKENIZER_DIR: str | None = None


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    if TOKENIZER_DIR:
        return f"{TOKENIZER_DIR}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in every document, with the Dice coefficient of the best unit."""
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item, the similarity and the first word of the best window."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "similarity", "start_word")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the rows outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select(F.col("id").alias("doc_id"), language.held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of documents with smaller ids."""
    found = suffixes.dedup(table(spark, sf_dir, "documents"), depth=50)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the BPE ids and of the decoded text of every document."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learned from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    good = F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    return found.select(F.col("id").alias("doc_id"), quality.held_out(F.col("id")).alias("held_out"), "score", good)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations, rendered."""
    return chat.render(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    found = lattice.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of the URL of every page."""
    return urls.judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens of two tokenizers that cover the same bytes of every document, and how common their links are."""
    return align.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults put into every conversation, the cheapest edits that mend its structure, and the mended text's digest."""
    return repair.repair_damaged(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


def op13_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the SentencePiece ids and of the decoded text of every document."""
    return pieces.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_benchmark_decontamination, op3_language_id, op4_suffix_array_dedup, op5_bpe_codec, op6_quality_classifier,
        op7_chat_formatting, op8_embedding_near_dedup, op9_simhash_near_dedup, op10_url_filter,
        op11_cross_tokenizer_alignment, op12_conversation_repair, op13_sentencepiece_codec,
    )
}
#: The others are held against brute force, the tokenizer library or held-out rows in ``tests/llm``.
ORACLES: dict[str, str] = {"op1_license_scan": licenses.oracle(), "op2_benchmark_decontamination": decontaminate.SQL, "op7_chat_formatting": chat.SQL, "op8_embedding_near_dedup": lattice.SQL}
