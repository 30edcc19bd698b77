"""The opN_ queries over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import oracles


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.near_dups import near_duplicates

    return near_duplicates(_docs(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op9_minhash_near_dedup": op9_minhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import toxicity

    docs = _docs(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.apply(docs, model)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    out = mix(_docs(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES |= {"op10_toxicity": op10_toxicity, "op3_mixing": op3_mixing}


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fingerprints import fingerprint_documents
    from tessera.plans.scratch import Scratch

    return fingerprint_documents(_docs(spark, sf_dir).select("doc_id", "text"), Scratch(spark))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.token_counts import count_tokens

    return count_tokens(_docs(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.url_filter import judge

    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


QUERIES |= {"op2_fingerprints": op2_fingerprints, "op4_token_counts": op4_token_counts, "op6_url_filter": op6_url_filter}


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.line_dedup import dedup_lines

    out = dedup_lines(_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.length("__kept").cast("long").alias("kept_chars"),
        F.sha2("__kept", 256).alias("kept_sha256"),
    )


QUERIES |= {"op1_line_dedup": op1_line_dedup}


def op8_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.piece_sampling import encode_documents

    return encode_documents(_docs(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


QUERIES |= {"op8_sentencepiece_sampling": op8_sentencepiece_sampling}


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.secrets import scan

    return scan(_docs(spark, sf_dir).select("doc_id", "text")).withColumn("value", F.sha2("value", 256)).withColumnRenamed("value", "value_sha256")


def op5_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images rendered from all embeddings; queries are edited copies of every image whose id is divisible by 100."""
    from pyspark.sql import functions as F

    from tessera.llm.media import find_copies, rendered

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    vectors = vectors.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return find_copies(rendered(vectors.where(F.col("vec_id") % 100 == 0), edited=True), rendered(vectors))


QUERIES |= {"op7_secret_scan": op7_secret_scan, "op5_media_copies": op5_media_copies}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES |= {"pipeline": pipeline}


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.turn_repair import damage, repair

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair(damage(turns), turns)


QUERIES |= {"op13_conversation_repair": op13_conversation_repair}
ORACLE_SQL["op13_conversation_repair"] = oracles.TURN_REPAIR


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.importance import resample

    return resample(_docs(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


QUERIES |= {"op11_importance_resampling": op11_importance_resampling}
ORACLE_SQL["op11_importance_resampling"] = oracles.RESAMPLING


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 100; there is no SQL, as a recall of 0.9 or more is not all."""
    from pyspark.sql import functions as F

    from tessera.llm.nearest import search, usable
    from tessera.plans.scratch import Scratch

    scratch = Scratch(spark)
    rows = scratch.save(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "usable")
    return search(rows.where(F.col("vec_id") % 100 == 0), rows, scratch)


QUERIES |= {"op12_nearest_neighbours": op12_nearest_neighbours}
