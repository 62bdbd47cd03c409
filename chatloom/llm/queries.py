"""The registered queries of this package: thin digests of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatloom.llm.sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]
QUERIES: dict = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_secret_scan(spark, sf_dir):
    from chatloom.llm.secrets import secret_digest

    return secret_digest(_table(spark, sf_dir, "documents"))


@_query
def op2_quality_rules(spark, sf_dir):
    from chatloom.llm.quality import judge

    d = judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return d.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@_query
def op3_license_scan(spark, sf_dir):
    from chatloom.llm.licenses import license_digest

    return license_digest(_table(spark, sf_dir, "documents"))


@_query
def op5_mixing(spark, sf_dir):
    from chatloom.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


@_query
def op6_jaccard_join(spark, sf_dir):
    from chatloom.llm.jaccard import similar_groups

    return similar_groups(_table(spark, sf_dir, "documents"))


@_query
def op7_substring_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    from chatloom.llm.superkmer import remove_repeats

    d = remove_repeats(_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op4_toxicity(spark, sf_dir):
    from chatloom.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op9_html_extraction(spark, sf_dir):
    from pyspark.sql import functions as F

    from chatloom.llm.html import extract

    d = extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return d.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op8_benchmark_decontamination(spark, sf_dir):
    from chatloom.llm.decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op10_quality_classifier(spark, sf_dir):
    from chatloom.llm.cotrain import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op11_centroid_clustering(spark, sf_dir):
    from chatloom.llm.centroids import centroid_digest, cluster_vectors

    d = cluster_vectors(_table(spark, sf_dir, "embeddings"), carry=["vec_id"])
    return d.select("row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroid_digest("centroid").alias("centroid_sha256"))


@_query
def op12_exact_topk(spark, sf_dir):
    from chatloom.llm.topk import top_products

    return top_products(_table(spark, sf_dir, "embeddings"), rowwise=True)


@_query
def op13_importance_resampling(spark, sf_dir):
    from chatloom.llm.resample import importance_sample

    d = importance_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return d.select("row.doc_id", "n_features", "weight", "score", "rank")
