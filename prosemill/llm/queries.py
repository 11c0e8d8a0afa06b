"""One query for each operator: its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, htmltext, langid, licenses, middle, minhash, mixing, pii, sharding, simhash, toxicity, variants
from .common import stage, table


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replaced(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))


def op2_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classes = minhash.near_classes(docs)
    return classes.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "class_id", "n_texts")


def op3_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mix(stage(mixing.units_of(table(spark, sf_dir, "documents"))))
    rows = made.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = langid.fit(docs.where(fold != 0))
    out = langid.predict(docs, model, also={"held_out": F.coalesce(fold == 0, F.lit(False))})
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("langs").alias("n_langs"))


def op5_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    out = toxicity.predict(docs, model, also={"held_out": held})
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(licenses.as_files(table(spark, sf_dir, "documents")), also=("doc_id",))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "license", F.array_join("licenses", ",").alias("licenses"), F.round("score", 6).alias("score"), "origin", "from_dir")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digest(middle.examples(table(spark, sf_dir, "documents")))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexed("fp").alias("fingerprint"), "component_id")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py, which stands at the top of the repository beside the entry points."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_surrogates, op2_probminhash, op3_pivotal_mix, op4_language_mixture, op5_kmeans_tree, op6_main_text, op7_decontaminate, op8_minimax_shards, op9_toxicity, op10_licenses, op11_fill_in_middle, op12_simhash, op13_spelling_variants, pipeline)}
ORACLES = {"op11_fill_in_middle": middle.SQL, "op13_spelling_variants": variants.SQL}
