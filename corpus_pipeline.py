"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept. All but the last return the columns of documents, with n_chars that of
the text as it is then. ORACLE_SQL is None: a trained classifier and a
tokenizer are no SQL; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestrum.llm import decontaminate, near_dups, packing, quality, repeats, shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_low_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.5) go; it learns as the query op7 does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(quality.fold("doc_id", 3) != 1)
    model = quality.learn(docs, labels)
    return quality.score(docs, model).where(F.col("score") >= 0.5).select(*COLUMNS)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 similar sets of five-word shingles, the one with the least doc_id stays; of rows with equal doc_id and text, one."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    tagged = docs.withColumns({"_id": name, "_tag": F.xxhash64("text")})
    found = near_dups.find_near_duplicates(tagged, shingle=5, percent=80, carry=("_tag",))
    kept = found.where("kept").select(name.alias("_id"), "_tag").distinct()
    # The join and the dropping of repeated rows go by the same columns, so texts are dealt out once. What is kept grows with the corpus and isn't broadcast.
    return tagged.hint("merge").join(kept, ["_id", "_tag"], "left_semi").dropDuplicates(["_id", "_tag"]).select(*COLUMNS)


def cut_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur earlier (by doc_id and place) go from the text; documents that something was cut from and nothing but spaces is left of go."""
    sized = docs.select(*COLUMNS, F.octet_length("text").alias("_bytes"))
    cut = repeats.remove_repeats(sized, keep_first=True, details=False)
    return _sized(cut.where((F.trim("text") != "") | (F.octet_length("text") == F.col("_bytes")) | F.col("text").isNull()))


def decontaminate_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents (a twentieth of the words hit) go; from others the words of benchmark passages go."""
    found = decontaminate.find_contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cut=True)
    return _sized(found.where(~decontaminate.is_contaminated()))


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row for each piece, with its ids."""
    return packing.pack(docs.select("doc_id", "text"), packing.default_tokenizer())


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", decontaminate_benchmark),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else shared.written(docs, f"stage{k}"), sf_dir)
    return docs
