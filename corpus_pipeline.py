"""A corpus from raw documents to packed sequences: each stage calls one operator of ``assetlake.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.llm.best_fit import cut_pieces, pack
from assetlake.llm.columns import fresh, words
from assetlake.llm.jaccard_join import keep_one
from assetlake.llm.mixing import ends, take
from assetlake.llm.quality_rules import keep_good
from assetlake.llm.queries import CAPACITY, EPOCHS, KEY, SEED, WEIGHTS, vocabulary, with_domain
from assetlake.llm.surrogates import pseudonymize
from assetlake.session import configure, materialize, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie beyond a fence of their language and source go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays."""
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced; ``n_chars``, where there is such a column, follows."""
    counter = fresh(docs.columns, "_replaced")
    out = pseudonymize(docs, KEY, counter)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new = F.when(F.col(counter) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind)
        out = out.withColumn("n_chars", new)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as there are, shared out by the target weights; a document may come twice, and those beyond
    their leaf's budget go. The document at which a budget ends stays whole."""
    domain = fresh(docs.columns, "_domain")
    size = fresh([*docs.columns, domain], "_n_words")
    levels = (domain, "lang", "source")
    sized = with_domain(docs, domain).withColumn(size, F.size(words(F.col("text"))).cast("long"))
    sizes = materialize(
        sized.select(F.col("doc_id").cast("long").alias("doc_id"), *levels, F.col(size).alias("n_tokens")), "sizes"
    )
    named = [(domain if level == "domain" else level, name, weight) for level, name, weight in WEIGHTS]
    weights = spark.createDataFrame(named, "level string, name string, weight long")
    ended = ends(sizes, levels, weights, F.sum("tokens"), EPOCHS, SEED)
    epoch, taken = fresh(sized.columns, "_epoch"), fresh(sized.columns, "_taken")
    return take(sized, levels, ended, SEED, size, epoch, taken).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized texts with their places in sequences."""
    pieces = cut_pieces(docs, vocabulary("word_bpe_49k.json"), 0, CAPACITY)
    with small_batches(spark):
        pieces = materialize(pieces, "pieces")
    return pack(pieces, CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix),
    ("packing", packing),
]

#: Surrogates are made in Python, so no SQL gives these rows; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again, on the whole ``documents`` table."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
