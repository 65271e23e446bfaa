"""A corpus pipeline over ``documents``: language ID, line dedup, SimHash near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on everything that its predecessor kept, and returns the
columns of ``documents`` (the last one adds its figures). Extra columns pass through. Empty tables give
empty tables. Rows that repeat an id are one document to the near-dedup stage and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import decontaminate, langid, line_dedup, mixing, simhash
from wordloom.llm.common import doc_crc, materialise

#: Least share of the probability that the predicted language must have.
LEAST_SCORE = 0.5
#: Most document ids that a stage broadcasts.
BROADCAST_IDS = 1_000_000


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language is not clear; every column stays as it was, whatever its name."""
    model = langid.fit(docs, F.pmod(doc_crc("doc_id"), F.lit(4)) != 2)
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("others"))
    tagged = langid.predict_rows(rows, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE))
    return tagged.select(*[F.col("text") if c == "text" else F.col("others")[c].alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that an earlier line resembles; every document stays, with n_chars of what is left of it."""
    out = line_dedup.drop_later_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each SimHash group; documents of null id stay.

    Up to ``BROADCAST_IDS`` ids that go are broadcast; beyond, the documents are shuffled to them.
    """
    groups = simhash.simhash_groups(docs)
    gone = materialise(groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "near-copies")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of ten words of a benchmark item occurs."""
    others = tuple(c for c in docs.columns if c != "doc_id")
    judged = decontaminate.contaminated_words(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=others)
    return judged.where(~F.col("contaminated")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target, copies and taken words in place of columns of these names."""
    figures = ("size", "source_size", "target", "copies", "taken")
    others = tuple(c for c in docs.columns if c not in ("doc_id", "source", *figures))
    mixed = mixing.mix_sources(docs, keep=others).where("copies > 0")
    return mixed.select(*[c for c in docs.columns if c not in figures], *figures)


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash", keep_one_of_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix),
]

#: SQL cannot express the context trees of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
