from pyspark.sql import functions as F

from wordloom.llm import mixing


def test_texts_of_a_mix_are_read_twice(spark):
    """Once for the sizes and once where they are kept; what finds the cuts reads short rows."""
    n, read = 200, spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    docs = spark.range(n, numPartitions=2).select(F.col("id").alias("doc_id"), F.concat(F.lit("a"), F.repeat(F.lit(" b"), (F.col("id") % 40).cast("int"))).alias("raw"), F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").alias("source"))
    docs = docs.select("doc_id", seen.asNondeterministic()("raw").alias("text"), "source")
    got = mixing.mix_sources(docs, keep=("text",)).collect()
    assert sorted(r.doc_id for r in got) == list(range(n)) and all(r.size == 1 + r.doc_id % 40 == len(r.text.split()) for r in got)
    assert read.value == 2 * n
