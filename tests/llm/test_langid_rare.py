"""A language with one row is learned beside many large ones."""

from pyspark.sql import functions as F

from tidepanel.llm import ecoc_langid


def test_rare_language_is_learned(spark):
    ids = spark.range(7500)
    fold = F.crc32(F.col("id").cast("string")) % ecoc_langid.FOLDS != ecoc_langid.HELD_OUT
    last = ids.where(fold).orderBy(F.xxhash64("id").desc()).first()[0]
    lang = F.when(F.col("id") == last, "rare").otherwise(F.concat(F.lit("l"), (F.col("id") % 8).cast("string")))
    docs = ids.select(F.col("id").alias("doc_id"), F.concat_ws(" ", lang, lang, (F.col("id") % 90).cast("string")).alias("text"), lang.alias("lang"))
    assert "rare" in list(ecoc_langid.train(docs).languages)
