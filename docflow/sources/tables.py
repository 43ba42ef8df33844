"""Engine inputs made from the stored tables: lines of documents, their mock translation, and pairs of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse, has_text
from ..functions.words import SEPARATOR
from .shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table, over all cores even if it is one small file."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, text): the lines of documents that are not blank; a document is a book, a line a fragment."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return docs.where(has_text(F.col("text"))).select("doc_id", F.col("pos").cast("long"), "text")


def mock_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, h, original, translated): lines with the faults that a model makes, by arithmetic on the key.

    ``translated`` is null where the model returned no line (h % 17 = 0).
    """
    x = lines(spark, sf_dir).withColumn("h", F.col("doc_id") * 31 + F.col("pos"))
    x = x.withColumn("o", F.when(F.col("h") % 5 == 0, F.replace("text", F.lit(", "), F.lit(f", {SEPARATOR}"))).otherwise(F.col("text")))
    x = x.withColumn("original", F.when(F.col("h") % 4 == 0, F.concat(F.lit("“"), "o", F.lit("”"))).otherwise(F.col("o")))
    x = x.withColumn("t", F.when(F.col("h") % 7 == 0, F.col("original")).otherwise(F.translate("original", "etn", "axk")))
    x = x.withColumn("t", F.when(F.col("h") % 11 == 0, F.replace("t", F.lit(SEPARATOR), F.lit(""))).otherwise(F.col("t")))
    x = x.withColumn("t", F.when(F.col("h") % 13 == 0, F.translate("t", "“”", "")).otherwise(F.translate("t", "“”", "«»")))
    return x.select("doc_id", "pos", "h", "original", F.when(F.col("h") % 17 != 0, F.col("t")).alias("translated"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, original, translated): user turns with the assistant turn that follows; pair_id = conv_id * 1000 + turn."""
    c = table(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("original"))
    answer = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("translated"))
    return user.join(answer, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "original", "translated")


def escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, html): documents as pages, line by line a paragraph, a heading of two parts, loose text and a blank paragraph in turn."""
    x = lines(spark, sf_dir).select("doc_id", "pos", F.pmod("pos", F.lit(4)).alias("kind"), collapse(F.col("text")).alias("t"))
    block = (
        F.when(F.col("kind") == 0, F.concat(F.lit("<p>"), escaped(F.col("t")), F.lit("</p>")))
        .when(F.col("kind") == 1, F.concat(F.lit("<h2>n"), F.col("pos").cast("string"), F.lit("<b>"), escaped(F.col("t")), F.lit("</b></h2>")))
        .when(F.col("kind") == 2, F.concat(F.lit("<div>"), escaped(F.col("t")), F.lit("</div>")))
        .otherwise("<p> </p>")
    )
    rows = x.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda r: r["b"]), "").alias("body"))
    head = '<html><head><link rel="stylesheet" href="s.css"></head><body>'
    return rows.select(F.col("doc_id").alias("page_id"), F.concat(F.lit(head), "body", F.lit("</body></html>")).alias("html"))
