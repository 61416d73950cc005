"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

1. A text is cut where its own content says so (a regular expression), into
   chunks of ``MIN_CHARS`` to ``MAX_CHARS`` characters.
2. Distinct chunks meet once in a shuffle, deduplicated in each task before. They
   prove that each 64-bit chunk hash stands for one content; hashes that stand for
   more (about one in 2^64 pairs) get an ordinal per content. Hash and ordinal are a
   verified identifier.
3. A text's recipe is its ordered list of identifiers. Texts are equal exactly if
   their recipes are, so the grouping moves eight bytes per chunk and a long text
   never travels whole.

A group of copies holding a third of all rows costs one row a task before the
shuffle (partial aggregation); the join that returns group facts to the rows has one
row a group on one side, so adaptive execution splits the other side's hot key.

Defined cases: null text counts as empty; the greatest ``doc_id`` stays; if several
rows share text and ``doc_id``, all of them name that id and exactly one has ``kept``
(they are the same row to every column used here, extra columns are not compared);
a null ``doc_id`` is smaller than any other. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marts.operators.merge import free_name
from marts.session import new_folder

MIN_CHARS = 512
MAX_CHARS = 4096

#: A chunk ends behind a blank or line end if one of these letters follows.
_CUT = r"[\s](?=[a-hA-HÀ-ÿ])"


def chunks(text: Column, low: int = MIN_CHARS, high: int = MAX_CHARS) -> Column:
    """The text in chunks whose concatenation is the text; none for an empty text."""
    pattern = rf"(?s).{{{low - 1},{high - 1}}}?{_CUT}|.{{{high}}}|.+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _distinct_chunks(texts: DataFrame, chunk_hash) -> DataFrame:
    return (
        texts.select(F.explode(chunks(F.col("text"))).alias("chunk"))
        .select(chunk_hash("chunk").alias("h"), "chunk")
        .distinct()
    )


def clashing_hashes(texts: DataFrame, chunk_hash=F.xxhash64) -> DataFrame:
    """``h`` of chunks that share their hash with another content; chunks move once."""
    return _distinct_chunks(texts, chunk_hash).groupBy("h").count().where("count > 1").select("h")


def clashing_chunks(texts: DataFrame, hashes: DataFrame, chunk_hash=F.xxhash64) -> DataFrame:
    """``(h, chunk, ordinal)`` of the contents behind the given hashes."""
    order = Window.partitionBy("h").orderBy("chunk")
    return (
        _distinct_chunks(texts, chunk_hash)
        .join(hashes, "h", "left_semi")
        .withColumn("ordinal", F.row_number().over(order))
    )


def recipes(
    spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text", chunk_hash=F.xxhash64
) -> DataFrame:
    """``(doc_id, text_sha256, recipe)`` for every row."""
    rows = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    # Written, so that the test below and the repair read it instead of chunking
    # again; it has a row only where two contents share a hash.
    folder = new_folder(spark, "chunk-clashes")
    clashing_hashes(rows, chunk_hash).write.parquet(folder)
    hashes = spark.read.parquet(folder)
    plain = rows.select(
        "doc_id",
        F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"),
        F.transform(chunks(F.col("text")), lambda c: chunk_hash(c)).alias("recipe"),
    )
    if hashes.isEmpty():
        return plain
    clashes = clashing_chunks(rows, hashes, chunk_hash)
    # Exact repair of the texts that hold such a chunk: their identifiers carry the
    # ordinal as a second entry, (h, ordinal), marked by its position.
    parts = rows.select(
        F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"),
        F.posexplode(chunks(F.col("text"))).alias("pos", "chunk"),
    ).withColumn("h", chunk_hash("chunk"))
    marks = (
        parts.join(clashes, ["h", "chunk"])
        .select("text_sha256", "pos", "ordinal")
        .distinct()
        .groupBy("text_sha256")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "ordinal"))).alias("marks"))
    )
    flat = F.flatten(
        F.transform("marks", lambda m: F.array(m["pos"].cast("long"), m["ordinal"].cast("long")))
    )
    return plain.join(marks, "text_sha256", "left").select(
        "doc_id",
        "text_sha256",
        F.when(F.col("marks").isNull(), F.col("recipe"))
        .otherwise(F.concat(F.col("recipe"), flat))
        .alias("recipe"),
    )


def exact_groups(
    spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``."""
    # Rows equal in id and text are told apart only by their number in the count.
    rows = recipes(spark, docs, key=key, text=text)
    same = rows.groupBy("recipe", "doc_id").agg(
        F.count(F.lit(1)).alias("copies"), F.first("text_sha256").alias("text_sha256")
    )
    groups = same.groupBy("recipe").agg(
        F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")
    )
    joined = same.alias("s").join(groups.alias("g"), F.col("s.recipe") == F.col("g.recipe"))
    return joined.select(
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
        "doc_id",
        "keep_id",
        "group_size",
        "text_sha256",
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(
    spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` without the rows of which a copy with a greater id stays.

    Rows that share id and text are one document; one of them, any, stays.
    """
    one, two = free_name("_id", docs.columns), free_name("_sha", docs.columns)
    groups = exact_groups(spark, docs, key=key, text=text)
    kept = groups.where("kept").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias(one),
        F.col("text_sha256").alias(two),
    )
    named = docs.select(
        "*",
        F.coalesce(F.col(key).cast("string"), F.lit("null")).alias(one),
        F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256).alias(two),
    )
    # Both steps use the join's shuffle and order: the text moves once.
    return (
        named.join(kept, [one, two], "left_semi").dropDuplicates([one, two]).select(*docs.columns)
    )
