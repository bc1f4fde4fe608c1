"""Canonical exact fingerprints of documents, by DataFrame functions alone.

A text is folded (compatibility normalisation, full case folding, normalisation
again, runs of white space to one space, none at the ends) and hashed to 128 bits
by two seeds of xxhash. Rows whose hashes agree are compared byte by byte: should
different folded texts ever share a hash, their fingerprints get their own SHA-256
as well, so fingerprints are equal exactly if the folded texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.shared import new_path, table, written

BROADCAST_ROWS = 500_000
SPAN = 10  # ids whose upper bits agree share a window: at most 1024 different ones
TOP_ROWS = 4096


def folded(text: Column) -> Column:
    """The canonical form; null texts count as empty."""
    def compose(x: Column) -> Column:
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    fold = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(compose(fold), r"[\s\p{Z}\x{85}]+", " "))


def wide(canonical: Column, bits: int = 128) -> Column:
    """The hash as hex digits. bits: how many of the 128 count, a multiple of 4."""
    words = [F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(canonical), F.xxhash64(F.lit("wide"), canonical))]
    return F.substring(F.concat(*words), 1, bits // 4)


def _limited(df: DataFrame) -> DataFrame:
    """df to be broadcast if it is small enough; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shared_hashes(*parts: DataFrame) -> DataFrame | None:
    """(wide) of hashes that different canonical texts share; None if there are none. parts: (wide, canonical)."""
    hashes = parts[0].select("wide")
    for p in parts[1:]:
        hashes = hashes.union(p.select("wide"))
    twice = written(hashes.groupBy("wide").count().where("count > 1").select("wide"), "hashes")
    some = _limited(twice)
    rows = None
    for p in parts:
        own = p.join(some, "wide", "left_semi")
        rows = own if rows is None else rows.union(own)
    clash = written(rows.groupBy("wide", "canonical").agg(F.lit(1).alias("one")).groupBy("wide").count().where("count > 1").select("wide"), "clash")
    return None if clash.isEmpty() else clash


def _final(df: DataFrame, clash: DataFrame | None, names: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds fingerprints: name -> (column of the hash, column of the canonical SHA-256)."""
    for name, (h, sha) in names.items():
        if clash is None:
            df = df.withColumn(name, F.col(h))
        else:
            hit = _limited(clash).select(F.col("wide").alias(h), F.lit(True).alias("_hit"))
            df = df.join(hit, h, "left").withColumn(name, F.when(F.col("_hit"), F.concat(h, F.lit("-"), sha)).otherwise(F.col(h))).drop("_hit")
    return df


def fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint", bits: int = 128) -> DataFrame:
    """All rows and columns of docs, and their fingerprint in column `name` (replaced if it is there).

    Null and empty texts and texts of white space alone have the same fingerprint,
    equal rows equal ones. An empty table gives an empty table.
    """
    docs = docs.drop(name)
    made = docs.select("*", folded(F.col(text_col)).alias("_canonical")).withColumns({"_wide": wide(F.col("_canonical"), bits), "_sha": F.sha2("_canonical", 256)})
    clash = shared_hashes(made.select(F.col("_wide").alias("wide"), F.col("_canonical").alias("canonical")))
    return _final(made, clash, {name: ("_wide", "_sha")}).drop("_wide", "_sha", "_canonical")


def following(keys: DataFrame, key: str) -> DataFrame:
    """(key, next) of distinct integers: the next larger one, and after the last the first.

    Keys are dealt out by their upper bits; the first of each group goes on to the
    next round, until few are left. No task gets more than 2^10 or TOP_ROWS keys.
    """
    levels = [written(keys, "keys")]
    while levels[-1].count() > TOP_ROWS:
        levels.append(written(levels[-1].groupBy(F.shiftright(key, SPAN * len(levels)).alias("g")).agg(F.min(key).alias(key)).select(key), "keys"))
    everything = Window.orderBy(key)
    out = levels.pop().select(key, F.coalesce(F.lead(key).over(everything), F.first(key).over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    while levels:
        group = F.shiftright(key, SPAN * len(levels))
        own = Window.partitionBy("g").orderBy(key)
        jump = out.select(F.shiftright(key, SPAN * len(levels)).alias("g"), F.col("next").alias("jump"))
        rows = levels.pop().select(key, group.alias("g")).withColumn("lead", F.lead(key).over(own))
        out = rows.join(jump, "g").select(key, F.coalesce("lead", "jump").alias("next"))
    return out


def with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text keeps the first half of the text and goes on with the start of
    the next document's text, by ascending id, after the last the first. Rows with
    the same id follow each other by their texts. Rows without an id have no next
    document: their edited text is the first half, near_next is null. Null texts
    count as empty; texts of any length are taken whole. Other columns are not looked at.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("canonical", folded(F.col("text"))).withColumns({"w": wide(F.col("canonical"), bits), "sha": F.sha2("canonical", 256)})
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL")
    firsts = ids.groupBy(F.shiftright("id", SPAN).alias("b")).agg(F.min("id").alias("id")).select("id")
    after = written(following(firsts, "id"), "following").select(F.shiftright("id", SPAN).alias("bucket"), F.col("next").alias("id"))

    own = rows.where("id IS NOT NULL").select("id", "text", "w", "sha", F.shiftright("id", SPAN).alias("bucket"), F.lit(0).alias("last"))
    ends = rows.where("id IS NOT NULL").join(after, "id").select("id", "text", "w", "sha", "bucket", F.lit(1).alias("last"))
    order = Window.partitionBy("bucket").orderBy("last", "id", "text")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    told = (
        own.unionByName(ends)
        .select("*", F.lead("text").over(order).alias("next"), F.lead("w").over(order).alias("next_w"), F.lead("sha").over(order).alias("next_sha"))
        .where("last = 0")
        .withColumn("next", F.coalesce("next", "text"))
        .select(
            "id", F.lit(False).alias("loose"), n.cast("long").alias("n_chars"), "w", "sha", F.coalesce("next_w", "w").alias("next_w"), F.coalesce("next_sha", "sha").alias("next_sha"),
            F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)).alias("edited"),
        )
    )
    half_of = F.substring("text", F.lit(1), n - half)
    loose = rows.where("id IS NULL").select("id", F.lit(True).alias("loose"), n.cast("long").alias("n_chars"), "w", "sha", F.col("w").alias("next_w"), F.col("sha").alias("next_sha"), half_of.alias("edited"))
    paired = (
        told.unionByName(loose)
        .withColumn("canonical", folded(F.col("edited")))
        .select("*", wide(F.col("canonical"), bits).alias("edited_w"), F.sha2("canonical", 256).alias("edited_csha"), F.sha2("edited", 256).alias("edited_sha256"))
        .drop("edited")
    )
    path = new_path(spark, "edited")
    paired.write.option("compression", "zstd").parquet(path)
    paired = spark.read.schema(paired.schema).parquet(path)

    clash = shared_hashes(rows.select(F.col("w").alias("wide"), "canonical"), paired.select(F.col("edited_w").alias("wide"), "canonical"))
    out = _final(paired.drop("canonical"), clash, {"fingerprint": ("w", "sha"), "edited_fingerprint": ("edited_w", "edited_csha"), "next_fingerprint": ("next_w", "next_sha")})
    return out.select(
        "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double").alias("near_edited"),
        F.when(~F.col("loose"), (F.col("fingerprint") == F.col("next_fingerprint")).cast("double")).alias("near_next"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    return with_edit(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
