"""Two tables that should be equal, fields that should keep to their domains, and answers rewritten where they are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import folders

BUCKETS = 4096


def reconcile(expected: DataFrame, got: DataFrame, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(*key, violation, times): keys that got lacks (missing), has beside those expected (unexpected), has more often (duplicate), or whose rows
    differ (changed). A null in a key is a value like others; a key that both have as often is no duplicate.

    Rows are dealt to buckets by key, and a bucket's fingerprint is its count and the sum of its rows' hashes, which doesn't depend on their
    order. Only buckets whose fingerprints differ are compared row by row: where tables are equal each is read once and
    no row is shuffled.
    """
    columns = [c for c in expected.columns if c not in key]
    sides = {}
    for name, df in (("_e", expected), ("_g", got)):
        h = F.xxhash64(F.to_json(F.struct(*key, *columns), {"ignoreNullFields": "false"}))
        sides[name] = df.select(*key, F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("_b"), h.alias("_h"))
    # sums of 64-bit hashes, kept exact
    print_ = lambda df, n: df.groupBy("_b").agg(F.count(F.lit(1)).alias(f"{n}n"), F.sum(F.col("_h").cast("decimal(38,0)")).alias(f"{n}h"))
    both = print_(sides["_e"], "e").join(print_(sides["_g"], "g"), "_b", "full_outer")
    differ = folders.kept(both.where("not (en <=> gn) or not (eh <=> gh)").select("_b"), "buckets")  # as many rows as buckets at most
    some = lambda df: df.join(F.broadcast(differ), "_b", "left_semi")
    summed = lambda df, n: some(df).groupBy(*key).agg(F.count(F.lit(1)).alias(f"{n}n"), F.sum(F.col("_h").cast("decimal(38,0)")).alias(f"{n}h"))
    left = summed(sides["_e"], "e").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "en", "eh")
    right = summed(sides["_g"], "g")
    on = F.lit(True)
    for i, k in enumerate(key):
        on = on & F.col(f"_k{i}").eqNullSafe(F.col(k))
    met = left.join(right, on, "full_outer")
    kind = F.when(F.col("gn").isNull(), "missing").when(F.col("en").isNull(), "unexpected").when(F.col("gn") > F.col("en"), "duplicate").when(F.col("gn") < F.col("en"), "missing").when(F.col("eh") != F.col("gh"), "changed")
    keys = [F.when(F.col("en").isNull(), F.col(k)).otherwise(F.col(f"_k{i}")).alias(k) for i, k in enumerate(key)]
    return met.select(*keys, kind.alias("violation"), F.coalesce("gn", F.lit(0)).cast("long").alias("times")).where("violation is not null")


def domain_violations(rows: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """(field, value, rows): values outside their field's domain, null among them, with the number of rows that have them; one pass over rows."""
    checked = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.coalesce(~F.col(f).cast("string").isin(*allowed), F.lit(True)).alias("bad")) for f, allowed in domains.items()])
    return rows.select(F.explode(F.filter(checked, lambda c: c.bad)).alias("c")).groupBy("c.field", "c.value").agg(F.count(F.lit(1)).alias("rows"))


def upsert_stored(new: DataFrame, path: str, key: list[str], buckets: int = 64) -> None:
    """Replace the rows of the stored table at path whose keys new has, and add the rest of new; rows that share a key in new all stay.

    The table lies in a folder a bucket of keys (_bucket=..). Only folders that a key of new belongs to are read and written again; the files of others stay as they
    are. What is to be written is finished in the shared folder first and takes the old files' place when all tasks are done.
    """
    spark = new.sparkSession
    dealt = folders.kept(new.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")), "upsert")
    if folders.exists(spark, path):
        touched = F.broadcast(dealt.select("_bucket").distinct())  # as many rows as buckets at most
        old = spark.read.schema(dealt.schema).parquet(path).join(touched, "_bucket", "left_semi").join(dealt.select(*key).distinct(), key, "left_anti")
        merged = folders.kept(old.select(*dealt.columns).unionByName(dealt), "merged")
    else:
        merged = dealt
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
