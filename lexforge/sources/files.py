"""Files in, tables out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """Every file below path with the suffix, whatever its case: path, length, content, sha256 and the first rule it fails.

    A file that fails is a row with an error, not a failed query.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").endswith(suffix))
    return rows.withColumns({"sha256": F.sha2("content", 256), "error": upload_error(F.col("path"), F.col("content"))})


def upload_error(path: Column, content: Column, most: int = 50 << 20) -> Column:
    return (
        F.when(~F.lower(path).endswith(".pdf"), "not a PDF name")
        .when(F.length(content) == 0, "empty")
        .when(F.length(content) > most, "too large")
        .when(F.substring(content, 1, 4) != F.lit(b"%PDF"), "not a PDF")
    )


def keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value.*) of files that hold one object each, keyed by document."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return rows.select(F.explode("m").alias("key", "v")).select("key", "v.*")


def lookup(rows: DataFrame, **keys) -> DataFrame:
    for k, v in keys.items():
        rows = rows.where(F.col(k) == F.lit(v))
    return rows.limit(1)


def replace(df: DataFrame, path: str) -> None:
    """Writes beside path, moves the old table aside and the new one in its place.

    A crash in between leaves the old table whole at ``path.old``, which restore() moves back;
    readers that keep a table open go on reading it until the next replace().
    """
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, target = fs_path(f"{path}.{uuid.uuid4().hex}"), fs_path(path)
    df.write.parquet(new.toString())
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = fs_path(f"{path}.old")
    restore(spark, path)
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, target):
        restore(spark, path)
        raise OSError(f"{new} can't be renamed to {path}")


def restore(spark: SparkSession, path: str) -> bool:
    """Moves the old table back if a replace() broke off before the new one was in place; says whether it had to."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old, target = fs_path(f"{path}.old"), fs_path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(old) and not fs.exists(target) and fs.rename(old, target))


def write_graph(entities: DataFrame, triples: DataFrame, path: str) -> None:
    """The three tables of a knowledge graph: entities, kinds of relation and relations."""
    replace(entities.distinct(), f"{path}/entities")
    replace(triples.select("predicate").distinct(), f"{path}/edges")
    replace(triples.distinct(), f"{path}/relations")


def set_lines(lines: DataFrame, settings: dict[str, str]) -> DataFrame:
    """Lines (ordinal, line) of KEY=value: given keys get their new value in place, keys not there come behind in order."""
    found, given = F.regexp_extract("line", r"^([A-Za-z_][A-Za-z0-9_]*)=", 1), F.create_map(*[F.lit(x) for kv in settings.items() for x in kv])
    value = F.try_element_at(given, F.col("key"))
    rows = lines.withColumn("key", found)
    out = rows.select("ordinal", F.when(value.isNotNull(), F.concat("key", F.lit("="), value)).otherwise(F.col("line")).alias("line"))
    new = lines.sparkSession.createDataFrame([(i, k, v) for i, (k, v) in enumerate(settings.items())], "i int, k string, v string")
    last = lines.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("last"))  # one row
    new = new.join(rows.select(F.col("key").alias("k")), "k", "left_anti").crossJoin(last)
    return out.unionByName(new.select((F.col("last") + 1 + F.col("i")).cast(lines.schema["ordinal"].dataType).alias("ordinal"), F.concat("k", F.lit("="), "v").alias("line")))


def append_log(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)
