"""Connected components and PageRank over tables of links."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A written table of so many rows at most goes to every task.
SMALL = 100_000


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have ended before
        pass


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through a table in the shared folder (spark.checkpoint.dir; a temporary one if unset)."""
    sc = df.sparkSession.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lexforge-graph-")
    path = f"{base.rstrip('/')}/lexforge-{uuid.uuid4().hex}"
    atexit.register(_remove, df.sparkSession, path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def free(table: DataFrame) -> None:
    """Deletes a table that cut() wrote and nothing reads any more."""
    _remove(table.sparkSession, table._written_at)


def if_small(table: DataFrame, rows: int = SMALL) -> DataFrame:
    """A table that cut() wrote, marked for broadcast if it has few rows; else joins deal both sides."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def components(links: DataFrame) -> DataFrame:
    """(a, b) to (id, root), root the least id reachable; roots themselves are left out.

    Large-star and small-star in turn until a round changes nothing.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        old, edges = edges, cut(large.join(least, "a").select(F.inline(pairs)).where("a <> b").distinct())
        free(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, score) of nodes (id) under edges (src, dst); uniform where there are no edges.

    Repeated edges count once.  Mass of nodes without successors spreads evenly.  Stops when
    the summed change falls under tolerance times the number of nodes.
    """
    nodes = cut(nodes.select("id").distinct())
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("score", F.lit(0.0))
    edges = edges.select("src", "dst").distinct()
    out = cut(edges.groupBy("src").agg(F.count("*").alias("deg")).join(edges, "src"))
    rank, old = nodes.withColumn("score", F.lit(1.0 / n)), None
    if out.isEmpty():
        return rank
    for _ in range(rounds):
        spread = out.join(rank, out.src == rank.id).groupBy("dst").agg(F.sum(F.col("score") / F.col("deg")).alias("inc"))
        kept = out.select(F.col("src").alias("id")).distinct().join(rank, "id").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("kept")).first()["kept"]
        base = (1 - damping) / n + damping * (1 - kept) / n
        new = rank.join(spread, rank.id == spread.dst, "left").select("id", F.col("score").alias("old"), (F.lit(base) + damping * F.coalesce("inc", F.lit(0.0))).alias("score"))
        new = cut(new)
        change = new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        rank = new.select("id", "score")
        if old is not None:
            free(old)
        old = new
        if change < n * tolerance:
            break
    return rank
