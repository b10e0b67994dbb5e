"""Helpers that the corpus operators share: tables, shared storage, samples, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(*names: str) -> tuple[str, ...]:
    """Column names that no input has, for what an operator adds and drops again."""
    mark = uuid.uuid4().hex
    return tuple(f"_{n}_{mark}" for n in names)


def quoted(columns: list[str]) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoints-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Cuts the lineage by a table in the shared folder. ``replaces``, what an
    earlier cut returned and nothing reads any more, is deleted then, so that
    rounds do not fill the folder."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    if replaces is not None:
        discard(replaces)
    return spark.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Deletes the files of a table that :func:`cut` returned."""
    spark = written.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("cut-"):
            where = jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(conf).delete(where, True)


#: Characters of a text beyond which a fit leaves it out of its sample.
FIT_CHARS = 200_000


def sampled(rows: DataFrame, n: int, key: str, text: str, group: str | None = None) -> list[Row]:
    """A bounded, reproducible sample for a fit: of each ``group`` about ``n`` rows
    of at most ``FIT_CHARS`` characters, chosen by a hash threshold of ``key``, at
    most 2 n, in the order of that hash."""
    part = F.lit("") if group is None else F.col(group).cast("string")
    usable = rows.where(F.coalesce(F.length(text) <= FIT_CHARS, F.lit(True))).withColumn("_part", part)
    counts = {r["_part"]: r["n"] for r in usable.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for g, c in counts.items() for x in (F.lit(g), F.lit(min(1.0, n / c)))])
    drawn = usable.withColumn("_draw", F.pmod(F.xxhash64(key), F.lit(1_000_003)) / 1_000_003).where(F.col("_draw") < share[F.col("_part")])
    order = Window.partitionBy("_part").orderBy("_draw", key, F.xxhash64(text))
    few = drawn.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= 2 * n)
    return few.orderBy("_part", "_place").select(*rows.columns).collect()


def _edge_state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph with long node ids.

    ``edges``: columns a, b in any order; loops and repeats are allowed.
    Returns (node, component) for every node of an edge, ``component`` being
    the smallest node reachable. Alternating large-star and small-star rounds:
    each is a minimum per node (combined before the shuffle) and one equi-join
    whose skewed side adaptive execution can split; nothing is collected.
    """
    def star(both: DataFrame, own: bool) -> DataFrame:
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m")
        )
        out = both.join(low, "a")
        if own:  # small star: both ends below a move to the minimum
            pairs = out.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            return pairs.where("a <> b").distinct()
        return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    now = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )
    before = _edge_state(now)
    for _ in range(max_rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both, own=False)
        # every edge now points from the larger to the smaller end
        now = cut(star(large, own=True), replaces=now)
        after = _edge_state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
