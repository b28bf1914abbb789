"""What the operators share: stored intermediate tables, words, and links between nodes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplens.operators.membership import FILTER_IDS, blocks_for, id_blocks, may_be_in

# The white space that separates words: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"

# A side of at most this many rows (keys of a few dozen bytes) may be broadcast after counting it.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. A temporary one is set in local mode only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="triplens-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


# Shuffle files go as soon as the query that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _path(spark: SparkSession, path: str):
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return java, java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result that is read more than once as Parquet in the shared folder and read it back.

    Lineage ends there, so a lost executor costs a read and not a recomputation, and each reader
    takes only the columns it needs. The write's shuffle files go at once; the table goes with
    ``released`` or when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    java, files = _path(spark, path)
    files.deleteOnExit(java)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def released(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        if table is not None:
            java, files = _path(table.sparkSession, table.stored_at)
            files.delete(java, True)


# A side of arrays may be broadcast if they have at most this many elements of a few dozen bytes.
BROADCAST_ELEMENTS = 2_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS, array: str | None = None) -> DataFrame:
    """Mark a stored side for broadcast if a count shows that it is small; else the planner decides.

    ``array`` names a column whose elements count too: rows alone don't bound its bytes.
    """
    if array is None:
        return F.broadcast(df) if df.count() <= rows else df
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(array)), F.lit(0)).alias("m")).first()
    return F.broadcast(df) if found.n <= rows and found.m <= BROADCAST_ELEMENTS else df


def words(text: Column) -> Column:
    """The words of a text in order, none for null."""
    split = F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " ")
    return F.filter(split, lambda w: w != "")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); a component is its least node.

    Large-star and small-star rounds turn about until the edges stop changing, which takes about
    log(n) rounds. Each round joins edges with one minimum per node, so a node of very many edges
    is a skewed join whose other side has one row, which adaptive execution splits.
    """
    now = stored(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        least = least.select("n", F.least("n", "m").alias("m"))
        # Neighbours above a node take the least node near it.
        large = both.join(least, both.a == least.n).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # All nodes below a node, and itself, take the least of them.
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        joined = large.join(low, large.a == low.n)
        pairs = joined.select(F.inline(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        last, now = now, stored(pairs.where(F.col("a") != F.col("b")).distinct(), "stars")
        released(last)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before is not None and (state.n, state.h) == before:
            break
        before = (state.n, state.h)
    heads = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads)


Links = Callable[[DataFrame], DataFrame]


def shared(members: DataFrame) -> DataFrame:
    """The stored rows of (bucket, node) whose bucket has another row.

    Most buckets of a large table have one member. Where the others are too many to broadcast, blocks of bits tell most
    of these members, which stay where they are.
    """
    twice = stored(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "twice")
    n = twice.count()
    if BROADCAST_ROWS < n <= FILTER_IDS:
        blocks = blocks_for(n)
        members = may_be_in(members, id_blocks(twice, blocks, "bucket"), blocks, "bucket").where("_maybe").drop("_maybe")
    out = stored(members.join(F.broadcast(twice) if n <= BROADCAST_ROWS else twice, "bucket", "left_semi").select("bucket", "node"), "shared")
    released(twice)
    return out


def linked(members: DataFrame | Sequence[DataFrame], prepare: Callable[[DataFrame], tuple[Links, Links]], rounds: int = 1) -> DataFrame:
    """(node, component) for the links among nodes that share a bucket.

    ``members`` has (bucket, node). ``prepare`` gets the nodes that share a bucket with another and
    returns two functions: one keeps the rows of (a, b) that are links, the other finds links
    between the components of (bucket, node, component). In the first round every node is compared
    with the least node of each of its buckets, so a group of n copies costs n comparisons; in
    further ones with a random node of the bucket, if that is in another component. What is still
    apart in a bucket after ``rounds`` rounds is compared in full. Pairs left out are inside one component
    already, so no component is lost.

    Several tables of members, none with a bucket of another, are counted one after the other, so that only one of them is
    spread out at a time; from then on they are one.
    """
    parts = [shared(part) for part in ([members] if isinstance(members, DataFrame) else members)]
    own = reduce(DataFrame.unionByName, parts)
    is_link, rest = prepare(own.select("node").distinct())
    known, found = own.select("bucket", "node", F.col("node").alias("component")), None
    made = [*parts]
    for turn in range(rounds + 1):
        order = F.xxhash64("node", "bucket", F.lit(turn)) if turn else F.col("node")
        head = known.groupBy("bucket").agg(
            F.min_by(F.struct("node", "component"), order).alias("head"), F.min("component").alias("lo"), F.max("component").alias("hi")
        )
        head = head.where("lo < hi")
        if turn < rounds:
            pairs = known.join(head, "bucket").where("component != head.component")
            pairs = pairs.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()
            new = stored(is_link(pairs), "links")
        else:
            new = stored(rest(known.join(head.select("bucket"), "bucket", "left_semi")), "links")
        made.append(new)
        if found is not None and not new.take(1):
            continue
        links = new.select("a", "b")
        if found is not None:  # a component found before is a star
            links = links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        before, found = found, stored(components(links), "components")
        released(before)
        if turn < rounds:
            known = own.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
            known = stored(known, "known")
            made.append(known)
    released(*made)
    return found
