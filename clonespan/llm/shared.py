"""What the operators of this subpackage share: written tables, clash-free columns, connected components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespan.session import ensure_checkpoint_dir

#: Fixed pattern: what separates words in the contracts of this subpackage.
SPACES = r"[\x20\x09-\x0D]+"

#: Edges that a task of `components` takes at once.
FOREST_EDGES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of 1,000 rows, unless the session names a size of its own: a batch is held more than once."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"


#: Paths written by the innermost `own_tables` that is open in this thread.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def saved(df: DataFrame, **options: str) -> DataFrame:
    """`df` written to the shared folder (with the writer's `options`) and read back: lost executors cost no recomputation, and Spark knows its size."""
    path = scratch(df.sparkSession)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def own_tables(spark: SparkSession):
    """Tables that are `saved` in this block are removed at its end, but for those written by the function that it gives."""
    outer, mine, kept = _WRITTEN.get(), [], []
    token = _WRITTEN.set(mine)

    def keep(df: DataFrame) -> DataFrame:
        out = saved(df)
        kept.append(mine.pop())
        return out

    try:
        yield keep
    finally:
        _WRITTEN.reset(token)
        if outer is not None:
            outer += kept
        jvm = spark.sparkContext._jvm
        for name in mine:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` less its own columns of these names (in any case): the operator's result columns win."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array: what stands between runs of ASCII white space."""
    return F.array_remove(F.split(text, SPACES), "")


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node) of the components of an edge list in memory, without the smallest nodes themselves."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for end in (u, v):
            np.minimum.at(new, label[end], low)
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    inner = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[inner], nodes[label[inner]]


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list of bigint or string nodes: (node, component), component = smallest node.

    Every round first deals the edges that are left over tasks of FOREST_EDGES each, where they are replaced by a star per
    component that they form there (one task: done); then it hooks and jumps:
    a node goes to the smallest end that any task found for it, the other ends become edges to that one, and nodes move on to
    where their new end has gone.  Nodes with very many neighbours are only aggregated with map-side combine, or stand on the
    side of a join that Spark can split.  Each round is written to the shared folder.  Nodes without edges do not occur; null
    ends are dropped.  Raises if `rounds` do not suffice.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("u <> v")
    kind = e.schema["u"].dataType.simpleString()

    def forest(batches):
        parts = [x for x in batches if x.num_rows]
        if parts:
            u, v = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in parts]) for c in ("u", "v"))
            u, v = local_forest(u, v)
            for i in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000]), pa.array(v[i : i + 100_000])], names=["u", "v"])

    for _ in range(rounds):
        e = saved(e)
        parts = max(1, -(-e.count() // FOREST_EDGES))
        e = saved(e.coalesce(parts).mapInArrow(forest, f"u {kind}, v {kind}"))
        if parts == 1:  # one task has seen all edges that are left
            up = e.select("u", F.col("v").alias("p"))
        else:
            up = saved(e.groupBy("u").agg(F.min("v").alias("p"), F.max("v").alias("q")))
        tops = up.select(F.col("p").alias("x")).distinct()
        # done if every node has one end, and no end has one itself
        if parts == 1 or up.filter("p <> q").isEmpty() and up.join(tops, up["u"] == tops["x"], "left_semi").isEmpty():
            return up.select(F.col("u").alias("node"), F.col("p").alias("component")).unionByName(tops.select(F.col("x").alias("node"), F.col("x").alias("component")))
        further = up.select(F.col("u").alias("x"), F.col("p").alias("pp"))
        jumped = up.join(further, up["p"] == further["x"], "left").select("u", F.coalesce("pp", "p").alias("v"))
        several = up.filter("p <> q").select(F.col("u").alias("x"), "p")
        rest = e.join(several, e["u"] == several["x"]).filter("v <> p").select(F.col("v").alias("u"), F.col("p").alias("v"))
        # an edge to the jumped-over end stays implied: that end's own edge is among the rows
        e = jumped.unionByName(rest)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
