"""What the operators of this subpackage share: scratch tables, files, components.

Everything that outlives one task goes to the folder that the session names in
``spark.checkpoint.dir`` (see :mod:`wearline.scratch`).  Executors and driver
see that folder alike, so a lost executor costs a re-run of its tasks and nothing
else.  An operator drops its tables as soon as nothing reads them; what its
result reads is one narrow table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import delete, dropped, scratch, shared_dir, stored

__all__ = ["WORD", "ascii_lower", "connected_components", "delete", "dropped", "file_system", "scratch", "shared_dir", "stored", "write_atomically"]

#: Words are runs of anything but the six ASCII blanks (fixed by the contract).
WORD = r"[^\x20\x09-\x0D]+"


def file_system(uri: str):
    """pyarrow file system and path of a URI; works on executors and on the driver."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_atomically(uri: str, fill) -> None:
    """``fill(file)`` writes to a name of its own, which then takes the place of ``uri``.

    A re-run or speculative copy of a task writes the same bytes, so whichever
    comes last may win.
    """
    system, path = file_system(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        fill(out)
    system.move(part, path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _all_stars(edges: DataFrame) -> bool:
    """Whether each u has one edge and no v is a u of another."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node with an edge to another; root: the least node.

    Alternating large-star and small-star rounds, until all edges are stars.  Each round is two partial
    aggregations, each joined back to the edges; both keep the number of edges
    linear, and a hot node is split by adaptive skew joins.  A round's edges are
    written to the shared folder, so lineage stays one round long.
    Null ends and self-loops are ignored; no edges give no rows.  The result
    reads one stored table, which :func:`dropped` takes away.
    """
    x, y = F.col(a), F.col(b)
    e, rounds = stored(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges"), 0
    while not _all_stars(e):
        if (rounds := rounds + 1) > max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(e)
        e = new
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out._wearline_path = e._wearline_path
    return out
