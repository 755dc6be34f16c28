"""Links inside groups of any size: each group's members are compared in tasks of bounded weight, and no pair is lost.

A group of up to `most` weight is one part. A larger one is cut into chunks by hash; a few of its members, its hubs, go to every
chunk, so that what is alike in different chunks is joined through them. Then members outside the group's largest component visit
all its other chunks: pairs inside that component need no comparing. Work grows with the square of a group only as far as its
members are not joined to each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, components, release

OWN, VISITOR = 0, 1
#: Members that are compared with all others of a part first; links that a task holds back before it passes them on.
HUBS, STRIP = 4, 1 << 14

#: For a part's table: gives the test of member i against members j (ascending), which says which of them are linked to it.
Tester = Callable[[pa.Table], Callable[[int, np.ndarray], np.ndarray]]


class Part:
    """Spanning links between members of one part: table has part, kind, fp, root, size and what the tester reads."""

    def __init__(self, table: pa.Table, tester: Tester):
        self.fp, self.size = table.column("fp").to_numpy(), table.column("size").to_numpy()
        self.visits = table.column("kind").to_numpy() == VISITOR
        self.label = np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
        self.linked = tester(table)

    def against(self, i: int, others: np.ndarray) -> Iterator[tuple[int, int]]:
        j = np.flatnonzero(others & (self.label != self.label[i]) & (5 * np.minimum(self.size, self.size[i]) >= 4 * np.maximum(self.size, self.size[i])))
        if not len(j):
            return
        for k in j[self.linked(i, j)].tolist():
            if self.label[k] != self.label[i]:
                yield int(self.fp[i]), int(self.fp[k])
                self.label[self.label == self.label[k]] = self.label[i]

    def links(self) -> Iterator[tuple[int, int]]:
        """Links that join what is joined: among own members, or where there are visitors, between these and own members."""
        if self.visits.any():
            for i in np.flatnonzero(self.visits).tolist():
                yield from self.against(i, ~self.visits)
            return
        waiting = np.argsort(self.fp * np.int64(0x1B873593) ^ (self.fp >> 29), kind="stable")
        every = np.ones(len(self.fp), bool)
        for i in waiting[:HUBS].tolist():
            yield from self.against(i, every)
        waiting = waiting[HUBS:]
        # A member that is in the largest component waits; once all that wait are in one component, all other pairs have been compared.
        while len(waiting) and len(np.unique(self.label[waiting])) > 1:
            most, later = np.bincount(self.label).argmax(), []
            for i in waiting.tolist():
                if self.label[i] == most:
                    later.append(i)
                else:
                    yield from self.against(i, every)
            waiting = np.array(later, np.int64)


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows of each part, column 0, which come together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        part = b.column(0).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])) if len(part) else np.zeros(1, np.int64)
        for x, y in zip(cuts.tolist(), cuts[1:].tolist()):
            if held and held[0].column(0)[0].as_py() != part[x]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def part_links(rows: DataFrame, tester: Tester) -> DataFrame:
    """(src, dst) of rows dealt by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []

        def done() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), ()))], ["src", "dst"])
            out.clear()
            return b

        for table in parts_of(batches):
            if table.num_rows > 1:
                out.extend(p for p in Part(table, tester).links() if p[0] != p[1])
            if len(out) > STRIP:
                yield done()
        yield done()
        release()

    first = ["part", "kind", "fp", "root", "size"]
    rows = rows.select(*first, *(c for c in rows.columns if c not in first))
    return rows.repartition("part").sortWithinPartitions("part", "kind", "size", "fp").mapInArrow(run, "src long, dst long")


def links(rows: DataFrame, tester: Tester, most: int) -> DataFrame:
    """(src, dst) that join the members of each group as the tester links them.

    rows: key long (the group), fp long (the member), size int, weight long (what it takes in memory), and what the tester reads.
    """
    payload = [c for c in rows.columns if c not in ("key", "weight")]
    plain = rows.withColumn("kind", F.lit(OWN)).withColumn("root", F.col("fp"))
    large = checkpointed(rows.groupBy("key").agg(F.sum("weight").alias("w")).where(F.col("w") > most).select("key", F.ceil(F.col("w") / most).cast("bigint").alias("chunks")))
    if not large.count():
        return checkpointed(part_links(plain.withColumnRenamed("key", "part").drop("weight"), tester))
    sizes = broadcast_if_small(large)
    name = F.xxhash64("key", "chunk")
    whole = plain.join(sizes, "key", "left_anti").withColumn("part", F.col("key")).select("part", "kind", "root", *payload)
    cut = rows.join(sizes, "key").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    order = F.xxhash64(F.col("fp"), F.lit(1))
    hubs = cut.groupBy("key").agg(F.array_distinct(F.array(F.min("fp"), F.max("fp"), F.min_by("fp", order), F.max_by("fp", order))).alias("fp")).select("key", F.explode("fp").alias("fp"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
    guests = cut.join(broadcast_if_small(hubs), ["key", "fp"], "left_semi").withColumn("own", F.col("chunk")).withColumn("chunk", every).where("chunk <> own").drop("own")
    chunks = cut.unionByName(guests).withColumn("part", name).withColumn("kind", F.lit(OWN)).withColumn("root", F.col("fp")).select("part", "kind", "root", *payload)
    found = checkpointed(part_links(whole.unionByName(chunks.select(whole.columns)), tester))
    joined = components(found)
    roots = broadcast_if_small(joined.withColumnRenamed("node", "fp"))
    named = cut.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    largest = named.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    visitors = named.join(broadcast_if_small(largest), "key").where("root <> largest").drop("largest").withColumn("own", F.col("chunk")).withColumn("chunk", every).where("chunk <> own").drop("own")
    both = named.withColumn("kind", F.lit(OWN)).unionByName(visitors.withColumn("kind", F.lit(VISITOR))).withColumn("part", name).select("part", "kind", "root", *payload)
    # What the first links join is told by a link of each member to its root.
    return checkpointed(joined.select(F.col("node").alias("src"), F.col("root").alias("dst")).union(part_links(both, tester)))
