"""A Merkle manifest of a dataset: one root over all rows, and for each row the proof that leads to it.

A row is a leaf: the SHA-256 of its columns, each `-` if null, else its UTF-8 size, `:` and its value.
The leaves of a group (a source) stand in order; of every level each `FANOUT` consecutive nodes become
one, their SHA-256 as hexadecimal text, the last run of a level being shorter and never padded, until one
node is left: the subroot. The subroots of all groups, in order of the groups, make the root alike.

Leaves are numbered within their group and dealt out by ranges of these numbers, so that a partition
holds stretches of consecutive leaves, whatever the group's size. Each stretch is one pass with a stack of
runs, one a level: a run that reaches its end carries into the next level and is written as a node record;
a group's last, short runs are carried where the group ends. Nodes whose parent also has children beyond
the stretch are its peaks: left of the first aligned one, and what is on the stack at the end. At most
2 * (FANOUT - 1) a level are left of a stretch, whatever its length. The peaks of the stretches of `MERGED`
neighbouring partitions go through the same stack, which makes one longer stretch of them, and so on until
one is left a group: a merge reads some hundred rows a stretch at most. Proofs go down the node records, from
the root to the leaves, a level at a time, by joins on a node's number.

Defined results: null ids stand first, rows that share an id by their leaves (equal leaves are
interchangeable); a null group stands before all others, groups by their UTF-8 bytes; a group of one leaf
is that leaf; an empty table gives an empty one; texts are hashed whole, null and empty ones differ; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, numbered, record, stored

FANOUT = 16
#: Stretches of so many partitions are merged into one at a time.
MERGED = 64
#: Columns of a leaf, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left: string, right: string>>"


def digest_of(*values: Column) -> Column:
    """SHA-256 of values, each with its size before it, null as `-`."""
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*parts), 256)


def group_key(group: Column) -> Column:
    """A string that is never null and sorts null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def height(n: Column) -> Column:
    """How many levels stand above the leaves of a group of n."""
    return sum((F.when(n > FANOUT**k, 1).otherwise(0) for k in range(15)), F.lit(0))


def _height(n: int) -> int:
    levels = 0
    while n > FANOUT**levels:
        levels += 1
    return levels


class Mountains:
    """The stack over a stretch of a group of n leaves, given as nodes of any level in order of their leaves."""

    def __init__(self, grp: str, n: int):
        self.grp, self.n, self.top, self.next = grp, n, _height(n), 0
        self.stack: list[list[str]] = [[] for _ in range(self.top + 1)]
        self.ends = [0] * (self.top + 1)  # the number after the last node of each level
        self.nodes: list[tuple[int, int, str, list[str]]] = []
        self.peaks: list[tuple[int, int, str]] = []

    def add(self, level: int, idx: int, digest: str) -> None:
        self.next = min((idx + 1) * FANOUT**level, self.n)
        self._push(level, idx, digest)

    def _push(self, level: int, idx: int, digest: str) -> None:
        while True:
            run = self.stack[level]
            self.ends[level] = idx + 1
            if level == self.top or (not run and idx % FANOUT):
                self.peaks.append((level, idx, digest))  # the root, or a parent that began before the stretch
                return
            run.append(digest)
            if len(run) < FANOUT:
                return
            level, idx, digest = self._carry(level)

    def _carry(self, level: int) -> tuple[int, int, str]:
        run, idx = self.stack[level], (self.ends[level] - 1) // FANOUT
        digest = hashlib.sha256("".join(run).encode()).hexdigest()
        self.nodes.append((level + 1, idx, digest, run))
        self.stack[level] = []
        return level + 1, idx, digest

    def close(self) -> None:
        """Carry the short runs if the group ends here; what is left on the stack are peaks."""
        for level in range(self.top):
            run = self.stack[level]
            if run and self.next == self.n:
                self._push(*self._carry(level))
            else:
                first = self.ends[level] - len(run)
                self.peaks += [(level, first + k, digest) for k, digest in enumerate(run)]


_RECORDS = pa.schema([("grp", pa.string()), ("n", pa.int64()), ("part", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("kids", pa.list_(pa.string()))])
_RECORDS_DDL = "grp string, n long, part long, level int, idx long, digest string, kids array<string>"


def _settled(of: Mountains, part: int) -> pa.RecordBatch:
    """Node records (kids set) and peaks (kids null) so far."""
    rows = [*of.nodes, *((*peak, None) for peak in of.peaks)]
    of.nodes, of.peaks = [], []
    level, idx, digest, kids = zip(*rows, strict=True) if rows else ([], [], [], [])
    return record(_RECORDS, grp=[of.grp] * len(rows), n=[of.n] * len(rows), part=[part] * len(rows), level=level, idx=idx, digest=digest, kids=kids)


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of a partition's stretches, leaves coming in order."""
    now, part = None, TaskContext.get().partitionId()
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("grp", "n", "idx", "digest"))
        for grp, n, idx, digest in zip(*columns, strict=True):
            if now is None or now.grp != grp or now.next != idx:
                if now is not None:
                    now.close()
                    yield _settled(now, part)
                now = Mountains(grp, n)
            now.add(0, idx, digest)
        if now is not None:
            yield _settled(now, part)
    if now is not None:
        now.close()
        yield _settled(now, part)


def _merged(table: pa.Table) -> pa.Table:
    """The records of consecutive stretches of one group, given their peaks."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("level", "idx", "digest")), strict=True), key=lambda r: r[1] * FANOUT ** r[0])
    of = Mountains(table.column("grp")[0].as_py(), table.column("n")[0].as_py())
    for row in rows:
        of.add(*row)
    of.close()
    return pa.Table.from_batches([_settled(of, table.column("part")[0].as_py())])


@dataclass(frozen=True)
class Forest:
    """The trees of all groups: numbered leaves, node records, a root a group, and how many levels the highest has."""

    leaves: DataFrame
    nodes: DataFrame  # grp, level (from 1), idx, kids
    roots: DataFrame  # grp, n, digest
    levels: int


def forest(leaves: DataFrame, *order: str) -> Forest:
    """The trees over rows with `grp` and `digest`."""
    arrow_batches(leaves.sparkSession, 10_000)
    leaves = numbered(leaves, *order)
    dealt = leaves.select("grp", "n", "idx", "digest").repartitionByRange("grp", "idx").sortWithinPartitions("grp", "idx")
    records = stored(dealt.mapInArrow(_stacked, _RECORDS_DDL), "merkle-nodes")
    last, levels = records.agg(F.max("part"), F.max(height(F.col("n")))).first()  # two numbers
    nodes = [records]
    while last:  # stretches of MERGED partitions become one
        last //= MERGED
        near = records.where("kids is null").withColumn("part", F.floor(F.col("part") / MERGED))
        records = stored(near.groupBy("grp", "part").applyInArrow(_merged, _RECORDS_DDL), "merkle-merged")
        nodes.append(records)
    roots = records.where("kids is null").select("grp", "n", "digest")
    every = reduce(DataFrame.unionByName, (r.where("kids is not null").select("grp", "level", "idx", "kids") for r in nodes))
    return Forest(leaves, every, roots, levels or 0)


def beside(kids: Column, place: Column) -> Column:
    """The siblings of the child at a place, before and behind it, end to end."""
    width = 64
    whole = F.array_join(kids, "")
    return F.struct(F.substring(whole, F.lit(1), place * width).alias("left"), F.substring(whole, (place + 1) * width + 1, F.lit(width * FANOUT)).alias("right"))


def with_proofs(trees: Forest, above: DataFrame) -> DataFrame:
    """The leaves with `path`: the siblings of every level, their own first, then those above their group's root.

    above: grp, path and further columns that leaves take over, one row a group.
    """
    also = [c for c in above.columns if c not in ("grp", "path")]
    entry = stored(trees.roots.select("grp", "n").join(above, "grp").withColumn("idx", F.lit(0).cast("long")), "merkle-roots")
    columns = ["grp", "idx", "path", *also]
    runs = down = None
    for level in range(trees.levels, 0, -1):
        here = entry.where(height(F.col("n")) == level).select(*columns)
        here = here if down is None else here.unionByName(down)
        runs = here.join(trees.nodes.where(F.col("level") == level).select("grp", "idx", "kids"), ["grp", "idx"])
        if level > 1:
            each = runs.select("*", F.posexplode("kids").alias("place", "kid"))
            longer = F.concat(F.array(beside(F.col("kids"), F.col("place"))), F.col("path"))
            down = stored(each.select("grp", (F.col("idx") * FANOUT + F.col("place")).alias("idx"), longer.alias("path"), *also), "merkle-paths")
    found = entry.where("n = 1").select(*columns, F.lit(None).cast("array<string>").alias("kids"))
    found = found if runs is None else found.unionByName(runs)
    place = F.pmod("idx", F.lit(FANOUT)).cast("int")
    joined = trees.leaves.withColumn("run", F.floor(F.col("idx") / FANOUT)).join(found.withColumnRenamed("idx", "run"), ["grp", "run"])
    own = F.when(F.col("kids").isNull(), F.array().cast(_PATH)).otherwise(F.array(beside(F.col("kids"), place)))
    return joined.withColumn("path", F.concat(own, F.col("path"))).drop("run", "kids", "n", "idx")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda digest, level: F.sha2(F.concat(level["left"], digest, level["right"]), 256))


def siblings_digest(path: Column) -> Column:
    """One digest of a whole proof: all siblings, bottom up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), ""), 256)


def prove(rows: DataFrame) -> DataFrame:
    """Rows (grp, doc_id, digest and others) with subroot, root and path, the siblings of each level up to the root."""
    trees = forest(rows, "doc_id", "digest")
    top = forest(trees.roots.select(F.lit("").alias("grp"), F.col("grp").alias("member"), "digest"), "member")
    crown = top.roots.select("grp", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    above = with_proofs(top, crown).select(F.col("member").alias("grp"), "path", F.col("digest").alias("subroot"), "root")
    return with_proofs(trees, above)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root and proof of every row: what a dataset's publisher keeps beside it."""
    rows = docs.select(group_key(F.col("source")).alias("grp"), "doc_id", "source", digest_of(*map(F.col, LEAF)).alias("digest"))
    return prove(rows).select("doc_id", "source", F.col("digest").alias("leaf"), "subroot", "root", F.col("path").alias("proof"))


def verify_tampered(docs: DataFrame) -> DataFrame:
    """The contract's digest: each row's leaf and proof, and the root that its tampered form folds to."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    tampered = digest_of(*(changed if c == "text" else F.col(c) for c in LEAF))
    leaf = digest_of(*map(F.col, LEAF))
    rows = docs.select(group_key(F.col("source")).alias("grp"), "doc_id", leaf.alias("digest"), F.nullif(tampered, leaf).alias("tampered"))
    proved = prove(rows).withColumn("folded_root", fold(F.coalesce("tampered", "digest"), F.col("path")))
    return proved.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
