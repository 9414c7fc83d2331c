"""SimHash near-duplicates by pigeonring filtering.

A fingerprint's 64 bits lie on a ring of `PARTS` segments. If two fingerprints differ in at most T
bits, then from some segment on every chain of 1, 2, ... segments differs in at most its share of T
(its length times T / PARTS, rounded down). With T = 4 and five segments the first of the chain is equal and
the first two differ in at most one bit together: so each fingerprint is filed under its pairs of
neighbouring segments and under those with one bit of the second flipped on, 26 bits a key; longer
chains are then held to their budgets, and only what remains gets the full Hamming check.

Equal fingerprints are one node from the start, so copies cost nothing. Inside a key only links that
join what was not yet joined are passed on (a spanning forest), so a large group of near copies
gives as many links as it has members, not as many as it has pairs - and no link between different
fingerprints is lost. Fingerprints are filed once, and keys are compared where they meet; keys with
more than `BLOCK` members are split into blocks, and every pair of blocks becomes a task of its own.

In the component search a node is its smallest document and fingerprint, in this order, so that a
component's root names its smallest document and nothing has to be gathered by root.

Null and empty texts, or texts of white space, have fingerprint zero and are linked like any other;
texts of any length are read whole. Rows that repeat are answered one by one. An empty table gives an
empty one; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, batches_of, record, shuffle_partitions, stored, text_key
from .components import smallest_reachable

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Where the ring's segments begin, and their widths: five, of 13 bits but for the last.
PARTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BLOCK = 4096
#: Up to so many hot keys (24 bytes each) are sent to every task, more are joined.
SENT = 100_000


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each run of four lower-cased words; of all words if there are fewer; none if there are none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - SHINGLE + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    counts = np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id and its fingerprint as a signed 64-bit integer, and the text's key if asked for; a narrow map over whole texts."""
    arrow_batches(docs.sparkSession)
    keys = ("tk",) * keyed
    schema = pa.schema([(name, pa.int64()) for name in ("doc_id", "fp", *keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                prints = np.array([fingerprint(shingle_hashes(t)) for t in batch.column("text").to_pylist()], np.uint64)
                yield record(schema, doc_id=batch.column("doc_id"), fp=pa.array(prints.view(np.int64)), **{k: batch.column(k) for k in keys})

    return docs.select("doc_id", "text", *(text_key(F.col("text")).alias(k) for k in keys)).mapInArrow(run, "doc_id long, fp long" + ", tk long" * keyed)


def _segment(fp, part: int):
    start, width = PARTS[part % len(PARTS)]
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def filed(nodes: DataFrame) -> DataFrame:
    """(key, fp, probe): every fingerprint under its five exact pairs of segments and their one-bit variants.

    A variant only turns a bit on, so two fingerprints that differ in that bit meet under the key of
    the one that has it.
    """
    fp = F.col("fp")

    def under(part: int):
        width, second = PARTS[(part + 1) % len(PARTS)][1], _segment(fp, part + 1)
        tops = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(width)])
        base = F.lit(part << 26) + F.shiftleft(_segment(fp, part), 13) + second
        return F.transform(F.filter(tops, lambda bit: second.bitwiseAND(bit) == 0), lambda bit: F.struct((base + bit).alias("key"), (bit != 0).alias("probe")))

    rows = [under(part) for part in range(len(PARTS))]
    return nodes.select("fp", F.explode(F.concat(*rows)).alias("at")).select("at.key", "fp", "at.probe")


def _budgets(first: np.ndarray, second: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    """Which pairs keep every chain that starts at their segment within its share of the distance."""
    differ, parts = first ^ second, np.broadcast_to(parts, first.shape)
    counts = np.stack([np.bitwise_count(differ >> np.uint64(start) & np.uint64((1 << width) - 1)) for start, width in PARTS]).astype(np.int64)
    sums, keep, at = np.zeros(len(first), np.int64), np.ones(len(first), bool), np.arange(len(first))
    for length in range(1, len(PARTS) + 1):
        sums = sums + counts[(parts + length - 1) % len(PARTS), at]
        keep &= sums <= length * DISTANCE // len(PARTS)
    return keep


def forest(left: np.ndarray, right: np.ndarray, part: int) -> list[tuple[int, int]]:
    """Links that join all of the near pairs between two lists (or within one): a spanning forest.

    Rows are compared in blocks against all others; each pass is bounded by the lists, never kept.
    """
    same = right is left
    names = np.unique(np.concatenate([left, right]))
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    li, ri = np.searchsorted(names, left), np.searchsorted(names, right)
    for k in range(len(left)):
        others, at = (right[k + 1 :], ri[k + 1 :]) if same else (right, ri)
        if not len(others):
            continue
        near = np.flatnonzero(_budgets(np.full(len(others), left[k]), others, part))
        for j in at[near].tolist():
            a, b = root(int(li[k])), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(names[li[k]]), int(names[j])))
    return out


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): enough links between distinct fingerprints (column fp) to join all within the distance."""
    spark = nodes.sparkSession
    arrow_batches(spark)
    parts = shuffle_partitions(spark)
    # dealt out first: a fingerprint becomes some 35 rows
    files = filed(nodes.repartition(parts, "fp"))
    # a key under which very many meet is counted, not gathered: it is dealt out in blocks from the start
    hot = stored(files.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("probe"), 1)).alias("held")).where(F.col("n") > BLOCK), "simhash-hot")
    split = files.join(F.broadcast(hot) if hot.count() <= SENT else hot, "key", "left")
    of_key = Window.partitionBy("key")  # at most BLOCK rows
    cold = split.where("n is null").select("key", "fp", "probe").repartition(parts, "key")
    sized = cold.withColumns({"n": F.count(F.lit(1)).over(of_key), "held": F.count(F.when(~F.col("probe"), 1)).over(of_key)})
    zero = F.lit(0)
    # a key matters only if something is filed there exactly and something else meets it
    small = sized.where("n > 1 and held > 0").select("key", "fp", "probe", zero.alias("block"), zero.alias("lo"), zero.alias("hi")).sortWithinPartitions("key")
    blocked = split.where("held > 0").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("lo"), F.greatest(o, F.col("block")).alias("hi")))
    large = blocked.select("key", "fp", "probe", "block", F.explode(cells).alias("cell")).select("key", "fp", "probe", "block", "cell.lo", "cell.hi")
    large = large.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "lo", "hi", "fp", "probe", "block")])
            rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
            change = np.flatnonzero((np.diff(rows[:3], axis=1) != 0).any(axis=0))
            whole = int(change[-1]) + 1 if len(change) else 0  # the last cell may go on in the next batch
            rest = rows[:, whole:]
            if whole and len(found := _cells(rows[:, :whole])):
                yield record(schema, a=pa.array(found[:, 0]), b=pa.array(found[:, 1]))
        if rest is not None and len(found := _cells(rest)):
            yield record(schema, a=pa.array(found[:, 0]), b=pa.array(found[:, 1]))

    return small.mapInArrow(run, "a long, b long").unionAll(large.mapInArrow(run, "a long, b long"))


#: Cells up to this size are compared at once with all others of a batch; larger ones one by one.
SMALL = 8


def _cells(rows: np.ndarray) -> np.ndarray:
    """The links of whole cells (rows: key, lo, hi, fp, probe, block; sorted by cell)."""
    key, lo, hi, fp, probe, block = rows
    fp = fp.view(np.uint64) if fp.flags.c_contiguous else np.ascontiguousarray(fp).view(np.uint64)
    n = len(key)
    first = np.concatenate([[0], np.flatnonzero((np.diff(rows[:3], axis=1) != 0).any(axis=0)) + 1])
    sizes = np.diff(np.concatenate([first, [n]]))
    cell, small = np.repeat(np.arange(len(first)), sizes), np.repeat(sizes <= SMALL, sizes)
    out = []
    for step in range(1, SMALL):
        i = np.flatnonzero(small[: max(0, n - step)] & (cell[: max(0, n - step)] == cell[step:]))
        j = i + step
        i, j = (x[((probe[i] == 0) | (probe[j] == 0)) & ((lo[i] == hi[i]) | (block[i] != block[j])) & (fp[i] != fp[j])] for x in (i, j))
        near = _budgets(fp[i], fp[j], key[i] >> 26)
        out.append(np.stack([fp[i[near]], fp[j[near]]], axis=1))
    for k in np.flatnonzero(sizes > SMALL).tolist():
        part = slice(int(first[k]), int(first[k] + sizes[k]))
        exact, probes, ring = probe[part] == 0, probe[part] == 1, int(key[part.start] >> 26)
        prints, low, high = fp[part], block[part] == lo[part.start], block[part] == hi[part.start]
        if lo[part.start] == hi[part.start]:
            held = prints[exact]
            found = forest(held, held, ring) + forest(prints[probes], held, ring)
        else:
            found = forest(prints[exact & low], prints[exact & high], ring) + forest(prints[probes & low], prints[exact & high], ring) + forest(prints[probes & high], prints[exact & low], ring)
        out.append(np.array(found, np.uint64).reshape(-1, 2))
    return np.concatenate(out).view(np.int64) if out else np.zeros((0, 2), np.int64)


def _components(prints: DataFrame, *also: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (fp, node) and, for those with links, (node, root). A node: none, id, further columns, fp; no field is null."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), *also)
    least = prints.groupBy("fp").agg(F.min(row).alias("least"))
    nodes = stored(least.select("fp", F.struct("least.*", "fp").alias("node")), "simhash-nodes")
    found = links(nodes.select("fp"))
    for end in "ab":
        found = found.join(nodes.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node")), end).drop(end).withColumnRenamed(f"{end}_node", f"{end}{end}")
    return nodes, smallest_reachable(found.select(F.col("aa").alias("a"), F.col("bb").alias("b")))


def _doc_id(node) -> Column:
    return F.when(~node["none"], node["id"])


def kept_rows(docs: DataFrame) -> DataFrame:
    """doc_id and tk (a hash of the text) of the row that stands for each component: the smallest doc_id, then tk.

    Rows that share a doc_id but hold different texts are told apart; null ids come last.
    """
    nodes, roots = _components(stored(fingerprints(docs, keyed=True), "simhash"), "tk")
    others = roots.where(F.col("node") != F.col("root")).select("node")
    return nodes.join(others, "node", "left_anti").select(_doc_id(F.col("node")).alias("doc_id"), "node.tk")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable); one row a row.

    A null doc_id counts as larger than all others; a component of nulls alone has a null id. The last
    join's key is the fingerprint: where many rows share one, adaptive execution splits their partition.
    """
    prints = stored(fingerprints(docs), "simhash")
    nodes, roots = _components(prints)
    named = nodes.join(roots, "node", "left").select("fp", _doc_id(F.coalesce("root", "node")).alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
