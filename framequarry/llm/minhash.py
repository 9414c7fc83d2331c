"""Document fingerprints by one-permutation MinHash, in SQL functions only.

Each run of `SHINGLE` words is hashed once; the hash's low bits name one of `BINS` bins and the rest
is its value, of which every bin keeps the least. A bin that nothing fell into borrows from another:
it walks the other bins in a random order of its own until it meets a filled one (optimal
densification), which is the same one for any two documents whose filled bins agree. Kept are the low `BITS` bits of each bin,
packed to hexadecimal. Two unequal values agree in so few bits by chance with probability 2^-BITS; the
likeness takes that out again.

Texts of fewer words than a shingle are one shingle; texts without words have an empty fingerprint,
which is like another empty one (1) and unlike all others (0).

Neighbours in ascending doc_id are found on ids alone: these are sorted by Spark's range partitioner, and
each gets its neighbours' keys; over the borders of partitions one row a partition is looked at. Texts
are exchanged once, by their own key; of each, as much as the document before it takes goes there.
Nulls come first, ties in doc_id go by the text's hash; rows that repeat follow each other.

Texts of any length are read whole; null is like empty. An empty table gives an empty one; columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHINGLE, BINS, BITS = 5, 128, 8
NO_ID = -(1 << 63)


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text: runs of anything but blank and \\t to \\r."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return let(F.split(trimmed, r"[\x20\x09-\x0D]+"), lambda ws: F.when(F.get(ws, F.lit(0)) == "", F.array().cast("array<string>")).otherwise(ws))


def shingle_hashes(text: Column) -> Column:
    """One 64-bit hash for each run of words."""

    def of(ws: Column) -> Column:
        last = F.size(ws) - SHINGLE
        runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(SHINGLE))))
        return F.when(F.size(ws) > 0, runs).otherwise(F.array().cast("array<bigint>"))

    return let(words(text), of)


def _table(values) -> Column:
    return F.lit(np.array(values))


def bins(hashes: Column) -> Column:
    """The low bits of the least value of each bin, in order of the bins; null where a bin is empty."""
    none, low = (1 << 48) - 1, (1 << BITS) - 1
    packed = F.transform(hashes, lambda h: F.shiftleft(h.bitwiseAND(F.lit(BINS - 1)), 48) + F.shiftrightunsigned(h, 16))
    # one entry more a bin, larger than any value: then each bin has a first entry
    ordered = F.sort_array(F.concat(packed, _table(np.arange(BINS, dtype=np.int64) << 48 | none)))
    firsts = let(ordered, lambda a: F.filter(a, lambda x, i: (i == 0) | (F.shiftrightunsigned(x, 48) != F.shiftrightunsigned(F.get(a, i - 1), 48))))
    return F.transform(firsts, lambda x: F.when(x.bitwiseAND(F.lit(none)) != none, x.bitwiseAND(F.lit(low)).cast("int")))


def _orders() -> np.ndarray:
    """For each bin a random order of all the others, end to end."""
    rng = np.random.default_rng(128)
    return np.concatenate([rng.permutation([j for j in range(BINS) if j != k]) for k in range(BINS)]).astype(np.int32)


def fingerprint(text: Column) -> Column:
    """The packed fingerprint: two hexadecimal digits a bin."""
    every, orders = _table(np.arange(BINS, dtype=np.int32)), _table(_orders())
    digits = F.lit("".join(f"{v:02x}" for v in range(1 << BITS)))

    def dense(have: Column) -> Column:
        def borrowed(k: Column) -> Column:
            order = F.slice(orders, k * (BINS - 1) + 1, F.lit(BINS - 1))
            return F.get(have, F.get(F.filter(order, lambda j: F.get(have, j).isNotNull()), F.lit(0)))

        full = F.transform(every, lambda k: F.substring(digits, 2 * F.coalesce(F.get(have, k), borrowed(k)) + 1, F.lit(2)))
        return F.when(F.exists(have, lambda v: v.isNotNull()), F.array_join(full, "")).otherwise(F.lit(""))

    return let(bins(shingle_hashes(text)), dense)


def likeness(one: Column, other: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints: the share of equal bins, less what chance gives."""
    every = _table(np.arange(0, 2 * BINS, 2, dtype=np.int32))
    equal = F.size(F.filter(every, lambda k: F.substring(one, k + 1, F.lit(2)) == F.substring(other, k + 1, F.lit(2))))
    chance = 1.0 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(one.isNull() | other.isNull(), F.lit(None).cast("double")).when((one == "") | (other == ""), (one == other).cast("double")).otherwise(estimate)


def neighbour_keys(rows: DataFrame) -> DataFrame:
    """For each distinct (did, tk): how many rows it has, the key before it (b_did, b_tk) and what that takes of a text (taken).

    rows: did, tk (the text's hash), n (its code points). The first key follows the last.
    """
    one = rows.groupBy("did", "tk").agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    # rows in order, numbered by partition and place in it; written, so that the numbers stay what they are
    placed = stored(one.repartitionByRange("did", "tk").sortWithinPartitions("did", "tk").withColumn("at", F.monotonically_increasing_id()), "minhash-order").withColumn("part", F.shiftright("at", 33))
    key = F.struct("did", "tk", "n")
    here = Window.partitionBy("part").orderBy("at")
    inside = placed.withColumn("before", F.lag(key).over(here))
    ends = placed.groupBy("part").agg(F.max_by(key, "at").alias("last"))
    over = Window.orderBy("part")  # one row a partition
    every = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = ends.select("part", F.coalesce(F.lag("last").over(over), F.last("last").over(every)).alias("edge"))
    linked = inside.join(edges, "part").withColumn("before", F.coalesce("before", "edge"))
    return linked.select("did", "tk", "copies", F.col("before.did").alias("b_did"), F.col("before.tk").alias("b_tk"), F.floor(F.col("before.n") / 4).cast("int").alias("taken"))


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tk", F.xxhash64("text"))
    keys = neighbour_keys(texts.select("did", "tk", F.length("text").alias("n")))
    # both sides of the last join read this exchange: its columns are the same in each
    printed = texts.select("did", "tk", "text", fingerprint(F.col("text")).alias("fingerprint"))
    together = printed.hint("merge").join(keys, ["did", "tk"]).withColumn("nth", F.row_number().over(Window.partitionBy("did", "tk").orderBy("did")))
    lent = together.where("nth = 1").select(F.col("b_did").alias("did"), F.col("b_tk").alias("tk"), F.substring(F.col("text"), F.lit(1), F.col("taken")).alias("after"), F.col("fingerprint").alias("next_fingerprint"))
    follows = together.select("did", "tk", "text", "fingerprint", "copies", "nth").join(lent.hint("merge"), ["did", "tk"])
    size = F.length("text")
    taken = F.floor(size / 4).cast("int")
    last = F.col("nth") == F.col("copies")  # rows that repeat are each other's next, all but the last
    head = F.when(last, F.col("after")).otherwise(F.substring(F.col("text"), F.lit(1), taken))
    edited = follows.select("did", size.cast("long").alias("n_chars"), "fingerprint", F.when(last, F.col("next_fingerprint")).otherwise(F.col("fingerprint")).alias("next_fingerprint"), F.concat(F.substring(F.col("text"), F.lit(1), size - taken), head).alias("edited"))
    done = edited.select("did", "n_chars", "fingerprint", "next_fingerprint", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    near = {"near_edited": "edited_fingerprint", "near_next": "next_fingerprint"}
    return done.select(F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *(likeness(F.col("fingerprint"), F.col(other)).alias(name) for name, other in near.items()))
