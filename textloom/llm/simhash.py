"""SimHash near-duplicates found by multi-index hashing.

A fingerprint has two segments of 32 bits. Two fingerprints with at most three differing bits differ by at most
one bit in one of the segments, so it is enough to look up, for each segment, the Hamming ball of radius one
around its value in a table of all segment values, and to verify the complete distance of what is found. Of two
values one bit apart exactly one has an even number of ones; only that one sends out its ball.

Work is done on distinct fingerprints. All that share a look-up key meet in a sorted run, where they are
compared in blocks and only a spanning forest of the verified links is emitted. Runs that are too long are
keyed again by the two halves of the other segment, by the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import map_batches, release, sieve, sieved, tables_made, utf8, written
from textloom.llm.components import attach, component_ids

SEED = 42
#: Fingerprints under one key that are compared with each other at once; longer runs are keyed again.
RUN = 2048


def hash_bits(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the word shingles of a UTF-8 text; zero if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return hash_bits(np.fromiter((digest(line[a:b], SEED) for a, b in zip(begins, ends[width - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(begins)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: its id column, ``keep`` and ``fp`` (the 64 bits as a long)."""
    kept = [id_col, *keep]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x, width) for x in utf8(batch.column(len(kept)))], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(found)], [*kept, "fp"])

    return map_batches(df, [*kept, text_col], f"{schema}, fp long", kernel)


def _keyed(segment: Column, tag: Column, bits: int) -> Column:
    """The keys under which a segment value is stored and looked up: itself and, if it sends one out, its ball."""
    ball = F.array(*[segment.bitwiseXOR(F.lit(1 << i).cast("long")) for i in range(bits)])
    own = F.array(F.struct(tag.alias("tag"), segment.alias("key"), F.lit(False).alias("ball")))
    out = F.transform(ball, lambda k: F.struct(tag.alias("tag"), k.alias("key"), F.lit(True).alias("ball")))
    return F.when(F.bit_count(segment) % 2 == 0, F.concat(own, out)).otherwise(own)


def evenly(fps: DataFrame) -> DataFrame:
    """Fingerprints in as many partitions as a shuffle has, before each of them sends out dozens of keys."""
    return fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def first_keys(distinct: DataFrame) -> DataFrame:
    """(fp) -> (tag, key, ball, fp): tag 0 for the upper segment, 1 for the lower."""
    fp = F.col("fp")
    upper, lower = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    both = F.concat(_keyed(upper, F.lit(0).cast("long"), 32), _keyed(lower, F.lit(1).cast("long"), 32))
    return distinct.select(F.explode(both).alias("e"), "fp").select("e.tag", "e.key", "e.ball", "fp")


def second_keys(deferred: DataFrame) -> DataFrame:
    """Keys the members of a long run by the halves of the segment that the run is not about."""
    fp = F.col("fp")
    other = F.when(F.col("tag") == 0, fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).otherwise(F.shiftrightunsigned(fp, 32))
    upper, lower = F.shiftright(other, 16), other.bitwiseAND(F.lit(0xFFFF).cast("long"))
    run = F.xxhash64("tag", "key")
    both = F.concat(_keyed(upper, run.bitwiseAND(F.lit(-2)), 16), _keyed(lower, run.bitwiseOR(F.lit(1)), 16))
    return deferred.select(F.explode(both).alias("e"), "fp").select("e.tag", "e.key", "e.ball", "fp").distinct()


def _forest(fps: np.ndarray, ball: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one run, in blocks; balls are compared with table entries only."""
    label = np.arange(len(fps))
    us, vs = [], []
    table = np.flatnonzero(~ball)
    for a in range(0, len(fps), RUN):
        for b in range(0, len(table), RUN):
            cols = table[b : b + RUN]
            near = np.bitwise_count(fps[a : a + RUN, None] ^ fps[None, cols]) <= most
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                own = cols[near[i]]
                found = label[own]
                apart = found != label[a + i]
                while apart.any():  # once for each component that this row joins
                    j = int(own[apart.argmax()])
                    if fps[a + i] != fps[j]:
                        us.append(fps[a + i])
                        vs.append(fps[j])
                    apart &= found != label[j]
                    label[label == label[j]] = label[a + i]
    return np.array(us, dtype=np.uint64), np.array(vs, dtype=np.uint64)


def links(keys: DataFrame, most: int = 3, defer: bool = True) -> DataFrame:
    """Verified links under shared keys, as (u, v, null); members of long runs as (fp, key, tag) if deferred."""

    def out(u: np.ndarray, v: np.ndarray, tag=None) -> pa.RecordBatch:
        tags = pa.nulls(len(u), pa.int64()) if tag is None else pa.array(np.full(len(u), tag, dtype=np.int64))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), tags], ["u", "v", "tag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        state = [None, 0, False]  # the open run's key, its members held, whether it is being deferred

        def close() -> Iterator[pa.RecordBatch]:
            if held and not state[2] and state[1] > 1:
                u, v = _forest(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), most)
                if len(u):
                    yield out(u, v)
            held.clear()
            state[1:] = [0, False]

        for batch in batches:
            tag, key, ball, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            fp, ball = fp.view(np.uint64), ball.astype(bool)
            cuts = np.flatnonzero((tag[1:] != tag[:-1]) | (key[1:] != key[:-1])) + 1
            begins, ends = np.append(0, cuts), np.append(cuts, len(fp))
            lone = (ends - begins) == 1
            lone[[0, -1]] = False  # may go on in another batch
            for a, b in zip(begins[~lone].tolist(), ends[~lone].tolist(), strict=True):
                if (at := (int(tag[a]), int(key[a]))) != state[0]:
                    yield from close()
                    state[0] = at
                held.append((fp[a:b], ball[a:b]))
                state[1] += b - a
                if defer and (state[2] or state[1] > RUN):
                    state[2] = True
                    members = np.concatenate([x for x, _ in held])
                    held.clear()
                    yield out(members, np.full(len(members), at[1], dtype=np.int64), at[0])
        yield from close()

    spread = keys.repartition("tag", "key").sortWithinPartitions("tag", "key")
    return spread.select("tag", "key", "ball", "fp").mapInArrow(run, "u long, v long, tag long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: its id column, ``keep``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints link at ``most`` (3 at most) or fewer differing bits; component_id is the smallest id reachable
    over links. A null text is empty, and texts without words have fingerprint zero, which links like any other.
    A long text is one fingerprint of all its shingles. Null ids stay and are never a component's id unless it has no
    other. Repeated rows stay, and so do rows of one id with unlike texts, each in its own component; an empty table
    gives an empty one; other columns are left behind. ``width`` words make a shingle."""
    if not 0 <= most <= 3:
        raise ValueError("two segments with balls of radius one find up to three differing bits")
    spark, standing = df.sparkSession, tables_made()
    rows = written(fingerprints(df, id_col, text_col, width, keep), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    found = written(links(first_keys(evenly(distinct.select("fp"))), most), "links")
    edges = found.where("tag is null").select("u", "v")
    late = found.where("tag is not null").select(F.col("u").alias("fp"), F.col("v").alias("key"), "tag")
    if not late.isEmpty():
        edges = edges.unionByName(written(links(second_keys(late), most, defer=False).select("u", "v"), "late-links"))
    by_fp = component_ids(distinct, edges)
    release(spark, standing, rows, by_fp)
    return attach(rows, by_fp, "fp").select(id_col, *keep, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups=near_duplicates) -> DataFrame:
    """One row for each component that ``groups`` finds, that of the smallest id, with all columns of ``df``.

    If that id stands on several rows of the component, the row with the smallest hash of its text stays; an id that
    stands on unlike texts stands for each of their components. Rows
    without an id can't stand for a group: they all stay and make no other row go.

    Only ids and hashes decide. What goes, and what stands more than once, is put in a Bloom filter; texts that it
    denies stay where they are, and only the others are shuffled, to be looked up exactly."""
    mark, key = "__text_hash", "__id_and_hash"
    spark, standing = df.sparkSession, tables_made()
    marked = df.withColumn(mark, F.xxhash64(F.col(text_col)))
    named = marked.where(F.col(id_col).isNotNull())
    own = F.struct(F.col(id_col).alias("id"), F.col(mark).alias("hash"))  # unlike texts of one id are told apart
    found = groups(named.select(own.alias(key), text_col), key, text_col)
    decided = found.groupBy(key).agg(F.count("*").alias("rows"), F.bool_and(F.col(key) == F.col("component_id")).alias("first"))
    decided = written(decided.where("not first or rows > 1").select(F.col(key)["id"].alias(id_col), F.col(key)["hash"].alias(mark), "first"), "near-duplicate-rows")
    release(spark, standing, decided)
    both = F.xxhash64(id_col, mark)
    split = sieved(marked.withColumn("__key", F.when(F.col(id_col).isNull(), F.lit(None).cast("long")).otherwise(both)).fillna(0, ["__key"]), sieve(decided.select(both.alias("h")), "h"), "__key")
    may = F.col("__may") & F.col(id_col).isNotNull()
    asked = split.where(may)
    kept = split.where(~may).unionByName(asked.join(decided.drop("first"), [id_col, mark], "left_anti"))
    again = decided.where("first").drop("first")
    if not again.isEmpty():
        kept = kept.unionByName(asked.join(again, [id_col, mark], "left_semi").dropDuplicates([id_col, mark]))
    return kept.select(df.columns)
