"""Near-duplicates by similarity: a SimHash of 256 bits, found by multi-index hashing at any size of corpus.

Two sets of shingles with Jaccard similarity s have cosine 2s / (1 + s), so each bit of their fingerprints differs
with probability acos(2s / (1 + s)) / pi. At s = 0.8 that is 15 %, far beyond three bits of 64; but 256 bits tell
such pairs (39 differing bits on average) from unrelated ones (128) without doubt.

Segments of the fingerprint are indexed. Every fingerprint is stored under the value of each of its segments, and those
of an even value also under each value in the Hamming ball of radius one around it. So two meet whose segments differ
in at most one bit, or in two bits of even values; their complete distance then makes them candidates. (Balls around
odd values too would let all pairs meet that are two bits apart, but with more keys for the same chance to meet.) The
segments' width follows the number of fingerprints, so that runs under one key stay
short, and the number of segments follows the width, so that the chance to find a pair at the threshold is the same
at all sizes.

Bits only propose: a candidate pair links if the exact Jaccard similarity of its shingles reaches the threshold. Under
each key a fingerprint is first compared with its nearest ones and with representatives of its group, so that a group
of copies makes a linear number of pairs; what has more partners than that is looked at again, and all its pairs are
compared that the first links have not yet joined. The members of a very long run are not compared at all, but keyed
again by further segments together with the key they share, by the same rule and with the same chance to meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import among, map_batches, release, sieve, tables_made, utf8, written
from textloom.llm.components import attach, component_ids, components
from textloom.llm.simhash import SEED, evenly

BITS = 256
#: Chance that a pair exactly at the threshold meets under some key; more similar pairs meet more surely.
MEET = 0.99
#: Fingerprints expected under one key at most, by which segments are made wider; longer runs are compared in blocks.
RUN = 2048
#: Fingerprints under one key that are held and compared by one task; longer runs are keyed again by further segments.
LONG = 1 << 14
#: A fingerprint of so many partners under one key is compared with all of them at once; one of more with a
#: representative, and with others if the links leave them apart.
NEAREST = 4


def differing(similarity: float) -> float:
    """The chance that one bit differs between two sets of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def reach(similarity: float) -> int:
    """Differing bits within which 99 % of the pairs of exactly this similarity lie."""
    p = differing(similarity)
    return int(BITS * p + 2.326 * math.sqrt(BITS * p * (1 - p)))


def layout(count: int, similarity: float, first: int = 0) -> np.ndarray:
    """The bit positions of each segment, one row a segment, for a table of ``count`` fingerprints.

    Bits are taken in the order of permutation ``first`` and those that follow it (0: as they stand)."""
    width = next(w for w in range(8, 57) if count * (w + 1) <= RUN << w)
    p = differing(similarity)
    met = sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) * share for k, share in enumerate((1, 1, 0.5)))
    number = math.ceil(math.log(1 - MEET) / math.log(1 - met))
    orders = (np.arange(BITS) if r == 0 else np.random.default_rng(r).permutation(BITS) for r in range(first, first + number))
    rows = (order[a : a + width] for order in orders for a in range(0, BITS - width + 1, width))
    return np.array([row for _, row in zip(range(number), rows, strict=False)])


def spread_bits(hashes: np.ndarray) -> np.ndarray:
    """Four independent 64-bit words for every hash (the mixing steps of SplitMix64)."""
    x = hashes[None, :] + (np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ones(words: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, lowest first: eight bits are counted at once in the bytes of a word."""
    lanes, counts = np.uint64(0x0101010101010101), np.zeros((8, 8), dtype=np.int64)
    for shift in range(8):
        bits = (words >> np.uint64(shift)) & lanes
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255))  # at most 255 in each byte
        counts[:, shift] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts.reshape(64)


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """The different hashes of the word shingles of a UTF-8 text, ascending; none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(begins, ends[width - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(begins)))


def kept_bytes(found: np.ndarray) -> bytes:
    """A set of shingles as it is stored: the upper 32 bits of its hashes, ascending, each once.

    Of two texts of n words about n * n / 2 ** 32 unlike shingles agree in them: one in ten pairs of 20,000 words has
    one such shingle."""
    high = (found >> np.uint64(32)).astype(np.uint32)
    return high[np.append(True, high[1:] != high[:-1])].tobytes() if len(high) else b""


def bits_of(found: np.ndarray) -> bytes:
    """The 32 bytes of a set of shingles: per bit, whether over half of them have it; zero for none."""
    counts = np.zeros((4, 64), dtype=np.int64)
    for i in range(0, len(found), 1 << 16):
        counts += np.array([ones(w) for w in spread_bits(found[i : i + (1 << 16)])])
    return np.packbits(2 * counts.reshape(BITS) > len(found)).tobytes()


def fingerprint(text: bytes, width: int = 5) -> bytes:
    """The 32 bytes of a text; zero without words."""
    return bits_of(shingles(text, width))


def alike(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sets of shingles, as the bytes of their ascending hashes, have this Jaccard similarity or more."""
    x, y = np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-6:
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return len(both) == 0 or shared / (len(both) - shared) >= similarity


def matrix(column: pa.Array, size: int = BITS // 8) -> np.ndarray:
    """One row of ``size`` bytes for each fingerprint."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, size)


def packed(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def segment_keys(rows: np.ndarray, segments: np.ndarray) -> Iterator[np.ndarray]:
    """Per segment, the keys of every fingerprint: one row each, its value and the ball of radius one around it."""
    bits = np.unpackbits(rows, axis=1)
    width = segments.shape[1]
    weights = np.int64(1) << np.arange(width, dtype=np.int64)
    ball = np.append(np.int64(0), weights)
    for i, at in enumerate(segments):
        yield (bits[:, at] @ weights)[:, None] ^ ball[None, :] | np.int64(i << width)


def sent_keys(rows: np.ndarray, segments: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per segment: its number, numbers of rows, and their keys: a row's value and, if that is even, the ball around it."""
    bits = np.unpackbits(rows, axis=1)
    width = segments.shape[1]
    weights = np.int64(1) << np.arange(width, dtype=np.int64)
    for i, at in enumerate(segments):
        value = bits[:, at] @ weights
        even = np.flatnonzero(bits[:, at].sum(axis=1) % 2 == 0)
        yield i, np.concatenate([np.arange(len(rows)), np.repeat(even, width)]), np.concatenate([value, (value[even][:, None] ^ weights).reshape(-1)]) | np.int64(i << width)


def forest(fps: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """A spanning forest over the fingerprints (four words a row) at most ``most`` bits apart, compared in blocks."""
    us, vs, label = [], [], np.arange(len(fps))
    for a in range(0, len(fps), RUN):
        for b in range(0, a + 1, RUN):
            left, right = fps[a : a + RUN], fps[b : b + RUN]
            apart = np.zeros((len(left), len(right)), dtype=np.uint16)
            for w in range(fps.shape[1]):
                apart += np.bitwise_count(left[:, None, w] ^ right[None, :, w])
            near = apart <= most
            if a == b:
                np.fill_diagonal(near, False)
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                cols = b + np.flatnonzero(near[i])
                found = label[cols]
                for other in np.unique(found[found != label[a + i]]).tolist():
                    us.append(a + i)
                    vs.append(int(cols[found == other][0]))
                    label[label == other] = label[a + i]
    return us, vs


def apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The differing bits of every fingerprint of ``left`` (four words a row) and every one of ``right``."""
    total = np.zeros((len(left), len(right)), dtype=np.uint16)
    for w in range(BITS // 64):
        total += np.bitwise_count(left[:, None, w] ^ right[None, :, w])
    return total


def proposed(fps: np.ndarray, most: int) -> tuple[list[int], list[int], np.ndarray]:
    """Pairs at most ``most`` bits apart, and which fingerprints have more partners than were paired.

    Those of few partners are paired with each of them. Those of more are paired with representatives: in turn the one
    of most partners that is near no earlier representative, with all that are near it. A group's middle has most
    partners under any key, so that keys agree on it and a group makes few pairs however many keys it shares."""
    us, vs, degree = [], [], np.zeros(len(fps), dtype=np.int64)
    step = max(1, RUN * RUN // len(fps))
    for a in range(0, len(fps), step):
        near = apart(fps[a : a + step], fps) <= most
        near[np.arange(len(near)), np.arange(a, a + len(near))] = False
        degree[a : a + step] = own = near.sum(axis=1)
        i, j = np.nonzero(near & ((own > 0) & (own <= NEAREST))[:, None])
        us += (a + i).tolist()
        vs += j.tolist()
    late = degree > NEAREST
    left = np.where(late, degree, 0)
    while left.any():
        r = int(left.argmax())
        near = np.flatnonzero(apart(fps[r : r + 1], fps)[0] <= most)
        left[near] = 0
        us += [r] * (len(near) - 1)
        vs += near[near != r].tolist()
    return us, vs, late


def across(fps: np.ndarray, labels: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of unlike labels at most ``most`` bits apart. What has the commonest label is never compared with itself."""
    names = np.unique(labels, axis=0, return_inverse=True)[1].reshape(-1)
    common = names == np.bincount(names).argmax()
    order = np.argsort(common, kind="stable")  # the others first
    own, rows = names[order], fps[order]
    others = int(np.count_nonzero(~common))
    for a in range(0, others, RUN):
        upto = min(a + RUN, others)
        for b in range(a, len(rows), RUN):
            i, j = np.nonzero((apart(rows[a:upto], rows[b : b + RUN]) <= most) & (own[a:upto, None] != own[None, b : b + RUN]))
            later = b + j > a + i
            if later.any():
                yield order[a + i[later]], order[b + j[later]]


def mixed(key: np.ndarray, number: int, value: np.ndarray) -> np.ndarray:
    """A key for a value of a further segment below a key (the mixing steps of SplitMix64)."""
    x = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number)
    for multiplier in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(multiplier)
    x = (x + value.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def keyed(fps: DataFrame, segments: np.ndarray, whole: bool = False) -> DataFrame:
    """(fp), or (fp, key) -> (key, fp) for every key that the fingerprint sends out, below the key that it has where it has one.

    ``whole``: under the balls around odd values too."""
    below = "key" in fps.columns

    def keys_of(part: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if not whole:
            yield from sent_keys(part, segments)
            return
        for number, keys in enumerate(segment_keys(part, segments)):
            yield number, np.repeat(np.arange(len(part)), keys.shape[1]), keys.reshape(-1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(0))
            above = batch.column(1).to_numpy() if below else None
            for i in range(0, len(rows), 4096):
                part = rows[i : i + 4096]
                for number, at, keys in keys_of(part):
                    own = mixed(above[i : i + 4096][at], number, keys) if below else keys
                    yield pa.RecordBatch.from_arrays([pa.array(own), packed(part[at])], ["key", "fp"])

    return fps.select(*["fp", "key"][: 1 + below]).mapInArrow(spread, "key long, fp binary")


def in_runs(rows: DataFrame, found, schema: str, size: int = BITS // 8, long: int | None = None, defer=None) -> DataFrame:
    """``found(key, fingerprints)`` for all rows (key, fp) that share a key, if they are more than one; ``size`` bytes each.

    Of a run of more than ``long`` rows nothing is held: ``defer(key, fingerprints)`` gets them part by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now, count, deferred = None, 0, False

        def close() -> Iterator[pa.RecordBatch]:
            if held and not deferred and count > 1:
                yield from found(now, held[0] if len(held) == 1 else np.concatenate(held))
            held.clear()

        for batch in batches:
            key, rows = batch.column(0).to_numpy(), matrix(batch.column(1), size)
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if a == b:
                    continue
                if key[a] != now:
                    yield from close()
                    now, count, deferred = key[a], 0, False
                held.append(rows[a:b])
                count += b - a
                if defer is not None and (deferred or count > long):
                    deferred = True
                    yield from defer(now, np.concatenate(held))
                    held.clear()
        yield from close()

    return rows.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def links(fps: DataFrame, segments: np.ndarray, most: int) -> DataFrame:
    """``fps(fp)``, all different -> links (u, v) by bits alone: under each key, a spanning forest of them."""

    def found(_: int, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        us, vs = forest(rows.view(np.uint64), most)
        if us:
            yield pa.RecordBatch.from_arrays([packed(rows[us]), packed(rows[vs])], ["u", "v"])

    return in_runs(keyed(fps, segments, whole=True), found, "u binary, v binary")


#: What a row of candidates is: a pair (u, v), a fingerprint u of more partners under a key, a member u of a long run.
PAIR, LATE, HOT = 0, 1, 2


def candidates(rows: DataFrame, most: int, long: int | None = LONG) -> DataFrame:
    """(key, fp) -> (kind, u, v, key): pairs near each other, and for their keys those of more partners and of long runs."""
    schema = "kind int, u binary, v binary, key long"

    def out(kind: int, us: np.ndarray, vs: np.ndarray | None, key: int | None) -> pa.RecordBatch:
        n = len(us)
        other = pa.nulls(n, pa.binary()) if vs is None else packed(vs)
        keys = pa.nulls(n, pa.int64()) if key is None else pa.array(np.full(n, key, dtype=np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, dtype=np.int32)), packed(us), other, keys], ["kind", "u", "v", "key"])

    def found(key: int, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        us, vs, late = proposed(np.ascontiguousarray(fps).view(np.uint64), most)
        if us:
            yield out(PAIR, fps[us], fps[vs], None)
        if late.any():
            yield out(LATE, fps[late], None, key)

    def defer(key: int, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield out(HOT, fps, None, key)

    return in_runs(rows, found, schema, long=long, defer=defer if long else None)


def owned(segments: np.ndarray, bits: np.ndarray, us: np.ndarray, vs: np.ndarray, key: int) -> np.ndarray:
    """Which pairs of rows of ``bits`` belong to this key: it is the least one they share in the first segment in which they meet."""
    width = segments.shape[1]
    weights = np.int64(1) << np.arange(width, dtype=np.int64)
    mine = key >> width
    free = np.ones(len(us), dtype=bool)
    odd = lambda x: np.bitwise_count(x.view(np.uint64)) % 2 == 1
    for at in segments[:mine]:
        a, b = bits[us][:, at], bits[vs][:, at]
        apart_by = (a != b).sum(axis=1)
        free &= (apart_by > 2) | ((apart_by == 2) & (a.sum(axis=1) % 2 == 1))
    a, b = bits[us][:, segments[mine]].astype(np.int64) @ weights, bits[vs][:, segments[mine]].astype(np.int64) @ weights
    differ = np.bitwise_count((a ^ b).view(np.uint64))
    top = lambda x: np.where(x > 0, np.int64(1) << np.floor(np.log2(np.maximum(x, 1))).astype(np.int64), 0)
    first = top(a ^ b)
    same, one = np.where(odd(a), a, a ^ top(a)), np.where(odd(a), a, b)
    low = np.where(differ == 0, same, np.where(differ == 1, one, np.minimum(a ^ first, b ^ first)))
    return free & (low == (key & ((1 << width) - 1)))


#: Hashes of a set's sketch, which are its least ones; a smaller set is its own sketch.
SKETCH = 512


def may_be_alike(a: bytes, b: bytes, similarity: float) -> bool:
    """By two sketches: exactly, if both are whole sets; else four deviations of the estimate below the similarity will do."""
    x, y = np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)
    both = np.concatenate([x, y])
    both.sort()
    twice = both[1:][both[1:] == both[:-1]]
    union = len(both) - len(twice)
    if len(x) < SKETCH and len(y) < SKETCH:
        return union == 0 or len(twice) / union >= similarity
    least = np.delete(both, np.flatnonzero(both[1:] == both[:-1]))[:SKETCH]
    shared = np.count_nonzero(twice <= least[-1]) / len(least)
    return shared >= similarity - 4 * math.sqrt(similarity * (1 - similarity) / SKETCH)


def unjoined(late: DataFrame, sets: DataFrame, segments: np.ndarray, most: int, similarity: float) -> DataFrame:
    """``late(key, fp, root, again)`` -> pairs (u, v) near each other under a key whose roots differ and whose sketches may be alike.

    All such pairs are compared where they meet, each under one of the keys that it shares (those that were keyed again
    under each); only what may be alike leaves the task."""
    unlike = late.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    sketches = sets.select("fp", F.substring("shingles", 1, 4 * SKETCH).alias("sketch"))
    rows = late.join(unlike, "key", "left_semi").join(sketches, "fp").select("key", "again", "fp", "root", "sketch")

    def found(key: int, again: bool, fps: np.ndarray, roots: np.ndarray, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(fps, axis=1)
        for us, vs in across(fps.view(np.uint64), roots, most):
            if not again:
                mine = owned(segments, bits, us, vs, key)
                us, vs = us[mine], vs[mine]
            like = np.array([may_be_alike(held[i], held[j], similarity) for i, j in zip(us.tolist(), vs.tolist(), strict=True)], dtype=bool)
            if like.any():
                yield pa.RecordBatch.from_arrays([packed(fps[us[like]]), packed(fps[vs[like]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            if sum(x.num_rows for x in held) > 1:
                whole = pa.Table.from_batches(held).combine_chunks()
                fps, roots = (np.ascontiguousarray(matrix(whole.column(i))) for i in (2, 3))
                yield from found(*now, fps, roots, whole.column(4).to_pylist())
            held.clear()

        for batch in batches:
            key, again = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = (np.flatnonzero((key[1:] != key[:-1]) | (again[1:] != again[:-1])) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if a < b:
                    if (at := (int(key[a]), bool(again[a]))) != now:
                        yield from close()
                        now = at
                    held.append(batch.slice(a, b - a))
        yield from close()

    return rows.repartition("key").sortWithinPartitions("key", "again").mapInArrow(run, "u binary, v binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingles, ``sets(fp, shingles)``, have the Jaccard similarity or more, as a written table."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        mask = [alike(a, b, similarity) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return batch.select(["u", "v"]).filter(pa.array(mask, pa.bool_()))

    both = written(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "wide-pairs")
    own = attach(both, sets.select(F.col("fp").alias("u"), F.col("shingles").alias("a")), "u")
    own = attach(own, sets.select(F.col("fp").alias("v"), F.col("shingles").alias("b")), "v", counted=both)
    return written(map_batches(own, ["u", "v", "a", "b"], "u binary, v binary", kernel), "wide-links")


def all_candidates(distinct: DataFrame, segments: np.ndarray, similarity: float, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """``distinct(fp)`` -> pairs (u, v), and (key, fp, again) of what has more partners; long runs are keyed again once."""
    most, again = reach(similarity), F.lit(False).alias("again")
    found = written(candidates(keyed(evenly(distinct.select("fp")), segments), most, long), "wide-candidates")
    hot = found.where(F.col("kind") == HOT).select(F.col("u").alias("fp"), "key")
    found = found.select("*", again)
    if not hot.isEmpty():
        largest = hot.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        more = candidates(keyed(evenly(hot), layout(largest, similarity, 1 + len(segments))), most, None)
        found = found.unionByName(written(more, "wide-more-candidates").withColumn("again", F.lit(True)))
    return found.where(F.col("kind") == PAIR).select("u", "v"), found.where(F.col("kind") == LATE).select("key", F.col("u").alias("fp"), "again")


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, keep: tuple[str, ...] = (), long: int = LONG) -> DataFrame:
    """One row per input row: its id column, ``keep``, ``fingerprint`` (hex) and ``component_id``.

    Texts link whose shingles have the Jaccard similarity or more, compared by 32 bits of their hashes; pairs are
    looked for among fingerprints of ``reach(similarity)`` or fewer differing bits of 256, and texts of one
    fingerprint count as alike. component_id is the smallest id reachable over links. A null text is empty; texts
    without words have fingerprint zero and are one group. Texts of fewer than ``width`` words link to the same words
    only, long ones by all their shingles. Null ids stay and are never a component's id unless it has no other.
    Repeated rows stay, and so do rows of one id with unlike texts, each in its own component; an empty table gives
    an empty one, other columns are left behind."""
    kept = [id_col, *keep]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", fp binary, shingles binary"

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x, width) for x in utf8(batch.column(len(kept)))]
        found = [pa.array([bits_of(x) for x in sets], pa.binary()), pa.array([kept_bytes(x) for x in sets], pa.binary())]
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], *found], [*kept, "fp", "shingles"])

    spark, standing = df.sparkSession, tables_made()
    rows = written(map_batches(df, [*kept, text_col], schema, kernel), "wide-fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "wide-distinct")
    segments = layout(distinct.count(), similarity)
    pairs, late = all_candidates(distinct, segments, similarity, long)
    paired = written(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), "wide-paired")
    # Most sets have no partner: a Bloom filter leaves them where they are, and copies are put together before the rest moves
    own = among(rows.select("fp", "shingles", F.xxhash64("fp").alias("__hash")), sieve(paired.select(F.xxhash64("fp").alias("h")), "h"), "__hash")
    sets = written(own.groupBy("fp").agg(F.min("shingles").alias("shingles")).join(paired, "fp", "left_semi"), "wide-shingles")
    edges = verified(pairs, sets, similarity)
    if not late.isEmpty():
        joined = components(edges)
        late = late.join(joined, late.fp == joined.node, "left").select("key", "again", "fp", F.coalesce("root", "fp").alias("root"))
        edges = edges.unionByName(verified(unjoined(late, sets, segments, reach(similarity), similarity), sets, similarity))
    by_fp = component_ids(distinct, edges)
    release(spark, standing, rows, by_fp)
    return attach(rows.select(*kept, "fp"), by_fp, "fp").select(*kept, F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
