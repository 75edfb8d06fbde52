"""Token counts by a two-tier lookup on the map side; the texts' pre-tokens are never shuffled.

A pre-token is a longest run of bytes other than space, tab and line ends (``[^\\x20\\x09-\\x0D]+``). The
vocabularies this serves split texts at white space, and neither their normalisation nor their special strings
reach over it, so the count of a text is the sum over its pre-tokens.

Tier 1 is a table of frequent pre-tokens with their counts, broadcast once. Each task sums its pre-tokens in a
Misra-Gries summary of fixed size; the summaries (at most SUMMARY_ENTRIES words a task), not the pre-tokens, are
shuffled and added up. Only entries that hold a
share of at least ``1 / TABLE_ENTRIES`` of all pre-tokens enter the table, so it has at most TABLE_ENTRIES
entries at any size of the corpus. Tier 2 is a bounded cache in each worker for whatever misses the table; its
misses are encoded by the library, many at a time.
"""

from __future__ import annotations

import os
import struct
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, slices, small, utf8, written

TABLE_ENTRIES = 1 << 14
SUMMARY_ENTRIES = 1 << 13
CACHE_ENTRIES = 1 << 18
#: Longer pre-tokens are encoded each time and kept nowhere.
LONGEST_KEPT = 64


def shrink(counts: Counter, most: int) -> Counter:
    """One Misra-Gries step: takes the (most+1)-th largest count from all, keeps what stays above zero."""
    if len(counts) <= most:
        return counts
    cut = sorted(counts.values(), reverse=True)[most]
    return Counter({k: n - cut for k, n in counts.items() if n > cut})


def summaries(df: DataFrame, text_col: str = "text", most: int = SUMMARY_ENTRIES) -> DataFrame:
    """For each task: its heavy pre-tokens with lower bounds of their counts, and one row for all (word null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        total = 0
        for batch in (part for whole in batches for part in small(whole)):
            for text in utf8(batch.column(0)):
                words = text.split()
                total += len(words)
                held.update(words)
                if len(held) > 8 * most:
                    held = shrink(held, most)
        held = shrink(held, most)
        least = total // (4 * TABLE_ENTRIES)
        found = [(k, n) for k, n in held.items() if n > least and len(k) <= LONGEST_KEPT]
        yield pa.RecordBatch.from_arrays([pa.array([None, *[k for k, _ in found]], pa.binary()), pa.array([total, *[n for _, n in found]], pa.int64())], ["word", "n"])

    return df.select(text_col).mapInArrow(run, "word binary, n long")


def frequent(df: DataFrame, text_col: str = "text", entries: int = TABLE_ENTRIES) -> list[bytes]:
    """The pre-tokens with a share of 1/entries or more, by the added summaries: at most ``entries`` of them."""
    added = written(summaries(df, text_col).groupBy("word").agg(F.sum("n").alias("n")), "pretokens")
    total = added.where("word is null").agg(F.sum("n")).first()[0] or 0
    heavy = added.where("word is not null").where(F.col("n") * entries >= total)
    found = [bytes(r.word) for r in heavy.orderBy(F.desc("n"), "word").limit(entries).collect()]
    discard(added)
    return found


@lru_cache(maxsize=4)
def counter(tokenizer_path: str):
    """words -> counts, by the library that the file belongs to."""
    if tokenizer_path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
        return lambda words: [len(x) for x in pieces.encode([w.decode() for w in words], num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path)
    tool.no_truncation()
    tool.no_padding()
    return lambda words: [len(x) for x in tool.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]


def pack(words: list[bytes], counts: list[int]) -> bytes:
    """The table as one block: number of entries, counts, lengths, words."""
    n = len(words)
    return struct.pack(f"<I{n}H{n}B", n, *counts, *[len(w) for w in words]) + b"".join(words)


@lru_cache(maxsize=2)
def unpack(block: bytes) -> dict[bytes, int]:
    (n,) = struct.unpack_from("<I", block)
    numbers = struct.unpack_from(f"<{n}H{n}B", block, 4)
    at, found = 4 + 3 * n, {}
    for count, size in zip(numbers[:n], numbers[n:], strict=True):
        found[block[at : at + size]] = count
        at += size
    return found


class Lengths(dict):
    """Token counts of pre-tokens: the table and, behind it, what this worker has encoded."""

    def __init__(self, fixed: dict[bytes, int], count):
        super().__init__(fixed)
        self.fixed, self.count = fixed, count

    def learn(self, words: set[bytes]) -> dict[bytes, int]:
        """Encodes what isn't known. Gives the counts of those too long to keep."""
        new = [w for w in words if w not in self]
        if not new:
            return {}
        if len(self) + len(new) > CACHE_ENTRIES + len(self.fixed):
            self.clear()
            self.update(self.fixed)
            new = [w for w in words if w not in self]
        long = {}
        for run in slices([len(w) for w in new]):
            for w, n in zip(new[run], self.count(new[run]), strict=True):
                (self if len(w) <= LONGEST_KEPT else long)[w] = n
        return long


_lengths: dict[tuple, Lengths] = {}


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per input row: its id column, ``n_bytes``, ``n_tokens``, ``over_limit`` (n_tokens > limit).

    Special strings in a text count as the library's default has it; none are added. A null text is empty; a long text
    is counted whole. Repeated rows and null ids stay, extra columns are left behind, an empty table gives an empty one. The tokenizer must
    split at white space; sentencepiece files that mark white space inside pieces do not qualify."""
    if tokenizer_path.endswith(".model"):
        raise ValueError("pieces of .model files may hold white space; use whole-text encoding for them")
    words = frequent(df, text_col)
    block = pack(words, counter(tokenizer_path)(words) if words else [])
    shared: Broadcast = df.sparkSession.sparkContext.broadcast(block)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        key = (hash(block), tokenizer_path)
        if key not in _lengths:
            _lengths.clear()
            _lengths[key] = Lengths(unpack(block), counter(tokenizer_path))
        known = _lengths[key]
        for batch in (part for whole in batches for part in small(whole)):
            texts = utf8(batch.column(1))
            split = [t.split() for t in texts]
            distinct: set[bytes] = set()
            distinct.update(*split)
            long = known.learn(distinct)
            get = known.__getitem__ if not long else lambda w, a=known, b=long: b[w] if w in b else a[w]
            counts = [sum(map(get, s)) for s in split]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
