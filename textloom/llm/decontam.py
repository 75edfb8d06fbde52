"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k is split into k + 1 pieces: wherever a text holds the item with at most k
edits, one piece stands there unchanged. An automaton finds all exact pieces of all items in one pass over a
text, and Myers' bit-parallel distance verifies the places that they point to.

Texts and items are compared as lower-case words with one space between them. The benchmark is the query set: it
is read in blocks of bounded size, each broadcast and matched against all rows; texts are never shuffled. A
benchmark of one block is one map; a larger one is matched block by block, with one block's automaton in a worker at
a time, and each block's result is written before its broadcast goes.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, map_batches, written

#: Edits allowed for each character of an item.
ERRORS = 0.08
#: Items of fewer words and characters than these allow no error, and stand between word borders.
SHORT_WORDS, SHORT_CHARS = 5, 24
#: Bytes of items that are broadcast at once.
BLOCK_BYTES = 4 << 20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(text: str) -> str:
    return " ".join([w.lower() for w in _WORD.findall(text)])


def split_item(size: int, budget: int) -> list[tuple[int, int]]:
    """budget + 1 pieces of nearly equal length."""
    n = budget + 1
    return [(size * i // n, size * (i + 1) // n) for i in range(n)]


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        found[c] |= 1 << i
    return dict(found)


def distances(mask: dict[str, int], size: int, text: str, anchored: bool = False) -> Iterator[int]:
    """After each character of the text: the least edit distance of the pattern to what ends there.

    It may begin anywhere in the text, or only at the text's beginning if anchored."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    for c in text:
        same = mask.get(c, 0)
        vertical = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up, down = (minus | ~(across | plus)) & full, plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1 | anchored) & full, (down << 1) & full
        plus, minus = (down | ~(vertical | up)) & full, up & vertical
        yield score


class Item:
    def __init__(self, key, text: str, errors: float):
        self.key, self.text = key, text
        self.short = text.count(" ") + 1 < SHORT_WORDS and len(text) < SHORT_CHARS
        self.size, self.budget = len(text), 0 if self.short else int(errors * len(text))
        self.mask, self.back = masks(text), masks(text[::-1])

    def best(self, text: str, a: int, b: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best place in text[a:b], the first of equals, if within the budget."""
        least, end = self.budget + 1, 0
        for i, d in enumerate(distances(self.mask, self.size, text[a:b])):
            if d < least:
                least, end = d, a + i + 1
        if least > self.budget:
            return None
        back = text[max(a, end - self.size - self.budget) : end][::-1]
        length = min((i + 1 for i, d in enumerate(distances(self.back, self.size, back, anchored=True)) if d == least), default=end - a)
        return least, end - length, end


class Matcher:
    """All items of a block, with the automaton of their pieces."""

    def __init__(self, items: tuple[tuple, ...], errors: float):
        import ahocorasick

        self.items = [Item(k, t, errors) for k, t in items]
        where: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        for n, item in enumerate(self.items):
            for a, b in split_item(item.size, item.budget):
                where[item.text[a:b]].append((n, a, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, tuple(places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str) -> list[tuple[Item, int, int, int, int]]:
        """(item, distance, start, end, places) in a normal text: the best place of each item that is within budget."""
        if self.empty or not text:
            return []
        windows: dict[int, list[list[int]]] = {}
        exact: dict[int, list[tuple[int, int, int]]] = {}
        for last, places in self.automaton.iter(text):
            for n, a, b in places:
                item = self.items[n]
                if item.short:
                    if text[last - item.size : last - item.size + 1] in ("", " ") and text[last + 1 : last + 2] in ("", " "):
                        exact.setdefault(n, []).append((0, last + 1 - item.size, last + 1))
                    continue
                begin = last + 1 - b - item.budget
                end = begin + item.size + 2 * item.budget
                open_ = windows.setdefault(n, [])
                if open_ and begin <= open_[-1][1] and open_[-1][0] <= begin:
                    open_[-1][1] = max(open_[-1][1], end)
                else:
                    open_.append([begin, end])
        found = []
        for n, spans in sorted(windows.items()):
            hits = [hit for a, b in merged(spans) if (hit := self.items[n].best(text, max(0, a), min(len(text), b)))]
            if hits:
                found.append((self.items[n], *min(hits), len(hits)))
        found += [(self.items[n], *hits[0], len(hits)) for n, hits in sorted(exact.items())]
        return found


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


@lru_cache(maxsize=2)
def matcher(items: tuple[tuple, ...], errors: float) -> Matcher:
    return Matcher(items, errors)


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[tuple, ...]]:
    """The items, normalised, in blocks of about ``most`` bytes; equal rows once; nulls and texts without words never.

    A benchmark of several blocks is written once, by block, so that each block reads its own rows only."""
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("body")).distinct()
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    count = -(-total // most)
    if count > 1:
        rows = written(rows.withColumn("block", F.pmod(F.xxhash64("item", "body"), F.lit(count)).cast("int")), "benchmark", by="block")
    for i in range(count):
        own = (rows.where(F.col("block") == i) if count > 1 else rows).orderBy("item", "body").collect()
        items = tuple((r[0], t) for r in own if (t := normal(r[1])))
        if items:
            yield items
    if count > 1:
        discard(rows)


def original_span(text: str, a: int, b: int) -> tuple[int, int]:
    """The words of a text that its normal form's [a, b) touches, as a span of the text."""
    at, begin, end = 0, None, 0
    for m in _WORD.finditer(text):
        upto = at + len(m[0].lower())
        if begin is None and a < upto:
            begin = m.start()
        if at < b:
            end = m.end()
        else:
            break
        at = upto + 1
    return begin or 0, end


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", errors: float = ERRORS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of ``docs`` and item found in it: ids, ``distance``, ``budget``, ``start``, ``end`` (code points
    of the text, whole words), ``places`` (separate places within the budget).

    Items of fewer than SHORT_WORDS words and SHORT_CHARS characters must stand as they are, as whole words. A null or
    empty text holds nothing; a long text is searched whole; null ids stay; repeated rows report alike; other columns
    are left behind; an empty benchmark, or an empty table, gives an empty result."""
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, distance int, budget int, start int, end int, places int"

    def matched(shared) -> DataFrame:
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            tool = matcher(shared.value, errors)
            rows, owner = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for item, distance, a, b, places in tool.find(normal(text or "")):
                    owner.append(i)
                    rows.append((item.key, distance, item.budget, *original_span(text, a, b), places))
            if not rows:
                return None
            keys, *numbers = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(keys), *[pa.array(x, pa.int32()) for x in numbers]], [id_col, item_col, "distance", "budget", "start", "end", "places"])

        return map_batches(docs, [id_col, text_col], schema, kernel)

    found = _by_block(docs, blocks(benchmark, item_col, item_text_col, block_bytes), matched)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def _by_block(docs: DataFrame, parts: Iterator[tuple], matched) -> DataFrame | None:
    """``matched(broadcast)`` of the only block as it is, or of several blocks as written tables, each broadcast destroyed; all together."""
    context = docs.sparkSession.sparkContext
    first, second = next(parts, None), next(parts, None)
    if first is None or second is None:
        return None if first is None else matched(context.broadcast(first))
    result = None
    for items in itertools.chain((first, second), parts):
        shared = context.broadcast(items)
        part = written(matched(shared), "contamination")
        shared.destroy()
        result = part if result is None else result.unionByName(part)
    return result


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", errors: float = ERRORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item within its budget, with all columns; items as in ``contamination``.

    Null and empty texts, null ids and repeated rows stay; long texts are searched whole; without items all rows stay.
    Against several blocks the texts' SHA-256 is what tells rows that go."""
    parts = blocks(benchmark, item_col, item_text_col, block_bytes)
    first, second = next(parts, None), next(parts, None)
    if first is None:
        return docs
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            tool = matcher(shared.value, errors)
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            return batch.filter(pa.array([not tool.find(normal(t or "")) for t in texts], pa.bool_()))

        return map_batches(docs, docs.columns, docs.schema, kernel)

    def bad(shared) -> DataFrame:
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            tool = matcher(shared.value, errors)
            hit = [hashlib.sha256(t.encode()).digest() for t in batch.column(0).to_pylist() if t and tool.find(normal(t))]
            return pa.RecordBatch.from_arrays([pa.array(hit, pa.binary())], ["__sha256"]) if hit else None

        return map_batches(docs, [text_col], "__sha256 binary", kernel)

    found = written(_by_block(docs, itertools.chain((first, second), parts), bad).distinct(), "contaminated")
    marked = docs.withColumn("__sha256", F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)))
    return marked.join(found, "__sha256", "left_anti").select(docs.columns)
