"""Characters of texts counted by class, all classes in one pass over a batch; equal texts of a batch are counted once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.functions import text as T

#: What is counted: characters of a class, or characters in runs of a class of a least length. Patterns are those of ``text``.
CLASSES = {"chinese": T.CJK, "alnum": T.ALNUM, "control": T.CONTROL, "uncommon": T.UNCOMMON, "replaced": r"[?\x{FFFD}]", "mojibake_char": T.MOJIBAKE_CHAR}
COUNTS = (*CLASSES, "garbled_chars", "mojibake_run", "mojibake_token")
_RUNS, _SINGLE = T.MOJIBAKE.removeprefix("(?:").removesuffix(")").split("|")
_FLAGS = {**CLASSES, "garbled_chars": T.GARBLED.removesuffix("{15,}"), "run": _RUNS.removesuffix("{2,}"), "single": _SINGLE.removesuffix("{1,}"), "token": "[" + "".join(sorted({x[0] for x in T.MOJIBAKE_TOKEN.split("|")})) + "]"}
_BIT = {name: 1 << i for i, name in enumerate(_FLAGS)}
#: Characters that are looked at together.
PIECE = 4_000_000


@cache
def _table() -> np.ndarray:
    """For each code point, the classes it is of, a bit each."""
    every = "".join(map(chr, range(0x110000)))
    table = np.zeros(0x110000, np.uint16)
    for name, pattern in _FLAGS.items():
        for m in re.finditer(f"(?:{re.sub(r'\\x\{([0-9A-F]+)\}', lambda x: '\\U' + x[1].zfill(8), pattern)})+", every):
            table[m.start() : m.end()] |= _BIT[name]
    return table


def _in_runs(own: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Per text, characters in runs of flagged ones of a least length; a run ends where its text does."""
    at = np.flatnonzero(own)
    row = np.searchsorted(ends, at, "right")
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(row) != 0)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    long = size >= least
    return np.bincount(row[first[long]], size[long], len(starts)).astype(np.int64)


def _counted(texts: list[str]) -> dict[str, np.ndarray]:
    ends = np.cumsum([len(x) for x in texts])
    starts = ends - [len(x) for x in texts]
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("ascii"), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    flags = _table()[codes]
    there = int(np.bitwise_or.reduce(flags)) if len(flags) else 0
    out = {name: np.zeros(len(texts), np.int64) for name in COUNTS}

    def sums(name: str) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum((flags & _BIT[name]) != 0, out=total[1:])
        return total[ends] - total[starts]

    for name in CLASSES:
        if there & _BIT[name]:
            out[name] = sums(name)
    if there & _BIT["garbled_chars"]:
        out["garbled_chars"] = _in_runs((flags & _BIT["garbled_chars"]) != 0, starts, ends, 15)
    if there & _BIT["run"]:
        out["mojibake_run"] = _in_runs((flags & _BIT["run"]) != 0, starts, ends, 2)
    if there & _BIT["single"]:
        out["mojibake_run"] = out["mojibake_run"] + sums("single")
    if there & _BIT["token"]:
        token = re.compile(T.MOJIBAKE_TOKEN)
        for i in np.flatnonzero(sums("token")):
            out["mojibake_token"][i] = sum(len(x) for x in token.findall(texts[i]))
    return out


def _pieces(values: pa.Array) -> dict[str, np.ndarray]:
    parts, own, size = [], [], 0
    for value in values.cast(pa.binary()):
        own.append((value.as_py() or b"").decode("utf-8", "replace"))
        size += len(own[-1])
        if size > PIECE:
            parts.append(_counted(own))
            own, size = [], 0
    if own or not parts:
        parts.append(_counted(own))
    return {name: np.concatenate([p[name] for p in parts]) for name in COUNTS}


def measured(rows: DataFrame, text_col: str) -> DataFrame:
    """The rows with COUNTS of a text's characters instead of the text."""
    at = rows.columns.index(text_col)
    others = [f for f in rows.schema if f.name != text_col]
    names = [f.name for f in others] + list(COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(at).fill_null("").dictionary_encode()
            found = _pieces(coded.dictionary)
            which = coded.indices.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], *[pa.array(found[n][which]) for n in COUNTS]], names)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], *[f"{n} long" for n in COUNTS]])
    return rows.mapInArrow(count, schema)
