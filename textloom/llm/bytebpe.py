"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

A rank file (base64 token, rank) becomes a ``tokenizers`` BPE model: every byte is shown as one printable
character, and every way to cut a token in two known tokens is a merge of that token's rank, which is the
rule by which rank files are applied. Decoding reverses the byte table; since a character may be split over
tokens, bytes are joined before they are read as UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import KERNEL_BYTES, list_array, map_batches, slices

#: Bytes of text that the library encodes at once; what it holds for each token takes many times the text.
BATCH_BYTES = 1 << 18
#: White space after anything else: whatever stands before it is split there by the usual patterns in any case.
_CUT = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The printable character for each byte: itself where Latin-1 shows it, else the next one from U+0100."""
    shown = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    return [chr(b) if shown[b] else chr(256 + sum(not x for x in shown[:b])) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def as_characters(token: bytes) -> str:
    shown = byte_characters()
    return "".join([shown[b] for b in token])


@lru_cache(maxsize=4)
def encoder(rank_path: str, pattern: str):
    """The library's tokenizer for a rank file; made once in each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(rank_path)
    text = {token: as_characters(token) for token in ranks}
    merges = [
        (text[token[:i]], text[token[i:]])
        for token, rank in sorted(ranks.items(), key=lambda x: x[1])
        for i in range(1, len(token))
        if ranks.get(token[:i], rank) < rank and ranks.get(token[i:], rank) < rank
    ]
    made = Tokenizer(models.BPE(vocab={text[token]: rank for token, rank in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


@lru_cache(maxsize=4)
def byte_table(rank_path: str) -> tuple[list[bytes], np.ndarray, list[bytes]]:
    """The bytes of each id, by the reversed byte table; their numbers; and the ids' decimal forms."""
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    vocabulary = {as_characters(token): rank for token, rank in read_ranks(rank_path).items()}
    found: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
    for text, rank in vocabulary.items():
        found[rank] = bytes([byte_of[c] for c in text])
    return found, np.array([len(x) for x in found]), [b"%d" % i for i in range(len(found))]


def pieces(text: str, most: int = KERNEL_BYTES // 4) -> Iterator[str]:
    """Cuts a very long text where white space follows something else; the ids of the pieces add up to its own."""
    begin = 0
    while len(text) - begin > most:
        cut = _CUT.search(text, begin + most)
        if not cut:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def encode_texts(texts: list[str], rank_path: str, pattern: str, offsets: bool = False):
    """Ids of each text, and the character offsets of each id if asked for (two arrays, end exclusive)."""
    tool = encoder(rank_path, pattern)
    parts, owner, shift = [], [], []
    for i, text in enumerate(texts):
        at = 0
        for part in pieces(text):
            parts.append(part)
            owner.append(i)
            shift.append(at)
            at += len(part)
    ids: list[list] = [[] for _ in texts]
    spans: list[list] = [[] for _ in texts]
    for run in slices([len(x) for x in parts], BATCH_BYTES):
        found = (tool.encode_batch if offsets else tool.encode_batch_fast)(parts[run], add_special_tokens=False)
        for i, at, one in zip(owner[run], shift[run], found, strict=True):
            ids[i].append(np.array(one.ids, dtype=np.int32))
            if offsets:
                spans[i].append(np.array(one.offsets, dtype=np.int32).reshape(-1, 2) + at)
    join = lambda x, shape: np.concatenate(x) if x else np.empty(shape, dtype=np.int32)
    return [join(x, 0) for x in ids], [join(x, (0, 2)) for x in spans]


def encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """One row per input row: its id column, ``ids``, ``n_tokens`` and, if asked for, ``starts`` and ``ends``.

    A null or empty text has no ids. Repeated rows stay repeated, extra columns are left behind, an empty table
    gives an empty one. Very long texts are cut at white space, which does not change their ids."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>, n_tokens long" + ", starts array<int>, ends array<int>" * offsets

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        ids, spans = encode_texts(texts, rank_path, pattern, offsets)
        columns = [batch.column(0), list_array(ids), pa.array([len(x) for x in ids], pa.int64())]
        if offsets:
            columns += [list_array([x[:, 0] for x in spans]), list_array([x[:, 1] for x in spans])]
        return pa.RecordBatch.from_arrays(columns, [id_col, "ids", "n_tokens", *["starts", "ends"] * offsets])

    return map_batches(df, [id_col, text_col], schema, kernel)


def decode_ids(ids: np.ndarray, bytes_of: list[bytes], sizes: np.ndarray) -> tuple[bytes, int]:
    """The bytes that ids stand for, and how many of the tokens end inside a character."""
    whole = b"".join(map(bytes_of.__getitem__, ids.tolist()))
    if whole.isascii():
        return whole, 0
    ends = np.cumsum(sizes[ids])[:-1]
    data = np.frombuffer(whole, dtype=np.uint8)
    return whole, int(np.count_nonzero((data[ends[ends < len(data)]] & 0xC0) == 0x80))


def decode(df: DataFrame, rank_path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: its id column, ``keep``, ``decoded`` (bytes) and ``n_split`` (long).

    ``n_split`` counts the tokens that end inside a character. Null ids decode to no bytes; an id outside the
    vocabulary is an error. ``decoded`` is valid UTF-8 again wherever the ids came from a text; read it with
    ``decoded_text`` if they may not have."""
    kept = [id_col, *keep]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", decoded binary, n_split long"

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        (bytes_of, sizes, _), none = byte_table(rank_path), np.empty(0, dtype=np.int32)
        lists = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else none for x in batch.column(batch.num_columns - 1)]
        decoded, split = zip(*[decode_ids(x, bytes_of, sizes) for x in lists], strict=True)
        columns = [batch.column(i) for i in range(len(kept))] + [pa.array(decoded, pa.binary()), pa.array(split, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [*kept, "decoded", "n_split"])

    return map_batches(df, [*kept, ids_col], schema, kernel)


def decoded_text(decoded: Column) -> Column:
    """The bytes as text; where they end or begin inside a character, U+FFFD stands for the broken part."""
    return F.make_valid_utf8(decoded.cast("string"))


def round_trip(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text and decodes its ids in one pass; one row per input row.

    Gives the id column, ``n_tokens``, ``ids_sha256`` (of the decimal ids, joined by one space), ``decoded_sha256``
    and ``n_split``, as ``encode`` and ``decode`` would, without sending ids to the JVM and back."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_split"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, _ = encode_texts([x or "" for x in batch.column(1).to_pylist()], rank_path, pattern)
        (bytes_of, sizes, decimal), rows = byte_table(rank_path), []
        for own in ids:
            decoded, split = decode_ids(own, bytes_of, sizes)
            text = b" ".join(map(decimal.__getitem__, own.tolist()))
            rows.append((len(own), hashlib.sha256(text).hexdigest(), hashlib.sha256(decoded).hexdigest(), split))
        counts, first, second, splits = zip(*rows, strict=True)
        columns = [pa.array(counts, pa.int64()), pa.array(first), pa.array(second), pa.array(splits, pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return map_batches(df, [id_col, text_col], f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long", kernel)
