import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
import tokenizers

from textloom.llm import bytebpe, tokencount

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})


def texts(n):
    pick = random.Random(3)
    some = ["a", "aa", "ha", "--", "=", " ", "  ", "\n", "\t", "é", "中", "🙂", "́", "\x1c", "\x85", "٣", "Ⅷ", "²", "'s", "The", " the"]
    return ["".join(pick.choice(some) for _ in range(pick.randint(0, 60))) for _ in range(n)] + ["".join(chr(pick.choice([pick.randint(0, 0x2FF), pick.randint(0xE000, 0x1FFFF)])) for _ in range(40)) for _ in range(n)]


def test_encoder_equals_the_rank_library(plain):
    cases = texts(1500)
    ids, spans = bytebpe.encode_texts(cases, RANKS, P.PATTERN, offsets=True)
    assert [x.tolist() for x in ids] == [plain.encode_ordinary(x) for x in cases]
    for text, found, span in zip(cases, ids, spans, strict=True):
        assert len(found) == len(span) and all(0 <= a <= b <= len(text) for a, b in span.tolist())


def test_pieces_of_long_texts_add_up(plain):
    text = "\n\n".join(texts(200)) + "x" * 5000 + "  tail\n"
    cut = list(bytebpe.pieces(text, 100))
    assert len(cut) > 20 and "".join(cut) == text
    assert [i for x in cut for i in plain.encode_ordinary(x)] == plain.encode_ordinary(text)


def test_round_trip(spark, odd, empty, plain):
    rows = bytebpe.round_trip(odd, RANKS, P.PATTERN).collect()
    apart = bytebpe.decode(bytebpe.encode(odd, RANKS, P.PATTERN, offsets=True), RANKS, keep=("n_tokens",)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, hashlib.sha256(r.decoded).hexdigest(), r.n_split) for r in apart) == sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256, r.n_split) for r in rows)
    want = [(r.doc_id, plain.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in odd.collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows], key=key) == sorted(
        [(d, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t).hexdigest()) for d, i, t in want], key=key
    )
    assert bytebpe.round_trip(empty, RANKS, P.PATTERN).count() == 0


def test_decoding_handles_split_characters_and_nulls(spark, plain):
    ids = plain.encode_ordinary("a🙂b")
    df = spark.createDataFrame([(1, ids), (2, ids[:2]), (3, None)], "doc_id long, ids array<int>")
    from pyspark.sql import functions as F

    rows = {r.doc_id: r for r in bytebpe.decode(df, RANKS).withColumn("text", bytebpe.decoded_text(F.col("decoded"))).collect()}
    assert rows[1].text == "a🙂b" and rows[1].n_split > 0
    assert rows[2].text.startswith("a�") and bytes(rows[3].decoded) == b""


def test_counts_equal_the_library(spark, odd, empty):
    path = P.path("word_bpe_49k.json")
    tool = tokenizers.Tokenizer.from_file(path)
    found = tokencount.count_tokens(odd, path).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(tool.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect()]
    assert sorted([(str(r.doc_id), r.n_bytes, r.n_tokens) for r in found]) == sorted([(str(d), b, n) for d, b, n in want])
    assert all(r.over_limit == (r.n_tokens > 2048) for r in found)
    assert tokencount.count_tokens(empty, path).count() == 0


def test_pretoken_sums_equal_the_library():
    path = P.path("word_bpe_49k.json")
    tool = tokenizers.Tokenizer.from_file(path)
    count = tokencount.counter(path)
    for text in texts(1500):
        assert sum(count(text.encode().split())) == len(tool.encode(text, add_special_tokens=False).ids), repr(text)


def test_table_is_bounded_and_packs():
    from collections import Counter

    assert len(tokencount.shrink(Counter({i: i for i in range(50)}), 10)) <= 10
    words = [b"a", "é".encode(), b"word"]
    assert tokencount.unpack(tokencount.pack(words, [1, 2, 3])) == dict(zip(words, [1, 2, 3], strict=True))
