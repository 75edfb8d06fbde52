import random
import zlib

import numpy as np

from textloom.llm import cnn


def plain_score(net, text):
    counts = max(1, -(-(len(text) - (cnn.CHUNK - cnn.HOP)) // cnn.HOP))
    pooled = []
    for k in range(counts):
        chunk = text[k * cnn.HOP : k * cnn.HOP + cnn.CHUNK].ljust(cnn.CHUNK, b"\0")
        under = np.array([net.embed[list(chunk[p : p + cnn.WIDTH])].reshape(-1) for p in range(0, cnn.CHUNK - cnn.WIDTH + 1, cnn.STRIDE)])
        pooled.append(np.maximum((under @ net.filters).max(axis=0) + net.bias, 0))
    both = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
    return 1 / (1 + np.exp(-(both @ net.weights + net.offset[0])))


def samples(n, seed):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("bcdfgklmnprst") + pick.choice("aeiou") for _ in range(pick.randint(1, 3)))
    good = [" ".join(word() for _ in range(pick.randint(5, 400))) for _ in range(n)]
    bad = [" ".join(word() + pick.choice(["%%%", "$$$", " |"]) for _ in range(pick.randint(5, 400))) for _ in range(n)]
    return good, bad


def test_chunks_cover_the_whole_text():
    for n in (0, 1, cnn.CHUNK - 1, cnn.CHUNK, cnn.CHUNK + 1, cnn.CHUNK + cnn.HOP, 5000):
        text = bytes(random.Random(n).randbytes(n))
        rows, begins = cnn.chunks([text])
        whole = np.zeros((len(rows) - 1) * cnn.HOP + cnn.CHUNK, dtype=np.uint8)
        for k, row in enumerate(rows):
            whole[k * cnn.HOP : k * cnn.HOP + cnn.CHUNK] = row
        assert whole[:n].tobytes() == text and not whole[n:].any() and begins.tolist() == [0]


def test_scores_equal_a_plain_network():
    net = cnn.fresh(3)
    texts = [b"", b"short", "ünï ".encode() * 300, bytes(range(256)) * 5]
    assert np.allclose(cnn.score(net, texts), [plain_score(net, t) for t in texts], atol=1e-5)


def test_gradients_equal_differences():
    net = cnn.fresh(4)
    texts, labels = [b"some text " * 70, b"other $$$ text", b""], np.array([1, 0, 1], dtype=np.float32)

    def loss():
        p = cnn.score(net, texts)
        return -np.mean(np.where(labels == 1, np.log(p), np.log(1 - p)))

    for part, slope in zip(net.parts(), cnn.gradients(net, texts, labels), strict=True):
        for i in np.argsort(-np.abs(slope).reshape(-1))[:3]:
            at, keep = np.unravel_index(i, part.shape), part.reshape(-1)[i]
            part[at] = keep + 1e-2
            up = loss()
            part[at] = keep - 1e-2
            down = loss()
            part[at] = keep
            assert abs((up - down) / 2e-2 - slope[at]) < 0.05 * abs(slope[at]) + 2e-3


def test_held_out_accuracy_and_odd_rows(spark, odd, empty):
    good, bad = samples(250, 1)
    rows = [(i, t) for i, t in enumerate([x for pair in zip(good, bad, strict=True) for x in pair])]
    docs = spark.createDataFrame(rows + [(10_000, None), (10_001, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i, _ in rows] + [(None, 1, 0), (3, None, 0), (99_999, 1, 0)], "doc_id long, quality int, toxic int")
    found = cnn.judged(docs, labels).collect()
    assert len(found) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    unseen = [(r.doc_id % 2 == 0) == bool(r.predicted) for r in found if r.held_out and r.doc_id < 10_000]
    assert len(unseen) > 80 and sum(unseen) / len(unseen) > 0.9
    assert cnn.judged(odd, labels.limit(0)).count() == odd.count()
    assert cnn.judged(empty, labels).count() == 0
    kept = cnn.keep_good(docs.where("doc_id < 10000"), labels)
    assert kept.columns == docs.columns and 200 < kept.count() < 300


def test_training_rows_are_bounded_and_not_held_out(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('ab ', 100) as text")
    labels = spark.range(4000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    texts, marks = cnn.training_rows(docs, labels, most_rows=50)
    assert len(texts) == len(marks) == 50
    texts, _ = cnn.training_rows(docs, labels, most_rows=500, most_bytes=300 * 64)
    assert len(texts) == 64
