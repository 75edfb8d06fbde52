"""The pipeline, held against a plain version of each stage on what the stage before it kept."""

import hashlib
import random
import sys
from pathlib import Path

import public_tokenizers as P
import tiktoken

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from textloom.llm import bytebpe, cnn, decontam, secrets, simhash_wide  # noqa: E402


def made(seed=6):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("bcdfgklmnprst") + pick.choice("aeiou") for _ in range(pick.randint(1, 3)))
    bench = [(i, " ".join(word() for _ in range(25))) for i in range(5)]
    docs = []
    for i in range(240):
        words = [word() for _ in range(pick.randint(40, 300))]
        if i % 6 == 1:
            words = [w + "%%%" for w in words]
        if i % 10 == 2:
            words += bench[i % 5][1].split() + words[:3]
        if i % 10 == 4:
            words.insert(5, 'token = "%040x"' % pick.getrandbits(160))
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, docs[i][1]) for i in range(0, 60, 3)]
    docs += [(1100 + i, docs[i][1].rsplit(" ", 4)[0] + " new end") for i in range(0, 60, 4)] + [(2000, None), (2001, ""), (None, docs[0][1])]
    return docs, [(i, int("%%%" not in t)) for i, t in docs[:240]], bench


def test_stages_equal_plain_versions(spark, tmp_path):
    docs, labels, bench = made()
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "0 as toxic").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, now, kept = str(tmp_path), df, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        kept[name] = out.collect()
        assert name == "byte-level BPE" or out.columns == df.columns
        now = spark.createDataFrame(kept[name], out.schema) if name != "byte-level BPE" else out
    one, two, three, four, five = kept.values()
    texts, marks = cnn.training_rows(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    net = cnn.train(texts, marks)
    good = [(i, t) for i, t in docs if cnn.score(net, [(t or "").encode()])[0] >= 0.7]
    assert sorted(map(str, good)) == sorted(str((r.doc_id, r.text)) for r in one)
    assert sum(dict(labels)[r.doc_id] for r in one if r.doc_id is not None and r.doc_id < 240) > 150
    rows = [(r.doc_id, r.text, int.from_bytes(simhash_wide.fingerprint((r.text or "").encode()))) for r in one]
    root = {}
    for i, _, f in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        linked = {root[j] for j, _, g in rows if j in root and (f ^ g).bit_count() <= simhash_wide.reach(0.8)}
        root[i] = min(linked | {i})
        root.update({j: root[i] for j, r in root.items() if r in linked})
    assert sorted(str(r.doc_id) for r in two) == sorted([str(x) for x in set(root.values())] + ["None" for i, _, _ in rows if i is None])
    assert not {r.doc_id for r in two} & set(range(1100, 1200))
    items = [decontam.normal(t) for _, t in bench]
    tool = decontam.Matcher(tuple(enumerate(items)), decontam.ERRORS)
    assert sorted(str(r.doc_id) for r in three) == sorted(str(r.doc_id) for r in two if not tool.find(decontam.normal(r.text or "")))
    assert 0 < len(three) < len(two) < len(one) < len(docs)
    assert sorted(str((r.doc_id, r.text)) for r in four) == sorted(str((r.doc_id, r.text and secrets.redact_text(r.text))) for r in three)
    assert all(r.n_chars == len(r.text) for r in four if r.text is not None) and any("[SECRET]" in (r.text or "") for r in four)
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = [(r.doc_id, (r.text or ""), plain.encode_ordinary(r.text or "")) for r in four]
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in five) == sorted(
        str((d, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())) for d, t, i in want
    )
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, five))
