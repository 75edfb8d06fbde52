import random

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import decontam


def plain_distances(pattern, text):
    row = list(range(len(pattern) + 1))
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        yield row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=80), st.text("abcd", max_size=90))
def test_bit_parallel_distance(pattern, text):
    assert list(decontam.distances(decontam.masks(pattern), len(pattern), text)) == list(plain_distances(pattern, text))


def edited(pick, text, n):
    for _ in range(n):
        at = pick.randrange(len(text))
        text = pick.choice([text[:at] + text[at + 1 :], text[:at] + pick.choice("abcxyz") + text[at:], text[:at] + pick.choice("abcxyz") + text[at + 1 :]])
    return text


def corpus(seed=1):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(pick.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(pick.randint(5, 30)))) for i in range(30)] + [(30, "too short"), (31, None), (None, "no id for this one here"), (32, "")]
    docs = []
    for d in range(160):
        text = " ".join(word() for _ in range(pick.randint(0, 60)))
        if d % 2:
            item = pick.choice(items[:30])[1]
            text += "\n " + edited(pick, item, pick.randint(0, int(len(item) * 0.12))).replace(" ", pick.choice([" ", "\n", "  "])).title() + " " + text[:50]
        docs.append((d, text))
    return docs + [(900, None), (901, ""), (docs[1])], items


def test_found_equals_brute_force(spark, odd, empty):
    docs, items = corpus()
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string").selectExpr("*", "1 as distance", "'x' as doc_id")
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'y' as item_id")
    want = {}
    for d, text in docs:
        for i, item in items:
            item = decontam.normal(item or "")
            if i is None or len(item.split()) < 5:
                continue
            best = min(plain_distances(item, decontam.normal(text or "")), default=10**9)
            if best <= int(decontam.ERRORS * len(item)):
                want[d, i] = best
    rows = decontam.contamination(df, bench).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in rows} == want and len(want) > 30 and any(want.values())
    text_of = dict(docs)
    for r in rows:
        span = decontam.normal(text_of[r.doc_id][r.start : r.end])
        item = decontam.normal(dict(items)[r.item_id])
        assert min(plain_distances(item, f" {span} ")) == r.distance and len(span) <= len(item) + r.budget + 14
    clean = {r.doc_id for r in decontam.keep_clean(df, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.contamination(empty, bench.limit(5)).count() == 0 and decontam.contamination(odd, bench.limit(0)).count() == 0
    assert decontam.keep_clean(odd, bench.limit(0)).count() == odd.count()
    blocked = decontam.blocks(bench, most=600)
    assert sum(len(b) for b in blocked) == 31
    in_blocks = decontam.contamination(df, bench, block_bytes=600).collect()
    assert sorted(map(str, in_blocks)) == sorted(map(str, rows))
    assert sorted(str(r) for r in decontam.keep_clean(df, bench, block_bytes=600).collect()) == sorted(str(r) for r in decontam.keep_clean(df, bench).collect())


def test_short_items_stand_as_whole_words_and_long_words_are_searched(spark):
    cjk = "".join(chr(0x4E00 + 37 * i % 9000) for i in range(60))
    bench = spark.createDataFrame([(1, "alpha"), (2, "Beta  gamma"), (3, cjk), (4, "a b c d e"), (5, "  ")], "item_id long, text string")
    texts = {1: "an ALPHA here", 2: "alphabet soup", 3: "beta\ngamma", 4: "beta gammas", 5: "x" + cjk[:20] + "q" + cjk[21:] + "y", 6: cjk[:30], 7: "alpha", 8: "xa b c d ey", 9: None, 10: "not alpha, but alpha", 11: "beta gamma " + "w " * 300_000 + "alpha"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {(r.doc_id, r.item_id, r.places) for r in decontam.contamination(df, bench).collect()}
    assert found == {(1, 1, 1), (3, 2, 1), (5, 3, 1), (7, 1, 1), (8, 4, 1), (10, 1, 1), (11, 1, 1), (11, 2, 1)}
    assert {r.doc_id for r in decontam.keep_clean(df, bench).collect()} == {2, 4, 6, 9}
