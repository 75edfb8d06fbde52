import random
import re

import numpy as np
import xxhash

from textloom.llm import simhash
from textloom.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 3:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_fingerprints_equal_a_plain_count(odd):
    for r in odd.collect():
        assert simhash.fingerprint((r.text or "").encode()) == plain_fingerprint((r.text or "")[:10**6])


def flipped(pick, fp, n):
    for b in pick.sample(range(64), n):
        fp ^= 1 << b
    return fp


def clusters(seed, groups, size, bits=None):
    pick = random.Random(seed)
    fps = []
    for _ in range(groups):
        at = pick.getrandbits(64)
        for _ in range(size):
            at = flipped(pick, at, pick.randint(0, 5))
            fps.append(at)
    return fps


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def found_groups(spark, fps, defer=True):
    df = spark.createDataFrame([(signed(x),) for x in set(fps)], "fp long")
    first = simhash.links(simhash.first_keys(df), 3, defer).collect()
    edges = [(r.u, r.v) for r in first if r.tag is None]
    late = [(r.u, r.v, r.tag) for r in first if r.tag is not None]
    if late:
        second = simhash.second_keys(spark.createDataFrame(late, "fp long, key long, tag long"))
        edges += [(r.u, r.v) for r in simhash.links(second, 3, False).collect()]
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 3 for u, v in edges)
    assert len(edges) <= 70 * len(fps)
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges or [(1, 1)], "u long, v long")).collect()}
    return [roots.get(signed(x), signed(x)) for x in fps]


def same_partition(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b, strict=True)))


def test_links_lose_nothing(spark):
    fps = clusters(1, 60, 12) + [0, 1, 3, 7, 15, 2**63, 2**64 - 1, 2**63 + 1]
    assert same_partition(found_groups(spark, fps), plain_groups(fps))


def test_long_runs_are_keyed_again(spark, monkeypatch):
    pick = random.Random(2)
    base = pick.getrandbits(64)
    dense = [base ^ sum(1 << b for b in range(12) if m >> b & 1) for m in pick.sample(range(4096), 350)]
    far = [base ^ (0x5A5A00 + 0x1000000 * k) for k in range(40)]
    fps = dense + far + clusters(3, 20, 5)
    monkeypatch.setattr(simhash, "RUN", 64)
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules["textloom.llm.simhash"])
    try:
        assert same_partition(found_groups(spark, fps), plain_groups(fps))
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules["textloom.llm.simhash"])


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(50, 50), (60, 61), (61, 60), (None, 3)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {roots[i] for i in range(100, 141)} == {100} and {roots[i] for i in range(7, 30)} == {7}
    assert roots[61] == roots[60] == 60 and 50 not in roots


def test_near_duplicates_equal_brute_force(spark, odd, empty):
    pick = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, "  "), (None, "only words")]
    for g in range(15):
        base = [pick.choice(words) for _ in range(300)]
        for k in range(6):
            own = list(base)
            for _ in range(k // 2):
                own[pick.randrange(300)] = "changed"
            rows.append((10 * g + k + 10, " ".join(own)))
    rows += [rows[-1]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    fps = [plain_fingerprint(t or "") for _, t in rows]
    groups = plain_groups(fps)
    least = {g: min((d for (d, _), h in zip(rows, groups, strict=True) if h == g and d is not None), default=None) for g in groups}
    assert found == sorted([(d, f"{f:016x}", least[g]) for (d, _), f, g in zip(rows, fps, groups, strict=True)], key=str)
    kept = simhash.keep_first(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted({str(x) for x in least.values()} | {"None"}) if None not in least.values() else True
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0
    assert simhash.keep_first(odd).columns == odd.columns


def test_keep_first_keeps_every_component_of_a_repeated_id(spark):
    from textloom.llm import simhash_wide

    one, two = (" ".join(f"{c}{i}" for i in range(200)) for c in "ab")
    df = spark.createDataFrame([(5, one), (5, two), (7, two + " end"), (8, one)], "doc_id long, text string")
    for groups in (simhash.near_duplicates, simhash_wide.similar):
        assert sorted((r.doc_id, r.text) for r in simhash.keep_first(df, groups=groups).collect()) == [(5, one), (5, two)]
