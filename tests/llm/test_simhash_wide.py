import random
import re

import numpy as np
import xxhash

from textloom.llm import simhash, simhash_wide


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {" ".join(words)} if words else set()


def mixed(x, k):
    m = 2**64 - 1
    x = (x + k * 0x9E3779B97F4A7C15) & m
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def plain_fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)]
    bits = [2 * sum(mixed(h, k) >> b & 1 for h in hashes) > len(hashes) for k in range(1, 5) for b in range(64)]
    return np.packbits(bits).tobytes()


def groups(nodes, linked):
    root = {x: x for x in nodes}
    for a in nodes:
        for b in nodes:
            if a < b and root[a] != root[b] and linked(a, b):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root.update({x: new for x, r in root.items() if r == old})
    return root


def test_fingerprints_equal_a_plain_count(odd):
    for t in [*("one two", "a b c d e f", "x y " * 700), *((r.text or "")[:20000] for r in odd.collect())]:
        assert simhash_wide.fingerprint(t.encode()) == plain_fingerprint(t)


def test_layout_follows_the_count_and_keeps_the_chance():
    p = simhash_wide.differing(0.8)
    pick = np.random.default_rng(1)
    for count in (0, 10**6, 10**9):
        segments = simhash_wide.layout(count, 0.8)
        assert count * (segments.shape[1] + 1) <= simhash_wide.RUN << segments.shape[1]
        met = [(flips[segments].sum(axis=1) <= 2).any() for flips in pick.random((2000, 256)) < p]
        assert np.mean(met) > 0.93


def test_links_lose_no_pair_that_meets(spark):
    pick = random.Random(4)
    rows = []
    for _ in range(25):
        at = pick.getrandbits(256)
        for _ in range(8):
            for b in pick.sample(range(256), pick.randint(0, 60)):
                at ^= 1 << b
            rows.append(at.to_bytes(32))
    rows = sorted({*rows, bytes(32), b"\xff" * 32})
    segments = simhash_wide.layout(len(rows), 0.8)
    bits = {x: np.unpackbits(np.frombuffer(x, np.uint8)) for x in rows}

    def linked(a, b):
        apart = bits[a] ^ bits[b]
        return apart.sum() <= 52 and (apart[segments].sum(axis=1) <= 2).any()

    found = simhash_wide.links(spark.createDataFrame([(bytearray(x),) for x in rows], "fp binary"), segments, 52).collect()
    edges = {frozenset((bytes(r.u), bytes(r.v))) for r in found}
    assert all(linked(*sorted(e)) for e in edges)
    assert groups(rows, lambda a, b: frozenset((a, b)) in edges) == groups(rows, linked)


def test_forest_joins_a_large_group_over_blocks():
    pick = np.random.default_rng(5)
    rows = np.repeat(pick.integers(0, 2**63, (2, 4), dtype=np.uint64), 700, axis=0)
    rows[:, 0] ^= np.uint64(1) << pick.integers(0, 64, 1400, dtype=np.uint64)
    us, vs = simhash_wide.forest(rows, 52)
    assert len(us) == 1398 and all((u < 700) == (v < 700) for u, v in zip(us, vs, strict=True))


def test_similar_documents_group(spark, odd, empty):
    pick = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows = [(1, None), (2, ""), (3, "  "), (4, "only words"), (5, "Only  WORDS"), (6, "only word"), (None, "only words")]
    for g in range(12):
        base = [pick.choice(words) for _ in range(pick.choice((120, 900)))]
        for k in range(5):
            own = list(base)
            for _ in range(k * len(base) // 200):
                own[pick.randrange(len(base))] = f"c{k}"
            rows.append((10 * g + k + 10, " ".join(own)))
    rows += [rows[-1]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as root", "2 as fp", "3 as least")
    found = simhash_wide.similar(df).collect()
    least = {r.doc_id: r.component_id for r in found}
    assert len(found) == len(rows) and least[2] == least[3] == least[1] == 1 and least[5] == 4 and least[6] == 6 and least[None] == 4
    assert all(least[10 * g + k + 10] == 10 * g + 10 for g in range(12) for k in range(5))
    kept = simhash.keep_first(df, groups=simhash_wide.similar)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 6, *range(10, 130, 10)]
    assert simhash_wide.similar(empty).count() == 0
    assert simhash_wide.similar(odd).count() == odd.count()


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def edited(pick, words, n, mark):
    own = list(words)
    for i in pick.sample(range(len(own)), n):
        own[i] = f"{mark}{i}"
    return " ".join(own)


def test_only_texts_of_the_similarity_link(spark):
    pick = random.Random(3)
    rows = []
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(300)]
        rows += [(100 * g + k, edited(pick, base, n, f"c{k}x")) for k, n in enumerate((0, 2, 5, 9, 14, 18))]
    hot = [f"hot{i}" for i in range(400)]
    rows += [(10000 + k, edited(pick, hot, 4 + k % 12, f"h{k}x")) for k in range(160)]
    text = dict(rows)
    near = {(a, b) for a in text for b in text if a < b and (a // 100 == b // 100 or a >= 10000) and jaccard(text[a], text[b]) >= 0.8}
    bits = {i: int.from_bytes(simhash_wide.fingerprint(t.encode())) for i, t in rows}
    false = [(a, b) for a in text for b in text if a < b and (bits[a] ^ bits[b]).bit_count() <= 52 and (a, b) not in near]
    assert len(false) > 100
    want = groups(sorted(text), lambda a, b: (a, b) in near)
    found = simhash_wide.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == want


def test_all_pairs_near_under_a_key_are_proposed_or_looked_at_again():
    pick = np.random.default_rng(8)
    fps = np.repeat(pick.integers(0, 2**63, (3, 4), dtype=np.uint64), [3, 40, 600], axis=0)
    fps[:, 1] ^= pick.integers(0, 2**63, len(fps), dtype=np.uint64)
    fps[:, 2] ^= np.uint64(1) << pick.integers(0, 63, len(fps), dtype=np.uint64)
    near = simhash_wide.apart(fps, fps) <= 34
    us, vs, late = simhash_wide.proposed(fps, 34)
    assert near[us, vs].all() and not any(u == v for u, v in zip(us, vs, strict=True))
    pairs = {frozenset(p) for p in zip(us, vs, strict=True)}
    again = {frozenset((int(i), int(j))) for a, b in simhash_wide.across(fps, np.arange(len(fps))[:, None], 34) for i, j in zip(a, b, strict=True)}
    wanted = {frozenset((int(i), int(j))) for i, j in zip(*np.nonzero(near), strict=True) if i != j}
    assert again == wanted
    assert all(p in pairs or late[list(p)].all() for p in wanted)


def test_long_runs_are_keyed_again_and_lose_nothing(spark):
    pick = random.Random(12)
    base = [f"b{i}" for i in range(500)]
    rows = [(k, edited(pick, base, 2 + k % 6, f"h{k}x")) for k in range(220)] + [(1000 + k, " ".join(f"o{k}w{i}" for i in range(60))) for k in range(40)]
    text = dict(rows)
    want = groups(sorted(text), lambda a, b: a < 1000 and b < 1000 and jaccard(text[a], text[b]) >= 0.8)
    found = simhash_wide.similar(spark.createDataFrame(rows, "doc_id long, text string"), long=40).collect()
    assert {r.doc_id: r.component_id for r in found} == want


def test_unlike_texts_of_one_id_stay(spark):
    alpha, one = " ".join(f"alpha{i}" for i in range(40)), " ".join(f"one{i}" for i in range(40))
    df = spark.createDataFrame([(5, alpha), (5, one), (7, one + " end"), (7, one + " end"), (9, alpha), (8, "quite different words stand here")], "doc_id long, text string")
    for found in (simhash.near_duplicates, simhash_wide.similar):
        kept = sorted((r.doc_id, r.text) for r in simhash.keep_first(df, groups=found).collect())
        assert kept == sorted([(5, alpha), (5, one), (8, "quite different words stand here")] + ([(7, one + " end")] if found is simhash.near_duplicates else []))


def test_each_pair_belongs_to_one_of_its_keys():
    pick = np.random.default_rng(4)
    base = pick.integers(0, 256, (40, 32), dtype=np.uint8)
    rows = np.concatenate([base, *[base ^ np.packbits(pick.random((40, 256)) < 0.06, axis=1) for _ in range(4)]])
    segments = simhash_wide.layout(3000, 0.8)
    bits = np.unpackbits(rows, axis=1)
    keys = [set() for _ in rows]
    for _, at, found in simhash_wide.sent_keys(rows, segments):
        for i, key in zip(at.tolist(), found.tolist(), strict=True):
            keys[i].add(key)
    met = 0
    for i in range(60):
        for j in range(i + 1, len(rows)):
            shared = keys[i] & keys[j]
            owners = [k for k in shared if simhash_wide.owned(segments, bits, np.array([i]), np.array([j]), k)[0]]
            assert len(owners) == bool(shared)
            met += bool(shared)
    assert met > 200


def test_pairs_meet_with_the_chance_that_the_layout_is_made_for():
    pick = np.random.default_rng(14)
    for count in (10**4, 10**6, 10**8):
        segments = simhash_wide.layout(count, 0.8)
        base = pick.integers(0, 256, (3000, 32), dtype=np.uint8)
        other = base ^ np.packbits(pick.random((3000, 256)) < simhash_wide.differing(0.8), axis=1)
        met = np.zeros(3000, dtype=bool)
        for (_, at, a), (_, bt, b) in zip(simhash_wide.sent_keys(base, segments), simhash_wide.sent_keys(other, segments), strict=True):
            both = set(zip(at.tolist(), a.tolist(), strict=True)) & set(zip(bt.tolist(), b.tolist(), strict=True))
            met[[i for i, _ in both]] = True
        assert met.mean() > 0.975


def test_sketches_deny_no_pair_of_the_similarity():
    pick = np.random.default_rng(6)
    for n, share in ((40, 0.85), (300, 0.82), (4000, 0.81), (20000, 0.8)):
        for _ in range(40):
            core = pick.integers(0, 2**32, n, dtype=np.uint32)
            extra = round(n * (1 - share) / (2 * share))
            a, b = (np.unique(np.concatenate([core, pick.integers(0, 2**32, extra, dtype=np.uint32)])).tobytes() for _ in range(2))
            assert simhash_wide.may_be_alike(a[: 4 * simhash_wide.SKETCH], b[: 4 * simhash_wide.SKETCH], 0.8) >= simhash_wide.alike(a, b, 0.8)
        other = np.unique(pick.integers(0, 2**32, n, dtype=np.uint32)).tobytes()
        assert not simhash_wide.may_be_alike(a[: 4 * simhash_wide.SKETCH], other[: 4 * simhash_wide.SKETCH], 0.8)
