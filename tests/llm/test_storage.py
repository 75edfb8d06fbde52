import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from textloom.llm import slots, warc


def test_shards(spark, odd, empty):
    df = odd.unionByName(spark.range(500).select((F.col("id") + 100).alias("doc_id"), F.expr("repeat('x', cast(id as int))").alias("text"), F.lit("l").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_tokens"), F.lit("k").alias("ids")))
    first = slots.first_map(spark, 24)
    maps = first, slots.add_shard(first, 24)
    rows = slots.shard_rows(df, maps).collect()
    texts = Counter((str(r.doc_id), len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((str(r.doc_id), r.size, r.text_crc32) for r in rows) == texts
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
        v = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:8], 16) % slots.SLOTS
        assert (r.vslot, r.shard) == (v, v % 24)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    again = {r.doc_id: (r.shard, r.grown_shard) for r in slots.shard_rows(df.where("doc_id % 3 = 0"), maps).collect()}
    assert all(again[r.doc_id] == (r.shard, r.grown_shard) for r in rows if r.doc_id is not None and r.doc_id % 3 == 0)
    assert slots.shard_rows(empty, maps).count() == 0


def test_maps_are_versioned_and_growth_takes_an_equal_share(spark, tmp_path):
    path = str(tmp_path / "maps")
    slots.save_map(slots.first_map(spark, 24), path)
    slots.save_map(slots.add_shard(slots.load_map(spark, path, 1), 24), path)
    one, two = ({r.vslot: r.shard for r in slots.load_map(spark, path, v).collect()} for v in (1, 2))
    assert len(one) == len(two) == slots.SLOTS and all(two[s] in (one[s], 24) for s in one)
    assert 150 <= Counter(two.values())[24] <= 190
    weights = spark.createDataFrame([(s, 1000 if s % 24 == 0 else 1) for s in one], "vslot int, bytes long")
    heavy = {r.vslot: r.shard for r in slots.add_shard(slots.first_map(spark, 24), 24, weights).collect()}
    total = lambda m, k: sum(1000 if s % 24 == 0 else 1 for s in m if m[s] == k)
    assert total(heavy, 24) > 0.03 * sum(1000 if s % 24 == 0 else 1 for s in one)


def test_equal_rows_and_a_hot_id_are_numbered_without_gaps(spark):
    rows = [(None, "")] * 300 + [(None, f"t{i}") for i in range(400)] + [(5, "x")] * 40 + [(i, "y" * (i % 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    first = slots.first_map(spark, 24)
    found = slots.shard_rows(df, (first, slots.add_shard(first, 24))).collect()
    by, held = {}, Counter()
    for r in found:
        by.setdefault(r.shard, []).append(r)
        held[r.vslot] += r.size
    assert len(found) == len(rows) and all(r.slot_bytes == held[r.vslot] for r in found)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        order = [(r.vslot, r.text_crc32 % slots.PARTS, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in sorted(own, key=lambda r: r.slot)]
        assert order == sorted(order)


def test_rebalancing_weighs_slots_by_their_bytes(spark):
    sizes = spark.createDataFrame([(v, 5000 if v % 24 == 3 else 10 + v % 7, 1) for v in range(slots.SLOTS)], "vslot int, bytes long, rows long")
    before, after = slots.first_map(spark, 24), slots.rebalanced(slots.first_map(spark, 24), sizes)
    weigh = lambda m: [r.b for r in m.join(sizes, "vslot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    assert max(weigh(before)) > 10 * sorted(weigh(before))[0] and max(weigh(after)) < 1.25 * min(weigh(after))
    one, two = ({r.vslot: r.shard for r in m.collect()} for m in (before, after))
    assert len(two) == slots.SLOTS and all(one[v] == 3 for v in one if one[v] != two[v]) and after.first().version == 2


def test_record_ids_are_unique(spark, tmp_path):
    rows = [(1, "u", "a" * 200), (1, "u", "a" * 200), (1, "u", "b" * 200), (2, "u", "a" * 200), (None, "u", "c"), (None, "u", "c"), (3, "u", "d" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(warc.planned(df), "file://" + str(tmp_path))
    names = [h["warc-record-id"] for r in manifest.collect() for h, _ in warc.read_records(r.path)]
    assert len(names) == len(set(names)) == len(rows)
    found = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.read_archives(manifest).collect())
    assert found == sorted([("1", "response", None)] * 3 + [("2", "revisit", 1)] + [("None", "response", None)] * 2 + [("3", "response", None)])
    assert warc.read_archives(manifest).rdd.getNumPartitions() == manifest.count()


def test_archives_round_trip(spark):
    same = "<p>" + "same " * 40
    rows = [(1, "http://a/x y\n", same), (2, None, same), (5, "http://b", same), (3, "u", None), (4, "u", None), (None, "u", "x" * 200), (6, "u", "ü" * 300 + "\r\n\r\n"), (6, "u", "ü" * 300 + "\r\n\r\n"), (7, "u", "small"), (8, "u", "small")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload_bytes", "'k' as digest", "2 as first").repartition(3)
    found = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(df).collect()), key=str)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = min((j for j, _, g in rows if g == h and j is not None), default=None)
        again = len(data) >= 100 and first is not None and first != i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert found == sorted(want, key=str)
    assert warc.archive(df.limit(0)).count() == 0


def test_archive_files(spark, tmp_path):
    out = warc.Writer("file://" + str(tmp_path))
    payloads = [b"<html>" + str(i).encode() * (i % 300) + b"</html>" for i in range(3000)] + [b"z" * 300_000]
    for i, p in enumerate(payloads):
        out.add(warc.record(i, f"http://h/{i}", p, hashlib.sha256(p).hexdigest(), None, "2000-01-01T00:00:00Z"))
    ((path, count, size),) = out.finish()
    assert count == len(payloads) and size < 0.5 * sum(map(len, payloads))
    raw = open(path.removeprefix("file://"), "rb").read()
    assert raw[:4] == bytes.fromhex("5d2a4d18")
    read = list(warc.read_records(path))
    assert [b.partition(b"\r\n\r\n")[2] for _, b in read] == payloads and read[5][0]["warc-record-id"] == f"<{warc.NAME}5>"
