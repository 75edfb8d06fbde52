import random

from textloom.llm.components import attach, component_ids, components


def plain(edges):
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_components_of_hubs_chains_and_random_edges(spark):
    pick = random.Random(2)
    edges = [(1000, i) for i in range(1, 400)] + [(i, i + 1) for i in range(2000, 2060)] + [(pick.randrange(3000, 3200), pick.randrange(3000, 3200)) for _ in range(150)] + [(5, 5), (7000, 3)]
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = plain([e for e in edges if e[0] != e[1]])
    assert {r.node: r.root for r in found} == want and len(found) == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows_of_a_hot_key_are_dealt_out_and_none_is_lost(spark):
    rows = [(7, i) for i in range(900)] + [(i % 50 + 100, i) for i in range(300)] + [(7, 3), (999, 1)]
    df = spark.createDataFrame(rows, "key long, x long").repartition(4)
    found = spark.createDataFrame([(7, "hot"), *[(k, f"k{k}") for k in range(100, 150)], (5, "nobody")], "key long, name string")
    got = sorted((r.key, r.x, r.name) for r in attach(df, found, "key").collect())
    assert got == sorted((k, x, "hot" if k == 7 else f"k{k}") for k, x in rows if k != 999)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    per = attach(df, found, "key").where("key = 7").rdd.glom().map(len).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(per) < 700  # more than one task


def test_component_ids_take_the_smallest_id(spark):
    nodes = spark.createDataFrame([(1, 50), (2, 40), (3, None), (4, 7)], "fp long, least long")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    assert {r.fp: r.component_id for r in component_ids(nodes, edges).collect()} == {1: 40, 2: 40, 3: 40, 4: 7}
