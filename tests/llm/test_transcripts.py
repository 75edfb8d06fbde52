import random

import numpy as np

from textloom.llm import transcripts as T


def made(n, seed, marks=0.3):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(pick.randint(1, 7)))
    said = lambda a, b: "\n".join(" ".join(word() for _ in range(pick.randint(a, b))) for _ in range(pick.randint(1, 3)))
    rows = []
    for c in range(n):
        roles = (["system"] if pick.random() < 0.3 else []) + ["user", "assistant"] * pick.randint(1, 4)
        for t, role in enumerate(roles):
            text = {"system": "Be brief. " + said(2, 5), "user": said(2, 10) + "?", "assistant": said(30, 90)}[role]
            rows.append((c, t, role, (role.title() + ": " if pick.random() < marks else "") + text))
    return rows


def model_of(rows):
    found = {}
    for c, _, role, text in rows:
        found.setdefault(c, []).append((role, text))
    return T.count_model(list(found.values()))


def plain_best(model, codes):
    score = {s: model.first[s] + model.emit[codes[0], s] for s in range(T.N)}
    paths = {s: [s] for s in score}
    for code in codes[1:]:
        new = {s: max((score[p] + model.step[p, s], -p) for p in score) for s in range(T.N)}
        paths = {s: paths[-new[s][1]] + [s] for s in new}
        score = {s: new[s][0] + model.emit[code, s] for s in new}
    return max(score.values()), paths


def value(model, codes, path):
    return model.first[path[0]] + model.emit[codes[0], path[0]] + sum(model.step[a, b] + model.emit[c, b] for a, b, c in zip(path, path[1:], codes[1:], strict=False))


def test_blocks_give_the_best_path():
    model, pick = model_of(made(30, 1)), np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        codes = pick.integers(0, int(np.prod(T.SHAPE)), n)
        best, _ = plain_best(model, codes)
        assert abs(value(model, codes, T.viterbi(model, codes).tolist()) - best) < 1e-9
        parts = np.array_split(codes, min(n, 5))
        ends = T.borders([T.matrix(model, p) for p in parts])
        path = [int(s) for p, before, last in zip(parts, [None, *ends[:-1]], ends, strict=True) for s in T.viterbi(model, p, before, last)]
        assert abs(value(model, codes, path) - best) < 1e-9


def test_roles_are_recovered_over_blocks_and_odd_rows(spark):
    rows = made(60, 2)
    long = [(99, t, ("user", "assistant")[t % 2], r[3]) for t, r in enumerate([x for x in made(60, 5, 0) if x[2] != "system"])]
    fine = [r for r in long if r[2] == ("assistant" if len(r[3]) > 150 else "user")]
    df = spark.createDataFrame(rows + long, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n_lines", "'x' as rendered")
    model = T.train(df.where("conv_id < 99"))
    one = {(r.conv_id, r.turn): r for r in T.recover_roles(df, model, block=10_000).collect()}
    many = {(r.conv_id, r.turn): r for r in T.recover_roles(df, model, block=7).collect()}
    assert one == many and len(one) == len(rows) + len(long)
    assert np.mean([one[c, t].role == role for c, t, role, _ in rows]) > 0.95
    assert np.mean([one[c, t].role == role for c, t, role, _ in fine]) > 0.7
    for c, t, _, text in rows:
        assert one[c, t].rendered == T.render(one[c, t].role, text) and one[c, t].n_lines == text.count("\n") + 1
    odd = spark.createDataFrame([(1, 0, None), (1, None, "x"), (None, 0, "y"), (None, None, ""), (1, 0, None), (2, 5, "user: z" * 9000)], "conv_id long, turn long, text string")
    assert T.recover_roles(odd, model).count() == 6 and T.recover_roles(odd.limit(0), model).count() == 0


def test_large_turns_are_solved_in_parts(spark):
    rows = [(1, None, t) for _, _, _, t in made(40, 3)] + [(1, 4, t) for _, _, _, t in made(30, 4)] + [(1, k, t) for k, (_, _, _, t) in enumerate(made(8, 6))] + [(None, None, t) for _, _, _, t in made(20, 8)] + [(2, None, "same")] * 60
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    model = model_of(made(30, 1))
    one, many = (sorted(map(str, T.recover_roles(df, model, block=b).collect())) for b in (100_000, 9))
    assert one == many and len(one) == len(rows)
    blocks = T._blocked(df, 9).groupBy(*T.RUN).count().where("conv_id is null or conv_id = 1").agg({"count": "max"}).first()[0]
    assert blocks < 40


def test_markers_and_rendering(spark):
    assert T.marker("User: hi")[0] == 2 and T.marker("### Assistant: yes")[0] == 3 and T.marker("<|im_start|>system|> x")[0] in (0, 1) and T.marker("plain text") == (0, 0)
    assert T.render("user", "Human: hello ") == "<|user|>\nhello\n<|end|>\n"
    model = model_of(made(40, 9))
    text = "System: be brief\nUser: how are you?\nAssistant: fine,\nthank you\nUser: good"
    assert T.parse_text(model, text) == [("system", "be brief"), ("user", "how are you?"), ("assistant", "fine,\nthank you"), ("user", "good")]
    out = T.parse_transcripts(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), model).collect()
    assert [len(r.turns) for r in sorted(out)] == [4, 1]
