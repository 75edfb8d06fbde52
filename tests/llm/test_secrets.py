import hashlib
import random
import re

from textloom.llm import secrets


def plain_base(text):
    out = []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def made(n, seed):
    pick = random.Random(seed)
    bits = ["token", "Token = ", "PASSWORD:", "api_key", "apikey='", "toKen\"", "ſecret", ": ", "=", "\"", "AKIA", "AKIA" + "Z9" * 8, "deadbeef", "0123456789abcdef", "x", " ", "\n", "é", "abcdefghijkl", "A-b_c.d/e+f=g", "secret=", "passwd"]
    return ["".join(pick.choice(bits) for _ in range(pick.randint(0, 25))) for _ in range(n)]


def test_base_spans_equal_plain_patterns():
    for text in made(4000, 2):
        assert [(a, k, b) for a, b, k in secrets.base_spans(text)] == plain_base(text), repr(text)


def test_automata_know_their_formats_and_leave_other_text():
    for name, strings in secrets.labelled_credentials(60, seed=91).items():
        assert sum(secrets.format_of(s) == name for s in strings) >= 57, name
    assert sum(secrets.format_of(s) is not None for s in secrets.ordinary_strings(2000, seed=92)) <= 4


def test_formats_of_varied_lengths_are_known():
    for name, strings in secrets.labelled_credentials(60, seed=95, vary=True).items():
        assert sum(secrets.format_of(s) is not None for s in strings if len(s) >= 20) >= 0.95 * sum(len(s) >= 20 for s in strings), name


def test_candidates_of_any_length_are_scored():
    pick, chars = random.Random(12), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = lambda more, n: "".join(pick.choices(chars + more, k=n))
    for n in (100, 216, 217, 300, 700, 1500):
        for _ in range(20):
            claims = n - 8 - 33 - 43
            key = f"eyJ{drawn('', 33)}.eyJ{drawn('_-', claims)}.{drawn('_-', 42)}x"
            assert secrets.redact_text(f"use {key} here") == "use [SECRET] here", key
    for n in (20, 24, 40, 64, 88, 100, 400):
        found = [secrets.format_of("A" + drawn("+/", n - 2) + "z") for _ in range(40)]
        assert sum(f is not None for f in found) >= 39, n
    assert sum(secrets.format_of(s) is not None for s in secrets.ordinary_strings(3000, seed=94) if len(s) >= 16) <= 4


def test_merging_folds_a_tail_and_keeps_a_head():
    pick = random.Random(4)
    a = secrets.Automaton(["key-" + "".join(pick.choices("0123456789abcdefghijklmnop", k=30)) for _ in range(150)])
    assert len(a.states) < 12
    assert a.likelihood("key-" + "3" * 30) > a.likelihood("kex-" + "3" * 30) + 3
    assert sum(a.ended[q] for q in a.states) == 150


def test_rows(spark, odd, empty):
    key = secrets.labelled_credentials(1, seed=33)["github"][0]
    texts = [*made(300, 5), None, "", f"see {key}, and token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" end", f"api_key={key}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in secrets.digest(secrets.scan(df)).collect()}
    for i, text in enumerate(texts):
        want = plain_base(text or "")
        names = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want]
        r = rows[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("grammar")] == names
    assert rows[len(texts) - 2].spans.startswith("grammar:4:44,assign:") and rows[len(texts) - 1].n_grammar == 0
    assert secrets.digest(secrets.scan(odd)).count() == odd.count() and secrets.digest(secrets.scan(empty)).count() == 0


def test_redaction_keeps_everything_else(spark, odd, empty):
    text = "a token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" b"
    assert secrets.redact_text(text) == "a [SECRET]\" b"
    out = secrets.redact(odd)
    assert out.schema == odd.schema and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert secrets.redact(empty).count() == 0


def test_each_format_is_found_at_half_to_ten_times_its_length():
    pick = random.Random(77)
    for name, pieces in secrets.FORMATS:
        for factor in (0.5, 1, 3, 10):
            made = ["".join(p if isinstance(p, str) else "".join(pick.choices(p[0], k=int(p[1] * factor))) for p in pieces) for _ in range(30)]
            assert sum(secrets.format_of(s) is not None for s in made) >= 29, (name, factor)


def test_addresses_and_names_are_no_secrets():
    for text in ("see https://cdn.Example.com/assets/v2/Xk29dkQpZ81mZ/img.png here", "cdn.example.com/Static/Bundles/MainPage.min.js", "com.Apple.WebKit.Networking.Process", "id 550e8400-e29b-41d4-a716-446655440000", "MAX_RETRY_COUNT_PER_HOST_2024", "InternationalizationConfigurationManager2024"):
        assert secrets.redact_text(text) == text, text
    key = secrets.labelled_credentials(1, seed=3)["github"][0]
    assert secrets.redact_text(f"https://example.com/hook/{key}/x") == "https://example.com/hook/[SECRET]/x"
