import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import fertility

MODEL = P.path("piece_bpe_32k.model")


def plain_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeat_words(words):
    ids = np.unique(np.array(words or ["a"]), return_inverse=True)[1] if words else np.empty(0, dtype=np.int64)
    assert fertility.repeat_words(ids) == plain_base(" ".join(words))[4]


def test_rows_equal_a_plain_count(spark, odd, empty):
    more = odd.select("doc_id", "text", "lang", "n_tokens").unionByName(
        spark.createDataFrame([(100 + i, ("alpha beta gamma delta " * (i % 7) + "\nsame line\nsame line\n" + "w%d " % i * 60 + " ".join(f"w{k}" for k in range(80 + i)) + " $#|"), "en") for i in range(60)], "doc_id long, text string, lang string").withColumn("n_tokens", F.lit(1))
    )
    rows = fertility.judge(more, MODEL).collect()
    want = sorted((str(r.doc_id), *plain_base(r.text or "")) for r in more.collect() if len(r.text or "") < 20000)
    found = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows if r.doc_id != 7)
    assert found == want and len(rows) == more.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert fertility.judge(empty, MODEL).count() == 0


def test_measures_equal_a_plain_count(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = "Some words, and 🙂 some more wörds " * 9
    row = fertility.measures(spark.createDataFrame([(1, text)], "doc_id long, text string"), MODEL, lang_col=None).first()
    tokens = [t for w in text.split() for t in model.encode(w)]
    share = np.unique(tokens, return_counts=True)[1] / len(tokens)
    assert row.vocab_tokens == len(tokens)
    assert abs(row.chars_per_token - sum(map(len, text.split())) / len(tokens)) < 1e-12
    assert abs(row.byte_share - np.mean([model.is_byte(t) for t in tokens])) < 1e-12
    assert abs(row.token_entropy - -(share * np.log2(share)).sum() / np.log2(len(tokens))) < 1e-9


def test_bands_reject_what_lies_far_off_and_keep_the_rest(spark):
    import random

    pick = random.Random(5)
    vowels, rest = "aeiou", "bcdfghklmnprst"
    word = lambda: "".join(pick.choice(rest) + pick.choice(vowels) for _ in range(pick.randint(1, 4)))
    clean = [(i, " ".join(word() for _ in range(300)), "xx") for i in range(80)]
    junk = [(1000 + i, " ".join(word() + pick.choice(["%%%", "###", "&&&"]) for _ in range(300)), "xx") for i in range(5)]
    runes = [(2000 + i, " ".join(chr(0x16A0 + pick.randint(0, 70)) * 3 + word() for _ in range(300)), "xx") for i in range(5)]
    rows = {r.doc_id: r.kept for r in fertility.judge(spark.createDataFrame(clean + junk + runes, "doc_id long, text string, lang string"), MODEL).collect()}
    assert sum(rows[i] for i in range(80)) >= 79
    assert not any(rows[2000 + i] for i in range(5)) and not any(rows[1000 + i] for i in range(5))


def test_rare_languages_have_bands_drawn_towards_their_script(spark):
    import random

    pick = random.Random(8)
    word = lambda: "".join(pick.choice("bcdfghklmnprst") + pick.choice("aeiou") for _ in range(pick.randint(1, 4)))
    rows = [(i, " ".join(word() for _ in range(200)), "xx") for i in range(120)] + [(500 + i, " ".join(word() for _ in range(200)), f"l{i}") for i in range(700)]
    rows += [(2000 + i, " ".join(word() + "%%%" for _ in range(200)), f"junk{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.kept for r in fertility.judge(df, MODEL).collect()}
    assert sum(found[i] for i, _, _ in rows[:820]) >= 810 and not any(found[2000 + i] for i in range(3))
    limits = fertility.bands(fertility.measures(df, MODEL)).where("level = 'lang'")
    assert limits.count() == 704


def plain_bands(values, below, above, least):
    bins = sorted(round(v * fertility.STEPS) for v in values)
    half = lambda xs: next(x for k, x in enumerate(xs) if 2 * (k + 1) >= len(xs))
    median = half(bins)
    mad = half(sorted(abs(x - median) for x in bins))
    edge = lambda side, k: (median + side * max(k * 1.4826 * mad, least * fertility.STEPS)) / fertility.STEPS
    return -1e9 if below is None else edge(-1, below), 1e9 if above is None else edge(1, above)


def test_kept_equals_a_plain_computation(spark):
    import random

    pick = random.Random(21)
    syllables = {"xx": ["ba", "ke", "li", "no"], "yy": ["стр", "ива", "по"], "zz": ["ar", "ün", "ök"]}
    rows = []
    for i in range(260):
        lang = pick.choice(["xx", "xx", "xx", "yy", "zz", None])
        word = lambda: "".join(pick.choice(syllables[lang or "xx"]) for _ in range(pick.randint(1, 4))) + pick.choice(["", "", "", "%"]) * (i % 13)  # noqa: B023, E731
        rows.append((i, " ".join(word() for _ in range(pick.choice([30, 120, 300]))), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    measured = fertility.measures(df, MODEL).collect()
    good = [r for r in measured if not (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)]
    want = {}
    for r in measured:
        kept = r in good
        for m, spec in fertility.BANDS.items():
            low, high = plain_bands([x[m] for x in good], *spec)
            for group in ([x for x in good if x.script == r.script], [x for x in good if r.lang is not None and x.lang == r.lang]):
                if group:
                    w, (a, b) = len(group) / (len(group) + fertility.PRIOR), plain_bands([x[m] for x in group], *spec)
                    low, high = w * a + (1 - w) * low, w * b + (1 - w) * high
            kept = kept and low <= r[m] <= high
        want[r.doc_id] = kept
    found = {r.doc_id: r.kept for r in fertility.judge(df, MODEL).collect()}
    assert found == want and 0 < sum(found.values()) < len(found)


def test_scripts():
    assert [fertility.script_of(x) for x in ("", "abc", "Привет", "中文字", "héé", "123", "한국어", "שלום")] == ["none", "latin", "cyrillic", "cjk", "latin", "none", "hangul", "other"]
