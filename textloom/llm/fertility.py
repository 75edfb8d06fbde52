"""Quality rules on tokeniser fertility: how a public vocabulary takes a text apart.

For each document: characters per token, the share of byte-fallback tokens, and the entropy of the tokens as a
share of the most that so many tokens could have, averaged over windows of tokens so that length does not
matter. Words (``[^\\x20\\x09-\\x0D]+``) are encoded one by one by a sentencepiece vocabulary with byte fallback.

The rejection bands belong to a language. They lie a number of deviations around the median of all documents of that
language that pass the base rules, both taken from exact histograms, so a run over the same rows always sets the same
bands. What few documents say is drawn towards what more of them say: the edges for a document are the weighted mean of
its language's and its script's, and a script's of its own and those of all documents, with weight n / (n + PRIOR) for
a group of n documents. So every language has a band of its own, and none is cut off by a rank or a least size.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import map_batches, release, slices, tables_made, utf8, written

#: Characters that count as symbols. Fixed values.
SYMBOLS = "#*$%&|<>"
#: Documents that a group must have for its own edges to weigh as much as those of the wider group.
PRIOR = 25
#: Steps of a histogram for one unit of a measure.
STEPS = 200
CACHE_WORDS = 1 << 17
WINDOW = 256
#: measure -> (deviations below the median, deviations above, least half width); None: open on that side.
BANDS = {
    "chars_per_token": (4.5, 6.0, 0.15),
    "byte_share": (None, 6.0, 0.05),
    "token_entropy": (4.0, None, 0.05),
}

SCHEMA = "lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, vocab_tokens long, chars_per_token double, byte_share double, token_entropy double"


def repeat_words(ids: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key = ids[:n].astype(np.int64)
    for k in range(1, width):  # renumbered at each step, so that no product overflows
        _, key = np.unique(key, return_inverse=True)
        key = key.astype(np.int64) * (int(ids.max()) + 1) + ids[k : n + k]
    _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[where] > 1)
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(width):
        covered[hit + k] = True
    return int(covered.sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


#: First code points of the blocks of the scripts told apart; fixed values.
SCRIPTS = (("latin", 0x41), ("greek", 0x370), ("cyrillic", 0x400), ("other", 0x530), ("arabic", 0x600), ("other", 0x780), ("indic", 0x900), ("other", 0xE00), ("latin", 0x1E00), ("greek", 0x1F00), ("none", 0x2000), ("cjk", 0x3040), ("hangul", 0xAC00), ("cjk", 0xF900), ("other", 0xFB00), ("cjk", 0x20000))


def script_of(text: str) -> str:
    """The script of most letters, by code point; "none" without letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "none"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = codes[(codes >= 0x80) | ((codes | 32) - 97 < 26)]
    if not len(letters):
        return "none"
    kinds = np.bincount(np.searchsorted([x for _, x in SCRIPTS], letters, side="right") - 1, minlength=len(SCRIPTS))
    total: dict[str, int] = {}
    for (name, _), n in zip(SCRIPTS, kinds.tolist(), strict=True):
        total[name] = total.get(name, 0) + n * (name != "none")
    return max(sorted(total), key=total.get)


class Words:
    """Numbers the words a worker has met and keeps their tokens end to end, up to a bound."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.reset()

    def reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.sizes = np.empty(0, dtype=np.int64)
        self.begins = np.empty(0, dtype=np.int64)
        self.tokens = np.empty(0, dtype=np.int32)

    def learn(self, words: set[bytes]) -> None:
        if len(self.number) + len(words) > CACHE_WORDS:
            self.reset()
        new = [w for w in words if w not in self.number]
        for run in slices([len(w) for w in new]):
            found = self.model.encode([w.decode() for w in new[run]], num_threads=1)
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            self.begins = np.concatenate([self.begins, len(self.tokens) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.tokens = np.concatenate([self.tokens, *[np.array(x, dtype=np.int32) for x in found]])
            self.number.update(zip(new[run], range(len(self.number), len(self.number) + len(found)), strict=True))

    def tokens_of(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.tokens[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[ids] - ends + sizes, sizes)]


@lru_cache(maxsize=1)
def vocabulary(model_path: str) -> Words:
    return Words(model_path)


def entropy(tokens: np.ndarray) -> float:
    """The entropy over windows of tokens as a share of its maximum, weighted by their sizes; 1 for up to one token."""
    n = len(tokens)
    if n < 2:
        return 1.0
    count = max(1, round(n / WINDOW))
    window = np.arange(n, dtype=np.int64) * count // n
    key = window * (1 << 32) + tokens
    found, counts = np.unique(key, return_counts=True)
    size = np.bincount(window, minlength=count)
    spread = np.bincount(found >> 32, weights=counts * np.log2(counts), minlength=count)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where(size > 1, (np.log2(size) - spread / size) / np.log2(size), 1.0)
    return float((share * size).sum() / n)


def measures(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per input row: its id column and the measures named in ``SCHEMA``. A null text has no words."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col), F.col(text_col), (F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")).alias("__lang"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = vocabulary(model_path)
        rows = []
        texts = utf8(batch.column(1))
        split = [t.split() for t in texts]
        distinct: set[bytes] = set()
        distinct.update(*split)
        words.learn(distinct)
        for text, own in zip(texts, split, strict=True):
            whole = text.decode()
            ids = np.fromiter(map(words.number.__getitem__, own), dtype=np.int64, count=len(own))
            tokens = words.tokens_of(ids)
            chars = len(whole) - sum(map(whole.count, " \t\n\v\f\r"))
            n = len(tokens)
            rows.append((
                script_of(whole), len(own), chars, sum(map(whole.count, SYMBOLS)), dup_lines(text), repeat_words(np.unique(ids, return_inverse=True)[1]) if len(ids) else 0,
                n, chars / n if n else 0.0, float(words.is_byte[tokens].mean()) if n else 0.0, entropy(tokens),
            ))
        types = [pa.string()] + [pa.int64()] * 6 + [pa.float64()] * 3
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], [id_col, *[x.split()[0] for x in SCHEMA.split(", ")]])

    return map_batches(source, [id_col, text_col, "__lang"], f"`{id_col}` {kind}, {SCHEMA}", kernel)


def base_failed(n_words, n_repeat_words):
    """Too short, or over half of its words in repeated windows."""
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def bands(measured: DataFrame) -> DataFrame:
    """(level, name) -> ``docs`` and the edges of each band as they are: for languages, scripts, and all documents."""
    good = measured.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    groups = F.array(*[F.struct(F.lit(k).alias("level"), v.alias("name")) for k, v in (("lang", F.col("lang")), ("script", F.col("script")), ("all", F.lit("")))])
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m) * STEPS).cast("long").alias("bin")) for m in BANDS])
    bins = good.select("lang", "script", F.explode(values).alias("v")).groupBy("lang", "script", "v.measure", "v.bin").agg(F.count("*").alias("n"))
    bins = bins.select(F.explode(groups).alias("g"), "measure", "bin", "n").where("g.name is not null").groupBy("g.level", "g.name", "measure", "bin").agg(F.sum("n").alias("n"))
    bins = written(bins, "fertility-bins")
    sizes = bins.where(F.col("measure") == next(iter(BANDS))).groupBy("level", "name").agg(F.sum("n").alias("docs"))
    own = Window.partitionBy("level", "name", "measure")
    bins = bins.join(sizes, ["level", "name"])
    half = lambda order: F.sum("n").over(own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) * 2 >= F.col("docs")
    middle = bins.withColumn("low", half("bin"))
    middle = middle.withColumn("median", F.min(F.when(F.col("low"), F.col("bin"))).over(own)).withColumn("off", F.abs(F.col("bin") - F.col("median")))
    spread = middle.withColumn("near", F.sum("n").over(own.orderBy("off").rangeBetween(Window.unboundedPreceding, 0)) * 2 >= F.col("docs"))
    edges = spread.groupBy("level", "name", "docs", "measure").agg(F.min("median").alias("median"), F.min(F.when(F.col("near"), F.col("off"))).alias("mad"))
    wide = edges.groupBy("level", "name", "docs")
    out = []
    for m, (below, above, least) in BANDS.items():
        own_m = F.col("measure") == m
        at = lambda side, k, own_m=own_m, least=least: F.max(F.when(own_m, (F.col("median") + side * F.greatest(k * 1.4826 * F.col("mad"), F.lit(least * STEPS))) / STEPS))
        out += [(at(-1, below) if below is not None else F.lit(-1e9)).alias(f"{m}_low"), (at(1, above) if above is not None else F.lit(1e9)).alias(f"{m}_high")]
    return wide.agg(*out)


def judge(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per input row: its id column, the measures, ``base_failed`` and ``kept``.

    kept is false if base_failed, or if a measure lies outside the edges for the document's language and script.
    Without any document that passes the base rules only these speak. Null or empty texts fail them; a long text is
    measured whole; a null language, or one without such documents, has its script's edges; null ids stay; repeated
    rows are judged alike; an empty table gives an empty one; other columns are left behind."""
    spark, standing = df.sparkSession, tables_made()
    rows = written(measures(df, model_path, id_col, text_col, lang_col), "fertility")
    limits = written(bands(rows), "fertility-bands")  # the planner knows its size; scripts are few, languages need not be
    release(spark, standing, rows, limits)
    edges = [c for m in BANDS for c in (f"{m}_low", f"{m}_high")]
    joined = rows
    for level, key in (("lang", F.col("lang")), ("script", F.col("script")), ("all", F.substring("script", 1, 0))):
        side = limits.where(F.col("level") == level).select(F.col("name").alias(f"__{level}"), F.col("docs").alias(f"__{level}_docs"), *[F.col(c).alias(f"__{level}_{c}") for c in edges])
        joined = joined.join(side if level == "lang" else F.broadcast(side), key == F.col(f"__{level}"), "left")

    def edge(name: str, open_at: float) -> Column:
        found = F.coalesce(F.col(f"__all_{name}"), F.lit(open_at))
        for level in ("script", "lang"):
            weight = F.coalesce(F.col(f"__{level}_docs") / (F.col(f"__{level}_docs") + PRIOR), F.lit(0.0))
            found = weight * F.coalesce(F.col(f"__{level}_{name}"), F.lit(0.0)) + (1 - weight) * found
        return found

    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    inside = F.lit(True)
    for m in BANDS:
        inside = inside & F.col(m).between(edge(f"{m}_low", -1e9), edge(f"{m}_high", 1e9))
    return joined.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"),
        "vocab_tokens", "chars_per_token", "byte_share", "token_entropy", "script",
    )
