"""Transcript parsing: a hidden Markov model recovers who speaks, then turns are rendered in one canonical form.

The units are lines. A state is a role, and whether a line begins a turn or goes on with it. What is seen of a
line is its speaker marker, its length, whether it asks, what it looks like, and whether the source began a new
entry with it. The model is counted from a bounded sample of labelled conversations; Viterbi's algorithm gives
the most likely roles of a whole conversation.

A long conversation is cut into blocks of entries. The best score between any two states over a block is a
max-plus matrix; the matrices of a conversation give the states at the blocks' borders, and each block is then
solved by itself between its borders. That is the same path as over the conversation in one piece, but no task
holds more than a block of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textloom.llm.common import map_batches, small, written

ROLES = ("system", "user", "assistant", "tool")
#: Names that mark a speaker. Fixed values.
NAMES = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "customer", "client", "q", "question", "prompt", "you", "me"),
    "assistant": ("assistant", "ai", "bot", "agent", "a", "answer", "gpt", "model", "response"),
    "tool": ("tool", "function", "observation", "output", "ipython"),
}
_ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
_MARK = re.compile(r"^[ \t]*(?:<\|(?:im_start\|>)?|\[/?|\*\*|#{1,6} *|<)?([A-Za-z]{1,12})(?:\|>|\]|\*\*:?|>|:\*\*|:)(?:[ \t]|$)")
LENGTHS = (1, 40, 120, 250, 500, 1000)
STATES = [(r, begins) for r in range(len(ROLES)) for begins in (True, False)]
N = len(STATES)
#: Kinds of features with their numbers of values.
SHAPE = (len(ROLES) + 2, len(LENGTHS) + 1, 2, 4, 2)
#: Entries of one conversation that are solved at once.
BLOCK = 256
TRAIN_CONVERSATIONS, TRAIN_ENTRIES = 1500, 20000


def marker(line: str) -> tuple[int, int]:
    """(0 without a marker, 1 + role, or one more for an unknown speaker; where the line's own text begins)."""
    m = _MARK.match(line)
    if not m:
        return 0, 0
    role = _ROLE_OF.get(m[1].lower())
    return (1 + ROLES.index(role) if role else len(ROLES) + 1), m.end()


def feature(line: str, entry: bool) -> int:
    """All that is seen of a line, as one number."""
    mark, at = marker(line)
    text = line[at:].strip()
    size = sum(len(text) >= x for x in LENGTHS)
    look = 1 if text[:1] in ("-", "*", "#", "|", "`", ">") else 2 if re.match(r"\d+[.)]", text) else 3 if text[:1] in ("{", "[", "<") else 0
    code = 0
    for value, count in zip((mark, size, int(text.endswith("?")), look, int(entry)), SHAPE, strict=True):
        code = code * count + value
    return code


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


class Model:
    """Log-probabilities of first states, steps and line features."""

    def __init__(self, first: np.ndarray, step: np.ndarray, seen: list[np.ndarray]):
        log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        self.first, self.step = log(first), log(step)
        codes = np.indices(SHAPE).reshape(len(SHAPE), -1)
        self.emit = sum(log(part)[:, values] for part, values in zip(seen, codes, strict=True)).T.copy()  # codes x states


def count_model(conversations: list[list[tuple[str, str]]]) -> Model:
    """From labelled conversations of (role, text) entries; what a marker names is known beforehand."""
    first, step = np.full(N, 0.5), np.full((N, N), 0.5)
    step[:, :] = [[0.5 if begins else (0.5 if r == s else 1e-3) for s, begins in STATES] for r, _ in STATES]
    first[[i for i, (_, begins) in enumerate(STATES) if not begins]] = 1e-3
    seen = [np.full((N, n), 0.5) for n in SHAPE]
    for i, (r, begins) in enumerate(STATES):
        seen[0][i] = 0.01  # a marker that names another role
        seen[1][i] = 3.0
        seen[0][i, 0] = 20
        if begins:
            seen[0][i, 1 + r] = 10
        seen[4][i] = (0.2, 5) if begins else (5, 0.05)
    for entries in conversations:
        before = None
        for role, text in entries:
            if role not in ROLES:
                continue
            for k, line in enumerate(lines_of(text)):
                state = STATES.index((ROLES.index(role), k == 0))
                if before is None:
                    first[state] += 1
                else:
                    step[before, state] += 1
                for part, value in zip(seen, np.unravel_index(feature(line, k == 0), SHAPE), strict=True):
                    part[state, value] += 1
                before = state
    return Model(first, step, seen)


def viterbi(model: Model, codes: np.ndarray, before: int | None = None, last: int | None = None) -> np.ndarray:
    """The best states of a run of lines that follows the state ``before`` and ends in ``last``, where given."""
    score = (model.first if before is None else model.step[before]) + model.emit[codes[0]]
    back = np.zeros((len(codes), N), dtype=np.uint8)
    for i in range(1, len(codes)):
        both = score[:, None] + model.step
        back[i] = both.argmax(axis=0)
        score = both.max(axis=0) + model.emit[codes[i]]
    path = np.empty(len(codes), dtype=np.uint8)
    path[-1] = score.argmax() if last is None else last
    for i in range(len(codes) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def matrix(model: Model, codes: np.ndarray) -> np.ndarray:
    """The best score from each state before a run (the last row: none) to each state at its end."""
    best = np.vstack([model.step, model.first]) + model.emit[codes[0]]
    for code in codes[1:]:
        best = (best[:, :, None] + model.step).max(axis=1) + model.emit[code]
    return best


def borders(matrices: list[np.ndarray]) -> list[int]:
    """The states at the ends of a conversation's blocks."""
    score, backs = matrices[0][N], []
    for m in matrices[1:]:
        both = score[:, None] + m[:N]
        backs.append(both.argmax(axis=0))
        score = both.max(axis=0)
    ends = [int(score.argmax())]
    for back in reversed(backs):
        ends.append(int(back[ends[-1]]))
    return ends[::-1]


def render(role: str, text: str) -> str:
    """One turn in canonical form; the marker that its first line begins with is gone."""
    return f"<|{role}|>\n{text[marker(lines_of(text)[0])[1]:].strip()}\n<|end|>\n"


def parse_text(model: Model, text: str) -> list[tuple[str, str]]:
    """(role, text) turns of a transcript in one piece, whose lines do not say where entries begin."""
    lines = lines_of(text)
    codes = np.array([feature(line, marker(line)[0] > 0 or i == 0) for i, line in enumerate(lines)])
    turns: list[list] = []
    for line, state in zip(lines, viterbi(model, codes), strict=True):
        role, begins = STATES[state]
        if begins or not turns:
            turns.append([ROLES[role], line[marker(line)[1] :]])
        else:
            turns[-1][1] += "\n" + line
    return [(r, t.strip()) for r, t in turns]


def parse_transcripts(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id column and ``turns``, an array of (role, text). A null text has one empty turn."""
    kind = df.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        turns = [[{"role": r, "text": t} for r, t in parse_text(model, x or "")] for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, shape)], [id_col, "turns"])

    return map_batches(df, [id_col, text_col], f"`{id_col}` {kind}, turns array<struct<role:string,text:string>>", kernel)


def train(df: DataFrame, most_conversations: int = TRAIN_CONVERSATIONS, most_entries: int = TRAIN_ENTRIES) -> Model:
    """Counts a model from the conversations of smallest hash: a bounded sample at any size."""
    chosen = df.where("conv_id is not null").select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(most_conversations)
    rows = df.join(F.broadcast(chosen), "conv_id").where("role is not null").select(F.xxhash64("conv_id").alias("h"), "conv_id", "turn", "role", "text")
    found: dict = {}
    for r in rows.orderBy("h", "conv_id", "turn", "role", "text").limit(most_entries).collect():
        found.setdefault(r.conv_id, []).append((r.role, r.text))
    return count_model(list(found.values()))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first ``keys`` columns, over the borders of batches."""
    at, held = None, []
    for whole in batches:
        for batch in small(whole):
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and row[:keys] != at:
                    yield at, held
                    held = []
                at = row[:keys]
                held.append(row[keys:])
    if held:
        yield at, held


def _blocked(df: DataFrame, block: int) -> DataFrame:
    """(conv_id, block, part, bucket, turn, h, text), whose first four columns name runs of entries in the order of (turn, h).

    A run holds the entries of ``block`` turns. Where a turn (or what has none) has more entries than that, each turn
    of its run is a run by itself (``part``), and the entries of the large turn are dealt out by ranges of their texts'
    hashes (``bucket``); only entries equal in conversation, turn and text are never parted."""
    number = F.coalesce(F.floor(F.col("turn") / block), F.lit(-1)).cast("long")
    source = df.select("conv_id", number.alias("block"), "turn", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    large = source.groupBy("conv_id", "block", "turn").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = large.groupBy(F.col("conv_id").alias("__conv"), F.col("block").alias("__block")).agg(F.collect_list(F.struct("turn", F.ceil(F.col("n") / block).cast("long").alias("shares"))).alias("__large"))
    joined = source.join(written(large, "large-turns"), F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("block") == F.col("__block")), "left")
    shares = F.coalesce(F.get(F.filter("__large", lambda x: x["turn"].eqNullSafe(F.col("turn"))), 0)["shares"], F.lit(1))
    place = F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * shares), shares - 1).cast("long")
    split = F.col("__large").isNotNull()
    return joined.select("conv_id", "block", F.when(split, F.col("turn")).alias("part"), F.when(split, place).otherwise(F.lit(0)).cast("long").alias("bucket"), "turn", "h", "text")


RUN = ["conv_id", "block", "part", "bucket"]


def recover_roles(df: DataFrame, model: Model, block: int = BLOCK) -> DataFrame:
    """``df(conv_id, turn, text)`` -> one row per row: conv_id, turn, role, n_lines, rendered.

    Rows of a conversation are taken by turn (nulls first), equal turns by the hash of their texts. Null texts are
    empty lines, long texts are read whole, rows without conv_id are one conversation, repeated rows stay, a given role
    is not looked at, other columns are left behind, an empty table gives an empty one."""
    conv, turn = (df.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    conv_kind, turn_kind = (to_arrow_type(df.schema[c].dataType) for c in ("conv_id", "turn"))
    kinds = [conv_kind, pa.int64(), turn_kind, pa.int64()]
    source = _blocked(df, block)

    def codes_of(rows: list[tuple]) -> np.ndarray:
        return np.array([feature(line, k == 0) for row in rows for k, line in enumerate(lines_of(row[-1]))])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _runs(batches, len(RUN)):
            yield pa.RecordBatch.from_arrays([*[pa.array([x], t) for x, t in zip(key, kinds, strict=True)], pa.array([matrix(model, codes_of(rows)).tobytes()])], [*RUN, "best"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c,), rows in _runs(batches, 1):
            ends = borders([np.frombuffer(row[-1]).reshape(N + 1, N) for row in rows])
            columns = [[c] * len(rows), *zip(*[row[:3] for row in rows], strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], pa.array([None, *ends[:-1]], pa.int32()), pa.array(ends, pa.int32())], [*RUN, "before", "last"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (c, _, _, _, before, last), rows in _runs(batches, len(RUN) + 2):
            path, at = viterbi(model, codes_of(rows), before, last), 0
            for t, _, text in rows:
                role, count = ROLES[STATES[path[at]][0]], len(lines_of(text))
                at += count
                out.append((c, t, role, count, render(role, text)))
            if len(out) >= 1000:
                yield made(out)
                out = []
        if out:
            yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        types = (conv_kind, turn_kind, pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "turn", "role", "n_lines", "rendered"])

    first = F.struct("block", "part", "bucket")
    long = source.groupBy("conv_id").agg(F.min(first).alias("a"), F.max(first).alias("b")).where("not a <=> b").select(F.col("conv_id").alias("__conv"))
    long = written(long, "long-conversations")
    keys = f"conv_id {conv}, block long, part {turn}, bucket long"
    renamed = {c: f"__{c}" for c in RUN}
    if long.isEmpty():
        ends = df.sparkSession.createDataFrame([], f"{keys}, before int, last int")
    else:
        some = source.join(long, F.col("conv_id").eqNullSafe(F.col("__conv")), "left_semi").repartition(*RUN).sortWithinPartitions(*RUN, "turn", "h")
        best = some.select(*RUN, "turn", "h", "text").mapInArrow(weigh, f"{keys}, best binary")
        ends = best.repartition("conv_id").sortWithinPartitions(*RUN).mapInArrow(chain, f"{keys}, before int, last int")
    ends = ends.withColumnsRenamed(renamed)
    same = F.lit(True)
    for c in RUN:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    bound = source.join(ends, same, "left")
    bound = bound.select(*RUN, "before", "last", "turn", "h", "text").repartition(*RUN).sortWithinPartitions(*RUN, "turn", "h")
    return bound.mapInArrow(solve, f"conv_id {conv}, turn {turn}, role string, n_lines long, rendered string")


def digest(text: str) -> str:
    """The plain form of the query's hash, for tests."""
    return hashlib.sha256(text.encode()).hexdigest()
