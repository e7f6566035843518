"""Chat formatting: roles of a raw transcript, recovered by a hidden Markov model.

A transcript is lines of text. Hidden is, for each line, whose turn it belongs
to and whether the turn begins there; seen are the line's features: its speaker
marker (a word before a colon, in brackets or in a heading), the how-manieth
speaker of the transcript has that marker, whether an empty line comes before,
how long the line is, whether it asks. Probabilities are counts from labelled
transcripts, smoothed; Viterbi finds the most likely roles of all lines
together, many transcripts side by side. Turns are then rendered in one
canonical form::

    <|role|>
    text
    <|end|>

The model is fitted on at most ``SAMPLE`` labelled conversations. Of every third
one some markers are left out, every third one has names that nobody knows
instead, and half of the others have no empty lines between turns, so that it
learns to do without each.

Defined results: a null or empty transcript, or one of empty lines, has no
turns and an empty rendering; a marker without text makes no turn; ``<|`` in a
text becomes ``< |``, so that no text can forge a turn; a transcript of any
length is read whole, with any number of roles and speakers, and markers and
lines of any length; how long a line is or the how-manieth its speaker, where
that never occurred in labelled transcripts, says nothing about its role; repeated rows are treated alike; an empty table gives an
empty result. In a table of turns a null text is an empty turn, a null role
gets no marker, rows of null conversation are one conversation of null id,
and turns that tie in number come in the order of role and text. Other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

#: Labelled conversations that the model is fitted on, at most.
SAMPLE = 1_500
SMOOTH = 0.1
#: What stands for every marker that isn't known.
UNKNOWN = "?"
_LETTERS = "abc"
#: Lines of transcripts that run together.
TOGETHER = 400_000
#: Transitions of transcripts that run together.
CELLS = 8_000_000

#: How the three usual roles are marked, by style: before and after the name, then the names.
STYLES = (
    ("", ": ", ("User", "Assistant", "System")),
    ("", ": ", ("Human", "AI", "Context")),
    ("### ", ":\n", ("Instruction", "Response", "System")),
    ("<|", "|>\n", ("user", "assistant", "system")),
    ("[", "] ", ("USER", "BOT", "SYSTEM")),
    ("**", ":** ", ("Customer", "Agent", "Note")),
    ("", ": ", ("Q", "A", "Setup")),
    ("", ": ", ("Alex", "Sam", "Moderator")),
)
ROLES = ("user", "assistant", "system")

# Of any length, and read in one pass: no part gives back what it has taken.
_NAME = r"\p{L}[\p{L}\p{N}]*+(?:_++[\p{L}\p{N}]++)*+(?:[ ]++[\p{L}\p{N}]++(?:_++[\p{L}\p{N}]++)*+)*+"
_MARK = regex.compile(
    rf"^\s*+(?:(?:\*\*|__|#{{1,6}}\s*+)\s*+({_NAME})\s*+(?::\s*+(?:\*\*|__)?|(?:\*\*|__)\s*+:?|$)"
    r"|<\|?\s*+(\p{L}[\p{L}_]*+)\s*+\|?>"
    r"|\[\s*+(\p{L}[\p{L}_]*+(?:[ ]++[\p{L}_]++)*+)\s*+\]"
    r"|(\p{L}[\p{L}\p{N}_]*+(?:[ ]\p{L}[\p{L}_]*+)?+)\s*+:(?=\s|$))\s*+"
)


def marked(line: str) -> tuple[str | None, str]:
    """A line's marker, in lower case, and what follows it."""
    m = _MARK.match(line)
    return (next(g for g in m.groups() if g).lower(), line[m.end() :]) if m else (None, line)


def lines(text: str | None) -> list[tuple[str, bool]]:
    """The lines that aren't empty, each with whether an empty one comes before."""
    out, blank = [], False
    for s in (text or "").splitlines():
        if s.strip():
            out.append((s, blank))
            blank = False
        else:
            blank = True
    return out


def features(rows: list[tuple[str, bool]]) -> tuple[list[tuple], list[str | None]]:
    """Of each line: marker, speaker's number, place and empty line before, length, question."""
    out, markers, order = [], [], {}
    for i, (s, blank) in enumerate(rows):
        name, rest = marked(s)
        markers.append(name)
        speaker = 0 if name is None else order.setdefault(name, len(order) + 1)
        out.append((name, speaker, 2 * bool(i) + blank, len(rest).bit_length(), rest.rstrip().endswith("?")))
    return out, markers


def emission(table: dict, value: object) -> np.ndarray:
    """Log probabilities of a feature's value by state; a marker that isn't known counts as such, another value that was never seen says nothing."""
    own = table.get(value)
    return own if own is not None else table.get(UNKNOWN, np.zeros_like(table[...]))


@dataclass
class Model:
    roles: list[str]  # state 2 r begins a turn of role r, 2 r + 1 goes on with it
    start: np.ndarray
    trans: np.ndarray
    emit: list[dict]  # by feature: log probabilities by value, by state; None for a value never seen

    def decode(self, seen: list[list[tuple]]) -> list[np.ndarray]:
        """The most likely states of each transcript's lines; transcripts run side by side, the longest first."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(seen)
        order = sorted((i for i in range(len(seen)) if seen[i]), key=lambda i: -len(seen[i]))
        k = 0
        while k < len(order):
            part, n = [], 0
            # What a step needs is the square of the number of states, for each transcript.
            while k < len(order) and (not part or (n < TOGETHER and len(part) * len(self.start) ** 2 < CELLS)):
                part.append(order[k])
                n += len(seen[order[k]])
                k += 1
            self._viterbi([seen[i] for i in part], part, out)
        return out

    def _viterbi(self, seen: list[list[tuple]], names: list[int], out: list[np.ndarray]) -> None:
        flat = [x for row in seen for x in row]
        em = np.zeros((len(flat), len(self.start)))
        for f, table in enumerate(self.emit):
            number: dict = {}
            ids = [number.setdefault(x[f], len(number)) for x in flat]
            em += np.stack([emission(table, v) for v in number])[ids]
        size = np.array([len(r) for r in seen])
        first = np.cumsum(size) - size
        back = np.zeros(em.shape, np.int32)
        now = self.start + em[first]
        best = [0] * len(seen)
        alive = len(seen)
        for t in range(1, int(size[0]) + 1):
            left = int(np.searchsorted(-size, -t))  # longer than t lines; they come first
            for i in range(left, alive):
                best[i] = int(now[i].argmax())
            alive = left
            if not alive:
                break
            way = now[:alive, :, None] + self.trans
            back[first[:alive] + t] = way.argmax(axis=1)
            now = way.max(axis=1) + em[first[:alive] + t]
        for i, name in enumerate(names):
            b, s = back[first[i] : first[i] + size[i]], best[i]
            path = np.empty(size[i], np.int64)
            for t in range(size[i] - 1, -1, -1):
                path[t] = s
                s = b[t, s]
            out[name] = path

    def turns(self, texts: list[str | None]) -> list[list[tuple[str, str]]]:
        """(role, text) of each transcript's turns."""
        rows = [lines(t) for t in texts]
        seen = [features(r) for r in rows]
        out = []
        for r, (_, markers), path in zip(rows, seen, self.decode([s for s, _ in seen])):
            turns: list[tuple[str, list[str]]] = []
            for (s, blank), name, state in zip(r, markers, path.tolist()):
                role, goes_on = self.roles[state // 2], state % 2
                if not goes_on or not turns:
                    turns.append((role, [marked(s)[1] if name is not None else s]))
                else:
                    turns[-1][1].append(("\n" if blank else "") + s)
            joined = ((role, "\n".join(parts).strip().replace("<|", "< |")) for role, parts in turns)
            out.append([(role, s) for role, s in joined if s])
        return out


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form; a role is one line that can't end its mark."""
    plain = lambda role: " ".join(role.replace("<|", "< |").replace("|>", "| >").split())
    return "".join(f"<|{plain(role)}|>\n{text}\n<|end|>\n" for role, text in turns)


def write(
    turns: list[tuple[str | None, str | None]], style: int, drop: np.random.Generator | None = None, names: tuple[str, ...] | None = None, between: str = "\n\n"
) -> tuple[str, list[tuple[str, bool]]]:
    """A transcript in one of ``STYLES``, and its label for each line that isn't empty: role, and whether the turn begins there."""
    before, after, usual = STYLES[style % len(STYLES)]
    names = names or usual
    parts, labels = [], []
    for role, text in turns:
        head = ""
        if role is not None and not (drop is not None and drop.random() < 0.3):
            head = before + (names[ROLES.index(role)] if role in ROLES else role) + after
        s = head + (text or "")
        n = sum(1 for x in s.splitlines() if x.strip())
        labels += [(role or "", i == 0) for i in range(n)]
        parts.append(s)
    return between.join(parts), labels


def fit(conversations: list[list[tuple[str | None, str | None]]], seed: int = 3) -> Model:
    """A model from labelled conversations: lists of (role, text)."""
    roles = sorted({r for c in conversations for r, _ in c if r is not None} | set(ROLES))
    n = 2 * len(roles)
    rng = np.random.default_rng(seed)
    start, trans = np.full(n, SMOOTH), np.full((n, n), SMOOTH)
    counts: list[dict] = [{} for _ in range(5)]
    total = np.zeros(n)
    for i, c in enumerate(conversations):
        c = [(r, t) for r, t in c if r is not None]
        strange = tuple(f"Name {_LETTERS[k]}" for k in rng.permutation(3)) if i % 3 == 1 else None
        text, labels = write(c, i // 3, rng if i % 3 == 2 else None, strange, "\n" if i % 3 < 2 and i // 3 // len(STYLES) % 2 else "\n\n")
        seen, _ = features(lines(text))
        if strange:
            seen = [(UNKNOWN if x[0] is not None else None, *x[1:]) for x in seen]
        before = None
        for x, (role, begins) in zip(seen, labels):
            s = 2 * roles.index(role) + (not begins)
            total[s] += 1
            for f, v in enumerate(x):
                counts[f].setdefault(v, np.zeros(n))[s] += 1
            if before is None:
                start[s] += 1
            else:
                trans[before, s] += 1
            before = s
    # A turn can't go on before it has begun, nor change its role.
    for k in range(n):
        start[k] = start[k] if k % 2 == 0 else 1e-12
        for j in range(1, n, 2):
            if k // 2 != j // 2:
                trans[k, j] = 1e-12
    emit = [{v: np.log((c + SMOOTH) / (total + SMOOTH * (len(d) + 1))) for v, c in d.items()} | {...: np.log(SMOOTH / (total + SMOOTH * (len(d) + 1)))} for d in counts]
    return Model(roles, np.log(start / start.sum()), np.log(trans / trans.sum(axis=1, keepdims=True)), emit)


def _style(conv: Column) -> Column:
    return F.pmod(F.xxhash64(conv), F.lit(len(STYLES))).cast("int")


def assemble(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, transcript): each conversation's turns in a raw form, marked in a style that its id decides."""
    style, role = _style(F.col("conv_id")), F.col("role")
    head = F.lit(None).cast("string")
    for k, (before, after, names) in enumerate(STYLES):
        name = F.coalesce(*(F.when(role == r, F.lit(x)) for r, x in zip(ROLES, names)), role)
        head = F.when(style == k, F.concat(F.lit(before), name, F.lit(after))).otherwise(head)
    read = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    said = F.concat(F.coalesce(head, F.lit("")), F.coalesce("text", F.lit("")))
    parts = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", said.alias("said")))).alias("all"))
    return parts.select("conv_id", F.array_join(F.transform("all", lambda x: x["said"]), "\n\n").alias("transcript"))


def train(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Model:
    """Fit on a bounded sample of conversations."""
    read = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    some = runtime.hash_sample(read.select("conv_id").where("conv_id is not null").distinct(), "conv_id", SAMPLE, 9)
    rows = read.join(F.broadcast(some), "conv_id").toPandas()
    rows = rows.astype(object).where(rows.notna(), None)
    rows["last"] = rows["turn"].isna()
    rows = rows.sort_values(["conv_id", "last", "turn", "role", "text"], na_position="last")
    return fit([list(zip(g["role"], g["text"])) for _, g in rows.groupby("conv_id", sort=True)])


def parse(transcripts: DataFrame, model: Model, id_col: str = "conv_id", text_col: str = "transcript") -> DataFrame:
    """(conv_id, turns, roles, chat): number of turns, their roles, and the canonical form."""
    shared = transcripts.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runtime.batches(it, "text"):
            found = shared.value.turns(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in found], pa.int32()), pa.array([[r for r, _ in t] for t in found], pa.list_(pa.string())), pa.array([render(t) for t in found], pa.string())],
                ["conv_id", "turns", "roles", "chat"],
            )

    read = transcripts.select(F.col(id_col).alias("conv_id"), F.col(text_col).cast("string").alias("text"))
    return runtime.mapped(read, run, f"conv_id {dict(transcripts.dtypes)[id_col]}, turns int, roles array<string>, chat string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, from raw transcripts to the canonical form."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return parse(assemble(turns), train(turns))
