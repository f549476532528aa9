"""Conversations repaired to (system) (user assistant)*, at the least cost, by min-plus products over runs of equal rows.

Rows of a conversation count in the order of turn (nulls first), of one turn by role and then by the 64-bit xxhash of the
text. A row's first fault counts: blank, duplicate (role and text seen earlier in the conversation), truncated (the last
character that isn't white space is none of .!?). Edits: keep 0, rename to user or assistant 2, delete 3 (blank and
duplicate rows must go), insert an empty user or assistant row 2; truncated rows that stay cost 1 more. Ties go to the
ASCII-least audit (D, I, K, R); each letter has one outcome where it stands, so the audit says all.

What stands so far is one of four states: nothing, a system row, ends with user, ends with assistant. A row is one of nine
symbols (initial and truncation, or "must go"), each a 4 x 4 min-plus matrix of the least costs between states. Equal
consecutive symbols collapse to a run; a run of n multiplies by the matrix's binary powers, which are kept by symbol.

1. Rows get their faults (a window by conversation, role and text hash; no text is shuffled) and a chunk: turn / CHUNK.
2. Each chunk, in its own task, becomes one matrix. The products are associative, so a conversation of any length is split.
3. The chunks of a conversation, from the last to the first, give the costs to go at each chunk's end.
4. Rows and texts of a conversation stream in order: the costs to go inside one chunk are unrolled from its end, run by run,
   then the cheapest letters forward, with the running SHA-256. One chunk's rows are held; the hash of a whole conversation
   can only be taken in order, so that this last pass of a conversation is one task's.

Nulls of conv_id, turn, role and text count as one space where text is meant, and sort first. All rows with one conv_id are
one conversation, null too. Conversations that lose all rows give zeros, an empty audit and the hash of nothing. Repeated
rows are duplicates. Other columns are not read; an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm import common

#: Turns of a chunk.
CHUNK = 4096
WHITE = " \t\n\v\f\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, RENAME, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
FAR = 1 << 40
#: The state after an inserted row, and after a kept row by its initial.
INSERTED = [USER, USER, ASSISTANT, USER]
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Costs to go after the last row: done, or rows to insert.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


def _moves(symbol: str, state: int) -> list[tuple[str, int, int, bool]]:
    """(letter, cost, next state, whether the row is used) of all edits in a state before a row, by letter. A symbol is an
    initial and "t" for truncated, or "x" for rows that must go."""
    out = [("D", DELETE, state, True), ("I", INSERT, INSERTED[state], False)]
    if symbol != "x":
        more = CUT_OFF if symbol.endswith("t") else 0
        to = KEPT.get(symbol[0], {}).get(state)
        if to is not None:
            out.append(("K", KEEP + more, to, True))
        out.append(("R", RENAME + more, INSERTED[state], True))
    return out


SYMBOLS = ["x", *(i + t for i in "sua-" for t in ("", "t"))]
MOVES = {s: [_moves(s, k) for k in range(4)] for s in SYMBOLS}


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product of a matrix with a matrix or a vector."""
    return np.minimum((a[:, :, None] + b[None]).min(1) if b.ndim == 2 else (a + b[None]).min(1), FAR)


def _matrix(symbol: str) -> np.ndarray:
    """The least costs of the edits before and of one row, from state to state."""
    inserts = np.full((4, 4), FAR, np.int64)
    inserts[range(4), range(4)] = 0
    step = inserts.copy()
    step[range(4), INSERTED] = INSERT
    for _ in range(3):
        inserts = times(inserts, np.minimum(step, inserts))
    row = np.full((4, 4), FAR, np.int64)
    for state in range(4):
        for _, cost, to, used in MOVES[symbol][state]:
            if used:
                row[state, to] = min(row[state, to], cost)
    return times(inserts, row)


class Powers:
    """Min-plus powers of the symbols' matrices, their binary powers kept."""

    def __init__(self) -> None:
        self.kept = {s: [_matrix(s)] for s in SYMBOLS}

    def binary(self, symbol: str, n: int) -> Iterator[np.ndarray]:
        own, k = self.kept[symbol], 0
        while n >> k:
            if k == len(own):
                own.append(times(own[-1], own[-1]))
            if n >> k & 1:
                yield own[k]
            k += 1

    def before(self, symbol: str, n: int, after: np.ndarray) -> np.ndarray:
        """The costs to go before n rows of one symbol."""
        for power in self.binary(symbol, n):
            after = times(power, after)
        return after

    def product(self, runs: list[tuple[str, int]]) -> np.ndarray:
        out = np.full((4, 4), FAR, np.int64)
        out[range(4), range(4)] = 0
        for symbol, n in reversed(runs):
            for power in self.binary(symbol, n):
                out = times(power, out)
        return out


def collapsed(symbols: list[str]) -> list[tuple[str, int]]:
    """Runs (symbol, how many)."""
    out: list[list] = []
    for s in symbols:
        if out and out[-1][0] == s:
            out[-1][1] += 1
        else:
            out.append([s, 1])
    return [(s, n) for s, n in out]


def unrolled(runs: list[tuple[str, int]], end: np.ndarray, state: int, powers: Powers, last: bool) -> tuple[list[str], int]:
    """The letters of each row (those of rows inserted before it first) for costs to go `end` after the runs, and the state
    then. last: the rows inserted after all others are one more item."""
    after = [end]
    for symbol, n in reversed(runs):
        after.append(powers.before(symbol, n, after[-1]))
    after.reverse()  # after[i]: before run i
    letters = []
    for i, (symbol, n) in enumerate(runs):
        one, inside = powers.kept[symbol][0], [after[i + 1]]
        for _ in range(n - 1):
            inside.append(times(one, inside[-1]))
        for to_go in reversed(inside):  # costs after each row of the run
            here, own = times(one, to_go).tolist(), ""
            to_go = to_go.tolist()
            used = False
            while not used:
                for letter, cost, to, used in MOVES[symbol][state]:  # letters ascend
                    if cost + (to_go[to] if used else here[to]) == here[state]:
                        own, state = own + letter, to
                        break
            letters.append(own)
    if last:
        own = ""
        while END[state]:
            own, state = own + "I", INSERTED[state]
        letters.append(own)
    return letters, state


# ---------------------------------------------------------------- tables


def damaged(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv, turn, role, text) after the damage that crc32("<conv_id>:<turn>") % 20 says: 0 drops a row, 1 empties its text,
    2 takes .!? out of it, 3 repeats it, 4 makes its role user."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text(F.col(id_col)), F.lit(":"), text(F.col("turn"))).cast("binary")) % 20
    rows = conversations.select(F.col(id_col).alias("conv"), "turn", text(F.col("role")).alias("role"), text(F.col("text")).alias("text"), h.alias("h")).where("h <> 0")
    harmed = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), harmed.alias("text"), copies.alias("_")).drop("_")


def _chunk(turn: Column, chunk: int) -> Column:
    return F.coalesce(F.floor(turn / chunk), F.lit(-(1 << 62)))  # nulls first


def faulty(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv, chunk, turn, role, h, symbol, fault) of rows (conv, turn, role, text): no texts, their hashes."""
    left = F.btrim("text", F.lit(WHITE))
    own = F.when(left == "", "blank").when(~F.substring(left, -1, 1).isin(".", "!", "?"), "truncated")
    light = rows.select("conv", "turn", "role", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2"), own.alias("own"))
    again = F.row_number().over(Window.partitionBy("conv", "role", "h", "h2").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("again"), "duplicate").otherwise(F.col("own"))
    initial = F.substring("role", 1, 1)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").otherwise(F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("-"), F.when(F.col("fault") == "truncated", "t").otherwise("")))
    return light.withColumn("again", again).withColumn("fault", fault).select("conv", _chunk(F.col("turn"), chunk).alias("chunk"), "turn", "role", "h", symbol.alias("symbol"), "fault")


ORDER = ("conv", "chunk", "turn", "role", "h", "symbol")


def _by_chunk(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row (conv, chunk, matrix) for each chunk of rows in order."""
    powers, now, runs, done = Powers(), None, [], []

    def rows() -> Iterator[pa.RecordBatch]:
        if done:
            columns = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            done.clear()

    for batch in batches:
        for key in zip(*(batch.column(c).to_pylist() for c in ("conv", "chunk", "symbol")), strict=True):
            if key[:2] != now:
                if runs:
                    done.append((*now, powers.product(runs).ravel().tolist()))
                now, runs = key[:2], []
            if runs and runs[-1][0] == key[2]:
                runs[-1] = (key[2], runs[-1][1] + 1)
            else:
                runs.append((key[2], 1))
        yield from rows()
    if runs:
        done.append((*now, powers.product(runs).ravel().tolist()))
    yield from rows()


def _backward(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(conv, chunk, costs to go at its end) of chunks that come from last to first."""
    first, now, to_go = True, None, END
    for batch in batches:
        ends = []
        for conv, matrix in zip(batch.column("conv").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
            if first or conv != now:
                first, now, to_go = False, conv, END
            ends.append(to_go.tolist())
            to_go = times(np.array(matrix, np.int64).reshape(4, 4), to_go)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(ends, schema.field(2).type)], schema=schema)


NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}


class _Repair:
    """A conversation on its way through the stream."""

    def __init__(self, powers: Powers) -> None:
        self.powers, self.state, self.audit, self.sha, self.any = powers, NOTHING, [], hashlib.sha256(), False
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.least = self.most = self.turn = self.initial = None
        self.symbols, self.texts, self.end = [], [], END

    def row(self, turn: int | None, role: str, symbol: str, fault: str | None) -> None:
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            self.least = turn if self.least is None else self.least
            if turn != self.most:
                self.turns += 1
            self.most = turn
        self.symbols.append(symbol)

    def _out(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def _inserted(self, letters: str, state: int) -> int:
        for _ in letters:
            state = INSERTED[state]
            self._out(NAMES[state], "")
            self.cost += INSERT
        return state

    def close(self, last: bool) -> None:
        """Ends a chunk."""
        state = self.state
        letters, self.state = unrolled(collapsed(self.symbols), self.end, state, self.powers, last)
        for own, symbol, (role, text) in zip(letters, self.symbols, self.texts, strict=False):
            state = self._inserted(own[:-1], state)
            for letter, cost, to, _ in MOVES[symbol][state]:
                if letter == own[-1]:
                    self.cost += cost
                    state = to
                    if letter == "K":
                        self._out(role, text)
                    elif letter == "R":
                        self._out(NAMES[to], text)
        if last:
            self._inserted(letters[-1], state)
        self.audit += letters
        self.symbols, self.texts = [], []

    def result(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.least is not None else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: Kinds of rows in the last stream, in their order within a chunk.
ONLY_ID, COSTS, FAULTS, TEXT = range(4)


def _forward(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, now, chunk, repair = Powers(), None, None, None

        def given(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

        done: list[tuple] = []
        for batch in batches:
            for conv, of, kind, turn, role, symbol, fault, text, end in zip(*(batch.column(c).to_pylist() for c in ("conv", "chunk", "kind", "turn", "role", "symbol", "fault", "text", "end")), strict=True):
                if repair is None or conv != now:
                    if repair is not None:
                        repair.close(True)
                        done.append((now, *repair.result()))
                    now, chunk, repair = conv, of, _Repair(powers)
                if kind == COSTS:
                    if repair.symbols:
                        repair.close(False)
                    repair.end = np.array(end, np.int64)
                elif kind == FAULTS:
                    repair.row(turn, role, symbol, fault)
                elif kind == TEXT:
                    repair.texts.append((role, text))
            if done:
                yield given(done)
                done = []
        if repair is not None:
            repair.close(True)
            yield given([*done, (now, *repair.result())])

    return run


def repaired(rows: DataFrame, ids: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for rows (conv, turn, role, text) and
    all conversations ids (conv)."""
    light = common.keep(faulty(rows, chunk), "turns")
    kind = light.schema["conv"].dataType
    conv, number = pa.field("conv", to_arrow_type(kind)), pa.field("chunk", pa.int64())
    name = kind.simpleString()
    matrices = pa.schema([conv, number, pa.field("matrix", pa.list_(pa.int64()))])
    ends = pa.schema([conv, number, pa.field("end", pa.list_(pa.int64()))])
    out = pa.schema([conv, *(pa.field(c, pa.int64()) for c in COUNTS), pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())])
    chunks = light.repartition("conv", "chunk").sortWithinPartitions(*ORDER).select("conv", "chunk", "symbol").mapInArrow(lambda b: _by_chunk(b, matrices), f"conv {name}, chunk long, matrix array<long>")
    to_go = chunks.repartition("conv").sortWithinPartitions("conv", F.col("chunk").desc()).mapInArrow(lambda b: _backward(b, ends), f"conv {name}, chunk long, end array<long>")
    texts = rows.select("conv", _chunk(F.col("turn"), chunk).alias("chunk"), "turn", "role", F.xxhash64("text").alias("h"), "text")
    parts = [ids.select("conv").distinct().withColumn("kind", F.lit(ONLY_ID)), to_go.withColumn("kind", F.lit(COSTS)), light.withColumn("kind", F.lit(FAULTS)), texts.withColumn("kind", F.lit(TEXT))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    every = every.repartition("conv").sortWithinPartitions("conv", "chunk", "kind", "turn", "role", "h", "symbol")
    return every.mapInArrow(_forward(out), f"conv {name}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")


def damaged_and_repaired(conversations: DataFrame, id_col: str = "conv_id", chunk: int = CHUNK) -> DataFrame:
    """repaired() of what damaged() leaves, for every conversation of the table."""
    ids = conversations.select(F.col(id_col).alias("conv"))
    return repaired(damaged(conversations, id_col), ids, chunk).withColumnRenamed("conv", id_col)
