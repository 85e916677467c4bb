"""Transcript parsing by a hidden Markov model over line features, then canonical turns.

States are (role, first line) and (role, later line). A line is seen as one symbol: its speaker marker, length class and
punctuation. Transitions and emissions are counted over labelled conversations. Viterbi runs by blocks of a
conversation: each block yields its max-plus matrix from the state before it to its last state, the matrices
of a conversation give every block's best entry and exit state, and each block is decoded between them. The result is the
path of the whole conversation, and no task holds more than a block's lines or one small matrix for each block.

Null texts are empty lines, null turns order first; each turn with a null conv_id is a conversation of its own (equal ones share
it), returned with a null conv_id. Rows with a null role are not learnt from. Equal turns of a conversation keep both rows, ordered by
text. reformat() learns from one half of the conversations what it parses in the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, text_batches

ROLES = ("system", "user", "assistant")
#: Speaker markers in use, by role, and how the canonical form opens and closes a turn.
MARKERS = {"system": ("System:", "### System"), "user": ("User:", "Human:", "### User", "Q:"), "assistant": ("Assistant:", "AI:", "### Assistant", "A:")}
OPEN, CLOSE = "<|{role}|>\n", "\n<|end|>"
#: Turn numbers of a block, and rows from which it is split.
BLOCK_TURNS, BLOCK_ROWS = 64, 4096
LONG = (40, 120, 400)
N_SYMBOLS = 4 * (len(LONG) + 1) * 2 * 2
PARSED = "conv_id string, block long, segment int, starts boolean, role string, n_lines int, rendered string"


def _pattern(role: str) -> str:
    return "^\\s*(" + "|".join(m.replace("#", "\\#") for m in MARKERS[role]) + ")\\s*"


def symbol(line: Column) -> Column:
    """The symbol of a line."""
    marker = F.lit(0)
    for i, role in enumerate(ROLES):
        marker = F.when(line.rlike("(?i)" + _pattern(role)), F.lit(i + 1)).otherwise(marker)
    length = F.lit(0)
    for i, least in enumerate(LONG):
        length = F.when(F.length(line) >= least, F.lit(i + 1)).otherwise(length)
    ask = F.when(line.rlike("[?¿]\\s*$"), F.lit(1)).otherwise(F.lit(0))
    item = F.when(line.rlike("^\\s*([-*•]|[0-9]+[.)])\\s"), F.lit(1)).otherwise(F.lit(0))
    return (((marker * (len(LONG) + 1) + length) * 2 + ask) * 2 + item).cast("int")


def with_block(rows: DataFrame, most: int = BLOCK_ROWS) -> DataFrame:
    """block: a string that orders the blocks of a conversation; each has 64 turn numbers, or part of one where equal numbers crowd.

    A block of more than `most` rows is split by turn number, then by ranges of the rows' hash `tie`, then by rows. Such blocks are
    counted in advance; a block counts as crowded from a 65,536th of all rows on at the latest, so the list of them stays bounded.
    """
    rows = rows.withColumn("slot_", F.floor(F.col("turn") / BLOCK_TURNS))
    sizes = rows.groupBy("conv_id", "slot_").count()
    total = rows.count()
    crowded = sizes.where(F.col("count") > max(most, total >> 16)).select("conv_id", "slot_", F.ceil(F.log2(F.col("count") / BLOCK_TURNS)).cast("int").alias("bits_"))
    out = rows.join(F.broadcast(crowded), ["conv_id", "slot_"], "left")  # at most 65,536 rows

    def leading(column: Column) -> Column:  # the first bits of a hash, in its order
        return F.shiftrightunsigned(column.bitwiseXOR(F.lit(-(1 << 63))), 40).cast("double") * F.pow(F.lit(2.0), F.col("bits_") - 24)

    def digits(column: Column) -> Column:  # numbers from -2^63 on as text in their order
        return F.lpad((column.cast("decimal(20,0)") + F.expr("9223372036854775808BD")).cast("string"), 20, "0")

    part = F.concat(digits(F.col("turn")), *(F.lpad(F.floor(leading(c)).cast("string"), 8, "0") for c in (F.col("tie"), F.xxhash64(F.monotonically_increasing_id()))))
    return out.withColumn("block", F.concat(digits(F.col("slot_")), F.coalesce(part, F.lit("")))).drop("slot_", "bits_")


def compose(turns: DataFrame) -> DataFrame:
    """Lines of transcripts as people paste them: each conversation has its marker style, and every fourth turn lacks its marker.

    Returns (conv_id, block, turn, tie, idx, line, symbol, state); state is null where the role is unknown.
    """
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.concat(F.lit("null "), F.xxhash64("turn", "role", "text").cast("string"))).alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("role").cast("string").alias("role"),
    )
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4)).cast("int")
    marker = F.lit("")
    for role in ROLES:
        names = F.array(*(F.lit(MARKERS[role][i % len(MARKERS[role])]) for i in range(4)))
        marker = F.when(F.col("role") == role, F.get(names, style)).otherwise(marker)
    silent = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0
    text = F.when(silent | (marker == ""), F.col("text")).otherwise(F.concat(marker, F.lit(" "), F.col("text")))
    lines = with_block(rows.withColumn("line_", text).withColumn("tie", F.xxhash64("role", "text"))).select("conv_id", "block", "turn", "tie", "role", F.posexplode(F.split("line_", "\n")).alias("idx", "line"))
    state = F.lit(None).cast("int")
    for i, role in enumerate(ROLES):
        state = F.when(F.col("role") == role, 2 * i + F.when(F.col("idx") == 0, 0).otherwise(1)).otherwise(state)
    return lines.select("conv_id", "block", "turn", "tie", "idx", "line", symbol(F.col("line")).alias("symbol"), state.alias("state"))


def _by_length(blocks: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """The blocks from long to short, and how many of them have a line i, for every i."""
    sizes = np.array([len(b) for b in blocks])
    order = np.argsort(-sizes, kind="stable")
    return order, (np.bincount(sizes)[::-1].cumsum()[::-1][1:]).tolist()


def blocks_of(lines: DataFrame) -> DataFrame:
    """(conv_id, block, symbols, states, lines): one row a block, its lines in order. Blocks stay what they are."""
    if "symbols" in lines.columns:
        return lines
    held = F.array_sort(F.collect_list(F.struct("turn", "tie", "idx", "symbol", "state", "line")))
    found = lines.groupBy("conv_id", "block").agg(held.alias("x"))
    return found.select("conv_id", "block", F.col("x.symbol").alias("symbols"), F.col("x.state").alias("states"), F.col("x.line").alias("lines"))


class Model:
    """Log transitions (the last row: before the first line) and emissions."""

    def __init__(self, steps: dict[tuple[int, int], int], symbols: dict[tuple[int, int], int]):
        n = 2 * len(ROLES)
        moves = np.full((n + 1, n), 0.01)
        moves[-1, 0::2] = 1
        for (a, b), c in steps.items():
            moves[a, b] += c
        for b in range(1, n, 2):  # a later line follows its own role only
            moves[[a for a in range(n + 1) if a // 2 != b // 2], b] = 0
        seen = np.full((n, N_SYMBOLS), 0.1)
        for (state, s), c in symbols.items():
            seen[state, s] += c
        with np.errstate(divide="ignore"):
            self.moves = np.log(moves / moves.sum(axis=1, keepdims=True))
        self.seen = np.log(seen / seen.sum(axis=1, keepdims=True))

    def matrices(self, blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each block of symbols the best log likelihoods from each state before it to each state of its last line, and
        the state of its first line on that way. Line i of all blocks is one step."""
        order, active = _by_length(blocks)
        n = 2 * len(ROLES)
        best, first = np.zeros((len(blocks), n + 1, n)), np.zeros((len(blocks), n + 1, n), dtype=np.int8)
        for i, a in enumerate(active):
            seen = self.seen[:, [blocks[b][i] for b in order[:a]]].T[:, None, :]
            if i == 0:
                best[:a], first[:a] = self.moves + seen, np.arange(n)
            else:
                step = best[:a, :, :, None] + self.moves[:-1]
                best[:a] = step.max(axis=2) + seen
                first[:a] = np.take_along_axis(first[:a], step.argmax(axis=2), axis=2)
        back = np.argsort(order)
        return best[back], first[back]

    def paths(self, blocks: list[np.ndarray], entries: np.ndarray, exits: np.ndarray) -> list[np.ndarray]:
        """path() of each block between its entry and its exit. Line i of all blocks is one step."""
        order, active = _by_length(blocks)
        best, back = np.zeros((len(blocks), 2 * len(ROLES))), []
        for i, a in enumerate(active):
            seen = self.seen[:, [blocks[b][i] for b in order[:a]]].T
            if i == 0:
                best = self.moves[entries[order]] + seen
            else:
                step = best[:a, :, None] + self.moves[:-1]
                back.append(step.argmax(axis=1).astype(np.int8))
                best[:a] = step.max(axis=1) + seen
        out = [np.empty(len(b), dtype=np.int8) for b in blocks]
        state = exits[order].astype(np.int64)
        for i in range(len(active) - 1, -1, -1):
            for b, x in zip(order[: active[i]].tolist(), state[: active[i]].tolist(), strict=True):
                out[b][i] = x
            if i:
                state[: active[i]] = back[i - 1][np.arange(active[i]), state[: active[i]]]
        return out

    def path(self, symbols: np.ndarray, entry: int, exit_: int | None = None) -> list[int]:
        """The best states, after state `entry`, ending in exit_ if given."""
        best, back = self.moves[entry] + self.seen[:, int(symbols[0])], []
        for s in symbols[1:].tolist():
            step = best[:, None] + self.moves[:-1]
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + self.seen[:, s]
        out = [int(best.argmax()) if exit_ is None else exit_]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def fit(lines: DataFrame) -> Model:
    """Counts over all labelled lines; what comes to the driver is a table of states and symbols. lines: also as blocks."""
    both = F.filter(F.arrays_zip(F.col("states").alias("state"), F.col("symbols").alias("symbol")), lambda x: x["state"].isNotNull())
    known = blocks_of(lines).select("conv_id", "block", both.alias("x")).where(F.size("x") > 0)
    seen = {(r["state"], r["symbol"]): r["count"] for r in known.select(F.explode("x").alias("x")).groupBy("x.state", "x.symbol").count().collect()}
    first = known.groupBy("conv_id").agg(F.min("block").alias("block")).withColumn("start_", F.lit(True))
    known = known.join(first, ["conv_id", "block"], "left")
    start = F.when(F.col("start_"), F.array(F.lit(2 * len(ROLES)))).otherwise(F.array().cast("array<int>"))
    following = known.select(F.concat(start, F.col("x.state")).alias("x"))
    pairs = following.select(F.explode(F.arrays_zip(F.col("x").alias("a"), F.slice("x", F.lit(2), F.size("x")).alias("b"))).alias("p"))
    ends = known.select("conv_id", "block", F.col("x")[0]["state"].alias("first"), F.element_at("x", -1)["state"].alias("a"))
    over = ends.select("a", F.lead("first").over(Window.partitionBy("conv_id").orderBy("block")).alias("b"))  # from block to block
    steps = {(r["a"], r["b"]): r["count"] for r in pairs.select("p.a", "p.b").unionByName(over).where("a is not null and b is not null").groupBy("a", "b").count().collect()}
    return Model(steps, seen)


def decode(lines: DataFrame, model: Model) -> DataFrame:
    """(conv_id, block, number, entry, exit, goes_on): the best states around every block, its number from 0, and whether its last turn goes on in the next one."""
    n = 2 * len(ROLES)

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best, first = model.matrices(list(batch["symbols"]))
            yield pd.DataFrame({"conv_id": batch["conv_id"], "block": batch["block"], "best": list(best.reshape(len(best), -1)), "first": list(first.reshape(len(first), -1).astype(np.int32))})

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.concat([between(c, x) for c, x in zip(batch["conv_id"], batch["x"], strict=True)] or [pd.DataFrame(columns=["conv_id", "block", "number", "entry", "exit", "goes_on"])])

    def between(conv_id: str, found: list) -> pd.DataFrame:
        best, back = None, []
        for x in found:
            m = np.asarray(x["best"], dtype=float).reshape(n + 1, n)
            if best is None:
                best = m[-1]
            else:
                step = best[:, None] + m[:-1]
                back.append(step.argmax(axis=0))
                best = step.max(axis=0)
        exits = [int(best.argmax())]
        for b in reversed(back):
            exits.append(int(b[exits[-1]]))
        exits = exits[::-1]
        entries = [n, *exits[:-1]]
        later = [x["first"][a * n + b] % 2 == 1 for x, a, b in zip(found, entries, exits, strict=True)]
        return pd.DataFrame({"conv_id": conv_id, "block": [x["block"] for x in found], "number": range(len(found)), "entry": entries, "exit": exits, "goes_on": [*later[1:], False]})

    parts = blocks_of(lines).select("conv_id", "block", "symbols").mapInPandas(summary, "conv_id string, block string, best array<double>, first array<int>")
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "best", "first"))).alias("x"))
    return whole.mapInPandas(chain, "conv_id string, block string, number long, entry int, exit int, goes_on boolean")


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """Segments of one role each in canonical form; one with starts false goes on from the block before it, which leaves it open.

    Columns: conv_id, block (its number from 0), segment (from 0 in its block), starts, role, n_lines, rendered. lines: also as blocks.
    """
    blocks = blocks_of(lines)
    text_batches(lines.sparkSession)
    joined = blocks.select("conv_id", "block", "symbols", "lines").join(decode(blocks, model), ["conv_id", "block"])
    strip = re.compile("(?i)(" + "|".join(_pattern(r) for r in ROLES) + ")")

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[list] = []
            paths = model.paths(list(batch["symbols"]), batch["entry"].to_numpy(), batch["exit"].to_numpy())
            for conv_id, block, path, held, goes_on in zip(batch["conv_id"], batch["number"], paths, batch["lines"], batch["goes_on"], strict=True):
                own: list[list] = []
                for state, line in zip(path.tolist(), held, strict=True):
                    starts = state % 2 == 0
                    if starts or not own:
                        own.append([conv_id, block, len(own), starts, ROLES[state // 2], 0, []])
                    own[-1][5] += 1
                    own[-1][6].append(strip.sub("", line, count=1) if starts else line)
                for row in own:
                    close = "\n" if goes_on and row is own[-1] else CLOSE
                    row[6] = OPEN.format(role=row[4]) * row[3] + "\n".join(row[6]) + close
                rows += own
            yield pd.DataFrame(rows, columns=["conv_id", "block", "segment", "starts", "role", "n_lines", "rendered"])

    return joined.mapInPandas(segments, PARSED)


def reformat(turns: DataFrame) -> DataFrame:
    """Transcripts composed from the turns, each half of the conversations parsed by a model fitted to the other half's roles."""
    blocks = materialize(blocks_of(compose(turns)))
    half = F.pmod(F.xxhash64("conv_id", F.lit(3)), F.lit(2))
    halves = [blocks.where(half == h) for h in (0, 1)]
    parsed = parse(halves[0], fit(halves[1])).unionByName(parse(halves[1], fit(halves[0])))
    return parsed.withColumn("conv_id", F.expr("try_cast(conv_id as bigint)"))
