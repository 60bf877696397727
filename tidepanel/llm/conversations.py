"""Conversation structure repair by a run-length dynamic program.

A row's symbol is the initial of its role with its fault. Equal consecutive symbols collapse into runs. A symbol has a
min-plus transition over the four states of the role pattern (nothing yet, after a system row, after a user row, after
an assistant row), whose binary powers are cached, so a run of n rows costs log n steps. The cheapest edits are then
unrolled from the front, always taking the least letter that still reaches the cheapest end.

Transitions are associative, so a conversation needn't be in one task. Narrow rows (no texts) are sorted by range; a
conversation inside one range is finished there, one that spans ranges is folded from one 4 x 4 matrix per range, and
each range unrolls its own rows. Only the digest of a repaired conversation is sequential, as SHA-256 is: its texts
are streamed in order past the audit and never held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import Batches, bounded_batches, staged

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]

#: Fixed values of the contract: costs of the edits, and white space.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"

NEVER = 1 << 50
MOST = (1 << 63) - 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a kept row, by state and role initial.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after an inserted row or one with a new role; each state allows just one of the two roles.
TURNED = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
GONE = "d"  # symbol of a row that has to be deleted; capitals are truncated rows, x is any other initial
RANGE_ROWS = 2_000_000
PIECE = 4096
"""Rows of a run that are unrolled from one list of costs."""
KEY = ["no_conv", "conv"]


def row_cost(symbol: str, state: int, letter: str) -> tuple[int, int]:
    """Cost and next state of deleting (D), keeping (K) or reroling (R) a row."""
    extra = TRUNCATED if symbol.isupper() else 0
    if letter == "D":
        return DELETE, state
    if symbol == GONE:
        return NEVER, state
    if letter == "K":
        after = KEPT.get((state, symbol.lower()))
        return (NEVER, state) if after is None else (extra, after)
    return REROLE + extra, TURNED[state]


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(NEVER, *(x + b[k][j] for k, x in enumerate(row))) for j in range(4)) for row in a)


@cache
def power(symbol: str, bit: int) -> Matrix:
    """Least costs from state to state over 2**bit rows of one symbol, insertions before a row included."""
    if bit:
        half = power(symbol, bit - 1)
        return product(half, half)
    out = [[NEVER] * 4 for _ in range(4)]
    for start in range(4):
        state, paid = start, 0
        for _ in range(3):  # more than two insertions in a row come back to a state met
            for letter in "DKR":
                cost, after = row_cost(symbol, state, letter)
                out[start][after] = min(out[start][after], paid + cost)
            state, paid = TURNED[state], paid + INSERT
    return tuple(map(tuple, out))


def before(matrix: Matrix, togo: Vector) -> Vector:
    """Least cost to the end from each state, before what the matrix stands for."""
    return tuple(min(x + y for x, y in zip(row, togo, strict=True)) for row in matrix)


#: Cost from each state after the last row: the pattern may end at the start or after an assistant row.
END: Vector = (0, 2 * INSERT, INSERT, 0)

Runs = list[tuple[str, int]]


def runs_of(symbols: str) -> Runs:
    return [(s, sum(1 for _ in same)) for s, same in groupby(symbols)]


def over_run(symbol: str, n: int, togo: Vector) -> Vector:
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            togo = before(power(symbol, bit), togo)
    return togo


def matrix_of(runs: Runs) -> Matrix:
    out = tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4))
    for symbol, n in runs:
        for bit in range(n.bit_length()):
            if n >> bit & 1:
                out = product(out, power(symbol, bit))
    return out


@cache
def relative_step(symbol: str, togo: Vector) -> tuple[Vector, int]:
    """:func:`before` for one row, as costs above the least one, and that one."""
    found = before(power(symbol, 0), togo)
    least = min(found)
    return tuple(x - least for x in found), least


@cache
def choice(symbol: str, state: int, togo: Vector) -> tuple[str, int]:
    """The least letters from a state over one row, insertions before it included, and the state after it."""
    now = before(power(symbol, 0), togo)
    left, letters = now[state], ""
    while True:
        cost, after = row_cost(symbol, state, "D")
        if cost + togo[after] == left:
            return letters + "D", after
        if INSERT + now[TURNED[state]] == left:
            state, letters, left = TURNED[state], letters + "I", left - INSERT
            continue
        for letter in "KR":
            cost, after = row_cost(symbol, state, letter)
            if cost + togo[after] == left:
                return letters + letter, after


def unrolled(runs: Runs, state: int, end: Vector) -> tuple[str, int]:
    """The least audit of these runs from ``state``, where ``end`` has the costs after them, and the state after them."""
    pieces = [(s, min(PIECE, n - at)) for s, n in runs for at in range(0, n, PIECE)]
    ends = [end]
    for symbol, n in reversed(pieces):
        ends.append(over_run(symbol, n, ends[-1]))
    out = []
    for (symbol, n), togo in zip(pieces, ends[-2::-1], strict=True):
        least = min(togo)
        steps = [tuple(x - least for x in togo)]
        for _ in range(n - 1):
            steps.append(relative_step(symbol, steps[-1])[0])
        for togo in reversed(steps):
            letters, state = choice(symbol, state, togo)
            out.append(letters)
    return "".join(out), state


def closing(state: int) -> str:
    return "I" * (END[state] // INSERT)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage, with their faults but for duplicates. A dropped row stays as a mark of its conversation (``gone``)."""
    blank = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").isNull().alias("no_conv"),
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("conv"),
        F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).alias("place"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    ).withColumn("kind", F.crc32("place") % 20)
    kind = F.col("kind")
    rows = rows.withColumns(
        {
            "gone": kind == 0,
            "role": F.when(kind == 4, F.lit("user")).otherwise(F.col("role")),
            "text": F.when(kind.isin(0, 1), F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
            "copy": F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
        }
    )
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    return rows.select(
        *KEY,
        "gone",
        "turn",
        "role",
        "text",
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)).alias("identity"),
        (F.length(end) == 0).alias("blank"),
        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x")).alias("initial"),
    )


ORDER = [*KEY, "turn", "role", "identity"]


def symbols(rows: DataFrame, partitions: int) -> DataFrame:
    """Narrow rows with their symbol and their place: range number ``part`` and ``pos``, both in the order of rows."""
    narrow = rows.select(*ORDER, "gone", "blank", "truncated", "initial")
    cut = narrow.repartitionByRange(partitions, *ORDER).sortWithinPartitions(*ORDER).withColumn("pos", F.monotonically_increasing_id())
    cut = staged(cut.drop("role").withColumn("part", F.shiftright("pos", 33).cast("int")))
    # the first of equal rows; met again by place, so that a very common row is no key of a join
    first = cut.where(~F.col("gone") & ~F.col("blank")).groupBy(*KEY, "identity").agg(F.min("pos").alias("pos"))
    marked = cut.join(first.select("pos", F.lit(True).alias("first")), "pos", "left")
    duplicate = ~F.col("blank") & F.col("first").isNull()
    symbol = F.when(F.col("blank") | duplicate, F.lit(GONE)).when(F.col("truncated"), F.upper("initial")).otherwise(F.col("initial"))
    return marked.select(
        *KEY,
        "part",
        "pos",
        "gone",
        F.col("turn").isNull().alias("no_turn"),
        F.coalesce("turn", F.lit(0)).alias("turn"),
        "blank",
        duplicate.alias("duplicate"),
        (~F.col("blank") & ~duplicate & F.col("truncated")).alias("truncated"),
        "initial",
        symbol.alias("symbol"),
    )


SEGMENT = (
    "no_conv boolean, conv bigint, part int, whole boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first string, last string, turns bigint, first_turn string, last_turn string, cost bigint, audit string, "
    "letters string, lengths array<bigint>, matrix array<bigint>"
)


Columns = dict[str, np.ndarray]


def segments(batches: Batches) -> Iterator[tuple[tuple, Columns]]:
    """``(no_conv, conv, part)`` and the columns of its rows, for rows that come in that order."""

    def merged(pieces: list[Columns]) -> Columns:
        return pieces[0] if len(pieces) == 1 else {c: np.concatenate([p[c] for p in pieces]) for c in pieces[0]}

    key, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        places = [columns[c] for c in (*KEY, "part")]
        new = np.zeros(len(batch), dtype=bool)
        for c in places:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), len(batch)]
        for a, b in zip(starts, starts[1:], strict=False):
            own = tuple(c[a].item() for c in places)
            if own != key and held:
                yield key, merged(held)
                held = []
            key = own
            held.append({c: v[a:b] for c, v in columns.items()})
    if held:
        yield key, merged(held)


def illegal_pairs(initials: str) -> int:
    return sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))


def described(key: tuple, rows: Columns, whole: bool) -> dict:
    if rows["gone"].any():
        stay = ~rows["gone"]
        rows = {c: v[stay] for c, v in rows.items()}
    initials, turns = "".join(rows["initial"]), rows["turn"][~rows["no_turn"]]
    runs = runs_of("".join(rows["symbol"]))
    out = dict(zip((*KEY, "part"), key, strict=True))
    out |= {c: int(rows[c].sum()) for c in ("blank", "duplicate", "truncated")} | {"whole": whole, "illegal": illegal_pairs(initials)}
    out |= {"first": initials[:1], "last": initials[-1:], "turns": int((turns[1:] != turns[:-1]).sum()) + min(len(turns), 1)}
    out |= {"first_turn": str(turns[0]) if len(turns) else None, "last_turn": str(turns[-1]) if len(turns) else None}
    if whole:
        togo = END
        for symbol, n in reversed(runs):
            togo = over_run(symbol, n, togo)
        audit, state = unrolled(runs, START, END)
        return out | {"cost": togo[START], "audit": audit + closing(state)}
    return out | {"letters": "".join(s for s, _ in runs), "lengths": [n for _, n in runs], "matrix": [x for row in matrix_of(runs) for x in row]}


def frame(rows: list[dict]) -> pd.DataFrame:
    columns = [c.split()[0] for c in SEGMENT.split(", ")]
    out = pd.DataFrame(rows, columns=columns, dtype=object)
    return out.where(out.notna(), None)


def summed(batches: Batches) -> Batches:
    """A row per conversation and range. The first and the last of a range may go on in another one; the rest are whole."""
    held, before_it, rows = None, None, []
    for segment in segments(batches):
        if held is not None:
            rows.append(described(*held, whole=before_it == held[0][-1] == segment[0][-1]))
            before_it = held[0][-1]
        held = segment
        if len(rows) >= 5000:
            yield frame(rows)
            rows = []
    if held is not None:
        rows.append(described(*held, whole=False))
    yield frame(rows)


@dataclass
class Joined:
    """What the segments of a conversation add up to."""

    totals: dict = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0))
    last: str = ""
    first_turn: int | None = None
    last_turn: int | None = None

    def add(self, row: dict) -> None:
        for name in self.totals:
            self.totals[name] += int(row[name])
        if row["first"]:
            self.totals["illegal"] += illegal_pairs(self.last + row["first"])
            self.last = row["last"]
        if row["first_turn"] is not None:
            self.totals["turns"] -= self.last_turn == int(row["first_turn"])
            self.first_turn = int(row["first_turn"]) if self.first_turn is None else self.first_turn
            self.last_turn = int(row["last_turn"])

    def gaps(self) -> int:
        return 0 if self.first_turn is None else min(self.last_turn - self.first_turn + 1 - self.totals["turns"], MOST)


RESULT = "no_conv boolean, conv bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def spanning(parts: DataFrame) -> DataFrame:
    """Results of the conversations that touch an end of a range: at most two segments a range."""

    def costs(rows: pd.DataFrame) -> pd.DataFrame:
        """The costs after each segment, folded from the last one, and the cost of all."""
        togo, out = END, []
        for row in rows.sort_values("part", ascending=False).to_dict("records"):
            out.append((row["no_conv"], row["conv"], row["part"], list(togo)))
            flat = [int(x) for x in row["matrix"]]
            togo = before(tuple(tuple(flat[4 * k : 4 * k + 4]) for k in range(4)), togo)
        return pd.DataFrame(out, columns=[*KEY, "part", "togo"]).assign(cost=togo[START])

    def pieces(batches: Batches) -> Batches:
        """The audit of a segment from each state, and the state after it."""
        for batch in batches:
            out = []
            for letters, lengths, togo in zip(batch["letters"], batch["lengths"], batch["togo"], strict=True):
                runs = list(zip(letters, map(int, lengths), strict=True))
                out.append([unrolled(runs, s, tuple(map(int, togo))) for s in range(4)])
            batch = batch.drop(columns=["letters", "lengths", "togo"])
            yield batch.assign(audits=[[a for a, _ in o] for o in out], after=[[s for _, s in o] for o in out])

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        state, audit, total = START, [], Joined()
        for row in rows.sort_values("part").to_dict("records"):
            audit.append(row["audits"][state])
            state = int(row["after"][state])
            total.add(row)
        values = {c: rows[c].iloc[0] for c in (*KEY, "cost")} | total.totals
        values |= {"gaps": total.gaps(), "audit": "".join(audit) + closing(state)}
        return pd.DataFrame([[values[c] for c in NAMES]], columns=NAMES)

    carried = [*KEY, "part", "blank", "duplicate", "truncated", "illegal", "first", "last", "turns", "first_turn", "last_turn"]
    types = dict(parts.dtypes)
    after = parts.select(*KEY, "part", "matrix").groupBy(*KEY).applyInPandas(costs, "no_conv boolean, conv bigint, part int, togo array<bigint>, cost bigint")
    with_costs = parts.select(*carried, "letters", "lengths").join(after, [*KEY, "part"])
    schema = ", ".join(f"{c} {types[c]}" for c in carried) + ", cost bigint, audits array<string>, after array<int>"
    return with_costs.mapInPandas(pieces, schema).groupBy(*KEY).applyInPandas(finish, RESULT)


def digests(batches: Batches) -> Batches:
    """Hashes of repaired conversations. Rows come by conversation, its audit first, then its rows in order; none is held."""
    key, audit, at, state, hashed, some, out = None, "", 0, START, None, False, []

    def put(line: str) -> None:
        nonlocal some
        hashed.update((("\n" if some else "") + line).encode("utf-8", "surrogatepass"))
        some = True

    def inserted() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = TURNED[state]
            put(ROLES[state] + ":")
            at += 1

    def close() -> None:
        inserted()
        out.append((*key, hashed.hexdigest()))

    for batch in batches:
        for no_conv, conv, first, role, text, own in zip(*(batch[c] for c in (*KEY, "head", "role", "text", "audit")), strict=True):
            if first:
                if key is not None:
                    close()
                key, audit, at, state, hashed, some = (no_conv, conv), own, 0, START, hashlib.sha256(), False
                continue
            inserted()
            letter = audit[at]
            at += 1
            if letter == "K":
                state = KEPT[state, role[0]]
                put(f"{role}:{text}")
            elif letter == "R":
                state = TURNED[state]
                put(f"{ROLES[state]}:{text}")
        if len(out) >= 5000:
            yield pd.DataFrame(out, columns=[*KEY, "repaired_sha256"])
            out = []
    if key is not None:
        close()
    yield pd.DataFrame(out, columns=[*KEY, "repaired_sha256"])


def range_count(conversations: DataFrame) -> int:
    return max(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), conversations.count() // RANGE_ROWS + 1)


def audits(rows: DataFrame, partitions: int) -> DataFrame:
    """Counts, cost and audit of every conversation of :func:`damaged` rows."""
    placed = symbols(rows, partitions)
    found = staged(placed.repartition(partitions, "part").sortWithinPartitions("part", "pos").mapInPandas(summed, SEGMENT))
    span = F.col("last_turn").cast("decimal(20,0)") - F.col("first_turn").cast("decimal(20,0)") + 1 - F.col("turns")
    gaps = F.when(span.isNull(), F.lit(0)).otherwise(F.least(span, F.lit(MOST))).cast("bigint")
    whole = found.where("whole").withColumn("gaps", gaps).select(NAMES)
    return whole.unionByName(spanning(found.where("not whole")))


def repaired(conversations: DataFrame) -> DataFrame:
    """Audit of every conversation: what is wrong with it after damage, and its cheapest repair.

    One row per different ``conv_id`` of the table, null included: ``conv_id``, ``gaps``, ``blank``, ``duplicate``,
    ``truncated``, ``illegal``, ``cost`` (longs), ``audit`` and ``repaired_sha256``. A null role or text, and a null id
    or turn in the place that is hashed, is one space. Rows are ordered by turn, nulls first; rows of one turn by role,
    then by the hash of role and text, so repeated rows lie side by side and all but the first are duplicates. A role
    whose initial is none of s, u and a (an empty one too) can't be kept. A conversation without rows after damage has zeros, an
    empty audit and the hash of nothing; an empty table gives no rows. Texts are read whole, of any length. Columns
    beyond conv_id, turn, role and text play no part, whatever their names.
    """
    bounded_batches(conversations.sparkSession)
    partitions = range_count(conversations)
    rows = damaged(conversations)
    found = staged(audits(rows, partitions))
    heads = found.select(*KEY, F.lit(True).alias("head"), "audit")
    texts = rows.where(~F.col("gone")).select(*ORDER, "text", F.lit(False).alias("head"))
    stream = texts.unionByName(heads, allowMissingColumns=True).repartition(partitions, *KEY)
    stream = stream.sortWithinPartitions(*KEY, F.desc("head"), "turn", "role", "identity").select(*KEY, "head", "role", "text", "audit")
    hashes = stream.mapInPandas(digests, "no_conv boolean, conv bigint, repaired_sha256 string")
    conv_id = F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id")
    return found.join(hashes, KEY).select(
        conv_id, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )
