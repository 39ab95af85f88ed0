"""Repair of conversations: the cheapest edits to a valid order of speakers, over a grammar that conversations share.

A conversation is a string of symbols, one a turn. Re-Pair replaces frequent pairs of symbols of all conversations by rules; each
rule has one min-plus matrix over the states of the valid order, made from the matrices of its two symbols.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.tables import written

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
#: Symbols of a turn: its role's initial, in upper case if the turn is truncated ("o", "O" for other roles), and "x" for
#: turns that must be deleted.
SYMBOLS = "suaoSUAOx"
MUST_GO = "x"
VALID_PAIRS = {"su", "ua", "au"}
#: States of the valid order: nothing yet, after the system turn, after a user's, after an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
#: Turns in a block; a longer conversation is several blocks, cut in parallel.
BLOCK = 1024
#: Rules that a round of Re-Pair may add, and rounds. They bound the grammar, not the result: a string that is still
#: several symbols long is evaluated symbol by symbol.
ROUND_RULES = 256
ROUNDS = 12

# --- min-plus matrices with ropes -----------------------------------------------------------------------------------
# An entry is None (no way) or (cost, rope). A rope is a string or a pair of ropes, so that rules share their parts.


def flat(rope: str | tuple) -> str:
    """The string of a rope."""
    out, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            stack += (top[1], top[0])
    return "".join(out)


def better(a: tuple | None, b: tuple | None) -> tuple | None:
    """The cheaper entry; of equal costs the one whose edits are least by ASCII.

    Both entries edit the same turns from the same state to the same state, so neither's edits are the beginning of the
    other's (the rest would be insertions, which cost), and the order stays the same whatever follows.
    """
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1] == b[1] or flat(a[1]) <= flat(b[1]) else b


def then(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return None
    return a[0] + b[0], a[1] if b[1] == "" else b[1] if a[1] == "" else (a[1], b[1])


def product(a: list, b: list) -> list:
    """The matrix of a string whose parts have the matrices ``a`` and ``b``."""
    out = []
    for i in STATES:
        row = []
        for j in STATES:
            best = None
            for k in STATES:
                best = better(best, then(a[i][k], b[k][j]))
            row.append(best)
        out.append(row)
    return out


def _steps(edits: Iterable[tuple[int, int, int, str]]) -> list:
    matrix = [[None] * len(STATES) for _ in STATES]
    for i, j, cost, letter in edits:
        matrix[i][j] = better(matrix[i][j], (cost, letter))
    return matrix


def insertions() -> list:
    """The matrix of no turn: insertions alone. More than two lead back to a state."""
    one = _steps([(i, i, 0, "") for i in STATES] + [(i, j, INSERT, "I") for (i, role), j in NEXT.items() if role in "ua"])
    return product(one, one)


def turn_matrix(symbol: str) -> list:
    """The matrix of one turn, with the insertions before it."""
    edits = [(i, i, DELETE, "D") for i in STATES]
    if symbol != MUST_GO:
        extra = TRUNCATED if symbol.isupper() else 0
        for (i, role), j in NEXT.items():
            if role == symbol.lower():
                edits.append((i, j, KEEP + extra, "K"))
            if role in "ua":
                edits.append((i, j, REROLE + extra, "R"))
    return product(insertions(), _steps(edits))


# --- grammar --------------------------------------------------------------------------------------------------------
# A rule is a pair of symbols; its number follows those of the turns and of earlier rules.

#: Matrices by grammar, kept by each Python worker so that the tasks it runs share them.
_KNOWN: dict[str, list] = {}


class Grammar:
    """Rounds of rules. A round replaces its pairs from the left, then the next round follows."""

    def __init__(self, rounds: list[list[tuple[int, int]]]) -> None:
        self.rounds, number = [], len(SYMBOLS)
        for pairs in rounds:
            self.rounds.append({pair: number + i for i, pair in enumerate(pairs)})
            number += len(pairs)
        self.key = hashlib.sha256(repr(rounds).encode()).hexdigest()

    def compressed(self, text: str) -> list[int]:
        """A string of turns as symbols and rules."""
        symbols = [SYMBOLS.index(c) for c in text]
        for rules in self.rounds:
            out, i, last = [], 0, len(symbols) - 1
            while i <= last:
                rule = rules.get((symbols[i], symbols[i + 1])) if i < last else None
                out.append(symbols[i] if rule is None else rule)
                i += 1 if rule is None else 2
            symbols = out
        return symbols

    def matrices(self) -> list:
        """The matrix of every symbol, bottom-up: turns, then the rules of each round."""
        if self.key not in _KNOWN:
            known = [turn_matrix(s) for s in SYMBOLS]
            for rules in self.rounds:
                known += [product(known[a], known[b]) for a, b in rules]
            _KNOWN.clear()
            _KNOWN[self.key] = known
        return _KNOWN[self.key]

    def matrix(self, text: str) -> list:
        """The matrix of a string with at least one turn."""
        known = self.matrices()
        first, *rest = self.compressed(text)
        matrix = known[first]
        for symbol in rest:
            matrix = product(matrix, known[symbol])
        return matrix


def pairs_of(symbols: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbours; of three equal symbols the first two alone, as both pairs can't be replaced."""
    taken = -2
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        if pair[0] == pair[1]:
            if taken == i - 1:
                continue
            taken = i
        yield pair


def learned(strings: DataFrame, rules: int = ROUND_RULES, rounds: int = ROUNDS) -> Grammar:
    """Re-Pair over a frame of distinct ``symbols`` strings, in rounds of at most ``rules`` new rules.

    A round counts the neighbours in all strings (a sum that combines before its shuffle) and makes rules of the most
    frequent ones that occur twice or more. The driver holds these alone, at most ``rules * rounds``. It ends when no
    pair repeats.
    """
    done: list[list[tuple[int, int]]] = []
    while len(done) < rounds:
        sofar = Grammar(done)

        def count(batches: Iterator[pa.RecordBatch], sofar: Grammar = sofar) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts: Counter = Counter()
                for text in batch.column(0).to_pylist():
                    counts.update(pairs_of(sofar.compressed(text)))
                columns = [[a for a, _ in counts], [b for _, b in counts], list(counts.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])

        pairs = strings.select("symbols").mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        top = pairs.where("n > 1").orderBy(F.desc("n"), "a", "b").limit(rules).collect()
        if not top:
            break
        done.append([(r.a, r.b) for r in top])
    return Grammar(done)


class Fold:
    """The blocks of a conversation in order: the best edits to each state. What the edits to all states begin with is
    settled and set aside, so the rest stays short."""

    def __init__(self) -> None:
        self.settled: list[str] = []
        self.at: list[tuple[int, str] | None] = [(0, "")] + [None] * (len(STATES) - 1)

    def add(self, matrix: list) -> None:
        at = []
        for j in STATES:
            best = None
            for k in STATES:
                step = then(self.at[k], matrix[k][j])
                best = better(best, step)
            at.append(None if best is None else (best[0], flat(best[1])))
        live = [a[1] for a in at if a]
        low, high = min(live), max(live)
        same = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        self.settled.append(low[:same])
        self.at = [a and (a[0], a[1][same:]) for a in at]

    def result(self) -> tuple[int, str]:
        """The least cost and its edits, with insertions after the last turn."""
        self.add(insertions())
        best = None
        for state in FINAL:
            best = better(best, self.at[state])
        return best[0], "".join(self.settled) + best[1]


# --- conversations --------------------------------------------------------------------------------------------------

ORDER = ["conv_id", "turn", "role", "digest"]
SPACES = " \t\n\x0b\x0c\r"
BLOCKS = ("conv_id long, part int, block long, symbols string, blank long, duplicate long, truncated long, illegal long, "
          "first string, last string")
EDITED = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
COUNTS = ("blank", "duplicate", "truncated")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, digest, copies`` of the rows that are left after damage by the CRC of ``conv_id:turn``.

    Modulo 20, 0 drops a row, 1 empties its text, 2 takes its marks of sentence ends, 3 makes it two copies, and 4 makes it a
    user's. Nulls count as one space, but stay null as conv_id and turn.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("fate <> 0").select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def classified(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, blank, cut, again, copies``: equal rows of a turn as one, with their faults; ``again`` if role
    and text were seen in an earlier turn. Only digests are shuffled, and equal rows are counted before."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    counted = rows.groupBy("conv_id", "turn", "role", "digest", (trimmed == "").alias("blank"),
                           (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut")).agg(F.sum("copies").alias("copies"))
    counted = written(counted, "turns")
    firsts = counted.groupBy("conv_id", "role", "digest").agg(
        F.count("*").alias("turns"), F.max(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("least"))
    firsts = firsts.where("turns > 1").select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"),
                                              F.col("digest").alias("_digest"), "unnumbered", "least")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    again = F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("turn") > F.col("least")))
    return counted.join(firsts, same, "left").select(*ORDER, "blank", "cut", F.coalesce(again, F.lit(False)).alias("again"), "copies")


class Block:
    """Up to ``BLOCK`` turns of a conversation: their symbols and what is counted in them."""

    def __init__(self, conv_id: int | None, part: int, number: int) -> None:
        self.name = (conv_id, part, number)
        self.symbols: list[str] = []
        self.counts = dict.fromkeys(COUNTS, 0)
        self.illegal, self.first, self.last = 0, None, None

    def add(self, initial: str, fault: str | None) -> None:
        if fault:
            self.counts[fault] += 1
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in VALID_PAIRS
        self.last = initial
        symbol = initial if initial in ("s", "u", "a") else "o"
        self.symbols.append(MUST_GO if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol)

    def row(self) -> tuple:
        return (*self.name, "".join(self.symbols), *self.counts.values(), self.illegal, self.first, self.last)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


_STRINGS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("symbols", pa.string()),
                      *[(c, pa.int64()) for c in (*COUNTS, "illegal")], ("first", pa.string()), ("last", pa.string())])
_EDITED = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in (*COUNTS, "illegal", "cost")], ("audit", pa.string())])


def blocks(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """The classified turns as strings: a row per block, by ``conv_id, part, block``.

    Turns are sorted over range partitions, which a long conversation crosses, so that its blocks are made in many tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            block = None
            for conv_id, role, blank, cut, again, copies, part in _rows(
                    batches, ["conv_id", "role", "blank", "cut", "again", "copies", "part"]):
                for copy in range(copies):
                    if block is None or block.name[0] != conv_id or len(block.symbols) == size:
                        if block:
                            yield block.row()
                        block = Block(conv_id, part, block.name[2] + 1 if block else 0)
                    fault = "blank" if blank else "duplicate" if again or copy else "truncated" if cut else None
                    block.add(role[:1], fault)
            if block:
                yield block.row()

        return _batches(each(), _STRINGS)

    ranged = turns.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return written(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(run, BLOCKS), "blocks")


def edits(strings: DataFrame, rules: Grammar) -> DataFrame:
    """``conv_id``, counts, ``cost`` and ``audit`` of every conversation: block matrices, made in parallel, folded in order."""
    entry = pa.struct([("cost", pa.int64()), ("audit", pa.string())])
    schema = f"{BLOCKS.replace('symbols string, ', '')}, entries array<struct<cost:bigint,audit:string>>"

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, list] = {}
            entries = []
            for text in batch.column("symbols").to_pylist():
                if text not in known:
                    known[text] = [e and {"cost": e[0], "audit": flat(e[1])} for row in rules.matrix(text) for e in row]
                entries.append(known[text])
            rest = batch.drop_columns(["symbols"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(entries, pa.list_(entry))], names=[*rest.schema.names, "entries"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            state, conv, counts, last = None, None, None, None
            for conv_id, first, end, entries, *found in _rows(batches, ["conv_id", "first", "last", "entries", *COUNTS, "illegal"]):
                if state is None or conv_id != conv:
                    if state:
                        yield conv, *counts, *state.result()
                    state, conv, counts = Fold(), conv_id, [0, 0, 0, 0]
                else:
                    counts[-1] += last + first not in VALID_PAIRS
                counts = [a + b for a, b in zip(counts, found)]
                found = [e and (e["cost"], e["audit"]) for e in entries]
                state.add([found[i:i + len(STATES)] for i in range(0, len(found), len(STATES))])
                last = end
            if state:
                yield conv, *counts, *state.result()

        return _batches(each(), _EDITED)

    evaluated = strings.mapInArrow(evaluate, schema)
    return evaluated.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(fold, EDITED)


class Repaired:
    """The digest of a repaired conversation, turn by turn, by its audit."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START
        self.sha, self.empty = hashlib.sha256(), True

    def _put(self, role: str, text: str, initial: str) -> None:
        self.sha.update(("" if self.empty else "\n").encode() + role.encode() + b":")
        self.sha.update(text.encode())
        self.state, self.empty = NEXT[self.state, initial], False

    def _made(self, text: str) -> None:
        role = "assistant" if self.state == USER else "user"
        self._put(role, text, role[0])

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self._made("")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._put(role, text, role[:1])
        elif letter == "R":
            self._made(text)

    def result(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


def repaired(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """``edited`` with ``repaired_sha256``: the turns of a conversation stream past its audit in order, and none is held."""
    carried = ["conv_id", *COUNTS, "illegal", "cost", "audit"]
    heads = edited.select(*carried, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"))
    turns = rows.select("conv_id", *[F.lit(None).cast("long").alias(c) for c in carried[1:-1]], F.lit(None).cast("string").alias("audit"),
                        F.lit(1).alias("kind"), "turn", "role", "digest", "text", "copies")
    schema = pa.schema([*_EDITED, ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            head, state = None, None
            for kind, role, text, copies, *values in _rows(batches, ["kind", "role", "text", "copies", *carried]):
                if kind == 0:
                    if state:
                        yield *head, state.result()
                    head, state = values, Repaired(values[-1])
                else:
                    for _ in range(copies):
                        state.turn(role, text)
            if state:
                yield *head, state.result()

        return _batches(each(), schema)

    sort = ["conv_id", "kind", "turn", "role", "digest"]
    both = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions(*sort)
    return both.mapInArrow(run, f"{EDITED}, repaired_sha256 string")


def repairs(conversations: DataFrame, size: int = BLOCK, rules: int = ROUND_RULES) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation, damaged first.

    A turn's first fault counts. ``audit`` has a letter for each edit of the cheapest repair to an optional system turn and
    pairs of user and assistant turns: K keeps a turn, R gives it the role that is due, D deletes it, I inserts an empty turn.

    Turns go by number (null first), then by role and the digest of their text, so ties have one order and equal rows are
    next to each other. Rows without a conv_id are one conversation. A conversation whose turns were all dropped has zeros, an
    empty audit and the digest of nothing; an empty table gives no rows. Other columns are ignored.

    A long conversation is cut into blocks of ``size`` turns over many tasks. Its audit, and the digest of its repaired
    text, are one value each: for these one task reads its blocks and turns as a stream, without holding them.
    """
    rows = damaged(conversations)
    strings = blocks(written(classified(rows), "classified"), size)
    found = edits(strings, learned(written(strings.select("symbols").distinct(), "strings"), rules))
    hashed = repaired(rows, found)
    numbers = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    every, n, h = conversations.select("conv_id").distinct().alias("e"), numbers.alias("n"), hashed.alias("h")
    zero = F.lit(0).cast("long")
    return (every.join(n, F.col("e.conv_id").eqNullSafe(F.col("n.conv_id")), "left")
            .join(h, F.col("e.conv_id").eqNullSafe(F.col("h.conv_id")), "left")
            .select("e.conv_id", F.coalesce("gaps", zero).alias("gaps"), *[F.coalesce(c, zero).alias(c) for c in (*COUNTS, "illegal", "cost")],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")))
