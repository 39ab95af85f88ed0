"""Repairs against trying every sequence of edits."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from quillon.llm import conversation_repair as cr
from quillon.llm.tables import _setting

COLUMNS = "conv_id long, turn long, role string, text string"
INITIAL = {"K": 0, "R": 3, "D": 4, "I": 3}


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        body = text.strip(" \t\n\v\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def apply(turns, found, audit):
    """Cost and repaired turns of an audit, or None if it isn't allowed."""
    cost, out, i = 0, [], 0
    for letter in audit:
        due = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if letter == "I":
            cost, out = cost + 3, [*out, (due, "")]
            continue
        if i == len(turns):
            return None
        (role, text), fault = turns[i], found[i]
        i += 1
        if letter == "D":
            cost += 4
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += (3 if letter == "R" else 0) + (3 if fault else 0)
        out.append((role if letter == "K" else due, text))
    if i < len(turns) or not re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
        return None
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


def exhaustive(turns):
    """The best over all audits with up to a few insertions."""
    found = faults(turns)
    best = None
    for length in range(len(turns), len(turns) + 4):
        for letters in product("DIKR", repeat=length):
            if sum(x != "I" for x in letters) == len(turns):
                made = apply(turns, found, "".join(letters))
                if made and (best is None or made[:2] < best[:2]):
                    best = made
    return best


def dynamic(turns):
    """The best by states, with whole strings."""
    found = faults(turns)
    at = {0: (0, "")}

    def inserted(at):
        for _ in range(2):
            for (i, role), j in cr.NEXT.items():
                if role != "s" and i in at:
                    at[j] = min(at.get(j, (10 ** 9, "")), (at[i][0] + 3, at[i][1] + "I"))
        return at

    for (role, _), fault in zip(turns, found):
        at, after = inserted(at), {}

        def go(j, cost, letter, after=after):
            after[j] = min(after.get(j, (10 ** 9, "")), (cost, letter))

        for i, (cost, way) in at.items():
            go(i, cost + 4, way + "D")
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                for (k, r), j in cr.NEXT.items():
                    if k == i and r == role[:1]:
                        go(j, cost + extra, way + "K")
                    if k == i and r != "s":
                        go(j, cost + extra + 3, way + "R")
        at = after
    at = inserted(at)
    best = min(at[s] for s in cr.FINAL if s in at)
    return apply(turns, found, best[1])


def brute(rows):
    out, convs = [], {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        kept = (turn, "user" if fate == 4 else role, text)
        convs[conv] += [] if fate == 0 else [kept] * (2 if fate == 3 else 1)
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = [r[1:] for r in kept]
        numbers = [r[0] for r in kept if r[0] is not None]
        found = faults(turns)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
        cost, audit, text = dynamic(turns)
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, found.count("blank"),
                    found.count("duplicate"), found.count("truncated"), sum(p not in cr.VALID_PAIRS for p in pairs), cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df, **options):
    return sorted((tuple(r) for r in cr.repairs(df, **options).collect()), key=str)


def random_turns(rng, n):
    roles = ["system", "user", "assistant", "tool", "", "u", "Assistant"]
    texts = ["Yes.", "No", "", " \n", "Why?", "Go!  ", "é", "a.b"]
    return [(rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}" + rng.choice([".", ""]))
            for _ in range(n)]


def test_states_find_what_all_edits_find():
    rng = random.Random(1)
    for n in (0, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 4, 4):
        turns = random_turns(rng, n)
        assert dynamic(turns) == exhaustive(turns), turns


def test_matrices_of_any_grammar_and_cut():
    rng = random.Random(2)
    for trial in range(60):
        text = "".join(rng.choice(cr.SYMBOLS) for _ in range(rng.randrange(1, 40)))
        rounds, symbols = [], list(range(len(cr.SYMBOLS)))
        for _ in range(3):
            rounds.append([(rng.choice(symbols), rng.choice(symbols)) for _ in range(12)])
            rounds[-1] = list(dict.fromkeys(rounds[-1]))
            symbols += range(symbols[-1] + 1, symbols[-1] + 1 + len(rounds[-1]))
        answers = set()
        for grammar in (cr.Grammar([]), cr.Grammar(rounds)):
            for cut in (1, 7, 100):
                fold = cr.Fold()
                for at in range(0, len(text), cut):
                    fold.add([[e and (e[0], cr.flat(e[1])) for e in row] for row in grammar.matrix(text[at:at + cut])])
                answers.add(fold.result())
        roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
        turns = [(roles[c.lower()], "" if c == "x" else f"{i}" + ("" if c.isupper() else ".")) for i, c in enumerate(text)]
        assert answers == {dynamic(turns)[:2]}, text


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t if rng.random() < 0.9 else None, *turn) for c in range(150) for t, turn in enumerate(random_turns(rng, rng.randrange(0, 9)))]
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (7, 2, None, None), (7, 2, "user", "Hi."), (7, 2, "user", "Hi."), (8, -5, "user", "x")]
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    assert result(df) == brute(rows)
    assert result(df, size=3, rules=2) == brute(rows)


def test_long_conversation_crosses_blocks_and_partitions(spark):
    rng = random.Random(4)
    rows = [(1, t, *turn) for t, turn in enumerate(random_turns(rng, 3000))] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    rows += [(3, None, "user", f"text {i}.") for i in range(500)] + [(4, 9, "user", "same") for _ in range(300)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert result(df, size=64) == brute(rows)
    with _setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):  # these turns would fit one partition
        strings = cr.blocks(cr.classified(cr.damaged(df)), 64)
    assert strings.where("conv_id = 1").select("part").distinct().count() > 1
    assert strings.agg(F.max(F.length("symbols"))).first()[0] <= 64


def test_empty_table_clashing_columns_and_dropped_conversations(spark):
    assert cr.repairs(spark.createDataFrame([], COLUMNS)).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Hi."), (5000, None, "assistant", "é" * 200_000)]
    df = spark.createDataFrame(rows, COLUMNS)
    for name in ("part", "block", "symbols", "cost", "audit", "digest", "copies", "kind", "blank", "_conv", "gaps"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    assert result(df) == brute(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in result(df)


def test_frequent_pairs_become_rules(spark):
    strings = spark.createDataFrame([("uaua" * 8,), ("suauaua",), ("xx",), ("xxx",)], "symbols string")
    grammar = cr.learned(strings)
    assert len(grammar.compressed("ua" * 16)) <= 4 and grammar.rounds
    assert cr.learned(spark.createDataFrame([("su",)], "symbols string")).rounds == []


@pytest.mark.parametrize(("symbols", "pairs"), [([1, 1, 1], 1), ([1, 1, 1, 1], 2), ([1, 1, 2, 1, 1], 4), ([], 0), ([3], 0)])
def test_equal_neighbours_count_once(symbols, pairs):
    assert len(list(cr.pairs_of(symbols))) == pairs
