import duckdb
import pytest

from quillon.llm import oracle, perspectives
from tests.llm.frames import listed

SCHEMA = "conv_id long, turn long, role string, text string, seq string, start string, segment string"
ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|> é🙂"), (1, 2, "bob lee", "yo <\\| x"), (1, 2, "ann", "tie"), (1, 2, "ann", "tie"),
    (1, 900, "cy", None), (2, 0, "ann", ""), (3, 0, "system", "alone"), (None, 1, "ann", "no id"), (None, 0, "bob", "no id"),
    (4, None, "x", "no turn"), (4, 5, None, "nameless"), (4, -7, "y", "early"), (5, 0, None, "nobody"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", "own", "own") for r in rows], SCHEMA)


@pytest.mark.parametrize("parts", [None, 1, 16])
def test_against_sql(spark, parts):
    rows = ROWS + [(9, i, f"s{i % 3}", "word " * (i % 7)) for i in range(600)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    result = con.execute(oracle.ORACLE["op7_perspectives"].replace("url_encode(role)", "replace(url_encode(role), '%20', '+')"))
    names = [d[0] for d in result.description]
    out = perspectives.perspectives(frame(spark, rows), parts=parts)
    assert listed(out, *names) == sorted(result.fetchall(), key=str)


def test_dialogues_rebuild_the_texts(spark):
    out = perspectives.perspectives(frame(spark, ROWS)).collect()
    dialogues = {}
    for r in sorted(out, key=lambda r: r.seq):
        key = (r.conv_id, r.perspective)
        assert r.start == len(dialogues.get(key, "")) and r.seq == dialogues.get(("n", key), 0)
        dialogues[key] = dialogues.get(key, "") + r.segment
        dialogues["n", key] = r.seq + 1
        assert r.end == len(dialogues[key])
    texts = {(c, r): t for c, _, r, t in ROWS}
    for r in out:
        own = r.role == r.perspective
        assert (r.mask_start is not None) == own == r.segment.startswith("<|assistant|>")
        if own:
            learned = dialogues[r.conv_id, r.perspective][r.mask_start:r.mask_end]
            assert learned.endswith("<|end|>") and "<|" not in learned[:-7]
            if (r.conv_id, r.role) == (1, "bob lee"):
                assert learned == "yo <\\\\| x<|end|>"
    assert texts and {k for k in dialogues if k[0] != "n"} == {
        (1, "ann"), (1, "bob lee"), (1, "cy"), (2, "ann"), (None, "ann"), (None, "bob"), (4, "x"), (4, "y")}


def test_escape_can_be_undone(spark):
    texts = ["<|end|>", "<\\|", "<\\\\| a <|", "plain", "", "<||>", "\\<|"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", perspectives.escaped(df.t).alias("e")).withColumn("back", perspectives.unescaped("e")).collect()
    assert all(r.t == r.back and "<|" not in r.e for r in out)


def test_no_turns(spark):
    assert perspectives.perspectives(frame(spark, [])).count() == 0


def test_turns_without_numbers_cross_many_ranges(spark):
    """Twice the turns without a number, the same share of them in the largest range."""
    for n in (2000, 4000):
        rows = [(1, None, ["ann", "bob"][i % 2], f"text {i}") for i in range(n)] + [(2, 5, "ann", f"same number {i}") for i in range(n)]
        cut = perspectives.ranged(perspectives.rendered(frame(spark, rows)), 16)
        sizes = [r["count"] for r in cut.groupBy("conv_id", "perspective", "block").count().collect()]
        assert sum(sizes) == 3 * n and max(sizes) < 0.15 * 3 * n
        out = perspectives.placed(cut).where("conv_id = 1 and perspective = 'ann'").select("seq", "segment").orderBy("seq").collect()
        assert [r.seq for r in out] == list(range(n))
        texts = [r.segment.split("\n")[1] for r in out]
        assert texts == [f"{t}<|end|>" for k in (0, 1) for t in sorted(f"text {i}" for i in range(k, n, 2))]
