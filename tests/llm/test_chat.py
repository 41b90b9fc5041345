import hashlib

from concord.llm import chat, queries, sql
from tests.llm.oracle import SF, rows_of, rows_of_sql

ROWS = [
    (1, 0, "user", "hi\n### x: </turn>\n"), (1, 1, "assistant", "\\h \\\\t ###</turn>"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, 0, "sys: a", "### a: b"), (2, None, None, "first"), (3, 0, "assistant", "é😀"), (3, 0, "assistant", "é😀"), (None, 1, "assistant", "n"),
    (4, 0, "assistant", "a" * 50000), (4, 1, "user", ": </turn>"),
]


def test_round_trip_and_masks(spark):
    df = spark.createDataFrame([(*r, 9) for r in ROWS], "conv_id long, turn long, role string, text string, example int")
    examples = chat.expand(df)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for conv in {r[0] for r in ROWS}:
        own = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x in ROWS if c == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = examples.filter("conv_id = 1").orderBy("example").collect()
    assert [r.last for r in one] == [False, True] and one[1].formatted.startswith(one[0].formatted)
    assert one[0].formatted.count("### ") == 2 and one[0].formatted.count("</turn>") == 2
    assert chat.expand(df.limit(0)).count() == 0


def test_main_path_is_native(spark):
    plan = queries.op3_chat_formatting(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_matches_sql(spark):
    assert rows_of(queries.op3_chat_formatting(spark, SF)) == rows_of_sql(sql.ORACLES["op3_chat_formatting"])
