"""Conversations of a thousand turns and more."""

from registry import prompting


def test_answers_stay_in_their_conversation(spark, tmp_path):
    turns = [(c, t, "assistant" if t % 2 else "user", f"said {c} {t}") for c, n in ((1, 1010), (2, 10)) for t in range(n)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["prompt_1"].split('"')[1]: r for r in prompting.reason_three_hop(spark, str(tmp_path)).collect()}
    assert len(got) == 510
    for c, t, n in ((1, 2, 1010), (1, 1000, 1010), (1, 1002, 1010), (1, 1008, 1010), (2, 0, 10), (2, 2, 10), (2, 8, 10)):
        want = [f"said {c} {t + g}" if t + g < n else None for g in (1, 3, 5)]
        assert [got[f"said {c} {t}"][f"answer_{h}"] for h in (1, 2, 3)] == want
