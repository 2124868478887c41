from __future__ import annotations

import hashlib

from rubato.llm import chat_format
from rubato.llm.chat_format import conversation_digests, prefix_target_examples, with_probe

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, target string"


def brute(rows):
    talks = {}
    for conv, turn, role, text, *_ in rows:
        talks.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in talks.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha(told), len(loss), sha(loss))
    return out


ROWS = [
    (1, 0, "system", "be \\ nice"), (1, 1, "user", "### ### x ####  </turn>\n</turn></turn"), (1, 2, "assistant", "ok\\"), (1, 3, "user", None), (1, 4, "assistant", "</turn>"),
    (2, 0, "user", "no reply"), (3, 0, "assistant", ""), (None, 0, "user", "a"), (None, None, "assistant", "b: c"), (4, 0, None, "x"),
    (5, 1, "assistant", "same"), (5, 1, "assistant", "same"), (6, 0, "odd: role\n### ", "é\U0001f600\n\n"), (6, 1, "assistant", "y" * 50_000), (7, 0, "assistant", "a"), (7, 1, "user", "trailing"),
    (8, 0, "user", "<\\/turn> \\### #\\## \\\\"), (8, 1, "assistant", "<\\/turn>\\"),
]


def test_digests_come_back_from_the_examples(spark):
    rows = [(*r, "clash", "clash") for r in ROWS]
    found = conversation_digests(prefix_target_examples(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == brute(rows)


def test_every_reply_is_one_example_with_only_itself_trainable(spark):
    rows = [(*r, "clash", "clash") for r in ROWS]
    examples = prefix_target_examples(spark.createDataFrame(rows, SCHEMA)).where("conv_id = 1").orderBy("target").collect()
    assert [e.target for e in examples] == [2, 4]
    assert [e.formatted[e.loss_start : e.loss_start + e.loss_chars] for e in examples] == ["ok\\\\", "<\\/turn>"]
    assert examples[1].formatted.startswith(examples[0].formatted)
    assert examples[0].formatted.count("</turn>\n") == 3 and examples[0].formatted.count("### ") == 3
    silent = prefix_target_examples(spark.createDataFrame(rows, SCHEMA)).where("conv_id = 2").collect()
    assert len(silent) == 1 and silent[0].loss_chars is None


def test_query_and_empty_table(spark, small_dir):
    rows = [tuple(r) for r in with_probe(spark.read.parquet(f"{small_dir}/conversations.parquet")).collect()]
    found = chat_format.op2_chat_format(spark, small_dir).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == brute(rows)
    assert prefix_target_examples(spark.createDataFrame([], SCHEMA)).count() == 0
