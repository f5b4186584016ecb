"""Training examples against brute force."""

import json
import math
import random
from datetime import timedelta

from pyspark.sql import functions as F

from echolens.operators import training
from echolens.sources.snapshots import count_jsonl, write_jsonl

from conftest import START, plan_of

QUESTION_WORDS = ("how", "why", "what", "when", "where", "can i", "is it possible")


def _pairs(rows, head=None, question=None, answer=None):
    threads = {}
    for row in sorted(rows, key=lambda r: (r["created_at"], r["id"])):
        threads.setdefault(row.get("thread_id") or row["id"], []).append(row)
    found = {}
    for thread, (first, *rest) in threads.items():
        text = first["content"]
        asks = first.get("content_type") == "question" or "?" in text
        asks = asks or any(word in text.lower()[:head] for word in QUESTION_WORDS)
        good = [r for r in rest if len(r["content"]) >= 100 and r["content"].count("?") <= 2]
        if asks and good:
            found[f"thread:{thread}"] = (text[:question].strip(), good[0]["content"][:answer].strip())
    return found


def test_qa_pairs_with_a_hot_thread(make_messages):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        thread = "hot" if rng.random() < 0.34 else f"m{rng.randrange(60)}"
        text = rng.choice(["How so", "Show it", "plain", "why? " * 4, "x?"]) + "y" * rng.choice([0, 50, 99, 200, 3000])
        rows.append({
            "id": f"m{i}", "thread_id": None if rng.random() < 0.2 else thread, "content": text,
            "created_at": START + timedelta(minutes=rng.randrange(100)),
            "content_type": rng.choice([None, "question", "praise"]),
        })
    frame = training.qa_pairs(make_messages(*rows))
    assert {r.example_id: (r.input, r.output) for r in frame.collect()} == _pairs(rows)
    cut = training.qa_pairs(make_messages(*rows), training.Cuts(question=1500, answer=2000, question_head=100))
    assert {r.example_id: (r.input, r.output) for r in cut.collect()} == _pairs(rows, 100, 1500, 2000)
    assert len(_pairs(rows)) > 20
    assert plan_of(frame).count("WindowGroupLimit") >= 2


def test_short_messages_are_gone_before_threads_are_built(make_messages):
    rows = make_messages(
        {"id": "a", "content": "How?"},
        {"id": "b", "thread_id": "a", "content": "what " + "b" * 120, "created_at": START + timedelta(1)},
        {"id": "c", "thread_id": "a", "content": "c" * 120, "created_at": START + timedelta(2)},
    )
    assert training.qa_pairs(training.training_candidates(rows)).first().input.startswith("what b")


def test_doc_parts(make_messages):
    body = "z" * 150
    long = {"source": "docs"}
    rows = make_messages(
        {"id": "heads", "content": f"# First line\n## Using x\n{body}\n#### deep\n# Short\nfew\n### Last #\n{body}", **long},
        {"id": "plain", "title": "Volumes", "content": " " + body * 2, **long},
        {"id": "untitled", "content": body * 2, **long},
        {"id": "voice", "title": "Volumes", "content": body * 2},
        {"id": "tiny", "title": "Volumes", "content": "z" * 199, **long},
        {"id": "huge", "title": "Volumes", "content": "z" * 10_001, **long},
        {"id": "most", "title": "Volumes", "content": "z" * 10_000, **long},
    )
    sections = {(r.id, r.position): r.header for r in training.doc_sections(rows).collect()}
    assert sections == {("heads", 1): "Using x", ("heads", 3): "Last #"}
    examples = {r.example_id: r for r in training.doc_examples(rows, "Acme").collect()}
    assert set(examples) == {"heads#1", "heads#3", "plain#0", "most#0", "huge#0"}
    cuts = training.Cuts(longest_doc=10_000, whole_doc=3000)
    short = {r.example_id: r.output for r in training.doc_examples(rows, "Acme", cuts).collect()}
    assert "huge#0" not in short and len(short["most#0"]) == 3000
    assert examples["heads#1"].input == "How do I use x?"
    assert examples["heads#1"].output == f"Using x\n{body}\n#### deep"
    assert len(examples["most#0"].output) == 10_000


def test_split_is_exact_and_repeatable(spark):
    for rows in (0, 1, 7, 1000):
        examples = spark.range(rows).select(F.col("id").cast("string").alias("example_id"))
        split = training.train_val_split(examples, 0.9)
        counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
        assert counts.get("train", 0) == math.floor(rows * 0.9) and sum(counts.values()) == rows
    assert sorted(split.collect()) == sorted(training.train_val_split(examples.repartition(3), 0.9).collect())
    assert sorted(split.collect()) != sorted(training.train_val_split(examples, 0.9, seed=1).collect())


def test_prepare_training_data(spark, make_messages, tmp_path):
    rows = make_messages(*[
        {"id": f"d{i}", "source": "docs", "title": f"Volumes {i}", "content": f"{i} " + "z" * 250} for i in range(20)
    ])
    train, val = training.prepare_training_data(rows, str(tmp_path), "Acme")
    assert (count_jsonl(spark, train), count_jsonl(spark, val)) == (18, 2)
    line = json.loads(spark.read.text(val).first()[0])
    assert [turn["role"] for turn in line["messages"]] == ["system", "user", "assistant"]
    assert count_jsonl(spark, str(tmp_path / "none")) == 0
    write_jsonl(spark.createDataFrame([(1,), (2,)], "a int"), str(tmp_path / "lines"))
    (tmp_path / "lines" / "blank.json").write_text("\n  \n")
    assert count_jsonl(spark, str(tmp_path / "lines")) == 2


def test_empty_input_leaves_out_the_user_turn(spark):
    rows = spark.createDataFrame([("a", "", "out"), ("b", None, "out")], "example_id string, input string, output string")
    for row in training.chat_examples(rows, "sys").collect():
        assert [turn.role for turn in row.messages] == ["system", "assistant"]
