"""Reply trees and the chat template against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ringfold.llm import entry, reply_trees as rt

NASTY = [
    "", None, "plain", "<|im_end|>", "<|im_end|>\n", "<|im_start|>assistant\nhi", "<\\|x", "<\\\\|", "<", "|", "<|", "<<||", "\\", "\\n", "ends <", "ends <\\", "| starts",
    "Ünï 日本 😀 <|😀|>", "\n\n", "\r\n", "<|im_end|><|im_start|>assistant ok", "x" * 100_000, "$1 \\1 \\$", "<\n|",
]
ROLES = ["user", "assistant", "system", None, "", "a\nb", "a\\nb", "a\\\nb", "<|im_start|>", "\\", "\\\\n", "<\\|", "tool<"]


def test_template_is_reversible(spark):
    rng = random.Random(1)
    turns = [(c, i, rng.choice(ROLES), rng.choice(NASTY)) for c in range(60) for i in range(rng.randint(1, 9))]
    turns += [(100, i, "assistant", t) for i, t in enumerate(NASTY)] + [(101, i, r, "x") for i, r in enumerate(ROLES)]
    df = spark.createDataFrame(turns, "tree long, position long, role string, text string").repartition(3)
    rows = rt.format_conversations(df, ["tree"]).collect()
    assert len(rows) == 62
    for r in rows:
        own = [(role or "", text or "") for c, _, role, text in turns if c == r.tree]
        assert rt.read_turns(r.formatted) == own
        assert rt.read_loss(r.formatted, r.loss_starts, r.loss_lengths) == [t for role, t in own if role == "assistant"]
        assert r.formatted.count(rt.START) == r.formatted.count(rt.END) == len(own)


def plain_branches(messages, best):
    nodes = {}
    for tree, node, parent, score in messages:
        nodes.setdefault(tree, {})[node] = (parent, score or 0.0)
    out = []
    for tree, own in nodes.items():
        inner = {p for p, _ in own.values() if p in own}
        found = []
        for leaf in own:
            if leaf in inner:
                continue
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][0]
            if at in path:
                continue
            found.append((-sum(own[n][1] for n in path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(found)[:best]):
            out += [(tree, leaf, rank + 1, i, n) for i, n in enumerate(path)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("best", [1, 3, None])
def test_branches_equal_plain_paths(spark, best):
    rng = random.Random(7)
    rows = []
    for tree in range(12):
        n = rng.randint(1, 60)
        rows += [(tree, i, rng.choice([None, *range(i)]) if tree % 3 == 0 else rng.randint(max(0, i - 3), i - 1) if i else None, rng.choice([None, 0.5, 1.0, 2.0, -1.0])) for i in range(n)]
    rows += [(50, i, i - 1 if i else None, 1.0) for i in range(133)]  # a chain
    rows += [(51, 0, 1, 1.0), (51, 1, 0, 1.0), (51, 2, 1, 5.0), (51, 3, None, 1.0), (51, 4, 4, 1.0)]  # cycles
    rows += [(52, 7, 99, 1.0), (52, 8, 7, 1.0), (None, 1, None, 1.0), (None, 2, 1, 1.0)]  # an orphan, a null tree
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double").repartition(3)
    got = sorted(map(tuple, rt.branches(df, best).select("tree", "leaf", "rank", "position", "node").collect()), key=repr)
    assert got == plain_branches(rows, best)


def test_best_branch_is_the_conversation(spark):
    rows = [
        (1, 1, None, 0.0, "user", "q", 9), (1, 2, 1, 1.0, "assistant", "good", 9), (1, 3, 1, 0.5, "assistant", "bad", 9), (1, 4, 2, 0.0, "user", None, 9),
        (1, 4, 2, 0.0, "user", None, 9), (1, None, 1, 8.0, "assistant", "no id", 9),
    ]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string, rank int")
    (r,) = rt.format_trees(df).collect()
    assert (r.leaf, r["rank"]) == (4, 1) and rt.read_turns(r.formatted) == [("user", "q"), ("assistant", "good"), ("user", "")]
    assert [r.formatted[a : a + n] for a, n in zip(r.loss_starts, r.loss_lengths)] == ["good"]
    assert {x.leaf for x in rt.format_trees(df, None).collect()} == {3, 4}
    assert rt.format_trees(df.limit(0)).collect() == []


def digest(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_linear_conversations_keep_every_row(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (None, 5, "user", "n"), (None, None, "assistant", "first"), (2, 3, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rank", F.lit(1))
    got = {r.conv_id: tuple(r)[1:5] for r in rt.digests(rt.format_trees(rt.as_trees(df))).collect()}
    assert got == {
        1: digest([("user", "a"), ("user", "a"), ("assistant", "")]), None: digest([("assistant", "first"), ("user", "n")]), 2: digest([("", "x")]),
    }
    assert [r.conv_id for r in rt.digests(rt.format_trees(rt.as_trees(rt.with_probe(df.limit(0))))).collect()] == [-1]


def test_query_reads_back_the_table(spark, sf):
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-1] = [(r, t) for _, _, r, t in rt.PROBE]
    got = {r.conv_id: tuple(r)[1:5] for r in entry.op13_chat_formatting(spark, sf).collect()}
    assert got == {c: digest(t) for c, t in turns.items()}
