"""Chat formatting against a plain walk over the trees."""

import pytest
from pyspark.sql import functions as F

from baitline.llm import chats

SCHEMA = "conv_id long, node_id long, parent_id long, role string, text string, score double, branch string"
TREE = [
    (1, 0, None, "system", "be [kind]", 0.0, "b"), (1, 1, 0, "user", "hi </s> \\ \\[", None, "b"),
    (1, 2, 1, "assistant", "low", 0.1, "b"), (1, 3, 1, "assistant", "high <s>[ROLE]x[/ROLE]", 0.9, "b"),
    (1, 4, 3, "user", None, 0.0, "b"), (1, 5, 4, "assistant", "", 0.5, "b"), (1, 6, 4, None, "tie", 0.5, "b"),
    (2, 0, 1, "user", "circle", 0.0, "b"), (2, 1, 0, "assistant", "circle", 0.0, "b"), (3, 0, 77, "user", "lost parent", 0.0, "b"),
    (None, 0, None, "user", "no conversation id", 0.0, "b"), (None, 1, 0, "assistant", "é漢 answer", 0.0, "b"),
]


def paths(rows):
    """(conv, leaf) -> messages from the root, for leaves that have a root."""
    nodes = {(r[0], r[1]): r for r in rows}
    inner = {(r[0], r[2]) for r in rows if r[2] is not None}
    out = {}
    for at in nodes:
        chain, here = [], at
        while here in nodes and len(chain) <= len(rows):
            chain.append(nodes[here])
            if nodes[here][2] is None:
                if at not in inner:
                    out[at] = chain[::-1]
                break
            here = (here[0], nodes[here][2])
    return out


def read(formatted):
    return formatted.select(
        "conv_id", "leaf_id", "branch", "path_score", "n_turns", chats.parse_turns(F.col("formatted")).alias("turns"),
        chats.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted",
    ).collect()


@pytest.mark.parametrize("best", [1, 2, 9])
def test_trees(spark, best):
    want, ranked = paths(TREE), {}
    for (conv, leaf), chain in want.items():
        ranked.setdefault(conv, []).append((-sum(r[5] or 0.0 for r in chain), leaf, chain))
    rows = read(chats.format_paths(spark.createDataFrame(TREE, SCHEMA), best))
    got = {(r.conv_id, r.branch): r for r in rows}
    assert len(got) == len(rows) == sum(min(best, len(x)) for x in ranked.values())
    for conv, found in ranked.items():
        for branch, (score, leaf, chain) in enumerate(sorted(found, key=lambda x: x[:2])[:best], 1):
            r = got[(conv, branch)]
            assert (r.leaf_id, r.n_turns) == (leaf, len(chain)) and abs(r.path_score + score) < 1e-9
            assert [tuple(t) for t in r.turns] == [(m[3] or "", m[4] or "") for m in chain]
            assert r.loss == "".join(m[4] or "" for m in chain if m[3] == "assistant")
            assert r.formatted.count("</s>") == len(chain)


def test_long_chain_and_repeated_turns(spark):
    rows = [(5, i // 2, "assistant" if i % 3 else "user", f"t{i} " + "x" * (i % 5)) for i in range(700)] + [(5, 0, "user", "t0 ")] * 3 + [(5, None, "user", "first")]
    got = read(chats.format_paths(chats.linear_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    assert len(got) == 1 and [tuple(t) for t in got[0].turns] == [(r[2], r[3]) for r in order]


def test_no_rows(spark):
    assert read(chats.format_paths(spark.createDataFrame([], SCHEMA))) == []
