"""Trees of any depth, and raw blocks of any shape."""

import json
import random

from docquarry.operators import blocks
from docquarry.sources import tables

SCHEMA = "page_id string, block_id string, parent_id string, pos int, text string"


def test_deep_and_broken_trees(spark):
    rng = random.Random(2)
    rows = [("chain", str(i), str(i - 1) if i else None, 0, f"t{i}") for i in range(1000)]
    rows += [("bushy", str(i), str(rng.randrange(i)) if i > 3 else None, i, f"b{i}") for i in range(200)]
    rows += [("cycle", "a", "b", 0, "x"), ("cycle", "b", "a", 0, "x"), ("cycle", "c", "a", 1, "x"), ("cycle", "d", None, 2, "root"), ("cycle", "e", "gone", 3, "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    key = lambda df: sorted((r.page_id, r.block_id, r.depth, list(r.path), r.text) for r in df.collect())
    deep = key(blocks.preorder_deep(frame, max_blocks=5000))
    assert [x[2] for x in deep if x[0] == "chain"].count(999) == 1 and len([x for x in deep if x[0] == "chain"]) == 1000
    assert [x[1] for x in deep if x[0] == "cycle"] == ["d"]
    assert key(blocks.preorder_deep(frame, 4, 60)) == key(blocks.preorder(frame, 4, 60))
    assert key(blocks.preorder_deep(frame.where("false"))) == []


def test_raw_blocks(spark, tmp_path):
    rich = lambda *t: [{"plain_text": x} for x in t]
    lines = [
        json.dumps({"page_id": "p", "id": "1", "pos": 0, "type": "paragraph", "has_children": True, "paragraph": {"rich_text": rich("a", "b"), "caption": rich("c")}}),
        json.dumps({"page_id": "p", "id": "2", "parent": {"block_id": "1"}, "pos": 1, "type": "equation", "equation": {"expression": "x^2"}}),
        json.dumps({"page_id": "p", "id": "3", "pos": "two", "type": "odd type.x", "paragraph": {"rich_text": rich("not its own")}}),
        json.dumps({"page_id": "p", "id": "4", "type": "paragraph", "paragraph": {"rich_text": {"plain_text": "no list"}}}),
        '{"page_id": "p", "id": "5", "ty', "[1, 2]", "",
    ]
    (tmp_path / "b.json").write_text("\n".join(lines) + "\n")
    got = [tuple(r) for r in blocks.from_raw(tables.read_raw_blocks(spark, str(tmp_path / "b.json"))).collect()]
    assert got[:4] == [
        ("p", "1", None, 0, "paragraph", True, "ab c"), ("p", "2", "1", 1, "equation", False, "x^2"), ("p", "3", None, None, "odd type.x", False, ""), ("p", "4", None, None, "paragraph", False, ""),
    ]
    assert got[4:] == [(None, None, None, None, None, False, "")] * 3
