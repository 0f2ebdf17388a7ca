"""Decontamination in several blocks answers like one block, row by row."""

import pytest

from terraweave.llm import decontamination

WORDS = " ".join(f"b{i}" for i in range(40))
ITEMS = [(i, " ".join(f"b{j}" for j in range(i, i + 14))) for i in range(0, 26, 2)] + [(100, "short item here"), (101, "head tail")]
ROWS = [
    (1, f"before {WORDS} after", "x"), (1, "nothing of it", "x"), (1, f"only {WORDS}", "y"), (None, f"{WORDS} a short item here", "z"),
    (None, "clean text", "z"), (None, None, "z"), (2, f"head {WORDS} tail", "q"), (3, f"head {WORDS} tail", "q"), (3, f"head {WORDS} tail", "q"), (4, "", None),
]


@pytest.mark.parametrize("limit", [1, 600])
@pytest.mark.parametrize("action", ["report", "drop", "cut"])
def test_blocks_answer_like_one_block(spark, action, limit):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, _row string")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert len(list(decontamination._blocks(bench, "item_id", "text", 600))) > 4
    one = decontamination.decontaminate(docs, bench, action=action)
    many = decontamination.decontaminate(docs, bench, action=action, max_set_bytes=limit)
    assert many.columns == one.columns and many.dtypes == one.dtypes
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
    assert many.count() == (4 if action == "drop" else len(ROWS))


def test_a_set_is_as_small_as_its_bound():
    """Built and pickled bytes, and the pieces of an item that is longer than a block."""
    import pickle

    import numpy as np

    text = " ".join(f"word{i % 9973}" for i in range(120_000))
    pieces = list(decontamination._pieces("7", text, 10, 1 << 20))
    words = text.encode().split()
    windows = {tuple(p.split()[i : i + 10]) for _, p, _ in pieces for i in range(len(p.split()) - 9)}
    assert len(pieces) > 4 and windows == {tuple(words[i : i + 10]) for i in range(len(words) - 9)}
    for item, joined, size in pieces:
        block = decontamination.WindowSet([(item, joined)])
        tables = [c for table in block.by_length.values() for c in table[:-1]]
        assert sum(c.nbytes for c in tables if isinstance(c, np.ndarray)) + len(block.words) <= size + 64 <= (1 << 20) + 64
        assert len(pickle.dumps(block)) < (1 << 20) + (1 << decontamination._GATE_BITS) + 4096


def test_equal_windows_of_many_items(spark):
    items = [(i, f"lead{i} " + " ".join(f"s{j}" for j in range(12))) for i in range(40)] + [(None, "s1 s2")]
    docs = spark.createDataFrame([(1, "x " + " ".join(f"S{j}" for j in range(12))), (2, "lead3 s0 s1 s2 s3 s4 s5 s6 s7 s8")], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(docs, bench).collect()}
    assert sorted(got[1]["items"]) == sorted(str(i) for i in range(40)) and got[1].hit_ranges == [1, 13] and got[2]["items"] == ["3"]
