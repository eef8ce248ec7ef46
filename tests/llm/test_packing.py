import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import packing, queries, tokens


def test_exact_complements_come_first():
    assert packing.plan({1000: 2, 1048: 2}) == [(2, [1048, 1000])]
    assert packing.plan({1500: 1, 300: 1, 248: 1, 40: 1}) == [(1, [1500, 248, 300]), (1, [40])]
    assert [n for n, _ in packing.plan({1000: 1, 500: 1, 300: 1, 248: 1})] == [1]
    assert packing.plan({2048: 7}) == [(7, [2048])]
    assert packing.plan({1: 4096}) == [(2, [1] * 2048)]
    assert packing.plan({}) == []


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_is_whole_and_tight(counts):
    patterns = packing.plan(counts, 64)
    used: dict[int, int] = {}
    for n, parts in patterns:
        assert sum(parts) <= 64 and n > 0
        for x in parts:
            used[x] = used.get(x, 0) + n
    assert used == counts
    total, sequences = sum(k * v for k, v in counts.items()), sum(n for n, _ in patterns)
    assert sequences <= 2 * total / 64 + 1
    assert len(patterns) <= 64 * 11


def check(rows, docs, capacity=2048):
    tool = tokens.library(queries.vocabulary("word_bpe_49k.json"), "plain", "<u4")
    want = []
    for i, t in docs:
        ids = np.array([*tool.tool.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity])) for k, at in enumerate(range(0, len(ids), capacity))]
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, want))
    held: dict[int, list] = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        ends = np.cumsum([n for _, n in parts])
        assert [o for o, _ in parts] == [0, *ends[:-1]] and ends[-1] <= capacity
    return len(held), sum(r[3] for r in want) / capacity


def test_op1_on_a_whole_table(spark):
    at = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    sequences, least = check(queries.op1_packing(spark, at).collect(), docs)
    assert sequences <= least * 1.01 + 1


@pytest.mark.parametrize("rows", [[], [(1, None), (None, "a b"), (2, "a b"), (2, "a b"), (3, ""), (4, "word " * 9000), (5, "…œ ’ 中")] + [(9, "same text")] * 500])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, length int, bucket string").repartition(3)
    got = packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json")).withColumnRenamed("row_id", "doc_id").collect()
    check(got, rows)


def test_pieces_keep_their_ids(spark):
    docs = spark.createDataFrame([(1, "a b c " * 2000)], "doc_id long, text string")
    got = packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json"), keep_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in got)
