import random
import re

import pytest

from weft.llm import queries, suffix_dedup

W = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, n=50):
    """doc -> (text, spans) by brute force over all passages; docs: (id, text)."""
    texts = {}
    for i, t in docs:
        if t is not None:
            texts[t] = min([texts.get(t, i), i], key=lambda x: (x is None, x))
    seen, out = {}, {}
    import numpy as np
    import xxhash

    key = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    for t, i in sorted(texts.items(), key=lambda x: (x[1] is None, x[1] or 0, key(x[0]))):
        words = list(W.finditer(t))
        names = [m.group() for m in words]
        gone = [False] * len(words)
        for k in range(len(words) - n + 1):
            if seen.setdefault(tuple(names[k : k + n]), (i, t, k)) != (i, t, k):
                gone[k : k + n] = [True] * n
        spans, k = [], 0
        while k < len(words):
            if not gone[k]:
                k += 1
                continue
            to = k
            while to < len(words) and gone[to]:
                to += 1
            if to < len(words):
                spans.append((words[k].start(), words[to].start()))
            else:
                spans.append((words[k - 1].end() if k else 0, len(t)) if k else (words[0].start(), len(t)))
            k = to
        done, last = [], 0
        for a, b in spans:
            done.append(t[last:a])
            last = b
        out[(i, t)] = ("".join(done) + t[last:], spans)
    result = []
    for i, t in docs:
        if t is None or (i, t) in out:
            result.append((i, t, *(out[(i, t)] if t is not None else (None, []))))
        elif len(W.findall(t)) >= n:
            result.append((i, t, "", [(0, len(t))]))
        else:
            result.append((i, t, t, []))
    return result


def run(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, k string, place int").repartition(3)
    got = suffix_dedup.cut(df)
    assert got.columns == ["doc_id", "text", "k", "place", "spans"]
    return sorted(((str(r.doc_id), r.text, [(s.start, s.end) for s in r.spans]) for r in got.collect()), key=str)


def want(docs):
    return sorted(((str(i), new, spans) for i, _, new, spans in plain(docs)), key=str)


def prose(rng, n):
    return " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 400)) + rng.choice(["", "", "é", "."]) for _ in range(n))


def test_equals_brute_force(spark):
    rng = random.Random(4)
    shared = [prose(rng, n) for n in (50, 51, 60, 49, 200, 75)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [prose(rng, rng.randint(0, 120)), rng.choice([*shared, "", ""])]
        docs.append((rng.randint(0, 10_000), rng.choice([" ", "\n", "\t\n "]).join(parts)))
    docs += [docs[0], (docs[1][0] + 1, docs[1][1]), (None, docs[2][1]), (None, "alone " + shared[0])]
    assert run(spark, docs) == want(docs)


def test_odd_rows(spark):
    rng = random.Random(5)
    p = prose(rng, 60)
    docs = [(1, None), (2, ""), (3, "short text"), (4, "short text"), (5, p), (6, p), (6, p), (7, "\n " + p + " \n"), (8, "w " * 5000), (9, "w " * 49), (10, "x" * 300), (11, "start " + p), (12, p + " end"), (13, "x" * 99), (14, "x" * 99)]
    assert run(spark, docs) == want(docs)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.cut(df).count() == 0


def test_runs_over_many_partitions(spark, monkeypatch):
    """A passage of half the texts, with words before and after it that some share, in blocks of few rows."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(suffix_dedup._common, "PARTITION_BYTES", 4000)
    rng = random.Random(8)
    common, heads, tails = prose(rng, 70), [prose(rng, 12) for _ in range(5)], [prose(rng, 30) for _ in range(5)]
    docs = [(k, " ".join([prose(rng, rng.randint(0, 60)), rng.choice(heads), common, rng.choice(tails), prose(rng, rng.randint(0, 60))])) for k in range(120)]
    docs += [(1000 + k, prose(rng, 80)) for k in range(100)] + docs[:5]
    assert run(spark, docs) == want(docs)


def test_words_that_hash_alike_are_not_cut(spark):
    """The words are compared, not their hashes: these differ, and collide in any polynomial modulo 2^64."""
    a = ["a", "b"]
    for _ in range(11):
        a = [a[0] + a[1], a[1] + a[0]]
    rng = random.Random(9)
    rest = [prose(rng, 30), prose(rng, 30)]
    docs = [(1, f"{rest[0]} {a[0]} {rest[1]}"), (2, f"{rest[0]} {a[1]} {rest[1]}")]
    assert run(spark, docs) == want(docs) == sorted(((str(i), t, []) for i, t in docs), key=str)


def test_a_line_that_texts_repeat(spark, monkeypatch):
    """Only the first places of a text's own repeats are sorted, however often it has them."""
    rows = {}
    stash = suffix_dedup._common.stash

    def counted(df, name):
        out = stash(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup._common, "stash", counted)
    rng = random.Random(11)
    block = prose(rng, 70)
    docs = [(k, f"{prose(rng, rng.randint(0, 60))} {'On he. ' * rng.randint(100, 400)}{prose(rng, rng.randint(0, 60))}") for k in range(40)]
    docs += [(100 + k, " ".join([prose(rng, 9), *[block] * 5, prose(rng, 9)])) for k in range(3)] + [(200, "a b " * 300), (201, " ".join([prose(rng, 60)] * 4)), (None, docs[0][1] + " end")]
    assert run(spark, docs) == want(docs)
    assert rows["contexts"] < 10 * len(docs) and rows["repeats"] < 30 * len(docs)


def test_own_words_that_hash_alike_are_not_cut(spark):
    a = ["a", "b"]
    for _ in range(11):
        a = [a[0] + a[1], a[1] + a[0]]
    rng = random.Random(12)
    x, y = prose(rng, 30), prose(rng, 30)
    docs = [(1, f"{x} {a[0]} {y} {x} {a[1]} {y}"), (2, f"{x} {a[0]} {y} {x} {a[0]} {y}")]
    assert run(spark, docs) == want(docs)


def test_clashing_names(spark):
    rng = random.Random(10)
    p = prose(rng, 60)
    names = ["__k", "__n", "__id", "__tk", "first", "cuts", "row", "same", "sha", "0", "1", "t", "k"]
    df = spark.createDataFrame([(1, p, *"abcdefghijklm"), (2, "x " + p, *"abcdefghijklm")], ["doc_id", "text", *names])
    got = {r.doc_id: r for r in suffix_dedup.cut(df).collect()}
    assert all("".join(got[i][n] for n in names) == "abcdefghijklm" for i in (1, 2)) and got[1].text == p and got[2].text == "x"


@pytest.mark.parametrize("at", ["/root/testdata/sf0.01"])
def test_op4_on_a_whole_table(spark, at):
    docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.text, r.n_spans, r.n_cut) for r in queries.op4_suffix_dedup(spark, at).collect()}
    assert got == {i: (new, len(spans), sum(b - a for a, b in spans)) for i, _, new, spans in plain(docs)}
    assert sum(n > 0 for _, n, _ in got.values()) > 10
