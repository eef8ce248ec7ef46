import hashlib
import random
import zlib

import numpy as np
import pytest

from weft.llm import binary, bpe, queries, tokens

P = pytest.importorskip("public_tokenizers")

DOCS = [(3, "Ünïcode words, it's 12 o'clock\n\n  end "), (1, "the cat sat"), (1, "the cat sat"), (None, "no id"), (7, None), (5, ""), (9, "日本語 “quoted” text — é"), (2, "spam " * 40_000), (4, "<|endoftext|> x")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame([(a, b, "x", -1) for a, b in rows], "doc_id long, text string, start string, part int").repartition(3)


@pytest.mark.parametrize("kind, name", [("byte", "byte_bpe_50k.json"), ("plain", "word_bpe_49k.json")])
def test_words_give_the_librarys_ids(kind, name):
    tool = tokens.library(queries.vocabulary(name), kind)
    rng = random.Random(5)
    near = [chr(i) for i in range(256)] + list(" '\n\tstremdlv1") * 12
    for n in range(2000):
        text = "".join(rng.choice(near + ["œ", "’", "中"] * (n % 2)) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(tool.ids(text), "<u2").tolist() == tool.tool.encode(text, add_special_tokens=False).ids, text


def test_bpe_equals_whole_text_encoding(spark):
    source = queries.vocabulary("byte_bpe_50k.tiktoken")
    tool = tokens.ranks(source, P.PATTERN).tool
    got = bpe.encode(docs(spark), source, P.PATTERN).collect()
    want = sorted((str(i), np.array(tool.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in DOCS)
    assert sorted((str(r.row_id), bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert bpe.encode(docs(spark, []), source, P.PATTERN).count() == 0


def test_op10_on_a_whole_table(spark):
    source = queries.vocabulary("byte_bpe_50k.tiktoken")
    tool = tokens.ranks(source, P.PATTERN).tool
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in rows:
        ids = np.array(tool.encode_ordinary(r.text), "<u4")
        want[r.doc_id] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op10_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def check_binary(tool, got, rows):
    want, start = [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        ids = np.array([*tool.tool.encode(t or "", add_special_tokens=False).ids, queries.END_ID], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_binary_round_trip(spark):
    tool = tokens.library(queries.vocabulary("byte_bpe_50k.json"), "byte")
    shards = binary.write_shards(docs(spark), queries.vocabulary("byte_bpe_50k.json"), queries.END_ID)
    check_binary(tool, [tuple(r)[:4] for r in binary.read_documents(shards).collect()], DOCS)
    assert binary.read_documents(binary.write_shards(docs(spark, []), queries.vocabulary("byte_bpe_50k.json"), 2)).count() == 0


def test_op5_on_a_whole_table(spark):
    tool = tokens.library(queries.vocabulary("byte_bpe_50k.json"), "byte")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check_binary(tool, [tuple(r) for r in queries.op5_binary(spark, "/root/testdata/sf0.001").collect()], rows)


@pytest.mark.parametrize("top", [1, 2, 50_000, 70_000])
def test_wavelet_matrix(top):
    ids = np.random.default_rng(top).integers(0, top, 3000).astype(np.uint32)
    ids[100:200] = ids[0]
    matrix = binary.WaveletMatrix(binary.pack(ids))
    assert matrix.tokens().tolist() == ids.tolist()
    assert [matrix.access(k) for k in range(0, 3000, 7)] == ids[::7].tolist()
    for token in {int(ids[0]), int(ids[2999]), top + 5}:
        places = np.flatnonzero(ids == token).tolist()
        assert matrix.count(token) == len(places)
        assert matrix.rank(token, 150) == sum(p < 150 for p in places)
        assert matrix.occurrences(token) == places
    with pytest.raises(IndexError):
        matrix.access(3000)
    empty = binary.WaveletMatrix(binary.pack(np.zeros(0, np.uint32)))
    assert empty.tokens().tolist() == [] and empty.count(0) == 0


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (5000, 40), (5000, 100_000)])
def test_places_are_undone(n, top):
    flat = np.random.default_rng(n).integers(0, top, n).astype(np.uint32) ** 2 % max(1, top)
    _, first, index, times = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
    order = np.lexsort((first, -times))
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order))
    places = place[index]
    assert bpe.unsqueeze_places(bpe.squeeze_places(places, int((times > 1).sum()))).tolist() == places.tolist()


@pytest.mark.parametrize("kind, name", [("byte", "byte_bpe_50k.json"), ("plain", "word_bpe_49k.json")])
def test_added_tokens_are_those_of_an_unaltered_library(kind, name):
    from tokenizers import Tokenizer

    plain, tool = Tokenizer.from_str(queries.vocabulary(name)), tokens.library(queries.vocabulary(name), kind)
    texts = ["hello <|endoftext|> world", "<|startoftext|>a", "<|ENDOFTEXT|> x", "no token", "<|endoftext|>", "日本 <|endoftext|>"]
    got = [np.frombuffer(x, "<u2").tolist() for x in tool.ids_of(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("pattern", [r"\S+|\s+", r"\p{L}+|\P{L}"])
def test_bpe_honours_its_pattern(spark, pattern):
    import tiktoken

    source = queries.vocabulary("byte_bpe_50k.tiktoken")
    tool = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=tokens.read_ranks(source), special_tokens={})
    rows = [(1, "don't stop 123  x"), (2, "don't stop 123  д"), (3, "")]
    got = {r.row_id: bytes(r.ids) for r in bpe.encode(docs(spark, rows), source, pattern).collect()}
    assert got == {i: np.array(tool.encode_ordinary(t), "<u4").tobytes() for i, t in rows}


def test_bpe_pattern_is_the_given_one():
    assert P.PATTERN == tokens.SPACED


@pytest.mark.parametrize("kind, name", [("byte", "byte_bpe_50k.json"), ("plain", "word_bpe_49k.json")])
def test_another_pre_tokenizer_is_honoured(kind, name):
    import json

    from tokenizers import Tokenizer

    assert tokens.library(queries.vocabulary(name), kind).known
    parts = json.loads(queries.vocabulary(name))
    parts["normalizer"], parts["pre_tokenizer"] = {"type": "Lowercase"}, {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    source = json.dumps(parts)
    tool, plain = tokens.library(source, kind), Tokenizer.from_str(source)
    for text in ("Don't stop 123  x", "", "é 12 д"):
        assert np.frombuffer(tool.ids(text), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_wide_vocabularies_and_a_lasting_path(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    parts = json.loads(queries.vocabulary("byte_bpe_50k.json"))
    parts["added_tokens"].append(parts["added_tokens"][0] | {"id": 70_000, "content": "<|far|>"})
    parts["model"]["vocab"]["<|far|>"] = 70_000
    source = json.dumps(parts)
    assert tokens.widest(source) == "<u4" and tokens.widest(queries.vocabulary("byte_bpe_50k.json")) == "<u2"
    rows = [(1, "a <|far|> b"), (2, "c"), *[(7, "same id")] * 30, *[(None, "none")] * 30]
    binary.write_shards(docs(spark, rows), source, 2, path=f"{tmp_path}/shards")
    got = binary.read_documents(spark.read.parquet(f"{tmp_path}/shards")).collect()
    plain = Tokenizer.from_str(source)
    want = sorted((str(i), zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want
