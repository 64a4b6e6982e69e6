import glob
import os
import random
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from strandloom.llm import token_files
from strandloom.llm.queries import QUERIES
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = token_files.Pieces(Tokenizer.from_file(PATH))


def whole(text, end_id=2):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [end_id]


def ids(value):
    return np.frombuffer(value, "<u4").tolist()


def folder():
    return tempfile.mkdtemp(prefix="spark-") + "/tokens"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t'sS1.é　 \x1c\x85😀,<|endoftext|>", max_size=30), max_size=5))
def test_pieces_are_encoded_as_whole_texts(texts):
    assert [ids(b) for b in PIECES.encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_the_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "MOST_PIECES", 50)
    rand, pieces = random.Random(1), token_files.Pieces(LIBRARY)
    for _ in range(30):
        texts = [" ".join(str(rand.randrange(10**rand.randint(1, 6))) for _ in range(40)) for _ in range(4)]
        assert [ids(b) for b in pieces.encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(pieces.words) <= 50 and len(pieces.others) <= 50
    long = "x" * 5000 + "." * 5000
    assert ids(pieces.encode([f"a {long} {long}"])[0]) == LIBRARY.encode(f"a {long} {long}", add_special_tokens=False).ids
    assert all(len(p) <= token_files.LONGEST_PIECE for known in (pieces.words, pieces.others) for p in known)


def test_files_give_back_every_document_in_order(spark):
    rand = random.Random(4)
    docs = [(rand.randrange(-50, 50), " ".join(rand.choice(["alpha", "beta.", "é", "\n", ""]) for _ in range(rand.randrange(60))), i, "x") for i in range(300)]
    docs += [(None, "of no one", 1, "y"), (None, None, 2, "y"), (5, "", 3, None), (5, None, 4, None)] + [(6, "again and again", 9, "z")] * 40
    docs += [(2**62, "big", 0, ""), (-(2**62), "small", 0, "")]
    path = folder()
    table = spark.createDataFrame(docs, "doc_id long, text string, ids int, start string").repartition(7)
    token_files.write(table, path, PATH, end_id=2, shard_bytes=1500)
    got = token_files.read(spark, path).orderBy("start").collect()
    assert len(glob.glob(f"{path}/*.tok")) > 10
    key = lambda d: (d is not None, d or 0)
    assert [r.doc_id for r in got] == sorted((d[0] for d in docs), key=key)
    assert sorted(((r.doc_id, ids(r.ids)) for r in got), key=str) == sorted(((d[0], whole(d[1])) for d in docs), key=str)
    assert all(r.n_tokens == len(ids(r.ids)) for r in got)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_some_documents_are_read_by_their_ranges(spark):
    path = folder()
    token_files.write(spark.range(500).selectExpr("id * 3 AS doc_id", "repeat(concat('word', id, ' '), 20) AS text"), path, PATH, end_id=2, shard_bytes=2000)
    every = {r.doc_id: tuple(r) for r in token_files.read(spark, path).collect()}
    some = token_files.read(spark, path, [0, 1, 300, 1497, 9999, 300])
    assert {r.doc_id: tuple(r) for r in some.collect()} == {i: every[i] for i in (0, 300, 1497)}
    assert some.rdd.getNumPartitions() == 3
    assert token_files.read(spark, path, []).collect() == []


def test_decoding_gives_the_texts(spark):
    path, texts = folder(), ["one two", "", "é 😀\n\n x  y", None]
    token_files.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, PATH, end_id=2)
    got = token_files.decode(token_files.read(spark, path), PATH, end_id=2).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["one two", "", "é 😀\n\n x  y", ""]


def test_no_documents(spark):
    path = folder()
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH, end_id=2)
    assert token_files.read(spark, path).collect() == [] and token_files.manifest_of(path)["tokens"] == 0


def test_damage_and_other_dictionaries_are_errors(spark):
    path = folder()
    token_files.write(spark.range(50).selectExpr("id AS doc_id", "concat('text ', id) AS text"), path, PATH, end_id=2)
    shards = glob.glob(f"{path}/*.tok")
    good = {s: open(s, "rb").read() for s in shards}
    for change in (lambda b: b[:-1], lambda b: b[: len(b) // 2], lambda b: b[:-45] + bytes([b[-45] ^ 1]) + b[-44:], lambda b: b[:-100] + bytes([b[-100] ^ 1]) + b[-99:]):
        with open(shards[0], "wb") as f:
            f.write(change(good[shards[0]]))
        with pytest.raises(Exception, match="cut short|another dictionary|damaged"):
            token_files.read(spark, path).collect()
    with open(shards[0], "wb") as f:
        f.write(good[shards[0]])
    assert token_files.read(spark, path).count() == 50
    dictionary = glob.glob(f"{path}/*.zdict")[0]
    with open(dictionary, "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="not the one with the hash"):
        token_files.read(spark, path).collect()


def test_files_of_attempts_that_were_not_committed_are_not_read(spark):
    path = folder()
    docs = spark.range(40).selectExpr("id AS doc_id", "'same text' AS text")
    token_files.write(docs, path, PATH, end_id=2)
    first = sorted(map(tuple, token_files.read(spark, path).collect()))
    with open(f"{path}/000000-0000-lost.tok", "wb") as f:
        f.write(b"half of a shard")
    token_files.write(docs, path, PATH, end_id=2)  # the job again: its shards take the place of the first ones
    assert sorted(map(tuple, token_files.read(spark, path).collect())) == first


def test_dictionary_helps_short_documents_and_is_bounded():
    rand = random.Random(3)
    words = ["".join(rand.choice("abcdefgh") for _ in range(7)) for _ in range(300)]
    samples = [b for b in PIECES.encode([" ".join(rand.choice(words) for _ in range(60)) for _ in range(900)])]
    content = token_files.train_dictionary(samples)
    assert 0 < len(content) <= token_files.DICTIONARY_BYTES
    import zstandard

    size = lambda d: sum(len(zstandard.ZstdCompressor(level=3, dict_data=d).compress(s)) for s in samples[:200])
    assert size(token_files._dictionary(content)) < 0.8 * size(None)
    assert token_files.train_dictionary([]) == b"" and token_files.train_dictionary([b"12345678"]) == b"12345678"


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError, match="byte-level"):
        token_files.encode(spark.createDataFrame([("a",)], "text string"), public_tokenizers.path("word_bpe_49k.json"))


def test_columns_of_the_same_name_are_replaced(spark):
    docs = spark.createDataFrame([("a b", "x", 3)], "text string, ids string, n int")
    out = token_files.encode(docs, PATH)
    assert out.columns == ["text", "ids", "n"] and ids(out.first().ids) == whole("a b")[:-1]
    assert token_files.decode(out.withColumn("text", out.n), PATH).first().text == "a b"


def test_very_long_text(spark):
    text = "lorem ipsum, " * 100_000 + "x" * 300_000
    got = token_files.encode(spark.createDataFrame([(text,)], "text string"), PATH, end_id=2).collect()[0]
    assert ids(got.ids) == whole(text)


@pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables are not here")
def test_query_against_the_library(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    start, want = 0, []
    for doc_id, text in docs:
        found = whole(text)
        want.append((doc_id, start, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        start += len(found)
    assert sorted(map(tuple, QUERIES["op13_token_files"](spark, SF).collect())) == want
