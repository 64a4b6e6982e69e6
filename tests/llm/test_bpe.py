import hashlib
import random
import tracemalloc

import public_tokenizers as P
import tiktoken
from strandloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def reference():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(PATH)) if t}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library():
    own, other = bpe.Encoder(bpe.read_ranks(PATH), P.PATTERN), reference()
    rnd = random.Random(7)
    texts = ["", " ", "a", "\n\n  x", "aaaa" * 50, "it's I'LL we're", "é" * 40, "x" * 5000, "日本語 テキスト", "\x1c \x85\xa0 z", "<|endoftext|>", "-=" * 300, "0123456789" * 30]
    texts += ["".join(rnd.choice("abcde éß\n\t.!'0917日") for _ in range(rnd.randint(0, 300))) for _ in range(300)]
    texts += ["".join(chr(rnd.choice((rnd.randint(1, 0xD7FF), rnd.randint(32, 126)))) for _ in range(80)) for _ in range(100)]
    got = own.encode(texts)
    for text, ids in zip(texts, got):
        want = other.encode_ordinary(text)
        assert ids == b"".join(i.to_bytes(4, "little") for i in want), text
        assert own.decode(ids) == text.encode()


def test_query_columns(spark):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (3, "", None), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_other string")
    out = bpe.encode(docs, PATH, P.PATTERN, decoded="decoded").collect()
    assert [bytes(r.decoded) for r in sorted(out, key=lambda r: r.doc_id)] == [b"Hello world", b"", b"", b""]
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_memory_is_that_of_a_part_of_the_texts():
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(9, 16))) for _ in range(40_000)]
    texts = [" ".join(rnd.choices(words, k=400)) for _ in range(500)] + ["", "x" * 5_000, "end"]
    own = bpe.Encoder(bpe.read_ranks(PATH), P.PATTERN)
    tracemalloc.start()
    try:
        got = own.encode(texts)
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert [own.decode(x) for x in got] == [t.encode() for t in texts]
    assert list(map(len, bpe._parts(texts[-4:], 1000))) == [1, 1, 1, 1] and [t for p in bpe._parts(texts, 1 << 18) for t in p] == texts
    # Before, 500 texts were split and 30,000 pieces merged at once: 44 MB beside what is kept, since then 8 MB.
    assert own.known and peak - kept < 15e6, (kept, peak)
