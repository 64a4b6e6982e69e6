"""Grammar inference: formats with their alphabets, marks and lengths, and candidates outside the base patterns."""

import random
import string

from strandloom.llm import secret_scan as S

ALL = string.ascii_letters + string.digits
SYLLABLES = ["tha", "rin", "geb", "ole", "ist", "und", "ver", "lor", "pa", "qui"]


def key(rnd, n, letters=ALL):
    return "".join(rnd.choice(letters) for _ in range(n))


def prose(rnd, n):
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 5))) for _ in range(n))


def test_automata_keep_structure():
    rnd = random.Random(4)
    values = [f"sk-{key(rnd, 20, string.ascii_lowercase + string.digits)}-{key(rnd, 6, string.digits)}" for _ in range(300)]
    automaton = S.Automaton([S.symbols_of(v) for v in values])
    assert len(automaton.steps) > 20
    fresh = [f"sk-{key(rnd, 20, string.ascii_lowercase + string.digits)}-{key(rnd, 6, string.digits)}" for _ in range(100)]
    bar = -5.0
    assert sum(automaton.score(S.symbols_of(v)) >= bar for v in fresh) >= 95
    for other in ("sk-short1-123456", "ordinarywordsinlowercase", fresh[0][:-1], fresh[0] + "1", fresh[0].replace("-", "_")):
        assert automaton.score(S.symbols_of(other)) < bar


def test_compatible_states_merge():
    """A loop of one symbol with a constant chance to end is one state."""
    rnd = random.Random(5)
    lengths = []
    for _ in range(4000):
        n = 1
        while rnd.random() < 0.8:
            n += 1
        lengths.append(n)
    automaton = S.Automaton(["d" * n for n in lengths])
    assert len(automaton.steps) < 6


def test_planted_formats_outside_base_patterns(spark):
    """Credentials that the base patterns find teach their format; the same format without a telling name is found, prose is not."""
    rnd = random.Random(6)
    form = lambda: f"gx{rnd.choice('pr')}_{key(rnd, 24)}"
    texts = [f"{prose(rnd, 30)} token = '{form()}' {prose(rnd, 30)}" for _ in range(80)]
    planted = {}
    for k in range(80, 140):
        before, secret = prose(rnd, 20) + " ", form()
        planted[k] = (len(before), len(before) + len(secret))
        texts.append(f"{before}{secret} {prose(rnd, 20)}")
    texts += [prose(rnd, 60) + f" on 2024-01-{k % 28:02d}, tel 555-0{k:03d}, see example.com/pages/{prose(rnd, 1)}" for k in range(200)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: [tuple(s) for s in r.spans if s.kind == "format"] for r in S.scan(docs).collect()}
    assert sum(found[k] == [("format", *planted[k])] for k in planted) >= 0.9 * len(planted)
    assert not any(found[k] for k in found if k not in planted)


def test_spans_stand_by_start_then_kind(spark):
    rnd = random.Random(7)
    form = lambda: f"gx_{key(rnd, 24)}"
    texts = [f"{prose(rnd, 20)} token={form()} {prose(rnd, 10)}" for _ in range(60)]
    texts.append(f"{form()} and token={form()} and {form()}")
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    spans = [tuple(s) for r in S.scan(docs).where("doc_id = 60").collect() for s in r.spans]
    assert [k for k, _, _ in spans] == ["format", "assign", "format"] and spans == sorted(spans, key=lambda s: (s[1], S.ORDER.index(s[0])))


def test_very_long_texts(spark):
    texts = ["y1" * 100_000, "token=" + "z2" * 50_000, " ".join(f"token=abcdefg{k}" for k in range(5000)), ("=" * 20 + "x") * 5000, "api_key: " * 20_000]
    out = {r.doc_id: len(r.base) for r in S.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert out == {0: 0, 1: 1, 2: 5000, 3: 0, 4: 0}

