import time

from strandloom.llm import decontaminate, line_dedup


def naive_lines(texts, sites=3):
    """Each line on so many sites stays where it stands first."""
    first, seen = {}, {}
    for i, t in enumerate(texts):
        for p, line in enumerate(t.split("\n")):
            key = line.strip(" \t\r\x0b\x0c")
            if key:
                first.setdefault(key, (i, p))
                seen.setdefault(key, set()).add(i)
    gone = lambda i, p, line: (k := line.strip(" \t\r\x0b\x0c")) and len(seen[k]) >= sites and first[k] != (i, p)
    return ["\n".join(line for p, line in enumerate(t.split("\n")) if not gone(i, p, line)) for i, t in enumerate(texts)]


def deduped(spark, texts):
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    return {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, min_sites=3).collect()}


def test_drops_at_all_places_of_a_text(spark):
    texts = ["x", "x\n", "\nx\n\nx", "a\nx\nb\nx", "x\nx\ny", "y\nx\n\ny", "y", "\n\n"]
    assert deduped(spark, texts) == dict(enumerate(naive_lines(texts)))


def test_texts_of_very_many_lines_and_drops(spark):
    deduped(spark, ["warm\nup", "warm", "warm"])
    one = ["the line"] * 3 + ["\n".join(f"own {i}" for i in range(50_000)) + "\nthe line\n" + "\n".join(f"end {i}" for i in range(50_000))]
    many = ["\n".join(f"line {i}" for i in range(50_000))] * 3 + ["\n".join(f"line {i}\nown {i}" for i in range(50_000))]
    for texts in (one, many):
        began = time.time()
        assert deduped(spark, texts) == dict(enumerate(naive_lines(texts)))
        assert time.time() - began < 40


def test_items_and_documents_that_repeat_an_id(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    absent = " ".join(f"absent{i}" for i in range(50))
    docs = spark.createDataFrame([(1, f"well {item} then"), (2, item), (2, "nothing of it"), (3, "nothing"), (None, item)], "doc_id long, text string")
    run = lambda items: sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert run([(7, item)]) == run([(7, item), (7, absent)]) == run([(7, absent), (7, item), (7, item)]) == [(1, 7, 4, 4), (2, 7, 4, 4)]
    assert run([(7, absent), (8, item), (None, item)]) == [(1, 8, 4, 4), (2, 8, 4, 4)]


def test_a_very_long_document_with_a_short_item(spark):
    item = "one two three four five six seven"
    text = " ".join(f"w{i}" for i in range(200_000)) + " " + item + " " + " ".join(f"v{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, text[:2000])], "doc_id long, text string")
    assert [(r.doc_id, r.containment) for r in decontaminate.find(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()] == [(1, 1.0)]
