import random
import re

from quantloom.llm import decontaminate as d


def brute(text, items, width=10):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, body in items:
        own = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        n = min(width, len(own))
        for a in range(len(own) - n + 1) if n else ():
            for b in range(len(words) - n + 1):
                if words[b : b + n] == own[a : a + n]:
                    hit |= set(range(b, b + n))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def cases(seed):
    r = random.Random(seed)
    line = lambda n, k: " ".join(r.choice("abcdefghij"[:k]) for _ in range(n))
    items = [(i, line(r.choice([0, 1, 3, 9, 10, 11, 25]), 3)) for i in range(12)] + [(90, None), (91, "..."), (7, line(14, 3))]
    docs = [(i, r.choice([line(60, 3), line(9, 3), line(40, 10), items[i % 12][1] + " x " + line(5, 2), "É À " + line(12, 2)])) for i in range(40)]
    return items, [*docs, (None, line(30, 3)), (200, None), (201, "")]


def test_windows_against_brute_force(spark, monkeypatch):
    for bound in (100_000, 30):
        monkeypatch.setattr(d, "WORDS_PER_AUTOMATON", bound)
        items, docs = cases(bound)
        got = d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4).collect()
        want = {i: brute(t, items, 4) for i, t in docs}
        assert len(got) == len(docs)
        for r in got:
            s = r.word_spans
            assert (r.n_words, sum(s[1::2]) - sum(s[::2]), sorted(r["items"])) == want[r.doc_id]


def test_removal(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven")]
    docs = [(1, "Keep this: One two three four five six seven eight nine ten! And this " + "clean " * 20, "x"), (2, items[0][1], "x"), (3, None, None), (4, "clean", "x")]
    out = d.decontaminated(spark.createDataFrame(docs, "doc_id long, text string, items string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "Keep this: ! And this " + "clean " * 20, 3: None, 4: "clean"}
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminated(out, none).count() == 3


def test_removal_with_items_of_two_blocks(spark, monkeypatch):
    words = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(words[:10])), (2, " ".join(words[5:15])), (3, "left right"), (4, " ".join(words[20:28]))]
    clean = " clean" * 40
    docs = [(1, "See " + " ".join(words[:15]) + "!" + clean), (2, "left " + " ".join(words[:10]) + " right" + clean), (3, " ".join(words[:10]) + " " + " ".join(words[20:28]) + " x" * 12), (4, None)]
    for bound in (100_000, 1):
        monkeypatch.setattr(d, "WORDS_PER_AUTOMATON", bound)
        out = d.decontaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert {r.doc_id: r.text for r in out.collect()} == {1: "See !" + clean, 2: "left  right" + clean, 4: None}


def test_one_row_for_each_row_with_several_blocks(spark, monkeypatch):
    items = [(1, "one two three"), (2, "four five"), (3, "two three four")]
    docs = [(None, "one two three x"), (None, "x x four five"), (7, "four five x"), (7, "x four five"), (7, "x four five"), (8, "one two three four"), (None, None), (None, "")]
    for bound in (100_000, 1):
        monkeypatch.setattr(d, "WORDS_PER_AUTOMATON", bound)
        got = d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        want = [(None, 4, [0, 3], [1]), (None, 4, [2, 4], [2]), (7, 3, [0, 2], [2]), (7, 3, [1, 3], [2]), (7, 3, [1, 3], [2]), (8, 4, [0, 4], [1, 3]), (None, 0, [], []), (None, 0, [], [])]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
