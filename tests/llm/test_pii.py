import re
import time
from collections import Counter

from hypothesis import given, settings, strategies as st

from quantloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain(text):
    """The contract's patterns, searched as they stand."""
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and not (sum(d[-1::-2]) + sum(2 * x - 9 * (x > 4) for x in d[-2::-2])) % 10:
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("aB1290.@@-+ ()_%é\n"), max_size=60))
def test_base_spans_are_the_plain_search(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111 1111 1111", "+1 (168) 555-5254", "255.1.2.3", "000000000000000000000001.2.3.4", "0" * 30 + "300.1.1.1", "a.b@c-d.ex.com", " ", "-", "x", "7", ".", "@"]), max_size=12).map("".join))
def test_base_spans_on_likely_texts(text):
    assert pii.base_spans(text) == plain(text)


def told(chain, table):
    """Right, found and wanted added spans by kind."""
    texts = [t for t, _ in table]
    got = pii.added_spans(texts, [pii.base_spans(t) for t in texts], chain)
    right, found, wanted = Counter(), Counter(), Counter()
    for g, (t, s) in zip(got, table):
        base = pii.base_spans(t)
        s = [x for x in s if not any(a < x[1] and x[0] < b for a, b, _ in base)]
        right.update(k for *x, k in set(g) & set(s))
        found.update(k for *_, k in g)
        wanted.update(k for *_, k in s)
    return right, found, wanted


def test_field_on_unseen_examples():
    right, found, wanted = told(pii.default_chain(), pii.labelled_table(4, seed=99))
    assert set(wanted) == {0, 2, 3, 4}
    for k in wanted:
        assert right[k] >= 0.93 * wanted[k] and right[k] >= 0.95 * found[k], (k, right, found, wanted)


def test_field_on_unseen_forms():
    """Each template is decoded by a field that was trained without it and its like: one in four is left out at a time."""
    right, found, wanted = Counter(), Counter(), Counter()
    apart = lambda of, fold, held: tuple(x for k, x in enumerate(of) if (k % 4 == fold) == held)
    for fold in range(4):
        chain = pii.fit(pii.labelled_table(3, 11, apart(pii.TEMPLATES, fold, False), apart(pii.forms(), fold, False)))
        for total, part in zip((right, found, wanted), told(chain, pii.labelled_table(2, 5, apart(pii.TEMPLATES, fold, True), apart(pii.forms(), fold, True)))):
            total.update(part)
    print({pii.FIELD_KINDS[k]: (round(right[k] / wanted[k], 3), round(right[k] / max(1, found[k]), 3)) for k in sorted(wanted)})
    for k in (0, 2, 3, 4):
        assert right[k] >= 0.9 * wanted[k] and right[k] >= 0.9 * found[k], (k, right, found, wanted)


#: Sentences written for this test alone; <...> is what the field is to find, of the kind before the bar.
WRITTEN = """
0|You can reach the editor, <maria.lopez at elpais dot es>, before noon.
0|Bug reports go to <kernel-team [at] lists [dot] debian [dot] org>.
0|My address is <bob_smith (at) hotmail (dot) com> if you need it.
0|Write me: <anna.k at web dot de>
0|questions? <support [at] example.com>
0|The author (<j.r.tolkien at pembroke dot ox dot ac dot uk>) replied.
0|send your cv to <jobs(at)startup(dot)io> by friday
0|mail <max underscore mueller at gmx dot net> for tickets
2|I paid with <4111/1111/1111/1111> and it failed.
2|The card was <5500.0000.0000.0004>, he said.
2|visa <4012 / 8888 / 8888 / 1881> exp 12/26
2|Amex: <3782/822463/10005>
3|Call the office at <(212) 555-0187> after nine.
3|Tel. <030 / 123 45 67> is the front desk.
3|my cell is <415.555.2671>, text me
3|Telefon: <0171/2345678>
3|You may phone <020 7946 0958> or come by.
3|appelez le <01 42 68 53 00> avant midi
3|Fax <001 212 555 0199> is gone.
3|whatsapp <0612-345-678> anytime
-|The match ended 3-2 and 45,000 came in 1998 and 2002.
-|Invoice 2024-000123456 was paid on 12.03.2024.
-|We sat at the table and put a dot on it.
-|Version 10.15.7 build 19H2026 runs on 64 machines.
-|The population grew from 1 204 578 to 1 350 122.
-|See pages 120-135, 140-152 and 160-171 of the book.
-|Coordinates 48.858222, 2.294500 mark the tower.
-|ISBN 978-0-306-40615-7 is out of print.
-|Look at example.com for details, or at the library.
-|At 10:15:30 the train left; at 11:45:10 it came.
""".strip().split("\n")


def test_field_on_written_sentences():
    chain, right, wanted, wrong = pii.default_chain(), Counter(), Counter(), []
    for line in WRITTEN:
        kind, text = line.split("|")[0], line.split("|", 1)[1]
        a, b = text.find("<"), text.find(">") - 1
        text = text.replace("<", "").replace(">", "")
        got = pii.added_spans([text], [pii.base_spans(text)], chain)[0]
        if kind == "-":
            wrong += [(text, s) for s in got]
        else:
            wanted[int(kind)] += 1
            right[int(kind)] += any(s < b and a < e and k == int(kind) and abs(s - a) < 4 and abs(e - b) < 4 for s, e, k in got)
            if not right[int(kind)] or not got:
                print("missed", text, got)
    print({pii.FIELD_KINDS[k]: f"{right[k]} of {wanted[k]}" for k in wanted}, wrong)
    assert len(wrong) <= 1 and all(right[k] >= 0.75 * wanted[k] for k in wanted)


def test_fitting_takes_seconds():
    began = time.time()
    pii.fit(pii.labelled_table())
    assert time.time() - began < 10  # about one on an idle core


def test_secrets():
    chain = pii.default_chain()
    for text, secret in (('x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### 4785', "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"), ("aws_secret_key: AbC123xyZ99887766QwErTy00 end", "AbC123xyZ99887766QwErTy00")):
        a = text.index(secret)
        assert pii.added_spans([text], [[]], chain)[0] == [(a, a + len(secret), 4)], text
    for text in ('token = "something"', "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "the key is important to everybody"):
        assert pii.added_spans([text], [[]], chain)[0] == [], text


def test_the_field_adds_to_the_documents(spark):
    got = pii.find(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).agg({"n_added": "sum"}).first()[0]
    assert got > 0


def test_time_grows_with_the_length():
    for text in ("a" * 200_000 + " dot at " + "b" * 100_000, "at " * 20_000 + "dot", "1-" * 20_000, "@" * 20_000 + "a.b", "token " * 20_000, "key=" * 20_000, "token = " + "a1" * 20_000, "1." * 20_000):
        took = []
        for whole in (text, text * 4):
            began = time.time()
            pii.added_spans([whole], [pii.base_spans(whole)], pii.default_chain())
            took.append(time.time() - began)
        assert took[1] < 12 * took[0] + 2, (text[:20], took)


def test_windows_decode_as_the_whole():
    chain = pii.default_chain()
    texts = ["call (555) 123-4567 today", "card 4111/1111/1111/1111 expires", "nothing 12 here 2020-01-01"]
    together = pii.added_spans(texts, [[]] * 3, chain)
    assert together == [pii.added_spans([t], [[]], chain)[0] for t in texts]
    assert [[k for *_, k in s] for s in together] == [[3], [2], []]


def test_rows(odd_docs, no_docs):
    got = pii.find(odd_docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd_docs.collect())
    assert all(r.spans == "" and r.n_email == 0 for r in got if r.doc_id in (2, 3))
    assert pii.find(no_docs).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co or 1.2.3.4 🙂 +1 (168) 555-5254.", "x"), (2, None, "x"), (3, "clean", "x")], "doc_id long, text string, spans string")
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == {1: "mail [EMAIL] or [IP] 🙂 [PHONE].", 2: None, 3: "clean"}


def test_field_sees_every_at_and_every_separator():
    chain = pii.default_chain()
    for begin, found, end, kind in (
        ("Please write to ", "jane.doe [at] example.com", " for details", 0),
        ("or mail ", "jane (at) example.com", " and wait", 0),
        ("contact ", "jane @ example dot com", " today", 0),
        ("write to ", "jane.doe at mail dot example dot org", "", 0),
        ("", "jane [at] example [dot] com", "", 0),
        ("call ", "555\u00a0123\u00a04567", " today", 3),
        ("call ", "555\u2013123\u20134567", " today", 3),
        ("phone ", "555\u00b7123\u00b74567", " now", 3),
        ("tel ", "(555)\u00a0123\u20114567", " or mail", 3),
    ):
        text = begin + found + end
        assert pii.added_spans([text], [pii.base_spans(text)], chain)[0] == [(len(begin), len(begin) + len(found), kind)], text
    for text in ("Visit us at example.com for more.", "We met at noon. Then 1, 2, 3, 4, 5, 6, 7, 8, 9, 10 of us left.", "Sold @ 3.50 each", "mail jane@example.com at once. Done"):
        assert pii.added_spans([text], [pii.base_spans(text)], chain)[0] == [], text


def test_long_windows_decode_apart():
    texts = ["call (555) 123-4567 today", "1, " * 30000, *["tel 555 123 4567 or"] * 2000]
    got = pii.added_spans(texts, [[]] * len(texts), pii.default_chain())
    assert [s[0][2] if s else None for s in got] == [3, None] + [3] * 2000
