import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
from hypothesis import given, settings, strategies as st

from quantloom.llm import queries
from quantloom.llm.divergence import audit, shares


def plain(rows, least_docs, most_terms):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        groups = {s: c for (l, s), c in counts.items() if l == lang}
        groups[None] = sum(groups.values(), Counter())
        share = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[t] for t in kept) + 5 * len(kept)) for t in kept} for s, c in groups.items()}
        for s in groups.keys() - {None}:
            pairs = [(-sum(abs(share[s][t] - share[o][t]) for t in kept), o) for o in groups.keys() - {s, None}]
            over = [(share[None][t] - share[s][t], t.encode()) for t in kept if groups[s][t] and share[s][t] > share[None][t]]
            out |= {(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(sorted(over)[:most_terms], 1)}
    return out


def test_against_the_plain_one(odd_docs, no_docs, spark):
    rows = odd_docs.collect() + [r.asDict() | {"lang": l, "source": s} for r in odd_docs.collect() for l, s in (("en", "c"), ("de", None), ("", "none"))]
    docs = spark.createDataFrame([tuple(r) if not isinstance(r, dict) else tuple(r.values()) for r in rows], odd_docs.schema)
    for least_docs, most_terms, cells in ((2, 50, 1 << 20), (1, 3, 256), (1000, 50, 1 << 20)):
        got = audit(docs.repartition(5), least_docs, most_terms, cells).collect()
        assert len(got) == len(set(got))
        assert {tuple(r) for r in got} == plain(docs.collect(), least_docs, most_terms)
    assert audit(no_docs).count() == 0


def test_many_blocks_give_what_one_gives(spark):
    """More terms than a block holds: the pair matrices are added up and the heaps merged."""
    rng = np.random.default_rng(3)
    text = lambda: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in rng.zipf(1.3, 400) % 600)
    docs = spark.createDataFrame([(i, text(), "en", f"s{i % 3}") for i in range(40)], "doc_id long, text string, lang string, source string")
    want = plain(docs.collect(), 2, 20)
    assert {tuple(r) for r in audit(docs, 2, 20, 1).collect()} == {tuple(r) for r in audit(docs, 2, 20).collect()} == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 10**14), min_size=1, max_size=5), st.integers(0, 10**14))
def test_shares_are_exact(counts, more):
    total, terms = sum(counts) + more, len(counts)
    got = shares(np.array([counts], np.int64), np.array([total], np.int64), terms)
    assert got[0].tolist() == [1 + int(Fraction(10**9 * (c + 5), total + 5 * terms)) for c in counts]


def test_against_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet')")
    sql = queries.ORACLES["op13_source_divergence"]
    want = {tuple(r) for r in con.execute(sql).fetchall()}
    assert {tuple(r) for r in queries.op13_source_divergence(spark, folder).collect()} == want
