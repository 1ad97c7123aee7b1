import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings, strategies as st

from quantloom.llm.spelling import BANDS, SUBS, near_pairs, parity_mask, variants, word_counts

LETTER = st.sampled_from("abceéÀstz÷")


def edits(word, letters):
    """Every string one insertion, deletion or replacement away."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return out - {word}


def counted(rows, least_length, least_count, misspell=None):
    counts = Counter()
    for r in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        for run in re.findall("[a-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            if misspell and h % misspell == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def plain(counts, times=5):
    letters = set("".join(counts))
    near = {w: sorted(edits(w, letters) & counts.keys(), key=lambda x: (-counts[x], x)) for w in counts}
    form = {w: x[0] if x and counts[x[0]] >= times * counts[w] else None for w, x in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


@settings(max_examples=300, deadline=None)
@given(st.text(LETTER, max_size=12), st.integers(0, 12), LETTER, st.sampled_from("idr"))
def test_an_edit_flips_two_bits_at_most(word, at, letter, kind):
    at = min(at, len(word))
    other = {"i": word[:at] + letter + word[at:], "d": word[:at] + word[at + 1 :], "r": word[:at] + letter * (at < len(word)) + word[at + 1 :]}[kind]
    x = parity_mask(word) ^ parity_mask(other)
    assert x.bit_count() <= (2 if kind == "r" else 1)
    equal = [k for k in range(3) if not x & BANDS[k]]
    assert equal and all(any(not x & s for s in SUBS[k]) for k in equal)


def test_bands_share_all_bits():
    assert sum(BANDS) == (1 << 63) - 1 and all(sum(s) + b == (1 << 63) - 1 for b, s in zip(BANDS, SUBS))


def test_counts_are_the_plain_ones(odd_docs, no_docs):
    rows = odd_docs.collect()
    for misspell in (None, 3):
        got = {r.word: r.n for r in word_counts(odd_docs.repartition(5), 4, 2, misspell).collect()}
        assert got == counted(rows, 4, 2, misspell)
    assert word_counts(no_docs).count() == 0
    assert variants(word_counts(no_docs)).count() == 0


def words_of_edits(spark):
    """Words in clusters of edits around a few, some of them long, with counts that form chains."""
    import random

    rng = random.Random(5)
    words = {}
    for _ in range(60):
        w = "".join(rng.choice("aeinstéÿ×") for _ in range(rng.randint(1, 9)))
        n = 1
        for _ in range(rng.randint(2, 12)):
            words.setdefault(w, n)
            w = rng.choice(sorted(edits(w, "aeinst")))
            n = n * rng.choice((1, 5, 6)) % 100_000 + 1
    words["x" * 300] = 9
    words["x" * 299] = 45
    words["x" * 150 + "y" + "x" * 149] = 3
    words.pop("", None)
    return words, spark.createDataFrame(list(words.items()), "word string, n long")


def test_variants_are_the_plain_ones(spark):
    words, df = words_of_edits(spark)
    want = plain(words)
    for most in (4096, 4):
        got = variants(df, most=most).collect()
        assert len(got) == len(want)
        assert {tuple(r) for r in got} == want
    pairs = Counter(tuple(r) for r in near_pairs(df, 4).collect())
    assert max(pairs.values()) == 1


def test_null_words_and_counts(spark):
    df = spark.createDataFrame([("abcdef", 5), (None, 5), ("abcdeg", None), ("abcdeh", 25)], "word string, n long")
    assert {tuple(r) for r in variants(df).collect()} == {("abcdef", "abcdeh", "abcdeh", 5, 1, 25), ("abcdeh", None, "abcdeh", 25, 1, None)}


def test_no_task_holds_a_hot_group(spark):
    """Words whose letters are all even share every band; they are met a pair of chunks at a time."""
    import random

    rng = random.Random(9)
    words = defaultdict(int)
    while len(words) < 600:
        half = [rng.choice("abcdefgh") for _ in range(4)]
        both = half * 2
        rng.shuffle(both)
        words["".join(both)] += 7
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {tuple(r) for r in variants(df, most=64).collect()} == plain(words)
