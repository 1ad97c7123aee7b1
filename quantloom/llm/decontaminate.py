"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import functools
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: What a word is (digits, a-z and every character beyond ASCII, after A-Z are lower-cased).
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {ord("A") + i: ord("a") + i for i in range(26)}
#: Words of benchmark items in one automaton; more items make more automata, never a larger one.
WORDS_PER_AUTOMATON = 100_000


def normalised(text: str) -> str:
    """A-Z in lower case, the length unchanged."""
    return text.lower() if text.isascii() else text.translate(LOWER)


class Automaton:
    """Suffix automaton of several word sequences, with the windows that end in each state.

    A window is `width` consecutive words of an item; a shorter item is one window. `ends[state]` lists (length, items) of
    the windows that are suffixes of what the state stands for, longest first.
    """

    def __init__(self, items: list[tuple[int, list[str]]], width: int):
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.width = [-1], [0], width
        texts = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in items if words]
        for _, word_ids in texts:
            last = 0
            for w in word_ids:
                last = self._extend(last, w)
        windows: dict[int, dict[int, set[int]]] = {}
        for item, word_ids in texts:
            state = length = 0
            for n, w in enumerate(word_ids, 1):
                state, length = self.step(state, length, w)
                if length >= width:
                    windows.setdefault(self.cut(state, width), {}).setdefault(width, set()).add(item)
                elif n == len(word_ids):
                    windows.setdefault(state, {}).setdefault(length, set()).add(item)
        self.ends: list[tuple[tuple[int, tuple[int, ...]], ...]] = [()] * len(self.len)
        for state in sorted(range(len(self.len)), key=self.len.__getitem__):
            own = tuple((n, tuple(items)) for n, items in sorted(windows.get(state, {}).items(), reverse=True))
            self.ends[state] = own + (self.ends[self.link[state]] if state else ())
        self.least = min((min(len(ids), width) for _, ids in texts), default=0)

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            to = self.next[last][w]
            return to if self.len[to] == self.len[last] + 1 else self._split(last, w, to)
        new = self._state({}, self.len[last] + 1, 0)
        while last >= 0 and w not in self.next[last]:
            self.next[last][w] = new
            last = self.link[last]
        if last >= 0:
            to = self.next[last][w]
            self.link[new] = to if self.len[to] == self.len[last] + 1 else self._split(last, w, to)
        return new

    def _split(self, at: int, w: int, to: int) -> int:
        twin = self._state(dict(self.next[to]), self.len[at] + 1, self.link[to])
        self.link[to] = twin
        while at >= 0 and self.next[at].get(w) == to:
            self.next[at][w] = twin
            at = self.link[at]
        return twin

    def _state(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The state of the longest suffix, read so far and with w, that some item holds; and its length."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        if w in self.next[state]:
            return self.next[state][w], length + 1
        return 0, 0

    def cut(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def hits(self, words: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges that windows cover (they may overlap) and the items whose windows occur."""
        spans, items = [], set()
        if not self.least or len(words) < self.least:
            return spans, items
        ids = np.fromiter(map(self.ids.get, words, (-1 for _ in words)), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        for begin, end in known.reshape(-1, 2)[known[1::2] - known[::2] >= self.least].tolist():
            state = length = 0
            for at in range(begin, end):
                state, length = self.step(state, length, int(ids[at]))
                for n, found in self.ends[state]:
                    if n <= length:
                        spans.append((at + 1 - n, at + 1))
                        items.update(found)
        return spans, items


def _automata(benchmark: DataFrame, width: int) -> Iterator[Automaton]:
    """One automaton for each block of items; the driver holds one block at a time."""
    block, words = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").toLocalIterator():
        found = WORD.findall(normalised(row["text"]))
        block.append((row["item_id"], found))
        words += len(found)
        if words >= WORDS_PER_AUTOMATON:
            yield Automaton(block, width)
            block, words = [], 0
    yield Automaton(block, width)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shared(docs: DataFrame, benchmark: DataFrame, width: int) -> list:
    """The automata, each pickled and broadcast on its own."""
    return [docs.sparkSession.sparkContext.broadcast(pickle.dumps(a)) for a in _automata(benchmark, width)]


@functools.lru_cache(1)
def _loaded(shared) -> Automaton:
    """A worker holds one automaton at a time, and a single one from task to task."""
    return pickle.loads(shared.value)


def _covered(texts: list[str | None], automata: list) -> tuple[list[int], list[list[tuple[int, int]]], list[set[int]]]:
    """For each text its words, the runs of them that windows of any automaton cover, and the items they are from."""
    n_words, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
    for shared in automata:
        a = _loaded(shared)
        for k, text in enumerate(texts):
            words = WORD.findall(normalised(text or ""))
            found, of = a.hits(words)
            n_words[k] = len(words)
            spans[k] += _merged(found)
            items[k] |= of
    return n_words, [_merged(s) for s in spans], items


def _scan(batches: Iterator[pa.RecordBatch], automata) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, spans, items = _covered(batch.column(1).to_pylist(), automata)
        flat = [[x for s in found for x in s] for found in spans]
        yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(flat, pa.list_(pa.int32())), pa.array(map(sorted, items), pa.list_(pa.int64()))], names=["doc_id", "n_words", "word_spans", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """For every document the words that benchmark windows cover, and the items they are from.

    Columns: doc_id, n_words, word_spans (begin, end, begin, end, ... of covered runs, in words), items. Every document's words
    stream through an automaton of the items, which keeps the longest match that ends at each word; only runs of words
    that the items know are walked. A benchmark beyond one automaton's bound has several, which each batch of documents meets
    one after the other.

    A null or empty text has no words; a null item or one without words has no window. Every row gives one row, also repeated
    documents and null ids. An empty table gives none.
    """
    automata = _shared(docs, benchmark, width)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda it: _scan(it, automata), "doc_id long, n_words long, word_spans array<int>, items array<long>")


def _removed(batches: Iterator[pa.RecordBatch], automata, limit: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        given = batch.column("text").to_pylist()
        n_words, covered_runs, _ = _covered(given, automata)
        texts, kept = [], []
        for text, n, spans in zip(given, n_words, covered_runs, strict=True):
            words = list(WORD.finditer(normalised(text))) if spans else []
            covered, at, parts = sum(e - b for b, e in spans), 0, []
            for b, e in spans:
                parts.append(text[at : words[b].start()])
                at = words[e - 1].end()
            texts.append("".join(parts) + text[at:] if spans else text)
            kept.append(covered <= limit * n)
        columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(kept))


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, coverage: float = 0.5) -> DataFrame:
    """The documents without the spans that benchmark windows cover; one covered beyond `coverage` of its words goes whole.

    The spans of all blocks of a large benchmark are found on the text as given and united before any is removed. Nulls and
    further columns stay as they are.
    """
    automata = _shared(docs, benchmark, width)
    return docs.mapInArrow(lambda it: _removed(it, automata, coverage), docs.schema)
