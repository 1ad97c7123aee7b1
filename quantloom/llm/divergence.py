"""How far the sources of a language lie apart in their terms: exact fixed-point shares in dense group-by-term tiles."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import stash

#: Shares are in billionths, each term is taken to occur so often more.
SCALE, PRIOR = 1_000_000_000, 5
TERM = re.compile(rb"[a-z\x80-\xff]+").findall
#: Entries that a task counts before it sends them on; cells of a tile; terms of a tile at least.
MOST_COUNTED, CELLS, LEAST_TERMS = 500_000, 1 << 20, 64


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        langs, sources, terms, n, docs = [], [], [], [], []
        for (lang, source), held in groups.items():
            langs += [lang] * len(held)
            sources += [source] * len(held)
            terms += held
            for a, b in held.values():
                n.append(a)
                docs.append(b)
        groups.clear()
        columns = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
        return pa.record_batch(columns, ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held = groups.setdefault((lang, source), {})
            before = len(held)
            for term, k in Counter(TERM(text.encode().lower())).items():
                if had := held.get(term):
                    had[0] += k
                    had[1] += 1
                else:
                    held[term] = [k, 1]
            size += len(held) - before
            if size > MOST_COUNTED:
                yield rows()
                size = 0
    yield rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): each group's occurrences of each term in whole texts, and its documents that hold it.

    A term is a maximal run of letters a to z and characters beyond ASCII, A to Z lower-cased first. Nulls are empty strings.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), by long division in three steps of a thousand: no step
    leaves 64 bits while a total is below 9e15."""
    below = (totals + PRIOR * terms)[:, None]
    rest, out = counts + PRIOR, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest %= below
    return out + 1


def _tile(rows: pa.Table, most_terms: int) -> pa.Table:
    """One block of a language's terms: what it adds to the distance of each two sources, and each source's own heap of terms.

    Rows without a term are the language's sources with their totals; the others are counts of the block's terms.
    """
    lang, terms_of_lang = rows["lang"][0].as_py(), rows["terms"][0].as_py()
    head = rows.filter(pc.is_null(rows["term"])).sort_by("source")
    body = rows.filter(pc.is_valid(rows["term"]))
    sources, totals = head["source"].to_pylist(), head["n"].to_numpy()
    place = {s: k for k, s in enumerate(sources)}
    coded = body["term"].combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    counts = np.zeros((len(sources), len(names)), np.int64)
    np.add.at(counts, (np.fromiter(map(place.__getitem__, body["source"].to_pylist()), np.int64, body.num_rows), coded.indices.to_numpy(zero_copy_only=False)), body["n"].to_numpy())
    own = shares(counts, totals, terms_of_lang) if names else counts
    whole = shares(counts.sum(0, keepdims=True), totals.sum(keepdims=True), terms_of_lang) if names else counts[:1]
    distance = np.zeros((len(sources), len(sources)), np.int64)
    step = max(1, 4 * CELLS // max(1, own.size))
    for at in range(0, len(sources), step):
        distance[at : at + step] = np.abs(own[at : at + step, None, :] - own[None, :, :]).sum(2)
    source, part, item, value = [], [], [], []
    for k, name in enumerate(sources):
        others = sources[:k] + sources[k + 1 :]
        source += [name] * len(others)
        part += ["pair"] * len(others)
        item += others
        value += np.delete(distance[k], k).tolist()
        above = own[k] - whole[0]
        held = np.nonzero((above > 0) & (counts[k] > 0))[0]
        best = heapq.nsmallest(most_terms, zip((-above[held]).tolist(), (names[t].encode() for t in held.tolist())))
        source += [name] * len(best)
        part += ["term"] * len(best)
        item += [t.decode() for _, t in best]
        value += [-v for v, _ in best]
    return pa.table({"lang": pa.array([lang] * len(source), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def audit(docs: DataFrame, least_docs: int = 30, most_terms: int = 50, cells: int = CELLS) -> DataFrame:
    """For each (lang, source) its distance to every other source of the lang, and the terms that it holds beyond the lang's share.

    Columns lang, source, part, item, value, rank. Each lang keeps the terms in at least `least_docs` of its documents; `shares` gives
    every kept term a share in each source and in the lang. `pair`: the item is another source, the value the sum over all
    kept terms of the difference of their shares. `term`: the item is a kept term that the source has and whose share is above the
    lang's, the value by how much, and only the `most_terms` largest are kept. Ranks start at 1, largest value first, then by item.

    Terms are counted in the tasks that read them. Kept terms are dealt into blocks by their hash, so many that sources times
    terms of a block stay near `cells`; each block is one dense tile, its pair matrix is added to the others' and its heaps are merged
    after it. A hot source or lang is only a larger count there. The result grows with the square of a lang's sources.

    Nulls in lang, source and text are empty strings; sources without terms take part; repeated rows count each; an empty table
    gives none. Other columns, whatever their names, are not read.
    """
    total = F.sum("docs").over(W.partitionBy("lang", "term"))
    kept = stash(term_counts(docs).withColumn("docs", total).where(F.col("docs") >= least_docs).select("lang", "source", "term", "n"))
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = stash(groups.join(held, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))))
    terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    a_block = F.greatest(F.lit(LEAST_TERMS).cast("long"), F.expr(f"{cells}L div sources"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(terms, "lang", "left").select("lang", F.coalesce("terms", F.lit(0).cast("long")).alias("terms"), a_block.alias("a_block"))
    langs = stash(langs.select("lang", "terms", F.greatest(F.lit(1), F.ceil(F.col("terms") / F.col("a_block"))).alias("blocks")))
    head = groups.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), "n", "terms")
    body = kept.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "n", "terms")
    tiles = head.unionByName(body).groupBy("lang", "block").applyInArrow(lambda rows: _tile(rows, most_terms), "lang string, source string, part string, item string, value long")
    summed = tiles.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= most_terms))
