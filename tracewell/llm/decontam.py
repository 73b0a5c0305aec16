"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed once, in shards of a few MB of documents: each stored row holds the shard's terms, and for each term
the sorted positions of its postings. A search expands each test window to the postings of its rarest term (rarest over
the whole index), and intersects the offset-adjusted lists of its other terms from the rarest on; what is left are exact
phrase matches. With `slop`, every term may be off its place by so many words (proximity matches). Postings never leave
their shard, so no exchange grows with term or passage frequency. Where the tests fit in one block, only terms that they
use are indexed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import slices, stored, texts

SHARD_BYTES = 6 << 20
#: Tests that are searched for at once; a longer test is cut into overlapping pieces of so many words.
BLOCK_BYTES = 8 << 20
PIECE_WORDS = 100_000
INDEX = "shard string, doc_ids array<bigint>, n_words binary, terms binary, starts binary, postings binary"
MATCHES = "shard string, row int, starts array<int>, ends array<int>, items array<string>, near array<string>"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long"

#: Bytes to bytes: A-Z lower, every ASCII byte that is no word character to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Numbers(dict):
    """Word -> number from 1, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


@dataclass
class Tests:
    """Distinct windows of a block of test items, as term numbers from 1; each row of `terms` is padded with 0."""

    vocabulary: dict[bytes, int]
    terms: np.ndarray
    lengths: np.ndarray
    items: list[str]
    item_starts: np.ndarray  # window w has the items item_rows[item_starts[w]:item_starts[w + 1]]
    item_rows: np.ndarray


def tests_of(rows: list[tuple[str, bytes]], window: int) -> Tests:
    vocabulary = Numbers()
    items = sorted({i for i, _ in rows})
    number = {x: k for k, x in enumerate(items)}
    parts, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
    for item, text in rows:
        w = words(text)
        ids = np.fromiter(map(vocabulary.__getitem__, w), np.int32, len(w))
        if len(ids):
            parts.append(np.lib.stride_tricks.sliding_window_view(ids, window) if len(ids) >= window else np.append(ids, np.zeros(window - len(ids), np.int32))[None])
            owners.append(np.full(len(parts[-1]), number[item]))
    terms, back = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([back.reshape(-1), np.concatenate(owners)], 1), axis=0)
    return Tests(dict(vocabulary), terms, (terms > 0).sum(1), items, np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1)), pairs[:, 1])


def pieces(items: DataFrame, window: int) -> DataFrame:
    """Stored distinct (id, text) of the items, long ones cut so that every window lies in a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                w = words(raw)
                cut = [b" ".join(w[k : k + PIECE_WORDS + window - 1]) for k in range(0, max(1, len(w) - window + 1), PIECE_WORDS)] if w else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(cut), pa.string()), pa.array(cut, pa.binary())], names=["id", "text"])

    return stored(items.distinct().mapInArrow(run, "id string, text binary"), "tests")


def build_index(docs: DataFrame, vocabulary: dict[bytes, int] | None, gap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored shards of positional postings, for the terms of `vocabulary` or for all; `gap` free positions part two documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text", SHARD_BYTES):
                numbers, lengths, ids = Numbers(), [], []
                for raw in texts(batch.column(1)):
                    w = words(raw)
                    lengths.append(len(w))
                    ids.append(np.fromiter(map(numbers.__getitem__, w) if vocabulary is None else map(vocabulary.get, w, repeat(0)), np.int32, len(w)))
                n = np.array(lengths, np.int64)
                stream = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                position = np.arange(len(stream)) + np.repeat(firsts(n, gap)[:-1] - (np.cumsum(n) - n), n)
                known = np.flatnonzero(stream)
                order = known[np.argsort(stream[known], kind="stable")]
                terms, starts = np.unique(stream[order], return_index=True)
                names = list(numbers) if vocabulary is None else by_number
                postings = np.diff(position[order], prepend=0).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{task}-{k}"]), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([n.astype(np.int32).tobytes()], pa.binary()), pa.array([b" ".join([names[t - 1] for t in terms.tolist()])], pa.binary()), *(pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (np.append(starts, len(order)), postings))],
                    names=["shard", "doc_ids", "n_words", "terms", "starts", "postings"],
                )
                k += 1

    by_number = sorted(vocabulary, key=vocabulary.get) if vocabulary is not None else []
    return stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, INDEX), "postings")


def firsts(n: np.ndarray, gap: int) -> np.ndarray:
    """Position of each document's first word in its shard, and the end; n: words of the documents."""
    return gap + np.append(0, np.cumsum(n + gap))


def term_counts(index: DataFrame, tests: Tests) -> np.ndarray:
    """Postings of each term over all shards; comes to the driver, bounded by the block's vocabulary."""
    vocabulary = tests.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[[vocabulary.get(t, 0) for t in terms.split()]] += np.diff(np.frombuffer(starts, np.int32))
        total[0] = 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in index.select("terms", "starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def phrases(keys: np.ndarray, tests: Tests, order: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, position of its rarest term) of matches: every term of the window lies within `slop` of its place
    after start. keys: sorted term << 32 | position; order: each window's offsets, rarest term first."""
    rows = np.arange(len(tests.lengths))
    rare = tests.terms[rows, order[:, 0]].astype(np.int64)
    lo, hi = np.searchsorted(keys, rare << 32), np.searchsorted(keys, (rare + 1) << 32)
    n = hi - lo
    window = np.repeat(rows, n)
    posting = keys[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())] & 0xFFFFFFFF
    shift = np.arange(-slop, slop + 1)
    start = (posting - order[window, 0])[:, None] + shift
    window, posting, start = np.repeat(window, len(shift)), np.repeat(posting, len(shift)), start.reshape(-1)
    for j in range(1, order.shape[1]):
        if not len(window):
            break
        offset = order[window, j]
        inside = j < tests.lengths[window]
        want = (tests.terms[window, offset].astype(np.int64) << 32) | (start + offset - slop)
        at = np.searchsorted(keys, want)
        got = keys[np.minimum(at, len(keys) - 1)]
        keep = ~inside | ((at < len(keys)) & (got >= want) & (got <= want + 2 * slop))
        window, posting, start = window[keep], posting[keep], start[keep]
    return window, start, posting


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 2, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Words of each document inside an occurrence of a test window, and the items whose windows occur.

    Windows are `window` consecutive item words; an item of fewer, but not none, is one window. `n_near` counts the items
    with a proximity match: a window and a start such that every term of the window occurs within `slop` words of its
    place after that start, in one document; exact matches are among them. Null texts have no words; items without words
    match nothing; a null item id is written as the empty string; repeated items count once; null document ids and
    repeated rows pass through, a row each; either table may be empty; other columns are not read. The index is built
    once. Items are searched for in blocks of about 8 MB, chosen by measured size; only a block comes to the driver.
    """
    items = items.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("id"), F.col(item_text_col).alias("text")).filter(F.col("text").isNotNull())
    items, gap = pieces(items, window), window + 2 * slop
    total = items.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    if blocks == 1:
        tests = tests_of([(r["id"], bytes(r["text"])) for r in items.collect()], window)
        return search(build_index(docs, tests.vocabulary, gap, id_col, text_col), tests, gap, slop, whole=True)
    index, found = build_index(docs, None, gap, id_col, text_col), None
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        tests = tests_of([(r["id"], bytes(r["text"])) for r in block.collect()], window)
        part = stored(search(index, tests, gap, slop), "leaks")
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("shard", "row").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items", "near")))
    return documents_of(index).join(found, ["shard", "row"], "left").select("doc_id", "n_words", "starts", "ends", "items", "near").mapInArrow(_counted, RESULT)


def documents_of(index: DataFrame) -> DataFrame:
    """(shard, row, doc_id, n_words) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, ids, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(ids), pa.string()), pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.int64()), pa.array(np.frombuffer(n, np.int32).astype(np.int64))], names=["shard", "row", "doc_id", "n_words"])

    return index.select("shard", "doc_ids", "n_words").mapInArrow(run, "shard string, row int, doc_id long, n_words long")


def search(index: DataFrame, tests: Tests, gap: int, slop: int, whole: bool = False) -> DataFrame:
    """Documents with matches: hit intervals (words, end exclusive), ids of matching items, ids of near ones. whole: the
    result, for every document."""
    counts, vocabulary = term_counts(index, tests), tests.vocabulary
    width = tests.terms.shape[1]
    cost = np.where(tests.terms > 0, counts[tests.terms], np.iinfo(np.int64).max)
    order = np.argsort(cost, axis=1, kind="stable").astype(np.int16 if width > 127 else np.int8)

    def of_items(pairs: np.ndarray) -> dict[int, list[str]]:
        """(document, window) rows -> the items of each document."""
        if not len(pairs):
            return {}
        n = np.diff(tests.item_starts)[pairs[:, 1]]
        rows = tests.item_rows[np.repeat(tests.item_starts[pairs[:, 1]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        both = np.unique(np.stack([np.repeat(pairs[:, 0], n), rows], 1), axis=0)
        cut = np.flatnonzero(np.diff(both[:, 0])) + 1
        return {int(g[0, 0]): [tests.items[i] for i in g[:, 1]] for g in np.split(both, cut)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                n = np.frombuffer(r["n_words"], np.int32).astype(np.int64)
                terms = np.array([vocabulary.get(t, 0) for t in r["terms"].split()], np.int64)
                starts, first = np.frombuffer(r["starts"], np.int32), firsts(n, gap)
                keys = (np.repeat(terms, np.diff(starts)) << 32) | np.cumsum(np.frombuffer(r["postings"], np.int32).astype(np.int64))
                keys = np.sort(keys[keys >> 32 > 0])
                none = (np.zeros(0, np.int64),) * 3
                exact = phrases(keys, tests, order, 0) if len(keys) else none
                near = phrases(keys, tests, order, slop) if slop and len(keys) else exact
                doc = np.searchsorted(first, exact[1], side="right") - 1
                hits: dict[int, tuple[list[int], list[int]]] = {}
                if len(doc):
                    by = np.lexsort((exact[1], doc))
                    lo, hi, d = (exact[1] - first[doc])[by], (exact[1] - first[doc] + tests.lengths[exact[0]])[by], doc[by]
                    for at in np.split(np.arange(len(d)), np.flatnonzero(np.diff(d)) + 1):
                        top = np.maximum.accumulate(hi[at])
                        new = np.flatnonzero(np.append(True, lo[at][1:] > top[:-1]))
                        hits[int(d[at[0]])] = (lo[at][new].tolist(), np.append(top[new[1:] - 1], top[-1]).tolist())
                found = of_items(np.unique(np.stack([doc, exact[0]], 1), axis=0))
                close = of_items(np.unique(np.stack([np.searchsorted(first, near[2], side="right") - 1, near[0]], 1), axis=0)) if slop else found
                rows = range(len(n)) if whole else sorted(hits.keys() | close.keys())
                lists = [*(pa.array([hits[k][i] if k in hits else [] for k in rows], pa.list_(pa.int32())) for i in (0, 1)), *(pa.array([x.get(k, []) for k in rows], pa.list_(pa.string())) for x in (found, close))]
                names = ["starts", "ends", "items", "near"]
                if whole:
                    yield from _counted([pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(n), *lists], names=["doc_id", "n_words", *names])])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([r["shard"]] * len(rows), pa.string()), pa.array(rows, pa.int32()), *lists], names=["shard", "row", *names])

    return index.mapInArrow(run, RESULT if whole else MATCHES)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, count, digest, near = [], [], [], []
        for r in batch.select(["starts", "ends", "items", "near"]).to_pylist():
            n = end = 0
            for a, b in sorted(zip(r["starts"] or [], r["ends"] or [])):
                n, end = n + max(0, b - max(a, end)), max(end, b)
            ids = sorted(set(r["items"] or []))
            hit.append(n)
            count.append(len(ids))
            near.append(len(set(r["near"] or [])))
            digest.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array([n > 0 for n in hit], pa.bool_()), pa.array(near, pa.int64())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"])
