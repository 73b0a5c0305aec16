"""Substring dedup: seed and extend.

Every text is winnowed on word 4-grams so that each window of `length` words owns exactly one anchor, chosen from the
window's own words; copies of a window thus meet at the same anchor. Anchors are counted first. Those that occur more than
once are seeds: each of their occurrences is sent with the words around it, and the occurrences of a seed are extended
word by word to the right and to the left, together: a step splits them into classes that agree so far, never pair by
pair. A window is repeated if another occurrence agrees with it as far as it reaches on both sides; runs of such windows
merge into maximal repeats. Of very frequent seeds each window is a group of its own, counted by partial aggregates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import BitMap, bounds, slices, stored, texts, whole_groups

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
GRAM = 4
PIECE = 4 << 20
#: A seed with more occurrences than this is extended window by window.
HOT = 20_000
#: Digests that a task remembers to pass over copies; a full memory starts anew.
REMEMBERED = 200_000
OCCURRENCE = "anchor long, digest binary, first int, n int, offset int, words binary"
RUN = "digest binary, first int, n int"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes(dict):
    """Word -> XXH64; a dict so that a repeated word costs one look-up."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < 500_000 and len(word) <= 64:
            self[word] = h
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of every run of n words, by doubling: a run of a + b words is hash(a) * base**b + hash(b)."""
    out, have, power, done = h, 1, base, None
    offset, rest = 0, n
    while rest:
        if rest & 1:
            if done is None:
                done, offset = out, have
            else:
                m = len(h) - offset - have + 1
                done = done[:m] * power + out[offset : offset + m]
                offset += have
        rest >>= 1
        if rest:
            m = len(out) - have
            out = out[:m] * power + out[have : have + m]
            power, have = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF), have * 2
    return mixed(done)


def anchors(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first owned window, number of owned windows, anchor's place) of a text of `length` words or more."""
    grams = rolling(h, GRAM)
    span, n = length - GRAM + 1, len(h) - length + 1
    # Rightmost minimum of each window's grams: doubling keeps (value, place) of the better half.
    best, have = np.arange(len(grams)), 1
    while have < span:
        step = min(have, span - have)
        m = len(best) - step
        left, right = best[:m], best[step:]
        best = np.where(grams[right] <= grams[left], right, left)
        have += step
    new = np.flatnonzero(np.append(True, best[1:n] != best[: n - 1]))
    return grams[best[new]].view(np.int64), new, np.diff(np.append(new, n)), best[new]


def scanned(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[tuple[bytes, list[bytes], tuple]]]:
    """(digest, words, anchors) of the texts of each piece that hold a window. Of equal texts close to each other only two
    are looked at: two prove that all windows repeat."""
    word, seen, twice = WordHashes(), set(), set()
    for whole in batches:
        for batch in slices(whole, "text", PIECE):
            piece = []
            for raw in texts(batch.column(0)):
                words = raw.split()
                if len(words) < length or (digest := hashlib.md5(raw).digest()) in twice:
                    continue
                (twice if digest in seen else seen).add(digest)
                piece.append((digest, words, anchors(np.fromiter(map(word.__getitem__, words), np.uint64, len(words)), length)))
            if len(seen) > REMEMBERED:
                seen, twice = set(), set()
            if piece:
                yield piece


def seeds(docs: DataFrame, length: int) -> DataFrame:
    """Stored (anchor, n) of the anchors that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in scanned(batches, length):
            anchor, n = np.unique(np.concatenate([a[0] for _, _, a in piece]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], names=["anchor", "n"])

    return stored(docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1"), "seeds")


def occurrences(docs: DataFrame, length: int, found: DataFrame) -> DataFrame:
    """Rows of two kinds. An occurrence of a seed: the text's digest, the first window it owns and their number, the
    anchor's offset from there, and the words of those windows. A run known to repeat: no anchor, digest, first window, n.

    Occurrences with the same words in one piece are known to repeat, and only the first of them is sent with its words.
    """
    seed = BitMap(found.select("anchor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in scanned(batches, length):
            rows: list[tuple] = []
            sent: dict[bytes, tuple | None] = {}
            for digest, words, (anchor, first, n, at) in piece:
                k = np.flatnonzero(seed.has(anchor))
                for a, f, m, o in zip(anchor[k].tolist(), first[k].tolist(), n[k].tolist(), (at - first)[k].tolist()):
                    around = b" ".join(words[f : f + m + length - 1])
                    if around not in sent:
                        sent[around] = (None, digest, f, m, None, None)
                        rows.append((a, digest, f, m, o, around))
                        continue
                    if known := sent[around]:
                        rows.append(known)
                        sent[around] = None
                    rows.append((None, digest, f, m, None, None))
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["anchor", "digest", "first", "n", "offset", "words"])

    return stored(docs.select("text").mapInArrow(run, OCCURRENCE), "occurrences")


def extended(rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, window of the row) of the windows that another occurrence of the same anchor repeats. rows: sorted by anchor."""
    numbers: dict[bytes, int] = {}
    around = [[numbers.setdefault(w, len(numbers) + 1) for w in x.split()] for x in rows.column("words").to_pylist()]
    size = np.array([len(x) for x in around])
    flat = np.append(np.concatenate([np.array(x, np.int64) for x in around]), 0)
    end = np.cumsum(size)
    offset, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("offset", "n"))
    at = end - size + offset
    group = np.repeat(np.arange(len(bounds(rows, ["anchor"])) - 1), np.diff(bounds(rows, ["anchor"])))

    def step(classes: np.ndarray, place: np.ndarray, inside: np.ndarray) -> np.ndarray:
        word = np.where(inside, flat[np.where(inside, place, 0)], 0)
        return np.unique(classes * (len(numbers) + 1) + word, return_inverse=True)[1]

    right, left = [group], [group]  # by words that the classes agree on, from the anchor to the right, before it to the left
    for k in range(length):
        right.append(step(right[-1], at + k, at + k < end))
    for k in range(length - GRAM):
        left.append(step(left[-1], at - k - 1, k < offset))
    found = [(np.zeros(0, np.int64),) * 2]
    for k, classes in enumerate(left):
        own = np.flatnonzero((offset >= k) & (offset - k < n))
        both = classes[own] * (len(size) + 1) + right[length - k][own]
        _, back, times = np.unique(both, return_inverse=True, return_counts=True)
        again = own[times[back] > 1]
        found.append((again, offset[again] - k))
    return tuple(np.concatenate(x) for x in zip(*found))


def repeats(docs: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """(digest, first, n): runs of windows whose words start elsewhere as well."""
    found = seeds(docs, length)
    rows = occurrences(docs, length, found)
    sent = rows.filter("anchor is not null")
    known = rows.filter("anchor is null").select("digest", "first", "n")
    frequent = stored(found.filter(F.col("n") > hot).select("anchor"), "frequent-seeds")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["anchor"], 10_000):
            size = np.diff(bounds(rows, ["anchor"]))
            rows = rows.take(pa.array(np.flatnonzero(np.repeat(size > 1, size)))).combine_chunks()
            if not rows.num_rows:
                continue
            row, window = extended(rows, length)
            by = np.lexsort((window, row))
            row, window = row[by], window[by]
            start = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(window) != 1))[: len(row)])
            first = rows.column("first").to_numpy()[row[start]] + window[start]
            yield pa.RecordBatch.from_arrays([rows.column("digest").combine_chunks().take(pa.array(row[start])), pa.array(first.astype(np.int32)), pa.array(np.diff(np.append(start, len(row))).astype(np.int32))], names=["digest", "first", "n"])

    if frequent.isEmpty():
        return known.unionByName(sent.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(extend, RUN))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, first, n, around in zip(*(batch.column(k).to_pylist() for k in range(4))):
                w = around.split()
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(b" ".join(w[k : k + length])).digest() for k in range(n)], pa.binary()), pa.array([digest] * n, pa.binary()), pa.array(range(first, first + n), pa.int32())], names=["window", "digest", "first"])

    each = stored(sent.join(frequent, "anchor", "left_semi").select("digest", "first", "n", "words").mapInArrow(windows, "window binary, digest binary, first int"), "windows")
    again = stored(each.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window"), "repeated-windows")
    rare = sent.join(frequent, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(extend, RUN)
    return known.unionByName(rare).unionByName(each.join(again, "window", "left_semi").select("digest", "first", F.lit(1).alias("n")))


def remove_repeats(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """Words of each document, words removed, and a digest of the words kept.

    A word goes if a window of `length` words covers it whose words also start anywhere else, same document included;
    windows are judged on the input. Null texts have no words; texts shorter than a window lose none; repeated rows and
    copies lose everything from `length` words on, one row each; null ids pass through; an empty table gives an empty
    result; other columns are not read. With `keep_text` the kept words come too. Windows are compared word by word; those
    of seeds with more than `hot` occurrences by their MD5.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    runs = repeats(base.filter(F.col("text").isNotNull()), length, hot).groupBy("digest").agg(F.collect_set(F.struct("first", "n")).alias("runs"))
    runs = stored(runs, "repeats")
    # Texts without a repeat are never shuffled: a map of the digests that have one goes to the scan.
    touched = BitMap(runs.select(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")))
    schema = RESULT + ", kept_text string" * keep_text

    def answered(batch: pa.RecordBatch, runs: Iterator[tuple]) -> pa.RecordBatch:
        total, gone, digest, kept_text = [], [], [], []
        for raw, (first, n) in zip(texts(batch.column("text")), runs):
            words = raw.split()
            kept = words
            if first:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, np.add(first, n) + (length - 1), -1)
                kept = [w for w, c in zip(words, np.cumsum(edge[:-1]).tolist()) if not c]
            joined = b" ".join(kept)
            total.append(len(words))
            gone.append(len(words) - len(kept))
            digest.append(hashlib.sha256(joined).hexdigest())
            kept_text.append(joined.decode() if keep_text else None)
        columns = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        return pa.RecordBatch.from_arrays(columns + [pa.array(kept_text, pa.string())] * keep_text, names=names + ["kept_text"] * keep_text)

    def split(hit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text", PIECE):
                    digests = [hashlib.md5(x).digest() for x in texts(batch.column("text"))]
                    is_hit = touched.has(np.array([int.from_bytes(d[:7], "big") for d in digests], np.int64))
                    batch = batch.filter(pa.array(is_hit == hit))
                    if hit:
                        yield batch.append_column("digest", pa.array([d for d, h in zip(digests, is_hit) if h], pa.binary()))
                    else:
                        yield answered(batch, iter([(None, None)] * batch.num_rows))

        return run

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                yield answered(batch, zip(batch.column("first").to_pylist(), batch.column("n").to_pylist()))

    asked = base.mapInArrow(split(True), "doc_id long, text string, digest binary").join(runs.hint("shuffle_hash"), "digest", "left")
    asked = asked.select("doc_id", "text", F.col("runs.first").alias("first"), F.col("runs.n").alias("n"))
    return base.mapInArrow(split(False), schema).unionByName(asked.mapInArrow(judged, schema))
