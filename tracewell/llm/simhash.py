"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. Two fingerprints within 4 bits either share a
segment, or (no segment being free of errors) at least two of their segments differ by exactly one bit. A segment, as a
word of the perfect (23, 12, 7) Golay code, lies within 3 bits of one codeword and within 4 of up to six; of two words
one bit apart one has even weight and one odd, and the even one's nearest codeword is within 4 of the odd one. So even
segments take one codeword index and odd ones up to six, and each pair of segments gives keys of 24 bits that two such
fingerprints must share. Keys: the 3 segments themselves and about 10 for each of the 3 pairs of segments.

Distinct fingerprints that share a key are verified by their distance and linked to a spanning forest, never to all
pairs; components of the forest are then found by large-star, small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import BitMap, bounds, slices, stored, texts, whole_groups

RADIUS = 4
SHINGLE = 4
SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (lowest bit, bits)
PIECE = 4 << 20
#: A key with more fingerprints than this is dealt out in blocks of so many, each pair of blocks a group of its own.
BLOCK = 65_536
SAMPLE = 64
_POLY = 0b110001110101  # generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the code


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the lower-cased (A-Z) words' shingles, repeats included; a text of fewer words is one shingle."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: max(0, len(words) - shingle)]]
    hash_ = xxhash.xxh64_intdigest
    return np.array([hash_(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :] or ends[-1:])], dtype=np.uint64)


def folded(h: np.ndarray) -> int:
    """The SimHash of shingle hashes: bits set in more than half of them; 0 for none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        ones += np.unpackbits(h[k : k + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return folded(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                fp = np.array([fingerprint(t, shingle) for t in texts(batch.column(1))], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class Golay:
    """Codeword indices (the 12 upper bits) near words of 23 bits."""

    def __init__(self) -> None:
        self.check = np.array([self._remainder(k << 11) for k in range(4096)], dtype=np.int64)
        errors: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(5):
            for at in combinations(range(23), weight):
                e = sum(1 << k for k in at)
                errors[self._remainder(e)].append(e)
        self.near = np.array([e[0] for e in errors], dtype=np.int64)
        self.n = np.array([len(e) for e in errors], dtype=np.int64)
        self.all = np.array([e + [e[0]] * (6 - len(e)) for e in errors], dtype=np.int64)

    @staticmethod
    def _remainder(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= _POLY << (k - 11)
        return x

    def indices(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n x 6 indices, how many of them count): one for words of even weight, all within 4 bits for odd ones."""
        syndrome = self.check[words >> 11] ^ (words & 2047)
        odd = (np.bitwise_count(words.astype(np.uint64)) & 1).astype(bool)
        return (words[:, None] ^ self.all[syndrome]) >> 11, np.where(odd, self.n[syndrome], 1)


def keys_of(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys): the table's number in the upper bits, then a segment or two codeword indices."""
    rows, keys = [], []
    parts = [((fp >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in SEGMENTS]
    near = [golay.indices(p) for p in parts]
    every = np.arange(len(fp))
    for k, p in enumerate(parts):
        rows.append(every)
        keys.append(p | (k << 32))
    for k, (a, b) in enumerate(combinations(range(3), 2)):
        (ia, na), (ib, nb) = near[a], near[b]
        for i in range(6):
            for j in range(6):
                at = np.flatnonzero((na > i) & (nb > j))
                rows.append(at)
                keys.append((ia[at, i] << 12) | ib[at, j] | ((k + 3) << 32))
    return np.concatenate(rows), np.concatenate(keys)


def forest(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) star edges of the components that links within `radius` make among distinct fingerprints.

    Breadth-first: each step compares a few reached fingerprints with those not yet reached, so a dense group costs about
    one look at each member. The root is the smallest, as an unsigned number.
    """
    if len(fp) == 2:
        return (fp[1:], fp[:1]) if bin(int(fp[0]) ^ int(fp[1])).count("1") <= radius else (fp[:0], fp[:0])
    left = np.sort(fp)
    nodes, roots = [], []
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:16], front[16:]
            hit = (np.bitwise_count(left[:, None] ^ some[None]) <= radius).any(1)
            if hit.any():
                nodes.append(left[hit])
                roots.append(np.full(int(hit.sum()), root, dtype=np.uint64))
                front, left = np.concatenate((front, left[hit])), left[~hit]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(nodes), np.concatenate(roots)) if nodes else (none, none)


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (column fp) within `radius` bits (4 at most)."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for whole in batches:
            for lo in range(0, whole.num_rows, 20_000):
                fp = whole.column(0).slice(lo, 20_000).to_numpy()
                rows, keys = keys_of(fp.view(np.uint64), golay)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], names=["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(expand, "key long, fp long")
    # Keys that fill more than a block are found from one fingerprint in 64; each then falls into `parts` blocks and a
    # group for every two blocks. A key that the sample misses is only a larger group: no link depends on it.
    sampled = distinct.select("fp").filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).mapInArrow(expand, "key long, fp long")
    hot = sampled.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block // SAMPLE)
    hot = stored(hot.select("key", F.ceil(F.col("n") * SAMPLE / F.lit(block)).cast("int").alias("parts")), "simhash-hot")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    joined = keyed.join(hot, "key", "left").withColumn("own", own)
    pair = F.when(F.col("parts") > 1, F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, F.col("own")) * F.col("parts") + F.greatest(o, F.col("own")))).otherwise(F.array(F.lit(0)))
    dealt = joined.select("key", F.explode(pair).alias("pair"), "fp")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["key", "pair"]):
            fp = rows.column("fp").to_numpy().view(np.uint64)
            cut = bounds(rows, ["key", "pair"])
            size = np.diff(cut)
            two = cut[:-1][size == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            found = [(fp[near + 1], fp[near])] + [forest(fp[a:b], radius) for a, b in zip(cut[:-1][size > 2], cut[1:][size > 2])]
            a, b = (np.concatenate([x[k] for x in found]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    edges = dealt.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(verify, "a long, b long")
    return edges.distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the component's smallest node.

    Large-star then small-star, each round written to the shared folder, until only stars are left. A star's neighbours are
    reduced to their minimum by a partial aggregate and joined back, never gathered.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = stored(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        # Large star: neighbours above a node hang on its smallest neighbour (or itself). The minima are stored, so that
        # both sides of the join are plain exchanges and Spark can split the node that a large group hangs on.
        low = stored(both(edges).groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("b"), F.least("u", "v").alias("m")), "links")
        large = edges.join(low, "b").select("a", F.col("m").alias("b")).distinct()
        # Small star: neighbours below a node, and the node, hang on the smallest of them.
        large = stored(large, "links")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "links")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        edges = stored(small, "links")
        # Done once these are stars: each node hangs on one other, and nothing hangs on a node that hangs itself.
        n, hung = edges.agg(F.count("*"), F.count_distinct("a")).collect()[0]
        if n == hung and edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links of `radius` bits or fewer.

    Null, empty and blank texts have fingerprint zero, linked like any other. Repeated rows pass through, a row each. A
    null doc_id takes part in links, but is no component's id unless all ids in it are null. An empty table gives an
    empty result. Other columns are not read. Fingerprints are exact for texts of any length.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    # The minima are stored, so that both sides of the join are plain exchanges and Spark can split a giant component.
    rooted = stored(rooted, "rooted-fingerprints")
    low = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "component-ids")
    of_fp = rooted.join(low, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- links by shingle similarity, for what lies beyond the radius that Golay keys reach

TABLES, MINIMA = 8, 3
_MUL = np.array([(0x9E3779B97F4A7C15 * (2 * k + 3) ^ (k << 40)) & 0xFFFFFFFFFFFFFFFF | 1 for k in range(TABLES * MINIMA)], dtype=np.uint64)
#: A key with more nodes than this is dealt out in blocks of so many, each pair of blocks a group of its own.
NEARBY = 1024
#: Members of a group whose links are looked for at once, before what they reach is set aside.
CLOSEST = 3


def minimum_keys(h: np.ndarray) -> bytes:
    """TABLES keys, each of MINIMA minima of the hashes under different multipliers; nothing for no hashes.

    Two texts of similarity 0.8 share a given key with probability 0.51 and none of the eight with 0.003.
    """
    if not len(h):
        return b""
    low = np.array([((h * m) ^ ((h * m) >> np.uint64(29))).min() for m in _MUL], dtype=np.uint64).reshape(TABLES, MINIMA)
    key = low[:, 0]
    for k in range(1, MINIMA):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + low[:, k]
    return (key ^ np.arange(TABLES, dtype=np.uint64)).tobytes()


def candidate_groups(nodes: DataFrame, block: int = NEARBY) -> DataFrame:
    """(group, node): members of groups that are to be compared. nodes: node, root, keys.

    Nodes of one root (fingerprints linked by Golay keys) are a group, and so are those that share a minimum key if they
    have two roots or more. Groups stand for their pairs, so rows grow with a group and not with its square (beyond a
    block: with its blocks); every two members of a key are together in some group. Groups of equal members are one.
    """
    minima = F.transform(F.sequence(F.lit(0), F.lit(TABLES - 1)), lambda k: F.substring("keys", k * 8 + 1, F.lit(8)))
    linked = F.array(F.unhex(F.concat(F.lit("47"), F.lpad(F.hex("root"), 16, "0"))))  # nine bytes, minima have eight
    every = F.explode(F.array_distinct(F.when(F.length("keys") > 0, F.concat(linked, minima)).otherwise(linked)))
    keyed = nodes.select(every.alias("key"), "node", "root")
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    hot = stored(hot.select("key", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("parts")), "simhash-hot")
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    pair = F.when(F.col("parts") > 1, F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, F.col("own")) * F.col("parts") + F.greatest(o, F.col("own")))).otherwise(F.array(F.lit(0)))
    dealt = keyed.join(hot, "key", "left").withColumn("own", own).select("key", F.explode(pair).alias("pair"), "node", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for rows in whole_groups(batches, ["key", "pair"]):
            cut = bounds(rows, ["key", "pair"])
            size = np.diff(cut)
            node, root, key = rows.column("node").to_numpy(), rows.column("root").to_numpy(), rows.column("key")
            group, at = [], []
            for lo, hi in zip(cut[:-1][size > 1], cut[1:][size > 1]):
                if (root[lo:hi] != root[lo]).any() or len(key[int(lo)].as_py()) == 9:
                    order = lo + np.argsort(node[lo:hi])
                    at.append(order)
                    group.append(np.full(hi - lo, xxhash.xxh64_intdigest(node[order].tobytes()), np.uint64).view(np.int64))
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(group)), pa.array(node[np.concatenate(at)])], names=["group", "node"])

    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(run, "group long, node long").distinct()


def alike(sets: list[np.ndarray], roots: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (row numbers) of the components that pairs of sets of `similarity` or more make, beyond those of equal roots.

    Breadth-first over an inverted index: every two sets are compared or already in one component.
    """
    size = np.array([len(x) for x in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True)) if size.min() >= similarity * size.max() else 0
        return [(0, 1)] if both > 0 and both >= similarity * (size.sum() - both) else []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    _, part = np.unique(roots, return_inverse=True)
    left, live, out = np.ones(len(sets), bool), len(sets), []
    while left.any():
        front = np.flatnonzero(part == part[left.argmax()])
        left[front] = False
        while len(front) and left.any():
            some, front = front[:CLOSEST], front[CLOSEST:]
            if 2 * left.sum() < live:
                keep, live = left[owner], left.sum()
                flat, owner = flat[keep], owner[keep]
            for x in some:
                lo, n = np.searchsorted(flat, sets[x]), np.searchsorted(flat, sets[x], "right")
                n -= lo
                both = np.bincount(owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(sets))
                hit = left & (both > 0) & (both >= similarity * (size[x] + size - both))
                if hit.any():
                    out += [(int(x), int(y)) for y in np.flatnonzero(hit)]
                    more = np.flatnonzero(left & np.isin(part, part[hit]))
                    left[more] = False
                    front = np.concatenate((front, more))
    return out


def wrapped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(i, h, row): id, text hash, and the whole row as one struct, so that no column name of docs can clash."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.xxhash64(f"`{text_col}`", F.lit(1)).alias("h"), row.alias("row"))


def at_key(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """rows joined with keys on (i, h), null ids too. The keys are the hashed side: rows with texts are never sorted."""
    keys = keys.withColumnRenamed("i", "_i").withColumnRenamed("h", "_h").hint("shuffle_hash")
    return rows.join(keys, rows["i"].eqNullSafe(keys["_i"]) & (rows["h"] == keys["_h"]), how).drop("_i", "_h")


def marked(texts_: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of texts_ (i, h, text) that may be among asked (i, h), picked by a map at the scan: others are not shuffled."""
    place = F.xxhash64("i", "h")
    asked_map = BitMap(asked.select(place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(asked_map.has(batch.column(3).to_numpy(zero_copy_only=False)))).select(["i", "h", "text"])

    return texts_.select("i", "h", "text", place.alias("p")).mapInArrow(run, "i long, h long, text string")


def similar_links(texts_: DataFrame, nodes: DataFrame, groups: DataFrame, shingle: int, similarity: float, repeated: bool) -> DataFrame:
    """Links (a, b) of the components that pairs within a group make whose shingle sets have a Jaccard similarity of `similarity` or more.

    texts_: i, h, text; nodes: node, i, h of the row that stands for it; groups: group, node; repeated: whether rows alike
    in id and text exist. Only those rows' texts are read.
    """
    asked = stored(groups.select("node").distinct().join(nodes, "node").select("node", "i", "h"), "asked")
    found = at_key(marked(texts_, asked), asked, "inner").select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(shingle_hashes(t, shingle)).tobytes() for t in texts(batch.column(1))], pa.binary())], names=["node", "shingles"])

    held = found.mapInArrow(sets, "node long, shingles binary")
    held = stored(held.dropDuplicates(["node"]) if repeated else held, "shingle-sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["group"], 500):
            node = rows.column("node").to_numpy()
            cut, of = bounds(rows, ["group"]), rows.column("shingles")
            for lo, hi in zip(cut, cut[1:]):
                found = alike([np.frombuffer(x, np.uint64) for x in of.slice(lo, hi - lo).to_pylist()], np.arange(hi - lo), similarity) if hi - lo > 1 else []
                if found:
                    at = np.array(found) + lo
                    yield pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(node[at[:, 1]])], names=["a", "b"])

    both = held.join(groups.hint("shuffle_hash"), "node").select("group", "node", "shingles")
    return both.repartition("group").sortWithinPartitions("group").mapInArrow(verify, "a long, b long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = RADIUS, similarity: float = 0.8, block: int = NEARBY) -> DataFrame:
    """The rows of docs, all columns as they are, that stand for their group of near-duplicates: the smallest id, then the
    smallest text hash, null ids last; of rows alike in id and text any one.

    Groups are components over pairs of texts whose sets of shingles have a Jaccard similarity of `similarity` or more.
    Texts that Golay keys link within `radius` bits are compared; so are those that share a key of hash minima, as pairs
    of 0.8 may differ in ten bits and more, which no code of this length reaches (all but three in a thousand share one;
    see README). Every two texts of such a group, of any size, are compared by their sets or already in one component.
    Texts of equal sets are one node, so null, empty and blank texts are one group. Fingerprints are those of the sets: a
    line counts once however often it is repeated. An empty table gives an empty result.
    """
    rows = wrapped(docs, id_col, text_col)
    base = rows.select("i", "h", F.col("row")[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                fp, keys, node = [], [], []
                for t in texts(batch.column(2)):
                    once = np.unique(shingle_hashes(t, shingle))
                    fp.append(folded(once))
                    keys.append(minimum_keys(once))
                    node.append(xxhash.xxh64_intdigest(once.tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, node)), pa.array(keys, pa.binary())], names=["i", "h", "fp", "node", "keys"])

    prints = stored(base.mapInArrow(run, "i long, h long, fp long, node long, keys binary"), "fingerprints")
    again = stored(prints.groupBy("i", "h").agg(F.count("*").alias("n")).filter("n > 1").select("i", "h"), "repeated-rows")
    repeated = not again.isEmpty()
    first = F.min(F.struct(F.col("i").isNull().alias("none"), "i", "h")).alias("first")
    nodes = prints.groupBy("node").agg(F.min("fp").alias("fp"), F.min("keys").alias("keys"), first)
    nodes = stored(nodes.select("node", "fp", "keys", "first.i", "first.h"), "distinct-sets")
    linked = components(links(nodes.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    rooted = nodes.join(linked, "fp", "left").select("node", F.coalesce("root", "fp").alias("root"), "keys")
    groups = stored(candidate_groups(rooted, block), "candidates")
    roots = components(similar_links(base, nodes.select("node", "i", "h"), groups, shingle, similarity, repeated))
    first = F.min(F.struct(F.col("i").isNull().alias("none"), "i", "h")).alias("first")
    stay = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(first)
    kept = at_key(rows, stored(stay.select("first.i", "first.h"), "stay"), "left_semi")
    if repeated:  # rows alike in id and text lie apart; the others need no second exchange
        kept = at_key(kept, again, "left_anti").unionByName(at_key(kept, again, "left_semi").dropDuplicates(["i", "h"]))
    return kept.select("row.*")
