"""SimHash near-duplicates by BK-trees.

Fingerprints within ``radius`` bits agree on at least two of radius + 2 bands, so they meet in at least one of the shards
keyed by two bands. The rows of a shard form BK-trees of at most ``TREE`` fingerprints; a larger shard has
several trees, its queries are cut the same way, and each tree goes to every cut of them, so a task never holds
more than two cuts however hot a shard is. A task returns links that hold its groups together, not all it finds;
components over these are the components over all links. Where links are verified afterwards this is not enough:
``keep_one_of_each`` also deals the sets of shingles to shards by the members of their prefixes. A first round takes from each shard no
more pairs than join its members, a second one all pairs that may be similar and are still apart. Parity sketches, whose bits
differ in no more places than the sets do, keep other pairs back inside the shards, so a family of pages that are not similar sends none.

Fingerprints are compared once each, however many documents share them. Iterations write their tables to the shared folder.

Defined results: a null text, an empty one or one without words has fingerprint 0 and links like any other; fewer words than
a shingle are one shingle; repeated rows have a line each; rows without key have a line, and no component takes its name from
them; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.bk_forest import Forest, Joined
from docketry.llm.common import releasing, stored, texts_of, whole_groups

SEED = 42
TREE = 1024
#: Shingles are counted in one of so many texts; those that at least COMMON of these share, at most MOST_COMMON, come last in the prefixes.
SAMPLE, COMMON, MOST_COMMON = 64, 4, 65_536
#: Bits of a sketch: at least twice the size of the set, within these limits.
SKETCH_BITS = (64, 8192)
#: Words of sketches that are compared at once.
SKETCH_WORDS = 4_000_000


def bit_majority(digests: bytes) -> int:
    """Fingerprint whose bits are set in more than half of the 8-byte digests."""
    n = len(digests) // 8
    rows = np.frombuffer(digests, np.uint8).reshape(n, 8)
    total = np.zeros(64, np.int64)
    for start in range(0, n, 65_536):
        bits = np.unpackbits(rows[start:start + 65_536], axis=1)
        whole = len(bits) // 255 * 255
        total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprint(text: str, words: int) -> int:
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    digest = xxhash.xxh64_digest
    return bit_majority(b"".join([digest(x, SEED) for x in shingles]))


def _printer(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(text, words) for text in batch.column("text").to_pylist()], np.uint64)
            kept = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(prints.view(np.int64))], [*kept, "fp"])
    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row."""
    return texts_of(docs).mapInArrow(releasing(_printer(words)), "doc_id long, fp long")


def band_masks(radius: int) -> list[int]:
    """Masks of all choices of two from radius + 2 bands; 64 bits are split as evenly as may be."""
    bands = radius + 2
    borders = [64 * i // bands for i in range(bands + 1)]
    parts = [((1 << (end - start)) - 1) << start for start, end in zip(borders, borders[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, 2)]


def _linker(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "shard"):
            shard = table.column("shard").to_numpy()
            prints = table.column("fp").to_numpy().view(np.uint64)
            member = table.column("member").to_numpy()
            trees = np.flatnonzero(member)
            asking = np.flatnonzero(table.column("query").to_numpy())
            if not len(trees) or not len(asking):
                continue
            names, number = np.unique(shard[trees], return_inverse=True)
            own = np.searchsorted(names, shard[asking])
            known = (own < len(names)) & (names[np.minimum(own, len(names) - 1)] == shard[asking])
            asking, own = asking[known], own[known]
            forest = Forest(prints[trees], number)
            sets = Joined(len(prints))
            for a, b, distance in forest.within(prints[asking], own, radius):
                sets.add(asking[a], trees[b], distance)
            a, b = (prints[x].view(np.int64) for x in sets.pairs())
            apart = a != b
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[apart]), pa.array(np.minimum(a, b)[apart])], ["a", "b"])
    return link


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) between different fingerprints that connect all that lie within ``radius`` bits of each other.

    ``prints``: distinct fingerprints in the column fp.
    """
    masks = F.array(*[F.lit(mask - (1 << 64) if mask >> 63 else mask) for mask in band_masks(radius)])
    banded = prints.select("fp", F.posexplode(masks).alias("band", "mask")).select("fp", F.xxhash64("band", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    # only shards of several trees need their number; stored, so that Spark knows how few they are when it plans the join
    large = stored(banded.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > TREE).select("key", F.ceil(F.col("n") / TREE).cast("int").alias("cuts")), "large-shards")
    cut = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("cuts")).cast("int")
    # a cut's tree (t) meets the queries of its own cut and of the later ones (q)
    shared = banded.join(large, "key", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("cut", cut) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))) \
        .select("fp", "key", F.least("cut", "other").alias("t"), F.greatest("cut", "other").alias("q"), "cut") \
        .select("fp", F.xxhash64("key", "t", "q").alias("shard"), (F.col("cut") == F.col("t")).alias("member"), (F.col("cut") == F.col("q")).alias("query"))
    return shared.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(releasing(_linker(radius)), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and the least node of its component, by alternating large and small stars until nothing changes."""
    now = stored(edges, "links")
    state = None
    while True:
        # large star: every neighbour above a node is tied to the least of the node and its neighbours
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its lesser neighbours are tied to the least of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b"))) \
            .filter("a <> b").distinct()
        now = stored(small, "stars")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return now.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = new


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the least doc_id that can be reached."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    firsts = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(firsts.select("fp"), radius))
    classes = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    names = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(classes.join(names, "root").select("fp", "component_id"), "fingerprint-classes")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str, words: int) -> np.ndarray:
    """Digests of the text's distinct shingles, in ascending order."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    parts = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in parts), np.uint64))


def set_key(shingles: np.ndarray) -> int:
    """Signed key of a set of shingles: equal sets are one node, whatever their texts."""
    return int.from_bytes(hashlib.sha256(shingles.tobytes()).digest()[:8], "little", signed=True)


def _sampler(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, words) for text in batch.column("text").to_pylist()]
            nodes = np.repeat(np.array([set_key(x) for x in sets], np.int64), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))], ["node", "token"])
    return run


def common_shingles(read: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many sets share, ascending, and about how many sets do, from one of ``SAMPLE`` texts.

    They only order the prefixes and say which shingles need no count to be known as shared: any values give the same pairs.
    """
    sample = read.filter(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(SAMPLE)) == 0).mapInArrow(releasing(_sampler(words)), "node long, token long")
    counted = sample.distinct().groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "token").limit(MOST_COMMON)
    found = counted.toArrow()
    tokens, n = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy() * SAMPLE
    order = np.argsort(tokens)
    return tokens[order], n[order]


def needed_in_prefix(size: int, least: float) -> int:
    """Of two sets as similar as ``least`` each has a common member among its first so many, in any order of all members."""
    return size - max(1, ceil(least * size - 1e-9)) + 1


def sketch(shingles: np.ndarray) -> bytes:
    """For each residue of the digests, whether an odd number of the set's members has it.

    Two sketches differ in no more bits than the sets in members; folding a longer one in half gives that of half as many bits.
    """
    bits = min(max(SKETCH_BITS[0], 1 << (2 * len(shingles) - 1).bit_length()), SKETCH_BITS[1])
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _describer(words: int, shingle: int, least: float, common: np.ndarray, frequency: np.ndarray):
    """Digest, fingerprint, key, size and sketch of the set of shingles, and the set's prefix: rare shingles first, then the common ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, prints, nodes, sizes, sketches, prefixes = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, shingle)
                digests.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
                prints.append(fingerprint(text, words))
                nodes.append(set_key(found))
                sizes.append(len(found))
                sketches.append(sketch(found))
                if len(common):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    found = found[np.lexsort((found, np.where(common[at] == found, frequency[at], 0)))]
                prefixes.append(found[:needed_in_prefix(len(found), least)].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(nodes, pa.int64()),
                 pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(prefixes, pa.binary())],
                ["doc_id", "digest", "fp", "node", "size", "sketch", "prefix"])
    return run


def _dealer(common: np.ndarray):
    """A row for each member of a prefix: the node, its size and the member's place in one number, and whether the member is known as common."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("prefix")]
            lengths = np.array([len(x) for x in prefixes], np.int64)
            tokens = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            node, size = (batch.column(x).to_numpy().astype(np.int64) for x in ("node", "size"))
            for start in range(0, len(tokens), 65_536):
                part = slice(start, start + 65_536)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (tokens[part].view(np.int64), node[row[part]], size[row[part]] << 31 | place[part], np.isin(tokens[part], common))],
                    ["token", "node", "value", "known"])
    return run


def _twins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token those whose token another row has too."""
    held, held_twin = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens = batch.column("token").to_numpy()
        same = np.concatenate([[held is not None and held.column("token")[0].as_py() == tokens[0]], tokens[1:] == tokens[:-1]])
        if held is not None and (same[0] or held_twin):
            yield held
        twin = same[:-1] | same[1:]
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(twin))
        held, held_twin = batch.slice(batch.num_rows - 1), bool(same[-1])
    if held is not None and held_twin:
        yield held


def shared_tokens(nodes: DataFrame, common: np.ndarray) -> DataFrame:
    """token, node, value of every member of a prefix that may stand in another prefix as well. ``nodes``: node, size, prefix."""
    dealt = nodes.mapInArrow(releasing(_dealer(common)), "token long, node long, value long, known boolean")
    # common members need no count, and are too many for one task
    rare = dealt.filter("not known").drop("known").repartition("token").sortWithinPartitions("token").mapInArrow(_twins, "token long, node long, value long")
    return rare.union(dealt.filter("known").drop("known"))


class Sketches:
    """Sketches of different lengths in one array of words."""

    def __init__(self, column: pa.ChunkedArray):
        data = [x.as_buffer() for x in column]
        self.words = np.frombuffer(b"".join(data), np.uint64)
        self.length = np.array([len(x) // 8 for x in data], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of differing bits of the sketches of rows a and b, the longer one folded."""
        out = np.zeros(len(a), np.int64)
        long_a, long_b = self.length[a], self.length[b]
        for one, two in set(zip(long_a.tolist(), long_b.tolist(), strict=True)):
            least = min(one, two)
            at = np.flatnonzero((long_a == one) & (long_b == two))
            for part in np.array_split(at, -(-len(at) * max(one, two) // SKETCH_WORDS)):
                left, right = (
                    np.bitwise_xor.reduce(self.words[self.start[rows][:, None] + np.arange(n)].reshape(len(rows), n // least, least), axis=1)
                    for rows, n in ((a[part], one), (b[part], two)))
                out[part] = np.bitwise_count(left ^ right).sum(axis=1)
        return out


def _pairer(least: float, joining: bool):
    """Pairs of a shard that may be as similar as ``least`` and whose roots differ: length, places of the shared member, sketches.

    ``joining``: only pairs that join the rows of a shard, nearer ones first. Otherwise all, and with each pair the number of
    shared members seen (n) and the number that their prefixes must share (least): the rest of the sets is too small to make up for fewer.
    """
    share = least / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "shard"):
            shard, node, root, value = (table.column(x).to_numpy() for x in ("shard", "node", "root", "value"))
            twin = np.concatenate([shard[1:] == shard[:-1], [False]])
            if not twin.any():
                continue
            size, place = value >> 31, value & 0x7FFFFFFF
            member, query = (table.column(x).to_numpy(zero_copy_only=False) for x in ("member", "query"))
            sketches, sets = Sketches(table.column("sketch")), Joined(len(shard))
            low, step, held, n_held = np.flatnonzero(twin), 1, [], 0
            while len(low):
                high = low + step
                inside = high < len(shard)
                low, high = low[inside], high[inside]
                # rows of a shard are in order of size: where the length filter ends a row, it ends it for good
                going = (shard[low] == shard[high]) & (size[low] + 1e-6 >= least * size[high])
                low, high = low[going], high[going]
                needed = np.ceil(share * (size[low] + size[high]) - 1e-6)
                most = np.minimum(place[low], place[high]) + 1 + np.minimum(size[low] - place[low], size[high] - place[high]) - 1
                good = np.flatnonzero((root[low] != root[high]) & (most >= needed) & (member[low] & query[high] | member[high] & query[low]))
                if joining:
                    good = good[sets.label[low[good]] != sets.label[high[good]]]
                distance = sketches.apart(low[good], high[good])
                near = distance <= size[low[good]] + size[high[good]] - 2 * needed[good]
                good, distance = good[near], distance[near]
                if joining:
                    sets.add(low[good], high[good], distance)
                elif len(good):
                    a, b, x, y = node[low[good]], node[high[good]], size[low[good]], size[high[good]]
                    beyond = np.maximum(np.ceil(least * x - 1e-9), np.ceil(least * y - 1e-9)).astype(np.int64) - 1
                    held.append(np.stack([np.maximum(a, b), np.minimum(a, b), needed[good].astype(np.int64) - beyond], axis=1))
                    n_held += len(a)
                if n_held > 200_000:
                    yield _counted_pairs(held)
                    held, n_held = [], 0
                step += 1
            if joining and sets.kept:
                a, b = (node[x] for x in sets.pairs())
                held.append(np.stack([np.maximum(a, b), np.minimum(a, b), np.zeros_like(a)], axis=1))
            if held:
                yield _counted_pairs(held)
    return run


def _counted_pairs(held: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.concatenate(held)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    first = np.flatnonzero(np.concatenate([[True], (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)]))
    n = np.diff(np.append(first, len(pairs)))
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(pairs[first, i])) for i in range(3)), pa.array(n)], ["a", "b", "least", "n"])


def shared_prefix_pairs(tokens: DataFrame, nodes: DataFrame, least: float, joining: bool) -> DataFrame:
    """Pairs (a, b) of nodes with different roots that may be as similar as ``least``: all of them, or such that join those of a shard.

    ``tokens``: see ``shared_tokens``; ``nodes``: node, root, sketch. A token of many nodes is cut, and its cuts meet in pairs.
    """
    large = stored(tokens.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > TREE).select(F.col("token").alias("key"), F.ceil(F.col("n") / TREE).cast("int").alias("cuts")), "large-tokens")
    cut = F.pmod(F.xxhash64("node", F.lit(1)), F.col("cuts")).cast("int")
    shared = tokens.join(large, tokens.token == large.key, "left").drop("key").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("cut", cut) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))) \
        .withColumn("t", F.least("cut", "other")).withColumn("q", F.greatest("cut", "other")) \
        .select("node", "value", F.when(F.col("cuts") == 1, F.col("token")).otherwise(F.xxhash64("token", "t", "q")).alias("shard"),
                (F.col("cut") == F.col("t")).alias("member"), (F.col("cut") == F.col("q")).alias("query"))
    rows = shared.join(nodes.select("node", "root", "sketch"), "node")
    pairs = rows.repartition("shard").sortWithinPartitions("shard", "value").mapInArrow(releasing(_pairer(least, joining)), "a long, b long, least long, n long")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("least").alias("least")).filter("n >= least").select("a", "b")


def _set_maker(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, words) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])
    return run


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                one, two = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                good.append(shared >= least * (len(one) + len(two) - shared))
            chosen = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column("a"), chosen.column("b")], ["a", "b"])
    return run


def similar_pairs(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets of word shingles have a Jaccard similarity of ``least`` or more.

    ``nodes``: node and doc_id, the key of a text that has this set.
    """
    asked = stored(nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "node", "left_semi").select("node", "doc_id"), "asked")
    # the keys asked for grow with the documents, so nothing bounds a broadcast of them
    made = docs.join(asked.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").mapInArrow(releasing(_set_maker(words)), "node long, shingles binary")
    # a key may have several texts, and a text several rows
    sets = stored(made.join(asked.select("node"), "node", "left_semi").dropDuplicates(["node"]), "shingles")
    left, right = (sets.select(F.col("node").alias(key), F.col("shingles").alias(side)) for key, side in (("a", "left"), ("b", "right")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(releasing(_similar(least)), "a long, b long")


def keep_one_of_each(docs: DataFrame, words: int = 2, radius: int = 3, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows, with all their columns, that remain if of each group of near-duplicates the one with the least key stays.

    Equal texts are duplicates. Different texts are near-duplicates if their sets of five-word shingles have a similarity of 0.8 or
    more. Texts with one set are one node. Fingerprints over two words within three bits and pairs that join the nodes of a shard are
    verified on the sets; then all pairs of nodes that are not yet joined, share a member of their prefixes and have sketches
    near enough are verified, which no pair that similar can escape. Rows without key stay; texts that share a key are told apart by
    their digests, the least of which counts as the first.
    """
    read = texts_of(docs)
    keyed = read.filter("doc_id is not null")
    common, frequency = common_shingles(keyed, shingle)
    prints = stored(keyed.mapInArrow(releasing(_describer(words, shingle, least, common, frequency)),
                                     "doc_id long, digest binary, fp long, node long, size int, sketch binary, prefix binary"), "fingerprints")
    same_set = [F.min(F.struct("doc_id", "digest")).alias("first"), F.min("fp").alias("fp"), *(F.first(x).alias(x) for x in ("size", "sketch", "prefix"))]
    nodes = stored(prints.groupBy("node").agg(*same_set).select("node", "first", "first.doc_id", "fp", "size", "sketch", "prefix"), "nodes")
    firsts = stored(nodes.groupBy("fp").agg(F.min("node").alias("first_node")), "distinct-fingerprints")
    same = nodes.select("node", "fp").join(firsts, "fp").filter("node <> first_node").select(F.col("node").alias("x"), F.col("first_node").alias("y"))
    near = links(firsts.select("fp"), radius)
    for side, name in (("a", "x"), ("b", "y")):
        near = near.join(firsts.select(F.col("fp").alias(side), F.col("first_node").alias(name)), side)
    linked = same.union(near.select("x", "y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    tokens = stored(shared_tokens(nodes, common), "shared-shingles")
    joining = shared_prefix_pairs(tokens, nodes.withColumn("root", F.col("node")), least, True)
    edges = stored(similar_pairs(keyed, nodes, stored(linked.union(joining).distinct(), "candidates"), shingle, least), "verified")
    open_nodes = nodes.join(components(edges), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "sketch")
    rest = stored(shared_prefix_pairs(tokens, open_nodes, least, False), "rest-candidates")
    edges = stored(edges.union(similar_pairs(keyed, nodes, rest, shingle, least)), "verified-all")
    named = nodes.select("node", "first").join(components(edges), "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    staying = named.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.digest")
    rows_of = stored(prints.groupBy("doc_id", "digest").agg(F.count("*").alias("n")), "texts")
    # what goes is less than what stays, so the texts meet the smaller table
    gone = stored(rows_of.join(staying, ["doc_id", "digest"], "left_anti").select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")), "gone")
    rows = docs.filter(F.col("doc_id").isNotNull())
    same_key = F.col("doc_id").cast("long") == F.col("gone_id")
    if rows_of.groupBy("doc_id").agg(F.sum("n").alias("n")).filter("n > 1").isEmpty():
        rows = rows.join(gone, same_key, "left_anti")
    else:
        own = rows.withColumn("own_digest", F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)))
        rows = own.join(gone, same_key & (F.col("own_digest") == F.col("gone_digest")), "left_anti").dropDuplicates(["doc_id", "own_digest"]).drop("own_digest")
    return rows.unionByName(docs.filter(F.col("doc_id").isNull()))
