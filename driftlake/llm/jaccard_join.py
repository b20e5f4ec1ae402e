"""N-gram Jaccard self-join: a MinHash LSH forest, then exact verification.

1. Each document gives its set of five-word shingles (hashed; a text of fewer
   words is one shingle), a hash of the whole set and a MinHash signature.
   Documents with equal sets form one class, so copies are never compared.
2. Forest. A signature is cut into ``TREES`` sequences of ``DEPTH`` labels. The classes
   that share the shortest prefix ever needed form a node; a node's rows are sorted
   by label after label, which makes the prefix trie, and its prefixes are shortened
   step by step from the whole sequence. At each length, leaders are taken in order;
   a class is tied to each leader whose estimated similarity is at least ``LINK`` and
   leaves at ``LEAVE``. By the triangle inequality of Jaccard distance two classes
   similar by 0.8 are then tied to a common leader. A union-find in the node leaves
   one edge for each class that is joined, with the prefix length that joined it.
3. How far prefixes are shortened is told by the links that were matched
   (``reached_depth``): the longest prefix at which those near the threshold are found
   with the target recall; where none tells, the length at which a pair at the
   threshold meets often enough whatever the data.
4. Nodes of more than ``PART`` classes are dealt out, by another hash in each tree.
   Their leaders meet again and are tied from ``LOOSE`` on (at most 0.3 + 0.2 + 0.3
   apart, so 0.2 similar); those that still don't fit one part are tied all together.
5. Connected candidates (alternating large-star and small-star rounds, each
   written to the shared folder) hold every link that the forest found.
6. Exact verification inside each candidate group. Sets travel as their difference
   from the group's first set, short for near copies; groups are cut by set size, as
   only sizes within the threshold can be similar, and in blocks. A pair of blocks is
   one run of rows, whose intersections are counted by matrix products. It gives
   link counts and one spanning edge a class, never pairs.

Nothing is collected on the driver but one row of counts, and no node, group or copy
class is capped.

Defined cases: null text is empty; empty texts have no shingles, are in a class of
their own and have no links; rows with null id take no part (null class, 0 links);
rows that share an id are separate rows with that id, and their classes are told
apart by ``class_key``, not by ``class_id``; repeated rows are copies; a class takes
the smallest id on a tie; a very long text is one set of hashes in memory; an empty
table gives an empty frame; other columns take no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlake.llm.common import SPACE_WORDS, buffers, gram_hashes, gram_prefix, materialize, mix, runs, slices, table, text_key, word_hashes, words

SHINGLE = 5
TREES = 16
DEPTH = 6
RECALL = 0.999
#: Estimates of similarity at which a class is tied to a leader, leaves to it, and at which leaders of parts are tied.
LINK, LEAVE, LOOSE = 0.35, 0.7, 0.05
#: Links up to this much above the threshold tell how far prefixes are shortened.
NEAR = 0.1
PART = 2000
BLOCK_ROWS = 400
BLOCK_IDS = 1_000_000
MOST_BLOCKS = 1 << 40
_SEEDS = np.random.default_rng(5).integers(1, 1 << 62, (2, TREES * DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_depth(threshold: float, recall: float) -> int:
    """The longest prefix by which pairs at the threshold meet in some tree often enough."""
    for depth in range(DEPTH, 1, -1):
        if 1 - (1 - threshold**depth) ** TREES >= recall:
            return depth
    return 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct shingle hashes of each text, and its number of words."""
    starts, ends, first = words(data, offsets, SPACE_WORDS)
    h = word_hashes(data, starts, ends)
    grams = gram_hashes(h, k)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(grams[lo : hi - k + 1]))
        else:
            own = h[lo:hi]
            out.append(mix(gram_prefix(own)[-1:] + np.uint64(hi - lo)) if hi > lo else np.zeros(0, np.uint64))
    return out, np.diff(first)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x TREES*DEPTH) MinHash labels; a set must not be empty."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), TREES * DEPTH), np.uint32)
    for i in range(TREES * DEPTH):
        out[:, i] = np.minimum.reduceat(((flat * _SEEDS[0, i] + _SEEDS[1, i]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def set_rows(ids: DataFrame) -> DataFrame:
    """(doc, th, s1, s2, sig) for rows (doc, th, text); texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = buffers(batch.column(2))
            for lo, hi in slices(offsets):
                sets, size = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                keep = np.flatnonzero(size)
                sets = [sets[i] for i in keep]
                if not sets:
                    continue
                s1 = np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets], np.uint64).view(np.int64)
                s2 = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(0x632BE59BD9B4E019))) for s in sets], np.uint64).view(np.int64)
                sig = signatures(sets)
                arrays = [pa.array(doc[keep + lo]), pa.array(th[keep + lo]), pa.array(s1), pa.array(s2), pa.array([r.tobytes() for r in sig], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc", "th", "s1", "s2", "sig"])

    return ids.mapInArrow(run, "doc long, th long, s1 long, s2 long, sig binary")


def _keys(classes: DataFrame, depth: int) -> DataFrame:
    """(rep, tree, key): the prefixes of each class down to the shortest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, TREES, DEPTH)
            key = np.zeros((n, TREES), np.uint64)
            for d in range(depth):
                key = mix(key * np.uint64(31) + sig[:, :, d].astype(np.uint64) + np.uint64(1))
            rep = np.repeat(batch.column(0).to_numpy(), TREES)
            tree = np.tile(np.arange(TREES, dtype=np.int32), n)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(tree), pa.array(key.ravel().view(np.int64))], ["rep", "tree", "key"])

    return classes.select("rep", "sig").mapInArrow(run, "rep long, tree int, key long")


class Forest:
    """Joins the members of one prefix tree's node; a union-find keeps one edge for each class that is joined."""

    def __init__(self, rep: np.ndarray, sig: np.ndarray, tree: int):
        labels = sig.reshape(len(rep), TREES, DEPTH)[:, tree]
        order = np.lexsort((rep, *labels.T[::-1]))  # the trie: sorted by label after label
        self.rep, self.sig = rep[order], sig[order]
        labels = labels[order]
        #: length of the prefix that each row shares with the row before
        self.shared = np.concatenate([[-1], np.cumprod(labels[1:] == labels[:-1], axis=1).sum(1)])
        self.root = np.arange(len(rep))
        self.edges: list[tuple[int, int, int, float]] = []

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def node(self, at: np.ndarray, depth: int, link: float) -> list[int]:
        """Ties the rows of one node to their leaders; returns the leaders."""
        leaders = []
        while len(at):
            leader = at[0]
            leaders.append(int(leader))
            like = (self.sig[at] == self.sig[leader]).mean(1)
            for i in np.flatnonzero(like >= link)[1:]:
                x, y = self.find(int(at[i])), self.find(int(leader))
                if x != y:
                    self.root[max(x, y)] = min(x, y)
                    self.edges.append((int(at[i]), int(leader), depth, float(like[i])))
            at = at[(like < LEAVE) & (at != leader)]
        return leaders

    def shorten(self, least: int, link: float) -> list[int]:
        """Goes from whole prefixes to the shortest; returns the leaders of the node of the shortest."""
        n, leaders, before = len(self.rep), [0], None
        for depth in range(DEPTH, least - 1, -1):
            edge = np.append(np.flatnonzero(self.shared < depth), n)
            known = set() if before is None else set(zip(before[:-1].tolist(), before[1:].tolist(), strict=True))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if hi - lo > 1 and (lo, hi) not in known:
                    found = self.node(np.arange(lo, hi), depth, link)
                    if hi - lo == n:
                        leaders = found
            before = edge
        return leaders


def _node_edges(least: int, link: float):
    """Edges (a, b) of parts of nodes; rows with a = b are leaders of nodes that were dealt out in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out = ["tree", "key", "a", "b", "depth", "alike"], []

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names)
            out.clear()
            return made

        for part in runs(batches, 3):
            tree, key = part.column(0)[0].as_py(), part.column(1)[0].as_py()
            split = part.column(3)[0].as_py() > 1
            rep = part.column(4).to_numpy()
            forest = Forest(rep, np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint32).reshape(len(rep), -1), tree)
            leaders = forest.shorten(least, link)
            own = forest.rep
            # what a part's own leaders stand for must be joined at any depth, so it counts as matched by the whole prefix
            out += [(tree, key, int(max(own[i], own[j])), int(min(own[i], own[j])), DEPTH if split else d, s) for i, j, d, s in forest.edges]
            if split:
                out += [(tree, key, int(own[i]), int(own[i]), DEPTH, 1.0) for i in leaders]
            if len(out) > 50_000:
                yield batch_of()
        yield batch_of()

    return run


def candidate_edges(classes: DataFrame, threshold: float, recall: float, part: int) -> DataFrame:
    """Edges (a, b), a > b, between classes (rep, sig) that may be similar."""
    least = prefix_depth(threshold, recall)
    keys = _keys(classes, least)
    sig = classes.select("rep", "sig")
    parts: list[DataFrame] = []
    for link in (LINK, LOOSE):
        sizes = keys.groupBy("tree", "key").agg(F.count("*").alias("n")).where("n > 1")
        dealt = keys.join(sizes, ["tree", "key"]).withColumn("parts", F.ceil(F.col("n") / part))
        # every tree deals by its own hash, so that two classes that part in one tree can meet in another
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rep", "tree"), F.col("parts"))).join(sig, "rep").select("tree", "key", "part", "parts", "rep", "sig")
        # dealt out by all three keys: by the first two alone a hot node's parts would share a task
        dealt = dealt.repartition("tree", "key", "part").sortWithinPartitions("tree", "key", "part")
        found = materialize(dealt.mapInArrow(_node_edges(least, link), "tree int, key long, a long, b long, depth int, alike double"), "node-edges")
        parts.append(found.where("a > b").select("a", "b", "depth", "alike"))
        keys = found.where("a = b").select(F.col("a").alias("rep"), "tree", "key")
        if not keys.limit(1).count():
            break
    else:
        # leaders that still stand in several parts of a node are all tied to its smallest
        first = keys.groupBy("tree", "key").agg(F.min("rep").alias("b"))
        parts.append(keys.join(first, ["tree", "key"]).where("rep > b").select(F.col("rep").alias("a"), "b", F.lit(DEPTH).alias("depth"), F.lit(1.0).alias("alike")))
    out = reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(F.max("depth").alias("depth"), F.max("alike").alias("alike"))
    out = materialize(out, "matched-prefixes")
    out = out.where(F.col("depth") >= reached_depth(out, threshold, recall, least))
    # a class met others in up to every tree: they are tied to their smallest, and it to that one,
    # so the members of a large group bring about one edge each, not one for each tree
    smallest = F.array_min("bs")
    ties = out.groupBy("a").agg(F.collect_set("b").alias("bs"))
    ties = ties.select(F.explode(F.concat(F.array(F.struct("a", smallest.alias("b"))), F.transform("bs", lambda b: F.struct(b.alias("a"), smallest.alias("b"))))).alias("e"))
    return ties.select("e.a", "e.b").where("a > b").distinct()


def reached_depth(matched: DataFrame, threshold: float, recall: float, least: int) -> int:
    """How far prefixes are shortened: the longest one at which the links near the threshold are found often enough.

    A link of similarity s that was matched by a prefix of length d stands for 1 / (1 - (1 - s^d)^TREES)
    links, found or not; the recall reached is links found over links stood for. Where no link near
    the threshold was matched at a length, nothing is known of the recall and prefixes are shortened further."""
    near = matched.where((F.col("alike") >= threshold) & (F.col("alike") < threshold + NEAR))
    depths = list(range(DEPTH, least, -1))
    if not depths:
        return least
    stands = {d: F.when(F.col("depth") >= d, 1 / (1 - F.pow(1 - F.pow("alike", F.lit(d)), F.lit(TREES)))) for d in depths}
    row = near.agg(*[F.count(stands[d]).alias(f"n{d}") for d in depths], *[F.sum(stands[d]).alias(f"s{d}") for d in depths]).first()
    return next((d for d in depths if row[f"n{d}"] and row[f"n{d}"] / row[f"s{d}"] >= recall), least)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (a, b), a > b: root is the smallest node that is connected.

    Alternates large-star and small-star rounds until the edges are stars."""
    edges = materialize(edges, "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        edges = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def verify_block(threshold: float):
    """Counts exact links of pairs of blocks, from what each set differs by from its group's first set.

    With D(x) the difference of x's set and the first set, two sets differ by
    |D(a)| + |D(b)| - 2 |D(a) & D(b)| shingles, whatever the first set is."""
    top = int(round(threshold * 1000))

    def links(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        rep = part.column(3).to_numpy()
        rep, once = np.unique(rep, return_index=True)  # a row given twice counts once
        block, weight, size = (part.column(i).to_numpy()[once] for i in (4, 5, 6))
        column = part.column(7)
        sets = [np.frombuffer(column[i].as_buffer(), np.uint64) for i in once.tolist()]
        n = len(rep)
        own = np.array([len(x) for x in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(n), own)
        _, which, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[which] > 1
        number = np.cumsum(times > 1) - 1
        column, owner = number[which[shared]], owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        both = np.zeros((n, n), np.float32)
        last = int(number[-1]) + 1 if len(number) else 0
        for lo in range(0, last, 4096):
            wide = min(4096, last - lo)
            s = slice(*np.searchsorted(column, [lo, lo + wide]))
            m = np.zeros((n, wide), np.float32)
            m[owner[s], column[s] - lo] = 1
            both += m @ m.T
        differ = own[:, None] + own[None, :] - 2 * both.astype(np.int64)
        total = size[:, None] + size[None, :]
        # J = (total - differ) / (total + differ), in whole numbers
        link = 1000 * (total - differ) >= top * (total + differ)
        np.fill_diagonal(link, False)
        if part.column(1)[0] != part.column(2)[0]:
            link &= block[:, None] != block[None, :]
        root = np.arange(n)
        while True:  # smallest label among linked rows, until nothing changes
            low = np.minimum(root, np.where(link, root[None, :], n).min(1))
            low = low[low]
            if (low == root).all():
                break
            root = low
        return rep, link @ weight, link.sum(1), rep[root]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, n = ["rep", "links", "classes", "root"], [], 0
        for part in runs(batches, 3):
            held.append(links(part))
            n += len(held[-1][0])
            if n > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)

    return run


def differences(texts: DataFrame) -> DataFrame:
    """(group, rep, n, size, diff) for rows (group, rep, n, text, first): the shingles in one of both texts alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first = None, np.zeros(0, np.uint64)
        for batch in batches:
            groups, column = batch.column(0).to_pylist(), batch.column(4)
            data, offsets = buffers(batch.column(3))
            for lo, hi in slices(offsets):
                sets, _ = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                diffs = []
                for i in range(lo, hi):
                    if groups[i] != group:  # rows of a group follow one another
                        group = groups[i]
                        first = shingle_sets(*buffers(column.slice(i, 1)))[0][0]
                    diffs.append(np.setxor1d(sets[i - lo], first, assume_unique=True).tobytes())
                size = pa.array(np.array([len(x) for x in sets], np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(3)), size, pa.array(diffs, pa.binary())], ["group", "rep", "n", "size", "diff"])

    return texts.select("group", "rep", "n", "text", "first").mapInArrow(run, "group long, rep long, n long, size long, diff binary")


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, classes, root) for rows (group, rep, n, size, diff).

    A group of many rows is dealt out by bands of set sizes, of which only neighbours can hold
    similar sets, and each band in blocks; a row goes to the pairs of blocks it takes part in."""
    # what is reduced is written first, so that both sides of a join have a shuffle of their own, which AQE can split for a hot group
    rows = materialize(members.groupBy("group").agg(F.count("*").alias("rows")), "group-sizes")
    step = -math.log(threshold) * 1.000001
    band = F.when(F.col("rows") <= BLOCK_ROWS, F.lit(0)).otherwise(F.floor(F.log("size") / step)).cast("long")
    members = members.join(rows, "group").withColumn("band", band).drop("rows")
    counts = members.groupBy("group", "band").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.octet_length("diff")) / 8 / BLOCK_IDS)).alias("blocks"))
    beside = Window.partitionBy("group").orderBy("band")
    near = lambda f, d: F.when(f("band").over(beside) == F.col("band") + d, f("blocks").over(beside)).otherwise(0)
    counts = counts.select("group", "band", "blocks", near(F.lag, -1).alias("below"), near(F.lead, 1).alias("above"))
    own = members.join(materialize(counts, "band-sizes"), ["group", "band"])
    label = lambda d, n: F.transform(F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>")), lambda i: (F.col("band") + d) * MOST_BLOCKS + i)
    own = own.withColumn("block", F.col("band") * MOST_BLOCKS + F.pmod(F.xxhash64("rep"), F.col("blocks")))
    own = own.withColumn("other", F.explode(F.concat(label(0, "blocks"), label(-1, "below"), label(1, "above"))))
    pairs = own.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "block", "n", "size", "diff")
    # dealt out by all three keys: by the group alone a hot group's pairs of blocks would share a task
    pairs = pairs.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    return pairs.mapInArrow(verify_block(threshold), "rep long, links long, classes long, root long")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = RECALL, part: int = PART) -> DataFrame:
    """One row for each row with an id and words: ``doc``, ``th`` (hash of the text),
    ``class_id`` (smallest id connected by links), ``class_key`` (tells classes apart which
    share a smallest id), ``n_links`` (other documents at least as similar as the threshold,
    copies included), ``n_copies`` (documents with the same set) and ``is_first`` (whether
    the row is the class's smallest by id, then by the hash of its text)."""
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text_key(text_col).alias("th"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = materialize(set_rows(ids), "shingle-sets")
    classes = rows.groupBy("s1", "s2").agg(F.min(F.struct("doc", "th")).alias("first"), F.count("*").alias("n"), F.first("sig").alias("sig"))
    # a class is named by its smallest id; two classes can share it where rows share an id
    classes = materialize(classes.select("s1", "s2", F.col("first.doc").alias("doc"), F.col("first.th").alias("th"), "n", "sig"), "classes")
    named = classes.withColumn("rep", F.col("doc"))
    if classes.groupBy("doc").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():
        named = classes.withColumn("rep", F.xxhash64("s1", "s2"))

    groups = components(candidate_edges(named.select("rep", "sig"), threshold, recall, part))
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    members = named.join(groups.withColumnRenamed("node", "rep").withColumnRenamed("root", "group"), "rep").select("group", "rep", "n", "doc", "th")
    texts = materialize(ids.join(members, ["doc", "th"]).select("group", "rep", "n", "text"), "member-texts")
    # of a group's first class any row will do
    first = materialize(texts.where("rep = group").groupBy("group").agg(F.first("text").alias("first")), "first-texts")
    diffs = materialize(differences(texts.join(first, "group")), "member-differences")
    links = materialize(verified(diffs, threshold), "links")
    count = links.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(links.where("rep > root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())

    linked = named.join(count, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    linked = linked.select("s1", "s2", "doc", "th", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("class_key"))
    least = linked.groupBy("class_key").agg(F.min(F.struct("doc", "th")).alias("least"))
    linked = linked.join(least, "class_key").select("s1", "s2", "class_key", "least", (F.col("links") + F.col("n") - 1).alias("n_links"), F.col("n").alias("n_copies"))
    out = rows.select("doc", "th", "s1", "s2").join(linked, ["s1", "s2"])
    return out.select("doc", "th", F.col("least.doc").alias("class_id"), "class_key", "n_links", "n_copies", (F.struct("doc", "th") == F.col("least")).alias("is_first"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class and its number of links, over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = jaccard_classes(docs)
    empty = docs.where(F.col("doc_id").isNull() | (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]")) == 0))
    rest = empty.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return found.select(F.col("doc").alias("doc_id"), "class_id", "n_links", "n_copies").unionByName(rest)


#: All pairs that share a shingle, for tables with distinct ids; for checking only.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y, c = a.n AND c = b.n AS copy FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 9 * c >= 4 * (a.n + b.n)
), e AS (
  SELECT x, y, copy FROM l UNION ALL SELECT y, x, copy FROM l
), r AS (
  SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.node = e.x
), c AS (
  SELECT doc_id, min(node) AS class_id FROM r GROUP BY doc_id
), k AS (
  SELECT x AS doc_id, count(*) AS links, count(*) FILTER (WHERE copy) AS copies FROM e GROUP BY x
)
SELECT doc_id, class_id, coalesce(links, 0) AS n_links, 1 + coalesce(copies, 0) AS n_copies FROM c LEFT JOIN k USING (doc_id)
"""


def brute_force(docs: list[tuple], threshold: float = 0.8, k: int = SHINGLE) -> list[tuple]:
    """Plain reference for tests: (doc_id, class_id, n_links) of rows with distinct ids."""
    import re

    sets = []
    for d, t in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append((d, {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(root, 0)
    for i, (d, s) in enumerate(sets):
        for e, u in sets[:i]:
            if s and u and len(s & u) >= threshold * len(s | u) - 1e-9:
                links[d] += 1
                links[e] += 1
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return [(d, find(d), links[d]) for d, _ in sets]
