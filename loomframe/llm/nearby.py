"""Near-duplicate documents by ProbMinHash.

A text is a weighted set: its five-word shingles and how often each occurs. Each shingle is a Poisson process of
arrivals at the rate of its weight; every arrival falls on a random component of the signature, and a component keeps
the shingle that arrived first. A text's arrivals stop when none can be earlier than what its components hold. Two texts
agree in a component with the probability of their probability Jaccard similarity.

Banding: texts that agree in a band of components are candidates, and form loose families. Inside a family the whole signatures are
compared, and the greatest spanning tree of estimated similarities gives the pairs to verify: texts that a chain of
links above a threshold connects are connected by such links of the tree. Pairs are verified with the exact probability Jaccard
similarity of the whole texts. Estimates stray, so a family that the verified pairs leave apart is closed: its further
candidates are verified, best first, until none is left between two components. Classes are the connected components of the
verified links.

Scale: equal texts are one node from the start. In a band, each map task links its members of a bucket to one of them and sends
only that one on, so a bucket of any size gives one link a member, never all pairs. Large families are split by
further components of the signature, several times over; what stays large, as texts that are all alike do, is dealt in
blocks that share some texts. A large family is closed block by block: every pair of blocks is a unit of its own, unless
both are of the family's largest part. That is the size of the family by what is left apart of it. Joins on a family or class spread
those that hold a thousandth of all rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, no_reserved, scratch
from .exchange import BLOBS_DDL, Gather, blob_rows, bucket_of, buckets, deal, flush_rows, received, runs
from .graph import components
from .textops import U64, mix, pieces, ragged, span_hashes, text_bytes, window_hashes, word_spans

SHINGLE = 5
SIMILARITY = 0.8
#: Components of a signature; the first BANDS * ROWS of them make the bands: a pair of similarity 0.8 shares a
#: band with a probability of 1 - (1 - 0.8 ** 4) ** 32, all but 5e-8.
COMPONENTS, BANDS, ROWS = 256, 32, 4
#: Texts of which all pairs of signatures are compared at a time, about.
BLOCK = 256
#: A larger family is dealt anew by two further components, so often.
RESPLITS = 4
#: Texts that go to each block of what is still larger.
HUBS = 8
#: Texts in a block of a family that is closed, about.
CLOSE_BLOCK = 256
NULL_ID = -(1 << 63)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of rows: row, hash, weight; sorted. A row with fewer words has one shingle of all its words, a row without words none."""
    starts, ends, first = word_spans(data, offsets)
    (h,) = span_hashes(data, starts, ends, 1)
    words = np.diff(first)
    count = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    row = np.repeat(np.arange(len(words)), count)
    at = first[row] + ragged(np.zeros(len(words), np.int64), count)
    key = np.empty(len(at), dtype=U64)
    for width in range(1, size + 1):
        whole = (np.minimum(words, size) == width)[row]
        if whole.any():
            key[whole] = window_hashes(h, width)[at[whole]] + U64(width)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.flatnonzero(runs(row, key))
    return row[new], key[new], np.diff(np.append(new, len(row)))


def signatures(row: np.ndarray, key: np.ndarray, weight: np.ndarray, rows: int, m: int = COMPONENTS) -> np.ndarray:
    """The ProbMinHash signature of each row: 16 bits of the shingle that reached each component first; 0 without shingles."""
    arrival = np.full(rows * m, np.inf)
    winner = np.zeros(rows * m, dtype=U64)
    only = np.bincount(row, minlength=rows)
    single = only[row] == 1  # every component goes to the one shingle
    if single.any():
        winner.reshape(rows, m)[row[single]] = key[single][:, None]
    row, key, rate = row[~single], key[~single], 1.0 / weight[~single]
    time = np.zeros(len(row))
    state = key.copy()
    while len(row):
        state = mix(state + U64(0x9E3779B97F4A7C15))
        time = time - np.log(((state >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
        place = row * m + (mix(state ^ U64(0xD1B54A32D192ED03)) % U64(m)).astype(np.int64)
        np.minimum.at(arrival, place, time)
        won = arrival[place] == time
        winner[place[won]] = key[won]
        limit = arrival.reshape(rows, m).max(axis=1)
        left = time < limit[row]
        row, key, rate, time, state = row[left], key[left], rate[left], time[left], state[left]
    return (winner.reshape(rows, m) >> U64(48)).astype(np.uint16)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets (sorted hashes, weights)."""
    if len(a[0]) and len(b[0]) and (a[1] == 1).all() and (b[1] == 1).all():
        both = np.sort(np.concatenate([a[0], b[0]]))
        shared = np.count_nonzero(both[1:] == both[:-1])
        return float(shared / (len(both) - shared))
    keys = np.union1d(a[0], b[0])
    if not len(keys):
        return 1.0
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1]
    y[np.searchsorted(keys, b[0])] = b[1]
    # sum over shared i of 1 / sum over j of max(x_j / x_i, y_j / y_i): with ratios x / y in order, the greater
    # term is x's for all j of no lesser ratio
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    from_x = np.append(np.cumsum(x[::-1])[::-1], 0.0)
    upto_y = np.append(0.0, np.cumsum(y))
    shared = np.flatnonzero((x > 0) & (y > 0))
    at = np.searchsorted(ratio, ratio[shared], side="left")
    return float((1.0 / (from_x[at] / x[shared] + upto_y[at] / y[shared])).sum())


def _signed(size: int, m: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(3))
            for a, b in pieces(offsets):
                found = signatures(*shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size), b - a, m)
                raw = pa.Array.from_buffers(pa.binary(2 * m), b - a, [None, pa.py_buffer(np.ascontiguousarray(found))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(3)), raw], names=["k_doc", "node", "check", "sig"])

    return run


def _stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by key and node: which are the first of their key, and links of the others to those."""
    first = runs(key)
    center = node[np.flatnonzero(first)][np.cumsum(first) - 1] if len(key) else node
    linked = ~first & (node != center)
    return first, node[linked], center[linked]


def _banded(bands: int, rows: int, n: int):
    """Band keys of signatures; of a task's equal keys one is sent on, and the others' links to it."""

    def combined(columns: list[np.ndarray]) -> list[pa.RecordBatch]:
        order = np.lexsort((columns[1], columns[0]))
        key, node = (c[order] for c in columns)
        first, a, b = _stars(key, node)
        key, node = key[first], node[first]
        kind = np.append(np.zeros(len(key), np.int8), np.ones(len(a), np.int8))
        bucket = np.append(bucket_of(key, n), bucket_of(mix(a.astype(U64)), n))
        return [blob_rows(bucket, [kind, np.append(key, b.astype(U64)), np.append(node, a)])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(combined, flush_rows(n))
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            sig = np.frombuffer(data.tobytes(), np.uint16).reshape(batch.num_rows, -1)[:, : bands * rows].astype(U64)
            key = np.zeros((len(sig), bands), dtype=U64) + np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
            for r in range(rows):
                key = mix((key ^ sig.reshape(len(sig), bands, rows)[:, :, r]) * U64(0xC2B2AE3D27D4EB4F) + U64(r))
            node = batch.column(0).to_numpy(zero_copy_only=False)
            yield from gather.add([key.ravel(), np.repeat(node, bands)])
        yield from gather.end()

    return run


LINKS_DDL = "a long, b long"


def _linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns, _ = received(batches)
    if not columns:
        return
    kind, key, node = columns
    own = kind == 0
    order = np.lexsort((node[own], key[own]))
    _, a, b = _stars(key[own][order], node[own][order])
    a, b = np.append(a, node[~own]), np.append(b, key[~own].astype(np.int64))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def spanning_pairs(sig: np.ndarray, least: float) -> list[tuple[int, int]]:
    """The greatest spanning tree of estimated similarities (Prim), without pairs below ``least``; ties by the first."""
    n = len(sig)
    best, near = np.full(n, -1.0), np.zeros(n, dtype=np.int64)
    out, done, at = [], np.zeros(n, dtype=bool), 0
    for _ in range(n - 1):
        done[at] = True
        alike = (sig == sig[at]).mean(axis=1)
        closer = alike > best
        best[closer], near[closer] = alike[closer], at
        at = int(np.argmax(np.where(done, -2.0, best)))
        if best[at] >= least:
            out.append((int(near[at]), at))
    return out


def _trees(least: float):
    """Pairs to verify in each unit; rows come sorted by unit and node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nodes, sigs = None, [], []

        def tree() -> Iterator[pa.RecordBatch]:
            found = np.array(spanning_pairs(np.stack(sigs), least), dtype=np.int64).reshape(-1, 2)
            if len(found):
                ends = np.sort(np.array(nodes, dtype=np.int64)[found], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        for batch in batches:
            data, _ = text_bytes(batch.column(2))
            sig = np.frombuffer(data.tobytes(), np.uint16).reshape(batch.num_rows, -1)
            for k, (u, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if u != unit:
                    if nodes:
                        yield from tree()
                    unit, nodes, sigs = u, [], []
                if not nodes or node != nodes[-1]:  # a hub is in its own block twice
                    nodes.append(node)
                    sigs.append(sig[k])
        if nodes:
            yield from tree()

    return run


def _sets(texts: pa.Array, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The weighted set of each text, as similarity() takes it."""
    data, offsets = text_bytes(texts)
    own = []
    for a, b in pieces(offsets):
        row, key, weight = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
        edges = np.searchsorted(row, np.arange(b - a + 1))
        own += [(key[x:y].copy(), weight[x:y].astype(np.int32)) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    return own


def _verified(size: int, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_sets(batch.column(column), size) for column in (2, 3)]
            alike = [similarity(a, b) for a, b in zip(*sets, strict=True)]
            keep = pa.array([x >= threshold - 1e-12 for x in alike], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.float64())], names=["a", "b", "similarity"]).filter(keep)

    return run


def joining_links(sig: np.ndarray, part: np.ndarray, block: np.ndarray, sets: list, least: float, threshold: float) -> list[tuple[int, int, float]]:
    """Verified links that join different parts, best estimates first, until no candidate is left between two of them.

    ``part``: what is known to be connected already. Where there are two blocks, only pairs across them are candidates: the
    pairs inside a block have a unit of their own.
    """
    up = {int(p): int(p) for p in part}

    def top(p: int) -> int:
        while up[p] != p:
            up[p] = up[up[p]]
            p = up[p]
        return p

    left, right, alike = [], [], []
    across = (block != block[0]).any()
    for i in range(len(sig)):
        others = np.flatnonzero((part[i + 1 :] != part[i]) & ((block[i + 1 :] != block[i]) | (not across))) + i + 1
        found = (sig[others] == sig[i]).mean(axis=1)
        near = found >= least
        left.append(np.full(int(near.sum()), i))
        right.append(others[near])
        alike.append(found[near])
    left, right, alike = (np.concatenate(c) for c in (left, right, alike))
    out = []
    for k in np.argsort(-alike, kind="stable").tolist():
        a, b = int(left[k]), int(right[k])
        one, two = top(int(part[a])), top(int(part[b]))
        if one != two and (exact := similarity(sets[a], sets[b])) >= threshold - 1e-12:
            up[one] = two
            out.append((a, b, exact))
    return out


def _closed(size: int, least: float, threshold: float):
    """Links between components of each unit (a family, or a pair of its blocks); rows come sorted by unit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, sets = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            node, part, block = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
            links = joining_links(np.stack([r[3] for r in rows]), part, block, sets, least, threshold)
            if links:
                a, b = (node[[x[k] for x in links]] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array([x[2] for x in links], pa.float64())], names=["a", "b", "similarity"])

        for batch in batches:
            data, _ = text_bytes(batch.column(4))
            sig = np.frombuffer(data.tobytes(), np.uint16).reshape(batch.num_rows, -1)
            own = _sets(batch.column(5), size)
            for k, (u, *r) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)):
                if u != unit:
                    if rows:
                        yield from close()
                    unit, rows, sets = u, [], []
                rows.append((*r, sig[k]))
                sets.append(own[k])
        if rows:
            yield from close()

    return run


def _node(text: F.Column) -> F.Column:
    return F.xxhash64(text)


def _nodes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k_doc, node (a hash of the text), check (60 bits of another) and text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    check = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("k_doc"), _node(text).alias("node"), check.alias("check"), text.alias("text"))


def _told_apart(df: DataFrame, clashes: list[DataFrame], node: str = "node", check: str = "check") -> DataFrame:
    """``df`` with other nodes for the texts that share a node with another text."""
    for clash in clashes:
        df = df.join(clash.select(F.col("node").alias(node), F.lit(True).alias("clash")), node, "left").withColumn(node, F.when(F.col("clash"), F.xxhash64(node, check)).otherwise(F.col(node))).drop("clash")
    return df


@dataclass
class Links:
    """``rows``: (k_doc, node) of each row. ``texts``: each node and how many copies it has. ``links``: the verified links (a, b, similarity)
    between nodes, which are the distinct texts. ``clashes``: nodes that texts shared at first, for _told_apart()."""

    rows: DataFrame
    texts: DataFrame
    links: DataFrame
    clashes: list[DataFrame]

    def labelled(self) -> DataFrame:
        """(node, copies, label) of each node."""
        return self.texts.join(components(self.links.select("a", "b")), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _units(members: DataFrame, n: int) -> DataFrame:
    """(unit, node, sig): what is compared as a whole. ``members``: label, size, node, sig.

    A family of up to BLOCK texts is a unit. A larger one is dealt RESPLITS times by two components; what then still has
    more texts is dealt in blocks, and HUBS of its texts go to each block, so that the blocks' trees grow together.
    """
    small = members.filter(F.col("size") <= BLOCK).select(F.col("label").alias("unit"), "node", "sig")
    part = lambda t: F.substring("sig", 2 * BANDS * ROWS + 4 * t + 1, 4)
    split = F.explode(F.array(*(F.xxhash64("label", F.lit(t), part(t)) for t in range(RESPLITS))))
    dealt = members.filter(F.col("size") > BLOCK).select(split.alias("unit"), "node", "sig")
    if dealt.isEmpty():
        return small
    dealt = cut(dealt, "units")
    among = F.pmod(F.xxhash64("node"), F.lit(HUBS))
    stats = cut(dealt.groupBy("unit").agg(F.count("*").alias("n"), *(F.min(F.when(among == k, F.struct("node", "sig"))).alias(f"h{k}") for k in range(HUBS))), "unit-hubs")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    named = lambda k: F.when(F.col("n") > BLOCK, F.xxhash64("unit", k)).otherwise(F.col("unit"))
    rows = hot_join(dealt, stats.select("unit", "n"), "unit", "n").select(named(F.pmod(F.xxhash64("node", "unit"), blocks)).alias("unit"), "node", "sig")
    hubs = stats.filter(F.col("n") > BLOCK).select("unit", "n", F.explode(F.array(*(f"h{k}" for k in range(HUBS)))).alias("h")).filter("h is not null")
    hubs = hubs.select("unit", "n", "h", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("k")).select(named(F.pmod(F.col("k"), blocks)).alias("unit"), "h.node", "h.sig")
    return small.unionByName(rows).unionByName(hubs)


def find_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = SIMILARITY) -> Links:
    """The verified links between the distinct texts of ``df``."""
    n = buckets(df)
    signed = cut(_nodes(df, id_col, text_col).mapInArrow(_signed(size, COMPONENTS), "k_doc long, node long, check long, sig binary"), "signatures")
    clashes: list[DataFrame] = []
    while True:  # in all likelihood once
        seen = _told_apart(signed, clashes)
        texts = cut(seen.groupBy("node").agg(F.min("k_doc").alias("k_doc"), F.first("sig").alias("sig"), F.count("*").alias("copies"), F.min("check").alias("low"), F.max("check").alias("high")), "texts")
        clash = texts.filter("low <> high").select("node")
        if clash.isEmpty():
            break
        clashes.append(cut(clash, "clashes"))
    docs = _told_apart(_nodes(df, id_col, text_col), clashes)
    # a text without words has no shingles: its signature is all zero, and no band of it is like another's
    banded = texts.filter(F.col("sig") != F.lit(bytes(2 * COMPONENTS))).select("node", "sig").mapInArrow(_banded(BANDS, ROWS, n), BLOBS_DDL)
    families = components(deal(banded, n).mapInArrow(_linked, LINKS_DDL))
    sizes = cut(families.groupBy("label").agg(F.count("*").alias("size")), "family-sizes")
    members = cut(hot_join(families, sizes, "label", "size").join(texts.select("node", "sig"), "node"), "members")
    units = _units(members, n)
    # estimates of a true link stray by 0.025: all but a few in 10^8 are above this
    least = threshold - 5.5 * (threshold * (1 - threshold) / COMPONENTS) ** 0.5
    pairs = units.repartition(n, "unit").sortWithinPartitions("unit", "node").mapInArrow(_trees(least), LINKS_DDL)
    pairs = cut(pairs.distinct(), "pairs")
    ends = pairs.select("a").union(pairs.select("b")).distinct().toDF("node")
    chosen = ends.join(texts.select("node", "k_doc"), "node")
    bodies = cut(docs.join(chosen, ["node", "k_doc"]).select("node", "text").dropDuplicates(["node"]), "bodies")
    both = pairs.join(bodies.toDF("a", "text_a"), "a").join(bodies.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    links = cut(both.mapInArrow(_verified(size, threshold), "a long, b long, similarity double"), "near-links")
    # candidates that no tree held may join what is still apart
    parts = members.drop("sig").join(components(links.select("a", "b")).toDF("node", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    parts = cut(parts, "parts")
    counts = parts.groupBy("label", "size", "part").agg(F.count("*").alias("n"))
    apart = counts.groupBy("label", "size").agg(F.max(F.struct("n", "part")).alias("core")).filter("core.n < size")
    apart = cut(apart.select("label", "size", F.col("core.part").alias("core"), F.col("core.n").alias("inside")), "apart-families")
    if apart.isEmpty():
        return Links(signed_rows(signed, clashes), texts.select("node", "copies"), links, clashes)
    rows = hot_join(parts.select("label", "node", "part"), apart, "label", "size")
    known = docs.join(rows.join(texts.select("node", "k_doc", "sig"), "node"), ["node", "k_doc"]).dropDuplicates(["node"])
    # blocks of the largest part come first; two of them needn't be compared
    inner, outer = (F.greatest(F.ceil(c / CLOSE_BLOCK).cast("int"), F.lit(1)) for c in (F.col("inside"), F.col("size") - F.col("inside")))
    key = F.xxhash64("node")
    block = F.when(F.col("part") == F.col("core"), F.pmod(key, inner)).otherwise(inner + F.pmod(key, outer)).cast("int")
    known = cut(known.select("label", "node", "part", "core", "sig", "text", inner.alias("inner"), outer.alias("outer"), block.alias("block")), "apart")
    others = F.sequence(F.when(F.col("part") == F.col("core"), F.col("inner")).otherwise(0), F.col("inner") + F.col("outer") - 1)
    mates = F.transform(others, lambda k: F.xxhash64("label", F.least("block", k), F.greatest("block", k)))
    units = known.select(F.explode(mates).alias("unit"), "node", "part", "block", "sig", "text")
    more = units.repartition(n, "unit").sortWithinPartitions("unit", "node").mapInArrow(_closed(size, least, threshold), "a long, b long, similarity double")
    return Links(signed_rows(signed, clashes), texts.select("node", "copies"), links.unionByName(cut(more.distinct(), "closing-links")), clashes)


def signed_rows(signed: DataFrame, clashes: list[DataFrame]) -> DataFrame:
    return _told_apart(signed.select("k_doc", "node", "check"), clashes).select("k_doc", "node")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """One row a document: doc_id, class_id (the least id of its class), n_links (links of its text to other texts that were verified).

    A class holds equal texts and, over any chain, texts whose probability Jaccard similarity of word shingles is
    ``threshold`` or more. A text of fewer than ``size`` words has one shingle of all its words. Null text counts as
    empty; texts without words are alike only if they are equal. A null id stays null and is the least. Each of
    repeated rows gives a row. A text of any length is taken whole, and needs some thirty times its bytes in one Python worker.
    An empty table gives an empty result; other columns aren't read.
    """
    with scratch(df.sparkSession) as keep:
        found = find_links(df, id_col, text_col, size, threshold)
        degree = found.links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        nodes = cut(found.labelled().join(degree, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0))), "nodes")
        known = keep(cut(hot_join(found.rows, nodes, "node", "copies").select("k_doc", "node", "label", "n_links"), "labelled"))
        least = keep(cut(known.groupBy("label").agg(F.min("k_doc").alias("class_id"), F.count("*").alias("size")), "classes"))
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias
    return hot_join(known, least, "label", "size").select(null("k_doc")("doc_id"), null("class_id")("class_id"), F.col("n_links").cast("long").alias("n_links"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """One row of ``df`` for each class of classes(), that of the least id, all columns unchanged. Of repeated rows one stays; null texts
    and empty ones are a class each; an empty table stays empty. Raises ValueError if a column's name begins with ``__lf_``."""
    no_reserved(df)
    with scratch(df.sparkSession) as keep:
        found = find_links(df, id_col, text_col, size, threshold)
        known = cut(hot_join(found.rows, cut(found.labelled(), "nodes"), "node", "copies").select("k_doc", "node", "label"), "labelled")
        best = known.groupBy("label").agg(F.min(F.struct("k_doc", "node")).alias("kept"))
        kept = keep(cut(best.select(F.col("kept.k_doc").alias("__lf_doc"), F.col("kept.node").alias("__lf_node")), "kept"))
        # rows that repeat id and text are told apart only here, among the kept ones
        again = known.groupBy("k_doc", "node").count().filter("count > 1").select(F.col("k_doc").alias("__lf_doc"), F.col("node").alias("__lf_node"))
        again = keep(cut(again, "repeated"))
        clashes = [keep(c) for c in found.clashes]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = df.withColumns({"__lf_doc": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)), "__lf_node": _node(text)})
    if clashes:
        docs = _told_apart(docs.withColumn("__lf_check", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")), clashes, "__lf_node", "__lf_check")
    out = docs.join(kept, ["__lf_doc", "__lf_node"])
    if not again.isEmpty():
        out = out.join(again, ["__lf_doc", "__lf_node"], "left_anti").unionByName(out.join(again, ["__lf_doc", "__lf_node"], "left_semi").dropDuplicates(["__lf_doc", "__lf_node"]))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
