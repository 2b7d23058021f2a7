"""op7 against exact similarities of all pairs."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from loomframe.llm import graph, nearby
from loomframe.llm.textops import text_bytes


def weights(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def exact(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in keys) for i in a if i in b)


def brute(rows):
    """(least id of the class) of each (id, text)."""
    texts = sorted({t or "" for _, t in rows})
    own = {t: weights(t) for t in texts}
    up = {t: t for t in texts}

    def top(t):
        while up[t] != t:
            t = up[t]
        return t

    for a, b in combinations(texts, 2):
        if own[a] and own[b] and len(own[a].keys() & own[b].keys()) > 0 and exact(own[a], own[b]) >= 0.8:
            up[top(a)] = top(b)
    least = {}
    for d, t in rows:
        key = -1 if d is None else d
        least[top(t or "")] = min(least.get(top(t or ""), key), key)
    return sorted((-1 if d is None else d, least[top(t or "")]) for d, t in rows), len(least)


def test_classes(docs, odd, none):
    for df in (docs, odd):
        found = nearby.classes(df).collect()
        key = lambda x: -1 if x is None else x
        assert sorted((key(r.doc_id), key(r.class_id)) for r in found) == brute([(r.doc_id, r.text) for r in df.collect()])[0]
    assert nearby.classes(none).count() == 0


def test_one_of_each(odd, none):
    out = nearby.one_of_each(odd)
    assert out.columns == odd.columns and out.count() == brute([(r.doc_id, r.text) for r in odd.collect()])[1]
    assert nearby.one_of_each(none).count() == 0


def test_signature_estimates_similarity():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(1 << 40)}" for _ in range(400)]
    other = base.copy()
    for k in (50, 150, 250, 350):
        other[k] = "other"
    texts = [" ".join(base), " ".join(other), " ".join(base + base[:100])]
    data, offsets = text_bytes(pa.array(texts))
    sig = nearby.signatures(*nearby.shingles(data, offsets), 3)
    for a, b in ((0, 1), (0, 2), (1, 2)):
        assert abs((sig[a] == sig[b]).mean() - exact(weights(texts[a]), weights(texts[b]))) < 0.12
    row, key, weight = nearby.shingles(data, offsets)
    sets = [(key[row == k], weight[row == k]) for k in range(3)]
    for a, b in ((0, 1), (0, 2), (1, 2)):
        assert nearby.similarity(sets[a], sets[b]) == pytest.approx(exact(weights(texts[a]), weights(texts[b])))


def test_large_families_are_split(spark, monkeypatch):
    """Texts that are all near one base, with blocks far smaller than the family."""
    monkeypatch.setattr(nearby, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = [f"w{rng.integers(1 << 40)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        own = base.copy()
        own[int(rng.integers(300))] = f"v{k}"
        rows.append((k, " ".join(own)))
    out = nearby.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in out} == {0}


def test_large_star_is_whole(spark, monkeypatch):
    """Copies near 0.85 to one base and near 0.73 to each other, with blocks far smaller than the family."""
    monkeypatch.setattr(nearby, "BLOCK", 8)
    monkeypatch.setattr(nearby, "CLOSE_BLOCK", 16, raising=False)
    rng = np.random.default_rng(11)
    base = [f"w{rng.integers(1 << 40)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(1, 150):
        own = base.copy()
        for place in range(10 + int(rng.integers(20)), 300, 65):
            own[place] = f"v{k}x{place}"
        rows.append((k, " ".join(own)))
    own = [frozenset(weights(t)) for _, t in rows]
    assert all(len(own[0] & x) / len(own[0] | x) >= 0.8 for x in own)
    out = nearby.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 150 and {r.class_id for r in out} == {0}


def test_failed_tree_links_are_made_up_for(spark):
    """Groups of six with similarities spread around the threshold: all that true links connect is one class."""
    rng = np.random.default_rng(12)
    rows, least = [], {}
    for g in range(400):
        base = [f"w{rng.integers(1 << 40)}" for _ in range(300)]
        group = []
        for k in range(6):
            own = base.copy()
            for place in rng.choice(300, 3 + int(rng.integers(2)), replace=False):
                own[place] = f"v{g}x{k}x{place}"
            group.append((6 * g + k, " ".join(own)))
        sets = [set(weights(t)) for _, t in group]
        part = list(range(6))
        for a, b in combinations(range(6), 2):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                part = [part[a] if p == part[b] else p for p in part]
        for k in range(6):
            least[6 * g + k] = 6 * g + part.index(part[k])
        rows += group
    assert 400 < len(set(least.values())) < 2400
    out = nearby.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.class_id for r in out} == least


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(1 << 40, size=(40, 2))]
    chain = rng.permutation(200).tolist()
    links += [(a + (1 << 41), b + (1 << 41)) for a, b in zip(chain, chain[1:])] + [(7, 7)]
    out = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    label = {r.node: r.label for r in out}
    assert len({label[c + (1 << 41)] for c in chain}) == 1 and len(set(label.values())) == 41 and 7 not in label
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cuts_are_cleared(spark):
    from loomframe.llm import common

    common.clear_cuts(spark)
    kept = common.cut(spark.range(5), "test")
    with common.scratch(spark) as keep:
        gone, stays = common.cut(spark.range(6), "test"), keep(common.cut(spark.range(7), "test"))
        assert gone.count() == 6 and len(common.cuts(spark)) == 3
    assert stays.count() == 7 and kept.count() == 5 and len(common.cuts(spark)) == 2
    assert common.clear_cuts(spark) == 2 and common.clear_cuts(spark) == 0


def test_hot_join(spark):
    from loomframe.llm import common

    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, -1, id) as key")
    stats = rows.groupBy("key").count()
    found = common.hot_join(rows, stats, "key", "count")
    assert sorted(map(tuple, found.select("id", "key", "count").collect())) == sorted((k, -1 if k % 3 == 0 else k, 1667 if k % 3 == 0 else 1) for k in range(5000))
    assert common.hot_join(rows.limit(0), stats.limit(0), "key", "count").count() == 0


def test_texts_that_share_a_hash(spark, docs, odd, monkeypatch):
    """Every text begins with one of three nodes: they are told apart by further hashes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(nearby, "_node", lambda text: F.pmod(F.xxhash64(text), F.lit(3)))
    found = nearby.classes(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in found) == brute([(r.doc_id, r.text) for r in docs.collect()])[0]
    assert nearby.one_of_each(odd).count() == brute([(r.doc_id, r.text) for r in odd.collect()])[1]


def test_recall_in_a_family_over_the_block(spark):
    """A family of 700 texts, over BLOCK, around similarity 0.8, against all pairs: 0.9 of the linked pairs or more are in one class."""
    rng = np.random.default_rng(21)
    base = [f"w{rng.integers(1 << 40)}" for _ in range(400)]
    rows = []
    for k in range(700):
        own = base.copy()
        for place in rng.choice(400, int(rng.integers(1, 9)), replace=False):
            own[place] = f"v{k}x{place}"
        rows.append((k, " ".join(own)))
    sets = [frozenset(weights(t)) for _, t in rows]
    label = {r.doc_id: r.class_id for r in nearby.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    linked = [(a, b) for a, b in combinations(range(700), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert len(linked) > 10_000 and all(label[a] == label[b] for a, b in linked)
