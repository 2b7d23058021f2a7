"""Quality rules, sharding, mixing, URL filter, decontamination and token shards."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from loomframe.llm import decontamination, mixing, quality, sharding, tokenstore, urls

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    w = WORDS.findall(text or "")
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(three), set()
    for i, x in enumerate(three):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_base_counts(docs, rows):
    text = {r[0]: r[1] for r in rows}
    for r in quality.quality(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counted(text[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_outliers(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9))))
    rows = [(k, " ".join(word() for _ in range(int(rng.integers(80, 300)))), "en", "s") for k in range(400)]
    rows += [(1000 + k, " ".join("#$%" + word() for _ in range(100)), "en", "s") for k in range(40)]
    out = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    kept = {r.doc_id for r in out if r.kept}
    assert not any(k >= 1000 for k in kept) and len(kept) >= 396


def test_each_statistic_rejects(spark):
    """One planted outlier for each statistic, usual in the other four."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(3, 9))))
    lined = lambda w: "\n".join(" ".join(w[i : i + 10]) for i in range(0, len(w), 10))
    usual = lambda n: [word() for _ in range(n)]
    rows = [(k, lined(usual(int(rng.integers(120, 240))))) for k in range(300)]
    phrase = usual(40)
    planted = {
        1000: lined(usual(20_000)),
        1001: lined([w[:1] for w in usual(40)] + [w[:2] for w in usual(140)]),
        1002: lined([w + "#" for w in usual(180)]),
        1003: "\n".join(x for _ in range(12) for x in (" ".join(usual(12)), "same line")),
        1004: lined(usual(50) + phrase + usual(47) + phrase + usual(3)),
    }
    own = {k: counted(t) for k, t in planted.items()}
    assert not any(c[5] for c in own.values()) and own[1003][3:5] == (11, 0) and own[1004][3:5] == (0, 80)
    out = quality.quality(spark.createDataFrame([(*r, "en", "s") for r in [*rows, *planted.items()]], "doc_id long, text string, lang string, source string")).collect()
    kept = {r.doc_id for r in out if r.kept}
    assert not kept & planted.keys() and len(kept) >= 298


def test_quality_odd(odd, none):
    assert quality.quality(odd).count() == odd.count() and quality.quality(none).count() == 0
    good = quality.good_documents(odd)
    assert good.columns == odd.columns and good.count() == quality.quality(odd).filter("kept").count()
    assert good.select("__x", "words").distinct().collect() == [("x", "y")]
    assert quality.good_documents(none).count() == 0


def least_determinant(x):
    """Brute force: mean, covariance (scaled) and log determinant of the best subset of rows."""
    n, p = x.shape
    h = quality.subset_size(n, p)
    best = None
    for chosen in itertools.combinations(range(n), h):
        own = x[list(chosen)].astype(float)
        cov = np.cov(own.T, bias=True) * quality.consistency(h, n, p)
        cov[np.diag_indices(p)] = np.maximum(cov.diagonal(), quality._LEAST)
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[2] - 1e-9:
            best = own.mean(axis=0), cov, det
    return best


def test_least_determinants(spark):
    """Small groups against all subsets: the estimate found is nearly always the best one, and then gives its distances."""
    rng = np.random.default_rng(7)
    rows, groups = [], {}
    for g in range(25):
        n = int(rng.integers(10, 15))
        x = np.round(rng.normal(0, [12, 20, 30, 25, 40], (n, 5)) + 100).astype(int)
        x[: n // 6] += np.round(rng.normal(400, 50, (n // 6, 5))).astype(int)
        groups[f"s{g}"] = x
        rows += [("en", f"s{g}", *map(int, v)) for v in x]
    rows += [("en", "few", 1, 2, 3, 4, 5)] * 9
    out = {r.source: r for r in quality.fit(spark.createDataFrame(rows, "lang string, source string, x0 long, x1 long, x2 long, x3 long, x4 long")).collect()}
    assert out.keys() == groups.keys()
    same = 0
    for g, x in groups.items():
        mean, cov, det = least_determinant(x)
        v = np.zeros((5, 5))
        for i, j in quality._PAIRS:
            v[i, j] = out[g][f"v{i}_{j}"]
        found = -2 * np.log(v.diagonal()).sum()
        assert found >= det - 1e-6
        if found < det + 1e-6:
            same += 1
            away = [(r - mean) @ np.linalg.inv(cov) @ (r - mean) for r in x]
            own = [((v @ (r - np.array([out[g][f"u{i}"] for i in range(5)]))) ** 2).sum() for r in x]
            assert own == pytest.approx(away, rel=1e-6)
    assert same >= 20


def test_subset_is_exact_with_ties(spark):
    """One vector that most rows share, and some others: exactly h rows make the estimate."""
    rows = [("en", "s", 10, 10, 0, 0, 0)] * 30 + [("en", "s", 10 + k, 10 - 2 * k, k % 3, 0, 0) for k in range(1, 21)]
    (r,) = quality.fit(spark.createDataFrame(rows, "lang string, source string, x0 long, x1 long, x2 long, x3 long, x4 long")).collect()
    x = np.array([r[2:] for r in rows], float)
    h = quality.subset_size(50, 5)
    v = np.zeros((5, 5))
    for i, j in quality._PAIRS:
        v[i, j] = r[f"v{i}_{j}"]
    away = ((x - np.array([r[f"u{i}"] for i in range(5)])) @ v.T) ** 2
    nearest = sorted(zip(away.sum(axis=1), x.tolist()))[:h]
    assert np.mean([n[1] for n in nearest], axis=0) == pytest.approx([r[f"u{i}"] for i in range(5)])


def test_cut_offs():
    assert quality.f_quantile(0.95, 5, 10) == pytest.approx(3.3258, abs=1e-3) and quality.f_quantile(0.99, 5, 200) == pytest.approx(3.1100, abs=1e-3)
    sizes, cuts = quality.size_classes(), quality.cut_offs(quality.QUANTILE, 5)
    assert len(cuts) == len(sizes) + 1 and min(cuts[10:]) == cuts[-1] and cuts[-1] == pytest.approx(30.856, abs=1e-3) and cuts[-2] < 31.5
    # normal rows: few are beyond the 99 % cut, in small groups too
    rng = np.random.default_rng(2)
    for n in (12, 40):
        beyond = 0
        for _ in range(60 if n > 12 else 30):
            x = rng.normal(0, 300, (n, 5))
            if n == 12:
                mean, cov, _ = least_determinant(x)
            else:
                keep = np.arange(n)
                for _ in range(20):
                    mean, cov = x[keep].mean(axis=0), np.cov(x[keep].T, bias=True) * quality.consistency(quality.subset_size(n, 5), n, 5)
                    keep = np.argsort(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean))[: quality.subset_size(n, 5)]
            away = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            beyond += int((away > quality.cut_offs(0.99, 5)[n]).sum()) / n
        assert beyond / (60 if n > 12 else 30) < 0.05


def test_chi_square():
    assert quality.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert quality.chi2_cdf(6.6257, 5) == pytest.approx(0.75, abs=1e-4)


def plain_fill(names, size):
    """The table by whole permutations."""
    prefs = [[(sharding._draw(n, "offset", size) + k * (sharding._draw(n, "skip", size - 1) + 1)) % size for k in range(size)] for n in names]
    owner, at = [None] * size, [0] * len(names)
    while None in owner:
        for s in range(len(names)):
            while at[s] < size and owner[prefs[s][at[s]]] is not None:
                at[s] += 1
            if at[s] < size:
                owner[prefs[s][at[s]]] = s
    return owner


def test_sharding(docs, odd, none):
    names = [f"n{k}" for k in range(7)]
    table = sharding.fill_table(names, 251)
    assert table == plain_fill(names, 251)
    full = sharding.fill_table([f"n{k}" for k in range(64)])
    share = Counter(full)
    assert max(share.values()) - min(share.values()) <= 1
    moved = sum(a != b for a, b in zip(full, sharding.fill_table([f"n{k}" for k in range(63)])) if a != 63)
    assert moved < 0.05 * len(full)
    heavy = Counter(sharding.fill_table({"a": 3, "b": 1}, 4001))
    assert heavy[0] == pytest.approx(3 * heavy[1], rel=0.01)
    out = sharding.place(odd, ["doc_id"], names, 251)
    assert out.columns == [*odd.columns, "slot", "shard"] and out.count() == odd.count()
    assert all(r.shard == table[r.slot] for r in out.collect())
    assert out.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    assert sharding.place(none, ["doc_id"], names, 251).count() == 0
    for bad in (([], 251), (["a", "a"], 251), (["a"], 250), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def water(sizes):
    """Targets by sharing again and again."""
    total, capped = sum(sizes), [False] * len(sizes)
    weight = [k % 3 + 1 for k in range(len(sizes))]
    while True:
        left = total - sum(3 * s for s, c in zip(sizes, capped) if c)
        w = sum(x for x, c in zip(weight, capped) if not c)
        out = [3.0 * s if c else left * x / w for s, x, c in zip(sizes, weight, capped)]
        over = [not c and o >= 3 * s for s, o, c in zip(sizes, out, capped)]
        if not any(over):
            return out
        capped = [c or o for c, o in zip(capped, over)]


def test_mixing(docs, odd, none):
    for df in (docs, odd):
        out = mixing.mixed_sizes(df).collect()
        own = {}
        for r in df.collect():
            own.setdefault(r.source, []).append(len(WORDS.findall(r.text or "")))
        names = sorted(own, key=lambda s: (s is None, s))
        expected = dict(zip((sum(own[s]) for s in names), water([sum(own[s]) for s in names])))
        assert len(out) == df.count()
        assert all(r.target == pytest.approx(expected[r.source_size]) and 0 <= r.taken <= 3 * r.size for r in out)
        for size, target in expected.items():
            assert sum(r.taken for r in out if r.source_size == size) == math.floor(target + 0.5)
        assert sorted(map(repr, out)) == sorted(map(repr, mixing.mixed_sizes(df).collect()))
    assert mixing.mixed_sizes(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0


def test_schedules(spark):
    for schedule in mixing.SCHEDULES:
        at = [r[0] for r in spark.range(101).select(mixing.position(F.col("id") / 100, schedule)).collect()]
        assert at[0] == 0 and at[-1] == pytest.approx(1) and at == sorted(at)
        times, shares = zip(*schedule)
        for u, t in zip(np.linspace(0, 1, 101), at):
            grid = np.linspace(0, t, 2001)
            assert np.trapezoid(np.interp(grid, times, shares), grid) == pytest.approx(u, abs=1e-4)
    with pytest.raises(ValueError):
        mixing.segments(((0.0, 1.0), (0.5, 1.0)))


def test_segmenter():
    counts = {"free": 50, "bets": 20, "the": 100, "ear": 5, "year": 7, "they": 8}
    split = urls.Segmenter(counts).split
    assert split("freebets") == ("free", "bets") and split("theyear") == ("the", "year") and split("") == ()
    rng = np.random.default_rng(0)
    seg = urls.Segmenter(counts)
    for _ in range(50):
        name = "".join(rng.choice(list("theyarfb"), 7))
        cuts = [[name[a:b] for a, b in zip((0, *c), (*c, 7))] for m in range(1 << 6) for c in [[i + 1 for i in range(6) if m >> i & 1]]]
        cost = lambda words: sum(map(seg._cost, words))
        assert cost(seg.split(name)) == pytest.approx(min(map(cost, cuts)))


def test_url_rules(spark):
    given = [
        (1, "https://A.Example.com/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"),
        (2, "http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (3, "http://x.example.com/fr", "x.example.com", "/fr", "com/", "allow"),
        (4, "http://b.net/es/1", "b.net", "/es/1", "net/es/", "block"),
        (5, "http://b.net/fr/#/es/", "b.net", "/fr/", "net/fr/", "block"),
        (6, "http://notcom/", "notcom", "/", None, None),
        (7, "http://com?a", "com", "", None, None),
        (8, None, "", "", None, None),
        (9, "no scheme/en/", "", "", None, None),
        (None, "ftp://ÄB.net#x", "Äb.net", "", None, None),
        (11, "", "", "", None, None),
        (11, "http://bnet/es/" + "a" * 5000, "bnet", "/es/" + "a" * 5000, None, None),
    ]
    df = spark.createDataFrame([(r[0], r[1], "<p>word free bets</p>", "z") for r in given], "page_id long, url string, html string, rule string")
    found = urls.judge_urls(df).collect()
    assert sorted(((r.page_id or 0, r.host, r.path, r.rule) for r in found), key=repr) == sorted(((r[0] or 0, r[2], r[3], r[4]) for r in given), key=repr)
    by = {(r.page_id, r.host, r.path): r for r in found}
    for page, _, host, path, rule, verdict in given:
        r = by[page, host, path]
        assert r.rule == rule and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert urls.judge_urls(df.limit(0)).count() == 0


def plain_verdicts(rows, rules=urls.RULES):
    """Lexicon, segmentation and naive Bayes in plain Python: (verdict by rule or None, score, host words) of each (url, html)."""
    lexicon = Counter()
    for _, html in rows:
        text = re.sub(r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>", " ", html or "").lower()
        lexicon.update(w for w in regex.findall(r"\p{L}+", text) if 2 <= len(w) <= urls.LONGEST_WORD)
    split = urls.Segmenter(lexicon).split
    tested = ({x for _, h, _ in rules for x in h.split(".")}, {x for _, _, p in rules for x in p.split("/") if x})
    found = []
    for url, _ in rows:
        rest = (url or "").partition("://")[2]
        host, path = re.match(r"(?s)([^/?#]*)(/[^?#]*)?", rest).groups()
        host, path = "".join(c.lower() if c.isascii() else c for c in host), path or ""
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        ruled = max(fits, key=lambda r: len(r[1] + r[2]))[0] if fits else None
        own = []
        for kind, parts, known in (("h", re.sub(r":[0-9]*$", "", host).split(".")[:-1], tested[0]), ("p", path.lower().split("/"), tested[1])):
            for part in parts:
                if part not in known:
                    own += [(kind, w) for run in regex.findall(r"\p{L}+", part) for w in split(run)] + [(kind, "#")] * bool(re.search("[0-9]", part))
        found.append((ruled, own))
    counts = {v: Counter(t for r, own in found if r == v for t in own) for v in ("allow", "block")}
    urls_of = Counter(r for r, _ in found)
    size = len(counts["allow"].keys() | counts["block"].keys()) + 1
    odds = lambda t: math.log(counts["block"][t] + 1) - math.log(counts["block"].total() + size) - math.log(counts["allow"][t] + 1) + math.log(counts["allow"].total() + size)
    prior = math.log(urls_of["block"] + 1) - math.log(urls_of["allow"] + 1)
    return [(r, prior + sum(map(odds, own)), " ".join(w for k, w in own if k == "h")) for r, own in found]


def test_url_scores(spark):
    """Every score and split against plain Python, on the pages of the smallest tables and on odd ones."""
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    pages += [(None, None, None), (-1, "http://españolgratis.org/en/ñandú?x", "<p>español gratis ñandú español</p>"), (-2, "x://" + "ab" * 3000 + ".org:80/", "y" * 100), (-2, "", ""), (-3, "http://a1.b.org/9/x9/", None)]
    found = {(r.page_id, r.host): r for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    expected = plain_verdicts([p[1:] for p in pages])
    assert len(found) == len(pages)
    for (page, url, _), (ruled, score, words) in zip(pages, expected):
        host = re.match(r"[^/?#]*", (url or "").partition("://")[2]).group()
        r = found[page, "".join(c.lower() if c.isascii() else c for c in host)]
        assert r.words == words and (r.score is None if ruled else r.score == pytest.approx(score, abs=1e-5))
        assert r.verdict == (ruled or ("block" if r.score > 0 else "allow"))
    assert found[-1, "españolgratis.org"].words == "español gratis"


def test_host_words_decide(spark):
    """Two hosts with the same last label and path get different verdicts."""
    rows = []
    for k in range(60):
        rows += [(3 * k, f"http://{'cheappills' if k % 2 else 'freepills'}.example.net/es/a", "<p>cheap free pills daily news</p>"), (3 * k + 1, f"http://{'dailynews' if k % 2 else 'freenews'}.example.com/de/a", "<p>weather</p>")]
    rows += [(1000, "http://cheappills.example.org/x/a", ""), (1001, "http://dailynews.example.org/x/a", ""), (1002, "http://newspills.example.org/x/a", "")]
    found = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1000].verdict == "block" and found[1001].verdict == "allow" and found[1002].words == "news pills"


def stretch(same, similarity):
    best = (0, 0, 0)
    for i in range(len(same)):
        for j in range(len(same), i, -1):
            if same[i] and same[j - 1] and sum(same[i:j]) >= similarity * (j - i) - 1e-9 and j - i > best[1]:
                best = (i, j - i, sum(same[i:j]))
    return best


def test_longest_stretch():
    rng = np.random.default_rng(4)
    for _ in range(200):
        same = rng.random(int(rng.integers(1, 40))) < 0.7
        assert decontamination.longest_stretch(same, 0.8) == stretch(same.tolist(), 0.8)


def test_masks_miss_nothing():
    """However a fifth of the words is substituted, a mask fits between them: long stretches begin and end with words that agree, short items needn't."""
    for sizes, masks, inner in ((range(decontamination.MIN_OVERLAP, 26), decontamination.MASKS, 1), (range(4, decontamination.MIN_OVERLAP + 1), decontamination.SHORT_MASKS, 0)):
        for n in sizes:
            most = n - math.ceil(decontamination.SIMILARITY * n - 1e-9)
            spoilt = np.array([sum(1 << k for k in c) for c in itertools.combinations(range(inner, n - inner), most)])
            found = np.zeros(len(spoilt), bool)
            for mask in masks:
                bits = sum(1 << k for k, c in enumerate(mask) if c == "1")
                for at in range(n - len(mask) + 1):
                    found |= spoilt & (bits << at) == 0
            assert found.all(), n


def test_matches_by_brute_force(monkeypatch):
    rng = np.random.default_rng(9)
    sizes = [*range(5, 31), 45, 60]
    items = [rng.integers(1 << 62, size=n).astype(np.uint64) for n in sizes]
    items += [items[10].copy(), np.append(items[20][:15], items[3])]
    docs = [np.empty(0, np.uint64)]
    for _ in range(150):
        own = items[int(rng.integers(len(items)))].copy()
        for k in rng.choice(len(own), size=int(rng.integers(0, len(own) // 3 + 1)), replace=False):
            own[k] = rng.integers(1 << 62)
        pad = [rng.integers(1 << 62, size=int(rng.integers(0, 9))).astype(np.uint64) for _ in range(2)]
        docs.append(np.concatenate([pad[0], own[int(rng.integers(0, 3)) :], pad[1], own if rng.random() < 0.2 else own[:0]]))
    edges = lambda x: np.append(0, np.cumsum([len(w) for w in x]))
    expected = {}
    for r, text in enumerate(docs):
        for i, own in enumerate(items):
            for shift in range(-len(own), len(text)):
                lo, hi = max(0, -shift), min(len(own), len(text) - shift)
                if len(own) < decontamination.LEAST_WORDS or hi <= lo or not (same := text[lo + shift : hi + shift] == own[lo:hi]).any():
                    continue
                if len(own) <= 13:
                    begin, size, agree = (0, hi - lo, int(same.sum())) if hi - lo == len(own) and same.mean() >= 0.8 else (0, 0, 0)
                else:
                    begin, size, agree = stretch(same.tolist(), 0.8)
                if size >= min(13, len(own)):
                    score = (agree, size, -(lo + shift + begin))
                    expected[r, i] = max(expected.get((r, i), score), score)
    index = decontamination.Index(np.concatenate(items), edges(items), (decontamination.MASKS, decontamination.SHORT_MASKS), 13, decontamination.LEAST_WORDS)
    for hits, cells in ((1 << 18, 1 << 22), (1, 1), (7, 100)):
        monkeypatch.setattr(decontamination, "HITS", hits)
        monkeypatch.setattr(decontamination, "CELLS", cells)
        found = decontamination.matches(index, np.concatenate(docs), edges(docs), 13, 0.8)
        assert {(r, i): (agree, size, -at) for r, i, size, agree, at in found} == expected and len(expected) > 60
        once = decontamination.matches(index, np.concatenate(docs), edges(docs), 13, 0.8, once=True)
        assert {r for r, *_ in once} == {r for r, _ in expected}


def test_short_items(spark):
    """Items of 13 words or fewer are found with substitutions at their ends, and not if they are shorter than asked for."""
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, "just five words are here"), (3, "a b c d e f g h i j k l m")], "item_id long, text string")
    rows = [(1, "x ZERO two three four five six seven x"), (2, "one two three nil five six nil"), (3, "just five words are here"), (4, "z b c d e f g h i j k l z"), (5, "one two three four five six"), (6, "one two three x five six seven")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = lambda **how: sorted((r.doc_id, r.item_id, r.overlap, r.n_same) for r in decontamination.contaminated(df, bench, **how).collect())
    assert pairs() == [(1, 1, 7, 6), (4, 3, 13, 11), (6, 1, 7, 6)]
    assert pairs(least_words=5) == [(1, 1, 7, 6), (3, 2, 5, 5), (4, 3, 13, 11), (6, 1, 7, 6)]
    assert sorted(r.doc_id for r in decontamination.clean_documents(df, bench).collect()) == [2, 3, 5]


def test_decontamination(spark, docs, none):
    rng = np.random.default_rng(6)
    item = [f"w{k}" for k in rng.integers(1 << 30, size=40)]
    swap = [w if k % 6 else "zzz" for k, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (None, "a short item of no more than nine words"), (4, "")], "item_id long, text string")
    pad = " ".join(f"p{k}" for k in range(50))
    rows = [(1, f"{pad} {' '.join(item)} {pad}"), (2, f"{pad} {' '.join(swap)}"), (3, f"{pad} {' '.join(item[:12])} {pad}"), (4, f"{pad}, {' '.join(w.upper() + ',' for w in item[5:25])}"), (5, pad), (6, None), (7, "(A SHORT item, of no more than nine words.)"), (1, f"{pad} {' '.join(item)} {pad}")]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, text string, item_id string, item long")
    found = sorted(((r.doc_id, r.item_id or 0, r.overlap, r.n_same, r.start) for r in decontamination.contaminated(df, bench).collect()))
    assert [f[:2] for f in found] == [(1, 1), (1, 1), (2, 1), (4, 1), (7, 0)]
    assert found[0][2:] == (40, 40, 50) and found[3][2:] == (20, 20, 50)
    assert sorted(r.doc_id for r in decontamination.clean_documents(df, bench).collect()) == [3, 5, 6]
    assert decontamination.clean_documents(df, bench).columns == df.columns
    small = sorted((r.doc_id, r.item_id or 0) for r in decontamination.contaminated(df, bench, block_words=20).collect())
    assert small == [f[:2] for f in found]
    assert sorted(r.doc_id for r in decontamination.clean_documents(df, bench, block_words=20).collect()) == [3, 5, 6]
    assert decontamination.contaminated(none, bench).count() == 0 and decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.clean_documents(docs, bench.limit(0)).count() == docs.count()


def test_wavelet_matrix():
    rng = np.random.default_rng(7)
    for n, top in ((0, 5), (1, 1), (1000, 7), (140_000, 50_000)):
        v = rng.integers(top, size=n)
        w = tokenstore.WaveletMatrix(tokenstore.WaveletMatrix.build(v, 16, np.array([3, 4]), np.array([0, 1]), np.array([n, 0])))
        assert (w.tokens() == v).all() and w.n == n and w.ids.tolist() == [3, 4] and w.nulls.tolist() == [0, 1]
        for i in rng.integers(max(n, 1), size=min(n, 20)):
            token = int(v[i])
            assert w.access(int(i)) == token
            lo, hi = sorted(rng.integers(n + 1, size=2).tolist())
            assert w.count(token, lo, hi) == int((v[lo:hi] == token).sum())
            places = np.flatnonzero(v == token)
            k = int(rng.integers(len(places)))
            assert w.select(token, k) == places[k]
        assert w.select(int(v[0]) if n else 1, n + 1) == -1 and w.count(60_000) == 0
    with pytest.raises(ValueError):
        tokenstore.WaveletMatrix(b"nothing at all")


def test_hash_table():
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(1 << 63, size=5000).astype(np.uint64))
    keys = np.concatenate([keys, (np.uint64(1) << np.uint64(63)) + np.arange(200, dtype=np.uint64)])
    table = tokenstore.HashTable(len(keys))
    table.add(keys[:3000])
    table.add(keys[3000:])
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys ^ np.uint64(1 << 20)) == -1).mean() > 0.99


def test_encoder_compares_bytes(monkeypatch):
    """Parts with equal hashes get their own ids: all hashes are made equal, in one batch and in the next."""
    import public_tokenizers

    enc = tokenstore.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 100)
    monkeypatch.setattr(tokenstore, "span_hashes", lambda data, starts, ends, variants: [np.full(len(starts), 7, np.uint64)])
    thue = "".join("ab"[k.bit_count() % 2] for k in range(2048))
    for texts in (["one two two", "three", "", "one"], ["four one four", thue, thue.translate(str.maketrans("ab", "ba")), thue]):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        found, counts = enc.encode(data, np.append(0, np.cumsum([len(t) for t in texts])))
        expected = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert found.tolist() == sum(expected, []) and counts.tolist() == [len(x) for x in expected]


def test_tokenize(spark, docs, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    ids = lambda t: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    for memory in (10, 1_000_000):
        enc = tokenstore.Encoder(path, memory)
        texts = [r.text or "" for r in docs.collect()] * 2
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        found, counts = enc.encode(data, np.append(0, np.cumsum([len(t.encode()) for t in texts])))
        assert found.tolist() == [k for t in texts for k in ids(t)[:-1].tolist()] and counts.tolist() == [len(ids(t)) - 1 for t in texts]
    start, expected = 0, []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        own = ids(r.text)
        expected.append((r.doc_id, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert sorted(tuple(r) for r in tokenstore.tokenize(docs, path).collect()) == expected
    files = tokenstore.write_shards(docs, path, shard_tokens=1000, partitions=3)
    assert sorted(tuple(r) for r in tokenstore.read_shards(files).collect()) == expected
    out = tokenstore.tokenize(odd, path).collect()
    assert len(out) == odd.count() and sum(r.doc_id is None for r in out) == 3 and {r.start for r in out if r.doc_id is None} >= {0}
    assert tokenstore.tokenize(none, path).count() == 0
