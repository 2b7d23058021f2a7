"""op3, op6 and op8 against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from loomframe.llm import exchange, lines, parsing, substrings
from loomframe.llm.textops import window_owner

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def by_bytes(rows, match):
    seen, out = set(), {}
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - match + 1):
            w = b[i : i + match]
            if w in seen:
                gone[i : i + match] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out[doc] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def by_words(rows, window):
    own = [(d, WORDS.findall(t or "")) for d, t in rows]
    count = Counter(tuple(w[i : i + window]) for _, w in own for i in range(len(w) - window + 1))
    out = []
    for d, w in own:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def by_lines(rows, window):
    seen, out = set(), {}
    for d, t in rows:
        own = (t or "").split("\n")
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            w = tuple(own[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        out[d] = (len(own), sum(gone), "\n".join(x for x, g in zip(own, gone) if not g))
    return out


@pytest.mark.parametrize("match, trigger, hot", [(100, 32, 64), (20, 6, 64), (20, 6, 0)])
def test_bytes(docs, rows, match, trigger, hot, monkeypatch):
    monkeypatch.setattr(parsing, "HOT_LOCAL", hot)
    found = parsing.remove_repeated_bytes(docs, match=match, trigger=trigger).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in found} == by_bytes([(r[0], r[1]) for r in rows], match)


def test_later_strings():
    """Entries with a trigger of 2 bytes and strings of 5, against all strings by hand."""
    rng = np.random.default_rng(9)
    entries = []
    for _ in range(300):
        before, after = int(rng.integers(0, 4)), int(rng.integers(0, 4))
        if before + after >= 3:
            entries.append((bytes(rng.choice(list(b"ab"), before).tolist()) + b"XY" + bytes(rng.choice(list(b"ab"), after).tolist()), before))
    size = np.array([len(e) for e, _ in entries])
    rank = rng.permutation(len(entries))
    text = np.frombuffer(b"".join(e for e, _ in entries), np.uint8)
    entry, start = parsing.later_strings(text, np.cumsum(size) - size, size, np.array([b for _, b in entries]), rank, 5, 2)
    seen, expected = set(), []
    for k in np.argsort(rank).tolist():
        for i in range(len(entries[k][0]) - 4):
            word = entries[k][0][i : i + 5]
            if word in seen:
                expected.append((k, i))
        seen |= {entries[k][0][i : i + 5] for i in range(len(entries[k][0]) - 4)}
    assert sorted(zip(entry.tolist(), start.tolist())) == sorted(expected) and expected


def test_common_lengths():
    words = [b"banana", b"band", b"ban", b"can", b""]
    rows = np.zeros((5, 6), np.uint8)
    for k, w in enumerate(words):
        rows[k, : len(w)] = list(w)
    order = parsing.sorted_rows(rows)
    assert [words[k] for k in order] == sorted(words)
    assert parsing.common_lengths(rows, np.array([len(w) for w in words]), order).tolist() == [0, 0, 3, 3, 0]


def test_window_owner():
    keys = np.random.default_rng(1).integers(1 << 63, size=500).astype(np.uint64)
    for width in (1, 2, 7, 100, 500):
        assert window_owner(keys, width).tolist() == [i + int(np.argmin(keys[i : i + width])) for i in range(500 - width + 1)]
    assert len(window_owner(keys, 501)) == 0


def test_bytes_odd(odd, none):
    out = parsing.remove_repeated_bytes(odd)
    assert out.count() == odd.count() and out.filter("doc_id is null").count() == 3
    same = out.filter("doc_id = 3").collect()
    assert len(same) == 3 and len({r.kept_sha256 for r in same}) == 1
    assert parsing.remove_repeated_bytes(none).count() == 0
    with pytest.raises(ValueError):
        parsing.remove_repeated_bytes(none, match=10, trigger=10)


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[k.bit_count() % 2] for k in range(n))


def test_complements_differ(spark):
    """Thue-Morse texts and their complements, which collide under every polynomial hash modulo 2^64, are different."""
    one, two = thue_morse(2048), thue_morse(2048, "b", "a")
    df = lambda *t: spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    found = lines.remove_repeated_lines(df(f"x\n{one}\ny", f"x\n{two}\ny")).collect()
    assert [r.n_removed for r in found] == [0, 0]
    common = " ".join(f"w{k}" for k in range(34))
    rows = [(0, f"{common} {one}"), (1, f"{common} {two}")]
    assert [r.n_removed for r in substrings.remove_repeated_windows(df(*(t for _, t in rows))).collect()] == [0, 0]
    for n, match, trigger in ((64, 100, 32), (2048, 100, 32), (2048, 1200, 1100)):
        rows = [(0, thue_morse(n) * 3), (1, thue_morse(n, "b", "a") * 3), (2, thue_morse(n, "c", "d") + thue_morse(n))]
        found = parsing.remove_repeated_bytes(df(*(t for _, t in rows)), match=match, trigger=trigger).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in found} == by_bytes(rows, match)
    words = thue_morse(64, "p ", "q ")
    rows = [(0, words), (1, thue_morse(64, "q ", "p "))]
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in substrings.remove_repeated_windows(df(*(t for _, t in rows))).collect()) == by_words(rows, 35)


def test_small_pieces(docs, rows, monkeypatch):
    """Texts far longer than what is worked on at a time."""
    from loomframe.llm import textops

    own = [(r[0], r[1]) for r in rows]
    docs = docs.coalesce(1).sortWithinPartitions("doc_id")
    for module, name, size in ((textops, "PIECE", 300), (textops, "SPANS", 7), (parsing, "PIECE", 700), (textops, "LONG", 20)):
        monkeypatch.setattr(module, name, size)
    data = [np.frombuffer((t or "").encode(), np.uint8) for _, t in own]
    offsets = np.append(0, np.cumsum([len(d) for d in data]))
    whole = np.concatenate(data)
    starts, ends, first = textops.word_spans(whole, offsets)
    raw = whole.tobytes()
    assert [[raw[s:e].decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])] == [WORDS.findall(t or "") for _, t in own]
    batch = docs.select("doc_id", "doc_id", "text").toArrow().combine_chunks().to_batches()[0]

    def passed(step, columns=2):
        out = [b for b in step(iter([batch]))]
        return out

    # map tasks and reduce tasks in this process, where the sizes above hold
    import pyarrow as pa

    def blobs(out):
        table = pa.Table.from_batches(out)
        return [table.filter(pa.compute.equal(table["bucket"], k)).combine_chunks().to_batches() for k in range(3)]

    from loomframe.llm import docwork

    found = {}
    parsed = blobs(passed(parsing._parse(100, 32, 3)))
    first_pass = [b for part in parsed for b in parsing._dictionary(iter(part), 3)]
    spans = [r for part in blobs(first_pass) for b in docwork._regroup(iter(part)) for r in b.to_pylist()]
    entries = {}
    for s in spans:
        (entries if s["kind"] == parsing.ENTRY else found).setdefault(s["k_doc"], []).append(s)
    texts = dict(own)
    kind = pa.list_(pa.struct([("first", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("bucket", pa.list_(pa.int32()))]))
    pick = lambda x: [{k: s[k] for k in ("first", "n", "bucket")} for s in x]
    near = pa.RecordBatch.from_arrays([pa.array(list(entries)), pa.array(list(entries)), pa.array([texts[d] for d in entries]), pa.array([pick(x) for x in entries.values()], kind)], names=["k_doc", "k_sub", "text", "spans"])
    sent = list(parsing._entries(100, 3)(iter([near])))
    more = [b for part in blobs(sent) for b in parsing._suffix_order(100, 32, 3)(iter(part))]
    for part in blobs(more):
        for b in docwork._regroup(iter(part)):
            for r in b.to_pylist():
                found.setdefault(r["k_doc"], []).append(r)
    last = pa.RecordBatch.from_arrays([pa.array([d for d, _ in own]), pa.array([d for d, _ in own]), pa.array([t for _, t in own]), pa.array([pick(found.get(d, [])) for d, _ in own], kind)], names=["k_doc", "k_sub", "text", "spans"])
    out = {r["k_doc"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["kept"]) for b in parsing._kept(100, True)(iter([last])) for r in b.to_pylist()}
    # k_sub is the document's id here, so that repeated rows play no part
    assert out == by_bytes(own, 100)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("hot", [64, 0])
def test_repeated_rows_are_one_document(spark, parts, hot, monkeypatch):
    """In one map task and in several, each repeated row gets what its single row gets; null ids too."""
    monkeypatch.setattr(parsing, "HOT_LOCAL", hot)
    rng = np.random.default_rng(5)
    line = lambda: " ".join(f"w{k}" for k in rng.integers(1 << 30, size=6))
    shared = "\n".join(line() for _ in range(5))
    texts = ["\n".join([line(), line(), shared, line(), *[shared] * (k % 2), line(), line()]) for k in range(6)]
    single = [(None, texts[0]), *enumerate(texts[1:], 1)]
    repeated = [r for r in single for _ in range(3)]
    one, many = (spark.createDataFrame(r, "doc_id long, text string").repartition(parts) for r in (single, repeated))
    for run in (parsing.remove_repeated_bytes, lines.remove_repeated_lines):
        expected = [tuple(r) for r in run(one).collect() for _ in range(3)]
        assert sorted(map(repr, (tuple(r) for r in run(many).collect()))) == sorted(map(repr, expected))
    found = {r.doc_id: r for r in lines.remove_repeated_lines(many).collect()}
    assert found[None].n_removed == 0 and found[1].n_removed == 10 and found[2].n_removed == 5


@pytest.mark.parametrize("window, period, cover", [(35, 21, (3, 6, 7, 12, 14)), (9, 7, (1, 2, 4))])
def test_words(docs, rows, window, period, cover):
    found = substrings.remove_repeated_windows(docs, window=window, period=period, cover=cover).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in found) == sorted(by_words([(r[0], r[1]) for r in rows], window))


def test_words_odd(odd, none):
    out = substrings.remove_repeated_windows(odd).collect()
    expected = by_words([(r.doc_id, r.text) for r in odd.collect()], 35)
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in out))) == sorted(map(repr, expected))
    assert substrings.remove_repeated_windows(none).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeated_windows(none, cover=(1, 2))


def test_lines(docs, rows, odd, none):
    found = lines.remove_repeated_lines(docs).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in found} == by_lines([(r[0], r[1]) for r in rows], 3)
    assert lines.remove_repeated_lines(odd).count() == odd.count()
    assert lines.remove_repeated_lines(none).count() == 0


def test_buckets_follow_the_input(spark, docs, rows, tmp_path, monkeypatch):
    """More buckets than shuffle partitions, if the input's files are large, and the same results; blobs of rows enough."""
    at = str(tmp_path / "docs")
    docs.write.parquet(at)
    stored, least = spark.read.parquet(at), exchange.shuffle_partitions(spark)
    assert exchange.buckets(stored) == exchange.buckets(spark.createDataFrame(rows[:3], docs.schema)) == least
    size = exchange._input_bytes(stored)
    assert size > 0 and exchange._input_bytes(stored.crossJoin(stored.select("doc_id").toDF("other"))) == 2 * size
    monkeypatch.setattr(exchange, "BUCKET_BYTES", -(-size // 40))
    assert exchange.buckets(stored) == exchange.buckets(stored.filter("doc_id > 3").select("text")) == 40 > least
    assert exchange.flush_rows(40) == exchange.FLUSH_ROWS and exchange.flush_rows(1 << 17) == 1 << 22
    monkeypatch.setattr(exchange, "MOST_BUCKETS", 25)
    assert exchange.buckets(stored) == max(least, 25)
    found = parsing.remove_repeated_bytes(stored).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in found} == by_bytes([(r[0], r[1]) for r in rows], 100)
    found = substrings.remove_repeated_windows(stored).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in found) == sorted(by_words([(r[0], r[1]) for r in rows], 35))
    found = lines.remove_repeated_lines(stored).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in found} == by_lines([(r[0], r[1]) for r in rows], 3)
