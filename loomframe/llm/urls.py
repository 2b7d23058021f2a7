"""URL filters: rules by host and path, and for the other urls host word segmentation with naive Bayes.

Host names and paths are taken apart into runs of letters, and each run is split into words by a unigram Viterbi search: the
split with the greatest product of word probabilities, unknown words having a probability that falls with their length.
Word counts come from the text of all pages. The words of host and path are the tokens of a multinomial naive Bayes
classifier, which is trained on all urls that a rule decides, and judges the others. What the rules themselves test, their
hosts' labels and paths' segments, and every url's last label are no tokens: else the classifier would only say the rules again.

Scale: nothing is bounded but the length of a word, and nothing is broadcast that grows. Urls are counted by their
tokens first, runs by theirs; the parts of distinct runs are joined with the whole lexicon by hash, and each run is split where
its known parts arrive. Tokens' odds are summed to runs, and runs' to urls, as whole numbers, so that reruns agree. Joins on
a token or url spread those that hold a thousandth of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, scratch

#: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Letters of the longest word of the language model; longer runs of letters in pages are no words.
LONGEST_WORD = 40
#: Odds are counted in this part of one.
FINE = 1e-9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lowered; path: then up to ``? #`` or the end."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule, written ``host + path``, and its verdict; null if none fits. Of equally long rules the first."""
    name = verdict = None
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.lit(rule_host + rule_path)
        name = F.when(fits, text) if name is None else name.when(fits, text)
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def page_words(html: Column) -> Column:
    """The words of a page's text: lower-case runs of 2 to LONGEST_WORD letters, of any script, outside tags."""
    plain = F.lower(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>", " "))
    return F.regexp_extract_all(plain, F.lit(rf"(?<!\p{{L}})\p{{L}}{{2,{LONGEST_WORD}}}(?!\p{{L}})"), F.lit(0))


def _runs(parts: Column, kind: str, tested: Sequence[str]) -> Column:
    """``kind`` and the letter runs of the parts that no rule tests, in order; ``#`` for the digits of a part."""
    own = F.filter(parts, lambda x: ~x.isin(list(tested))) if tested else parts
    found = lambda x: F.concat(F.regexp_extract_all(x, F.lit(r"\p{L}+"), F.lit(0)), F.when(x.rlike("[0-9]"), F.array(F.lit("#"))).otherwise(F.array().cast("array<string>")))
    return F.transform(F.flatten(F.transform(own, found)), lambda run: F.concat(F.lit(kind + ":"), run))


def tokens(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The runs of the host's labels but its last, as ``h:run``, and of the path's segments, as ``p:run``."""
    labels = F.split(F.regexp_replace(host, r":[0-9]*$", ""), r"\.", -1)
    front = F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0)))
    label_names = sorted({x for _, h, _ in rules for x in h.split(".") if x})
    segment_names = sorted({x for _, _, p in rules for x in p.lower().split("/") if x})
    return _runs(front, "h", label_names), _runs(F.split(F.lower(path), "/", -1), "p", segment_names)


class Segmenter:
    """Unigram Viterbi over ``counts``, out of ``total`` words."""

    def __init__(self, counts: dict[str, int], total: int | None = None, longest: int = LONGEST_WORD):
        total = max(1, sum(counts.values()) if total is None else total)
        self.cost = {w: math.log(total) - math.log(n) for w, n in counts.items()}
        self.unknown, self.longest = math.log(total) + 1.0, longest

    def _cost(self, word: str) -> float:
        found = self.cost.get(word)
        # a letter of an unknown word is as unlikely as one of 26
        return found if found is not None else self.unknown + len(word) * math.log(26)

    def split(self, name: str) -> tuple[str, ...]:
        """The cheapest split; of equal ones that with the longest last words."""
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            cost, begin = min((best[b] + self._cost(name[b:end]), b) for b in range(max(0, end - self.longest), end))
            best.append(cost)
            back.append(begin)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return tuple(reversed(out))


def _parts(longest: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every part of a run that could be a word, once a run, a run at a time."""
        for batch in batches:
            names, parts = [], []
            for name in batch.column(0).to_pylist():
                own = sorted({name[a:b] for a in range(len(name)) for b in range(a + 2, min(len(name), a + longest) + 1)})
                names += [name] * len(own)
                parts += own
                if len(parts) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.string())], names=["run", "word"])
                    names, parts = [], []
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.string())], names=["run", "word"])

    return run


def _split(total: int, longest: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [list(Segmenter({k["word"]: k["n"] for k in known or []}, total, longest).split(name)) for name, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["run", "words"])

    return run


def segmented(runs: DataFrame, lexicon: DataFrame, longest: int = LONGEST_WORD) -> DataFrame:
    """(run, words) of each of the distinct ``runs`` of letters. ``lexicon``: word, n."""
    total = lexicon.agg(F.sum("n")).first()[0] or 0
    parts = cut(runs.select("run").mapInArrow(_parts(longest), "run string, word string"), "url-parts")
    stats = cut(parts.groupBy("word").agg(F.count("*").alias("uses")).join(lexicon, "word"), "url-known")
    known = hot_join(parts, stats, "word", "uses").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return runs.select("run").join(known, "run", "left").select("run", "known").mapInArrow(_split(total, longest), "run string, words array<string>")


def odds_of(allow: int, block: int, size: int) -> Column:
    """Log odds of block of a token that ``allow`` and ``block`` of the tokens of each class are, add-one smoothed, in whole FINE parts.
    ``size``: distinct tokens, and one for all unknown ones."""
    odds = F.log(F.col("block") + F.lit(1.0)) - F.log(F.col("allow") + F.lit(1.0)) + F.lit(math.log(allow + size) - math.log(block + size))
    return F.round(odds / F.lit(FINE)).cast("long")


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, score (log odds of block; null if a rule decides), words
    (the host's words but what rules test, joined by spaces).

    Without a rule the verdict is block if the score is above 0, else allow. A null url, or one without ``://``, has an
    empty host and path and no tokens: it is judged by the share of blocked urls alone. Null ids stay null, repeated rows are judged alike, an
    empty table gives an empty result. Urls and pages may be of any length. Other columns aren't read.
    """
    host, path = host_and_path(F.col(f"`{url_col}`"))
    urls = df.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own, rest = tokens(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "ruled": verdict, "tokens": F.concat(own, rest)}).withColumn("key", F.concat_ws(" ", "tokens"))
    with scratch(df.sparkSession) as keep:
        words = F.explode(page_words(F.col(f"`{html_col}`"))).alias("word")
        lexicon = cut(df.select(words).groupBy("word").agg(F.count("*").alias("n")), "lexicon")
        by = lambda kind: F.count_if(F.col("ruled").eqNullSafe(kind))
        keys = cut(urls.groupBy("key").agg(F.first("tokens").alias("tokens"), F.count("*").alias("size"), by("allow").alias("allow"), by("block").alias("block")), "url-keys")
        each = keys.select("key", "allow", "block", F.posexplode("tokens").alias("at", "token"))
        runs = cut(each.groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.count("*").alias("uses")).withColumn("run", F.substring("token", 3, 1 << 30)), "url-runs")
        letters = runs.filter("run <> '#'").select("run").distinct()
        splits = cut(runs.join(segmented(letters, lexicon), "run", "left").select("token", "uses", "allow", "block", F.posexplode(F.coalesce("words", F.array("run"))).alias("at", "word")).withColumn("part", F.concat(F.substring("token", 1, 2), "word")), "url-words")
        vocabulary = cut(splits.groupBy("part").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.count("*").alias("parts")), "vocabulary")
        sums = vocabulary.agg(F.sum("allow"), F.sum("block"), F.count_if(F.col("allow") + F.col("block") > 0)).first()
        priors = keys.agg(F.sum("allow"), F.sum("block")).first()
        prior = round((math.log((priors[1] or 0) + 1) - math.log((priors[0] or 0) + 1)) / FINE)
        odds = vocabulary.select("part", "parts", odds_of(sums[0] or 0, sums[1] or 0, sums[2] + 1).alias("odds"))
        scored = hot_join(splits, odds, "part", "parts").groupBy("token", "uses").agg(F.sum("odds").alias("odds"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
        scored = cut(scored.select("token", "uses", "odds", F.concat_ws(" ", "words.word").alias("words")), "url-scores")
        hosts = F.when(F.col("token").startswith("h:"), F.struct("at", "words"))
        total = hot_join(each.select("key", "at", "token"), scored, "token", "uses").groupBy("key").agg(F.sum("odds").alias("odds"), F.concat_ws(" ", F.sort_array(F.collect_list(hosts))["words"]).alias("words"))
        judged = keep(cut(keys.select("key", "size").join(total, "key", "left").select("key", "size", (F.coalesce("odds", F.lit(0)) + F.lit(prior)).alias("odds"), F.coalesce("words", F.lit("")).alias("words")), "url-verdicts"))
    score = F.when(F.col("ruled").isNull(), F.round(F.col("odds") * F.lit(FINE), 6))
    verdict = F.coalesce("ruled", F.when(score > 0, F.lit("block")).otherwise("allow"))
    return hot_join(urls.drop("tokens"), judged, "key", "size").select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"), "words")
