"""URL filter: rules first, then naive Bayes over the words that host names and paths are made of.

A unigram model of words, counted over the pages' visible text, splits concatenated names by Viterbi search.
Multinomial naive Bayes is trained on the tokens of all urls that a rule decides, with their share of block as
the prior and a smoothing that is chosen on a tenth of them held out, and judges those that no rule does. Tokens
that rules themselves test (top-level labels and rule path segments) are left out: with them the classifier would
only repeat the rules. Blocking needs odds of ``odds`` to one.

A short list of web words joins the word model with a small share of its words, so that common names can be
split, and each listed word of BAD counts as one more token of a blocked url. That is all it does: any word that
training holds a few times outweighs it.

Nothing here is bounded by a cap. Each distinct name meets the counts of its own substrings in a join, so no
lexicon is broadcast and no word is too rare; the tokens of all urls meet their odds in another. Both are joins on
exchanged sides, whose hot keys adaptive execution splits. Only sums reach the driver.

Defined results: null urls and urls without ``://`` have empty host and path; a url without a token has the prior's
odds; a token that training lacks has those of a word never seen; repeated rows, rows without a page_id and pages
without text count like others; with no ruled url of either class nothing is blocked. Of rules of equal length only
one can fit a url.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import lean, small_batches, stored

#: Words of web names. Those in BAD start with one count for the class block.
GOOD = "blog news shop store home page index wiki forum mail help support docs data open school media music photo video travel health sport science tech code cloud book art city www example".split()
BAD = "casino win bet poker porn xxx sex adult spam farm ads ad track tracker click pill viagra loan crack warez torrent cheap bonus lottery jackpot malware phish".split()
LONGEST = 20
SMOOTHING = (0.05, 0.2, 0.5, 1.0, 2.0)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that queries apply.
RULES = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def word_counts(pages: DataFrame) -> DataFrame:
    """(w, n) of the words of 2 to 20 letters in the pages' visible text."""
    text = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " "))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("w")).filter(F.length("w").between(2, LONGEST))
    return words.groupBy("w").agg(F.count("*").alias("n"))


def with_listed(counts: DataFrame, total: int, words: list[str]) -> DataFrame:
    """``counts`` with the listed ``words``, each at least as frequent as one word in 2,000."""
    extra = max(1, total // 2000)
    listed = counts.sparkSession.createDataFrame([(w, extra) for w in words], "w string, n long")
    return counts.union(listed).groupBy("w").agg(F.max("n").alias("n"))


def split(name: str, counts: dict[str, int], total: int) -> list[tuple[str, bool]]:
    """The likeliest words that make up ``name``, and whether each is known; unknown stretches cost more the longer they are.

    ``counts`` needs to hold the name's own substrings only. Of equal costs the one whose last word is shortest counts.
    """
    total += 1000
    unknown = math.log(total)
    best, cut = [0.0], [0]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            n = counts.get(name[start:end])
            options.append((best[start] + (math.log(total / n) if n else unknown + 2.3 * (end - start)), -start))
        cost, start = min(options)
        best.append(cost)
        cut.append(-start)
    out, end = [], len(name)
    while end:
        part = name[cut[end] : end]
        out.append((part, part in counts))
        end = cut[end]
    return out[::-1]


def names_of(urls: DataFrame, skip: list[str]) -> DataFrame:
    """(id, side, name): runs of letters of the host without its last label, and of the path without the segments ``skip``.

    Runs of digits are named <num>.
    """
    labels = F.split("host", r"\.")
    labels = F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0)))
    segments = F.filter(F.split(F.lower("path"), "/"), lambda x: ~x.isin(skip)) if skip else F.split(F.lower("path"), "/")
    runs = lambda parts: F.flatten(F.transform(parts, lambda x: F.regexp_extract_all(x, F.lit(r"(\p{L}+|\p{Nd}+)"), F.lit(1))))
    sided = lambda side, parts: F.transform(runs(parts), lambda x: F.struct(F.lit(side).alias("side"), F.when(x.rlike(r"^\p{Nd}"), "<num>").otherwise(F.lower(x)).alias("name")))
    return urls.select("id", F.explode(F.concat(sided("h", labels), sided("p", segments))).alias("x")).select("id", "x.side", "x.name")


def segmented(names: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(name, words): the words of each distinct name, unknown ones as <other>."""
    small_batches(names.sparkSession)
    names = names.filter("name <> '<num>'").select("name").distinct()
    n = F.length("name")
    starts = F.sequence(F.lit(1), n)
    subs = F.flatten(F.transform(starts, lambda a: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), n - a + 1)), lambda k: F.substr(F.col("name"), a, k))))
    found = names.select("name", F.explode(F.array_distinct(subs)).alias("w")).join(counts, "w")
    found = found.groupBy("name").agg(F.collect_list("w").alias("w"), F.collect_list("n").alias("n"))
    rows = names.join(found, "name", "left")

    def run(batches):
        for b in batches:
            out = []
            for name, w, k in zip(*(c.to_pylist() for c in b.columns)):
                out.append([x if known else "<other>" for x, known in split(name, dict(zip(w or (), k or ())), total)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    return rows.select("name", "w", "n").mapInArrow(lean(run), "name string, words array<string>")


def tokens_of(names: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(id, token, n): how often each token comes up in a url."""
    words = F.explode(F.coalesce("words", F.array("name")))
    rows = names.join(segmented(names, counts, total), "name", "left").select("id", "side", words.alias("w"))
    return rows.groupBy("id", F.concat_ws(":", "side", "w").alias("token")).agg(F.count("*").alias("n"))


def _class_sums(counts: DataFrame) -> tuple[int, int, int]:
    """Tokens of allowed and of blocked urls, and distinct tokens."""
    r = counts.agg(F.sum("allow"), F.sum("block"), F.count("*")).first()
    return r[0] or 0, r[1] or 0, r[2]


def _log_odds(sums: tuple[int, int, int], smoothing: float, allow, block) -> Column:
    """Of block against allow, of one token; tokens never seen count as one more kind."""
    of = lambda n, size: F.log(n + smoothing) - F.log(F.lit(size + smoothing * (sums[2] + 1)))
    return of(block, sums[1]) - of(allow, sums[0])


def token_counts(tokens: DataFrame, verdicts: DataFrame, bad: list[str] = BAD) -> DataFrame:
    """(token, allow, block) over the urls of ``verdicts`` (id, verdict); each word of ``bad`` once more in block."""
    spark = tokens.sparkSession
    rows = tokens.join(verdicts, "id").select("token", *(F.when(F.col("verdict") == v, F.col("n")).otherwise(F.lit(0)).cast("long").alias(v) for v in ("allow", "block")))
    listed = spark.createDataFrame([(f"{side}:{w}", 0, 1) for w in bad for side in "hp"], "token string, allow long, block long")
    return rows.union(listed).groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


def scored(tokens: DataFrame, counts: DataFrame, smoothings: tuple[float, ...]) -> DataFrame:
    """(id, s0, s1, ...): each url's log odds, without the prior, for each smoothing."""
    sums = _class_sums(counts)
    rows = tokens.join(counts, "token", "left")
    allow, block = (F.coalesce(c, F.lit(0)) for c in ("allow", "block"))
    return rows.groupBy("id").agg(*(F.sum(F.col("n") * _log_odds(sums, a, allow, block)).alias(f"s{k}") for k, a in enumerate(smoothings)))


def _prior(verdicts: DataFrame) -> float | None:
    """Log odds of block among ruled urls; none if a class is empty."""
    n = {r["verdict"]: r["n"] for r in verdicts.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    return math.log(n["block"] / n["allow"]) if len(n) == 2 else None


def chosen_smoothing(tokens: DataFrame, verdicts: DataFrame, bad: list[str] = BAD) -> float:
    """The smoothing under which a held-out tenth of the ruled urls is likeliest, learned from the others."""
    held = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(10)) == 0
    prior = _prior(verdicts.filter(~held))
    if prior is None:
        return 1.0
    got = scored(tokens.join(verdicts.filter(held), "id", "left_semi"), token_counts(tokens, verdicts.filter(~held), bad), SMOOTHING).join(verdicts, "id")
    sign = F.when(F.col("verdict") == "block", 1.0).otherwise(-1.0)
    # log of the class's probability, 1 / (1 + e^-x), without overflow
    right = lambda x: -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))
    r = got.agg(*(F.sum(right(sign * (F.col(f"s{k}") + prior))) for k in range(len(SMOOTHING)))).first()
    return max((x, a) for x, a in zip(r, SMOOTHING))[1] if r[0] is not None else 1.0


def judge(pages: DataFrame, rules: list[Rule] = RULES, odds: float = 4.0, good: list[str] = GOOD, bad: list[str] = BAD) -> DataFrame:
    """(page_id, host, path, rule, verdict, log_odds) for every row of ``pages``."""
    counts = stored(word_counts(pages), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    urls = pages.select(F.monotonically_increasing_id().alias("id"), pages["page_id"], host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    urls = stored(urls.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)), "urls")  # ids stay as written
    skip = sorted({x for r in rules for x in r.path.lower().split("/") if x})
    tokens = stored(tokens_of(names_of(urls, skip), with_listed(counts, total, [*good, *bad]), total), "tokens")
    verdicts = urls.filter("found IS NOT NULL").select("id", "found.verdict")
    prior = _prior(verdicts)
    smoothing = chosen_smoothing(tokens, verdicts, bad)
    score = scored(tokens, token_counts(tokens, verdicts, bad), (smoothing,))
    out = urls.join(score, "id", "left")
    log_odds = F.lit(0.0) if prior is None else F.coalesce("s0", F.lit(0.0)) + prior
    verdict = F.coalesce("found.verdict", F.when(log_odds >= math.log(odds), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), log_odds.alias("log_odds"))
