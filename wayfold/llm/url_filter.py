"""URL filters: lists of rules, and beyond them the ratio of two character language models.

URLs that a rule settles are the labelled ones. Over all of them the followers of character contexts are counted, one
smoothed variable-order Markov model for accepted and one for rejected URLs: of a context without followers the longest
suffix with some stands for it. Counts and probabilities are tables, which grow with the URLs, and are joined by string. A URL is accepted if the difference of the two log-likelihoods,
divided by its length, reaches a threshold that is calibrated on the labelled URLs.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.scratch import Scratch

#: (rule, verdict); a rule is a host, then a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none fits."""
    rule = verdict = None
    for r, v in sorted(rules, key=lambda x: (-len(x[0]), x[0])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule = F.when(fits, r) if rule is None else rule.when(fits, r)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


class Markov:
    """Interpolated (Witten-Bell) model over a tree of contexts given as counts of strings: the last character follows the others."""

    def __init__(self, counts: dict[str, int], alphabet: int = 256):
        self.followers: dict[str, dict[str, int]] = defaultdict(dict)
        for s, n in counts.items():
            self.followers[s[:-1]][s[-1]] = n
        self.size = {c: (sum(f.values()), len(f)) for c, f in self.followers.items()}
        self.alphabet, self.known = alphabet, {}

    def log_probability(self, context: str, char: str) -> float:
        while context and context not in self.size:
            context = context[1:]
        key = context + char
        if key not in self.known:
            p = 1 / self.alphabet
            for i in range(len(context), -1, -1):
                c = context[i:]
                if c in self.size:
                    n, kinds = self.size[c]
                    p = (self.followers[c].get(char, 0) + kinds * p) / (n + kinds)
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[key] = math.log(p)
        return self.known[key]


def difference(accepted: Markov, rejected: Markov, text: str, order: int) -> float:
    """Log-likelihood difference for each character; 0 for an empty text."""
    text = f"^{text}$"
    total = 0.0
    for i in range(1, len(text)):
        context = text[max(0, i - order) : i]
        total += accepted.log_probability(context, text[i]) - rejected.log_probability(context, text[i])
    return total / max(1, len(text) - 1)


#: Parts into which the rows of a frequent string are dealt.
PARTS = 8


def _grams(rows: DataFrame, order: int) -> DataFrame:
    """All strings of up to ``order + 1`` characters of ``s`` that end behind its first character, as ``gram``."""
    return rows.select("listed", F.explode(F.expr(f"flatten(transform(sequence(2, length(s)), i -> transform(sequence(1, least(i, {order + 1})), k -> substring(s, i - k + 1, k))))")).alias("gram"))


def _differences(scratch: Scratch, rows: DataFrame, order: int) -> DataFrame | None:
    """``gram, delta``: difference of the log-probabilities of its last character behind the others, for each gram of ``rows``.

    Level by level of length; what a join brings together is at most the followers or the first characters of one string.
    None if a class is empty.
    """
    counted = [F.count(F.when(F.col("listed") == v, 1)).alias(c) for v, c in (("allow", "fa"), ("block", "fb"))]
    t = scratch.keep(_grams(rows, order).groupBy("gram").agg(*counted)).withColumn("size", F.length("gram"))
    sums = [f(c).alias(n) for c in "ab" for f, n in ((lambda c: F.sum(f"f{c}"), f"n{c}"), (lambda c: F.count(F.when(F.col(f"f{c}") > 0, 1)), f"k{c}"))]
    root = t.where("size = 1").agg(*sums).first()
    if not root["na"] or not root["nb"]:
        return None
    own = t.where("size = 1").select("gram", *(((F.col(f"f{c}") + F.lit(root[f"k{c}"] / 256)) / (root[f"n{c}"] + root[f"k{c}"])).alias(f"p{c}") for c in "ab"))
    levels = [scratch.keep(own)]
    for size in range(2, order + 2):
        mine = t.where(F.col("size") == size).withColumns({"context": F.expr(f"substring(gram, 1, {size - 1})"), "shorter": F.expr(f"substring(gram, 2, {size - 1})")})
        totals = mine.groupBy("context").agg(*sums)
        less = levels[-1].select(F.col("gram").alias("shorter"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
        p = lambda c: F.when(F.col(f"n{c}") > 0, (F.col(f"f{c}") + F.col(f"k{c}") * F.col(f"q{c}")) / (F.col(f"n{c}") + F.col(f"k{c}"))).otherwise(F.col(f"q{c}"))
        levels.append(scratch.keep(mine.join(totals, "context").join(less, "shorter").select("gram", p("a").alias("pa"), p("b").alias("pb"))))
    whole = levels[-1]
    for level in levels[1:-1]:
        whole = whole.unionByName(level.where("startswith(gram, '^')"))
    return scratch.keep(whole.select("gram", (F.log("pa") - F.log("pb")).alias("delta")))


def _scored(rows: DataFrame, differences: DataFrame, order: int) -> DataFrame:
    """``row, score``: the mean difference over the characters of ``s``."""
    at = F.expr(f"transform(sequence(2, length(s)), i -> substring(s, greatest(1, i - {order}), least(i, {order + 1})))")
    parts = rows.select("row", F.explode(at).alias("gram")).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int"))
    all_parts = differences.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return parts.join(all_parts, ["gram", "part"]).groupBy("row").agg(F.round(F.avg("delta"), 12).alias("score"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, order: int = 4) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for each row of ``pages``.

    The models hold every string that was counted over all labelled URLs. The whole URL is judged, its host in lower case.
    The threshold is the one that errs least on the labelled URLs of both classes, each weighing the same, in steps of
    0.01. If one of the classes has no URL, there is no ratio, and all others are allowed. A null URL, or one without
    ``://``, has empty host and path and no rule; it is judged by what text it has, a very long one character by character
    as well. Of thresholds that err as little the middle one is taken. Rows with repeated ids or URLs each
    get a result; an empty table gives none. Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "url_filter")
    url = F.col("url")
    a = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    host, path = host_and_path(url)
    a = a.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    at = F.instr(url, "://") + 3
    whole = F.when(F.col("host") != "", F.concat(F.substring(url, F.lit(1), at - 1), "host", F.substring(url, at + F.length("host"), F.length(url)))).otherwise(F.coalesce(url, F.lit("")))
    a = a.withColumns({"rule": rule, "listed": verdict, "s": F.concat(F.lit("^"), whole, F.lit("$")), "row": F.monotonically_increasing_id()})
    a = scratch.keep(a.drop("url"))
    differences = _differences(scratch, a, order)
    if differences is None:
        return a.select("page_id", "host", "path", "rule", F.coalesce("listed", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    out = scratch.keep(a.drop("s").join(_scored(a, differences, order), "row"))
    steps = out.where(F.col("listed").isNotNull()).groupBy("listed", F.floor(F.col("score") * 100).cast("long").alias("step")).agg(F.count("*").alias("n"))
    threshold = calibrated([(r["listed"], r["step"], r["n"]) for r in steps.collect()]) / 100
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score")


def calibrated(steps: list[tuple[str, int, int]]) -> int:
    """The step from which on a score is accepted: the middle of those with the least balanced error."""
    if not steps:
        return 0
    total = {v: sum(n for w, _, n in steps if w == v) or 1 for v in ("allow", "block")}
    best: list[int] = []
    least = math.inf
    for t in range(min(s for _, s, _ in steps), max(s for _, s, _ in steps) + 2):
        error = sum(n / total[v] for v, s, n in steps if (s >= t) != (v == "allow"))
        if error < least - 1e-12:
            least, best = error, []
        if error <= least + 1e-12:
            best.append(t)
    return best[len(best) // 2]
