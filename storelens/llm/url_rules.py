"""Operator 8: URL filtering by listed rules and mined token associations, in DataFrame functions only.

Listed rules (host, path, verdict) are looked up by host: a url's host and all
its parent domains are tried, the path must start with the rule's, the longest
rule wins. Where none fits, mined rules decide. They are association rules
"these url tokens, so this label" from an FP-growth over labelled urls, kept
above a confidence and a support and dropped where a shorter rule says the same
at least as surely. An inverted index lists for each token the rules it is part
of; a rule fires where all its tokens were counted. A url for which a block rule
fires is blocked, any other allowed.

An itemset tree doubles with each token of a url, so FP-growth is bounded before
it starts: by the `vocabulary` surest frequent tokens and, of each url, the
`width` surest of those (share of blocked urls, then number of urls, then name).
Where these bounds would leave a token out, `whole` mining counts level by level
instead: sets of one token, of two, of three, over every token of every url, as
many as the third power of a url's length at most. Rules have at most `longest`
tokens. All are parameters of mine(); supports and confidences count every
labelled url, and matching reads every token of a url.

The host stands after the first "://" up to "/", "?", "#" or the end, A-Z
lower-cased; the path follows up to "?" or "#". A null url and one without
"://" has an empty host and path, no rule and no token, and is allowed; line
ends are characters as any other. Repeated rows are judged alike, and each counts
in mining. A kept column with the name of an added one (`host`, `path`, `rule`,
`mined`, `verdict`) gets `_kept` behind its name. A null label is no label, an
empty table of labels gives no rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import checkpointed, kept_names

# Listed rules as host + path; the verdicts are the contract's.
LISTED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SUPPORT = 0.002
CONFIDENCE = 0.8
# Tokens of a rule, tokens of one url that are mined, and tokens that are mined at all.
LONGEST = 3
WIDTH = 10
VOCABULARY = 1000
LABEL = "label=block"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, UPPER.lower()), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: parent domains, host labels, path segments with digits made one, parameter names."""
    labels = F.filter(F.split(host(url), r"\."), lambda x: x != "")
    shape = lambda x: F.regexp_replace(x, r"\d+", "0")
    segments = F.filter(F.split(path(url), "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    found = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host="), shape(x))),
        F.transform(segments, lambda x: F.concat(F.lit("path="), shape(x))),
        F.transform(names, lambda x: F.concat(F.lit("query="), x)),
        F.array(F.concat(F.lit("scheme="), scheme)),
    )
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    return F.when(there, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def listed_rule(host_name: Column, path_name: Column, rules=LISTED) -> Column:
    """The longest fitting rule as host + path, or null."""
    by_host: dict[str, list] = {}
    for rule_host, rule_path, _ in rules:
        by_host.setdefault(rule_host, []).append(rule_path)
    if not by_host:
        return F.lit(None).cast("string")
    index = F.create_map(*chain.from_iterable((F.lit(h), F.array(*map(F.lit, sorted(p)))) for h, p in sorted(by_host.items())))
    labels = F.split(host_name, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.flatten(
        F.transform(
            parents,
            lambda h: F.transform(
                F.filter(F.coalesce(index[h], F.array().cast("array<string>")), lambda p: F.startswith(path_name, p)),
                lambda p: F.concat(h, p),
            ),
        )
    )
    # Of rules of one length (a longer host, a shorter path) the greater text, so the answer is one.
    best = F.array_max(F.transform(fitting, lambda r: F.struct(F.char_length(r).alias("n"), r.alias("rule"))))
    return best["rule"]


@dataclass(frozen=True)
class Mined:
    """A combination of tokens that says "block", with the share of such urls that were and of all labelled ones."""

    tokens: tuple[str, ...]
    confidence: float
    support: float


def verdict_of(rule: Column, listed=LISTED) -> Column:
    """The verdict of a listed rule; null for a null one."""
    if not listed:
        return F.lit(None).cast("string")
    return F.create_map(*chain.from_iterable((F.lit(h + p), F.lit(v)) for h, p, v in listed))[rule]


def listed_labels(pages: DataFrame, url: str = "url", listed=LISTED) -> DataFrame:
    """Every url with `blocked`: whether a listed rule blocks it; a url without one is not blocked."""
    rule = listed_rule(host(F.col(url)), path(F.col(url)), listed)
    return pages.select(F.col(url), F.coalesce(verdict_of(rule, listed) == "block", F.lit(False)).alias("blocked"))


def mine(
    labelled: DataFrame, url: str = "url", blocked: str = "blocked", support: float = SUPPORT, confidence: float = CONFIDENCE,
    longest: int = LONGEST, width: int = WIDTH, vocabulary: int = VOCABULARY, whole: bool = False,
) -> list[Mined]:
    """Rules of the labelled urls, of at most `longest` tokens each.

    An itemset must hold a share of `support` of all rows with a token. With `whole`, no token is left out: where
    `width` or `vocabulary` would leave one out, sets are counted by levels. Without, the driver holds only what these
    parameters bound: `vocabulary` tokens, and no more rules than itemsets that `width` and `support` allow.
    """
    rows = labelled.where(F.col(blocked).isNotNull()).select(F.col(blocked).alias("blocked"), tokens(F.col(url)).alias("tokens")).where(F.size("tokens") > 0)
    # Equal sets of tokens become one row before they are taken apart, so a hot url is counted once.
    sets = rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("n_blocked"))
    counted = sets.select(F.explode("tokens").alias("token"), "n", "n_blocked").groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_blocked").alias("n_blocked"))
    look = sets.agg(F.sum("n").alias("rows"), F.max(F.size("tokens")).alias("most")).first()
    total = look["rows"] or 0
    frequent = counted.where(F.col("n") >= math.ceil(support * total))
    if whole and total and (look["most"] > width or frequent.count() > vocabulary):
        return _shortest(_by_levels(sets, counted, total, max(1, math.ceil(support * total)), confidence, longest))
    surest = frequent.orderBy(F.desc(F.col("n_blocked") / F.col("n")), F.desc("n"), "token").limit(vocabulary)
    names = [r["token"] for r in surest.collect()]
    if not names:
        return []
    # The intersection keeps the order of its first list, the surest token first.
    chosen = F.slice(F.array_intersect(F.array(*map(F.lit, names)), F.col("tokens")), 1, width)
    items = rows.select(F.when(F.col("blocked"), F.array_append(chosen, F.lit(LABEL))).otherwise(chosen).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    says = model.associationRules.where(F.element_at("consequent", 1) == LABEL).where(F.size("antecedent") <= longest)
    return _shortest([Mined(tuple(sorted(r["antecedent"])), r["confidence"], r["support"]) for r in says.collect()])


def _shortest(found: list[Mined]) -> list[Mined]:
    """The rules of which no part says the same at least as surely."""
    sure = {rule.tokens: rule.confidence for rule in found}
    shorter = lambda rule: (part for n in range(1, len(rule.tokens)) for part in combinations(rule.tokens, n))
    kept = [rule for rule in found if not any(sure.get(part, -1.0) >= rule.confidence for part in shorter(rule))]
    return sorted(kept, key=lambda r: (len(r.tokens), r.tokens))


def _by_levels(sets: DataFrame, counted: DataFrame, total: int, least: int, confidence: float, longest: int) -> list[Mined]:
    """All rules of at most `longest` tokens that a part does not already say by having the same urls or no other than blocked ones.

    A set in `least` blocked urls has only parts that are, so each level extends the sets of the one before. A set
    without a url less than one of its parts, or without an allowed url, is not extended: whatever holds it has a
    shorter rule that is at least as sure.
    """
    found: list[Mined] = []

    def rules(level: DataFrame) -> None:
        sure = level.where(F.col("n_blocked") / F.col("n") >= confidence)
        found.extend(Mined(tuple(r["part"]), r["n_blocked"] / r["n"], r["n_blocked"] / total) for r in sure.collect())

    level = checkpointed(counted.where(F.col("n_blocked") >= least).select(F.array("token").alias("part"), "n", "n_blocked"))
    rules(level)
    extended = level.where((F.col("n_blocked") < F.col("n")) & (F.col("n") < total))
    own = sets.select("tokens", "n", "n_blocked", F.explode("tokens").alias("token"))
    own = own.join(extended.select(F.col("part")[0].alias("token")), "token")
    own = own.groupBy("tokens").agg(F.array_sort(F.collect_list("token")).alias("own"), F.first("n").alias("n"), F.first("n_blocked").alias("n_blocked"))
    inside = own.groupBy("own").agg(F.sum("n").alias("n"), F.sum("n_blocked").alias("n_blocked"))
    inside = checkpointed(inside.select("own", "n", "n_blocked", F.explode(F.transform("own", lambda t: F.array(t))).alias("part")))
    for size in range(2, longest + 1):
        more = F.filter("own", lambda t: t > F.element_at("part", -1))
        inside = inside.withColumn("_token", F.explode(more)).withColumn("part", F.array_append("part", F.col("_token"))).drop("_token")
        level = inside.groupBy("part").agg(F.sum("n").alias("n"), F.sum("n_blocked").alias("n_blocked")).where(F.col("n_blocked") >= least)
        before = extended.select(F.col("part").alias("_part"), F.col("n").alias("_n"))
        level = level.join(before, F.slice("part", 1, size - 1) == F.col("_part")).where(F.col("n") < F.col("_n"))
        level = checkpointed(level.select("part", "n", "n_blocked"))
        rules(level)
        extended = level.where(F.col("n_blocked") < F.col("n"))
        inside = inside.join(extended.select("part"), "part")
    return found


def fired(found: Column, rules: list[Mined]) -> Column:
    """Numbers of the mined rules all of whose tokens are among `found`, by an inverted index."""
    if not rules:
        return F.array().cast("array<int>")
    index: dict[str, list[int]] = {}
    for number, rule in enumerate(rules):
        for token in rule.tokens:
            index.setdefault(token, []).append(number)
    lists = F.create_map(*chain.from_iterable((F.lit(t), F.array(*map(F.lit, n))) for t, n in sorted(index.items())))
    sizes = F.array(*(F.lit(len(r.tokens)) for r in rules))
    met = F.flatten(F.transform(found, lambda t: F.coalesce(lists[t], F.array().cast("array<int>"))))
    count = lambda n: F.size(F.filter(met, lambda m: m == n))
    return F.filter(F.array_distinct(met), lambda n: count(n) == F.get(sizes, n))


ADDED = ("host", "path", "rule", "mined", "verdict")


def judged(pages: DataFrame, rules: list[Mined], keep: list[str], url: str = "url", listed=LISTED) -> DataFrame:
    """`keep` columns, `host`, `path`, `rule`, `mined` (numbers of the mined rules that fired) and `verdict`."""
    # Kept columns and the url travel as one each, so that none of their names can clash.
    kept = F.struct(*keep) if keep else F.struct(F.lit(1).alias("_"))
    parts = pages.select(kept.alias("_keep"), F.col(url).alias("_url"))
    parts = parts.withColumns({"host": host(F.col("_url")), "path": path(F.col("_url"))})
    parts = parts.withColumns({"rule": listed_rule(F.col("host"), F.col("path"), listed), "mined": fired(tokens(F.col("_url")), rules)})
    mined = F.when(F.size("mined") > 0, "block").otherwise("allow")
    parts = parts.withColumn("verdict", F.coalesce(verdict_of(F.col("rule"), listed), mined))
    return parts.select(*(F.col("_keep")[c].alias(name) for c, name in kept_names(keep, list(ADDED)).items()), *ADDED)
