"""URL filters: host and path rules first, then association rules over URL tokens mined by FP-growth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staygauge.llm.columns import free_name, quoted
from staygauge.session import settle

MIN_SUPPORT = 0.001  # share of labelled pages that show a rule and its verdict
MIN_COUNT = 8  # and number of them
MIN_CONFIDENCE = 0.6
MAX_RULES = 10_000  # rules that are broadcast; more of them stay a table and are joined
BLOCK = "=block"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


MinedRules = list[tuple[tuple[str, ...], float, float]]


@dataclass(frozen=True)
class PathRule:
    """A verdict for a host, its subdomains, and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null and where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def path_rule(host: Column, path: Column, rules: list[PathRule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null. Of equally long ones the first by name wins."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url: scheme, labels of the host and their parts, path segments, file ending, query keys, fragment.

    Digits are written as 0, so that numbered pages share their tokens. Null and empty urls have none.
    """
    def tagged(tag: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(tag), F.regexp_replace(F.lower(v), "[0-9]+", "0")))

    rest, host, path = after_scheme(url), host_of(url), path_of(url)
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    scheme = F.when(F.locate("://", url) > 0, F.substring_index(url, "://", 1)).otherwise("")
    return F.array_distinct(F.concat(
        tagged("scheme:", F.array(scheme)), tagged("host:", F.split(host, r"\.")), tagged("part:", F.split(host, "[.-]")),
        tagged("path:", F.split(path, "/")), tagged("ending:", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))),
        tagged("key:", F.transform(F.split(query, "&"), lambda v: F.substring_index(v, "=", 1))),
        tagged("fragment:", F.array(F.when(rest.contains("#"), "yes").otherwise("")))))


def _by_token(rules: DataFrame) -> DataFrame:
    """A row for each rule (tokens, confidence, support), under its token that fewest rules share."""
    each = rules.select("tokens", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = each.join(shared, "token").groupBy("tokens").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    return rules.join(index, "tokens")


def _minimal(rules: DataFrame) -> DataFrame:
    """Without each rule that holds all tokens of another one that is as confident. Shorter rules go first, a size at a time."""
    rest, kept = settle(rules, "url_rules"), rules.limit(0)
    while (size := rest.agg(F.min(F.size("tokens"))).first()[0]) is not None:
        own = settle(rest.filter(F.size("tokens") == size), "url_minimal_rules")
        kept = kept.unionAll(own)
        longer = rest.filter(F.size("tokens") > size)
        part = _by_token(own).select("token", F.col("tokens").alias("part"), F.col("confidence").alias("as_confident"))
        held = (F.col("as_confident") >= F.col("confidence")) & (F.size(F.array_except("part", "tokens")) == 0)
        covered = longer.withColumn("token", F.explode("tokens")).join(part, "token").filter(held).select("tokens").distinct()
        rest = settle(longer.join(covered, "tokens", "left_anti"), "url_rules")
    return settle(kept, "url_minimal_rules")


def mine_rules(
    pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
    min_count: int = MIN_COUNT, max_rules: int = MAX_RULES,
) -> MinedRules | DataFrame:
    """(tokens, confidence, support) of token sets whose labelled pages are mostly bad, from ``pages`` (page_id, url).

    ``labels`` (page_id, bad boolean) are the training rows; a page labelled twice is bad if any row says so. All labelled pages
    are mined. A rule is dropped if a part of its tokens alone is as confident; all others are returned, up to ``max_rules`` of
    them as a list and more as a table. ``min_support`` is a share, so the pages that a rule needs grow with the labelled ones.
    No labelled page, no rule.
    """
    known = labels.select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("boolean").alias("bad"))
    known = known.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    tokens = pages.select(F.col("page_id").cast("long").alias("page_id"), url_tokens(F.col("url").cast("string")).alias("tokens"))
    baskets = settle(tokens.join(known, "page_id").select(
        F.when(F.col("bad"), F.array_append("tokens", F.lit(BLOCK))).otherwise(F.col("tokens")).alias("items")), "url_baskets")
    total = baskets.count()
    if not total:
        return []
    support = min(1.0, max(min_support, min_count / total))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BLOCK))).select(
        F.sort_array("antecedent").alias("tokens"), "confidence", "support")
    best = _minimal(found)
    if best.count() > max_rules:
        return best
    best = best.orderBy(F.desc("confidence"), F.size("tokens"), F.desc("support"), "tokens").collect()
    return [(tuple(r.tokens), r.confidence, r.support) for r in best]


def _matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(of, matched): per url with a fitting rule of a table the tokens of the best one. Rules meet urls under one token."""
    urls = pages.select(F.col("url").cast("string").alias("of")).distinct().withColumn("own", url_tokens(F.col("of")))
    rank = F.struct((-F.col("confidence")).alias("c"), F.size("tokens").alias("n"), (-F.col("support")).alias("s"), "tokens")
    fits = urls.withColumn("token", F.explode("own")).join(_by_token(rules), "token").filter(F.size(F.array_except("tokens", "own")) == 0)
    return fits.groupBy("of").agg(F.min(rank)["tokens"].alias("matched"))


def judge_urls(pages: DataFrame, path_rules: list[PathRule], rules: MinedRules | DataFrame) -> DataFrame:
    """All columns of ``pages`` (page_id, url) with host, path, rule, verdict and matched.

    The longest path rule decides; a url without one is blocked if it holds all tokens of a mined rule, whose tokens are then
    in ``matched``, and allowed else. Null urls and urls without ``://`` have an empty host and path. Input columns named like a
    result are replaced. Every row is judged by itself; an empty table gives none.
    """
    named = pages.drop("host", "path", "rule", "verdict", "matched")
    if isinstance(rules, DataFrame):
        of = free_name(named, "of")
        joined = named.join(_matched(named, rules).withColumnRenamed("of", of), F.col("url").cast("string") == F.col(of), "left")
        return _judged(joined.select(*map(quoted, named.columns), "matched"), path_rules)
    frequency: dict[str, int] = {}
    for tokens, _, _ in rules:
        for t in tokens:
            frequency[t] = frequency.get(t, 0) + 1
    index: dict[str, list[tuple[int, tuple[str, ...]]]] = {}
    for k, (tokens, _, _) in enumerate(rules):  # a rule is listed under its token that fewest rules share
        index.setdefault(min(tokens, key=lambda t: (frequency[t], t)), []).append((k, tokens))
    index = pages.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("array<string>")
    def match(tokens):
        import pandas as pd

        def first(own):
            held = set(own)
            fits = [rule for t in own for rule in index.value.get(t, ()) if held.issuperset(rule[1])]
            return list(min(fits)[1]) if fits else None

        return pd.Series([first(own) if index.value else None for own in tokens], dtype=object)

    return _judged(named.withColumn("matched", match(url_tokens(F.col("url").cast("string")))), path_rules)


def _judged(found: DataFrame, path_rules: list[PathRule]) -> DataFrame:
    url = F.col("url").cast("string")
    name, verdict = path_rule(F.col("host"), F.col("path"), path_rules)
    learned = F.when(F.col("matched").isNotNull(), "block").otherwise("allow")
    found = found.select(*[quoted(c) for c in found.columns if c != "matched"], host_of(url).alias("host"),
                         path_of(url).alias("path"), "matched")
    return found.withColumn("rule", name).withColumn("verdict", F.coalesce(verdict, learned))
