"""URL filters: fixed host and path rules first, then association rules mined from labelled URLs.

A URL becomes a set of tokens (host labels, path segments, endings, query keys; digits folded). FP-growth finds the token
combinations that stand in enough blocked URLs; those whose share of blocked among all labelled URLs reaches a confidence
are the association rules with the consequent "block". Tokens that no labelled URL tells apart are one item, and only the smallest
combinations are rules. Rules match by inverted index: each is posted under its rarest item, a URL looks its items up
there, and a posting fires if all its items are in the URL. Everything is DataFrame and Spark ML code.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import ascii_lower
from tagmill.written import cut

#: Least blocked URLs that a combination stands in, at any size of the table, and least confidence of a rule.
LEAST_URLS, CONFIDENCE = 20, 0.8


class Rule(NamedTuple):
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the production list.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def _rest(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))


def host_and_path(urls: DataFrame) -> DataFrame:
    """``urls`` (with a column url) and its host and path: after the first ``://`` up to ``/``, ``?`` or ``#``; then up to ``?`` or ``#``."""
    rest = F.coalesce(_rest(F.col("url")), F.lit(""))
    return urls.withColumn("host", ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def fitting_rule(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits host and path, or nulls; equal lengths go by order."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        name = F.when(fits, rule.name) if name is None else name.when(fits, rule.name)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def tokens() -> Column:
    """Distinct tokens of the columns url, host and path."""
    said = lambda parts, mark: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&", -1), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(said(F.split("host", r"\.", -1), "h:"), said(F.split(F.lower("path"), r"[/.]", -1), "p:"), said(keys, "q:")))


class Mined(NamedTuple):
    """Association rules that lead to "block": ``rules`` (antecedent: items, confidence, posted_under: an item) and the ``items`` (token, item)."""

    rules: DataFrame
    items: DataFrame


def token_items(baskets: DataFrame, least: int) -> DataFrame:
    """(token, item, bad, good) of the tokens that stand in ``least`` blocked ``baskets`` (has, bad, good): tokens of one set of URLs are one item.

    No URL among the labelled tells such tokens apart, so every rule with one of them holds with any other, and mining
    them singly would only multiply the combinations. Sets are compared by two 64-bit digests and their sizes.
    """
    digest = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "has"))
    tokens_ = baskets.select("*", F.explode("has").alias("token"))
    sets = tokens_.groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("baskets"), digest(1).alias("d1"), digest(2).alias("d2")).filter(F.col("bad") >= least)
    same = ["bad", "good", "baskets", "d1", "d2"]
    return sets.join(sets.groupBy(*same).agg(F.min("token").alias("item")), same).select("token", "item", "bad", "good")


def mine_rules(labelled: DataFrame, confidence: float = CONFIDENCE, least: int = LEAST_URLS) -> Mined | None:
    """The smallest combinations of items that stand in ``least`` blocked URLs and reach ``confidence``; None if there are none.

    ``labelled`` has url and blocked (boolean; null: not learned from); equal and repeated URLs count each; extra columns
    are ignored. An item that reaches the confidence alone is a rule and is mined no further, as nothing longer with it
    can fire where it doesn't. Longer candidates are mined by FP-growth from the blocked URLs alone; the others are only
    counted, under a candidate's rarest item. No labelled URL: no rule.
    """
    known = host_and_path(labelled.filter(F.col("blocked").isNotNull())).select(F.array_sort(tokens()).alias("has"), "blocked").filter(F.size("has") > 0)
    counted = F.sum(F.col("blocked").cast("long")).alias("bad"), F.sum((~F.col("blocked")).cast("long")).alias("good")
    baskets = cut(known.groupBy("has").agg(*counted), "baskets")
    items = cut(token_items(baskets, least), "items")
    if items.isEmpty():
        return None
    alone = items.filter((F.col("token") == F.col("item")) & (F.col("bad") / (F.col("bad") + F.col("good")) >= confidence))
    single = alone.select(F.array("item").alias("antecedent"), (F.col("bad") / (F.col("bad") + F.col("good"))).alias("confidence"), F.col("item").alias("posted_under"))
    open_ = items.join(alone.select("item"), "item", "left_anti")
    held = baskets.select("has", "bad", "good", F.explode("has").alias("token")).join(open_.select("token", "item"), "token")
    held = cut(held.groupBy("has", "bad", "good").agg(F.array_sort(F.collect_set("item")).alias("items")).groupBy("items").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "held")
    bad = held.filter("bad > 0").select("items", F.explode(F.sequence(F.lit(1), F.col("bad").cast("int")))).select("items")  # FP-growth counts rows
    n = bad.count()
    rules = single
    if n:
        # half a URL less, so that rounding can't raise the floor, which is rounded up to whole URLs
        mined = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n)).fit(bad).freqItemsets.filter(F.size("items") > 1)
        mined = cut(mined.select(F.array_sort("items").alias("antecedent"), "freq"), "mined")
        rarity = items.filter("token = item").select("item", (F.col("bad") + F.col("good")).alias("n"))
        posted = mined.select("antecedent", "freq", F.explode("antecedent").alias("item")).join(rarity, "item").groupBy("antecedent", "freq").agg(F.min(F.struct("n", "item")).alias("m"))
        candidates = cut(posted.select("antecedent", "freq", F.col("m.item").alias("posted_under")), "candidates")
        good = held.filter("good > 0").select(F.col("items").alias("has"), "good", F.explode("items").alias("posted_under"))
        met = good.join(candidates, "posted_under").filter(F.size(F.array_except("antecedent", "has")) == 0)
        spared = met.groupBy("antecedent").agg(F.sum("good").alias("spared"))
        scored = candidates.join(spared, "antecedent", "left").withColumn("confidence", F.col("freq") / (F.col("freq") + F.coalesce("spared", F.lit(0))))
        sure = cut(scored.filter(F.col("confidence") >= confidence).select("antecedent", "confidence", "posted_under"), "sure")
        inner = sure.select(F.col("antecedent").alias("part"), "posted_under")
        longer = sure.select("antecedent", F.explode("antecedent").alias("posted_under")).join(inner, "posted_under").filter((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0))
        rules = single.unionByName(sure.join(longer.select("antecedent").distinct(), "antecedent", "left_anti"))
    rules = cut(rules, "rules")
    return None if rules.isEmpty() else Mined(rules, cut(items.select("token", "item"), "token-items"))


def blocked_urls(urls: DataFrame, mined: Mined) -> DataFrame:
    """(url, confidence) of the distinct ``urls`` (url, host, path) for which a mined rule fires, with its best confidence.

    A URL's tokens are looked up as items, its items as rules' rarest ones, and a rule fires if all its items are there.
    Nothing is broadcast by hint: Spark does so if a table's size, which it knows, is under its own threshold. A null
    url has no tokens; equal urls are one row; ties in confidence are one value; extra columns are ignored; empty: empty.
    """
    has = urls.select("url", "host", "path").distinct().select("url", F.explode(tokens()).alias("token")).join(mined.items, "token").groupBy("url").agg(F.collect_set("item").alias("has"))
    looked_up = has.select("url", "has", F.explode("has").alias("posted_under")).join(mined.rules, "posted_under")
    fired = looked_up.filter(F.size(F.array_except("antecedent", "has")) == 0)
    return fired.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: tuple[Rule, ...] = RULES, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    A fixed rule's verdict holds where one fits; else "block" if a mined rule fires, "allow" if none does. A null url, or
    one without ``://``, has empty host and path, no tokens and is allowed. Equal and repeated rows get their row each; a
    null page_id stays null; extra columns are ignored; an empty table gives an empty result.
    """
    mined = mine_rules(labelled, confidence)
    name, verdict = fitting_rule(rules)
    judged = host_and_path(pages.select(F.col("page_id").cast("long").alias("page_id"), "url")).withColumn("rule", name).withColumn("fixed", verdict)
    result = ["page_id", "host", "path", "rule"]
    if mined is None:
        return judged.select(*result, F.coalesce("fixed", F.lit("allow")).alias("verdict"))
    fired = blocked_urls(judged.filter("fixed is null and url is not null"), mined).select("url", F.lit("block").alias("found"))
    return judged.join(fired, "url", "left").select(*result, F.coalesce("fixed", "found", F.lit("allow")).alias("verdict"))


def labels_of_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked) of the pages whose path names a labelled document by number: blocked if its quality is 0 or it is toxic.

    A row for each such page, repeated ones too; a null url or a number beyond 64 bits names none; several labels of a
    document block if one does; null labels say nothing; extra columns are ignored; an empty table gives an empty result.
    """
    bad = F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(bad).alias("blocked"))
    named = host_and_path(pages.select("url")).select("url", F.expr("try_cast(regexp_extract(path, '/([0-9]+)', 1) as bigint)").alias("doc_id"))
    return named.filter("doc_id is not null").join(known, "doc_id").select("url", "blocked")
