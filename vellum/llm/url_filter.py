"""URL filters as Bloom filter cascades.

Rules are a host (it stands for its subdomains too) and the beginning of a path. A URL's keys are those beginnings of
it that have the shape of some rule: so many labels of the host, so many characters of the path. A cascade encodes
which keys of the corpus are listed: level 1 is a Bloom filter of the listed keys that occur, level 2 one of the other
keys that pass level 1, level 3 one of the listed keys that pass level 2, and so on until no key passes wrongly. All
keys of the corpus are tried while it's built, so on them its answers are exact, and judging a URL takes no join.

Scale: keys are deduplicated by a pre-aggregated shuffle; a level's bits are OR-ed on the executors and take about
1.44 * log2(other keys / listed keys) bits a listed key, as a scalar subquery's one value. No filter takes more than
``most_bytes``: a longer list is split by a hash of the key into shards with a cascade each, which judge the URLs one
after the other, so a list of any length is matched by its cascades alone.

Defined cases: a null URL, or one without "://", has an empty host and path; a null page id is kept; repeated rows are
judged each; empty lists match nothing; of two rules of equal length, block wins; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom
from .common import ascii_lower, written

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host with A-Z lower-cased, and the path; both empty without "://"."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, _URL, 1)), F.regexp_extract(url, _URL, 2)


@dataclass
class Cascade:
    """Which keys of a universe are listed."""

    levels: list[Bloom]

    def contains(self, key: Column) -> Column:
        """True where all levels up to an odd one hold the key and the next, if any, doesn't."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].holds(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """universe and listed have a column key: the keys that are asked about, without repeats, and those of them that are listed."""
    r, all_keys = listed.count(), universe.count()
    if not r:
        return Cascade([])
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    rate = min(0.5, math.sqrt(0.5) * r / max(1, all_keys - r))
    levels: list[Bloom] = []
    n = r
    while True:
        levels.append(Bloom.sized(n, rate, seed=len(levels) + 1).built(inside))
        passing = written(outside.where(levels[-1].holds(F.col("key"))), "passing")
        n = passing.count()
        if not n:
            return Cascade(levels)
        inside, outside, rate = passing, inside, 0.5


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards))


def build_cascades(universe: DataFrame, listed: DataFrame, *, most_bytes: int = 64 << 20) -> list[Cascade]:
    """A cascade for each shard of the keys; as many shards as it takes for no filter to be larger than most_bytes."""
    keys = written(universe.select("key").where(F.col("key").isNotNull()).distinct(), "keys")
    inside = written(keys.join(listed.select("key").distinct(), "key", "left_semi"), "listed")
    r, all_keys = inside.count(), keys.count()
    rate = min(0.5, math.sqrt(0.5) * r / max(1, all_keys - r)) if r else 0.5
    shards = max(1, math.ceil(1.1 * Bloom.sized(r, rate).bits / (8 * most_bytes)))
    if shards == 1:
        return [build_cascade(keys, inside)]
    return [build_cascade(*[x.where(shard_of(F.col("key"), shards) == i) for x in (keys, inside)]) for i in range(shards)]


def _shapes(rules: DataFrame) -> list[tuple[str, int, int]]:
    """Different (list, labels, path length) of the rules: what lists look like, a few dozen however long they are."""
    host = F.substring_index("rule", "/", 1)
    labels = F.length(host) - F.length(F.translate(host, ".", "")) + 1
    rows = rules.select("action", labels.alias("labels"), (F.length("rule") - F.length(host)).alias("chars")).distinct().collect()
    return sorted((r["action"], r["labels"], r["chars"]) for r in rows)


def _beginning(host: Column, path: Column, labels: int, chars: int) -> Column:
    """The beginning of a URL with that shape, null if it's shorter."""
    fits = F.length(host) - F.length(F.translate(host, ".", "")) + 1 >= labels
    return F.when(fits & (F.length(path) >= chars) & (host != ""), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars)))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", most_bytes: int = 64 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict for each page.

    rules: rule (host and beginning of a path), action (allow or block); the longest that fits decides. listed: rule;
    URLs that no rule fits are blocked if such an entry fits, else allowed. All lists are one: a key names its list.
    """
    rules = rules.select("rule", "action").where(F.col("rule").isNotNull() & F.col("action").isin("allow", "block"))
    rules = rules.unionByName(listed.select("rule", F.lit("listed").alias("action")).where(F.col("rule").isNotNull()))
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    shapes = _shapes(rules)
    beginnings = [_beginning(F.col("host"), F.col("path"), labels, chars) for _, labels, chars in shapes]
    keys = [F.concat(F.lit(action + " "), x) for (action, _, _), x in zip(shapes, beginnings, strict=True)]
    fit = "array<struct<n:int,action:string,rule:string>>"
    urls = urls.withColumn("fits_", F.array().cast(fit))
    if shapes:
        cascades = build_cascades(urls.select(F.explode(F.array(*keys)).alias("key")), rules.select(F.concat("action", F.lit(" "), "rule").alias("key")), most_bytes=most_bytes)
        for i, cascade in enumerate(cascades):
            holds = [cascade.contains(k) & (shard_of(k, len(cascades)) == i) for k in keys]
            found = [F.when(h, F.struct(F.length(x).alias("n"), F.lit(action).alias("action"), x.alias("rule"))) for h, x, (action, _, _) in zip(holds, beginnings, shapes, strict=True)]
            urls = urls.withColumn("fits_", F.concat("fits_", F.array_compact(F.array(*found)).cast(fit)))
            if i + 1 < len(cascades):  # one shard's filters at a time
                urls = written(urls, "judged")
    urls = urls.withColumn("best_", F.array_max(F.filter("fits_", lambda x: x["action"] != "listed")))
    on_list = F.exists("fits_", lambda x: x["action"] == "listed")
    verdict = F.when(F.col("best_").isNotNull(), F.col("best_.action")).when(on_list, "block").otherwise("allow")
    return urls.select("page_id", "host", "path", F.col("best_.rule").alias("rule"), verdict.alias("verdict"))
