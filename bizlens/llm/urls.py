"""URL filters: Bloom filter cascades over the corpus's own keys.

A key is a host (or a domain it belongs to) followed by a path prefix. For a list
of keys, level 0 is a Bloom filter of the listed keys; level 1 holds the keys of
the corpus that level 0 lets through wrongly, level 2 the listed keys that level
1 lets through, and so on until a level has no false positive left among the
keys it must turn away. As every key of the corpus took part, walking the levels
gives exact membership, and judging a url needs no join: the levels travel in the
plan, some bits per listed key.

Rules come first: of a url's keys that a rule lists, the longest decides. Without
one, the method decides: a url whose host or a parent domain is listed (its key
is the host with an empty path) is blocked, any other allowed.

Only DataFrame functions are used. Defined cases: a null url or one without
``://`` has an empty host and path and is allowed (an empty host is never listed);
repeated urls are judged one by one; an empty list or table gives filters that
let nothing through; rules of equal length that fit one url: the longer host
first; other columns are ignored.

A list of more than ``max_keys`` keys is dealt into shards by hash, each with its
own cascade and pass over the keys of the urls, so that a filter stays bounded.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.common import cut_lineage, table

#: (host, path, verdict): the rules of the contract.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: First labels of unwanted sites; a host of the corpus with one of them is listed.
UNWANTED = ("ads-track", "casino-win", "spam-farm", "adult-x", "cheap-pills", "free-bets")
#: Listed keys per cascade: at most 43 bits each at level 0, so some 6 MB.
MAX_KEYS = 1_000_000
#: Share of wrong keys that levels after the first let through.
LATER_FPP = 1 / 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)([^?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)([^?#]*)", 2), F.lit(""))
    return F.translate(found, _UPPER, _LOWER), path


def domains(host: Column) -> Column:
    """The host and what follows each of its dots, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every key of a url whose path part has one of the lengths, longest first."""
    def with_prefix(n: int) -> Column:
        prefix = F.substring(path, 1, n)
        key = lambda d: F.struct(
            (F.length(d) + n).alias("n"), F.length(d).alias("h"), F.concat(d, prefix).alias("key")
        )
        return F.transform(domains(host), lambda d: F.when(F.length(path) >= n, key(d)))

    pairs = [with_prefix(n) for n in path_lengths]
    every = F.filter(F.concat(*pairs), lambda x: x.isNotNull())
    return F.transform(F.sort_array(every, asc=False), lambda x: x["key"])


def _places(key: Column, level: int, hashes: int, bits: int) -> Column:
    return F.array(
        *[F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits).cast("long")) for i in range(hashes)]
    )


class Level:
    """One Bloom filter, carried in the plan as a binary literal with seven bits a
    byte (so that a byte is an ASCII character). Its size is bounded by max_keys."""

    def __init__(self, members: DataFrame, number: int, count: int, fpp: float) -> None:
        self.number = number
        self.hashes = max(1, math.ceil(math.log2(1 / fpp)))
        self.bits = max(64, math.ceil(count * self.hashes / math.log(2)))
        places = F.explode(_places(F.col("key"), number, self.hashes, self.bits))
        words = (
            members.select(places.alias("p"))
            .groupBy(F.expr("p div 7").alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1, cast(p % 7 as int))")).alias("v"))
        )
        filled = bytearray(self.bits // 7 + 1)
        for r in words.collect():  # at most bits / 7 rows
            filled[r.w] = r.v
        self.filter = F.lit(bytes(filled))

    def has(self, key: Column) -> Column:
        def bit(p: Column) -> Column:
            byte = F.substring(self.filter, (F.floor(p / 7) + 1).cast("int"), F.lit(1))
            mask = F.call_function("shiftleft", F.lit(1), (p % 7).cast("int"))
            return F.ascii(byte.cast("string")).bitwiseAND(mask) != 0

        return F.forall(_places(key, self.number, self.hashes, self.bits), bit)


class Cascade:
    """Exact membership of a list among the keys of a universe."""

    def __init__(self, listed: DataFrame, universe: DataFrame) -> None:
        """Both frames have one column ``key`` with distinct, non-null values."""
        self.levels: list[Level] = []
        inside = cut_lineage(listed)
        n_in, n_all = inside.count(), universe.count()
        if not n_in:
            return
        fpp = min(0.5, max(n_in / max(1, n_all), 2.0**-30))
        mine, n_mine, others = inside, n_in, None
        while n_mine:
            level = Level(mine, len(self.levels), n_mine, fpp if not self.levels else LATER_FPP)
            self.levels.append(level)
            if others is None:
                others = universe.join(inside, "key", "left_anti")
            wrong = cut_lineage(others.where(level.has(F.col("key"))))
            mine, others, n_mine = wrong, mine, wrong.count()

    def has(self, key: Column) -> Column:
        """Level 0 lets all listed keys through; what level 1 then turns away is
        listed, what level 2 then turns away is not, and so on."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(level.has(key), answer).otherwise(F.lit(level.number % 2 == 1))
        return answer


def _members(universe: DataFrame, listed: DataFrame, max_keys: int) -> list[tuple[Column, Cascade]]:
    """(shard condition over ``key``, its cascade) for each shard of the list."""
    n = listed.count()
    shards = max(1, -(-n // max_keys))
    out = []
    for s in range(shards):
        of = lambda key, s=s: F.pmod(F.xxhash64(key), F.lit(shards)) == s
        out.append((of, Cascade(listed.where(of(F.col("key"))), universe.where(of(F.col("key"))))))
    return out


def _listed(shards: list, key: Column) -> Column:
    if len(shards) == 1:
        return shards[0][1].has(key)
    return reduce(lambda a, b: a | b, [of(key) & c.has(key) for of, c in shards])


def judge(
    pages: DataFrame,
    rules: DataFrame,
    listed: DataFrame,
    max_keys: int = MAX_KEYS,
) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every url. ``rules``: host, path,
    verdict; ``listed``: host of sites that the method blocks."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = rules.select("verdict", F.length("path").alias("n"), F.concat("host", "path").alias("key"))
    lengths = [r.n for r in rules.select("n").distinct().collect()]  # at most a path's length
    places = seen.select("host", "path").distinct()
    universe = places.select(F.explode(keys(F.col("host"), F.col("path"), lengths or [0])).alias("key"))
    universe = cut_lineage(universe.where("key <> ''").distinct())
    allow, block = (
        _members(universe, rules.where(F.col("verdict") == v).select("key").distinct(), max_keys)
        for v in ("allow", "block")
    )
    hosts = cut_lineage(places.select(F.explode(domains(F.col("host"))).alias("key")).where("key <> ''").distinct())
    sites = _members(hosts, listed.select(F.col("host").alias("key")).where("key <> ''").distinct(), max_keys)

    candidates = F.filter(keys(F.col("host"), F.col("path"), lengths or [0]), lambda k: k != "")
    rule = F.get(
        F.filter(
            F.transform(
                candidates,
                lambda k: F.struct(
                    k.alias("key"),
                    F.when(_listed(block, k), "block").when(_listed(allow, k), "allow").alias("verdict"),
                ),
            ),
            lambda x: x["verdict"].isNotNull(),
        ),
        F.lit(0),
    )
    site = F.exists(F.filter(domains(F.col("host")), lambda d: d != ""), lambda d: _listed(sites, d))
    return (
        seen.withColumn("found", rule)
        .withColumn("listed", site)
        .select(
            "page_id", "host", "path", F.col("found.key").alias("rule"),
            F.coalesce("found.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
            "listed",
        )
    )


def unwanted_sites(pages: DataFrame, labels: tuple[str, ...] = UNWANTED) -> DataFrame:
    """The hosts and domains of the corpus that begin with one of the labels."""
    host, _ = host_and_path(F.col("url"))
    names = pages.select(host.alias("host")).distinct().select(F.explode(domains(F.col("host"))).alias("host"))
    return names.where(F.substring_index("host", ".", 1).isin(*labels)).distinct()


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")
    return judge(pages, rules, unwanted_sites(pages))


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path,
    row_number() OVER () AS r
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
    ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY r),
judged AS (
  SELECT *, regexp_matches(host, '(^|\.)(ads-track|casino-win|spam-farm|adult-x|cheap-pills|free-bets)(\.|$)') AS listed
  FROM parts LEFT JOIN fits USING (r))
SELECT page_id, host, path, rule,
  coalesce(rule_verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM judged
"""
