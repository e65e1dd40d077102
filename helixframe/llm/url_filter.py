"""URL filters by a cascade of Bloom filters, in DataFrame operations only.

A rule names a host (with its subdomains) and a path prefix.  Each url yields one
candidate key for every shape (labels of the host, length of the path) that the rules
have, so it is decided by exact membership of its candidate keys among the listed keys.
That is what the cascade answers without a join: level 1 encodes the listed keys,
level 2 the keys of the whole corpus that level 1 takes for listed by mistake, level 3 the
listed keys that level 2 takes for such, and so on until no mistake is left; a key is
listed if the first level that doesn't hold it is an even one.  Sized by the number of keys
in the corpus, the cascade needs O(log2(keys / listed)) bits for each listed key.

Filters are data, not literals: a level is an array of 64-bit words, all levels are one row of a
stored table, which is broadcast.  Its size is known beforehand; where it would be over ``MAX_WORDS``, keys are dealt by a hash
into parts with a cascade each, and the table goes through them one after another.

Edge cases: a null url, or one without ``://``, has an empty host and path and no rule;
repeated pages are judged each; no rules: all is allowed; a rule listed as both is a block; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, saved, table

#: (host, path prefix, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Most 64-bit words of a cascade's first level; all levels together have about twice as many.
MAX_WORDS = 1 << 20


@dataclass
class Level:
    name: str
    row: DataFrame
    bits: int
    hashes: int
    seed: int

    def holds(self, key: Column) -> Column:
        """Whether the filter, the column ``name``, holds ``key``."""
        out = F.lit(True)
        for at in _positions(key, self.bits, self.hashes, self.seed):
            out = out & (F.getbit(F.get(F.col(self.name), F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
        return out


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed * 64 + i), key), F.lit(bits)) for i in range(hashes)]


def _size(count: int, rate: float) -> tuple[int, int]:
    """Hashes and bits of a Bloom filter of ``count`` keys with about this rate of mistakes."""
    hashes = max(1, round(-math.log2(rate)))
    return hashes, max(64, 64 * math.ceil(count * hashes / math.log(2) / 64))


def _level(keys: DataFrame, count: int, rate: float, seed: int, name: str) -> Level:
    """A stored filter of the ``count`` keys (column key)."""
    hashes, bits = _size(count, rate)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("v"))
    every = keys.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    # one row of a known size
    row = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "v"))), lambda x: x["v"]).alias(name))
    return Level(name, saved(row), bits, hashes, seed)


def _with(df: DataFrame, levels: list[Level]) -> DataFrame:
    for x in levels:
        df = df.crossJoin(F.broadcast(x.row))  # a single row
    return df


def build(listed: DataFrame, universe: DataFrame, name: str = "level") -> list[Level]:
    """Levels that separate ``listed`` from all other keys of ``universe`` (both: column key)."""
    ins = saved(listed.select("key").where("key IS NOT NULL").distinct())
    count = ins.count()
    if not count:
        return []
    keys = universe.select("key").where("key IS NOT NULL")
    every = max(1, keys.agg(F.approx_count_distinct("key")).first()[0])
    levels = [_level(ins, count, _rate(count, every), 1, f"{name}_1")]
    # the corpus's keys that level 1 takes for listed ones: about count / sqrt(2)
    outs = saved(_with(keys, levels).where(levels[0].holds(F.col("key"))).select("key").distinct().join(ins, "key", "left_anti"))
    inner, outer = outs, ins
    while n := inner.count():  # each level halves what is left
        new = _level(inner, n, 0.5, len(levels) + 1, f"{name}_{len(levels) + 1}")
        levels.append(new)
        inner, outer = saved(_with(outer, [new]).where(new.holds(F.col("key"))).select("key")), inner
    return levels


def _rate(count: int, every: int) -> float:
    return min(0.5, count / (math.sqrt(2) * max(1, every)))


def member(levels: list[Level], key: Column) -> Column:
    """Whether ``key``, of the universe or listed, is listed; the levels' rows must be joined (:func:`_with`)."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels), 0, -1):
        out = F.when(levels[i - 1].holds(key), out).otherwise(F.lit(i % 2 == 0))
    return out & key.isNotNull() if levels else F.lit(False)


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path of a url."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _keys(shapes: list[tuple[int, int]]) -> Column:
    """The candidate key of each shape: (labels of the host, signs of the path)."""
    names = F.split("host", r"\.", -1)

    def key(s: Column) -> Column:
        fits = (F.size(names) >= s["labels"]) & (F.char_length("path") >= s["length"])
        return F.when(fits, F.concat(F.array_join(F.slice(names, F.size(names) - s["labels"] + 1, s["labels"]), "."), F.substring(F.col("path"), F.lit(1), s["length"])))

    return F.transform(F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(n).alias("length")) for a, n in shapes]), key)


def _decide(own: dict[str, list[Level]], part: Callable[[Column], Column], k: int) -> Callable[[Column], Column]:
    """A candidate with what part ``k`` says of it."""

    def decide(c: Column) -> Column:
        return F.struct(c["key"].alias("key"), *[F.when(part(c["key"]) == k, member(own[v], c["key"])).otherwise(c[v]).alias(v) for v in ("block", "allow")])

    return decide


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] | DataFrame = RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict; ``rules``: host, path, verdict ("block" or "allow"), as tuples or a table."""
    spark = pages.sparkSession
    host, path = parts(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    size = F.struct((F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1).alias("labels"), F.char_length("path").alias("length"))
    shapes = sorted((tuple(r["s"]) for r in rules.select(size.alias("s")).distinct().collect()), key=lambda s: (-s[0] - s[1], s))
    if not shapes:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    # the corpus's complete key universe, once
    universe = saved(rows.select("host", "path").distinct().select(F.explode(_keys(shapes)).alias("key")).where("key IS NOT NULL").distinct())
    listed = rules.select(F.concat("host", "path").alias("key"), "verdict")
    wanted = {r["verdict"]: r["n"] for r in listed.groupBy("verdict").agg(F.count_distinct("key").alias("n")).collect()}
    most = max(wanted.values())
    hashes, bits = _size(most, _rate(most, universe.count()))
    count = max(1, -(-bits // 64 // MAX_WORDS))
    part = lambda key: F.pmod(F.xxhash64(F.lit(-1), key), F.lit(count))
    none = F.lit(None).cast("boolean")
    cand = F.transform(_keys(shapes), lambda k: F.struct(k.alias("key"), none.alias("block"), none.alias("allow")))
    rows = rows.withColumn("cand", cand)
    for k in range(count):
        own = {v: build(listed.where((F.col("verdict") == v) & (part(F.col("key")) == k)), universe.where(part(F.col("key")) == k), v) if wanted.get(v) else [] for v in ("block", "allow")}
        decided = F.transform("cand", _decide(own, part, k))
        rows = _with(rows, own["block"] + own["allow"]).select("page_id", "host", "path", decided.alias("cand"))
        rows = rows if k == count - 1 else saved(rows)
    # of the rules that fit the longest wins
    best = F.reduce(F.filter("cand", lambda c: c["block"] | c["allow"]), F.lit(None).cast("struct<key:string,block:boolean,allow:boolean>"), lambda a, c: F.when(a.isNull() | (F.char_length(c["key"]) > F.char_length(a["key"])), c).otherwise(a))
    out = rows.withColumn("best", best)
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.when(F.col("best.block"), "block").otherwise("allow").alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
WITH r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
x AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
y AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM x),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM (SELECT DISTINCT page_id, host, path FROM y) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, host, path)
SELECT y.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM y LEFT JOIN m ON m.page_id = y.page_id
"""
