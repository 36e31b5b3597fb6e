"""URL rules and exact blocklist membership by a cascade of Bloom filters, in column expressions alone.

Rules: an ordered list of (host, path) prefixes; the longest that fits decides.

Blocklist: the corpus's complete key universe (every host and every parent domain of it) is known, so a filter's
false positives can be listed. Level 1 encodes the listed keys, level 2 the unlisted keys that level 1 lets through,
level 3 the listed keys that level 2 lets through, and so on, until a level lets nothing wrong through. A key of
the universe is listed exactly if the first level that stops it is an even one (or none is and the last is odd).
Asking takes a few hashes and no join.

A level's bits are built by a distributed bitmap aggregate. Filters travel as literals of at most ``MOST_BITS`` bits
a level; a longer list is cut into slices by a hash of the key, each with a cascade and a pass of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowarden.session import materialise

# (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BITS_PER_KEY = 10
HASHES = 3
CHUNK = 32_768  # bits of one bitmap the aggregate builds
MOST_BITS = 1 << 23
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for a null url or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (written host + path; of equal lengths the first in order) and its verdict; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def domains(host: Column) -> Column:
    """A host and its parent domains, longest first; none for an empty host."""
    labels = F.split(host, r"\.", -1)
    every = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host != "", every).otherwise(F.array().cast("array<string>"))


def _position(key: Column, level: int, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(k)), F.lit(bits)) + 1  # bitmap positions count from 1


def _build(keys: DataFrame, level: int, rows: int) -> bytes:
    """The bits of one level: at most MOST_BITS / 8 bytes."""
    chunks = max(1, -(-rows * BITS_PER_KEY // CHUNK))
    bits = chunks * CHUNK
    spots = keys.select(F.explode(F.array(*[_position(F.col("key"), level, k, bits) for k in range(HASHES)])).alias("p"))
    parts = spots.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    made = bytearray(bits // 8)
    for row in parts.collect():
        at = (row["b"] - 1) * (CHUNK // 8)
        made[at : at + CHUNK // 8] = row["m"]
    return bytes(made)


def _passes(key: Column, level: int, data: bytes) -> Column:
    filter_ = F.lit(data)
    ok = F.lit(True)
    for k in range(HASHES):
        at = _position(key, level, k, len(data) * 8) - 1
        byte = F.conv(F.hex(F.substring(filter_, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8).cast("int") + 1)
        ok = ok & (byte.bitwiseAND(bit) != 0)
    return ok


def cascade(universe: DataFrame) -> list[bytes]:
    """Levels for ``universe`` (key, listed), one row per key. Without a listed key there is no level."""
    here, there = universe.where("listed").select("key"), universe.where("NOT listed").select("key")
    levels: list[bytes] = []
    while rows := here.count():
        data = _build(here, len(levels) + 1, rows)
        let_through = there.where(_passes(F.col("key"), len(levels) + 1, data))
        levels.append(data)
        here, there = let_through, here
    return levels


def is_listed(key: Column, levels: list[bytes]) -> Column:
    """Exact membership of a key of the universe the cascade was built for."""
    member = F.lit(False)
    for i in range(len(levels), 0, -1):
        member = _passes(key, i, levels[i - 1]) & ~member
    return member


def key_universe(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """Stored (key, listed): every host of ``hosts`` (column host), every parent domain, and every listed key."""
    own = hosts.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key"), F.lit(False).alias("listed"))
    given = listed.select(F.translate("key", UPPER, LOWER).alias("key"), F.lit(True).alias("listed")).where("key IS NOT NULL")
    return materialise(own.unionByName(given).groupBy("key").agg(F.max("listed").alias("listed")), "url-keys")


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, url_col: str = "url", most_bits: int = MOST_BITS) -> DataFrame:
    """``pages`` with host, path, rule and verdict (columns of these names are replaced).

    ``listed`` has a column key: hosts or domains that are blocked with all their subdomains where no rule fits. A null
    url and one without ``://`` have an empty host, fit no rule and are allowed. Rows, nulls and repeats stay.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.withColumns({"host": host, "path": path})
    universe = key_universe(rows, listed)
    slices = max(1, -(-universe.where("listed").count() * BITS_PER_KEY * 2 // most_bits))
    slice_of = lambda key: F.pmod(F.xxhash64(F.lit("slice"), key), F.lit(slices))
    for i in range(slices):
        levels = cascade(universe.where(slice_of(F.col("key")) == i))
        found = F.col("__listed") if i else F.lit(False)
        hit = F.exists(domains(F.col("host")), lambda key: (slice_of(key) == i) & is_listed(key, levels))
        rows = rows.withColumn("__listed", found | hit)
        if i < slices - 1:
            rows = materialise(rows, "judged")  # the next pass carries its own filter only
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("verdict", F.coalesce(verdict, F.when(F.col("__listed"), "block").otherwise("allow")))
    return rows.drop("__listed")


def listed_domains(pages: DataFrame, url_col: str = "url", labels=LISTED_LABELS) -> DataFrame:
    """A blocklist for a corpus: the domains of its hosts that begin with one of ``labels`` (column key)."""
    host, _ = host_and_path(F.col(url_col))
    every = pages.select(host.alias("host")).distinct().select(F.explode(domains(F.col("host"))).alias("key"))
    return every.where(F.substring_index("key", ".", 1).isin(*labels)).distinct()
