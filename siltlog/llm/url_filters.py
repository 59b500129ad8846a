"""Operator 1: URL filters by a temporal list join.

A list is a history of dated entries: on a day, a key (a domain or host, or a host with a path) is added to
a list with a verdict, or taken off it. Each entry holds from its day to the next entry of the same list and
key: a validity interval. A capture looks up every key it falls under (its host, the domains above it, its
path's prefixes) among the intervals that hold its fetch time, as an as-of join. The longest key decides;
of equally long keys an 'allow' decides over a 'block', then the list's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A hot host's captures are dealt to so many parts, and the list's intervals are copied to each.
SALTS = 16
_FOREVER = "TIMESTAMP_NTZ '9999-12-31 00:00:00'"


def intervals(entries: DataFrame) -> DataFrame:
    """list_name, key, verdict, valid_from, valid_to of each addition; taken-off entries only end others.

    ``entries``: list_name, key, listed_at, action ('add' or 'drop'), verdict ('block' or 'allow'). Of entries
    of a list and key with the same time, a drop counts after an add, and 'block' after 'allow'. A slash at a
    key's end is left out.
    """
    following = "lead(listed_at) OVER (PARTITION BY list_name, key ORDER BY listed_at, action, verdict)"
    rows = entries.where("key IS NOT NULL AND listed_at IS NOT NULL").selectExpr("list_name", "rtrim('/', lower(key)) AS key", "listed_at", "action", "verdict")
    rows = rows.selectExpr("list_name", "key", "verdict", "action", "listed_at AS valid_from", f"coalesce({following}, {_FOREVER}) AS valid_to")
    return rows.where("action = 'add' AND valid_from < valid_to").drop("action")


def host(url: Column) -> Column:
    """The host in lower case, without user, port and trailing dot; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*?)\.?(?::\d*)?(?:[/?#]|$)", 1))


def keys(url: Column) -> Column:
    """All keys a URL falls under: its host, the domains above it, and its host with each prefix of its path."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1))
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(host(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, F.filter(prefixes, lambda p: ~F.endswith(p, F.lit("/"))))))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture: page_id, url, fetched_at, verdict ('block', 'allow' or 'none'), matched_key,
    list_name, valid_from, n_active (entries that hold).

    ``captures``: page_id, url, fetched_at. A null or unparsable URL, or a null time, matches nothing. Very long
    URLs are read whole. Repeated rows are looked up once and reported each; an empty table gives no rows, an empty list 'none' for all; extra
    columns are ignored. The join is on key and salt, so the captures of a host that holds a third of all
    rows are spread; only matches are reduced afterwards, per capture.
    """
    taken = captures.select("page_id", "url", "fetched_at")
    spread = taken.distinct().withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "fetched_at"), F.lit(SALTS)).cast("int"))
    asked = spread.select("page_id", "url", "fetched_at", "salt", F.explode(keys(F.col("url"))).alias("k"))
    held = intervals(entries).withColumn("i_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = (F.col("k") == F.col("key")) & (F.col("salt") == F.col("i_salt")) & (F.col("fetched_at") >= F.col("valid_from")) & (F.col("fetched_at") < F.col("valid_to"))
    matches = asked.join(held, on)
    order = F.struct(-F.length("key"), "verdict", "list_name", "valid_from", "key")
    decided = matches.groupBy(*[F.col(c).alias(f"m_{c}") for c in ("page_id", "url", "fetched_at")]).agg(F.min_by(F.struct("verdict", "key", "list_name", "valid_from"), order).alias("w"), F.count("*").alias("n"))
    same = F.lit(True)
    for c in ("page_id", "url", "fetched_at"):
        same &= F.col(c).eqNullSafe(F.col(f"m_{c}"))
    out = taken.join(decided, same, "left")
    return out.select("page_id", "url", "fetched_at", F.coalesce("w.verdict", F.lit("none")).alias("verdict"), F.col("w.key").alias("matched_key"), F.col("w.list_name").alias("list_name"), F.col("w.valid_from").alias("valid_from"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_active"))
