"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

All of it is DataFrame functions. A url's host lies after the first `://` up to `/`, `?`, `#` or the end
(A-Z lower-cased), its path from there up to `?`, `#` or the end; a null url or one without `://` has
empty ones. A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with
the rule's; the longest rule wins (of equally long ones the first by text).

Urls that no rule judges are looked up in the list of canonical URLs. An entry covers its host and all
subdomains. One with a path covers that very path and all below it; if it ends with a `/`, only what lies
below; one without a path covers the whole host. Schemes, ports, user names, trailing dots of hosts,
queries and fragments are left out. So a url has two keys for each suffix of its host and each leading
part of its path, up to the most labels and path steps that any entry of the list has: longer keys can't
be listed. The filter is a table of blocks, a 64-bit mask each, that is built by bit_or over the list. A
key is passed on if its own bits are all set in its block, and an exact hash join with the list removes
what was passed by chance.

Joins back to pages go by broadcast where the checked size of what was found allows it, else with salts:
a host, a key or a url may hold a large share of all rows.

Null and repeated page_ids keep a row each, and so do null urls; null entries are left out, and an empty
list allows all. An empty table of pages gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import common

#: Bits set for a key, listed keys for each 64-bit block, and bytes up to which a side of a join is broadcast.
KEY_BITS = 5
KEYS_PER_BLOCK = 4
MOST_BROADCAST = 8_000_000
#: Parts of each key of a join that can't be broadcast.
SALTS = 32


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The text (host + path) of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    by_text = sorted(rules, key=lambda r: r[0] + r[1], reverse=True)
    for rule_host, rule_path, _ in sorted(by_text, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.lit(rule_host + rule_path)).otherwise(out)  # longer ones are asked first
    return out


def _bare(host: Column) -> Column:
    """A host without user name, port and trailing dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":\d*$", ""), r"\.+$", "")


def keys_of(host: Column, path: Column, most_labels: int, most_steps: int) -> Column:
    """The keys under which a listed entry of so many host labels and path steps can cover this url."""
    labels = F.split(_bare(host), r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    steps = F.split(path, "/")  # the first is empty
    pieces = F.transform(F.sequence(F.lit(1), F.least(F.size(steps), F.lit(most_steps + 1))), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    paths = F.flatten(F.transform(pieces, lambda p: F.when((p == path) & (p != ""), F.array(p)).otherwise(F.array(p, F.concat(p, F.lit("/"))))))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(F.filter(paths, lambda p: p != ""), lambda p: F.concat(h, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(keys))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    second = F.xxhash64(key, F.lit(17))
    out = F.lit(0).cast("long")
    for i in range(KEY_BITS):
        # shiftleft takes its count modulo 64
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(second, 6 * i), F.lit(64)).cast("int")))
    return out


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of a list (key): block, mask."""
    return listed.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("mask"))


def canonical(entry: Column) -> Column:
    """A listed entry as a key: no scheme, lower-case host, path (/ if it has none), no query."""
    bare = F.regexp_replace(entry, r"(?s)^.*?://", "")
    path = F.regexp_extract(bare, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.concat(_bare(F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1))), F.when(path == "", "/").otherwise(path))


def _joined(left: DataFrame, right: DataFrame, on: list[str], right_bytes: int, how: str = "inner") -> DataFrame:
    """left join right, whose keys are distinct and some of which many rows of left may have."""
    if right_bytes <= MOST_BROADCAST:
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread.hint("shuffle_hash"), [*on, "_salt"], how).drop("_salt")


def _found(df: DataFrame, text: Column) -> tuple[DataFrame, int]:
    """df stored, and about the bytes that its rows take in memory."""
    df = common.stored(df)
    return df, df.agg(F.coalesce(F.sum(F.octet_length(text) + 64), F.lit(0))).first()[0]


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule and verdict of each page (page_id, url); listed: a column `entry`."""
    keys = listed.where("entry is not null").select(canonical(F.col("entry")).alias("key")).distinct()
    labels, steps = F.size(F.split(F.substring_index("key", "/", 1), r"\.")), F.size(F.split(F.regexp_replace("key", "/$", ""), "/")) - 1
    n, most_labels, most_steps = keys.agg(F.count("*"), F.coalesce(F.max(labels), F.lit(1)), F.coalesce(F.max(steps), F.lit(0))).first()
    blocks = max(1, n // KEYS_PER_BLOCK)
    url = F.col("url")
    split = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = split.withColumn("rule", best_rule(F.col("host"), F.col("path"), rules))
    # one lookup for each distinct host and path, however many pages it has
    open_ = judged.where("rule is null and host <> ''").select("host", "path").distinct()
    asked = open_.select("host", "path", F.explode(keys_of(F.col("host"), F.col("path"), most_labels, most_steps)).alias("key"))
    asked = asked.withColumn("block", _block(F.col("key"), blocks)).withColumn("bits", _mask(F.col("key")))
    possible = _joined(asked, bloom(keys, blocks), ["block"], 64 * blocks).where(F.col("mask").bitwiseAND(F.col("bits")) == F.col("bits")).select("host", "path", "key")
    sure, size = _found(possible.select("key").distinct().join(keys.hint("shuffle_hash"), "key", "left_semi"), F.col("key"))
    hits, size = _found(_joined(possible, sure, ["key"], size).select("host", "path").distinct(), F.concat("host", "path"))
    verdicts = {h + p: v for h, p, v in rules}
    by_rule = F.create_map(*(F.lit(x) for pair in verdicts.items() for x in pair)) if verdicts else None
    out = _joined(judged, hits.withColumn("hit", F.lit(True)), ["host", "path"], size, "left")
    method = F.when(F.col("hit"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", (F.coalesce(by_rule[F.col("rule")], method) if by_rule is not None else method).alias("verdict"))
