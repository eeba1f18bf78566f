"""URL filters: a blocked Bloom filter of listed entries in front of an exact hash join.

An entry is a host and a path prefix (a rule) or a whole canonical URL. A URL probes the filter with every key that could
list it: each suffix of its host at a dot, with each prefix of its path whose length some entry has, and its canonical form. A
block of the filter is one row of eight 32-bit words, and a key sets one bit in each word of one block, so a probe is one
lookup. Keys that pass go to an exact join on the key itself, which removes the false positives.

The filter is a table of bounded size, and is always broadcast: probes never move for it. A list too long for its full bits a
key gets fewer, and passes more false positives on to the exact join. That join has a limit of its own: a short list
is broadcast, a long one meets the probes that passed by a shuffle on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import materialize

#: Bits of the filter for each key, which give about 1 false positive in 200 with blocks of 256 bits.
BITS_PER_KEY = 12
#: The filter has at most so many blocks of 40 bytes: at 12 bits a key enough for 22 million keys.
FILTER_BLOCKS = 1 << 20
#: A list of up to so many keys is broadcast.
BROADCAST_KEYS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that only track where a visit comes from.
TRACKING = r"(?:utm_[^=&]*|gclid|fbclid|ref)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without doubled or trailing slashes, sorted query without tracking; no fragment."""
    query = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)"))), "&")
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), "/+", "/"), "/$", "")
    return F.concat(host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def _bits(key: Column, blocks: int) -> tuple[Column, Column]:
    """The key's block, and its bit in each of the block's eight words, as four longs of two words each."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    second = F.xxhash64(key, F.lit(1))
    one = lambda i: F.shiftright(second, 5 * i).bitwiseAND(F.lit(31)).cast("int")
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    masks = F.array(*(bit(one(2 * i)).bitwiseOR(bit(one(2 * i + 1) + 32)) for i in range(4)))
    return block, masks


def blocked_bloom(keys: DataFrame, count: int, bits_per_key: int = BITS_PER_KEY, most: int = FILTER_BLOCKS) -> tuple[DataFrame, int]:
    """``block, w0..w3`` of the filter of ``keys.key``, and its number of blocks; built by one combining aggregation."""
    blocks = min(most, max(1, -(-count * bits_per_key // 256)))
    block, masks = _bits(F.col("key"), blocks)
    parts = keys.select(block.alias("block"), masks.alias("m"))
    return parts.groupBy("block").agg(*(F.bit_or(F.col("m")[i]).alias(f"w{i}") for i in range(4))), blocks


def passing(probes: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``probes`` whose ``key`` the filter may hold: all that it holds, and few others."""
    block, masks = _bits(F.col("key"), blocks)
    asked = probes.withColumn("_block", block).withColumn("_masks", masks).join(F.broadcast(bloom), F.col("_block") == F.col("block"))
    passed = F.lit(True)
    for i in range(4):
        passed = passed & (F.col("_masks")[i].bitwiseAND(F.col(f"w{i}")) == F.col("_masks")[i])
    return asked.where(passed).select(*probes.columns)


def match_listed(probes: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of ``probes`` (any columns and ``key``) that ``listed`` (``key`` and any columns, unique keys) holds.

    Blocked Bloom filter first, exact join after. The keys of both are non-null.
    """
    count = listed.count()
    hits = passing(probes, *blocked_bloom(listed.select("key"), count))
    return hits.join(F.broadcast(listed) if count <= BROADCAST_KEYS else listed, "key")


def judge_urls(pages: DataFrame, rules: DataFrame, blocked_urls: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every url by rules, else by a list of blocked URLs.

    ``rules``: ``host, path, verdict``; a rule fits its host and all subdomains if the url's path starts with its path, and the
    longest ``host + path`` wins (of equally long ones the longer host). ``blocked_urls``: ``url``; a url whose canonical form is
    listed is blocked if no rule fits. All else gets ``default``.

    Returns ``page_id, host, path, rule, verdict, listed, canonical_url``.

    * null url or one without ``://``: host and path empty, no rule, not listed;
    * repeated rows and null ids: a row each; rules given twice: blocking wins; rules with nulls take no part;
    * no rules or no list: nothing fits; empty table: no rows; other columns are not read.

    Distinct (host, path) pairs are judged once. Candidate keys are as many as a host has dots times the
    lengths that rule paths have; both are short by nature, and no cap is set on either.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    parsed = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.when(host_of(F.col("url")) != "", canonical(F.col("url"))).alias("canonical_url"))
    own = rules.select(F.translate("host", _UPPER, _LOWER).alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v")).dropna()
    lengths = [r["n"] for r in own.select(F.length("p").alias("n")).distinct().collect()]  # at most one for each length of a path
    entries = materialize(own.groupBy(F.concat("h", F.lit(" "), "p").alias("key"), F.concat("h", "p").alias("rule"), F.length("h").alias("host_length")).agg(F.max("v").alias("verdict")), "rules")
    urls = materialize(blocked_urls.select(canonical(F.col("url")).alias("key")).where("key is not null and key <> ''").distinct(), "listed")

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.lit(lengths).cast("array<int>") if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    rule_keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit(" "), p))))
    asked = parsed.where("host <> ''").select("host", "path", "canonical_url").distinct()
    # Rules and URLs have a filter each: a rule that a third of all URLs asks for stays in a broadcast, away from the long list.
    by_rule = match_listed(asked.select("host", "path", "canonical_url", F.explode(F.array_distinct(rule_keys)).alias("key")), entries)
    by_url = match_listed(asked.withColumn("key", F.col("canonical_url")), urls)
    found = by_rule.select("host", "path", "canonical_url", F.struct(F.length("rule").alias("n"), "host_length", "rule", "verdict").alias("fit"), F.lit(False).alias("listed")) \
        .unionByName(by_url.select("host", "path", "canonical_url", F.lit(True).alias("listed")), allowMissingColumns=True)
    best = found.groupBy("host", "path", "canonical_url").agg(F.max("fit").alias("best"), F.max("listed").alias("listed"))
    judged = best.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("canonical_url").alias("c"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"), "listed")
    return parsed.join(judged, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")) & (F.col("canonical_url") == F.col("c")), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("listed"), "block"), F.lit(default)).alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed"), "canonical_url")
