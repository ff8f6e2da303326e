"""Not-modified revisits of a web archive, resolved against the latest earlier full response.

Records are rows: record_id, warc_type ('response' or 'revisit'), url, ts, status, headers (the raw HTTP header block)
and payload_digest.  A revisit takes its payload from the latest full response (type response, status 200) with the
same canonical URL and a strictly earlier time; of responses at one instant the one with the greatest record_id counts.
Its validators are then held against that response's, and the permitted headers of the revisit replace the stored ones.

The as-of join runs on distinct (URL, instant) points.  Points of one URL are cut into time segments: a running maximum
inside each segment, one carried over from earlier segments, and an equi-join back.  A URL that holds a third of all
records is thus spread over its segments, copies of one instant collapse before the shuffle, and the join back has
plain equality keys that adaptive execution can split.

Defined results (column outcome):
 resolved            a validator of the revisit equals the response's
 unvalidated         there is an earlier response, and the revisit names no validator that the response has too
 validator_mismatch  the first comparable validator differs: no payload and no merged headers
 no_response         no earlier full response, or the revisit has no URL or no time (one that does not parse is none)
Null header blocks count as empty.  Records of other types are left out.  An empty table gives an empty table; rows
that repeat a record are resolved one by one; further columns of the input do not take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let

#: Fixed values (RFC 9110, 15.4.5): header fields that a not-modified response may update.
PERMITTED_HEADERS = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that name a visit and not a resource.
TRACKING = r"^(?i:utm_[a-z]+|gclid|fbclid|sessionid|ref)="
SEGMENT_SECONDS = 3600


def canonical_url(url: Column) -> Column:
    """Host in lower case without credentials, default port and leading www, path without closing slashes, sorted
    query without tracking parameters; no scheme and no fragment.  What has no host keeps its text up to the fragment."""
    whole = F.regexp_replace(F.trim(url), "(?s)#.*$", "")
    host = F.lower(F.regexp_extract(whole, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)?$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(whole, r"^[^/?]*//[^/?]*([^?]*)", 1), r"/+$", "")
    parts = F.filter(F.split(F.regexp_extract(whole, r"(?s)\?(.*)$", 1), "&", -1), lambda x: (x != "") & ~x.rlike(TRACKING))
    query = let(F.array_sort(parts), lambda p: F.when(F.size(p) > 0, F.concat(F.lit("?"), F.array_join(p, "&"))).otherwise(F.lit("")))
    return F.when(F.trim(url) == "", F.lit(None)).when(host == "", whole).otherwise(F.concat(host, path, query))


def parse_headers(block: Column) -> Column:
    """A map of header names in lower case to values; values of a repeated name are joined with commas."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n", -1), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("n"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))

    def folded(p: Column) -> Column:
        names = F.array_distinct(F.transform(p, lambda x: x["n"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(F.transform(F.filter(p, lambda x: x["n"] == n), lambda x: x["v"]), ", ")))

    return let(pairs, folded)


def header_block(headers: Column) -> Column:
    """The header lines of a map, sorted by name."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return F.array_join(entries, "\n")


def merge_headers(stored: Column, revisit: Column, permitted: tuple[str, ...] = PERMITTED_HEADERS) -> Column:
    names = F.array(*(F.lit(x) for x in permitted))
    fresh = F.map_filter(revisit, lambda k, _: F.array_contains(names, k))
    return let(fresh, lambda f: F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(f, k)), f))


def _tag(headers: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.try_element_at(headers, F.lit("etag")), r'^\s*(?:W/)?"?([^"]*)"?\s*$', "$1")


def _instant(column: str) -> Column:
    return F.unix_micros(F.col(column).try_cast("timestamp"))


def latest_earlier(records: DataFrame, *, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """(key, at) of every instant at which a URL was recorded, with ``base``: the latest full response before it."""
    width = segment_seconds * 1_000_000
    full = (F.col("warc_type") == "response") & (F.col("status") == 200)
    base = F.when(full, F.struct(F.col("at"), F.col("record_id"), F.coalesce("headers", F.lit("")).alias("headers"), F.col("payload_digest")))
    points = records.where(F.col("key").isNotNull() & F.col("at").isNotNull()).groupBy("key", "at").agg(F.max(base).alias("here"))
    points = points.withColumn("segment", F.floor(F.col("at") / width))
    inside = W.partitionBy("key", "segment").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("key").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    segments = points.groupBy("key", "segment").agg(F.max("here").alias("last")).select("key", "segment", F.max("last").over(before).alias("carried"))
    near = points.select("key", "segment", "at", F.max("here").over(inside).alias("near"))
    return near.join(segments, ["key", "segment"]).select("key", "at", F.coalesce("near", "carried").alias("base"))


def resolve_revisits(records: DataFrame, *, permitted: tuple[str, ...] = PERMITTED_HEADERS, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """One row for each revisit: record_id, canonical_url, base_id, outcome, merged_headers, payload_digest."""
    lean = records.where(F.col("warc_type").isin("response", "revisit")).select("record_id", "warc_type", canonical_url(F.col("url")).alias("key"), _instant("ts").alias("at"), "status", "headers", F.col("payload_digest").cast("string").alias("payload_digest"))
    visits = lean.where(F.col("warc_type") == "revisit").select("record_id", "key", "at", parse_headers(F.col("headers")).alias("own"), F.col("payload_digest").alias("own_digest"))
    found = visits.join(latest_earlier(lean, segment_seconds=segment_seconds), ["key", "at"], "left").withColumn("stored", parse_headers(F.col("base.headers")))
    own, stored = F.col("own"), F.col("stored")
    modified = lambda h: F.try_element_at(h, F.lit("last-modified"))
    outcome = (
        F.when(F.col("base").isNull(), "no_response")
        .when(_tag(own).isNotNull() & _tag(stored).isNotNull(), F.when(_tag(own) == _tag(stored), "resolved").otherwise("validator_mismatch"))
        .when(modified(own).isNotNull() & modified(stored).isNotNull(), F.when(modified(own) == modified(stored), "resolved").otherwise("validator_mismatch"))
        .when(F.col("own_digest").isNotNull() & F.col("base.payload_digest").isNotNull(), F.when(F.col("own_digest") == F.col("base.payload_digest"), "resolved").otherwise("validator_mismatch"))
        .otherwise("unvalidated")
    )
    taken = F.col("outcome").isin("resolved", "unvalidated")
    return found.withColumn("outcome", outcome).select(
        "record_id",
        F.col("key").alias("canonical_url"),
        F.col("base.record_id").alias("base_id"),
        "outcome",
        F.when(taken, header_block(merge_headers(stored, own, permitted))).alias("merged_headers"),
        F.when(taken, F.col("base.payload_digest")).alias("payload_digest"),
    )


# --- records of a crawl, derived from the table of pages -------------------------------------------------------------

_START = 1704067200


def captures_of(pages: DataFrame) -> DataFrame:
    """Four records for each page: its full response, two revisits by other spellings of its URL, and a visit of its
    host's front page, which is a full response for one page in sixteen and otherwise a revisit.  A host with many
    pages gives one URL with as many records."""
    p = F.col("page_id")
    tag = lambda n: F.concat(F.lit('"'), F.substring(F.sha2(F.concat(F.col("url"), F.lit(n)), 256), 1, 16), F.lit('"'))
    front = F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1)
    day = F.pmod(p * 7919, F.lit(365)).cast("string")
    line = lambda *parts: F.concat(*parts, F.lit("\r\n"))
    date = lambda k: line(F.lit("Date: day "), F.pmod(p * 31 + k, F.lit(365)).cast("string"))
    full_head = F.concat(line(F.lit("Content-Type: text/html; charset=utf-8")), line(F.lit("ETag: "), tag("a")), line(F.lit("Last-Modified: day "), day), line(F.lit("Server: a")), date(0))
    second = F.concat(
        F.when(F.pmod(p, F.lit(4)) == 0, line(F.lit("etag: W/"), tag("a"))).when(F.pmod(p, F.lit(4)) == 1, line(F.lit("ETag: "), tag("b"))).when(F.pmod(p, F.lit(4)) == 2, line(F.lit("Last-Modified: day "), day)).otherwise(F.lit("")),
        line(F.lit("Cache-Control: max-age=60")),
        line(F.lit("Server: b")),
        date(2),
    )
    front_tag = F.concat(F.lit('"f'), F.pmod(p, F.lit(5)).cast("string"), F.lit('"'))
    front_head = F.concat(line(F.lit("ETag: "), front_tag), line(F.lit("Vary: accept")), line(F.lit("X-Page: "), p.cast("string")), date(3))
    at = lambda factor, plus: F.timestamp_seconds(F.lit(_START) + F.pmod(p * factor, F.lit(31_536_000)) + plus)
    record = lambda k, kind, url, ts, status, head, digest: F.struct((p * 4 + k).alias("record_id"), kind.alias("warc_type"), url.alias("url"), ts.alias("ts"), status.alias("status"), head.alias("headers"), digest.alias("payload_digest"))
    none, lit = F.lit(None).cast("string"), F.lit
    digest = F.sha2(F.col("html"), 256)
    is_front = F.pmod(p, F.lit(16)) == 0
    rows = F.array(
        record(0, lit("response"), F.col("url"), at(7919, 0), lit(200), full_head, digest),
        record(1, lit("revisit"), F.concat(F.regexp_replace("url", "#.*$", ""), lit("#again")), at(7919, 60 + F.pmod(p, F.lit(7)) * 86400), lit(304), F.concat(line(F.lit("ETag: "), tag("a")), date(1)), none),
        record(2, lit("revisit"), F.regexp_replace("url", "^https?://", "HTTP://WWW."), at(7919, 5000 - F.pmod(p, F.lit(9)) * 1000), lit(304), second, F.when(F.pmod(p, F.lit(8)) == 3, digest)),
        record(3, F.when(is_front, "response").otherwise("revisit"), F.concat(front, lit("/")), at(104729, 0), F.when(is_front, 200).otherwise(304), front_head, F.when(is_front, digest)),
    )
    return pages.select(F.explode(rows).alias("r")).select("r.*")
