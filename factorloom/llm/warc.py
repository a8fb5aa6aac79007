"""Not-modified revisits in web archives: an as-of join to the full response that they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import need

#: Headers of a stored response that a not-modified answer may not replace (they describe its body or the connection).
FIXED_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")


def parse_headers(block: Column) -> Column:
    """A block of header lines as a map with lower-case names; folded lines are joined, of repeated names the last counts, null
    gives null."""
    lines = F.filter(F.split(F.regexp_replace(block, r"\r?\n[ \t]+", " "), r"\r?\n"), lambda x: F.instr(x, ":") > 1)
    part = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value"))
    none = F.array().cast("array<struct<name:string,value:string>>")
    # the block is split once; each line takes the place of an earlier one of its name
    return F.map_from_entries(F.aggregate(F.transform(lines, part), none, lambda done, e: F.array_append(F.filter(done, lambda d: d["name"] != e["name"]), e)))


def canonical_url(url: Column) -> Column:
    """Scheme, user, www, default port, fragment and a trailing slash go; the host is in lower case; the query stays."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"(?s)#.*$", "")
    host = F.regexp_extract(rest, r"^[^/?]*", 0)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    host = F.regexp_replace(F.regexp_replace(F.lower(host), r"^.*@", ""), r"(:80|:443)$", "")
    host = F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\d*\.", "")
    return F.concat(host, F.regexp_replace(path, r"/+(?=\?|$)", ""))


def _tag(headers: Column) -> Column:
    """An ETag for weak comparison."""
    return F.regexp_replace(headers["etag"], r"^W/", "")


def resolve_revisits(records: DataFrame, record_id: str = "record_id", url: str = "url", captured: str = "captured", status: str = "status", headers: str = "headers", body: tuple[str, ...] = ("payload_digest",), span: str = "day") -> DataFrame:
    """One row per record: record_id, url, captured, status, base_id, validation, resolved, headers, and the ``body`` columns.

    A record of status 304, or with a header warc-type of revisit, is a revisit; it refers to the latest earlier record of
    status 200 that is none, with the same canonical url (of equal times the larger record_id is later); a revisit's header
    warc-refers-to-target-uri names the url in place of its own. ``validation`` is payload-digest (for a profile of identical
    payloads), etag or last-modified, the first of which both have and in which they agree, mismatch where it differs, absent
    where they have none in common, none without an earlier response. A revisit is resolved on agreement, or on absent if neither side has any validator. It then gets
    status 200, the base's body columns, and the base's headers with those of the revisit that may replace them.
    Other records pass unchanged, with base_id and validation null and resolved true.

    An urls' captures are split by ``span`` of time and each span's last response is carried to the later ones, so a
    url with any number of captures isn't one group. Null urls and null times match nothing; null headers count as
    empty; repeated rows stay; other columns are ignored; an empty table gives an empty result. The header map needs lower-case
    names (see ``parse_headers``).
    """
    need(records, [record_id, url, captured, status, headers, *body])
    usable = F.col(url).isNotNull() & F.col(captured).isNotNull()
    rows = records.select(record_id, url, captured, status, F.coalesce(F.col(headers), F.create_map().cast("map<string,string>")).alias(headers), *body)
    marked = F.coalesce(F.lower(F.col(headers)["warc-type"]) == "revisit", F.lit(False))
    revisit = F.coalesce(F.col(status) == 304, F.lit(False)) | marked
    meant = F.coalesce(F.when(revisit, F.col(headers)["warc-refers-to-target-uri"]), F.col(url))
    key = F.when(usable, F.concat(F.lit("u"), canonical_url(meant))).otherwise(F.concat(F.lit("-"), F.coalesce(F.xxhash64(record_id, url, captured).cast("string"), F.lit(""))))
    base = F.struct(F.col(record_id).alias("id"), F.col(headers).alias("headers"), *body)
    rows = rows.withColumns({"_key_": key, "_span_": F.date_trunc(span, F.col(captured)), "_full_": F.when(usable & (F.col(status) == 200) & ~marked, base)})
    spans = rows.groupBy("_key_", "_span_").agg(F.max_by("_full_", F.when(F.col("_full_").isNotNull(), F.struct(captured, record_id))).alias("_last_"))
    earlier = Window.partitionBy("_key_").orderBy("_span_").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_carried_", F.last("_last_", ignorenulls=True).over(earlier)).filter("_carried_ is not null").select("_key_", "_span_", "_carried_")
    within = Window.partitionBy("_key_", "_span_").orderBy(captured, record_id).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_near_", F.last("_full_", ignorenulls=True).over(within)).join(spans, ["_key_", "_span_"], "left")
    rows = rows.withColumn("_base_", F.when(revisit & usable, F.coalesce("_near_", "_carried_")))
    own, old = F.col(headers), F.col("_base_.headers")
    alike = F.when(own["warc-profile"].contains("identical-payload-digest"), own["warc-payload-digest"])
    kinds = [("payload-digest", alike, old["warc-payload-digest"]), ("etag", _tag(own), _tag(old)), ("last-modified", own["last-modified"], old["last-modified"])]
    validation = F.lit("absent")
    for name, a, b in reversed(kinds):
        validation = F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, name).otherwise("mismatch")).otherwise(validation)
    bare = F.coalesce(*(x for _, a, b in kinds[1:] for x in (a, b)), alike).isNull()
    validation = F.when(revisit, F.when(F.col("_base_").isNull(), "none").otherwise(validation))
    rows = rows.withColumn("validation", validation)
    good = F.col("validation").isin("payload-digest", "etag", "last-modified") | (F.col("validation") == "absent") & bare
    rows = rows.withColumn("resolved", F.when(revisit, good).otherwise(True))
    take = revisit & F.col("resolved")
    fresh = F.map_filter(own, lambda k, _: ~k.isin(*FIXED_HEADERS) & ~k.startswith("warc-"))
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    return rows.select(
        record_id,
        url,
        captured,
        F.when(take, 200).otherwise(F.col(status)).alias(status),
        F.col("_base_.id").alias("base_id"),
        "validation",
        "resolved",
        F.when(take, F.map_concat(kept, fresh)).otherwise(own).alias(headers),
        *(F.when(take, F.col(f"_base_.{c}")).otherwise(F.col(c)).alias(c) for c in body),
    )
