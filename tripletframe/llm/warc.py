"""Resolution of not-modified revisit records against the latest earlier full response (DataFrame operations only).

A revisit's answer follows from its canonical URL and time alone, so the as-of
join works on the distinct (URL, time) pairs. A hot URL is cut into time buckets
(quantiles of all times): the latest time with a full response inside a bucket
comes from a running maximum over (URL, bucket), the latest one before the
bucket from a running maximum over one pre-aggregated row per (URL, bucket).
Headers and payload join afterwards by (URL, time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Time buckets a URL's records are spread over.
TIME_BUCKETS = 256
#: Header fields of a not-modified answer that never replace stored ones (HTTP caching rules).
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag",
    "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that do not name a resource.
TRACKING = r"(utm_[^=&]*|ref|fbclid|gclid|sessionid)"


def canonical_url(url: Column) -> Column:
    """Lower-case host without scheme, ``www.``, default port and user; no fragment, tracking parameters or final slash; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^([^@]*@)?(www\.)?", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^" + TRACKING + "(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def strong(etag: Column) -> Column:
    """Validator without the weak mark (weak comparison)."""
    return F.regexp_replace(etag, r"^W/", "")


def fields(headers: Column) -> Column:
    """Header fields (key, value) by lower-case name, in name order; names that differ only in case are one field, their
    values joined by ", " in the order of the names as written. A null value is no field, a null map has none."""
    given = F.array_sort(F.filter(F.map_entries(headers), lambda e: e["value"].isNotNull()))
    names = F.array_sort(F.array_distinct(F.transform(given, lambda e: F.lower(e["key"]))))

    def joined(name: Column) -> Column:
        return F.array_join(F.transform(F.filter(given, lambda e: F.lower(e["key"]) == name), lambda e: e["value"]), ", ")

    return F.coalesce(F.transform(names, lambda n: F.struct(n.alias("key"), joined(n).alias("value"))), F.array().cast("array<struct<key:string,value:string>>"))


def resolve_revisits(records: DataFrame, buckets: int = TIME_BUCKETS) -> DataFrame:
    """One row per revisit of ``records(record_id, url, ts, kind, headers map<string,string>, payload_sha256, ...)``.

    ``kind`` is 'response' (full) or 'revisit'; other rows are not read. Columns:
    record_id, url_key, refers_to (record_id of the latest full response of the
    same canonical URL with an earlier time), status,
    headers (merged), payload_sha256. status: 'resolved' when the validators
    agree: entity tags, where both sides have one (weak comparison), else
    last-modified, where both have one, else the revisit has none ('unchecked',
    taken over too); 'mismatch' when they differ (nothing is merged);
    'unresolved' without an earlier response, url or time. Header names are
    compared in lower case (:func:`fields`). Of responses of one URL and time the
    largest (record_id, fields, payload) counts, a null record_id below all
    others; such a response is referred to with a null refers_to. Revisits are
    answered each by their own URL and time, whatever their record_id: repeated
    rows, and rows that share one or have none. An empty table gives no rows;
    other columns are not read.
    """
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), F.unix_micros("ts").alias("t"), (F.col("kind") == "response").alias("full"), "headers", "payload_sha256")
    bounds = rows.agg(F.percentile_approx("t", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    edges = F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds))]) if bounds else F.array().cast("array<long>")
    known = rows.where("url_key is not null and t is not null")
    times = (known.groupBy("url_key", "t").agg(F.max("full").alias("full"), F.max(~F.col("full")).alias("asked"))
             .withColumn("bucket", F.size(F.filter(edges, lambda b: b <= F.col("t")))))
    point = F.when(F.col("full"), F.col("t"))
    inside = Window.partitionBy("url_key", "bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = times.groupBy("url_key", "bucket").agg(F.max(point).alias("top")).select("url_key", "bucket", F.max("top").over(before).alias("carry"))
    near = times.withColumn("near", F.max(point).over(inside)).where("asked")
    matched = near.join(carried, ["url_key", "bucket"]).select("url_key", "t", F.coalesce("near", "carry").alias("at"))

    best = F.max(F.struct("record_id", fields(F.col("headers")).alias("old"), "payload_sha256"))
    stored = known.where("full").groupBy("url_key", F.col("t").alias("at")).agg(best.alias("best")).select(
        "url_key", "at", F.col("best.record_id").alias("refers_to"), F.map_from_entries("best.old").alias("old"), F.col("best.payload_sha256").alias("payload_sha256"))
    revisits = rows.where(~F.col("full")).select("record_id", "url_key", "t", F.map_from_entries(fields(F.col("headers"))).alias("new"))
    both = revisits.join(matched, ["url_key", "t"], "left").join(stored, ["url_key", "at"], "left")
    tag, date = (F.col("new")["etag"], F.col("old")["etag"]), (F.col("new")["last-modified"], F.col("old")["last-modified"])
    status = (F.when(F.col("at").isNull(), "unresolved")
              .when(tag[0].isNotNull() & tag[1].isNotNull(), F.when(strong(tag[0]) == strong(tag[1]), "resolved").otherwise("mismatch"))
              .when(date[0].isNotNull() & date[1].isNotNull(), F.when(date[0] == date[1], "resolved").otherwise("mismatch"))
              .when(tag[0].isNull() & date[0].isNull(), "unchecked").otherwise("mismatch"))
    permitted = F.map_filter("new", lambda k, _: ~k.isin(*NOT_MERGED))
    merged = F.map_concat(F.map_filter("old", lambda k, _: ~F.map_contains_key(permitted, k)), permitted)
    taken = F.col("status").isin("resolved", "unchecked")
    return both.withColumn("status", status).select("record_id", "url_key", "refers_to", "status", F.when(taken, merged).otherwise(F.col("new")).alias("headers"), F.when(taken, F.col("payload_sha256")).alias("payload_sha256"))


def header_lines(headers: Column) -> Column:
    """Headers as sorted ``name: value`` lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
