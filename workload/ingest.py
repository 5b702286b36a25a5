"""Normalisation, publication, updates and change streams over the given tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetspark.functions.codes import code_path
from facetspark.functions.images import flatten_images, image_urls
from facetspark.operators.normalize import (
    copy_main_language, keep_map_keys, normalize_documents, route_by_status, to_bool,
)
from facetspark.operators.predicates import Match, MatchAny, Phrase, Term, all_of, any_of, ge, terms_any
from facetspark.operators.shape import flatten_languages, fold_languages
from facetspark.operators.taxonomy import taxonomy_tables
from facetspark.operators.upsert import latest_per_key, resolve_changes, upsert_documents
from facetspark.plans.ingest import INDEXED_AT, import_documents, import_taxonomy, prepare_import
from facetspark.plans.search import Distribution, Scatter, SearchRequest, search
from facetspark.scale import scratch_path
from facetspark.sources import documents as src
from facetspark.sources import versions as vs
from facetspark.specs import CollectionSpec, FieldSpec
from facetspark.streaming import changes as ch
from workload.common import BM25_SQL, Query, facets_sql, table, tokens_sql, wall_clock

LANGS = ("de", "en", "fr")


def wide_documents(spark, d):
    """The documents as a feed has them: one text column per language besides the main one."""
    docs = table(spark, d, "documents")
    by_lang = [F.when(F.col("lang") == x, F.col("text")).alias(f"body_{x}") for x in ("de", "en", "es", "fr")]
    return docs.select(
        F.when(F.col("source") != "src0", F.col("doc_id").cast("string")).alias("code"),
        F.col("text").alias("body"), *by_lang,
        F.concat_ws(",", "source", "lang", "source").alias("tags"),
        F.when(F.col("lang") == "en", F.col("n_chars")).otherwise(0).alias("size"),
        (F.col("source") == "src1").alias("flag"),
        F.col("n_chars").alias("modified"), "lang",
    )


FEED = CollectionSpec(
    "feed",
    (
        FieldSpec("code", "keyword", required=True),
        FieldSpec("body", "text_lang", full_text=True),
        FieldSpec("labels", "taxonomy", input_field="tags", split=True, taxonomy="labels", facet=True),
        FieldSpec("size", "long"),
        FieldSpec("flag", "bool", facet=True),
        FieldSpec("modified", "date"),
        FieldSpec("lang", "keyword", facet=True),
    ),
    id_field="code", last_modified_field="modified", langs=LANGS, taxonomies=("labels",), denylist=frozenset({"1", "2"}),
)


def toxic_ids(spark, d):
    return table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))


def normalized(spark, d):
    result = normalize_documents(wide_documents(spark, d), FEED, denied=toxic_ids(spark, d))
    return result.accepted.select(
        "code", "size", "flag", "modified", F.array_join("labels", "|").alias("labels"),
        F.array_join(F.array_sort(F.map_keys("body")), "|").alias("langs"), F.length(F.col("body")["main"]).alias("chars"),
    )


def rejected(spark, d):
    result = normalize_documents(wide_documents(spark, d), FEED, denied=toxic_ids(spark, d))
    return result.rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def folded(spark, d):
    maps = fold_languages(wide_documents(spark, d).select("tags", "body", "body_de", "body_en", "body_es", "body_fr"), "body", LANGS)
    return maps.select("tags", F.explode("body").alias("key", "text")).groupBy("tags", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")
    )


def flattened(spark, d):
    maps = fold_languages(copy_main_language(wide_documents(spark, d), ["tags"]), "body", LANGS)
    flat = flatten_languages(maps.select("code", "body", "tags_main"), ["body"], ["main", "fr", "de"])
    return flat.select("code", "tags_main", F.md5("body").alias("body"), F.md5("body_fr").alias("body_fr"), F.md5("body_de").alias("body_de"))


def normalize_events(spark, d):
    events = table(spark, d, "events")
    props = F.from_json("props", "map<string,int>")
    shaped = events.select(
        F.col("event_id").cast("string").alias("id"),
        F.unix_seconds(wall_clock("ts")).alias("at"), "value", "event_type",
        keep_map_keys(props, ["k"])["k"].alias("k"),
        to_bool(props["k"], T.IntegerType()).alias("has_k"),
    )
    spec = CollectionSpec(
        "events",
        (FieldSpec("id", "keyword"), FieldSpec("at", "date"), FieldSpec("value", "double"), FieldSpec("k", "integer"),
         FieldSpec("kind", "keyword", input_field="event_type"), FieldSpec("has_k", "bool")),
        id_field="id", last_modified_field="at",
    )
    return normalize_documents(shaped, spec, stamp=False).accepted


def jsonl(spark, d):
    """Documents as JSON lines with broken ones: German texts are cut off, Spanish ones blank."""
    line = F.to_json(F.struct(
        F.when(F.col("source") != "src0", F.col("doc_id").cast("string")).alias("code"), "text", "source"
    ))
    rows = table(spark, d, "documents").withColumn("line", line).select(
        F.when(F.col("lang") == "de", F.expr("left(line, length(line) - 3)"))
        .when(F.col("lang") == "es", F.lit("")).otherwise(F.col("line")).alias("value")
    )
    path = scratch_path(spark, "jsonl")
    rows.write.option("compression", "gzip").text(path)
    return path


RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("code", "text", "source")])


def ingest_report(spark, d):
    raw = src.read_documents(spark, jsonl(spark, d), RAW)
    return src.ingest_report(raw, "code", toxic_ids(spark, d))


def read_jsonl(spark, d):
    parsed = src.split_corrupt(src.read_documents(spark, jsonl(spark, d), RAW))
    return parsed.documents.select("code", "source", F.md5("text").alias("text"))


def first_rows(spark, d):
    """How many rows a limited read gives, and how many of them are whole."""
    raw = src.read_documents(spark, jsonl(spark, d), RAW, limit=100)
    return raw.agg(F.count(F.lit(1)).alias("n"))


def stamped(spark, d):
    """Documents with the time they were normalised at, upper-cased tags by a step before."""
    upper = lambda df: df.withColumn("tags", F.upper("tags"))
    ready = prepare_import(wide_documents(spark, d), FEED, upper).accepted
    return ready.agg(
        F.count(F.lit(1)).alias("n"), F.count(INDEXED_AT).alias("n_stamped"),
        F.count_if(F.exists("labels", lambda t: t != F.upper(t))).alias("n_lower"),
    )


def taxonomy_import(spark, d):
    """Nations as a taxonomy file, read, changed by a step before, published as tables and read back."""
    nation = table(spark, d, "nation")
    entry = F.struct(
        F.create_map(F.lit("en"), F.col("n_name")).alias("name"),
        F.create_map(F.lit("en"), F.array(F.lower("n_name"), F.col("n_name"))).alias("synonyms"),
        F.array(F.concat(F.lit("en:region-"), F.col("n_regionkey").cast("string"))).alias("parents"),
    )
    pair = F.struct(F.concat(F.lit("en:nation-"), F.col("n_nationkey").cast("string")).alias("key"), entry.alias("value"))
    base = scratch_path(spark, "taxonomy")
    nation.agg(F.to_json(F.map_from_entries(F.collect_list(pair))).alias("value")).coalesce(1).write.text(f"{base}/file")
    tables = taxonomy_tables(src.read_taxonomy(spark, f"{base}/file", "places"))
    import_taxonomy(tables, base, "places", lambda t: replace(t, names=t.names.where("name <> 'FRANCE'")))
    found = [vs.read_current(spark, base, f"places-{part}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
             for part in ("nodes", "edges", "names", "synonyms")]
    return reduce(lambda a, b: a.unionByName(b), found)


def taxonomy_import_lines(spark, d):
    """Parts as a taxonomy in JSON lines, read, changed by a step before, published as tables; all rows of these."""
    part = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    entries = part.select(
        F.concat(F.lit("en:part-"), F.col("p_partkey").cast("string")).alias("id"),
        F.create_map(F.lit("en"), F.col("p_name"), F.lit("fr"), F.when(F.col("p_size") % 2 == 0, size).otherwise("")).alias("name"),
        F.create_map(F.lit("xx"), F.array(F.lower("p_brand"), F.col("p_brand"), F.lower("p_brand")), F.lit("en"), F.array(F.lit(""), size))
        .alias("synonyms"),
        F.array(F.lower("p_type"), F.lower("p_brand"), F.lower("p_type")).alias("parents"),
    )
    base = scratch_path(spark, "taxonomy-lines")
    entries.write.json(f"{base}/file")
    tables = taxonomy_tables(src.read_taxonomy_lines(spark, f"{base}/file", "parts"))
    import_taxonomy(tables, base, "parts", lambda t: replace(t, names=t.names.where("lang <> 'en' OR id NOT LIKE '%7'")))
    nodes, edges, names, synonyms = (vs.read_current(spark, base, f"parts-{t}") for t in ("nodes", "edges", "names", "synonyms"))
    none = F.lit(None).cast("string")
    rows = (
        nodes.select(F.lit("nodes").alias("part"), "taxonomy", "id", none.alias("lang"), none.alias("value")),
        edges.select(F.lit("edges"), "taxonomy", "child", none, "parent"),
        names.select(F.lit("names"), "taxonomy", "id", "lang", "name"),
        synonyms.select(F.lit("synonyms"), "taxonomy", "id", "lang", F.concat_ws(":", F.col("position").cast("string"), "synonym")),
    )
    return reduce(lambda a, b: a.unionAll(b), rows)


def merge_other_buckets(spark, d):
    """Two merges into a version with a number of buckets of its own."""
    base = scratch_path(spark, "merged")
    vs.publish_version(customers(spark, d), base, "customers", "id", 5)
    vs.merge_into_current(spark, base, "customers", order_updates(spark, d), "id", "modified")
    vs.merge_into_current(spark, base, "customers", order_updates(spark, d), "id", "modified", gone_customers(spark, d))
    return vs.read_current(spark, base, "customers").select("id", "amount", "segment", "modified")


def stream_restarted(spark, d):
    """The change log applied in two runs of a stream with one checkpoint; the second starts where the first ended."""
    base = scratch_path(spark, "restarted")
    vs.publish_version(customers(spark, d), base, "customers", "id", 4)
    log, events = f"{base}/log", change_log(spark, d)
    apply = ch.ApplyChanges(base, "customers", "id", "modified", lambda: snapshot(spark, d))
    for half in (0, 1):
        events.where(F.pmod(F.crc32(F.col("event_id").cast("binary")), F.lit(2)) == half).coalesce(1).write.mode("append").json(log)
        stream = ch.newest_per_id(ch.read_change_files(spark, log))
        ch.run_changes(stream, apply, f"{base}/checkpoint", output_mode="update").awaitTermination()
    return vs.read_current(spark, base, "customers").select("id", "amount", "segment")


def stream_tail(spark, d):
    """A tail that keeps running while events arrive, is stopped, and goes on from its checkpoint when started again."""
    base = scratch_path(spark, "tail")
    vs.publish_version(customers(spark, d), base, "customers", "id", 4)
    log, events = f"{base}/log", change_log(spark, d)
    part = F.pmod(F.crc32(F.col("event_id").cast("binary")), F.lit(3))
    sizes = dict(events.groupBy(part.alias("part")).count().collect())  # three numbers
    apply = ch.ApplyChanges(base, "customers", "id", "modified", lambda: snapshot(spark, d))

    def arrive(k):
        events.where(part == k).coalesce(1).write.mode("append").json(log)

    def start():
        stream = ch.newest_per_id(ch.read_change_files(spark, log))
        return ch.run_changes(stream, apply, f"{base}/checkpoint", forever=True, every="0 seconds", output_mode="update")

    arrive(0)
    query = start()
    ch.wait_until_applied(query, sizes.get(0, 0))
    arrive(1)  # while the query runs
    ch.wait_until_applied(query, sizes.get(0, 0) + sizes.get(1, 0))
    query.stop()
    arrive(2)  # while it does not
    query = start()
    ch.wait_until_applied(query, sizes.get(2, 0))
    query.stop()
    return vs.read_current(spark, base, "customers").select("id", "amount", "segment")


def batch_lookup(spark, d):
    wanted = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return src.lookup_documents(table(spark, d, "orders"), "o_orderkey", wanted).select("o_orderkey", "o_totalprice")


def status_routes(spark, d):
    events = table(spark, d, "events").withColumn("status", F.expr(
        "case event_type when 'view' then 'FOUND' when 'click' then 'found' when 'error' then 'REMOVED' when 'signup' then 'RETRY' else 'SKIP' end"
    ))
    routed = route_by_status(events)
    parts = {"index": routed.index, "delete": routed.delete, "retry": routed.retry, "ignored": routed.ignored}
    result = None
    for name, part in parts.items():
        counted = part.agg(F.count(F.lit(1)).alias("n")).withColumn("route", F.lit(name))
        result = counted if result is None else result.unionByName(counted)
    return result


# --- updates ---------------------------------------------------------------

def customers(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("segment"),
        F.lit(0).cast("long").alias("modified"),
    )


def order_updates(spark, d):
    """Each finished order as an update of its customer, without a segment."""
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("amount"),
        (F.unix_seconds(wall_clock("o_orderdate")) * 100_000 + F.col("o_orderkey")).alias("modified"),
    )


def gone_customers(spark, d):
    return table(spark, d, "customer").where("c_mktsegment = 'MACHINERY' and c_acctbal < 1000").select(F.col("c_custkey").alias("id"))


UPSERT_SQL = """
WITH up AS (SELECT DISTINCT ON (o_custkey) o_custkey AS id, o_totalprice AS amount,
              CAST(epoch(o_orderdate) AS BIGINT) * 100000 + o_orderkey AS modified
            FROM orders WHERE o_orderstatus = 'F' ORDER BY o_custkey, modified DESC),
gone AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal < 1000)
SELECT c_custkey AS id, c_acctbal AS amount, c_mktsegment AS segment, CAST(0 AS BIGINT) AS modified FROM customer
WHERE c_custkey NOT IN (SELECT id FROM up) AND c_custkey NOT IN (SELECT id FROM gone)
UNION ALL SELECT id, amount, NULL, modified FROM up WHERE id NOT IN (SELECT id FROM gone)"""


def upsert_merge(spark, d):
    return upsert_documents(customers(spark, d), order_updates(spark, d), "id", "modified", gone_customers(spark, d))


def publish_roundtrip(spark, d):
    """Publish, republish, then merge updates and deletions into the live version."""
    base = scratch_path(spark, "published")
    vs.publish_version(customers(spark, d), base, "customers", version="customers-1")
    vs.publish_version(customers(spark, d), base, "customers", "id", 8)
    vs.merge_into_current(spark, base, "customers", order_updates(spark, d), "id", "modified", gone_customers(spark, d))
    return vs.read_current(spark, base, "customers").select("id", "amount", "segment", "modified")


def latest_events(spark, d):
    events = table(spark, d, "events")
    return latest_per_key(events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


def change_log(spark, d):
    """The events as a change log: users change; errors delete."""
    return table(spark, d, "events").select(
        F.concat(F.unix_millis(wall_clock("ts")).cast("string"), F.lit("-"), F.col("event_id").cast("string")).alias("event_id"),
        F.col("user_id").cast("string").alias("id"),
        F.when(F.col("event_type") == "error", F.lit("deleted")).alias("action"),
    )


SINCE = 1_705_276_800_000  # 2024-01-15 UTC


def replay(spark, d):
    return ch.replay_changes(change_log(spark, d), SINCE)


LOG_SQL = """
log AS (SELECT epoch_us(ts) // 1000 AS ms, event_id AS seq, CAST(user_id AS VARCHAR) AS id,
          CASE WHEN event_type = 'error' THEN 'deleted' END AS action FROM events),
newest AS (SELECT DISTINCT ON (id) * FROM log WHERE ms >= {since} ORDER BY id, ms DESC, seq DESC)"""


def snapshot(spark, d):
    """Customers as they are now: paid in from their finished orders; those without any are gone."""
    return order_updates(spark, d).groupBy("id").agg(
        F.sum("amount").alias("total"), F.max("modified").alias("modified")
    ).select("id", F.round("total", 2).alias("amount"), F.lit("updated").alias("segment"), "modified")


def resolved(spark, d):
    events = ch.replay_changes(change_log(spark, d), 0).select(F.col("id").cast("long").alias("id"), "action")
    return resolve_changes(events, snapshot(spark, d), "id").select("id", "status", F.col("doc.amount").alias("amount"))


RESOLVED_SQL = f"""
WITH {LOG_SQL.format(since=0)},
snap AS (SELECT o_custkey AS id, round(sum(o_totalprice), 2) AS amount FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT CAST(n.id AS BIGINT) AS id, CASE WHEN action IS NOT NULL OR snap.id IS NULL THEN 'REMOVED' ELSE 'FOUND' END AS status,
  CASE WHEN action IS NULL THEN snap.amount END AS amount
FROM newest n LEFT JOIN snap ON snap.id = CAST(n.id AS BIGINT)"""


def stream_upsert(spark, d):
    """The change log as a stream of files, applied to a published version of the customers."""
    base = scratch_path(spark, "live")
    vs.publish_version(customers(spark, d), base, "customers", "id", 8)
    log = f"{base}/log"
    change_log(spark, d).repartitionByRange(3, "event_id").write.json(log)
    stream = ch.newest_per_id(ch.read_change_files(spark, log, max_files=2))
    apply = ch.ApplyChanges(base, "customers", "id", "modified", lambda: snapshot(spark, d))
    ch.run_changes(stream, apply, f"{base}/checkpoint", output_mode="update").awaitTermination()
    return vs.read_current(spark, base, "customers").select("id", "amount", "segment")


STREAM_SQL = f"""
WITH r AS ({RESOLVED_SQL})
SELECT c_custkey AS id, c_acctbal AS amount, c_mktsegment AS segment FROM customer WHERE c_custkey NOT IN (SELECT id FROM r)
UNION ALL SELECT id, amount, 'updated' FROM r WHERE status = 'FOUND'"""


def stream_newest(spark, d):
    """Newest change per user as a streaming aggregation."""
    base = scratch_path(spark, "newest")
    change_log(spark, d).repartitionByRange(3, "event_id").write.json(f"{base}/log")
    stream = ch.newest_per_id(ch.read_change_files(spark, f"{base}/log", max_files=1))
    query = stream.writeStream.outputMode("update").foreachBatch(
        lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{base}/out")
    ).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return latest_per_key(out, ["id"], [F.col("batch")]).drop("batch")


def streams_routed(spark, d):
    log = change_log(spark, d)
    both = ch.combine_streams({
        "shop": log.where("action is null").withColumnRenamed("id", "code"), "desk": log.where("action is not null"),
    }, {"shop": "code"})
    return ch.route_streams(both, {"shop": "products", "desk": "tickets"}).groupBy("dataset", "stream").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids")
    )


def stale(spark, d):
    """Order months as dated versions; the newest month of every status is live."""
    orders = table(spark, d, "orders")
    name = F.concat(F.lit("orders-"), F.lower("o_orderstatus"), F.date_format("o_orderdate", "-yyyy-MM"))
    versions = orders.select(name.alias("name")).union(orders.select(F.concat(F.lit("x"), name).alias("name"))).distinct()
    live = orders.groupBy("o_orderstatus").agg(F.max(name).alias("version")).select(F.col("o_orderstatus").alias("alias"), "version")
    return vs.stale_versions(versions, live, "orders")


# --- codes and images --------------------------------------------------------

def codes(spark, d):
    code = F.lpad(F.col("o_totalprice").cast("decimal(20,2)").cast("string"), 12, "0")
    plain = F.replace(code, F.lit("."), F.lit(""))
    return table(spark, d, "orders").select(
        "o_orderkey", code_path(F.concat(plain, F.col("o_orderkey").cast("string"))).alias("path"),
        code_path(F.concat(F.lit("org-"), F.col("o_orderstatus"), F.lit("/"), F.col("o_orderkey").cast("string"))).alias("short"),
        code_path(code).alias("none"),
    )


def part_images(spark, d):
    """An image map in the split layout made of a part's own values."""
    def sizes(n):
        size = F.struct(F.lit(n).alias("h"), F.col("p_size").alias("w"), F.lit("https://x/y").alias("url"))
        return F.create_map(F.lit("400"), size, F.lit("100"), size)

    def chosen(rev):
        generation = F.create_map(F.lit("angle"), F.col("p_size").cast("string"), F.lit("unlisted"), F.lit("x"))
        return F.struct(F.lit("1").alias("imgid"), rev.cast("string").alias("rev"), sizes(400).alias("sizes"), generation.alias("generation"))

    uploaded = F.create_map(F.lit("1"), F.struct(
        sizes(100).alias("sizes"), F.col("p_partkey").alias("uploaded_t"), F.col("p_brand").alias("uploader")
    ))
    selected = F.create_map(
        F.lit("front"), F.create_map(F.lit("en"), chosen(F.col("p_size")), F.lit("fr"), chosen(F.col("p_size") + 1)),
        F.lit("nutrition"), F.create_map(F.when(F.col("p_type") == "SMALL", F.lit("fr")).otherwise(F.lit("de")), chosen(F.col("p_size"))),
    )
    return table(spark, d, "part").select(
        "p_partkey", F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("code"), F.lit("en").alias("lang"),
        F.array(F.lit("fr"), F.lit("de"), F.lit("it")).alias("languages_codes"),
        F.struct(uploaded.alias("uploaded"), selected.alias("selected")).alias("images"),
    )


def images_flat(spark, d):
    flat = part_images(spark, d).select("p_partkey", F.explode(flatten_images(F.col("images"))).alias("key", "image"))
    return flat.select("p_partkey", "key", "image.imgid", "image.rev", "image.uploader", "image.angle", F.size("image.sizes").alias("n_sizes"))


def images_urls(spark, d):
    flat = part_images(spark, d).withColumn("images", flatten_images(F.col("images")))
    urls = image_urls(flat, "https://images.example.org/products")
    return urls.select(
        "p_partkey", "image_front_url", "image_front_small_url", "image_thumb_url", "image_nutrition_url",
        F.col("selected_images")["front"]["display"]["fr"].alias("front_fr"),
        F.col("selected_images")["nutrition"]["thumb"]["de"].alias("nutrition_de"),
        F.array_join(F.array_sort(F.map_keys("selected_images")), ",").alias("types"),
    )


IMAGE_SQL = """
WITH p AS (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS c FROM part),
q AS (SELECT *, 'https://images.example.org/products/' || c[1:3] || '/' || c[4:6] || '/' || c[7:9] || '/' || c[10:] || '/' AS u FROM p)
SELECT p_partkey, u || 'front_en.' || p_size || '.400.jpg' AS image_front_url, u || 'front_en.' || p_size || '.200.jpg' AS image_front_small_url,
  u || 'front_en.' || p_size || '.100.jpg' AS image_thumb_url, CAST(NULL AS VARCHAR) AS image_nutrition_url,
  u || 'front_fr.' || (p_size + 1) || '.400.jpg' AS front_fr,
  CASE WHEN p_type <> 'SMALL' THEN u || 'nutrition_de.' || p_size || '.100.jpg' END AS nutrition_de, 'front,nutrition' AS types
FROM q"""

# --- whole requests ------------------------------------------------------------

CATALOG = CollectionSpec(
    "catalog",
    (
        FieldSpec("id", "long"), FieldSpec("body", "text_lang", full_text=True), FieldSpec("source", "keyword", facet=True),
        FieldSpec("lang", "keyword", facet=True), FieldSpec("size", "long"), FieldSpec("modified", "date"),
    ),
    id_field="id", last_modified_field="modified", langs=LANGS,
)


def catalog(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.create_map(F.col("lang"), F.col("text")).alias("body"), "source", "lang",
        F.col("n_chars").alias("size"), F.col("n_chars").alias("modified"),
    )


def request(query, **options):
    return SearchRequest(query=query, langs=("en", "fr"), **options)


SORTED = request(
    all_of(any_of(Match("body", "the"), Phrase("body", "de la")), ge("size", 500), terms_any("source", ["src3", "src5", "src7"])),
    sort_by="-size", page=2, page_size=10, fields=("id", "source", "size", "body_en"),
    facets=("source", "lang"), charts=(Distribution("source"), Scatter("id", "size")),
)
SORTED_BASE = f"""
SELECT doc_id AS id, source, lang, n_chars AS size, CASE WHEN lang = 'en' THEN text END AS body_en FROM (
  SELECT *, {tokens_sql('text', fold=False)} AS tokens FROM documents)
WHERE n_chars >= 500 AND source IN ('src3', 'src5', 'src7') AND lang IN ('en', 'fr')
  AND (list_contains(tokens, 'the') OR contains(' ' || array_to_string(tokens, ' ') || ' ', ' de la '))"""


def search_hits(spark, d):
    return search(catalog(spark, d), CATALOG, SORTED).hits.withColumn("body_en", F.md5("body_en"))


def search_facets(spark, d):
    return search(catalog(spark, d), CATALOG, SORTED, buckets=2).facets


def search_charts(spark, d):
    return search(catalog(spark, d), CATALOG, SORTED).charts["id:size"]


def search_summary(spark, d):
    return search(catalog(spark, d), CATALOG, SORTED).summary


RANKED = request(all_of(MatchAny("erenst"), MatchAny("the").boosted(2.0), Term("source", "src8").boosted(1.5) | ge("size", 0)), page_size=25)


def search_ranked(spark, d):
    return search(catalog(spark, d), CATALOG, RANKED).hits.select("id", F.round("_score", 6).alias("score"))


RANKED_SQL = f"""
WITH corpus AS MATERIALIZED (SELECT doc_id, lang, source, {tokens_sql('text', fold=False)} AS tokens FROM documents WHERE lang IN ('en', 'fr')),
tf AS MATERIALIZED (SELECT doc_id, lang, len(tokens) AS length, t.term, len(list_filter(tokens, lambda x: x = t.term)) AS tf
  FROM corpus, (SELECT unnest(['erenst', 'the']) AS term) t WHERE list_contains(tokens, t.term)),
df AS (SELECT lang, term, count(*) AS doc_freq FROM tf GROUP BY ALL),
stats AS (SELECT lang, count(*) AS n_docs, avg(len(tokens)) AS avg_length FROM corpus GROUP BY ALL),
w AS (SELECT *, ln(1 + (n_docs - doc_freq + 0.5) / (doc_freq + 0.5)) AS idf FROM tf JOIN df USING (lang, term) JOIN stats USING (lang)),
s AS (SELECT doc_id, sum(CASE WHEN term = 'the' THEN 2 ELSE 1 END * {BM25_SQL}) AS s FROM w GROUP BY doc_id HAVING count(*) = 2)
SELECT doc_id AS id, round(s + 1 + CASE WHEN source = 'src8' THEN 1.5 ELSE 0 END, 6) AS score FROM s JOIN corpus USING (doc_id)
ORDER BY s + CASE WHEN source = 'src8' THEN 1.5 ELSE 0 END DESC, doc_id LIMIT 25"""


def search_nested(spark, d):
    """An OR of a group and single clauses; words of a group that is not met do not count."""
    query = any_of(all_of(MatchAny("erenst"), Term("source", "src8")), ge("size", 9000), Term("source", "src9"))
    return search(catalog(spark, d), CATALOG, request(query, page_size=5000)).hits.select("id", F.round("_score", 6).alias("score"))


NESTED_SQL = f"""
WITH corpus AS MATERIALIZED (SELECT doc_id, lang, source, n_chars, {tokens_sql('text', fold=False)} AS tokens FROM documents WHERE lang IN ('en', 'fr')),
tf AS MATERIALIZED (SELECT doc_id, lang, len(tokens) AS length, len(list_filter(tokens, lambda x: x = 'erenst')) AS tf
  FROM corpus WHERE list_contains(tokens, 'erenst')),
df AS (SELECT lang, count(*) AS doc_freq FROM tf GROUP BY ALL),
stats AS (SELECT lang, count(*) AS n_docs, avg(len(tokens)) AS avg_length FROM corpus GROUP BY ALL),
w AS (SELECT *, ln(1 + (n_docs - doc_freq + 0.5) / (doc_freq + 0.5)) AS idf FROM tf JOIN df USING (lang) JOIN stats USING (lang)),
s AS (SELECT doc_id, {BM25_SQL} AS s FROM w)
SELECT documents.doc_id AS id, round(CASE WHEN source = 'src8' AND s IS NOT NULL THEN s + 1 ELSE 0 END
  + CASE WHEN n_chars >= 9000 THEN 1 ELSE 0 END + CASE WHEN source = 'src9' THEN 1 ELSE 0 END, 6) AS score
FROM documents LEFT JOIN s USING (doc_id) WHERE (source = 'src8' AND s IS NOT NULL) OR n_chars >= 9000 OR source = 'src9'"""


def import_partial(spark, d):
    """A full import of the feed, then a partial one of the toxic documents with new tags only."""
    base = scratch_path(spark, "import")
    feed = wide_documents(spark, d)
    import_documents(feed, FEED, base, buckets=4)
    some = feed.join(toxic_ids(spark, d), F.col("code") == F.col("id"), "left_semi")
    import_documents(some.select("code", "lang", F.lit("new,newer").alias("tags"), "modified"), FEED, base, partial=True)
    live = vs.read_current(spark, base, "feed")
    return live.select("code", F.array_join("labels", "|").alias("labels"), F.length(F.col("body")["main"]).alias("chars"))


FEED_OK = "source <> 'src0' AND doc_id NOT IN (1, 2)"
TOXIC = "SELECT doc_id FROM labels WHERE toxic = 1"

QUERIES = {
    "normalize_documents": Query(normalized, f"""
SELECT CAST(doc_id AS VARCHAR) AS code, CASE WHEN lang = 'en' AND n_chars <> 0 THEN n_chars END AS size,
  CASE WHEN source = 'src1' THEN true END AS flag, CASE WHEN n_chars <> 0 THEN n_chars END AS modified,
  source || '|' || lang AS labels, CASE WHEN lang = 'es' THEN 'main' WHEN lang IN ('de', 'en', 'fr') AND lang < 'main' THEN lang || '|main' ELSE 'main|' || lang END AS langs,
  CAST(length(text) AS INTEGER) AS chars
FROM documents WHERE {FEED_OK} AND doc_id NOT IN ({TOXIC})"""),
    "rejected_documents": Query(rejected, f"""
SELECT CASE WHEN source = 'src0' THEN 'missing id' ELSE 'denied id' END AS reason, count(*) AS n
FROM documents WHERE NOT ({FEED_OK} AND doc_id NOT IN ({TOXIC})) GROUP BY ALL"""),
    "fold_languages": Query(folded, """
WITH m AS (SELECT source || ',' || lang || ',' || source AS tags, 'main' AS key, text FROM documents
           UNION ALL SELECT source || ',' || lang || ',' || source, lang, text FROM documents WHERE lang IN ('de', 'en', 'fr'))
SELECT tags, key, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM m WHERE text <> '' GROUP BY ALL"""),
    "flatten_languages": Query(flattened, """
SELECT CASE WHEN source <> 'src0' THEN CAST(doc_id AS VARCHAR) END AS code, source || ',' || lang || ',' || source AS tags_main, md5(text) AS body,
  CASE WHEN lang = 'fr' THEN md5(text) END AS body_fr, CASE WHEN lang = 'de' THEN md5(text) END AS body_de FROM documents"""),
    "normalize_events": Query(normalize_events, """
SELECT CAST(event_id AS VARCHAR) AS id, CAST(floor(epoch(ts)) AS BIGINT) AS at, CASE WHEN value <> 0 THEN value END AS value,
  nullif(CAST(json_extract(props, '$.k') AS INTEGER), 0) AS k, event_type AS kind,
  CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) <> 0 THEN true END AS has_k FROM events"""),
    "ingest_report": Query(ingest_report, f"""
SELECT CASE WHEN lang = 'de' THEN 'corrupt' WHEN source = 'src0' THEN 'missing id' WHEN doc_id IN ({TOXIC}) THEN 'denied id' ELSE 'accepted' END AS outcome,
  count(*) AS n FROM documents WHERE lang <> 'es' GROUP BY ALL"""),
    "read_documents": Query(read_jsonl, """
SELECT CASE WHEN source <> 'src0' THEN CAST(doc_id AS VARCHAR) END AS code, source, md5(text) AS text FROM documents WHERE lang NOT IN ('de', 'es')"""),
    "first_rows": Query(first_rows, "SELECT CAST(least(count(*), 100) AS BIGINT) AS n FROM documents WHERE lang <> 'es'"),
    "stamped_import": Query(stamped, f"""
SELECT count(*) AS n, count(*) AS n_stamped, CAST(0 AS BIGINT) AS n_lower FROM documents WHERE {FEED_OK}"""),
    "taxonomy_import": Query(taxonomy_import, """
SELECT * FROM (VALUES ('nodes', 0), ('edges', 0), ('names', -1), ('synonyms', NULL)) v(part, more)
JOIN LATERAL (SELECT CASE WHEN part = 'synonyms' THEN count(*) * 2 WHEN part = 'names' THEN count(*) FILTER (n_name <> 'FRANCE') ELSE count(*) END AS n
  FROM nation) ON true""".replace("SELECT *", "SELECT part, CAST(n AS BIGINT) AS n", 1)),
    "taxonomy_import_lines": Query(taxonomy_import_lines, """
WITH p AS (SELECT 'en:part-' || p_partkey AS id, * FROM part),
found AS (
  SELECT 'nodes' AS part, id, CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS VARCHAR) AS value FROM p
  UNION ALL SELECT 'edges', id, NULL, lower(p_type) FROM p
  UNION ALL SELECT 'edges', id, NULL, lower(p_brand) FROM p WHERE lower(p_brand) <> lower(p_type)
  UNION ALL SELECT 'names', id, 'en', p_name FROM p WHERE p_name <> '' AND id NOT LIKE '%7'
  UNION ALL SELECT 'names', id, 'fr', CAST(p_size AS VARCHAR) FROM p WHERE p_size % 2 = 0
  UNION ALL SELECT 'synonyms', id, 'xx', '0:' || lower(p_brand) FROM p
  UNION ALL SELECT 'synonyms', id, 'xx', '1:' || p_brand FROM p WHERE p_brand <> lower(p_brand)
  UNION ALL SELECT 'synonyms', id, 'en', '1:' || p_size FROM p)
SELECT part, 'parts' AS taxonomy, id, lang, value FROM found"""),
    "merge_other_buckets": Query(merge_other_buckets, UPSERT_SQL),
    "stream_restarted": Query(stream_restarted, STREAM_SQL),
    "stream_tail": Query(stream_tail, STREAM_SQL),
    "batch_lookup": Query(batch_lookup, """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)"""),
    "route_by_status": Query(status_routes, """
SELECT CASE event_type WHEN 'view' THEN 'index' WHEN 'click' THEN 'index' WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'retry' ELSE 'ignored' END AS route,
  count(*) AS n FROM events GROUP BY ALL"""),
    "upsert_merge": Query(upsert_merge, UPSERT_SQL),
    "publish_roundtrip": Query(publish_roundtrip, UPSERT_SQL),
    "import_partial": Query(import_partial, f"""
SELECT CAST(doc_id AS VARCHAR) AS code, CASE WHEN doc_id IN ({TOXIC}) THEN 'new|newer' ELSE source || '|' || lang END AS labels,
  CAST(CASE WHEN doc_id NOT IN ({TOXIC}) THEN length(text) END AS INTEGER) AS chars FROM documents WHERE {FEED_OK}"""),
    "latest_per_key": Query(latest_events, """
SELECT DISTINCT ON (user_id) user_id, event_id, event_type, value FROM events ORDER BY user_id, ts DESC, event_id DESC"""),
    "replay_changes": Query(replay, f"WITH {LOG_SQL.format(since=SINCE)} SELECT ms || '-' || seq AS event_id, id, action FROM newest"),
    "resolve_changes": Query(resolved, RESOLVED_SQL),
    "stream_upsert": Query(stream_upsert, STREAM_SQL),
    "stream_newest": Query(stream_newest, f"WITH {LOG_SQL.format(since=0)} SELECT ms || '-' || seq AS event_id, id, action FROM newest"),
    "streams_routed": Query(streams_routed, """
SELECT CASE WHEN event_type = 'error' THEN 'tickets' ELSE 'products' END AS dataset, CASE WHEN event_type = 'error' THEN 'desk' ELSE 'shop' END AS stream,
  count(*) AS n, count(DISTINCT user_id) AS n_ids FROM events GROUP BY ALL"""),
    "stale_versions": Query(stale, """
WITH v AS (SELECT DISTINCT o_orderstatus, 'orders-' || lower(o_orderstatus) || strftime(o_orderdate, '-%Y-%m') AS name FROM orders)
SELECT name FROM v WHERE name NOT IN (SELECT max(name) FROM v GROUP BY o_orderstatus)"""),
    "code_path": Query(codes, """
WITH c AS (SELECT *, lpad(CAST(CAST(o_totalprice AS DECIMAL(20, 2)) AS VARCHAR), 12, '0') AS code FROM orders),
f AS (SELECT *, replace(code, '.', '') || o_orderkey AS full_code FROM c)
SELECT o_orderkey, full_code[1:3] || '/' || full_code[4:6] || '/' || full_code[7:9] || '/' || full_code[10:] AS path,
  o_orderkey || '/org-' || o_orderstatus AS short, CAST(NULL AS VARCHAR) AS "none" FROM f"""),
    "flatten_images": Query(images_flat, """
SELECT p_partkey, '1' AS key, CAST(NULL AS VARCHAR) AS imgid, CAST(NULL AS VARCHAR) AS rev, p_brand AS uploader, CAST(NULL AS VARCHAR) AS angle, 2 AS n_sizes FROM part
UNION ALL SELECT p_partkey, 'front_en', '1', CAST(p_size AS VARCHAR), NULL, CAST(p_size AS VARCHAR), 2 FROM part
UNION ALL SELECT p_partkey, 'front_fr', '1', CAST(p_size + 1 AS VARCHAR), NULL, CAST(p_size AS VARCHAR), 2 FROM part
UNION ALL SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'nutrition_fr' ELSE 'nutrition_de' END, '1', CAST(p_size AS VARCHAR), NULL, CAST(p_size AS VARCHAR), 2 FROM part"""),
    "image_urls": Query(images_urls, IMAGE_SQL),
    "search_hits": Query(search_hits, f"SELECT id, source, size, md5(body_en) AS body_en FROM ({SORTED_BASE}) ORDER BY size DESC, id LIMIT 10 OFFSET 10"),
    "search_facets": Query(search_facets, facets_sql(SORTED_BASE, {"source": "source", "lang": "lang"}, 2, {"source": ["src3", "src5", "src7"]})),
    "search_charts": Query(search_charts, f"SELECT CAST(id AS DOUBLE) AS x, CAST(size AS DOUBLE) AS y FROM ({SORTED_BASE}) ORDER BY size DESC, id LIMIT 10 OFFSET 10"),
    "search_summary": Query(search_summary, f"SELECT count(*) AS count, CAST(ceil(count(*) / 10.0) AS BIGINT) AS page_count, true AS is_count_exact FROM ({SORTED_BASE})"),
    "search_ranked": Query(search_ranked, RANKED_SQL),
    "search_nested": Query(search_nested, NESTED_SQL),
}
