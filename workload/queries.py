"""One query per operator. Each takes (spark, sf_dir), reads whole tables and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe import fixed
from fleetframe.functions import parse_pairs, parse_version, drop_log_lines
from fleetframe.operators import actions, catalog, inventory, layout, planning, properties, rollup
from fleetframe.operators.skew import hot_keys
from fleetframe.plans import deployments, reports
from fleetframe.session import scratch_path
from fleetframe.sources import archive, catalog as store, landing, page_index, verify
from fleetframe.sources.nodes import land, typed_nodes
from fleetframe.streaming import jobs
from workload import views as v

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_nodes(v.landed(spark, sf_dir))


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of this fleet, running or not."""
    return inventory.scan_landed(nodes(spark, sf_dir), v.SCHEME, include_stopped=True)


def odd_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_nodes(v.landed(spark, sf_dir, v.ODD_INV))


def wide_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_nodes(v.landed(spark, sf_dir, v.WIDE_INV))


def families(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and managers; sets of every eighth number play the application databases of the managers two below them."""
    plain = nodes(spark, sf_dir)
    number = F.substring("grp", 5, 20).cast("long")
    app_db = F.concat(F.lit("dep-"), (number - 2).cast("string"), F.lit(fixed.APP_DB_SUFFIX))
    named = plain.withColumn("grp", F.when(number % 8 == 6, app_db).otherwise(F.col("grp")))
    return named, plain.where(F.col("type") == fixed.MANAGER).select(F.col("grp").alias("manager"))


# --- inventory ------------------------------------------------------------------------------------------------------


@query
def inventory_scan(spark, sf_dir):
    kept = inventory.with_label(inventory.scan_records(v.records(spark, sf_dir), v.SCHEME), v.SCHEME, "group")
    return land(kept, v.SCHEME).select("seq", "grp", "node", "status", "source")


@query
def named_scan(spark, sf_dir):
    # A name replaces the source filter: members of any source, stopped ones too.
    named = inventory.scan_landed(nodes(spark, sf_dir), v.SCHEME, name="dep-1", include_stopped=True)
    return named.select("seq", "grp", "node", "status", "source")


@query
def version_source(spark, sf_dir):
    return typed_nodes(land(v.records(spark, sf_dir), v.SCHEME)).select(
        "seq", "type", "version", "port", "shard_id", "shard_count", F.col("arbiter").cast("int").alias("arbiter"), "id"
    )


@query
def label_overlay(spark, sf_dir):
    flat = inventory.flat_labels(v.records(spark, sf_dir), v.SCHEME)
    return flat.select("seq", F.explode("labels").alias("key", "value"))


@query
def lookup_found_missing(spark, sf_dir):
    names = v.table(spark, sf_dir, "orders").select(F.concat(F.lit("dep-"), F.col("o_custkey").cast("string")).alias("grp"))
    all_nodes = nodes(spark, sf_dir)
    found = inventory.found(all_nodes, names).select("grp", "node", F.lit("found").alias("outcome"))
    lost = inventory.missing(all_nodes, names)
    return found.unionByName(
        lost.select("grp", F.lit(None).cast("string").alias("node"), F.lit("missing").alias("outcome"))
    )


@query
def manager_children(spark, sf_dir):
    named, managers = families(spark, sf_dir)
    return inventory.children(named, managers).select("manager", "relation", "grp", "node")


@query
def manager_removal(spark, sf_dir):
    return actions.family_removal(*families(spark, sf_dir)).select("manager", "step", "relation", "node", "remove_dir")


@query
def server_manager(spark, sf_dir):
    all_nodes = nodes(spark, sf_dir)
    servers = all_nodes.where(F.col("type") == fixed.SERVER_GROUP).select("seq", "node", F.col("parent").alias("om_name"))
    managers = all_nodes.where(F.col("type") == fixed.MANAGER).withColumn("node", F.col("grp"))
    return inventory.attach_manager(servers, managers).select("seq", "node", "om_name", "om_network", "om_url")


@query
def server_without_manager(spark, sf_dir):
    all_nodes = nodes(spark, sf_dir)
    servers = all_nodes.where(F.col("type") == fixed.SERVER_GROUP).select("seq", "node", F.col("parent").alias("om_name"))
    managers = all_nodes.where(F.col("type") == fixed.MANAGER).withColumn("node", F.col("grp"))
    return inventory.without_manager(servers, managers).select("seq", "node", "om_name")


@query
def grouped_nodes(spark, sf_dir):
    slim = nodes(spark, sf_dir).select("seq", "grp", "node", "status")
    gathered = inventory.grouped(slim)
    return gathered.select(
        "grp", "part", F.size("members").alias("size"),
        F.array_join(F.transform("members", lambda m: F.concat(m["node"], F.lit(":"), m["status"])), " ").alias("members"),
    )


@query
def bulk_targets(spark, sf_dir):
    return inventory.bulk_targets(nodes(spark, sf_dir))


@query
def safe_paths(spark, sf_dir):
    return actions.safe_paths(nodes(spark, sf_dir)).select("seq", "node", "data_dir")


# --- roll-ups -------------------------------------------------------------------------------------------------------


def summary(rows: DataFrame) -> DataFrame:
    return rollup.rollup(rows).select(
        *rollup.SUMMARY_COLUMNS, "start_port", "max_port", F.col("rows").alias("n_rows"),
        "running_rows", "stopped_rows", "layout_error",
    )


@query
def deployment_summary(spark, sf_dir):
    return summary(nodes(spark, sf_dir))


@query
def running_deployments(spark, sf_dir):
    return deployments.list_deployments(nodes(spark, sf_dir))


@query
def cluster_counts(spark, sf_dir):
    return rollup.role_counts(nodes(spark, sf_dir))


@query
def member_order(spark, sf_dir):
    return layout.member_order(nodes(spark, sf_dir)).select("grp", "seq", "port", "member_no")


@query
def shard_chunks(spark, sf_dir):
    clusters = nodes(spark, sf_dir).where(F.col("type") == fixed.SHARDED)
    return layout.shard_members(clusters).select(
        "grp", "node", "shard_id", "port", "member_no", "chunk", F.col("layout_error").cast("int").alias("layout_error")
    )


@query
def shard_headers(spark, sf_dir):
    clusters = nodes(spark, sf_dir).where(F.col("type") == fixed.SHARDED)
    return layout.shard_headers(layout.shard_members(clusters))


@query
def host_strings(spark, sf_dir):
    return deployments.host_strings(nodes(spark, sf_dir)).select("grp", "part", "parts", "hosts", "uri", "set_address")


@query
def host_rows(spark, sf_dir):
    return deployments.host_rows(nodes(spark, sf_dir))


@query
def cluster_addresses(spark, sf_dir):
    return deployments.cluster_addresses(nodes(spark, sf_dir))


@query
def wide_host_strings(spark, sf_dir):
    # Three sets hold all order lines: lists in parts, and no text that is not whole.
    listed = deployments.host_strings(wide_nodes(spark, sf_dir), part_rows=1000)
    return listed.select("grp", "part", "parts", "hosts", "uri", "set_address")


@query
def wide_member_order(spark, sf_dir):
    # All three groups count as hot, so they are numbered by the range sort.
    slim = wide_nodes(spark, sf_dir).select("grp", "seq", "port")
    return layout.member_order(slim, hot=hot_keys(slim, ["grp"], 1000)).select("grp", "seq", "port", "member_no")


@query
def odd_report_rows(spark, sf_dir):
    return reports.list_rows(odd_nodes(spark, sf_dir))


@query
def odd_detail_rows(spark, sf_dir):
    return reports.detail_rows(odd_nodes(spark, sf_dir))


@query
def odd_host_strings(spark, sf_dir):
    listed = deployments.host_strings(odd_nodes(spark, sf_dir))
    return listed.select("grp", "hosts", "uri", F.col("name_error").cast("int").alias("name_error"))


@query
def report_lines(spark, sf_dir):
    return reports.report_lines(reports.summary_json(fleet(spark, sf_dir)))


@query
def endpoint_strings(spark, sf_dir):
    return deployments.endpoints(nodes(spark, sf_dir))


@query
def nested_documents(spark, sf_dir):
    return deployments.detailed_documents(fleet(spark, sf_dir))


@query
def summary_json(spark, sf_dir):
    return reports.summary_json(fleet(spark, sf_dir))


@query
def report_rows(spark, sf_dir):
    return reports.list_rows(fleet(spark, sf_dir))


@query
def detail_rows(spark, sf_dir):
    return reports.detail_rows(fleet(spark, sf_dir))


@query
def action_order(spark, sf_dir):
    listed = actions.action_list(nodes(spark, sf_dir))
    return listed.select("grp", "action", "step", "node", F.col("idle").cast("int").alias("idle"), "remove_dir")


# --- catalogue ------------------------------------------------------------------------------------------------------


@query
def pages_scan(spark, sf_dir):
    # A hundred tags to a page, written as JSON page files and read back.
    tags = v.view(spark, sf_dir, v.TAGS)
    number = F.expr("seq div 100")
    pages = tags.groupBy(number.alias("page")).agg(
        F.collect_list(F.struct(F.col("tag").alias("name"))).alias("results"),
        F.lit("more").alias("next"),
    )
    path = scratch_path(spark, "pages")
    pages.select("results", "next").write.json(path)
    return catalog.name_filter(store.read_pages(spark, path), must_include=".", must_exclude="-rc")


@query
def tag_filter(spark, sf_dir):
    docs = catalog.tag_documents(v.view(spark, sf_dir, v.TAGS))
    return catalog.version_filter(docs, "7.1").select("seq", "tag", "major", "minor", "patch")


@query
def tag_name_filter(spark, sf_dir):
    return catalog.name_filter(v.view(spark, sf_dir, v.TAGS), must_include="7.", must_exclude="-rc").select("seq", "tag")


@query
def tag_enrich(spark, sf_dir):
    docs = catalog.tag_documents(v.view(spark, sf_dir, v.ODD_TAGS))
    return docs.select(
        "seq", "tag", "group", F.array_join("fragments", "|").alias("fragments"),
        F.col("release_candidate").cast("int").alias("release_candidate"), "major", "minor", "patch",
        F.col("parse_error").cast("int").alias("parse_error"),
    )


@query
def semver_parse(spark, sf_dir):
    parsed = v.view(spark, sf_dir, v.ODD_TAGS).select("seq", "tag", parse_version(F.col("tag")).alias("p"))
    return parsed.select("seq", "tag", "p.major", "p.minor", "p.patch", F.col("p.parse_error").cast("int").alias("parse_error"))


@query
def tag_groups(spark, sf_dir):
    return catalog.grouped_tags(v.view(spark, sf_dir, v.TAGS)).select("group", "place", "tag", "seq")


@query
def tag_group_sizes(spark, sf_dir):
    return catalog.group_sizes(v.view(spark, sf_dir, v.TAGS))


@query
def tag_page(spark, sf_dir):
    page = catalog.tag_page(v.view(spark, sf_dir, v.TAGS), page=2, page_size=40)
    return page.select("place", "tag", F.col("has_more").cast("int").alias("has_more"))


def indexed(spark: SparkSession, sf_dir: str) -> str:
    """All tags in an indexed catalogue, with ranges small enough for many of them."""
    root = scratch_path(spark, "catalog")
    store.append_batch(catalog.tag_documents(v.view(spark, sf_dir, v.TAGS)), root, "load", 0)
    page_index.index_catalog(spark, root, range_rows=64)
    return root


@query
def tag_page_deep(spark, sf_dir):
    # The fourth page, the fifth of version 5 and the second of 7.1, from the index.
    root = indexed(spark, sf_dir)
    pages = [page_index.list_indexed_tags(spark, root, n, 20, version).withColumn("version", F.lit(version or "")) for n, version in ((4, None), (5, "5"), (2, "7.1"))]
    every = pages[0].unionByName(pages[1]).unionByName(pages[2])
    return every.select("version", "place", "tag", F.col("has_more").cast("int").alias("has_more"))


@query
def tag_page_after(spark, sf_dir):
    root = indexed(spark, sf_dir)
    pages = [page_index.list_indexed_tags(spark, root, page_size=30, after=after).withColumn("after", F.lit(after)) for after in ("latest", "6.0.2", "4", "0")]
    every = pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])
    return every.select("after", "place", "tag", F.col("has_more").cast("int").alias("has_more"))


@query
def tag_batches(spark, sf_dir):
    tags = v.view(spark, sf_dir, v.TAGS)
    return layout.fixed_chunks(tags, [], [F.col("tag"), F.col("seq")]).select("seq", "tag", "position", "chunk")


@query
def tag_upsert(spark, sf_dir):
    old = v.view(spark, sf_dir, v.OLD_TAGS).groupBy("tag").agg(F.min("seq").alias("seq"))
    target = old.select("tag", "seq", F.lit("stale").alias("group"), F.lit(None).cast("int").alias("major"))
    source = catalog.tag_documents(v.view(spark, sf_dir, v.TAGS)).select("tag", "seq", "group", "major")
    return store.upsert(target, source)


@query
def archive_links(spark, sf_dir):
    return catalog.archive_links(v.archives(spark, sf_dir), "6.0.1", "x86_64", "rpm", "tar.gz")


@query
def archive_links_landed(spark, sf_dir):
    path = scratch_path(spark, "archives")
    archive.land_archives(v.archives(spark, sf_dir), path, files=8)
    return archive.landed_links(archive.read_landed_archives(spark, path), "6.0.1", "x86_64", "rpm", "tar.gz")


# --- planning -------------------------------------------------------------------------------------------------------


@query
def spec_violations(spark, sf_dir):
    return planning.violations(planning.with_defaults(v.specs(spark, sf_dir)))


@query
def spec_capacity(spark, sf_dir):
    ready = planning.valid_specs(planning.with_defaults(v.specs(spark, sf_dir)))
    return planning.capacity(ready)


@query
def topology_nodes(spark, sf_dir):
    ready = planning.valid_specs(planning.with_defaults(v.specs(spark, sf_dir)))
    return planning.expand(ready).select(
        "seq", "grp", "node", "port", "role", "deployment_type", "shard_id", F.col("arbiter").cast("int").alias("arbiter")
    )


@query
def topology_labels(spark, sf_dir):
    ready = planning.valid_specs(planning.with_defaults(v.specs(spark, sf_dir)))
    labelled = planning.node_labels(ready, v.SCHEME, "/data")
    return labelled.select("seq", "node", F.explode("labels").alias("key", "value"))


@query
def server_group_labels(spark, sf_dir):
    labelled = planning.server_labels(v.view(spark, sf_dir, v.SERVER_SPEC), v.SCHEME)
    return labelled.select("seq", "node", F.explode("labels").alias("key", "value"))


@query
def manager_labels(spark, sf_dir):
    managers = v.view(spark, sf_dir, v.SERVER_SPEC).select("seq", "name", "port", F.lit("net").alias("network_name"))
    labelled = planning.manager_labels(managers, v.SCHEME)
    return labelled.select("seq", "app_db", F.explode("labels").alias("key", "value"))


@query
def planned_summary(spark, sf_dir):
    # Specs are expanded and labelled, read back as node records and rolled up again.
    ready = planning.valid_specs(planning.with_defaults(v.specs(spark, sf_dir)))
    labelled = planning.node_labels(ready, v.SCHEME, "/data").withColumns({
        "seq": F.col("seq") * 100000 + F.col("slot"),
        "id": F.md5("node"),
        "status": F.lit(fixed.RUNNING),
        "env": F.array(F.lit("MONGO_VERSION=7.0.1")),
        "image_tags": F.lit(None).cast("array<string>"),
    })
    scanned = inventory.scan_records(labelled, v.SCHEME)
    return rollup.summaries(typed_nodes(land(scanned, v.SCHEME)))


@query
def connection_strings(spark, sf_dir):
    ready = planning.valid_specs(planning.with_defaults(v.specs(spark, sf_dir)))
    return planning.connections(ready).select(
        "seq", "name", F.array_join("localhost", " ").alias("localhost"), F.array_join("mapped", " ").alias("mapped")
    )


@query
def repeated_names(spark, sf_dir):
    # Two specs to a name: the earlier one keeps it.
    halved = v.specs(spark, sf_dir).withColumn("name", F.concat(F.lit("dep-"), F.expr("seq div 2").cast("string")))
    return planning.repeated_names(halved).select("seq", "name")


@query
def name_collisions(spark, sf_dir):
    return planning.name_collisions(v.specs(spark, sf_dir), nodes(spark, sf_dir)).select("seq", "name", "kind")


@query
def free_names(spark, sf_dir):
    return planning.free_names(v.specs(spark, sf_dir), nodes(spark, sf_dir)).select("seq", "name", "kind")


@query
def port_conflicts(spark, sf_dir):
    ready = planning.valid_specs(planning.with_defaults(v.specs(spark, sf_dir)))
    return planning.port_conflicts(ready, nodes(spark, sf_dir))


@query
def host_port_conflicts(spark, sf_dir):
    # Specs and nodes dealt over eleven hosts; every eleventh spec has none.
    ready = planning.valid_specs(planning.with_defaults(v.specs(spark, sf_dir)))
    host = lambda key: F.concat(F.lit("host-"), (key % 11).cast("string"))
    placed = ready.withColumn("host", F.when(F.col("seq") % 11 != 4, host(F.col("seq"))))
    used = nodes(spark, sf_dir).withColumn("host", F.when(F.col("seq") % 13 != 0, host(F.col("seq"))))
    return planning.host_port_conflicts(placed, used)


# --- text and streams -----------------------------------------------------------------------------------------------


@query
def mask_credentials(spark, sf_dir):
    masked = jobs.mask_records(v.log_records(v.view(spark, sf_dir, v.LOGS)))
    return masked.select("seq", "msg", F.col("args")[1].alias("arg"), F.col("kwargs")["uri"].alias("uri"))


@query
def mask_credentials_strict(spark, sf_dir):
    masked = jobs.mask_records(v.log_records(v.view(spark, sf_dir, v.LOGS)), strict=True)
    return masked.select("seq", "msg")


@query
def mask_documents(spark, sf_dir):
    # Whole documents of any length go through the same functions.
    docs = v.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("msg"))
    return jobs.mask_records(docs).select("doc_id", drop_log_lines(F.col("msg")).alias("text"))


@query
def drop_server_log(spark, sf_dir):
    return v.view(spark, sf_dir, v.LOGS).select("seq", drop_log_lines(F.col("line")).alias("line"))


@query
def kv_parse(spark, sf_dir):
    parsed = v.view(spark, sf_dir, v.PAIR_TEXT).select("page_id", parse_pairs(F.col("text"), "&", "=").alias("p"))
    return parsed.select("page_id", F.explode("p.pairs").alias("key", "value"))


@query
def property_overlay(spark, sf_dir):
    texts = v.view(spark, sf_dir, v.PAIR_TEXT)
    base = properties.property_lines(texts, "page_id", "text", "&")
    updates = v.table(spark, sf_dir, "pages").select(
        "page_id", F.explode(F.array(F.lit("ref"), F.lit("host"))).alias("key"),
        F.expr("split_part(split_part(url, '/', 3), ':', 1)").alias("value"), F.col("page_id").alias("seq"),
    )
    return properties.overlay_properties(base, updates, "page_id")


@query
def property_files(spark, sf_dir):
    # Whole files with a comment and a blank line; the settings go over them.
    texts = v.view(spark, sf_dir, v.PAIR_TEXT).withColumn("text", F.concat(F.lit("# page=old\n\n"), F.replace("text", F.lit("&"), F.lit("\n"))))
    lines = properties.file_lines(texts, "page_id")
    updates = v.table(spark, sf_dir, "pages").select(
        "page_id", F.explode(F.array(F.lit("page"), F.lit("host"))).alias("key"), F.lit("new").alias("value"), F.col("page_id").alias("seq")
    )
    return properties.overlay_file(lines, updates, "page_id")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # A pattern, because a plain path has to be a folder and a test table may be one file.
    schema = v.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query
def stream_mask(spark, sf_dir):
    logs = spark.sql(v.LOGS, events=table_stream(spark, sf_dir, "events"))
    out = scratch_path(spark, "masked")
    jobs.start_masking(v.log_records(logs), out, scratch_path(spark, "masked-checkpoint"), once=True).awaitTermination()
    done = spark.read.parquet(out)
    return done.select("seq", "msg", F.col("args")[1].alias("arg"), F.col("kwargs")["uri"].alias("uri"))


@query
def stream_catalog(spark, sf_dir):
    tags = spark.sql(v.TAGS, part=table_stream(spark, sf_dir, "part"))
    root = scratch_path(spark, "catalog")
    jobs.start_catalog_refresh(tags, root, scratch_path(spark, "catalog-checkpoint"), once=True).awaitTermination()
    return store.read_catalog(spark, root).select("tag", "seq", "group", "major", "minor", "patch")


@query
def catalog_writers(spark, sf_dir):
    # Two streams and two loads into one catalogue, with equal batch numbers, some run again; then one compaction.
    root = scratch_path(spark, "catalog")
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")
    old = catalog.tag_documents(v.view(spark, sf_dir, v.OLD_TAGS)).withColumn("imported_at", at(1))
    for _ in range(2):
        store.append_batch(old, root, "load/old", 0)
    later = catalog.tag_documents(v.view(spark, sf_dir, v.TAGS).where("seq % 2 = 0")).withColumn("imported_at", at(2))
    store.append_batch(later, root, "load/later", 0)
    for rest in (0, 1):
        tags = spark.sql(v.TAGS, part=table_stream(spark, sf_dir, "part")).where(F.col("seq") % 4 == 2 * rest + 1)
        checkpoint = scratch_path(spark, "catalog-checkpoint")
        for _ in range(2):
            jobs.start_catalog_refresh(tags, root, checkpoint, once=True).awaitTermination()
    store.compact(spark, root)
    return store.read_catalog(spark, root).select("tag", "seq", "group", "major")


def page_files(spark: SparkSession, sf_dir: str) -> str:
    """Tags as page files of every kind: even pages indented by line, odd ones in one line, and for every tenth page a file that is no page."""
    tags = v.view(spark, sf_dir, v.TAGS)
    entry = F.concat(F.lit('{"name": "'), F.col("tag"), F.lit('"}'))
    pages = tags.groupBy(F.expr("seq div 100").alias("page")).agg(F.sort_array(F.collect_list(entry)).alias("names"))
    joined = lambda gap: F.concat(F.lit('{"results": ['), F.array_join("names", f",{gap}"), F.lit(f'],{gap}"next": null}}'))
    good = pages.select("page", F.when(F.col("page") % 2 == 0, joined("\n  ")).otherwise(joined(" ")).alias("value"))
    broken = pages.where("page % 10 = 3").select("page", F.lit('{"results": [').alias("value"))
    path = scratch_path(spark, "page-files")
    # One document to a file: every document has a folder of its own.
    for kind, files in (("good", good), ("broken", broken)):
        files = files.select(F.concat(F.lit(f"{kind}-"), F.col("page").cast("string")).alias("file"), "value")
        files.repartition(spark.sparkContext.defaultParallelism, "file").write.partitionBy("file").option("lineSep", "\n").text(f"{path}/kind={kind}")
    return path


@query
def stream_pages_mixed(spark, sf_dir):
    # Indented, one-line and broken page files in one stream: tags to the catalogue, broken files to the quarantine by path.
    path, root, broken = page_files(spark, sf_dir), scratch_path(spark, "catalog"), scratch_path(spark, "broken")
    files = store.stream_page_files(spark, f"{path}/*/*/*.txt", 7)
    jobs.start_page_refresh(files, root, broken, scratch_path(spark, "catalog-checkpoint"), must_exclude="-rc", once=True).awaitTermination()
    tags = store.read_catalog(spark, root).select("tag", "group", F.lit("catalogue").alias("went_to"))
    held = store.read_quarantine(spark, broken).select(F.regexp_extract("path", "file=([^/]*)", 1).alias("tag"), F.col("reason").alias("group"), F.lit("quarantine").alias("went_to"))
    return tags.unionByName(held)


@query
def catalog_snapshot(spark, sf_dir):
    # A version is held while later batches, two compactions and a vacuum come; then all versions that are kept are read.
    root = scratch_path(spark, "catalog")
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")
    store.append_batch(catalog.tag_documents(v.view(spark, sf_dir, v.OLD_TAGS)).withColumn("imported_at", at(1)), root, "load", 0)
    held = store.read_catalog(spark, root)
    tags = v.view(spark, sf_dir, v.TAGS)
    for batch in (1, 2):
        docs = catalog.tag_documents(tags.where(F.col("seq") % 2 == batch - 1)).withColumn("imported_at", at(batch + 1))
        store.append_batch(docs, root, "load", batch)
        store.compact(spark, root)
    store.vacuum(spark, root, keep_versions=2)
    versions = {"held": held, "first": store.read_catalog(spark, root, 1), "middle": store.read_catalog(spark, root, 3), "last": store.read_catalog(spark, root)}
    named = [df.select(F.lit(name).alias("read"), "tag", "seq") for name, df in versions.items()]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


@query
def landed_summary(spark, sf_dir):
    # All nodes are landed in buckets; the roll-up of the landing has no shuffle.
    made = landing.land_nodes(v.landed(spark, sf_dir), scratch_path(spark, "inventory"), buckets=8)
    return made.by_group(lambda rows, hot: summary(rows))


@query
def landed_hosts(spark, sf_dir):
    made = landing.land_nodes(v.landed(spark, sf_dir), scratch_path(spark, "inventory"), buckets=8)
    return made.by_group(deployments.host_rows)


@query
def landed_wide_order(spark, sf_dir):
    # Three groups hold all rows: they are found at landing and lie apart.
    made = landing.land_nodes(v.landed(spark, sf_dir, v.WIDE_INV), scratch_path(spark, "inventory"), buckets=8, hot_rows=1000)
    return made.by_group(lambda rows, hot: layout.member_order(rows.select("grp", "seq", "port"), hot))


@query
def content_differences(spark, sf_dir):
    # Orders against a copy in which rows were changed, swapped between customers with their number kept, and doubled.
    orders = v.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    shifted = (F.col("o_orderkey") % 1000 == 7) & (F.col("o_orderpriority") == "1-URGENT")
    copy = orders.withColumns({
        "o_totalprice": F.when(shifted, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
        "o_orderpriority": F.when(F.col("o_custkey") % 500 == 3, "5-LOW").otherwise(F.col("o_orderpriority")),
    })
    twice = copy.where((F.col("o_orderkey") % 2000 == 1) & (F.col("o_orderpriority") == "2-HIGH"))
    by_day = ["o_orderdate", "o_orderpriority"]
    return verify.differing(orders, copy.unionByName(twice), by_day).select(F.col("o_orderdate").cast("string").alias("day"), F.col("o_orderpriority").alias("priority"), "sent_rows", "landed_rows")


@query
def verified_load(spark, sf_dir):
    # All deployments are written, counted on the way and counted again when read back.
    summaries = rollup.summaries(nodes(spark, sf_dir))
    path = scratch_path(spark, "load")
    store.write_verified(summaries, path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("loaded"))
