"""Fleet inventory and release-catalogue analytics on Spark."""

from fleetframe.functions import LabelScheme
from fleetframe.operators.inventory import scan_landed
from fleetframe.plans.catalog import list_tags, load_tags
from fleetframe.plans.deployments import (
    cluster_addresses,
    detailed_documents,
    endpoints,
    get_deployment,
    host_rows,
    host_strings,
    list_deployments,
)
from fleetframe.plans.provisioning import Plan, plan_deployments
from fleetframe.plans.reports import detail_rows, in_order, list_rows, report_lines, summary_json, write_report
from fleetframe.session import build
from fleetframe.sources.archive import land_archives, landed_links, read_landed_archives
from fleetframe.sources.catalog import compact, read_catalog, stream_page_files, vacuum
from fleetframe.sources.nodes import land, read_landed, read_records, typed_nodes, write_landed
from fleetframe.sources.page_index import index_catalog, list_indexed_tags
from fleetframe.sources.verify import content_digest, differing
from fleetframe.streaming.jobs import start_catalog_refresh, start_masking, start_page_refresh

__all__ = [
    "LabelScheme", "Plan", "build", "cluster_addresses", "compact", "content_digest", "detail_rows", "detailed_documents", "differing", "endpoints",
    "get_deployment", "host_rows", "host_strings", "in_order", "index_catalog", "land", "land_archives", "landed_links", "list_deployments",
    "list_indexed_tags", "list_rows", "list_tags", "load_tags", "plan_deployments", "read_catalog", "read_landed", "read_landed_archives",
    "read_records", "report_lines", "scan_landed", "start_catalog_refresh", "start_masking", "start_page_refresh", "stream_page_files",
    "summary_json", "typed_nodes", "vacuum", "write_landed", "write_report",
]
