"""Column functions: text, versions, labels. All are built from native Spark functions."""

from fleetframe.functions.labels import (
    LabelScheme,
    canonical_type,
    default_to,
    env_value,
    known_type,
    overlay,
    prefixed_only,
    short_id,
    to_int,
)
from fleetframe.functions.text import (
    drop_log_lines,
    endpoint_uri,
    is_log_line,
    manager_urls,
    mask_credentials,
    mask_list,
    mask_map,
    parse_pairs,
    safe_path,
    strip,
)
from fleetframe.functions.versions import parse_version, tag_group, tag_version

__all__ = [
    "LabelScheme", "canonical_type", "default_to", "env_value", "known_type", "overlay", "prefixed_only", "short_id",
    "to_int", "drop_log_lines", "endpoint_uri", "is_log_line", "manager_urls", "mask_credentials", "mask_list",
    "mask_map", "parse_pairs", "safe_path", "strip", "parse_version", "tag_group", "tag_version",
]
