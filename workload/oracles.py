"""Every query in DuckDB SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from workload import views as v

PATTERN = r"(mongodb(?:\+srv)?://[^:]+:)([^@]+)(@)"
STRICT = r"(mongodb(?:\+srv)?://[^:/\s@]+:)([^\s/]+)(@)"
MASK = r"\1************\3"
LOG_LINE = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}\+[0-9]{4}"
    r"[\s\x1c-\x1f\x{85}\p{Z}]+[A-Z][\s\x1c-\x1f\x{85}\p{Z}]+"
)

INV = f"inv AS ({v.sql(v.INV)})"
TYPED = f"""{INV},
typed AS (
 SELECT seq, grp, node, source,
  port AS raw_port,
  CASE lower(translate(coalesce(raw_type, 'Standalone'), ' _', '--'))
   WHEN 'standalone' THEN 'Standalone' WHEN 'replica-set' THEN 'Replica Set' WHEN 'sharded-cluster' THEN 'Sharded Cluster'
   WHEN 'atlas-deployment' THEN 'Atlas Deployment' WHEN 'ops-manager' THEN 'Ops Manager'
   WHEN 'ops-manager-deployment-server' THEN 'Ops Manager Deployment Server' END AS type,
  role, TRY_CAST(port AS INTEGER) AS port, CAST(shard_id AS INTEGER) AS shard_id, CAST(shard_count AS INTEGER) AS shard_count,
  arbiter = '1' AS arbiter, status,
  split_part(list_filter(string_split(env, ';'), lambda e: starts_with(e, 'MONGO_VERSION='))[1], '=', 2) AS env_version,
  CASE WHEN raw_type = 'Atlas Deployment' THEN version_label
   WHEN raw_type = 'ops-manager'
    THEN split_part(list_filter(string_split(env, ';'), lambda e: starts_with(e, 'VERSION='))[1], '=', 2)
   ELSE split_part(list_filter(string_split(env, ';'), lambda e: starts_with(e, 'MONGO_VERSION='))[1], '=', 2)
  END AS version,
  substr(id, 1, 12) AS id, data_dir, container_data_dir, parent, group_size, start_port, network
 FROM inv)"""


ODD_TYPED = TYPED.replace(INV, f"inv AS ({v.sql(v.ODD_INV)})")
FLEET = "(SELECT * FROM typed WHERE source = 'fleet')"


def rolled(source: str = "typed") -> str:
    return f"""
nodes AS (SELECT * FROM {source}),
firsts AS (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY grp ORDER BY seq) = 1),
heads AS (SELECT grp, shard_count FROM nodes WHERE role = 'rs-member'
 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY CAST(shard_id AS BIGINT) * port, seq) = 1),
counted AS (
 SELECT grp, count(*) AS n_rows, count(*) FILTER (status = 'running') AS running_rows,
  count(*) FILTER (status IS DISTINCT FROM 'running') AS stopped_rows, min(port) AS min_port, max(port) AS max_port,
  count(*) FILTER (role = 'cfg-svr') AS n_config, count(*) FILTER (role = 'mongos') AS n_router,
  count(*) FILTER (role = 'rs-member') AS n_member, min(port) FILTER (role = 'cfg-svr') AS config_start,
  count(*) FILTER (status = 'running' AND role IN ('cfg-svr', 'mongos')) AS running_fixed,
  count(*) FILTER (status = 'running' AND role = 'rs-member') AS running_member
 FROM nodes GROUP BY grp),
sliced AS (
 SELECT c.*, f.type AS deployment_type, f.node, f.port, f.raw_port, f.status, f.version, f.group_size, f.start_port AS first_start,
  CASE WHEN h.shard_count > 0 AND n_member > 0 THEN n_member // h.shard_count END AS chunk_size
 FROM counted c JOIN firsts f USING (grp) LEFT JOIN heads h USING (grp)),
chunked AS (
 SELECT *, CASE WHEN chunk_size IS NULL THEN 0 WHEN chunk_size > 0
   THEN CAST(ceil(n_member / chunk_size) AS BIGINT) END AS n_chunks FROM sliced),
sized AS (
 SELECT *, CASE WHEN deployment_type IS NULL THEN NULL WHEN deployment_type = 'Replica Set' THEN n_rows
   WHEN deployment_type = 'Sharded Cluster' THEN n_router + n_config + CASE WHEN chunk_size IS NULL THEN 0 ELSE n_chunks * chunk_size END
   WHEN deployment_type = 'Ops Manager Deployment Server' THEN CAST(group_size AS BIGINT) ELSE 1 END AS containers FROM chunked),
roll AS (
 SELECT *, CASE WHEN deployment_type IN ('Replica Set', 'Sharded Cluster') THEN grp ELSE node END AS name,
  CASE WHEN deployment_type IS NULL THEN NULL WHEN deployment_type = 'Replica Set' THEN CASE WHEN running_rows > 0 THEN 'running' ELSE 'stopped' END
   WHEN deployment_type = 'Sharded Cluster'
    THEN CASE WHEN running_fixed + CASE WHEN chunk_size IS NULL THEN 0 ELSE running_member END > 0
      THEN 'running' ELSE 'stopped' END
   WHEN deployment_type LIKE 'Ops Manager%' THEN status
   ELSE CASE WHEN status = 'running' THEN 'running' ELSE 'stopped' END END AS state,
  CASE WHEN deployment_type = 'Ops Manager Deployment Server' THEN '-- Check OM --' ELSE version END AS mongo_version,
  CASE WHEN deployment_type IS NULL THEN NULL WHEN deployment_type = 'Replica Set' THEN concat_ws('-', min_port, min_port + n_rows - 1)
   WHEN deployment_type = 'Sharded Cluster' THEN CASE WHEN config_start IS NULL THEN ''
     ELSE concat_ws('-', config_start, config_start + containers - 1) END
   WHEN deployment_type = 'Ops Manager Deployment Server'
    THEN concat(first_start, '-', CAST(first_start AS BIGINT) + CAST(group_size AS BIGINT) - 1)
   WHEN deployment_type = 'Ops Manager' THEN raw_port ELSE CAST(port AS VARCHAR) END AS port_range,
  CASE deployment_type WHEN 'Replica Set' THEN min_port WHEN 'Sharded Cluster' THEN config_start
   WHEN 'Ops Manager Deployment Server' THEN CAST(first_start AS INTEGER) ELSE port END AS start_port,
  CASE WHEN deployment_type = 'Sharded Cluster' AND n_config = 0 THEN 'no config servers'
   WHEN deployment_type = 'Sharded Cluster' AND chunk_size = 0 THEN 'fewer members than shards' END AS layout_error
 FROM sized)"""


LISTED = """
sections AS (
 SELECT t.*, r.deployment_type, r.state, r.mongo_version, r.n_config, r.n_router, r.n_member, r.n_chunks, r.chunk_size,
  CASE WHEN r.deployment_type IS DISTINCT FROM 'Sharded Cluster' THEN 2 WHEN role = 'cfg-svr' THEN 0 WHEN role = 'mongos' THEN 1
   WHEN role = 'rs-member' AND coalesce(r.n_chunks, 1) > 0 THEN 2 END AS section,
  CASE WHEN r.deployment_type = 'Sharded Cluster' AND role = 'rs-member' THEN CAST(shard_id AS BIGINT) * t.port
   WHEN r.deployment_type IS NULL OR r.deployment_type IN ('Sharded Cluster', 'Replica Set') THEN t.port ELSE 0 END AS sorter
 FROM nodes t JOIN roll r USING (grp)),
placed AS (
 SELECT *, row_number() OVER (PARTITION BY grp ORDER BY section, sorter NULLS FIRST, seq) AS place
 FROM sections WHERE section IS NOT NULL),
listed AS (
 SELECT *, CASE WHEN deployment_type = 'Sharded Cluster' AND section = 2 AND chunk_size > 0
   THEN (place - n_config - n_router - 1) // chunk_size END AS chunk
 FROM placed WHERE deployment_type IS NULL OR deployment_type IN ('Replica Set', 'Sharded Cluster') OR place = 1)"""

TAGS = f"tags AS ({v.sql(v.TAGS)})"
GROUP = """coalesce(nullif(regexp_extract(tag, '^([0-9]+\\.[0-9]+)', 1), ''),
 nullif(regexp_extract(tag, '^([0-9]+)', 1), ''), 'others')"""


def versions(source: str) -> str:
    """Version parts of ``tag`` in ``source``: the longest prefix, split at dots, all parts numbers."""
    return f"""
prefixed AS (
 SELECT *, {GROUP} AS "group",
  coalesce(nullif(regexp_extract(tag, '^([0-9]+\\.[0-9]+.[0-9]+)', 1), ''),
   nullif(regexp_extract(tag, '^([0-9]+\\.[0-9]+)', 1), '')) AS dotted,
  nullif(regexp_extract(tag, '^([0-9]+)', 1), '') AS lead
 FROM {source}),
cut AS (SELECT *, string_split(dotted, '.') AS p FROM prefixed),
docs AS (
 SELECT *, coalesce(NOT (len(p) IN (2, 3) AND len(list_filter(p, lambda x: try_cast(x AS INTEGER) IS NULL)) = 0), false)
   AS bad FROM cut),
parsed AS (
 SELECT seq, tag, "group",
  CASE WHEN dotted IS NULL THEN try_cast(lead AS INTEGER) WHEN NOT bad THEN try_cast(p[1] AS INTEGER) END AS major,
  CASE WHEN NOT bad THEN try_cast(p[2] AS INTEGER) END AS minor,
  CASE WHEN NOT bad THEN try_cast(p[3] AS INTEGER) END AS patch,
  CAST(bad OR (dotted IS NULL AND lead IS NOT NULL AND try_cast(lead AS INTEGER) IS NULL) AS INTEGER) AS parse_error
 FROM docs)"""


SPEC = f"""spec AS ({v.sql(v.SPEC)}),
ready AS (
 SELECT *, CASE kind WHEN 'sharded' THEN shards * replicas + config_servers + mongos WHEN 'replica_set' THEN replicas
   ELSE 1 END AS n
 FROM spec WHERE kind <> 'invalid' AND NOT (kind = 'standalone' AND arbiter))"""
PLANNED = f"""{SPEC},
planned AS (
 SELECT seq, name AS grp, name AS node, port, CASE kind WHEN 'atlas' THEN 'atlas' ELSE 'standalone' END AS role,
  0 AS shard_id, false AS arbiter, kind, shards, ephemeral FROM ready WHERE kind IN ('standalone', 'atlas')
 UNION ALL
 SELECT seq, name, concat(name, '-', i), port + i - 1, 'rs-member', 0, arbiter AND i = replicas, kind, shards, ephemeral
 FROM ready, generate_series(1, replicas) AS g(i) WHERE kind = 'replica_set'
 UNION ALL
 SELECT seq, name, concat(name, '-cfg-svr-', i), port + i - 1, 'cfg-svr', 0, false, kind, shards, ephemeral
 FROM ready, generate_series(1, config_servers) AS g(i) WHERE kind = 'sharded'
 UNION ALL
 SELECT seq, name, concat(name, '-mongos-', i), port + config_servers + i - 1, 'mongos', 0, false, kind, shards, ephemeral
 FROM ready, generate_series(1, mongos) AS g(i) WHERE kind = 'sharded'
 UNION ALL
 SELECT seq, name, concat(name, '-sh-', s, '-', i), port + config_servers + mongos + (s - 1) * replicas + i - 1,
  'rs-member', s, false, kind, shards, ephemeral
 FROM ready, generate_series(1, shards) AS h(s), generate_series(1, replicas) AS g(i) WHERE kind = 'sharded'),
kinds AS (
 SELECT *, CASE kind WHEN 'sharded' THEN 'Sharded Cluster' WHEN 'replica_set' THEN 'Replica Set'
   WHEN 'atlas' THEN 'Atlas Deployment' ELSE 'Standalone' END AS deployment_type FROM planned)"""

LOGS = f"logs AS ({v.sql(v.LOGS)})"
PAIRS = f"""texts AS ({v.sql(v.PAIR_TEXT)}),
pairs AS (SELECT page_id, unnest(string_split(text, '&')) AS kv FROM texts WHERE text <> '')"""


def masked(column: str, pattern: str = PATTERN) -> str:
    return f"regexp_replace({column}, '{pattern}', '{MASK}', 'g')"


def kept_lines(column: str) -> str:
    return (
        f"array_to_string(list_filter(string_split({column}, chr(10)),"
        f" lambda x: NOT regexp_matches(x, '{LOG_LINE}')), chr(10))"
    )


BOUND = "MAP {'27017/tcp': [{'HostIp': '0.0.0.0', 'HostPort': raw_port}]}"


def member(kind: str, version: str, host: str, container: str, arbiter: str, state: str = "status") -> str:
    return f"""{{'name': node, 'deployment_type': {kind}, 'state': {state}, 'containers': 1, 'mongo_version': {version},
   'port': port, 'host_data_dir': {host}, 'container_data_dir': {container}, 'is_arbiter': {arbiter},
   'container': {{'id': id, 'image': CAST([] AS VARCHAR[]), 'ports': {BOUND}}}}}"""


_PLAIN = member("'mongod'", "CAST(NULL AS VARCHAR)", "data_dir", "container_data_dir", "arbiter")
_OF_SET = member("'mongod'", "env_version", "data_dir", "container_data_dir", "arbiter")
_ROUTER = member("'mongos'", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "false")
_HEAD = """'name': r.name, 'deployment_type': r.deployment_type, 'state': r.state, 'containers': r.containers,
  'mongo_version': r.mongo_version"""

DOCUMENTS = f"""
WITH {TYPED}, {rolled(FLEET)}, {LISTED},
shard_docs AS (
 SELECT grp, chunk, {{'name': grp, 'deployment_type': 'shard', 'state': CAST(NULL AS VARCHAR), 'containers': count(*),
  'mongo_version': CAST(NULL AS VARCHAR),
  'port_range': concat(arg_min(port, place), '-', arg_min(port, place) + count(*) - 1), 'size': count(*),
  'members': list({_PLAIN} ORDER BY place)}} AS doc
 FROM listed WHERE chunk IS NOT NULL GROUP BY grp, chunk),
shards AS (SELECT grp, list(doc ORDER BY chunk) AS shards FROM shard_docs GROUP BY grp),
lists AS (
 SELECT grp, list({_PLAIN} ORDER BY place) FILTER (section = 0) AS config,
  list({_ROUTER} ORDER BY place) FILTER (section = 1) AS routers,
  list({_OF_SET} ORDER BY place) FILTER (section = 2) AS members,
  list({_PLAIN} ORDER BY place) FILTER (section = 2) AS loose,
  min(port) FILTER (place = 1) AS port, min(data_dir) FILTER (place = 1) AS data_dir,
  min(container_data_dir) FILTER (place = 1) AS container_data_dir, bool_or(arbiter AND place = 1) AS arbiter,
  min(id) FILTER (place = 1) AS id, min(raw_port) FILTER (place = 1) AS raw_port
 FROM listed GROUP BY grp),
clusters AS (
 SELECT r.grp, r.n_chunks, r.layout_error, l.loose,
  {{{_HEAD}, 'port_range': r.port_range, 'routers': coalesce(l.routers, []),
  'config_servers_replica_set': {{'name': r.grp, 'deployment_type': 'Replica Set', 'state': CAST(NULL AS VARCHAR),
   'containers': r.n_config, 'mongo_version': CAST(NULL AS VARCHAR),
   'port_range': concat_ws('-', r.config_start, r.config_start + r.n_config - 1), 'size': r.n_config,
   'members': coalesce(l.config, [])}},
  'shards': coalesce(s.shards, [])}} AS doc
 FROM roll r JOIN lists l USING (grp) LEFT JOIN shards s USING (grp) WHERE r.deployment_type = 'Sharded Cluster')
SELECT grp, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts, CAST(to_json({{{_HEAD}, 'port_range': r.port_range, 'size': r.n_rows,
  'members': l.members}}) AS VARCHAR) AS document
FROM roll r JOIN lists l USING (grp) WHERE r.deployment_type = 'Replica Set'
UNION ALL
SELECT grp, 0, 1, CAST(to_json({{{_HEAD}, 'port': l.port, 'host_data_dir': l.data_dir,
  'container_data_dir': l.container_data_dir, 'is_arbiter': l.arbiter AND r.deployment_type = 'Standalone',
  'container': {{'id': l.id, 'image': CAST([] AS VARCHAR[]), 'ports': {BOUND.replace("raw_port", "l.raw_port")}}}}}) AS VARCHAR)
FROM roll r JOIN lists l USING (grp) WHERE r.deployment_type IN ('Standalone', 'Atlas Deployment')
UNION ALL
SELECT grp, 0, 1, CAST(to_json({{{_HEAD}, 'port_range': r.port_range}}) AS VARCHAR)
FROM roll r WHERE r.deployment_type LIKE 'Ops Manager%'
UNION ALL
SELECT grp, 0, 1, CAST(to_json(doc) AS VARCHAR) FROM clusters WHERE n_chunks IS NOT NULL
UNION ALL
SELECT grp, 0, 1, CAST(to_json(struct_insert(doc, layout_error := layout_error, unassigned := coalesce(loose, []))) AS VARCHAR)
FROM clusters WHERE n_chunks IS NULL
"""

ORACLES = {
    "inventory_scan": f"""WITH {INV}
SELECT seq, grp, node, status, source FROM inv
WHERE source = 'fleet' AND status = 'running' AND node NOT LIKE '%-6'""",
    "version_source": f"""WITH {TYPED}
SELECT seq, type, version, port, shard_id, shard_count, CAST(arbiter AS INTEGER) AS arbiter, id FROM typed""",
    "label_overlay": f"""WITH {TYPED}
SELECT i.seq, u.key, u.value
FROM inv i JOIN typed t USING (seq), LATERAL (VALUES
 ('fleet-group', CASE WHEN i.node NOT LIKE '%-6' THEN i.grp END), ('fleet-name', i.node),
 ('fleet-type', coalesce(i.raw_type, 'Standalone')), ('fleet-role', i.role), ('fleet-port', i.port),
 ('fleet-shard-id', i.shard_id), ('fleet-shard-count', i.shard_count), ('fleet-arbiter', i.arbiter),
 ('fleet-data-dir', i.data_dir), ('fleet-container-data-dir', i.container_data_dir), ('fleet-parent', i.parent),
 ('fleet-group-size', i.group_size), ('fleet-start-port', i.start_port), ('fleet-network', i.network),
 ('fleet-container-id', t.id), ('fleet-container-status', i.status), ('fleet-mongo-version', t.version)) AS u(key, value)
WHERE u.value IS NOT NULL""",
    "lookup_found_missing": f"""WITH {INV},
names AS (SELECT DISTINCT concat('dep-', o_custkey) AS grp FROM orders),
alive AS (SELECT grp, node FROM inv WHERE status = 'running')
SELECT grp, node, 'found' AS outcome FROM alive WHERE grp IN (SELECT grp FROM names)
UNION ALL
SELECT grp, NULL, 'missing' FROM names WHERE grp NOT IN (SELECT grp FROM alive)""",
    "manager_children": f"""WITH {INV},
named AS (
 SELECT seq // 10 AS k, node, parent, CASE WHEN seq // 10 % 8 = 6 THEN concat('dep-', seq // 10 - 2, '-app-db')
   ELSE grp END AS grp FROM inv),
managers AS (SELECT DISTINCT grp AS manager FROM inv WHERE raw_type = 'ops-manager')
SELECT manager, 'child' AS relation, grp, node FROM named JOIN managers ON parent = manager
UNION ALL
SELECT manager, 'app-db', grp, node FROM named JOIN managers ON grp = concat(manager, '-app-db')""",
    "manager_removal": f"""WITH {TYPED},
named AS (
 SELECT seq, node, parent, port, data_dir, CASE WHEN seq // 10 % 8 = 6 THEN concat('dep-', seq // 10 - 2, '-app-db') ELSE grp END AS grp FROM typed),
managers AS (SELECT DISTINCT grp AS manager FROM inv WHERE raw_type = 'ops-manager'),
family AS (
 SELECT manager, 'child' AS relation, 0 AS turn, 0 AS sorter, seq, node, data_dir FROM named JOIN managers ON parent = manager
 UNION ALL SELECT manager, 'app-db', 1, port, seq, node, data_dir FROM named JOIN managers ON grp = concat(manager, '-app-db'))
SELECT manager, row_number() OVER (PARTITION BY manager ORDER BY turn, sorter, seq) AS step, relation, node,
 CASE WHEN turn = 1 AND trim(data_dir) NOT IN ('', '/') THEN data_dir END AS remove_dir FROM family""",
    "server_manager": f"""WITH {INV},
managers AS (SELECT grp, network, port FROM inv WHERE raw_type = 'ops-manager' AND status = 'running'
 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY seq) = 1)
SELECT s.seq, s.node, s.parent AS om_name, m.network AS om_network, concat('http://', m.grp, ':', m.port) AS om_url
FROM inv s JOIN managers m ON s.parent = m.grp WHERE s.raw_type = 'ops-manager-deployment-server'""",
    "server_without_manager": f"""WITH {INV}
SELECT seq, node, parent AS om_name FROM inv WHERE raw_type = 'ops-manager-deployment-server'
 AND parent NOT IN (SELECT grp FROM inv WHERE raw_type = 'ops-manager' AND status = 'running')""",
    "grouped_nodes": f"""WITH {INV}
SELECT grp, CAST(0 AS BIGINT) AS part, CAST(count(*) AS INTEGER) AS size,
 string_agg(concat(node, ':', status), ' ' ORDER BY seq) AS members FROM inv GROUP BY grp""",
    "bulk_targets": f"""WITH {INV}
SELECT grp FROM inv WHERE source = 'fleet' INTERSECT SELECT grp FROM inv WHERE status = 'running'""",
    "safe_paths": f"""WITH {INV}
SELECT seq, node, data_dir FROM inv WHERE data_dir IS NOT NULL AND trim(data_dir) NOT IN ('', '/')""",
    "deployment_summary": f"""WITH {TYPED}, {rolled()}
SELECT grp, name, deployment_type, state, containers, mongo_version, port_range, start_port, max_port, n_rows,
 running_rows, stopped_rows, layout_error FROM roll""",
    "running_deployments": f"""WITH {TYPED}, {rolled("(SELECT * FROM typed WHERE status = 'running' AND source = 'fleet')")}
SELECT grp, name, deployment_type, state, containers, mongo_version, port_range FROM roll""",
    "cluster_counts": f"""WITH {TYPED}, {rolled()}
SELECT grp, n_config, n_router, n_member, n_chunks, chunk_size, containers, port_range, layout_error
FROM roll WHERE deployment_type = 'Sharded Cluster'""",
    "member_order": f"""WITH {TYPED}
SELECT grp, seq, port, row_number() OVER (PARTITION BY grp ORDER BY port, seq) AS member_no FROM typed""",
    "shard_chunks": f"""WITH {TYPED},
m AS (
 SELECT *, row_number() OVER w AS member_no, count(*) OVER (PARTITION BY grp) AS n, first(shard_count) OVER w AS shards
 FROM typed WHERE type = 'Sharded Cluster' AND role = 'rs-member'
 WINDOW w AS (PARTITION BY grp ORDER BY CAST(shard_id AS BIGINT) * port, seq))
SELECT grp, node, shard_id, port, member_no,
 CASE WHEN n // shards > 0 THEN (member_no - 1) // (n // shards) END AS chunk, CAST(n // shards = 0 AS INTEGER) AS layout_error
FROM m""",
    "shard_headers": f"""WITH {TYPED},
m AS (
 SELECT *, row_number() OVER w AS member_no, count(*) OVER (PARTITION BY grp) AS n, first(shard_count) OVER w AS shards
 FROM typed WHERE type = 'Sharded Cluster' AND role = 'rs-member'
 WINDOW w AS (PARTITION BY grp ORDER BY CAST(shard_id AS BIGINT) * port, seq)),
c AS (SELECT *, (member_no - 1) // (n // shards) AS chunk FROM m WHERE n // shards > 0)
SELECT grp, chunk, arg_min(shard_id, member_no) AS shard_id, arg_min(port, member_no) AS start_port, count(*) AS size
FROM c GROUP BY grp, chunk""",
    "host_strings": f"""WITH {TYPED},
h AS (SELECT grp, string_agg(concat(node, ':', port), ',' ORDER BY port, seq) AS hosts FROM typed
 WHERE type = 'Replica Set' GROUP BY grp)
SELECT grp, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts, hosts, concat('mongodb://', hosts, '/?replicaSet=', grp) AS uri,
 concat(grp, '/', hosts) AS set_address FROM h""",
    "host_rows": f"""WITH {TYPED}, {rolled()}, {LISTED}
SELECT grp, CAST(section AS INTEGER) AS section, chunk, place, concat(node, ':', port) AS host FROM listed
WHERE deployment_type = 'Replica Set' OR (deployment_type = 'Sharded Cluster' AND section IN (0, 2))""",
    "cluster_addresses": f"""WITH {TYPED}, {rolled()}, {LISTED},
sets AS (SELECT *, CASE WHEN section = 0 THEN concat(grp, '-cfg-svr') ELSE concat(grp, '-sh-', chunk + 1) END AS set_name
 FROM listed WHERE deployment_type = 'Sharded Cluster' AND (section = 0 OR chunk IS NOT NULL))
SELECT grp, set_name, concat(set_name, '/', string_agg(concat(node, ':', port), ',' ORDER BY place)) AS address
FROM sets GROUP BY grp, set_name""",
    "wide_host_strings": f"""WITH wide AS ({v.sql(v.WIDE_INV)}),
placed AS (SELECT grp, concat(node, ':', CAST(port AS INTEGER)) AS host,
 row_number() OVER (PARTITION BY grp ORDER BY CAST(port AS INTEGER), seq) AS place, count(*) OVER (PARTITION BY grp) AS n FROM wide)
SELECT grp, (place - 1) // 1000 AS part, (max(n) + 999) // 1000 AS parts, string_agg(host, ',' ORDER BY place) AS hosts,
 CASE WHEN max(n) <= 1000 THEN concat('mongodb://', string_agg(host, ',' ORDER BY place), '/?replicaSet=', grp) END AS uri,
 CASE WHEN max(n) <= 1000 THEN concat(grp, '/', string_agg(host, ',' ORDER BY place)) END AS set_address
FROM placed GROUP BY grp, part""",
    "wide_member_order": f"""WITH wide AS ({v.sql(v.WIDE_INV)})
SELECT grp, seq, CAST(port AS INTEGER) AS port, row_number() OVER (PARTITION BY grp ORDER BY CAST(port AS INTEGER), seq) AS member_no
FROM wide""",
    "odd_report_rows": f"""WITH {ODD_TYPED}, {rolled()}
SELECT 0 AS rank, CAST(NULL AS VARCHAR) AS grp, '| Name|Type|Status|Containers|Version|Port(s) |' AS line
UNION ALL SELECT 1, NULL, '| ------|------|------|------|------|------ |'
UNION ALL SELECT 2, grp, concat('| ', grp, '|', coalesce(deployment_type, 'unknown'), '|', coalesce(nullif(state, ''), 'unknown'), '|',
 coalesce(CAST(containers AS VARCHAR), 'None'), '|', coalesce(nullif(mongo_version, ''), 'unknown'), '|', coalesce(port_range, ''), ' |')
FROM roll""",
    "odd_detail_rows": f"""WITH {ODD_TYPED}, {rolled()}, {LISTED}
SELECT grp, CAST(0 AS BIGINT) AS line_no, concat('**', coalesce(name, 'unknown'), ' (', CASE deployment_type WHEN 'Replica Set'
 THEN 'replica set' WHEN 'Sharded Cluster' THEN 'sharded cluster' ELSE CASE WHEN deployment_type IS NULL THEN 'unknown'
 ELSE 'standalone' END END, '):**') AS line FROM roll
UNION ALL SELECT grp, 1, '| Name | Port | Type | Hostname | Container ID |' FROM roll
UNION ALL SELECT grp, 2, '| ------|------|------|------|------ |' FROM roll
UNION ALL SELECT grp, place + 2, concat('| ', coalesce(node, 'unknown'), '|', coalesce(CAST(port AS VARCHAR), 'unknown'), '|',
 CASE WHEN deployment_type = 'Sharded Cluster' AND section = 0 THEN 'mongod (config)'
 WHEN deployment_type = 'Sharded Cluster' AND section = 1 THEN 'mongos' ELSE 'mongod' END, '|',
 CASE WHEN node IS NULL OR port IS NULL THEN 'unknown' ELSE concat(node, ':', port) END, '|', id, ' |') FROM listed""",
    "odd_host_strings": f"""WITH {ODD_TYPED},
h AS (SELECT grp, CASE WHEN node IS NOT NULL AND port IS NOT NULL THEN concat(node, ':', port) END AS host, port, seq
 FROM typed QUALIFY first(type) OVER (PARTITION BY grp ORDER BY seq) = 'Replica Set')
SELECT grp, coalesce(string_agg(host, ',' ORDER BY port NULLS FIRST, seq), '') AS hosts,
 CASE WHEN count(host) = count(*) THEN concat('mongodb://', string_agg(host, ',' ORDER BY port NULLS FIRST, seq), '/?replicaSet=', grp) END AS uri,
 CAST(count(host) < count(*) AS INTEGER) AS name_error FROM h GROUP BY grp""",
    "report_lines": f"""WITH {TYPED}, {rolled(FLEET)}
SELECT grp, concat('{{"name":', to_json(grp), ',"document":', CAST(to_json({{'name': name, 'deployment_type': deployment_type,
 'state': state, 'containers': containers, 'mongo_version': mongo_version, 'port_range': port_range}}) AS VARCHAR), '}}') AS line FROM roll""",
    "named_scan": f"""WITH {INV} SELECT seq, grp, node, status, source FROM inv WHERE grp = 'dep-1'""",
    "repeated_names": f"""WITH {SPEC}
SELECT seq, concat('dep-', seq // 2) AS name FROM spec QUALIFY row_number() OVER (PARTITION BY seq // 2 ORDER BY seq) > 1""",
    "property_files": f"""WITH texts AS ({v.sql(v.PAIR_TEXT)}),
files AS (SELECT page_id, string_split(concat('# page=old', chr(10), chr(10), replace(text, '&', chr(10))), chr(10)) AS ls FROM texts),
lines AS (SELECT page_id, unnest(range(len(ls))) AS n, unnest(ls) AS line FROM files)
SELECT page_id, CAST(n AS INTEGER) AS line_no, line FROM lines
WHERE NOT (contains(line, '=') AND NOT starts_with(line, '#') AND trim(split_part(line, '=', 1)) IN ('page', 'host'))
UNION ALL SELECT page_id, CAST(len(ls) AS INTEGER), 'host=new' FROM files
UNION ALL SELECT page_id, CAST(len(ls) + 1 AS INTEGER), 'page=new' FROM files""",
    "catalog_writers": f"""WITH {TAGS}, old AS ({v.sql(v.OLD_TAGS)}),
every AS (SELECT seq, tag, 1 AS day FROM old UNION ALL SELECT seq, tag, CASE WHEN seq % 2 = 0 THEN 2 WHEN seq % 4 = 1 THEN 3 ELSE 4 END FROM tags),
best AS (SELECT seq, tag FROM every QUALIFY row_number() OVER (PARTITION BY tag ORDER BY day DESC, seq DESC) = 1),
{versions('best')}
SELECT tag, seq, "group", major FROM parsed""",
    "endpoint_strings": f"""WITH {TYPED},
f AS (SELECT * FROM typed QUALIFY row_number() OVER (PARTITION BY grp ORDER BY seq) = 1)
SELECT grp, type AS deployment_type,
 CASE WHEN type <> 'Ops Manager' THEN concat('mongodb://', node, ':', port, '/') END AS uri,
 CASE WHEN type = 'Ops Manager' THEN concat('http://', node, ':', port) END AS network_url,
 CASE WHEN type = 'Ops Manager' THEN concat('http://localhost:', port) END AS external_url
FROM f WHERE type IN ('Standalone', 'Atlas Deployment', 'Ops Manager')""",
    "nested_documents": DOCUMENTS,
    "summary_json": f"""WITH {TYPED}, {rolled(FLEET)}
SELECT grp, CAST(to_json({{'name': name, 'deployment_type': deployment_type, 'state': state, 'containers': containers,
 'mongo_version': mongo_version, 'port_range': port_range}}) AS VARCHAR) AS document FROM roll""",
    "report_rows": f"""WITH {TYPED}, {rolled(FLEET)}
SELECT 0 AS rank, CAST(NULL AS VARCHAR) AS grp, '| Name|Type|Status|Containers|Version|Port(s) |' AS line
UNION ALL SELECT 1, NULL, '| ------|------|------|------|------|------ |'
UNION ALL SELECT 2, grp, concat('| ', grp, '|', deployment_type, '|', coalesce(nullif(state, ''), 'unknown'), '|',
 coalesce(CAST(containers AS VARCHAR), 'None'), '|', coalesce(nullif(mongo_version, ''), 'unknown'), '|', port_range, ' |')
FROM roll""",
    "detail_rows": f"""WITH {TYPED}, {rolled(FLEET)}, {LISTED}
SELECT grp, CAST(0 AS BIGINT) AS line_no, concat('**', name, ' (', CASE deployment_type WHEN 'Replica Set' THEN 'replica set'
 WHEN 'Sharded Cluster' THEN 'sharded cluster' ELSE 'standalone' END, '):**') AS line FROM roll
UNION ALL SELECT grp, 1, '| Name | Port | Type | Hostname | Container ID |' FROM roll
UNION ALL SELECT grp, 2, '| ------|------|------|------|------ |' FROM roll
UNION ALL SELECT grp, place + 2, concat('| ', node, '|', port, '|', CASE WHEN deployment_type = 'Sharded Cluster' AND section = 0
 THEN 'mongod (config)' WHEN deployment_type = 'Sharded Cluster' AND section = 1 THEN 'mongos' ELSE 'mongod' END, '|',
 node, ':', port, '|', id, ' |') FROM listed""",
    "action_order": f"""WITH {TYPED}, {rolled()}, {LISTED},
acts AS (
 SELECT *, CASE WHEN action = 'start' THEN section WHEN deployment_type <> 'Sharded Cluster' THEN 0
   WHEN section = 1 THEN 0 WHEN section = 2 THEN 1 ELSE 2 END AS turn
 FROM listed, (VALUES ('stop'), ('remove'), ('start')) AS a(action)
 WHERE deployment_type NOT LIKE 'Ops Manager%' AND NOT (deployment_type = 'Atlas Deployment' AND action = 'stop'))
SELECT grp, action, row_number() OVER (PARTITION BY grp, action ORDER BY turn, sorter, seq) AS step, node,
 CAST(action = 'stop' AND status IS DISTINCT FROM 'running' AS INTEGER) AS idle,
 CASE WHEN action = 'remove' AND deployment_type <> 'Atlas Deployment'
  AND NOT (deployment_type = 'Sharded Cluster' AND section = 1)
  AND trim(data_dir) NOT IN ('', '/') THEN data_dir END AS remove_dir
FROM acts""",
    "pages_scan": f"""WITH {TAGS} SELECT tag FROM tags WHERE contains(tag, '.') AND NOT contains(tag, '-rc')""",
    "tag_filter": f"""WITH {TAGS}, {versions('tags')}
SELECT seq, tag, major, minor, patch FROM parsed WHERE major = 7 AND minor = 1""",
    "tag_name_filter": f"""WITH {TAGS} SELECT seq, tag FROM tags WHERE contains(tag, '7.') AND NOT contains(tag, '-rc')""",
    "tag_enrich": f"""WITH odd AS ({v.sql(v.ODD_TAGS)}), {versions('odd')}
SELECT seq, tag, "group", array_to_string(string_split(tag, '-'), '|') AS fragments,
 CAST(contains(tag, '-rc') AS INTEGER) AS release_candidate, major, minor, patch, parse_error FROM parsed""",
    "semver_parse": f"""WITH odd AS ({v.sql(v.ODD_TAGS)}),
cut AS (SELECT seq, tag, string_split(tag, '.') AS p FROM odd),
ok AS (SELECT *, len(p) IN (2, 3) AND len(list_filter(p, lambda x: try_cast(x AS INTEGER) IS NULL
  OR NOT regexp_full_match(x, '[+-]?[0-9]+'))) = 0 AS good FROM cut)
SELECT seq, tag, CASE WHEN good THEN try_cast(p[1] AS INTEGER) END AS major,
 CASE WHEN good THEN try_cast(p[2] AS INTEGER) END AS minor, CASE WHEN good THEN try_cast(p[3] AS INTEGER) END AS patch,
 CAST(NOT good AS INTEGER) AS parse_error FROM ok""",
    "tag_groups": f"""WITH {TAGS}, k AS (SELECT {GROUP} AS "group", tag, seq FROM tags)
SELECT "group", row_number() OVER (PARTITION BY "group" ORDER BY tag DESC, seq) AS place, tag, seq FROM k""",
    "tag_group_sizes": f"""WITH {TAGS}
SELECT {GROUP} AS "group", CAST(count(*) AS BIGINT) AS tags, count(DISTINCT tag) AS distinct_tags, max(tag) AS first_tag,
 min(tag) AS last_tag FROM tags GROUP BY 1""",
    "tag_page": f"""WITH {TAGS},
d AS (SELECT tag, row_number() OVER (ORDER BY tag DESC) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT tag FROM tags) t)
SELECT CAST(r - 40 AS INTEGER) AS place, tag, CAST(n > 80 AS INTEGER) AS has_more FROM d WHERE r BETWEEN 41 AND 80""",
    "tag_batches": f"""WITH {TAGS}, p AS (SELECT seq, tag, row_number() OVER (ORDER BY tag, seq) AS position FROM tags)
SELECT seq, tag, position, (position - 1) // 20 AS chunk FROM p""",
    "tag_upsert": f"""WITH {TAGS}, old AS ({v.sql(v.OLD_TAGS)}), {versions('tags')},
fresh AS (SELECT tag, seq, "group", major FROM parsed QUALIFY row_number() OVER (PARTITION BY tag ORDER BY seq DESC) = 1)
SELECT tag, seq, "group", major FROM fresh
UNION ALL
SELECT tag, min(seq), 'stale', NULL FROM old WHERE tag NOT IN (SELECT tag FROM fresh) GROUP BY tag""",
    "archive_links": f"""WITH archive AS ({v.sql(v.ARCHIVE)}),
platforms AS (
 SELECT version, arch, package_format, link_name, download_link FROM archive
 UNION ALL SELECT version, CASE arch WHEN 'arm64' THEN 'x86_64' ELSE 'arm64' END, package_format, link_name,
  concat(download_link, '/a') FROM archive),
links AS (
 SELECT version, arch, package_format, link_name, download_link FROM platforms
 UNION ALL SELECT version, arch, package_format, CASE link_name WHEN 'deb' THEN 'tar.gz' ELSE 'deb' END,
  concat(download_link, '/b') FROM platforms)
SELECT version, arch, package_format, download_link FROM links
WHERE contains(version, '6.0.1') AND arch = 'x86_64' AND contains(package_format, 'rpm') AND link_name = 'tar.gz'""",
    "spec_violations": f"""WITH {SPEC}
SELECT seq, name, 'exactly one type has to be set' AS violation FROM spec WHERE kind = 'invalid'
UNION ALL
SELECT seq, name, 'a standalone deployment has no arbiter' FROM spec WHERE kind = 'standalone' AND arbiter""",
    "spec_capacity": f"""WITH {SPEC}
SELECT seq, name, n AS ports, CASE WHEN arbiter AND kind IN ('replica_set', 'sharded')
 THEN CAST(replicas // 2 AS INTEGER) END AS write_concern FROM ready""",
    "topology_nodes": f"""WITH {PLANNED}
SELECT seq, grp, node, CAST(port AS INTEGER) AS port, role, deployment_type, CAST(shard_id AS INTEGER) AS shard_id,
 CAST(arbiter AS INTEGER) AS arbiter FROM kinds""",
    "topology_labels": f"""WITH {PLANNED}
SELECT seq, node, u.key, u.value FROM kinds, LATERAL (VALUES ('source', 'fleet', true),
 ('fleet-name', node, true), ('fleet-group', grp, true), ('fleet-port', CAST(port AS VARCHAR), true),
 ('fleet-role', role, true), ('fleet-type', deployment_type, true), ('fleet-shard-count', CAST(shards AS VARCHAR), true),
 ('fleet-data-dir', CASE WHEN ephemeral OR role = 'atlas' THEN '' ELSE concat('/data/', node, '-db') END, role <> 'mongos'),
 ('fleet-container-data-dir', CASE WHEN ephemeral OR role = 'atlas' THEN '' ELSE '/data/db' END, role <> 'mongos'),
 ('fleet-ephemeral', CAST(CAST(ephemeral AS INTEGER) AS VARCHAR), role <> 'mongos'),
 ('fleet-shard-id', CAST(shard_id AS VARCHAR), role NOT IN ('mongos', 'atlas')),
 ('fleet-arbiter', CAST(CAST(arbiter AS INTEGER) AS VARCHAR), role NOT IN ('mongos', 'atlas'))) AS u(key, value, given)
WHERE given""",
    "server_group_labels": f"""WITH g AS ({v.sql(v.SERVER_SPEC)}),
s AS (SELECT *, concat(name, '-', i) AS node, port + i AS node_port FROM g, generate_series(0, count - 1) AS x(i))
SELECT seq, node, u.key, u.value FROM s, LATERAL (VALUES ('source', 'fleet'), ('fleet-name', node), ('fleet-group', name),
 ('fleet-group-size', CAST(count AS VARCHAR)), ('fleet-parent', om_name), ('fleet-port', CAST(node_port AS VARCHAR)),
 ('fleet-start-port', CAST(port AS VARCHAR)), ('fleet-role', 'ops-manager-deployment-server'),
 ('fleet-type', 'ops-manager-deployment-server')) AS u(key, value)""",
    "manager_labels": f"""WITH g AS ({v.sql(v.SERVER_SPEC)})
SELECT seq, concat(name, '-app-db') AS app_db, u.key, u.value FROM g, LATERAL (VALUES ('source', 'fleet'),
 ('fleet-name', name), ('fleet-group', name), ('fleet-parent', name), ('fleet-port', CAST(port AS VARCHAR)),
 ('fleet-network', 'net'), ('fleet-role', 'ops-manager'), ('fleet-type', 'ops-manager')) AS u(key, value)""",
    "planned_summary": f"""WITH {SPEC}
SELECT name AS grp, name, CASE kind WHEN 'sharded' THEN 'Sharded Cluster' WHEN 'replica_set' THEN 'Replica Set'
 WHEN 'atlas' THEN 'Atlas Deployment' ELSE 'Standalone' END AS deployment_type, 'running' AS state, n AS containers,
 CASE WHEN kind <> 'atlas' THEN '7.0.1' END AS mongo_version,
 CASE WHEN kind IN ('sharded', 'replica_set') THEN concat(port, '-', port + n - 1) ELSE CAST(port AS VARCHAR) END AS port_range
FROM ready""",
    "connection_strings": f"""WITH {SPEC},
a AS (SELECT *, CASE WHEN username IS NOT NULL AND password IS NOT NULL THEN concat(username, ':', password, '@')
  ELSE '' END AS auth FROM ready),
c AS (
 SELECT seq, name, concat('mongodb://', auth, 'localhost:', port) AS localhost, CASE kind
  WHEN 'replica_set' THEN concat('mongodb://', auth, array_to_string(list_transform(range(1, replicas + 1),
    lambda i: concat(name, '-', i, ':', port + i - 1)), ','), '/?replicaSet=', name)
  WHEN 'atlas' THEN concat('mongodb://', auth, name, ':', port)
  ELSE concat('mongodb://', auth, name, '-1:', port, '/?directConnection=True') END AS mapped
 FROM a WHERE kind <> 'sharded'
 UNION ALL
 SELECT seq, any_value(name), string_agg(concat('mongodb://', auth, 'localhost:', port + config_servers + i - 1), ' ' ORDER BY i),
  string_agg(concat('mongodb://', auth, name, '-mongos-', i, ':', port + config_servers + i - 1), ' ' ORDER BY i)
 FROM a, generate_series(1, mongos) AS g(i) WHERE kind = 'sharded' GROUP BY seq),
w AS (SELECT seq, name, unnest(string_split(localhost, ' ')) AS l, unnest(string_split(mapped, ' ')) AS m,
  generate_subscripts(string_split(mapped, ' '), 1) AS i FROM c)
SELECT seq, name, string_agg({masked('l')}, ' ' ORDER BY i) AS localhost, string_agg({masked('m')}, ' ' ORDER BY i) AS mapped
FROM w GROUP BY seq, name""",
    "name_collisions": f"""WITH {SPEC}, {INV}
SELECT seq, name, kind FROM spec WHERE name IN (SELECT grp FROM inv WHERE status = 'running')""",
    "free_names": f"""WITH {SPEC}, {INV}
SELECT seq, name, kind FROM spec WHERE name NOT IN (SELECT grp FROM inv WHERE status = 'running')""",
    "port_conflicts": f"""WITH {PLANNED}, {INV},
taken AS (SELECT DISTINCT CAST(port AS BIGINT) AS port FROM inv WHERE status = 'running'),
claims AS (SELECT port FROM kinds GROUP BY port HAVING count(DISTINCT seq) > 1),
counted AS (
 SELECT k.seq, any_value(k.grp) AS name, count(t.port) AS taken_ports, count(c.port) AS shared_ports,
  count(*) FILTER (k.port NOT BETWEEN 0 AND 65535) AS invalid_ports
 FROM kinds k LEFT JOIN taken t ON k.port = t.port LEFT JOIN claims c ON k.port = c.port GROUP BY k.seq)
SELECT * FROM counted WHERE taken_ports > 0 OR shared_ports > 0 OR invalid_ports > 0""",
    "host_port_conflicts": f"""WITH {PLANNED}, {INV},
used AS (
 SELECT DISTINCT CASE WHEN seq % 13 <> 0 THEN concat('host-', seq % 11) ELSE 'localhost' END AS host, CAST(port AS BIGINT) AS port FROM inv
 WHERE status = 'running'),
wanted AS (SELECT *, CASE WHEN seq % 11 <> 4 THEN concat('host-', seq % 11) ELSE 'localhost' END AS host FROM kinds),
claims AS (SELECT host, port FROM wanted GROUP BY host, port HAVING count(DISTINCT seq) > 1),
counted AS (
 SELECT w.seq, w.grp AS name, w.host, count(u.port) AS taken_ports, count(c.port) AS shared_ports,
  count(*) FILTER (w.port NOT BETWEEN 0 AND 65535) AS invalid_ports
 FROM wanted w LEFT JOIN used u ON w.host = u.host AND w.port = u.port LEFT JOIN claims c ON w.host = c.host AND w.port = c.port
 GROUP BY w.seq, w.grp, w.host)
SELECT * FROM counted WHERE taken_ports > 0 OR shared_ports > 0 OR invalid_ports > 0""",
    "mask_credentials": f"""WITH {LOGS}
SELECT seq, {masked('line')} AS msg, {masked('line')} AS arg, {masked('line')} AS uri FROM logs""",
    "mask_credentials_strict": f"""WITH {LOGS} SELECT seq, {masked('line', STRICT)} AS msg FROM logs""",
    "mask_documents": f"""SELECT doc_id, {kept_lines(masked('text'))} AS text FROM documents""",
    "drop_server_log": f"""WITH {LOGS} SELECT seq, {kept_lines('line')} AS line FROM logs""",
    "kv_parse": f"""WITH {PAIRS},
bad AS (SELECT DISTINCT page_id FROM pairs WHERE len(string_split(kv, '=')) <> 2),
cut AS (SELECT page_id, trim(split_part(kv, '=', 1)) AS key, trim(split_part(kv, '=', 2)) AS value FROM pairs)
SELECT page_id, key, any_value(value) AS value FROM cut WHERE page_id NOT IN (SELECT page_id FROM bad) GROUP BY page_id, key""",
    "property_overlay": f"""WITH {PAIRS},
base AS (SELECT page_id, trim(split_part(kv, '=', 1)) AS key, substr(kv, strpos(kv, '=') + 1) AS value FROM pairs
 WHERE contains(kv, '=')),
updates AS (
 SELECT page_id, unnest(['ref', 'host']) AS key, split_part(split_part(url, '/', 3), ':', 1) AS value, page_id AS seq
 FROM pages),
last AS (SELECT page_id, key, value FROM updates QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY seq DESC) = 1)
SELECT b.page_id, b.key, b.value FROM base b ANTI JOIN last l USING (page_id, key)
UNION ALL SELECT page_id, key, value FROM last""",
    "stream_mask": f"""WITH {LOGS}
SELECT seq, {masked('line')} AS msg, {masked('line')} AS arg, {masked('line')} AS uri FROM logs""",
    "stream_catalog": f"""WITH {TAGS}, {versions('tags')}
SELECT tag, seq, "group", major, minor, patch FROM parsed QUALIFY row_number() OVER (PARTITION BY tag ORDER BY seq DESC) = 1""",
    "stream_pages_mixed": f"""WITH {TAGS}
SELECT DISTINCT tag, {GROUP} AS "group", 'catalogue' AS went_to FROM tags WHERE NOT contains(tag, '-rc')
UNION ALL SELECT DISTINCT concat('broken-', seq // 100), 'not JSON', 'quarantine' FROM tags WHERE seq // 100 % 10 = 3""",
    "catalog_snapshot": f"""WITH {TAGS}, old AS ({v.sql(v.OLD_TAGS)}),
every AS (SELECT seq, tag, 1 AS day FROM old UNION ALL SELECT seq, tag, 2 + seq % 2 FROM tags),
reads AS (SELECT unnest([1, 1, 2, 3]) AS days, unnest(['held', 'first', 'middle', 'last']) AS read)
SELECT read, tag, seq FROM every JOIN reads ON day <= days
QUALIFY row_number() OVER (PARTITION BY read, tag ORDER BY day DESC, seq DESC) = 1""",
    "tag_page_deep": f"""WITH {TAGS}, {versions('tags')},
d AS (SELECT DISTINCT tag, major, minor FROM parsed),
s AS (SELECT '' AS version, 4 AS page, tag FROM d UNION ALL SELECT '5', 5, tag FROM d WHERE major = 5 UNION ALL SELECT '7.1', 2, tag FROM d WHERE major = 7 AND minor = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY tag DESC) AS r, count(*) OVER (PARTITION BY version) AS n FROM s)
SELECT version, CAST(r - 20 * (page - 1) AS INTEGER) AS place, tag, CAST(n > 20 * page AS INTEGER) AS has_more FROM n
WHERE r > 20 * (page - 1) AND r <= 20 * page""",
    "tag_page_after": f"""WITH {TAGS}, d AS (SELECT DISTINCT tag FROM tags), a AS (SELECT unnest(['latest', '6.0.2', '4', '0']) AS "after"),
n AS (SELECT "after", tag, row_number() OVER (PARTITION BY "after" ORDER BY tag DESC) AS r, count(*) OVER (PARTITION BY "after") AS n FROM d JOIN a ON tag < "after")
SELECT "after", CAST(r AS INTEGER) AS place, tag, CAST(n > 30 AS INTEGER) AS has_more FROM n WHERE r <= 30""",
    "content_differences": """WITH sent AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderdate FROM orders),
changed AS (
 SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 1000 = 7 AND o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_custkey % 500 = 3 THEN '5-LOW' ELSE o_orderpriority END AS o_orderpriority, o_orderdate FROM sent),
landed AS (SELECT * FROM changed UNION ALL SELECT * FROM changed WHERE o_orderkey % 2000 = 1 AND o_orderpriority = '2-HIGH'),
odd AS (
 SELECT o_orderdate, o_orderpriority FROM (SELECT * FROM sent EXCEPT ALL SELECT * FROM landed)
 UNION SELECT o_orderdate, o_orderpriority FROM (SELECT * FROM landed EXCEPT ALL SELECT * FROM sent)),
n AS (
 SELECT o_orderdate, o_orderpriority, sum(s) AS sent_rows, sum(l) AS landed_rows
 FROM (SELECT *, 1 AS s, 0 AS l FROM sent UNION ALL SELECT *, 0, 1 FROM landed) GROUP BY ALL)
SELECT CAST(o_orderdate AS VARCHAR) AS day, o_orderpriority AS priority, CAST(sent_rows AS BIGINT) AS sent_rows, CAST(landed_rows AS BIGINT) AS landed_rows
FROM n SEMI JOIN odd USING (o_orderdate, o_orderpriority)""",
    "verified_load": "SELECT count(DISTINCT l_orderkey) AS loaded FROM lineitem",
}

# A landing changes how nodes lie, not what is computed from them.
ORACLES |= {"archive_links_landed": ORACLES["archive_links"]}
ORACLES |= {"landed_summary": ORACLES["deployment_summary"], "landed_hosts": ORACLES["host_rows"], "landed_wide_order": ORACLES["wide_member_order"]}
