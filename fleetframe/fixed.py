"""Names, roles, formats and patterns that must be exact for results to be right."""

# Deployment types, keyed by their normalised spelling.
TYPE_NAMES = {
    "standalone": "Standalone",
    "replica-set": "Replica Set",
    "sharded-cluster": "Sharded Cluster",
    "atlas-deployment": "Atlas Deployment",
    "ops-manager": "Ops Manager",
    "ops-manager-deployment-server": "Ops Manager Deployment Server",
}
STANDALONE = "Standalone"
REPLICA_SET = "Replica Set"
SHARDED = "Sharded Cluster"
ATLAS = "Atlas Deployment"
MANAGER = "Ops Manager"
SERVER_GROUP = "Ops Manager Deployment Server"

# Raw type labels that decide where a node's version is read.
RAW_ATLAS = "Atlas Deployment"
RAW_MANAGER = "ops-manager"
RAW_SERVER = "ops-manager-deployment-server"

# Node roles.
CONFIG = "cfg-svr"
ROUTER = "mongos"
MEMBER = "rs-member"
SINGLE = "standalone"
ATLAS_ROLE = "atlas"

# Environment variables, states and placeholders.
SERVER_VERSION_VAR = "MONGO_VERSION"
MANAGER_VERSION_VAR = "VERSION"
RUNNING = "running"
STOPPED = "stopped"
UNKNOWN = "unknown"
NO_ID = "N/A"
SERVER_GROUP_VERSION = "-- Check OM --"
APP_DB_SUFFIX = "-app-db"
OTHER_TAGS = "others"

# Report headings.
LIST_HEADINGS = ["Name", "Type", "Status", "Containers", "Version", "Port(s)"]
DETAIL_HEADINGS = ["Name", "Port", "Type", "Hostname", "Container ID"]
RULE_CELL = "------"

# Text patterns (Java syntax; (?d) makes "." stop at \n only).
URI_SECRET = r"(mongodb(?:\+srv)?://[^:]+:)([^@]+)(@)"
URI_SECRET_STRICT = r"(mongodb(?:\+srv)?://[^:/\s@]+:)([^\s/]+)(@)"
MASK = "************"
SERVER_LOG_LINE = (
    r"(?d)^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}\+[0-9]{4}"
    r"[\s\x1c-\x1f\x85\p{Z}]+[A-Z][\s\x1c-\x1f\x85\p{Z}]+.*$"
)
PATCH_PREFIX = r"(?d)^([0-9]+\.[0-9]+.[0-9]+)"
MINOR_PREFIX = r"^([0-9]+\.[0-9]+)"
MAJOR_PREFIX = r"^([0-9]+)"

# Every character that counts as white space when text is stripped.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Defaults of a deployment spec.
SPEC_DEFAULTS = {
    "standalone": False,
    "replica_set": False,
    "replicas": 3,
    "shards": 2,
    "arbiter": False,
    "priority": False,
    "atlas": False,
    "sharded": False,
    "port": 27017,
    "config_servers": 1,
    "mongos": 1,
    "auth": False,
    "username": None,
    "password": None,
    "auth_db": "admin",
    "image_repo": "mongo",
    "image_tag": "latest",
    "network_name": "mongo_network",
    "ephemeral": False,
}
DEFAULT_AUTH_ROLES = ["dbAdminAnyDatabase", "readWriteAnyDatabase", "userAdminAnyDatabase", "clusterAdmin"]
MAX_PORT = 65535
