"""The message kinds: which fields each has and how each field is written in JSON.

Everything the decoder, the encoder and the conformance check do is derived from the two
texts below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fields per message kind; a trailing "?" marks an optional field.
# Server kinds also have serverId and messageNo.
CLIENT_KINDS = """
AddWorkers                 clusterId count
ChangeDockerImage          clusterId dockerImage
LaunchCluster              clusterSpec
LaunchSpotCluster          clusterSpec bidPrice
TerminateCluster           clusterId
TerminateWorker            instanceId
"""
SERVER_KINDS = """
ClusterLaunchAttempt       clusterSpec error?
ClusterTerminationAttempt  clusterId reason error?
ClustersAdded              clusters
ClustersRemoved            clusterIds
DockerImageChangeAttempt   clusterId dockerImage error?
DockerImageChangeRequest   clusterId dockerImage
InstanceContainerState     instanceId containerState
InstanceDockerImage        instanceId dockerImage?
InstanceIpAddress          instanceId ipAddress?
InstanceState              instanceId state
InstanceSubnet             instanceId subnet?
InstanceTerminatedAt       instanceId terminatedAt
WorkerAdditionAttempt      clusterId count error?
WorkerTerminationAttempt   instanceId error?
WorkersAdded               clusterId workers
WorkersRemoved             clusterId workerIds
"""

# Type of each message field, and the fields of the nested types.
FIELD_TYPES = """
serverId text, messageNo int, clusterId uuid, instanceId text, count int, dockerImage image, clusterSpec spec, bidPrice decimal,
reason termination_reason, clusters cluster*, clusterIds uuid*, containerState container_state,
ipAddress address, state instance_state, subnet subnet, terminatedAt instant, workers instance*, workerIds text*,
error text
"""
NESTED_TYPES = {
    "image": "repo text, tag text",
    "subnet": "id text, availabilityZone text",
    "tags": "tags textmap",
    "spec": """id uuid, name text, dockerImage image, ttl? duration, idleTimeout? duration, masterInstanceType text,
               workerInstanceType text, numWorkers int, subnetId text, placementGroup? text, extraInstanceTags? tags""",
    "instance": """id text, ipAddress? address, subnet? subnet, placementGroup? text, dockerImage? image,
                   state instance_state, containerState container_state, instanceType text, launchedAt instant,
                   terminatedAt? instant""",
    "cluster": """id uuid, name text, dockerImage image, ttl? duration, idleTimeout? duration, master instance,
                  workers instance*, workerInstanceType text, subnet subnet, placementGroup? text,
                  workerBidPrice? decimal, launchedAt instant""",
}

# Strict form of a cluster id, and what an address may look like.
UUID_PATTERN = "^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$"
LOOSE_UUID_PATTERN = "^[0-9a-fA-F]+(-[0-9a-fA-F]+){4}$"
ADDRESS_PATTERN = (
    r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?!$)|$)){4}$|^[0-9a-fA-F:]*:[0-9a-fA-F:.]*$")

#: Decimals as table values. Reading one with more digits before the point fails; one with more behind it would be rounded.
DECIMAL = T.DecimalType(38, 18)

ENVELOPE = ["serverId", "messageNo"]


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    many: bool
    optional: bool


def _fields(text: str) -> list[Field]:
    out = []
    for item in text.split(","):
        name, kind = item.split()
        out.append(Field(name.rstrip("?"), kind.rstrip("*"), kind.endswith("*"), name.endswith("?")))
    return out


MESSAGE_FIELDS = _fields(FIELD_TYPES)
NESTED = {name: _fields(text) for name, text in NESTED_TYPES.items()}


def _kinds() -> dict[str, tuple[list[str], list[str]]]:
    out = {}
    for text, envelope in ((CLIENT_KINDS, []), (SERVER_KINDS, ENVELOPE)):
        for line in text.strip().splitlines():
            kind, *fields = line.split()
            required = envelope + [f for f in fields if not f.endswith("?")]
            out[kind] = (required, [f[:-1] for f in fields if f.endswith("?")])
    return out


# kind -> (required fields, optional fields)
KINDS = _kinds()


def kinds_requiring(field: str) -> list[str]:
    return [k for k, (required, _) in KINDS.items() if field in required]


def kinds_having(field: str) -> list[str]:
    return [k for k, (required, optional) in KINDS.items() if field in required + optional]


def wire_type(kind: str) -> T.DataType:
    """Spark type a JSON value of this kind is read as, before its text is converted."""
    if kind in NESTED:
        return T.StructType([T.StructField(f.name, field_type(f, wire_type)) for f in NESTED[kind]])
    if kind == "textmap":
        return T.MapType(T.StringType(), T.StringType())
    return {"int": T.IntegerType(), "decimal": DECIMAL}.get(kind, T.StringType())


def field_type(field: Field, of=wire_type) -> T.DataType:
    inner = of(field.kind)
    return T.ArrayType(inner) if field.many else inner


def wire_schema() -> T.StructType:
    """Schema for ``from_json``: the tag, every field of every kind, and the corrupt-record text."""
    return T.StructType(
        [T.StructField("$type", T.StringType())]
        + [T.StructField(f.name, field_type(f)) for f in MESSAGE_FIELDS]
        + [T.StructField("_corrupt_record", T.StringType())]
    )


def column_name(field: str) -> str:
    """``messageNo`` is column ``message_no``."""
    return "".join("_" + c.lower() if c.isupper() else c for c in field)
