"""Input tables for the registered queries, as SQL over the generated tables.

Each text gives the same rows on Spark and DuckDB. ``Inputs`` resolves them on Spark;
``with_views`` puts the ones a query needs in front of its SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.hot_keys import row_numbers
from ..session import prepare, shared_dir
from ..sources.inventory import snapshot_stream

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

NOW = "2024-01-30 12:00:00"
#: Micro-batches of a table that is read as a stream.
SLICES = 4
#: Views whose rows cost far more to work on than to read: a file of small rows is read by few tasks.
SPREAD = ["wire_parts"]

# Tag views: (key, value, condition) per row that an order gives.
_TAG_ROWS = [
    ("x:cluster_name", "concat('cluster-', o_orderkey)", "true"),
    ("x:cluster_ttl", "concat(o_custkey % 24 + 1, 'h')", "o_custkey % 3 <> 0"),
    ("x:cluster_idle_timeout", "concat(o_custkey % 90 + 1, 'm')", "o_custkey % 2 = 0"),
    ("x:worker_bid_price", "cast(cast(cast(o_custkey % 500 as decimal(18,2)) / 100 as decimal(18,2)) as string)",
     "o_custkey % 5 = 0"),
    ("Name", "concat('node ', o_orderkey)", "o_orderkey % 4 = 0"),
    ("team", "o_orderpriority", "true"),
]
_TAG_OVERRIDE = [
    ("team", "'ops'", "o_custkey % 3 = 0"),
    ("x:cluster_ttl", "'1h'", "o_custkey % 4 = 0"),
    ("owner", "concat('c', o_custkey)", "o_custkey % 7 = 0"),
]
TAG_VIEWS = {
    "tag_rows": _TAG_ROWS,
    "tag_override": _TAG_OVERRIDE,
    "extra_tag": [*_TAG_OVERRIDE, ("Name", "concat('own name ', o_orderkey)", "o_custkey % 10 = 0")],
    "cluster_tags": [
        *_TAG_ROWS,
        ("x:cluster_ttl", "'soon'", "o_custkey % 12 = 0"),
        ("x:cluster_docker_image", "concat('lab/app:', o_custkey % 9, '.0-', o_orderkey % 50)", "o_orderkey % 8 <> 0"),
        ("x:worker_instance_type", "cast(o_custkey % 2000 as string)", "o_orderkey % 9 <> 0"),
        ("x:subnet_id", "concat('subnet-', o_custkey % 25)", "o_orderkey % 10 <> 0"),
        ("x:placement_group", "concat('pg-', o_custkey % 6)", "o_custkey % 6 <> 0"),
        ("x:spark_cluster_role", "'Master'", "true"),
        ("x:container_state", "'ContainerRunning'", "o_orderstatus = 'O'"),
    ],
}


def _tag_union(name: str) -> str:
    return "\nunion all ".join(
        f"select o_orderkey as cluster_id, '{key}' as tag_key, {value} as tag_value from orders where {condition}"
        for key, value, condition in TAG_VIEWS[name])


def _tag_scan(name: str) -> str:
    """The same rows from one scan of the orders, for Spark."""
    cells = ", ".join(
        f"case when {condition} then named_struct('tag_key', '{key}', 'tag_value', {value}) end"
        for key, value, condition in TAG_VIEWS[name])
    return f"select o_orderkey as cluster_id, inline(array_compact(array({cells}))) from orders"


VIEWS: dict[str, str] = {
    **{name: _tag_union(name) for name in TAG_VIEWS},
    "spec_dim": """
select p_partkey as instance_type, p_size as cores, cast(p_size as bigint) * 1073741824 as memory_bytes,
       p_size % 5 as devices, 343597383680 as bytes_per_device,
       cast(cast(p_retailprice as decimal(18,2)) / 1000 as decimal(18,4)) as hourly_price,
       p_type <> 'SMALL' as is_spot_eligible
from part""",
    "instance_fact": """
select concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) as instance_id,
       l_orderkey as cluster_id, l_partkey as instance_type,
       case when l_linenumber = 1 then 'Master' else 'Worker' end as role,
       case when l_linestatus = 'O' and l_returnflag = 'N' then 'Running'
            when l_linestatus = 'O' and l_returnflag = 'A' then 'Starting'
            when l_linestatus = 'O' then 'Pending'
            when l_returnflag = 'N' then 'Terminating' else 'Terminated' end as state,
       case l_linenumber % 5 when 0 then 'ContainerPending' when 1 then 'ContainerRunning'
            when 2 then 'ContainerStarting' when 3 then 'ContainerStopped' else 'ContainerStopping' end as container_state,
       case l_linenumber % 6 when 0 then 'stopped' when 1 then 'running' when 2 then 'pending'
            when 3 then 'shutting-down' when 4 then 'terminated' else 'stopping' end as provider_state,
       case when l_suppkey % 7 = 0 then '' else concat('pg-', l_suppkey % 7) end as placement_group,
       case when l_suppkey % 2 = 0 then 'spot' end as lifecycle,
       o_orderdate as launched_at,
       case when l_linestatus = 'F' and l_returnflag <> 'N'
            then concat('User initiated (', cast(greatest(l_shipdate, o_orderdate) as string), ' GMT)') end as reason,
       case when l_linestatus = 'F' and l_returnflag <> 'N' then greatest(l_shipdate, o_orderdate) end as terminated_at
from lineitem join orders on l_orderkey = o_orderkey""",
    "raw_instance": """
select concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) as instance_id,
       case when l_suppkey % 11 <> 0 then l_orderkey end as cluster_id, l_partkey as instance_type,
       case when l_suppkey % 9 <> 0 then concat('10.0.', l_suppkey % 200, '.', l_linenumber) end as address,
       case when l_suppkey % 5 <> 0 then concat('subnet-', l_suppkey % 27) end as subnet_id,
       case l_linenumber % 6 when 0 then 'stopped' when 1 then 'running' when 2 then 'pending'
            when 3 then 'shutting-down' when 4 then 'terminated' else 'stopping' end as provider_state,
       case l_linenumber % 5 when 0 then 'ContainerPending' when 1 then 'ContainerRunning'
            when 2 then 'ContainerStarting' when 3 then 'ContainerStopped' end as container_state,
       case when l_suppkey % 7 = 0 then '' else concat('pg-', l_suppkey % 7) end as placement_group,
       case when l_suppkey % 2 = 0 then 'spot' end as lifecycle,
       l_shipdate as launched_at
from lineitem""",
    "cluster_dim": """
select o_orderkey as cluster_id, concat('cluster-', o_orderkey) as name, o_orderdate as launched_at,
       case when o_orderpriority = '5-LOW' then null
            else 24 * cast(substring(o_orderpriority, 1, 1) as bigint) end as ttl_hours,
       case o_orderstatus when 'F' then 'Terminated' when 'O' then 'Running' else 'Starting' end as master_state,
       o_custkey % 2000 as worker_type
from orders""",
    "cluster_spec": """
select o_orderkey as cluster_id, concat('cluster-', o_orderkey) as name,
       concat('lab/app:', o_custkey % 9, '.0-', o_orderkey % 50) as image,
       o_custkey % 2000 as worker_type, concat('subnet-', o_custkey % 25) as subnet_id,
       case when o_custkey % 6 <> 0 then concat('pg-', o_custkey % 6) end as placement_group,
       case when o_custkey % 3 <> 0 then (o_custkey % 24 + 1) * 3600 + 1800 end as ttl_seconds,
       case when o_custkey % 2 = 0 then (o_custkey % 90 + 1) * 60 + 30 end as idle_seconds,
       case when o_custkey % 5 = 0
            then cast(cast(o_custkey % 500 as decimal(18,2)) / 100 as decimal(18,2)) end as bid_price,
       o_orderdate as launched_at
from orders""",
    "numbered_event": """
select *, row_number() over (partition by user_id % 4 order by ts, event_id) as message_no from events""",
    "message_log": """
select event_id, ts, concat('srv-', user_id % 4) as server_id, message_no,
       case event_type when 'click' then 'InstanceState' when 'view' then 'InstanceContainerState'
            when 'signup' then 'InstanceDockerImage' when 'purchase' then 'WorkersAdded'
            else 'WorkersRemoved' end as kind,
       user_id as entity_id, concat('v', cast(floor(value) as int) % 5) as val
from numbered_event""",
    # what was lost on the way
    "gapped_log": """
select * from message_log where event_id % 97 <> 0""",
    "client_log": """
select event_id, ts, concat('client-', entity_id % 40) as client_id, server_id, message_no from gapped_log""",
    "fold_log": """
select event_id, ts, user_id as entity_id,
       case cast(floor(value * 100) as bigint) % 9
            when 0 then 'InstanceState' when 1 then 'InstanceContainerState' when 2 then 'InstanceIpAddress'
            when 3 then 'InstanceSubnet' when 4 then 'InstanceTerminatedAt' when 5 then 'DockerImageChangeRequest'
            when 6 then 'DockerImageChangeAttempt' when 7 then 'WorkersAdded' else 'WorkersRemoved' end as kind,
       concat('v', cast(floor(value) as int) % 5) as val,
       case when event_type = 'error' then 'failed' end as error
from events""",
    "message_text": """
select event_id,
       case when event_id % 101 = 0 then concat('{"$type":"', kind)
            else concat('{"$type":"', kind, '","serverId":"', server_id, '","messageNo":', message_no,
                        ',"instanceId":"', entity_id, '"}') end as line
from message_log""",
    "wire_parts": """
select event_id, cast(floor(value * 100) as bigint) % 26 as pick, user_id,
       concat('"serverId":"srv-', user_id % 4, '","messageNo":', event_id, ',') as envelope,
       concat('"clusterId":"00000000-0000-4000-8000-', lpad(cast(user_id as string), 12, '0'), '"') as cluster,
       concat('"instanceId":"i-', user_id, '"') as instance,
       concat('{"repo":"lab/app","tag":"', event_id % 9, '.0-', event_id % 50, '"}') as image,
       concat('{"id":"subnet-', user_id % 25, '","availabilityZone":"zone-', user_id % 3, '"}') as subnet,
       case when event_type = 'error' then ',"error":"it broke"' else '' end as error,
       concat('2024-01-', lpad(cast(event_id % 28 + 1 as string), 2, '0'), 'T10:', lpad(cast(event_id % 60 as string), 2, '0'),
              ':07.250Z') as stamp,
       concat('PT', event_id % 30 + 1, 'H', event_id % 59 + 1, 'M') as span
from events""",
    "wire_nested": """
select event_id, pick, user_id, envelope, cluster, instance, image, subnet, error, stamp,
       concat('{"id":"00000000-0000-4000-8000-', lpad(cast(user_id as string), 12, '0'), '","name":"job ', event_id,
              '","dockerImage":', image, case when user_id % 3 <> 0 then concat(',"ttl":"', span, '"') else '' end,
              ',"idleTimeout":"PT15M","masterInstanceType":"m1","workerInstanceType":"w', user_id % 7, '","numWorkers":',
              event_id % 100, ',"subnetId":"subnet-', user_id % 25, '","extraInstanceTags":{"tags":{"team":"t', user_id % 5,
              '"}}}') as spec,
       concat('{"id":"i-', user_id, '","ipAddress":"10.0.0.', user_id % 250, '","subnet":', subnet, ',"dockerImage":', image,
              ',"state":"Running","containerState":"ContainerRunning","instanceType":"w', user_id % 7,
              '","launchedAt":"', stamp, '"}') as snapshot
from wire_parts""",
    "wire_text": """
select event_id, concat('{"$type":"', case pick
  when 0 then concat('AddWorkers",', cluster, ',"count":', event_id % 50)
  when 1 then concat('ChangeDockerImage",', cluster, ',"dockerImage":', image)
  when 2 then concat('LaunchCluster","clusterSpec":', spec)
  when 3 then concat('LaunchSpotCluster","clusterSpec":', spec, ',"bidPrice":1.', user_id % 9 + 1, '000')
  when 4 then concat('TerminateCluster",', cluster)
  when 5 then concat('TerminateWorker",', instance)
  when 6 then concat('ClusterLaunchAttempt",', envelope, '"clusterSpec":', spec, error)
  when 7 then concat('ClusterTerminationAttempt",', envelope, cluster, ',"reason":"',
                     case user_id % 4 when 0 then 'ClientRequested' when 1 then 'IdleTimeout' when 2 then 'TTLExpired'
                          else 'Bored' end, '"', error)
  when 8 then concat('ClustersAdded",', envelope, '"clusters":[{"id":"00000000-0000-4000-8000-',
                     lpad(cast(user_id as string), 12, '0'), '","name":"c', event_id, '","dockerImage":', image, ',"master":',
                     snapshot, ',"workers":[', snapshot, ',', snapshot, '],"workerInstanceType":"w1","subnet":', subnet,
                     ',"workerBidPrice":0.2500,"launchedAt":"', stamp, '"}]')
  when 9 then concat('ClustersRemoved",', envelope, '"clusterIds":["00000000-0000-4000-8000-',
                     lpad(cast(user_id as string), 12, '0'), '"]')
  when 10 then concat('DockerImageChangeAttempt",', envelope, cluster, ',"dockerImage":', image, error)
  when 11 then concat('DockerImageChangeRequest",', envelope, cluster, ',"dockerImage":', image)
  when 12 then concat('InstanceContainerState",', envelope, instance, ',"containerState":"',
                      case when user_id % 5 = 0 then 'ContainerLost' else 'ContainerRunning' end, '"')
  when 13 then concat('InstanceDockerImage",', envelope, instance, ',"dockerImage":', image)
  when 14 then concat('InstanceIpAddress",', envelope, instance, ',"ipAddress":"10.0.0.', user_id % 300, '"')
  when 15 then concat('InstanceState",', envelope, instance, ',"state":"',
                      case when user_id % 5 = 0 then 'Lost' else 'Running' end, '"')
  when 16 then concat('InstanceSubnet",', envelope, instance, case when user_id % 2 = 0 then concat(',"subnet":', subnet) else '' end)
  when 17 then concat('InstanceTerminatedAt",', envelope, instance, ',"terminatedAt":"',
                      case when user_id % 6 = 0 then 'yesterday' else stamp end, '"')
  when 18 then concat('WorkerAdditionAttempt",', envelope, cluster, ',"count":', event_id % 50, error)
  when 19 then concat('WorkerTerminationAttempt",', envelope, instance, error)
  when 20 then concat('WorkersAdded",', envelope, cluster, ',"workers":[', snapshot, ',', snapshot, ']')
  when 21 then concat('WorkersRemoved",', envelope, cluster, ',"workerIds":["i-1","i-', user_id, '"]')
  when 22 then concat('NoSuchKind",', envelope, cluster)
  when 23 then concat('AddWorkers",', '"clusterId":"nobody","count":', event_id % 50)
  when 24 then concat('WorkerAdditionAttempt",', envelope, '"count":', event_id % 50)
  else concat('WorkersRemoved",', envelope) end,
  case when pick <= 24 then '}' else '' end) as line
from wire_nested""",
    "wire_faults": """
select event_id, case event_id % 8
  when 0 then replace(line, '"state":"Running"', '"state":"Idle"')
  when 1 then replace(line, '"tag":', '"label":')
  when 2 then replace(replace(line, '"numWorkers":', '"numWorkers":"many","number":'), '"messageNo":', '"messageNo":0.5')
  when 3 then replace(line, '["0000', '["nobody-0000')
  when 4 then replace(line, '"containerState":"ContainerRunning"', '"containerState":null')
  when 5 then replace(replace(line, '"workers":[', '"workers":[7,'), '"subnet":{', '"subnet":[],"net":{')
  when 6 then replace(replace(line, '"tags":{', '"tags":{"a.b":5,'), '"id":"', '"id":"x-')
  else line end as line
from wire_text""",
    "price_history": """
select event_id, user_id as instance_type, concat('zone-', user_id % 3) as zone,
       case when cast(floor(value) as int) % 10 = 0 then 'Windows' else 'Linux/UNIX' end as product,
       cast(value as decimal(18,2)) as price, ts
from events where event_type = 'view'""",
    "price_probe": """
select event_id, user_id as instance_type, concat('zone-', user_id % 3) as zone, ts
from events where event_type = 'purchase'""",
    "app_run": """
select event_id, user_id as cluster_id, ts as start_at, cast(floor(value * 60000) as bigint) as duration_ms,
       event_type = 'error' and ts >= timestamp '2024-01-30 00:00:00' as active
from events where ts < timestamp '2024-01-30 12:00:00'""",
    "app_reading": """
select event_id, user_id as cluster_id, date_trunc('day', ts) as seen_at, ts as start_at,
       cast(floor(value * 60000) as bigint) as duration_ms, event_type = 'error' as active
from events where ts < timestamp '2024-01-30 12:00:00'""",
    "app_cluster": """
select distinct user_id as cluster_id, timestamp '2024-01-01 00:00:00' as launched_at,
       case when user_id % 3 = 0 then 24 * (user_id % 40) end as ttl_hours,
       case when user_id % 2 = 0 then 60 * (user_id % 48 + 1) end as idle_minutes,
       case when user_id % 11 <> 0 then concat('10.0.0.', user_id) end as master_address,
       case when user_id % 7 = 0 then 'Terminating' else 'Running' end as master_state,
       case when user_id % 5 = 0 then 'ContainerStarting' else 'ContainerRunning' end as master_container
from events""",
    "history_text": """
select event_id, user_id as cluster_id,
       concat('{"activeapps":[', case event_type when 'error' then '{"id":"a"}' when 'signup' then '{"id":"a"},{"id":"b"}' else '' end,
              '],"completedapps":[',
              case when event_type in ('view', 'error') then concat('{"starttime":', 1704067200000 + event_id * 1000,
                   ',"duration":', cast(floor(value * 1000) as bigint), '}')
                   when event_type = 'click' then concat('{"starttime":', 1704067200000 + event_id * 1000,
                   ',"duration":5},{"starttime":', 1704067200000 + event_id * 1000 + 60000, ',"duration":',
                   cast(floor(value * 1000) as bigint), '}')
                   else '' end, ']}') as doc
from events""",
    # what each cluster's master answered last, some of it torn off
    "history_last": """
select event_id, cluster_id, case when event_id % 5 = 0 then substring(doc, 1, 30) else doc end as doc from (
  select *, row_number() over (partition by cluster_id order by event_id desc) as rn from history_text) d where rn = 1""",
    "snapshot_prev": """
select user_id as id, event_type as state, case when value >= 5 then value end as address from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events
  where ts < timestamp '2024-01-15 00:00:00') d where rn = 1 and event_type <> 'error'""",
    "snapshot_cur": """
select user_id as id, event_type as state, case when value >= 5 then value end as address from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) d
where rn = 1 and event_type <> 'error'""",
    "fleet_prev": """
select id, id % 50 as cluster_id, case when id < 50 then 'Master' else 'Worker' end as role, state, address from snapshot_prev""",
    "fleet_cur": """
select id, id % 50 as cluster_id, case when id < 50 then 'Master' else 'Worker' end as role, state, address from snapshot_cur""",
    "poll": """
select distinct case when extract(day from ts) <> 11 then user_id end as id, cast(extract(day from ts) as int) as poll_no
from events where extract(day from ts) <> 7""",
    # three days a poll; one did not take place, one found nothing
    "fleet_poll": """
select poll_no, user_id as id, event_type as state, case when value >= 5 then value end as address, event_id as first_event from (
  select *, row_number() over (partition by user_id, poll_no order by ts desc, event_id desc) as rn from (
    select *, cast(floor((extract(day from ts) - 1) / 3) as int) as poll_no from events where event_type <> 'error') e) d
where rn = 1 and poll_no not in (2, 5)
union all
select 2, cast(null as bigint), cast(null as varchar(20)), cast(null as double), cast(null as bigint)""",
    # what the servers of gapped_log had said when it ended
    "received_log": """
select m.event_id, m.ts, m.entity_id, m.kind, m.val, cast(null as varchar(20)) as error
from message_log m join (select server_id, max(message_no) as upto from gapped_log group by server_id) r
  on m.server_id = r.server_id and m.message_no <= r.upto""",
    "user_tags": """
select cluster_id, tag_key, tag_value from tag_rows where tag_key <> 'x:cluster_name'""",
    "subnet_dim": """
select concat('subnet-', n_nationkey) as subnet_id, r_name as zone from nation join region on n_regionkey = r_regionkey""",
    "subnet_choice": """
select s_suppkey as pos, concat('subnet-', s_nationkey) as subnet_id from supplier""",
    "group_state": """
select concat('pg-', s_suppkey) as group_name, case when s_acctbal > 0 then 'available' else 'deleted' end as state from supplier""",
    "image_tags": """
select p_partkey as image_id, concat(replace(p_name, ' ', '/'), ':', substring(p_brand, 7, 9), '.0-',
       case when p_size % 9 = 0 then 'latest' else cast(p_size as string) end) as image_ref
from part""",
    "listing_text": """
select p_partkey as listing_id, concat('{"name":"', replace(p_name, ' ', '/'), '","tags":[',
       case when p_size % 10 = 0 then '' else concat('"', substring(p_brand, 7, 9), '.0-', p_size, '","latest"') end, ']}') as doc
from part""",
    "command_target": """
select cluster_id as command_id, instance_id from instance_fact
union all select o_orderkey, concat(o_orderkey, '-phantom') from orders where o_orderkey % 50 = 0""",
    "command_invocation": """
select l_orderkey as command_id, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) as instance_id,
       case when l_returnflag = 'A' or l_linenumber < 5 then 'Success' when l_returnflag = 'R' then 'Failed'
            when l_linestatus = 'F' then 'TimedOut' else 'InProgress' end as status
from lineitem""",
    "request_log": """
select event_id as request_id, ts, user_id * 101 as cluster_id,
       case event_type when 'signup' then 'AddWorkers' when 'error' then 'TerminateCluster'
            when 'view' then 'TerminateWorker' when 'click' then 'ChangeDockerImage'
            else case when user_id % 2 = 0 then 'LaunchCluster' else 'LaunchSpotCluster' end end as kind,
       case when event_type = 'signup' then cast(floor(value) as int) - 5 end as worker_count,
       case when event_type = 'view' then concat('w-', user_id) end as instance_id,
       case when event_type = 'purchase' then concat('job-', user_id) end as spec, cast(0.25 as decimal(18,4)) as bid_price,
       case when event_id % 3 = 0 then 'Name' end as tag_a, case when event_id % 3 = 0 then 'x:cluster_ttl' end as tag_b
from events""",
    "worker_dim": """
select concat('w-', s_suppkey) as instance_id, case s_nationkey % 5 when 0 then 'Pending' when 1 then 'Starting'
       when 2 then 'Running' when 3 then 'Terminating' else 'Terminated' end as state from supplier""",
    "state_history": """
select event_id, ts, user_id as instance_id,
       case event_type when 'signup' then 'Pending' when 'view' then 'Starting' when 'click' then 'Running'
            when 'purchase' then 'Terminating' else 'Terminated' end as state,
       case cast(floor(value) as int) % 5 when 0 then 'ContainerPending' when 1 then 'ContainerStarting'
            when 2 then 'ContainerRunning' when 3 then 'ContainerStopping' else 'ContainerStopped' end as container_state,
       case when event_type = 'error' then concat('t', cast(floor(value) as int) % 3) end as terminated_mark
from events""",
    "launch_request": """
select event_id as request_id, case when event_id % 13 <> 0 then concat('job-', user_id) end as name,
       case when user_id % 6 <> 0 then cast(floor(value) as int) % 30 end as lifetime_hours,
       cast(floor(value) as int) % 130 as num_workers, cast(floor(value) as int) % 200 as idle_minutes,
       user_id as instance_type, cast(cast(floor(value) as int) % 12 as decimal(18,2)) as bid_ratio
from events where event_type = 'signup'""",
}


def _mentions(sql: str, names) -> list[str]:
    words = set(re.findall(r"\b(?:from|join)\s+([a-z_]+)", sql))
    return [n for n in names if n in words]


def needed_views(sql: str) -> list[str]:
    """Views a SQL text depends on, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _mentions(text, VIEWS):
            if name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    return order


def with_views(sql: str) -> str:
    """The SQL with every view it uses as a leading common table expression."""
    views = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in needed_views(sql))
    body = sql.strip()
    if not views:
        return body
    if body.lower().startswith("with "):
        return f"with {views},\n{body[5:]}"
    return f"with {views}\n{body}"


class Inputs:
    """The generated tables and the views over them, as DataFrames of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, streaming: bool = False):
        self.spark, self.sf_dir, self.streaming = prepare(spark), sf_dir, streaming

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.arriving(rows, name) if self.streaming else rows

    def arriving(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` landed in the order of ``ts``, as ``SLICES`` spans of whole days, and read as one micro-batch for each."""
        path = shared_dir(self.spark, f"{name}-landing")
        files = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        days = F.unix_date(F.col("ts").cast("date"))
        low, high = rows.agg(F.coalesce(F.min(days), F.lit(0)), F.coalesce(F.max(days), F.lit(0))).first()
        for i in range(SLICES):
            cut = lambda k: F.lit(low + (high + 1 - low) * k // SLICES)
            part = rows.where((days >= cut(i)) & (days < cut(i + 1)))
            part.repartition(files).write.mode("append").parquet(path)
        return self.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)

    def stream(self) -> Inputs:
        """The same tables and views, read as streams."""
        return Inputs(self.spark, self.sf_dir, streaming=True)

    def view(self, name: str) -> DataFrame:
        if name == "numbered_event":
            # Numbered with the library's operator: a plain window over four servers is four tasks.
            events = self.table("events")
            numbered = row_numbers(events.withColumn("server", F.col("user_id") % 4),
                                   ["server"], ["ts", "event_id"], "message_no")
            return numbered.drop("server")
        return self.sql(_tag_scan(name) if name in TAG_VIEWS else VIEWS[name], name in SPREAD)

    def spread(self, name: str) -> DataFrame:
        """A table dealt evenly over all shuffle partitions."""
        return self.table(name).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def opened(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` landed and read as a stream, all at once."""
        path = shared_dir(self.spark, name)
        rows.write.parquet(path)
        return snapshot_stream(self.spark, path, rows.schema)

    def landed(self, name: str, *columns: str, stream: bool = False) -> DataFrame:
        """Columns of a view, written once to the shared folder and read back.

        For a view that is dear to compute and read several times by one operator.
        """
        path = shared_dir(self.spark, name)
        rows = self.view(name).select(*columns)
        rows.write.parquet(path)
        if stream:
            return snapshot_stream(self.spark, path, rows.schema)
        return self.spark.read.schema(rows.schema).parquet(path)

    def sql(self, text: str, spread: bool = False) -> DataFrame:
        """Run SQL over tables and views; each name it mentions is passed in as a DataFrame, tables dealt evenly if ``spread``."""
        views, tables = _mentions(text, VIEWS), _mentions(text, TABLES)
        given = {n: self.view(n) for n in views} | {n: (self.spread if spread else self.table)(n) for n in tables}
        for name in given:
            text = re.sub(rf"\b(from|join)\s+{name}\b", rf"\1 {{{name}}}", text)
        return self.spark.sql(_brace_safe(text, given), **given)


def _brace_safe(text: str, names) -> str:
    """Double the braces of JSON text so that only the table names are filled in."""
    doubled = text.replace("{", "{{").replace("}", "}}")
    for name in names:
        doubled = doubled.replace("{{" + name + "}}", "{" + name + "}")
    return doubled
