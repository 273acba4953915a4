"""The readers, decoders and encoders over the generated tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.states import CONTAINER_STATES, INSTANCE_STATES, TERMINATION_REASONS
from ..operators import folds, totals
from ..session import shared_dir
from ..sources import inventory, messages
from ..sources.kinds import KINDS, MESSAGE_FIELDS, NESTED, UUID_PATTERN
from .batch_queries import EFFECTIVE, PREFIX
from .registry import query
from .views import NOW, Inputs


def reservations(t: Inputs) -> DataFrame:
    """Raw instances in provider form: an instance, and its twin if it is a spot one, per reservation."""
    key = lambda k, v: f"named_struct('key', '{k}', 'value', {v})"
    instance = lambda suffix: f"""named_struct('instance_id', concat(instance_id, '{suffix}'), 'instance_type', instance_type,
        'tags', case when cluster_id is null then array({key('Name', "'stray'")})
                else array({key('Name', "concat('node ', cluster_id)")}, {key('x:cluster_id', 'cast(cluster_id as string)')}) end)"""
    return t.view("raw_instance").selectExpr(
        "instance_id as reservation_id",
        f"case when lifecycle = 'spot' then array({instance('')}, {instance('-twin')}) else array({instance('')}) end as instances")


@query("inventory_scan", """
select cast(cluster_id as string) as cluster_id, instance_id, instance_type from raw_instance where cluster_id is not null
union all
select cast(cluster_id as string), concat(instance_id, '-twin'), instance_type from raw_instance
where cluster_id is not null and lifecycle = 'spot'""")
def inventory_scan(t: Inputs) -> DataFrame:
    return inventory.inventory_scan(reservations(t), PREFIX).drop("tags")


_JSON = """
j as (select w.event_id, p.pick, p.user_id, case when json_valid(w.line) then cast(w.line as json) end as m, w.line
      from wire_text w join wire_parts p on w.event_id = p.event_id),
judged as (select *, case
    when m is null then 'malformed JSON'
    when pick = 22 then 'unknown $type NoSuchKind'
    when pick = 24 then 'missing clusterId'
    when pick = 23 then 'invalid clusterId'
    when pick = 7 and user_id % 4 = 3 then 'invalid reason'
    when pick = 12 and user_id % 5 = 0 then 'invalid containerState'
    when pick = 14 and user_id % 300 > 255 then 'invalid ipAddress'
    when pick = 15 and user_id % 5 = 0 then 'invalid state'
    when pick = 17 and user_id % 6 = 0 then 'invalid terminatedAt' end as reject from j)"""


def _text(path: str) -> str:
    return f"json_extract_string(m, '$.{path}')"


@query("message_decode", f"""
with {_JSON.strip()}
select event_id, {_text('"$type"')} as kind, {_text('serverId')} as server_id, cast({_text('messageNo')} as int) as message_no,
       {_text('clusterId')} as cluster_id, {_text('instanceId')} as instance_id, cast({_text('count')} as int) as count,
       {_text('dockerImage.tag')} as image_tag, {_text('clusterSpec.name')} as spec_name,
       1000 * (3600 * cast(regexp_extract({_text('clusterSpec.ttl')}, 'PT([0-9]+)H', 1) as bigint)
               + 60 * cast(regexp_extract({_text('clusterSpec.ttl')}, 'H([0-9]+)M', 1) as bigint)) as spec_ttl,
       cast({_text('bidPrice')} as decimal(18,4)) as bid_price, {_text('reason')} as end_reason,
       {_text('containerState')} as container_state, {_text('state')} as state, {_text('ipAddress')} as ip_address,
       {_text('subnet.availabilityZone')} as zone, cast(replace({_text('terminatedAt')}, 'Z', '') as timestamp) as terminated_at,
       cast(replace({_text('workers[1].launchedAt')}, 'Z', '') as timestamp) as worker_launched_at,
       {_text('clusters[0].workers[1].id')} as snapshot_worker, {_text('workerIds[1]')} as worker_id,
       {_text('clusterIds[0]')} as removed_cluster, {_text('error')} as error, reject
from judged where reject is null
union all
select event_id, {", ".join(["null"] * 21)}, reject from judged where reject is not null""")
def message_decode(t: Inputs) -> DataFrame:
    rows = messages.message_parse(t.view("wire_text"), "line")
    item = lambda c, i: F.try_element_at(c, F.lit(i))
    return rows.select(
        "event_id", "kind", "server_id", "message_no", "cluster_id", "instance_id", "count",
        F.col("docker_image.tag").alias("image_tag"), F.col("cluster_spec.name").alias("spec_name"),
        F.col("cluster_spec.ttl").alias("spec_ttl"), F.col("bid_price").cast("decimal(18,4)").alias("bid_price"), F.col("reason").alias("end_reason"),
        "container_state", "state", "ip_address", F.col("subnet.availabilityZone").alias("zone"),
        F.col("terminated_at").cast("timestamp_ntz").alias("terminated_at"),
        item("workers", 2)["launchedAt"].cast("timestamp_ntz").alias("worker_launched_at"),
        item(item("clusters", 1)["workers"], 2)["id"].alias("snapshot_worker"),
        item("worker_ids", 2).alias("worker_id"), item("cluster_ids", 1).alias("removed_cluster"), "error",
        "reject")


@query("message_encode", f"with {_JSON.strip()} select event_id, line from judged where reject is null")
def message_encode(t: Inputs) -> DataFrame:
    rows, _ = messages.message_decode(t.view("wire_text"), "line")
    return messages.message_encode(rows)


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _schema_paths() -> tuple[list[tuple[str, str, str]], list[tuple[str, str]]]:
    """(path, JSON type, kind of value) of every value, and (path of an object, name of a field it needs)."""
    values, needed = [], []
    open_ = [(f.name, f) for f in MESSAGE_FIELDS]
    while open_:
        path, field = open_.pop()
        if field.many:
            values.append((path, "array", ""))
            path += "[]"
        if field.kind in NESTED:
            values.append((path, "object", ""))
            needed += [(path, f.name) for f in NESTED[field.kind] if not f.optional]
            open_ += [(f"{path}.{f.name}", f) for f in NESTED[field.kind]]
        elif field.kind == "textmap":
            values += [(path, "object", ""), (f"{path}.*", "string", "")]
        else:
            values.append((path, {"int": "integer", "decimal": "number"}.get(field.kind, "string"), field.kind))
    return values, needed


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


def _conformance(view: str) -> str:
    values, needed = _schema_paths()
    enums = {"instance_state": INSTANCE_STATES, "container_state": CONTAINER_STATES, "termination_reason": TERMINATION_REASONS}
    return rf"""
with l as (select *, json_extract_string(m, '$."$type"') as kind
           from (select case when json_valid(line) and json_type(line) = 'OBJECT' then cast(line as json) end as m from {view}) x),
field(kind, path, needed) as (values {_rows([(k, f, "y" if f in required else "") for k, (required, optional) in KINDS.items() for f in required + optional])}),
rule(path, wanted, of) as (values {_rows(values)}),
needs(path, name) as (values {_rows(needed)}),
enum(of, value) as (values {_rows([(of, value) for of, names in enums.items() for value in names])}),
node as (
  select kind, type, value, split_part(split_part(fullkey, '.', 2), '[', 1) as top,
    regexp_replace(regexp_replace(fullkey[3:], '\[[0-9]+\]', '[]', 'g'), '(extraInstanceTags\.tags)\..*', '\1.*') as path
  from l, json_tree(l.m) where (type <> 'NULL' or fullkey like '%]') and fullkey <> '$'),
typed as (
  select n.kind, n.path, n.value, r.wanted, r.of,
    case when type in ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL') then lower(type) when type = 'VARCHAR' then 'string' when type = 'DOUBLE' then 'number' else 'integer' end as found
  from node n join field f on f.kind = n.kind and f.path = n.top join rule r on r.path = n.path),
broken as (
  select '?' as kind, 'malformed JSON' as rule from l where m is null
  union all select coalesce(kind, '?'), 'unknown $type' from l where m is not null and coalesce(kind, '?') not in {_in(KINDS)}
  union all select l.kind, 'missing ' || path from l join field using (kind) where needed = 'y' and json_extract_string(m, '$.' || path) is null
  union all select kind, 'missing ' || path || '.' || name from typed join needs using (path) where found = 'object' and json_extract_string(value, '$.' || name) is null
  union all select kind, 'type ' || path from typed where found <> wanted and not (wanted = 'number' and found = 'integer')
  union all select kind, 'enum ' || path from typed t where found = wanted and of in (select of from enum)
    and not exists (select 1 from enum e where e.of = t.of and e.value = json_extract_string(t.value, '$'))
  union all select kind, 'pattern ' || path from typed where found = wanted and of = 'uuid' and not regexp_matches(json_extract_string(value, '$'), '{UUID_PATTERN}'))
select kind, rule, count(*) as n from broken group by kind, rule"""


@query("message_conformance", _conformance("wire_text"))
def message_conformance(t: Inputs) -> DataFrame:
    return messages.message_conformance(t.view("wire_text"), "line")


@query("message_conformance_log", _conformance("message_text"))
def message_conformance_log(t: Inputs) -> DataFrame:
    return messages.message_conformance(t.view("message_text"), "line")


@query("message_conformance_nested", _conformance("wire_faults"))
def message_conformance_nested(t: Inputs) -> DataFrame:
    return messages.message_conformance(t.view("wire_faults"), "line")


@query("price_history_scan", """
select instance_type, event_id, zone, product, price, ts from price_history
where zone = 'zone-1' and product = 'Linux/UNIX' and ts >= timestamp '2024-01-10 00:00:00'
  and instance_type in (select instance_type from spec_dim where is_spot_eligible)""")
def price_history_scan(t: Inputs) -> DataFrame:
    types = t.view("spec_dim").where("is_spot_eligible")
    return inventory.price_history_scan(t.view("price_history"), types, "zone-1", "Linux/UNIX", "2024-01-10 00:00:00")


@query("app_history_scan", """
with doc as (select event_id, user_id as cluster_id, event_type, event_id * 1000 as start_ms, cast(floor(value * 1000) as bigint) as ms,
                    case event_type when 'error' then 1 when 'signup' then 2 else 0 end as active from events),
run as (
  select event_id, cluster_id, start_ms, start_ms + ms as end_ms, active from doc where event_type in ('view', 'error')
  union all select event_id, cluster_id, start_ms, start_ms + 5, active from doc where event_type = 'click'
  union all select event_id, cluster_id, start_ms + 60000, start_ms + 60000 + ms, active from doc where event_type = 'click'
  union all select event_id, cluster_id, null, null, active from doc where event_type not in ('view', 'error', 'click'))
select event_id, cluster_id, timestamp '2024-01-01 00:00:00' + start_ms * interval 1 millisecond as start_at,
       timestamp '2024-01-01 00:00:00' + end_ms * interval 1 millisecond as end_at, active from run""")
def app_history_scan(t: Inputs) -> DataFrame:
    rows = inventory.app_history_scan(t.view("history_text"), "doc")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_at", "end_at")})


_RUNS = """
last as (select e.*, event_id * 1000 as start_ms, cast(floor(value * 1000) as bigint) as ms, l.doc from events e join history_last l using (event_id)),
run as (
  select event_id, user_id as cluster_id, start_ms, ms, false as active from last where event_type in ('view', 'error') and event_id % 5 <> 0
  union all select event_id, user_id, start_ms, 5, false from last where event_type = 'click' and event_id % 5 <> 0
  union all select event_id, user_id, start_ms + 60000, ms, false from last where event_type = 'click' and event_id % 5 <> 0
  union all select event_id, user_id, null, null, true from last where event_type in ('error', 'signup') and event_id % 5 <> 0
  union all select event_id, user_id, null, null, true from last where event_type = 'signup' and event_id % 5 <> 0)"""


@query("app_run_scan", f"""
with {_RUNS}
select event_id, cluster_id, timestamp '2024-01-01 00:00:00' + start_ms * interval 1 millisecond as start_at, ms as duration_ms, active, null as reason from run
union all select event_id, user_id, null, null, null, 'malformed JSON' from last where event_id % 5 = 0""")
def app_run_scan(t: Inputs) -> DataFrame:
    runs, rejects = inventory.app_run_scan(t.view("history_last"), "doc")
    rows = runs.unionByName(rejects.drop("doc"), allowMissingColumns=True)
    return rows.withColumn("start_at", F.col("start_at").cast("timestamp_ntz"))


@query("timeout_from_history", f"""
with {_RUNS},
activity as (
  select cluster_id, sum(case when active then 1 else 0 end) as active,
         max(case when not active then timestamp '2024-01-01 00:00:00' + (start_ms + ms) * interval 1 millisecond end) as last_end
  from run group by cluster_id)
select c.cluster_id, case
    when c.cluster_id in (select user_id from last where event_id % 5 = 0) then null
    when c.master_address is null or c.master_state <> 'Running' or c.master_container <> 'ContainerRunning' then null
    when coalesce(a.active, 0) > 0 then null
    when timestamp '{NOW}' > c.launched_at + c.ttl_hours * interval 1 hour then 'TTLExpired'
    when timestamp '{NOW}' > coalesce(a.last_end, c.launched_at) + c.idle_minutes * interval 1 minute then 'IdleTimeout' end as verdict
from app_cluster c left join activity a on c.cluster_id = a.cluster_id""")
def timeout_from_history(t: Inputs) -> DataFrame:
    """From what the masters answered: a cluster whose answer can't be read is not judged."""
    runs, rejects = inventory.app_run_scan(t.view("history_last"), "doc")
    unread = rejects.select("cluster_id", F.lit(False).alias("readable")).distinct()
    clusters = t.view("app_cluster").join(unread, "cluster_id", "left").withColumn("available", F.coalesce("readable", F.lit(True))).drop("readable")
    return totals.timeout_verdict(clusters, runs, NOW, "available")


@query("image_tag_scan", """
select p_partkey as listing_id, replace(p_name, ' ', '/') as repo, concat(substring(p_brand, 7, 9), '.0-', p_size) as tag
from part where p_size % 10 <> 0
union all select p_partkey, replace(p_name, ' ', '/'), 'latest' from part where p_size % 10 <> 0""")
def image_tag_scan(t: Inputs) -> DataFrame:
    return inventory.image_tag_scan(t.view("listing_text"), "doc")


@query("cluster_snapshot", f"""
with shown as (select i.*, m.effective_state from instance_fact i join {EFFECTIVE} m
               on i.state = m.state and i.container_state = m.container_state),
master as (select * from (select *, row_number() over (partition by cluster_id order by launched_at, instance_id) as rn
                          from shown where role = 'Master') x where rn = 1)
select c.cluster_id, c.name, m.instance_id as master_id, m.effective_state as master_container, w.instance_id as worker_id,
       w.effective_state as worker_container, w.launched_at as worker_launched_at
from cluster_dim c left join master m on c.cluster_id = m.cluster_id
left join shown w on c.cluster_id = w.cluster_id and w.role = 'Worker'""")
def cluster_snapshot(t: Inputs) -> DataFrame:
    nested = inventory.cluster_snapshot(t.view("cluster_dim"), t.view("instance_fact"), part_size=1000)
    flat = nested.select("cluster_id", "name", "master", F.explode_outer("workers").alias("w"))
    return flat.select(
        "cluster_id", "name", F.col("master.instance_id").alias("master_id"),
        F.col("master.container_state").alias("master_container"), F.col("w.instance_id").alias("worker_id"),
        F.col("w.container_state").alias("worker_container"), F.col("w.launched_at").alias("worker_launched_at"))


@query("available_groups", "select group_name from group_state where state = 'available'")
def available_groups(t: Inputs) -> DataFrame:
    return inventory.available_groups(t.view("group_state"), "state", "group_name")


# The cluster of a user's messages is the user's own, and all its instances are one: the message that counts is a matter of order alone.
_FOLDED = f"""
{_JSON.strip()},
ok as (select *, case when pick = 8 then m -> '$.clusters[0]' end as snapshot from judged where reject is null),
present as (
  select user_id, added, snapshot from (
    select user_id, max(event_id) filter (where pick = 8) as added, max(event_id) filter (where pick = 9) as gone from ok group by user_id) c
  join (select event_id, snapshot from ok where pick = 8) s on s.event_id = c.added where gone is null or gone < added),
later as (select o.* from ok o join present p on o.user_id = p.user_id and o.event_id > p.added)"""
_CLUSTER_ID = "concat('00000000-0000-4000-8000-', lpad(cast(p.user_id as varchar), 12, '0'))"


def _snap(path: str, of: str = "snapshot") -> str:
    return f"json_extract_string({of}, '$.{path}')"


def _stamp(path: str, of: str) -> str:
    return f"cast(replace({_snap(path, of)}, 'Z', '') as timestamp)"


def _folded(t: Inputs) -> tuple[DataFrame, DataFrame]:
    """The fold of what is decoded, landed first since it is read several times."""
    decoded, _ = messages.message_decode(t.view("wire_text"), "line")
    path = shared_dir(t.spark, "decoded")
    decoded.write.parquet(path)
    return folds.fold_messages(t.spark.read.schema(decoded.schema).parquet(path), ["event_id"])


@query("fold_clusters", f"""
with {_FOLDED},
image as (
  select user_id, arg_max({_text('dockerImage.tag')}, event_id) filter (where pick = 10) as tag, arg_max(pick = 11, event_id) as changing
  from later where pick = 11 or (pick = 10 and {_text('error')} is null) group by user_id)
select {_CLUSTER_ID} as cluster_id, {_snap('name')} as name, {_snap('workerInstanceType')} as worker_instance_type, {_snap('subnet.id')} as subnet_id,
       {_stamp('launchedAt', 'snapshot')} as launched_at, {_snap('master.id')} as master_id,
       coalesce(tag, {_snap('dockerImage.tag')}) as image_tag, coalesce(changing, false) as image_change_in_progress
from present p left join image i on p.user_id = i.user_id""")
def fold_clusters(t: Inputs) -> DataFrame:
    clusters, _ = _folded(t)
    return clusters.select(
        "cluster_id", "name", "worker_instance_type", F.col("subnet.id").alias("subnet_id"), F.col("launched_at").cast("timestamp_ntz").alias("launched_at"),
        "master_id", F.col("docker_image.tag").alias("image_tag"), "image_change_in_progress")


@query("fold_members", f"""
with {_FOLDED},
said as (
  select user_id, max(event_id) filter (where pick = 15) as state_at, max(event_id) filter (where pick = 12) as container_at,
         max(event_id) filter (where pick = 14) as address_at, max(event_id) filter (where pick = 16) as subnet_at,
         max(event_id) filter (where pick = 17) as terminated_at
  from later group by user_id),
removed as (select user_id, max(event_id) as removed from later where pick = 21 group by user_id),
start as (
  select p.user_id, min(o.event_id) as start from present p join ok o on o.user_id = p.user_id and o.event_id >= p.added and o.pick in (8, 20)
  left join removed r on r.user_id = p.user_id where r.removed is null or o.event_id > r.removed group by p.user_id),
workers as (
  select s.user_id, case o.pick when 8 then o.snapshot -> '$.workers[0]' else o.m -> '$.workers[0]' end as w from start s join ok o on o.event_id = s.start)
select {_CLUSTER_ID} as cluster_id, {_snap('master.id')} as instance_id, 'Master' as role,
       case when state_at is null then {_snap('master.state')} else json_extract_string(s1.m, '$.state') end as state,
       case when container_at is null then {_snap('master.containerState')} else json_extract_string(s2.m, '$.containerState') end as container_state,
       case when address_at is null then {_snap('master.ipAddress')} else json_extract_string(s3.m, '$.ipAddress') end as ip_address,
       case when subnet_at is null then {_snap('master.subnet.id')} else json_extract_string(s4.m, '$.subnet.id') end as subnet_id,
       cast(replace(json_extract_string(s5.m, '$.terminatedAt'), 'Z', '') as timestamp) as terminated_at, {_stamp('master.launchedAt', 'p.snapshot')} as launched_at
from present p left join said x on p.user_id = x.user_id left join ok s1 on s1.event_id = state_at left join ok s2 on s2.event_id = container_at
  left join ok s3 on s3.event_id = address_at left join ok s4 on s4.event_id = subnet_at left join ok s5 on s5.event_id = x.terminated_at
union all
select {_CLUSTER_ID}, {_snap('id', 'w')}, 'Worker', {_snap('state', 'w')}, {_snap('containerState', 'w')}, {_snap('ipAddress', 'w')},
       {_snap('subnet.id', 'w')}, null, {_stamp('launchedAt', 'w')}
from workers p""".replace("json_extract_string(snapshot", "json_extract_string(p.snapshot"))
def fold_members(t: Inputs) -> DataFrame:
    _, members = _folded(t)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return members.select("cluster_id", "instance_id", "role", "state", "container_state", "ip_address", F.col("subnet.id").alias("subnet_id"),
                          ntz("terminated_at"), ntz("launched_at"))
