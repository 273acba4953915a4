"""The batch operators over the generated tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.states import CONTAINER_STATES, INSTANCE_STATES, allowed_transitions
from ..operators import fleet, logs, lookups, prices, requests, sets, states, tags, totals
from .registry import query
from .views import NOW, Inputs

PREFIX = "x:"
_NTZ = "timestamp_ntz"


# The effective container state by container state (rows) and instance state (columns).
EFFECTIVE = """(
  select container_state, unnest(['Pending', 'Starting', 'Running', 'Terminating', 'Terminated']) as state,
         'Container' || unnest(cells) as effective_state
  from (values
    ('ContainerPending',  ['Pending', 'Pending',  'Pending',  'Stopping', 'Stopped']),
    ('ContainerStarting', ['Pending', 'Starting', 'Starting', 'Stopping', 'Stopped']),
    ('ContainerRunning',  ['Pending', 'Starting', 'Running',  'Stopping', 'Stopped']),
    ('ContainerStopping', ['Stopped', 'Stopping', 'Stopping', 'Stopping', 'Stopped']),
    ('ContainerStopped',  ['Stopped', 'Stopped',  'Stopped',  'Stopped',  'Stopped'])) v(container_state, cells))"""
SPEC_NULLS = "cast(null as string)"


def _both(rows: DataFrame, rejects: DataFrame) -> DataFrame:
    """Rows and rejects as one result."""
    return rows.withColumn("reason", F.lit(None).cast("string")).unionByName(rejects, allowMissingColumns=True)


def _system(key: str) -> str:
    return f"(starts_with({key}, '{PREFIX}') or {key} = 'Name')"


# Tags


@query("tag_pivot", f"""
with wide as (
  select cluster_id,
         max(case when tag_key = 'x:cluster_name' then tag_value end) as name,
         max(case when tag_key = 'x:cluster_docker_image' then tag_value end) as cluster_image,
         max(case when tag_key = 'x:docker_image' then tag_value end) as image,
         max(case when tag_key = 'x:worker_instance_type' then tag_value end) as worker_type,
         max(case when tag_key = 'x:subnet_id' then tag_value end) as subnet_id,
         max(case when tag_key = 'x:placement_group' then tag_value end) as placement_group,
         max(case when tag_key = 'x:spark_cluster_role' then tag_value end) as role,
         max(case when tag_key = 'x:cluster_ttl' then tag_value end) as ttl,
         max(case when tag_key = 'x:cluster_idle_timeout' then tag_value end) as idle,
         max(case when tag_key = 'x:worker_bid_price' then tag_value end) as bid,
         max(case when tag_key = 'x:container_state' then tag_value end) as container_state
  from cluster_tags group by cluster_id)
select cluster_id, name, cluster_image, image, worker_type, subnet_id, placement_group, role,
       try_cast(split_part(ttl, 'h', 1) as bigint) as ttl_hours,
       try_cast(split_part(idle, 'm', 1) as bigint) as idle_minutes,
       cast(bid as decimal(18,4)) as bid_price, container_state,
       case when ttl = 'soon' then 'Malformed tag x:cluster_ttl: soon' end as error
from wide""")
def tag_pivot(t: Inputs) -> DataFrame:
    return tags.tag_pivot(t.view("cluster_tags"), PREFIX)


@query("extra_tags", f"select cluster_id, tag_key, tag_value from tag_rows where not {_system('tag_key')}")
def extra_tags(t: Inputs) -> DataFrame:
    return tags.extra_tags(t.view("tag_rows"), PREFIX)


@query("validate_tags", f"""
select cluster_id, tag_key, tag_value, cast(null as string) as reason from user_tags
where cluster_id not in (select cluster_id from user_tags where {_system('tag_key')})
union all
select cluster_id, tag_key, tag_value, concat('Invalid tag key: ', tag_key) from user_tags where {_system('tag_key')}""")
def validate_tags(t: Inputs) -> DataFrame:
    return _both(*tags.validate_tags(t.view("user_tags"), PREFIX))


@query("merge_tags", """
select coalesce(o.cluster_id, b.cluster_id) as cluster_id, coalesce(o.tag_key, b.tag_key) as tag_key,
       coalesce(o.tag_value, b.tag_value) as tag_value
from tag_rows b full outer join tag_override o on b.cluster_id = o.cluster_id and b.tag_key = o.tag_key""")
def merge_tags(t: Inputs) -> DataFrame:
    return tags.merge_tags(t.view("tag_rows"), t.view("tag_override"))


_RESOURCE = """
select cluster_id, 'Name' as tag_key, concat('Spark {role} : ', name) as tag_value from cluster_spec
union all select cluster_id, 'x:cluster_id', cast(cluster_id as string) from cluster_spec
union all select cluster_id, 'x:cluster_name', name from cluster_spec
union all select cluster_id, 'x:spark_cluster_role', '{role}' from cluster_spec"""


@query("build_tags", f"""
with attribute as (
  select cluster_id, 'x:cluster_docker_image' as tag_key, image as tag_value from cluster_spec
  union all select cluster_id, 'x:worker_instance_type', cast(worker_type as string) from cluster_spec
  union all select cluster_id, 'x:subnet_id', subnet_id from cluster_spec
  union all select cluster_id, 'x:placement_group', placement_group from cluster_spec where placement_group is not null
  union all select cluster_id, 'x:cluster_ttl', concat(ttl_seconds // 3600, 'h') from cluster_spec where ttl_seconds is not null
  union all select cluster_id, 'x:cluster_idle_timeout', concat(idle_seconds // 60, 'm') from cluster_spec where idle_seconds is not null
  union all select cluster_id, 'x:worker_bid_price', cast(bid_price as string) from cluster_spec where bid_price is not null)
select 'Master' as role, r.* from ({_RESOURCE.format(role='Master')}) r
union all select 'Master', a.* from attribute a
  where not exists (select 1 from extra_tag e where e.cluster_id = a.cluster_id and e.tag_key = a.tag_key)
union all select 'Master', e.* from extra_tag e
union all select 'Worker', r.* from ({_RESOURCE.format(role='Worker')}) r
union all select 'Worker', e.* from extra_tag e
union all select 'SpotRequest', r.* from ({_RESOURCE.format(role='Worker')}) r""")
def build_tags(t: Inputs) -> DataFrame:
    clusters, extra = t.view("cluster_spec"), t.view("extra_tag")
    parts = [
        tags.build_tags(clusters, extra, PREFIX, role).withColumn("role", F.lit(role))
        for role in ("Master", "Worker", "SpotRequest")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# States and checks


@query("effective_state", f"""
select h.event_id, h.state, h.container_state, m.effective_state
from state_history h join {EFFECTIVE} m on h.state = m.state and h.container_state = m.container_state""")
def effective_state(t: Inputs) -> DataFrame:
    rows = t.view("state_history").select("event_id", "state", "container_state")
    return states.effective_state(rows, "state", "container_state")


@query("normalise_state", """
select instance_id, provider_state,
       case provider_state when 'pending' then 'Starting' when 'running' then 'Running' when 'shutting-down' then 'Terminating'
            when 'stopping' then 'Terminating' when 'terminated' then 'Terminated' end as state,
       case when provider_state = 'stopped' then 'unexpected instance state: stopped' end as reason
from instance_fact""")
def normalise_state(t: Inputs) -> DataFrame:
    rows = t.view("instance_fact").select("instance_id", "provider_state")
    return _both(*states.normalise_state(rows, "provider_state"))


@query("lifecycle_filter", """
select 'running' as which, cluster_id, instance_id from instance_fact where role = 'Worker' and state = 'Running'
union all select 'unterminated', cluster_id, instance_id from instance_fact where role = 'Worker' and state <> 'Terminated'
union all select 'members', cluster_id, instance_id from instance_fact
union all select 'running_clusters', cluster_id, instance_id from instance_fact where cluster_id in (
  select cluster_id from instance_fact where role = 'Master' and state = 'Running' and container_state = 'ContainerRunning')""")
def lifecycle_filter(t: Inputs) -> DataFrame:
    rows = t.view("instance_fact").select("cluster_id", "instance_id", "role", "state", "container_state")
    out = None
    for which in ("running", "unterminated", "members", "running_clusters"):
        part = states.lifecycle_filter(rows, which).select(F.lit(which).alias("which"), "cluster_id", "instance_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("action_guard", """
select event_id, 'terminate_instance' as action,
       case state when 'Terminating' then 'instance is already terminating' when 'Terminated' then 'instance is already terminated' end as error
from state_history
union all
select event_id, 'terminate_instance_shown',
       case when state = 'Terminating' then 'instance is already terminating'
            when state = 'Terminated' then 'instance is already terminated'
            when container_state = 'ContainerStopping' then 'container is stopping'
            when container_state = 'ContainerStopped' then 'container is stopped' end
from state_history
union all
select event_id, 'terminate_cluster',
       case when terminated_mark is not null then concat('cluster termination is already underway because of ', terminated_mark)
            when state = 'Terminating' then 'cluster is already terminating'
            when state = 'Terminated' then 'cluster is already terminated' end
from state_history
union all
select event_id, 'add_workers',
       case when state <> 'Running' then 'cluster master must be running to add workers'
            when event_id % 10 - 4 <= 0 then 'worker count must be positive' end
from state_history
union all
select event_id, 'change_image',
       case when state <> 'Running' then 'cluster master must be running to change docker image'
            when container_state <> 'ContainerRunning' then 'master container is not running' end
from state_history
union all
select event_id, 'change_image_again',
       case when state <> 'Running' then 'cluster master must be running to change docker image'
            when event_id % 4 = 1 then 'docker image change is in progress'
            when container_state <> 'ContainerRunning' then 'master container is not running' end
from state_history""")
def action_guard(t: Inputs) -> DataFrame:
    rows = t.view("state_history").withColumn("workers", F.col("event_id") % 10 - 4).withColumn("changing", F.col("event_id") % 4 == 1)
    cases = {
        "terminate_instance": states.action_guard(rows, "terminate_instance", "state"),
        "terminate_instance_shown": states.action_guard(rows, "terminate_instance", "state", "container_state"),
        "terminate_cluster": states.action_guard(rows, "terminate_cluster", "state", underway_col="terminated_mark"),
        "add_workers": states.action_guard(rows, "add_workers", "state", count_col="workers"),
        "change_image": states.action_guard(rows, "change_image", "state", "container_state"),
        "change_image_again": states.action_guard(rows, "change_image", "state", "container_state", changing_col="changing"),
    }
    out = None
    for name, checked in cases.items():
        part = checked.select("event_id", F.lit(name).alias("action"), "error")
        out = part if out is None else out.unionByName(part)
    return out


@query("display_status", """
select case when state = 'Terminated' then 'red' when state <> 'Running' then 'busy'
            when container_state = 'ContainerPending' then 'cyan' when container_state = 'ContainerStarting' then 'yellow'
            when container_state = 'ContainerRunning' then 'green' else 'busy' end as bucket, count(*) as n
from instance_fact group by 1""")
def display_status(t: Inputs) -> DataFrame:
    shown = states.display_status(t.view("instance_fact"), "state", "container_state")
    return shown.groupBy("bucket").agg(F.count("*").alias("n"))


@query("instance_facts", """
select instance_id, cluster_id, instance_type, address, subnet_id, provider_state,
       coalesce(container_state, 'ContainerPending') as container_state, nullif(placement_group, '') as placement_group,
       coalesce(lifecycle = 'spot', false) as is_spot, launched_at
from raw_instance""")
def instance_facts(t: Inputs) -> DataFrame:
    return states.instance_facts(t.view("raw_instance"))


@query("uptime", f"""
select instance_id, launched_at as started_at, coalesce(terminated_at, timestamp '{NOW}') as ended_at, terminated_at
from instance_fact""")
def uptime(t: Inputs) -> DataFrame:
    rows = t.view("instance_fact").select("instance_id", "state", "launched_at", "reason")
    rows, _ = states.uptime(rows, "reason", NOW)
    return rows.select("instance_id", "started_at", "ended_at", "terminated_at")


@query("ttl_expiry", f"""
select cluster_id, launched_at + ttl_hours * interval 1 hour as expires_at,
       coalesce(timestamp '{NOW}' > launched_at + ttl_hours * interval 1 hour, false) as expired
from cluster_dim""")
def ttl_expiry(t: Inputs) -> DataFrame:
    return states.ttl_expiry(t.view("cluster_dim"), "ttl_hours", NOW).select("cluster_id", "expires_at", "expired")


@query("bid_price", """
select r.request_id, r.instance_type, cast(r.bid_ratio * s.hourly_price as decimal(38,6)) as bid_price
from launch_request r join spec_dim s on r.instance_type = s.instance_type where s.is_spot_eligible""")
def bid_price(t: Inputs) -> DataFrame:
    return prices.bid_price(t.view("launch_request"), t.view("spec_dim"), "bid_ratio").select(
        "request_id", "instance_type", "bid_price")


@query("size_normalise", """
with total as (
  select i.cluster_id, sum(cast(s.memory_bytes + i.instance_type * 512 * (i.cluster_id % 3) as hugeint)) as bytes
  from instance_fact i join spec_dim s on i.instance_type = s.instance_type group by i.cluster_id)
select cluster_id, cast(bytes as decimal(38,0)) as bytes, case
  when bytes = 0 then '0b'
  when bytes % 1125899906842624 = 0 then concat(bytes // 1125899906842624, 'p')
  when bytes % 1099511627776 = 0 then concat(bytes // 1099511627776, 't')
  when bytes % 1073741824 = 0 then concat(bytes // 1073741824, 'g')
  when bytes % 1048576 = 0 then concat(bytes // 1048576, 'm')
  when bytes % 1024 = 0 then concat(bytes // 1024, 'k')
  else concat(bytes, 'b') end as size
from total""")
def size_normalise(t: Inputs) -> DataFrame:
    sized = t.view("instance_fact").join(t.view("spec_dim"), "instance_type").select(
        "cluster_id", F.expr("memory_bytes + instance_type * 512 * (cluster_id % 3)").alias("bytes"))
    return states.size_normalise(sized, ["cluster_id"], "bytes")


@query("image_ref_parse", """
select image_id, image_ref, split_part(image_ref, ':', 1) as repo, regexp_extract(image_ref, '^[^:]*:?(.*)$', 1) as tag,
       split_part(regexp_extract(image_ref, '^[^:]*:?(.*)$', 1), '-', 1) as short_tag
from image_tags""")
def image_ref_parse(t: Inputs) -> DataFrame:
    return states.image_ref_parse(t.view("image_tags"), "image_ref")


@query("launch_request_check", """
select request_id, 'name' as rule from launch_request where coalesce(name, '') = ''
union all select request_id, 'lifetime_hours' from launch_request where lifetime_hours is not null and lifetime_hours not between 1 and 24
union all select request_id, 'num_workers' from launch_request where num_workers is null or num_workers not between 0 and 100
union all select request_id, 'idle_minutes' from launch_request where idle_minutes is not null and idle_minutes not between 1 and 180
union all select request_id, 'bid_ratio' from launch_request where bid_ratio is not null and bid_ratio not between 0 and 10""")
def launch_request_check(t: Inputs) -> DataFrame:
    return states.launch_request_check(t.view("launch_request"))


# Joins


@query("strict_lookup", """
select c.cluster_id, c.worker_type, s.cores, s.hourly_price,
       case when s.instance_type is null then concat('unknown worker_type: ', c.worker_type) end as reason
from cluster_dim c left join spec_dim s on c.worker_type = s.instance_type""")
def strict_lookup(t: Inputs) -> DataFrame:
    specs = t.view("spec_dim").select(F.col("instance_type").alias("worker_type"), "cores", "hourly_price")
    return _both(*lookups.strict_lookup(t.view("cluster_dim").select("cluster_id", "worker_type"), specs, "worker_type"))


@query("optional_lookup", """
select i.instance_id, i.subnet_id, s.zone,
       case when i.subnet_id is not null and s.subnet_id is null then concat('unknown subnet_id: ', i.subnet_id) end as reason
from raw_instance i left join subnet_dim s on i.subnet_id = s.subnet_id""")
def optional_lookup(t: Inputs) -> DataFrame:
    rows = t.view("raw_instance").select("instance_id", "subnet_id")
    return _both(*lookups.optional_lookup(rows, t.view("subnet_dim"), "subnet_id"))


@query("ordered_lookup", """
select c.pos, c.subnet_id, s.zone, case when s.subnet_id is null then concat('unknown subnet_id: ', c.subnet_id) end as reason
from subnet_choice c left join subnet_dim s on c.subnet_id = s.subnet_id""")
def ordered_lookup(t: Inputs) -> DataFrame:
    return _both(*lookups.ordered_lookup(t.view("subnet_choice"), t.view("subnet_dim"), "subnet_id"))


_ASSEMBLED = """
tagged as (
  select cluster_id,
         max(case when tag_key = 'x:cluster_name' then tag_value end) as name,
         max(case when tag_key = 'x:cluster_docker_image' then tag_value end) as image,
         max(case when tag_key = 'x:worker_instance_type' then tag_value end) as worker_type,
         max(case when tag_key = 'x:subnet_id' then tag_value end) as subnet_id,
         max(case when tag_key = 'x:placement_group' then tag_value end) as placement_group,
         max(case when tag_key = 'x:cluster_ttl' then try_cast(split_part(tag_value, 'h', 1) as bigint) end) as ttl_hours,
         max(case when tag_key = 'x:cluster_idle_timeout' then try_cast(split_part(tag_value, 'm', 1) as bigint) end) as idle_minutes,
         max(case when tag_key = 'x:worker_bid_price' then cast(tag_value as decimal(18,4)) end) as bid_price
  from cluster_tags group by cluster_id),
master as (
  select * from (select cluster_id, instance_id as master_id, launched_at,
                        row_number() over (partition by cluster_id order by launched_at, instance_id) as rn
                 from instance_fact where role = 'Master') m where rn = 1),
assembled as (
  select t.*, m.master_id, m.launched_at from tagged t join master m on t.cluster_id = m.cluster_id
  where name is not null and image is not null and worker_type is not null and subnet_id is not null)"""


@query("assemble_clusters", f"""
with {_ASSEMBLED.strip()}
select a.*, (select count(*) from instance_fact i where i.cluster_id = a.cluster_id and i.role = 'Worker') + 1 as members
from assembled a""")
def assemble_clusters(t: Inputs) -> DataFrame:
    instances = t.view("instance_fact").select("cluster_id", "instance_id", "role", "launched_at")
    clusters, members = fleet.assemble_clusters(instances, t.view("cluster_tags"), PREFIX)
    return clusters.join(members.groupBy("cluster_id").agg(F.count("*").alias("members")), "cluster_id")


@query("snapshot_diff", """
select coalesce(p.id, c.id) as id,
       case when p.id is null then 'added' when c.id is null then 'removed' else 'retained' end as change
from snapshot_prev p full outer join snapshot_cur c on p.id = c.id""")
def snapshot_diff(t: Inputs) -> DataFrame:
    return fleet.snapshot_diff(t.view("snapshot_prev"), t.view("snapshot_cur"), "id")


POLL_DIFF = """
with pairs as (select poll_no, lag(poll_no) over (order by poll_no) as previous from (select distinct poll_no from poll) d)
select n.poll_no, n.id, 'added' as change from poll n join pairs on n.poll_no = pairs.poll_no
where previous is not null and n.id is not null
  and not exists (select 1 from poll p where p.id = n.id and p.poll_no = previous)
union all
select pairs.poll_no, p.id, 'removed' from poll p join pairs on p.poll_no = previous
where p.id is not null
  and not exists (select 1 from poll n where n.id = p.id and n.poll_no = pairs.poll_no)"""


@query("poll_diff", POLL_DIFF)
def poll_diff(t: Inputs) -> DataFrame:
    return fleet.poll_diff(t.view("poll"), "id", "poll_no")


@query("snapshot_apply", """
with led as (select cluster_id, max(case when role = 'Master' then 1 else 0 end) as led from fleet_cur group by cluster_id)
select c.id, c.cluster_id, c.role, c.state, coalesce(c.address, p.address) as address
from fleet_cur c join led on c.cluster_id = led.cluster_id and led.led = 1 left join fleet_prev p on c.id = p.id
union all
select p.id, p.cluster_id, p.role, p.state, p.address
from fleet_prev p join led on p.cluster_id = led.cluster_id and led.led = 0""")
def snapshot_apply(t: Inputs) -> DataFrame:
    return fleet.snapshot_apply(
        t.view("fleet_prev"), t.view("fleet_cur"), "id", sticky_cols=["address"], overwrite_cols=["state"],
        cluster_col="cluster_id", is_master=F.col("role") == "Master")


@query("owner_lookup", """
with owner as (select instance_id, max(cluster_id) as cluster_id from instance_fact group by instance_id)
select t.command_id, t.instance_id, o.cluster_id from command_target t left join owner o on t.instance_id = o.instance_id""")
def owner_lookup(t: Inputs) -> DataFrame:
    routed, unknown = lookups.owner_lookup(t.view("command_target"), t.view("instance_fact"), "instance_id")
    return routed.unionByName(unknown, allowMissingColumns=True)


@query("member_semi", """
select command_id, instance_id, status from command_invocation
where instance_id in (select instance_id from instance_fact where lifecycle = 'spot')""")
def member_semi(t: Inputs) -> DataFrame:
    spot = t.view("instance_fact").where("lifecycle = 'spot'")
    return lookups.member_semi(t.view("command_invocation"), spot, "instance_id")


@query("price_asof", """
select q.event_id, q.instance_type, q.zone, q.ts, coalesce(p.price, 0) as price
from price_probe q asof left join price_history p
  on q.instance_type = p.instance_type and q.zone = p.zone and q.ts >= p.ts""")
def price_asof(t: Inputs) -> DataFrame:
    return prices.price_asof(t.view("price_probe"), t.view("price_history"), ["instance_type", "zone"], "ts")


@query("request_outcome", """
select r.request_id,
       case kind when 'AddWorkers' then 'WorkerAdditionAttempt' when 'TerminateCluster' then 'ClusterTerminationAttempt'
            when 'TerminateWorker' then 'WorkerTerminationAttempt' when 'ChangeDockerImage' then 'DockerImageChangeAttempt'
            else 'ClusterLaunchAttempt' end as attempt,
       case kind
         when 'LaunchCluster' then case when tag_a = 'Name' then concat('Failed to launch cluster for spec ', spec,
                ': Invalid instance tags: Invalid tag key: Name, Invalid tag key: x:cluster_ttl') end
         when 'LaunchSpotCluster' then case when tag_a = 'Name' then concat('Failed to launch spot cluster with bid price ', bid_price, ' for spec ', spec,
                ': Invalid instance tags: Invalid tag key: Name, Invalid tag key: x:cluster_ttl') end
         when 'AddWorkers' then case
           when c.cluster_id is null then concat('Add workers: no cluster with id ', r.cluster_id)
           when c.master_state <> 'Running' then concat('Failed to add workers to cluster with id ', r.cluster_id,
                ': requirement failed: cluster master must be running to add workers')
           when r.worker_count <= 0 then concat('Failed to add workers to cluster with id ', r.cluster_id,
                ': requirement failed: worker count must be positive') end
         when 'ChangeDockerImage' then case
           when c.cluster_id is null then concat('Change docker image: no cluster with id ', r.cluster_id)
           when c.master_state <> 'Running' then concat('Failed to change Docker image of cluster with id ', r.cluster_id,
                ': requirement failed: cluster master must be running to change docker image')
           when r.cluster_id % 5 = 2 then concat('Failed to change Docker image of cluster with id ', r.cluster_id,
                ': requirement failed: docker image change is in progress') end
         when 'TerminateCluster' then case
           when c.cluster_id is null then concat('Terminate cluster: no cluster with id ', r.cluster_id)
           when c.master_state = 'Terminating' then concat('Failed to terminate cluster with id ', r.cluster_id,
                ': requirement failed: cluster is already terminating')
           when c.master_state = 'Terminated' then concat('Failed to terminate cluster with id ', r.cluster_id,
                ': requirement failed: cluster is already terminated') end
         when 'TerminateWorker' then case
           when w.instance_id is null then concat('Terminate worker: no worker with instance id ', r.instance_id)
           when w.state = 'Terminating' then concat('Failed to terminate worker with instance id ', r.instance_id,
                ': requirement failed: instance is already terminating') end
       end as error
from request_log r left join cluster_dim c on r.cluster_id = c.cluster_id
left join worker_dim w on r.instance_id = w.instance_id and w.state <> 'Terminated'""")
def request_outcome(t: Inputs) -> DataFrame:
    log = t.view("request_log").withColumn("extra_tags", F.create_map(F.coalesce("tag_a", F.lit("team")), F.lit("1"), F.coalesce("tag_b", F.lit("owner")), F.lit("2")))
    clusters = t.view("cluster_dim").withColumn("image_changing", F.col("cluster_id") % 5 == 2)
    return requests.request_outcome(log, clusters, t.view("worker_dim"))


@query("completion_barrier", """
with ended as (select command_id, count(*) as n from command_invocation
               where status in ('Success', 'Cancelled', 'Cancelling', 'Failed', 'TimedOut') group by command_id),
wanted as (select command_id, count(*) as n from command_target group by command_id)
select distinct t.command_id, t.instance_id from command_target t
join wanted w on t.command_id = w.command_id join ended e on t.command_id = e.command_id and w.n = e.n
where exists (select 1 from command_invocation i
              where i.command_id = t.command_id and i.instance_id = t.instance_id and i.status = 'Success')""")
def completion_barrier(t: Inputs) -> DataFrame:
    return lookups.completion_barrier(t.view("command_target"), t.view("command_invocation"))


# Aggregations


@query("group_members", """
select r.cluster_id, g.n, r.instance_id from raw_instance r
join (select cluster_id, count(*) as n from raw_instance where cluster_id is not null group by cluster_id) g
  on r.cluster_id = g.cluster_id""")
def group_members(t: Inputs) -> DataFrame:
    return fleet.group_members(t.view("raw_instance"), "cluster_id")


@query("cluster_capacity", """
select cluster_id, cores, memory_bytes, storage_bytes, hourly_price,
       cast(null as string) as instance_id, cast(null as bigint) as instance_type, cast(null as string) as reason from (
select c.cluster_id,
       cast(coalesce(sum(case when i.state = 'Running' then s.cores end), 0) as bigint) as cores,
       cast(coalesce(sum(case when i.state = 'Running' then s.memory_bytes end), 0) as bigint) as memory_bytes,
       cast(coalesce(sum(case when i.state = 'Running' then s.devices * s.bytes_per_device end), 0) as bigint) as storage_bytes,
       cast(coalesce(sum(s.hourly_price), 0) as decimal(38,4)) as hourly_price
from cluster_dim c
left join instance_fact i on c.cluster_id = i.cluster_id and i.role = 'Worker' and i.state <> 'Terminated'
left join spec_dim s on i.instance_type = s.instance_type
group by c.cluster_id) known
union all
select cluster_id, null, null, null, null, instance_id, instance_type, concat('unknown instance_type: ', instance_type)
from instance_fact where role = 'Worker' and state <> 'Terminated'
  and instance_type not in (select instance_type from spec_dim)""")
def cluster_capacity(t: Inputs) -> DataFrame:
    shown, rejects = totals.cluster_capacity(t.view("cluster_dim"), t.view("instance_fact"), t.view("spec_dim"))
    return _both(shown, rejects)


_FIRST_MASTER = """
master as (
  select * from (select cluster_id, instance_type, state, launched_at, terminated_at,
                        row_number() over (partition by cluster_id order by launched_at, instance_id) as rn
                 from instance_fact where role = 'Master') m where rn = 1)"""


@query("dashboard_totals", f"""
with {_FIRST_MASTER.strip()},
busy as (select cluster_id, count(*) as workers from instance_fact
         where role = 'Worker' and state = 'Running' and container_state = 'ContainerRunning' group by cluster_id)
select c.cluster_id, coalesce(b.workers, 0) as workers, cast(w.cores * coalesce(b.workers, 0) as bigint) as cores,
       cast(w.memory_bytes * coalesce(b.workers, 0) as double) / 1073741824 as memory_gib,
       cast(w.devices * w.bytes_per_device * coalesce(b.workers, 0) as double) / 1073741824 as storage_gib,
       cast(round(w.hourly_price * coalesce(b.workers, 0)
                  + case when m.state <> 'Terminated' then s.hourly_price else 0 end, 2) as decimal(38,2)) as cost_per_hour
from cluster_dim c left join busy b on c.cluster_id = b.cluster_id left join master m on c.cluster_id = m.cluster_id
left join spec_dim w on c.worker_type = w.instance_type left join spec_dim s on m.instance_type = s.instance_type""")
def dashboard_totals(t: Inputs) -> DataFrame:
    return totals.dashboard_totals(t.view("cluster_dim"), t.view("instance_fact"), t.view("spec_dim"))


@query("accrued_cost", f"""
with {_FIRST_MASTER.strip()},
worked as (select cluster_id, sum(date_sub('hour', launched_at, coalesce(terminated_at, timestamp '{NOW}')) + 1) as hours
           from instance_fact where role = 'Worker' group by cluster_id)
select c.cluster_id, cast(round(case when c.bid_price is null then
         case when k.hours is null then 0 else cast(k.hours as bigint) * w.hourly_price end
       + case when m.cluster_id is null then 0
              else (date_sub('hour', m.launched_at, coalesce(m.terminated_at, timestamp '{NOW}')) + 1) * s.hourly_price end
       end, 2) as decimal(38,2)) as cost
from cluster_spec c left join worked k on c.cluster_id = k.cluster_id left join master m on c.cluster_id = m.cluster_id
left join spec_dim w on c.worker_type = w.instance_type left join spec_dim s on m.instance_type = s.instance_type""")
def accrued_cost(t: Inputs) -> DataFrame:
    clusters = t.view("cluster_spec").withColumn("is_spot", F.col("bid_price").isNotNull())
    return totals.accrued_cost(clusters, t.view("instance_fact"), t.view("spec_dim"), NOW)


@query("last_activity", """
select c.cluster_id, coalesce(max(r.start_at + r.duration_ms * interval 1 millisecond), c.launched_at) as last_activity
from app_cluster c left join app_run r on c.cluster_id = r.cluster_id and not r.active
group by c.cluster_id, c.launched_at""")
def last_activity(t: Inputs) -> DataFrame:
    return totals.last_activity(t.view("app_cluster"), t.view("app_run"))


TIMEOUT = f"""
with activity as (
  select cluster_id, sum(case when active then 1 else 0 end) as active,
         max(case when not active then start_at + duration_ms * interval 1 millisecond end) as last_end
  from app_run group by cluster_id)
select c.cluster_id, case
    when c.master_address is null or c.master_state <> 'Running' or c.master_container <> 'ContainerRunning' then null
    when coalesce(a.active, 0) > 0 then null
    when timestamp '{NOW}' > c.launched_at + c.ttl_hours * interval 1 hour then 'TTLExpired'
    when timestamp '{NOW}' > coalesce(a.last_end, c.launched_at) + c.idle_minutes * interval 1 minute then 'IdleTimeout' end as verdict
from app_cluster c left join activity a on c.cluster_id = a.cluster_id"""


@query("timeout_verdict", TIMEOUT)
def timeout_verdict(t: Inputs) -> DataFrame:
    return totals.timeout_verdict(t.view("app_cluster"), t.view("app_run"), NOW)


@query("dedupe_last", """
select event_id, ts, instance_id, state, container_state, terminated_mark from (
  select *, row_number() over (partition by instance_id order by ts desc, event_id desc) as rn from state_history) h
where rn = 1""")
def dedupe_last(t: Inputs) -> DataFrame:
    return sets.dedupe_last(t.view("state_history"), "instance_id", ["ts", "event_id"])


@query("activity_count", """
select cluster_id, cast(sum(case when active then 1 else 0 end) as bigint) as active,
       sum(case when active then 1 else 0 end) = 0 as idle
from app_run group by cluster_id""")
def activity_count(t: Inputs) -> DataFrame:
    return totals.activity_count(t.view("app_run"), "cluster_id")


# Ordered computations


def _changes(prop: str, extra: str = "") -> str:
    return f"""
select instance_id, ts, event_id, '{prop}' as property, {prop} as value from (
  select *, lag({prop}) over w as before, row_number() over w as rn from shown window w as (partition by instance_id order by ts, event_id)) h
where (rn = 1 or {prop} is distinct from before){extra}"""


CHANGE_EVENTS = f"""
with shown as (
  select h.event_id, h.ts, h.instance_id, h.state, h.terminated_mark, m.effective_state
  from state_history h join {EFFECTIVE} m on h.state = m.state and h.container_state = m.container_state)
{_changes('state')} union all {_changes('effective_state')} union all
{_changes('terminated_mark', ' and terminated_mark is not null')}"""
CHANGE_PROPS = ["state", "effective_state", "terminated_mark"]


def shown_history(t: Inputs) -> DataFrame:
    return states.effective_state(t.view("state_history"), "state", "container_state")


@query("change_events", CHANGE_EVENTS)
def change_events(t: Inputs) -> DataFrame:
    return logs.change_events(
        shown_history(t), "instance_id", CHANGE_PROPS, ["ts", "event_id"], set_only=["terminated_mark"])


@query("message_number", """
select event_id, user_id % 4 as server, row_number() over (partition by user_id % 4 order by ts, event_id) as message_no from events""")
def message_number(t: Inputs) -> DataFrame:
    rows = t.table("events").select("event_id", "ts", (F.col("user_id") % 4).alias("server"))
    return logs.message_number(rows, "server", ["ts", "event_id"]).drop("ts")


SEQUENCE_GAPS = """
select server_id, message_no, prev_no, 'out of sequence' as gap from (
  select server_id, message_no, lag(message_no) over (partition by server_id order by message_no) as prev_no from gapped_log) l
where message_no <> prev_no + 1"""


@query("sequence_gaps", SEQUENCE_GAPS)
def sequence_gaps(t: Inputs) -> DataFrame:
    return logs.sequence_gaps(t.view("gapped_log").select("server_id", "message_no"), "server_id", "message_no").select(
        "server_id", "message_no", "prev_no", "gap")


CLIENT_GAPS = """
select client_id, event_id, server_id, message_no, prev_server, prev_no,
       case when prev_server <> server_id then 'server changed' else 'out of sequence' end as gap from (
  select *, lag(server_id) over w as prev_server, lag(message_no) over w as prev_no from client_log
  window w as (partition by client_id order by ts, event_id)) l
where prev_server <> server_id or message_no <> prev_no + 1"""


@query("client_sequence_gaps", CLIENT_GAPS)
def client_sequence_gaps(t: Inputs) -> DataFrame:
    log = t.view("client_log")
    return logs.sequence_gaps(
        log, "server_id", "message_no", ["client_id"], ["ts", "event_id"]).drop("ts")


def _alive(prop: str) -> str:
    return f"case when present and {prop}_at > since then {prop}_val end as {prop}"


_PROPS = {"state": "InstanceState", "container_state": "InstanceContainerState", "ip_address": "InstanceIpAddress",
          "subnet": "InstanceSubnet", "terminated_at": "InstanceTerminatedAt"}
_LAST = ",\n".join(
    f"max(no) filter (kind = '{k}') as {p}_at, arg_max(val, no) filter (kind = '{k}') as {p}_val" for p, k in _PROPS.items())
LATEST_STATE = f"""
with numbered as (select *, row_number() over (partition by entity_id order by ts, event_id) as no from fold_log),
folded as (
  select entity_id, arg_max(kind = 'WorkersAdded', no) filter (kind in ('WorkersAdded', 'WorkersRemoved')) as present,
         max(no) filter (kind = 'WorkersRemoved') as gone, {_LAST},
         max(no) filter (kind = 'DockerImageChangeAttempt' and error is null) as image_at,
         arg_max(val, no) filter (kind = 'DockerImageChangeAttempt' and error is null) as image_val,
         max(no) filter (kind = 'DockerImageChangeRequest' or (kind = 'DockerImageChangeAttempt' and error is null)) as changing_at,
         arg_max(kind = 'DockerImageChangeRequest', no)
           filter (kind = 'DockerImageChangeRequest' or (kind = 'DockerImageChangeAttempt' and error is null)) as changing_val
  from numbered group by entity_id),
known as (
  select f.*, (select min(no) from numbered n where n.entity_id = f.entity_id and n.kind = 'WorkersAdded'
               and (f.gone is null or n.no > f.gone)) as since from folded f)
select entity_id, present, {", ".join(_alive(p) for p in _PROPS)}, {_alive("image")},
       coalesce(present and changing_val and changing_at > since, false) as image_change_in_progress
from known where present is not null"""


@query("latest_state", LATEST_STATE)
def latest_state(t: Inputs) -> DataFrame:
    return logs.latest_state(t.view("fold_log"), "entity_id", ["ts", "event_id"])


COLLECT_FIRST = """
select entity_id, val as value, ts, event_id from (
  select *, row_number() over (partition by entity_id order by ts, event_id) as rn from message_log
  where kind = 'InstanceState' and val in ('v2', 'v3')) l where rn = 1"""


def first_wanted() -> tuple:
    return (F.col("kind") == "InstanceState") & F.col("val").isin("v2", "v3"), F.col("val")


@query("collect_first", COLLECT_FIRST)
def collect_first(t: Inputs) -> DataFrame:
    return logs.collect_first(t.view("message_log"), "entity_id", *first_wanted(), ["ts", "event_id"])


@query("find_first", """
select cluster_id, instance_id, instance_type, launched_at from (
  select *, row_number() over (partition by cluster_id order by launched_at, instance_id) as rn
  from instance_fact where role = 'Master') m where rn = 1""")
def find_first(t: Inputs) -> DataFrame:
    rows = t.view("instance_fact").select("cluster_id", "instance_id", "instance_type", "launched_at", "role")
    return sets.find_first(rows, "cluster_id", ["launched_at", "instance_id"], F.col("role") == "Master").drop("role")


@query("validate_transitions", """
select * from (
  select instance_id, ts, event_id, lag(state) over w as from_state, lag(container_state) over w as from_container,
         state as to_state, container_state as to_container
  from state_history window w as (partition by instance_id order by ts, event_id)) h
where from_state is not null and (from_state <> to_state or from_container <> to_container)
  and not (to_state = from_state and to_container = 'ContainerStopping')
  and (to_state, to_container) is distinct from case
    when from_container = 'ContainerStopping' then ('Running', 'ContainerStopped')
    when from_state = 'Running' and from_container = 'ContainerStopped' then ('Terminating', 'ContainerStopped')
    when from_state = 'Pending' then ('Starting', 'ContainerPending')
    when from_state = 'Starting' then ('Running', 'ContainerPending')
    when from_state = 'Running' and from_container = 'ContainerPending' then ('Running', 'ContainerStarting')
    when from_state = 'Running' and from_container = 'ContainerStarting' then ('Running', 'ContainerRunning')
    when from_state = 'Terminating' then ('Terminated', 'ContainerStopped')
    else (from_state, from_container) end""")
def validate_transitions(t: Inputs) -> DataFrame:
    return logs.validate_transitions(
        t.view("state_history"), "instance_id", ["state", "container_state"], allowed_transitions(t.spark), ["ts", "event_id"])


# Sorts, limits


@query("current_price", """
select s.instance_type, coalesce(p.price, 0) as price from spec_dim s
left join (select instance_type, arg_min(price, ts) as price from price_history group by instance_type) p
  on s.instance_type = p.instance_type""")
def current_price(t: Inputs) -> DataFrame:
    return prices.current_price(t.view("price_history"), ["instance_type"], keys=t.view("spec_dim"))


@query("rank_images", """
select image_id, repo, tag, try_cast(regexp_extract(tag, '^(?:.*-)?([0-9]+)[^-]*$', 1) as bigint) as build from (
  select image_id, split_part(image_ref, ':', 1) as repo, regexp_extract(image_ref, '^[^:]*:?(.*)$', 1) as tag from image_tags) i""")
def rank_images(t: Inputs) -> DataFrame:
    parsed = states.image_ref_parse(t.view("image_tags"), "image_ref").select("image_id", "repo", "tag")
    return prices.rank_images(parsed, "tag")


@query("rank_images_top", """
select tag, try_cast(regexp_extract(tag, '^(?:.*-)?([0-9]+)[^-]*$', 1) as bigint) as build from (
  select distinct regexp_extract(image_ref, '^[^:]*:?(.*)$', 1) as tag from image_tags) i
order by build desc nulls last, tag limit 10""")
def rank_images_top(t: Inputs) -> DataFrame:
    parsed = states.image_ref_parse(t.view("image_tags"), "image_ref").select("tag").distinct()
    return prices.rank_images(parsed, "tag", limit=10)


@query("default_choice", """
select arg_min(instance_type, instance_type) as master_type,
       arg_min(instance_type, instance_type) filter (is_spot_eligible) as worker_type,
       (select arg_min(subnet_id, pos) from subnet_choice) as subnet_id
from spec_dim""")
def default_choice(t: Inputs) -> DataFrame:
    return prices.default_choice(t.view("spec_dim"), ["instance_type"], t.view("subnet_choice"), ["pos"])


# Sets


@query("append_rows", "select id, state, address from snapshot_prev union all select id, state, address from snapshot_cur")
def append_rows(t: Inputs) -> DataFrame:
    return sets.append_rows(t.view("snapshot_prev"), t.view("snapshot_cur"))


@query("union_keep_left", """
select id, state, address from snapshot_prev
union all select id, state, address from snapshot_cur where id not in (select id from snapshot_prev)""")
def union_keep_left(t: Inputs) -> DataFrame:
    return sets.union_keep_left(t.view("snapshot_prev"), t.view("snapshot_cur"), "id")


@query("upsert", """
select id, state, address from snapshot_cur
union all select id, state, address from snapshot_prev where id not in (select id from snapshot_cur)""")
def upsert(t: Inputs) -> DataFrame:
    return sets.upsert(t.view("snapshot_prev"), t.view("snapshot_cur"), "id")


@query("upsert_partial", """
select coalesce(c.id, p.id) as id, coalesce(c.state, p.state) as state, coalesce(c.address, p.address) as address
from snapshot_prev p full outer join snapshot_cur c on p.id = c.id""")
def upsert_partial(t: Inputs) -> DataFrame:
    return sets.upsert(t.view("snapshot_prev"), t.view("snapshot_cur"), "id", partial=True)


@query("remove_ids", "select id, state, address from snapshot_prev where id not in (select id from snapshot_cur)")
def remove_ids(t: Inputs) -> DataFrame:
    return sets.remove_ids(t.view("snapshot_prev"), t.view("snapshot_cur"), "id")


@query("distinct_union", "select name from cluster_dim union select coalesce(name, '') from launch_request")
def distinct_union(t: Inputs) -> DataFrame:
    requested = t.view("launch_request").select(F.coalesce("name", F.lit("")).alias("name"))
    return sets.distinct_union(t.view("cluster_dim").select("name"), requested)
