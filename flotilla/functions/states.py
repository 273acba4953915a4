"""Instance and container states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The closed state names.
INSTANCE_STATES = ["Pending", "Starting", "Running", "Terminating", "Terminated"]
CONTAINER_STATES = ["ContainerPending", "ContainerStarting", "ContainerRunning", "ContainerStopping", "ContainerStopped"]
TERMINATION_REASONS = ["ClientRequested", "IdleTimeout", "TTLExpired"]
ROLES = ["Master", "Worker"]

# Container state (rows) as limited by instance state (columns).
EFFECTIVE_STATES = """
                    Pending  Starting  Running   Terminating  Terminated
ContainerPending    Pending  Pending   Pending   Stopping     Stopped
ContainerStarting   Pending  Starting  Starting  Stopping     Stopped
ContainerRunning    Pending  Starting  Running   Stopping     Stopped
ContainerStopping   Stopped  Stopping  Stopping  Stopping     Stopped
ContainerStopped    Stopped  Stopped   Stopped   Stopped      Stopped
"""

# Provider state name to instance state.
PROVIDER_STATES = {
    "pending": "Starting",
    "running": "Running",
    "shutting-down": "Terminating",
    "stopping": "Terminating",
    "terminated": "Terminated",
}

# Legal moves, first match wins, "any" matches every state.
TRANSITION_RULES = """
any          ContainerStopping  -> Running      ContainerStopped
Running      ContainerStopped   -> Terminating  ContainerStopped
Pending      any                -> Starting     ContainerPending
Starting     any                -> Running      ContainerPending
Running      ContainerPending   -> Running      ContainerStarting
Running      ContainerStarting  -> Running      ContainerRunning
Terminating  any                -> Terminated   ContainerStopped
"""

# Status colour of a running instance by container state.
STATUS_COLOURS = {"ContainerPending": "cyan", "ContainerStarting": "yellow", "ContainerRunning": "green"}


def effective_matrix() -> list[tuple[str, str, str]]:
    """``(container state, instance state, effective container state)``, 25 rows."""
    header, *lines = EFFECTIVE_STATES.strip("\n").splitlines()
    return [
        (line.split()[0], state, "Container" + cell)
        for line in lines
        for state, cell in zip(header.split(), line.split()[1:])
    ]


def effective_container_state(state: Column, container: Column) -> Column:
    """Container state limited by the instance state; null for a name outside either list."""
    bent: dict[tuple[str, str], list[str]] = {}
    for own, machine, result in effective_matrix():
        if own != result:
            bent.setdefault((machine, result), []).append(own)
    chain = F
    for (machine, result), owns in bent.items():
        chain = chain.when((state == machine) & container.isin(owns), result)
    return chain.when(container.isin(CONTAINER_STATES) & state.isin(INSTANCE_STATES), container)


def provider_state(col: Column) -> Column:
    """Instance state of a provider state name, null when the name has none."""
    chain = F
    for name, state in PROVIDER_STATES.items():
        chain = chain.when(col == name, state)
    return chain


def status_bucket(state: Column, container: Column) -> Column:
    """``red`` once terminated, a colour while running in a mapped container state, else ``busy``."""
    chain = F.when(state == "Terminated", "red")
    for name, colour in STATUS_COLOURS.items():
        chain = chain.when((state == "Running") & (container == name), colour)
    return chain.otherwise("busy")


def legal_moves() -> list[tuple[str, str, str, str]]:
    """``(from state, from container, to state, to container)`` for every start that moves.

    Includes the terminate request, which may put any container into stopping.
    """
    rules = [line.replace("->", " ").split() for line in TRANSITION_RULES.strip().splitlines()]
    moves = set()
    for state in INSTANCE_STATES:
        for container in CONTAINER_STATES:
            hit = next((r for r in rules if r[0] in ("any", state) and r[1] in ("any", container)), None)
            if hit:
                moves.add((state, container, hit[2], hit[3]))
            moves.add((state, container, state, "ContainerStopping"))
    return sorted(m for m in moves if m[:2] != m[2:])


def allowed_transitions(spark: SparkSession) -> DataFrame:
    """The legal moves as a table (at most 50 rows)."""
    return spark.createDataFrame(
        legal_moves(), "from_state string, from_container string, to_state string, to_container string")
