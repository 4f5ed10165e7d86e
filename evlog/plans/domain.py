"""Domain objects over streams: state by replay, and commands that turn a state into events."""

from __future__ import annotations

import json
import runpy
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SpecError
from ..sources.log import Append, BatchAppended, EventLog
from .folds import Fields, Fold, Machine, Resettable
from .projections import Projection


def field_of(name: str, kind: str = "string") -> str:
    """The SQL of a payload field."""
    text = f"get_json_object(data, '$.{name}')"
    return text if kind == "string" else f"try_cast({text} AS {kind})"


#: A counter that can be reset.
COUNTER = Resettable("stream_id", {"Incremented": field_of("amount", "double"), "Decremented": "-" + field_of("amount", "double")}, ("Reset",), "count")

#: A task and a user: each field is what the last event that sets it says.
TASK = Fields(
    "stream_id",
    {
        "title": {"TaskCreated": field_of("title"), "TaskTitleChanged": field_of("title")},
        "description": {"TaskCreated": field_of("description"), "TaskDescriptionChanged": field_of("description")},
        "completed": {"TaskCompleted": "true", "TaskReopened": "false"},
        "assignee_id": {"TaskAssigned": field_of("assigneeId"), "TaskUnassigned": "CAST(NULL AS STRING)"},
    },
    {"completed": False},
)
USER = Fields(
    "stream_id",
    {
        "name": {"UserCreated": field_of("name"), "UserNameChanged": field_of("name")},
        "email": {"UserCreated": field_of("email"), "UserEmailChanged": field_of("email")},
        "active": {"UserDeactivated": "false", "UserReactivated": "true"},
    },
    {"active": True},
)


def copied_fields(key: str, schema: dict[str, dict[str, str]]) -> Fields:
    """A fold in which every event sets the fields of its own names: {event: {field: type}}."""
    fields: dict[str, dict[str, str]] = {}
    for event, own in schema.items():
        for name, kind in own.items():
            fields.setdefault(name, {})[event] = field_of(name, {"number": "double", "boolean": "boolean"}.get(kind.removesuffix("?"), "string"))
    return Fields(key, fields)


# -- states of maps and sets


@dataclass(frozen=True)
class Put:
    """into[key] = value: names of payload fields; value None: the whole payload."""

    into: str
    key: str
    value: str | None = None


@dataclass(frozen=True)
class Drop:
    out_of: str
    key: str


@dataclass(frozen=True)
class Add:
    """Add a payload field to a set, or to the set under a key of a map of sets."""

    to: str
    value: str
    under: str | None = None


@dataclass(frozen=True)
class Move:
    """Move a key of a map, or all of them, to a set."""

    out_of: str
    to: str
    key: str | None = None


@dataclass(frozen=True)
class Set:
    """A field from the payload, or to a constant; merge: only the keys that the payload's object has."""

    name: str
    value: str | None = None
    to: object = None
    merge: bool = False
    first: bool = False  # only if nothing was set before


@dataclass(frozen=True)
class Count:
    name: str


def collections(key: str, rules: dict[str, list], zero: dict) -> Machine:
    """A general fold of maps, sets and fields from rules by event type. Sets are kept as sorted lists."""

    def step(state: dict, event: dict) -> dict:
        data = event["data"] or {}
        state = json.loads(json.dumps(state))
        for rule in rules.get(event["type"], []):
            if isinstance(rule, Put):
                state[rule.into][str(data.get(rule.key))] = data if rule.value is None else data.get(rule.value)
            elif isinstance(rule, Drop):
                state[rule.out_of].pop(str(data.get(rule.key)), None)
            elif isinstance(rule, Add):
                at = state if rule.under is None else state[rule.to]
                name = rule.to if rule.under is None else str(data.get(rule.under))
                at[name] = sorted({*at.get(name, []), data.get(rule.value)})
            elif isinstance(rule, Move):
                names = list(state[rule.out_of]) if rule.key is None else [str(data.get(rule.key))]
                gone = [n for n in names if state[rule.out_of].pop(n, None) is not None or rule.key is not None]
                state[rule.to] = sorted({*state[rule.to], *gone})
            elif isinstance(rule, Set):
                value = rule.to if rule.value is None else data.get(rule.value)
                if rule.merge:
                    state[rule.name] = {**(state.get(rule.name) or {}), **(value or {})}
                elif not (rule.first and state.get(rule.name) is not None):
                    state[rule.name] = value
            elif isinstance(rule, Count):
                state[rule.name] = state.get(rule.name, 0) + 1
            else:
                raise SpecError(f"no rule {rule!r}")
        return state

    return Machine(key, step, zero, tuple(rules))


#: An identity: who it is, its roles by organisation, its sessions and open challenges, and its lockout.
IDENTITY = collections(
    "stream_id",
    {
        "UserRegistered": [Set("user_id", "userId"), Set("email", "email"), Set("exists", to=True)],
        "SocialIdentityLinked": [Set("user_id", "userId", first=True), Set("email", "email", first=True), Set("exists", to=True), Put("social", "provider", "providerId")],
        "EmailVerified": [Set("email_verified", to=True)],
        "RoleAssigned": [Add("roles", "role", under="tenantId")],
        "MfaChallengeCreated": [Put("challenges", "id")],
        "MfaChallengeVerified": [Drop("challenges", "challengeId")],
        "SessionCreated": [Put("sessions", "sessionId")],
        "SessionRevoked": [Add("revoked", "sessionId")],
        "SessionRevokedByReuse": [Move("sessions", "revoked", "sessionId")],
        "AllSessionsRevoked": [Move("sessions", "revoked")],
        "LoginFailed": [Count("failed_logins")],
        "AccountLocked": [Set("locked_until", "lockedUntil")],
        "AccountUnlocked": [Set("locked_until", to=0), Set("failed_logins", to=0)],
        "PasswordChanged": [Set("locked_until", to=0), Set("failed_logins", to=0)],
    },
    {"user_id": None, "email": None, "exists": False, "email_verified": False, "social": {}, "roles": {}, "challenges": {}, "sessions": {}, "revoked": [], "failed_logins": 0, "locked_until": 0},
)

#: A tenant: its settings, open invitations and members.
TENANT = collections(
    "stream_id",
    {
        "TenantCreated": [Set("name", "name"), Set("exists", to=True)],
        "TenantSettingsChanged": [Set("settings", "settings", merge=True)],
        "MemberInvited": [Put("invites", "email", "role")],
        "InviteRevoked": [Drop("invites", "email")],
        "MemberJoined": [Drop("invites", "email"), Put("members", "userId", "role")],
        "MemberRemoved": [Drop("members", "userId")],
    },
    {"name": None, "exists": False, "settings": {}, "invites": {}, "members": {}},
)


# -- commands


@dataclass(frozen=True)
class Aggregate:
    """A kind of stream: the fold of its state, and decide(state, command) -> events, which raises to refuse."""

    name: str
    fold: object
    decide: Callable[[dict | None, dict], list[dict]]


def state_of(log: EventLog, aggregate: Aggregate, stream_id: str) -> tuple[dict | None, int]:
    """A stream's state and revision; None and -1 without events."""
    events = log.read_stream(stream_id)
    row = aggregate.fold.batch(events).first()
    return (None if row is None else row.asDict(recursive=True)), log.stream_revision(stream_id)


def handle(log: EventLog, aggregate: Aggregate, stream_id: str, command: dict, tenant_id: str = "default"):
    """Load, decide, append at the revision that was seen."""
    state, revision = state_of(log, aggregate, stream_id)
    events = aggregate.decide(state, command)
    return log.append(stream_id, events, revision, tenant_id) if events else None


def orchestrate(log: EventLog, steps: list[tuple[Aggregate, str, dict]], tenant_id: str = "default") -> BatchAppended:
    """Commands for several streams, decided on their states and appended as one: all or none."""
    parts = []
    for aggregate, stream_id, command in steps:
        state, revision = state_of(log, aggregate, stream_id)
        events = aggregate.decide(state, command)
        if events:
            parts.append(Append(stream_id, events, revision, tenant_id))
    return log.append_batch(parts)


def states_of_two(events: DataFrame, first: Fold, second: Fold, on: str, how: str = "left") -> DataFrame:
    """The states of one kind of streams beside those of another that they name: both folded at once, as wholes, and joined.
    on: the column of the first fold's states that holds the second's keys. Columns that both have are the first's."""
    one, two = first.batch(events), second.batch(events)
    key = second.keys[0]
    two = two.select(F.col(key).alias("_named"), *[c for c in two.columns if c != key and c not in one.columns])
    return one.join(two, one[on] == two["_named"], how).drop("_named")


def discover(folder: str, skipped: tuple[str, ...] = ("__init__.py",)) -> dict[str, object]:
    """The folds, projections and aggregates that the Python files below a folder define, by name. Files and folders whose
    names begin with a dot or an underscore, and installed packages, are left out; files are taken in order of their names."""
    found: dict[str, object] = {}
    for path in sorted(Path(folder).rglob("*.py")):
        parts = path.relative_to(folder).parts
        if path.name in skipped or any(p.startswith((".", "_")) or p in ("site-packages", "node_modules") for p in parts):
            continue
        for name, value in runpy.run_path(str(path)).items():
            if isinstance(value, (Fold, Aggregate, Projection)) and not name.startswith("_"):
                if name in found:
                    raise SpecError(f"{name} is defined twice")
                found[name] = value
    return found


def lookup(log: EventLog, kind: str, value: str, field: str = "userId") -> str | None:
    """A secondary index kept as one-event streams: what the first event of lookup-<kind>-<value> says."""
    row = log.read_stream(f"lookup-{kind}-{value}", limit=1).first()
    return None if row is None else json.loads(row.data).get(field)
