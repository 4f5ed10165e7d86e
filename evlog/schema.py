"""Commands on a lock file: python -m evlog.schema diff|status|sync --lock FILE --schema FILE [--default A.E.F=JSON] [--force]

diff shows what has changed since the lock and ends with 1 if any of it is breaking; status tells in one line; sync writes the
lock of the next version. A schema file is JSON: {aggregate: {event: {field: type}}}. Without a lock file the first sync makes one.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from .model import SpecError
from .plans.schema_evo import Change, Lock


def line(change: Change) -> str:
    where = ".".join(x for x in (change.aggregate, change.event, change.field) if x)
    types = "" if change.field is None else f" ({change.before or '-'} -> {change.after or '-'})"
    return f"{'BREAKING' if change.breaking else 'ok'} {change.kind} {where}{types}"


def main(arguments: list[str] | None = None, say=print) -> int:
    parser = argparse.ArgumentParser(prog="evlog.schema")
    parser.add_argument("command", choices=["diff", "status", "sync"])
    parser.add_argument("--lock", required=True)
    parser.add_argument("--schema", required=True)
    parser.add_argument("--default", action="append", default=[], help="aggregate.event.field=JSON")
    parser.add_argument("--force", action="store_true")
    given = parser.parse_args(arguments)
    current = json.loads(Path(given.schema).read_text(encoding="utf-8"))
    lock = Lock.load(given.lock) if Path(given.lock).exists() else None
    changes = [] if lock is None else [c for own in lock.status(current).values() for c in own]
    if given.command == "diff":
        say("\n".join(map(line, changes)) or "no changes")
        return int(any(c.breaking for c in changes))
    if given.command == "status":
        breaking = sum(c.breaking for c in changes)
        say("no lock" if lock is None else f"version {lock.version}, {lock.hash()[:12]}: {len(changes)} changes, {breaking} of them breaking")
        return int(breaking > 0)
    defaults = {tuple(name.split(".", 2)): json.loads(value) for name, _, value in (d.partition("=") for d in given.default)}
    try:
        synced = Lock(1, current) if lock is None else lock.sync(current, defaults, given.force)
    except SpecError as e:
        say(e)
        return 1
    synced.save(given.lock)
    say(f"version {synced.version}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
