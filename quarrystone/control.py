"""The control protocol: one request of JSON a line, one response of JSON a line."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

# The requests' names and fields; True marks those that must be given.
REQUESTS: dict[str, dict[str, bool]] = {
    "snapshot_create": {"name": True},
    "snapshot_list": {},
    "snapshot_delete": {"name": True},
    "vault_create": {"password": True, "key_path": False},
    "vault_unlock": {"password": True, "key_file": True},
    "vault_lock": {},
    "stats": {},
}


@dataclass(frozen=True)
class Response:
    ok: bool
    names: list[str] = field(default_factory=list)
    message: str = ""
    error: str = ""


def parse(line: str) -> tuple[str, dict[str, str]]:
    """The operation and its fields; fields that it doesn't know are ignored."""
    try:
        given = json.loads(line)
    except json.JSONDecodeError as e:
        raise ValueError(f"invalid control request: {e}") from None
    op = given.get("op") if isinstance(given, dict) else None
    if not isinstance(op, str) or op not in REQUESTS:
        raise ValueError(f"invalid control request: no operation {op!r}")
    fields = {k: given[k] for k in REQUESTS[op] if given.get(k) is not None}
    for k, needed in REQUESTS[op].items():
        if (needed and k not in fields) or not isinstance(fields.get(k, ""), str):
            raise ValueError(f"invalid control request: {op} needs {k} as a string")
    return op, fields


class Control:
    """Calls the operations by name; one returns names (a list), a message (a string) or nothing, and its error becomes the response's."""

    def __init__(self, operations: dict[str, Callable[..., list[str] | str | None]]):
        unknown = operations.keys() - REQUESTS.keys()
        if unknown:
            raise ValueError(f"no such operations: {sorted(unknown)}")
        self.operations = operations

    def handle(self, line: str) -> str:
        try:
            op, fields = parse(line)
            if op not in self.operations:
                raise NotImplementedError(f"{op} isn't offered here")
            got = self.operations[op](**fields)
            out = Response(True, names=got) if isinstance(got, list) else Response(True, message=got or "")
        except Exception as e:  # any failure is the client's answer
            out = Response(False, error=str(e))
        return json.dumps(asdict(out))

    def serve(self, lines: Iterable[str]) -> Iterable[str]:
        """Responses in the order of the requests; empty lines have none."""
        return (self.handle(line) for line in lines if line.strip())
