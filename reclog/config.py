"""Settings of a store from strict JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

LARGEST = 4 << 20


@dataclass(frozen=True)
class Config:
    root: str
    node: str = "node"
    batch_records: int = 1024
    batch_bytes: int = 64 << 20
    record_bytes: int = 16 << 20
    read_records: int = 10_000
    read_bytes: int = 64 << 20
    compact_segments: int = 8
    compact_bytes: int = 64 << 20

    def __post_init__(self):
        if not self.root or not self.node:
            raise ValueError("root and node must be set")
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "int" and (isinstance(value, bool) or not isinstance(value, int) or value < 1):
                raise ValueError(f"{f.name} must be a positive number")


def parsed(text: str) -> Config:
    """A Config. Raises ValueError for other than one object, unknown or repeated fields, or more than 4 MiB."""
    if len(text.encode()) > LARGEST:
        raise ValueError("the configuration is too large")

    def once(pairs):
        if len(pairs) != len({k for k, _ in pairs}):
            raise ValueError("a field is there twice")
        return dict(pairs)

    found = json.loads(text, object_pairs_hook=once)
    unknown = set(found) - {f.name for f in fields(Config)} if isinstance(found, dict) else None
    if unknown is None or unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}" if unknown else "not an object")
    return Config(**found)
