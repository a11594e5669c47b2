"""Versions of a table: JSON manifests, each put once, and which concurrent changes go together.

A manifest lists the schema, fragments (one Parquet file each), deletion files, patches, indexes, settings
and the transaction that made it.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from brindle.sources.store import Exists, Store


class CommitConflict(RuntimeError):
    """A concurrent commit can't go together with this change."""


class RetryableConflict(CommitConflict):
    """A concurrent commit touched what this change read; doing it again on the latest version may succeed."""


@dataclass
class Fragment:
    id: int
    file: str
    rows: int
    schema: int  # index into Manifest.schemas, as the file is written
    version: int = 0  # that added it
    first_row_id: int | None = None
    deleted: int = 0
    bytes: int = 0

    @property
    def live(self) -> int:
        return self.rows - self.deleted


@dataclass
class Manifest:
    version: int
    fields: list[dict]  # id, name, type (JSON), nullable, column (its name in files), metadata
    schemas: list[list[dict]] = field(default_factory=list)  # of files: id, column and type of their fields
    fragments: list[Fragment] = field(default_factory=list)
    deletions: list[dict] = field(default_factory=list)  # path of (addr), rows
    patches: list[dict] = field(default_factory=list)  # path, fields, rows
    indexes: list[dict] = field(default_factory=list)
    next_fragment: int = 0
    next_field: int = 0
    next_row_id: int | None = None  # None: row ids are addresses
    config: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)
    transaction: dict = field(default_factory=dict)
    timestamp: float = 0.0

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> "Manifest":
        raw = json.loads(text)
        return cls(**raw | {"fragments": [Fragment(**f) for f in raw["fragments"]]})

    @property
    def rows(self) -> int:
        return sum(f.live for f in self.fragments)


#: What a concurrent commit means for ours: C compatible, R retry on the latest version, I incompatible,
#: F retry if both touch a fragment, else compatible. Rows: our operation; fixed values.
_THEIRS = "Append Delete Update Rewrite Merge Project CreateIndex Overwrite Restore UpdateConfig Reserve DataReplacement DataOverlay UpdateBases".split()
_VERDICTS = {
    "Append": "CCCCCCCIICCCCC",
    "Delete": "CFFFRCCIICCFCC",
    "Update": "CFFFRCCIICCFFC",
    "Rewrite": "CFFFRCFIICCFFC",
    "Merge": "RRRRRICIICCRRC",
    "Project": "CCCCRRCIICCCCC",
    "CreateIndex": "CCCFCCNIICCRCC",
    "Overwrite": "CCCCCCCRCCCCCC",
    "Restore": "CCCCCCCCCCCCCC",
    "UpdateConfig": "CCCCCCCICKCCCC",
    "DataReplacement": "CFFFRRRIICCFCC",
    "DataOverlay": "CFFFRRCIICCCCC",
}


def verdict(ours: dict, theirs: dict) -> str:
    """C, R or I for two transactions (operation, fragments, keys)."""
    if theirs["operation"] == "Clone":
        return "C"
    row = _VERDICTS.get(ours["operation"])
    if row is None or theirs["operation"] not in _THEIRS:
        return "R"
    v = row[_THEIRS.index(theirs["operation"])]
    if v == "F":
        if ours["operation"] == "Update" and theirs["operation"] == "DataOverlay" and not ours.get("added"):
            return "C"
        return "R" if set(ours.get("fragments", ())) & set(theirs.get("fragments", ())) else "C"
    if v == "N":
        return "R" if set(ours.get("keys", ())) & set(theirs.get("keys", ())) else "C"
    if v == "K":
        return "I" if set(ours.get("keys", ())) & set(theirs.get("keys", ())) else "C"
    return v


class Log:
    """Manifests of one branch of a table."""

    ATTEMPTS = 20

    def __init__(self, store: Store, branch: str | None = None):
        self.store, self.branch = store, branch
        self.extra: dict[str, str] = {}  # config that each commit sets along with its change
        self.folder = f"tree/{branch}/_versions" if branch else "_versions"

    def _name(self, version: int) -> str:
        return f"{self.folder}/{version:020d}.json"

    def versions(self) -> list[int]:
        names = (p.rpartition("/")[2] for p, n, _ in self.store.list(self.folder) if n)
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no table at {self.store.root}" + (f", branch {self.branch}" if self.branch else ""))
        return found[-1]

    def read(self, version: int) -> Manifest:
        if not self.store.exists(self._name(version)):
            raise FileNotFoundError(f"version {version} of {self.store.root} doesn't exist")
        return Manifest.loads(self.store.read(self._name(version)))

    def commit(self, base: Manifest | None, operation: dict, change) -> Manifest:
        """Put the next version: change(latest manifest, its number) on top of whatever has been committed since.

        operation: operation, fragments touched, keys set. Concurrent commits since base are judged one by one.
        """
        operation = operation | {"uuid": uuid.uuid4().hex, "read_version": base.version if base else 0}
        seen = base.version if base else 0
        latest = base
        for attempt in range(self.ATTEMPTS):
            for v in [v for v in self.versions() if v > seen]:
                latest = self.read(v)
                found = verdict(operation, latest.transaction) if base else "I"
                if found != "C":
                    kind = RetryableConflict if found == "R" else CommitConflict
                    raise kind(f"{operation['operation']} of version {operation['read_version']} conflicts with {latest.transaction['operation']} of version {v}")
                seen = v
            number = seen + 1
            made = change(Manifest.loads(latest.dumps()) if latest else None, number)
            made.config = made.config | self.extra
            made.version, made.transaction, made.timestamp = number, operation, time.time()
            try:
                self.store.put_new(self._name(number), made.dumps())
                return made
            except Exists:
                time.sleep(min(1.0, 0.01 * 2**attempt))
        raise RetryableConflict(f"{self.ATTEMPTS} attempts to commit failed")
