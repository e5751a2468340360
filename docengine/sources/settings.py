"""Settings of a cluster and of its collections, as a mapping that a configuration file may hold."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields

from docengine.functions.versions import check_quorum
from docengine.operators.ring import REPLICATION, Ring


@dataclass(frozen=True)
class Settings:
    """What a Database goes by: copies and quorums, pages, when levels are compacted, and the members."""

    replication_factor: int = REPLICATION
    write_quorum: int = 2
    read_quorum: int = 2
    query_limit: int = 100
    query_offset: int = 0
    l0_file_num_threshold: int = 4
    level_size_multiplier: int = 10
    base_level_size_mb: int = 10
    compaction_seconds: int = 10
    nodes: tuple[tuple[str, str, int], ...] = ()

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name != "nodes" and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
                raise ValueError(f"{f.name} is a whole number from 0, not {value!r}")
        check_quorum(self.write_quorum, self.replication_factor)
        check_quorum(self.read_quorum, self.replication_factor)
        if len({n for n, *_ in self.nodes}) != len(self.nodes):
            raise ValueError("two nodes have one name")

    @classmethod
    def of(cls, config: Mapping) -> Settings:
        """From {"replication_factor": 3, "nodes": {"node1": {"host": "localhost", "port": 8081}}, ...}.

        Members of "cluster" count as written beside it; unknown names are errors.
        """
        flat = {k: v for k, v in config.items() if k != "cluster"} | dict(config.get("cluster") or {})
        known = {f.name for f in fields(cls)}
        if unknown := set(flat) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        nodes = tuple((name, str(n.get("host", "localhost")), int(n["port"])) for name, n in (flat.get("nodes") or {}).items())
        return cls(**{k: v for k, v in flat.items() if k != "nodes"}, nodes=nodes)

    @classmethod
    def read(cls, path: str) -> Settings:
        """From a file of the driver: JSON, or YAML where a reader of it is installed."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith(".json"):
            return cls.of(json.loads(text))
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("no reader of YAML is installed; write the settings as JSON") from e
        return cls.of(yaml.safe_load(text) or {})

    @classmethod
    def single(cls) -> Settings:
        """One node that holds one copy."""
        return cls(replication_factor=1, write_quorum=1, read_quorum=1)

    def ring(self, local: str | None = None) -> Ring:
        return Ring(tuple(n for n, *_ in self.nodes), self.replication_factor, {n: (host, port) for n, host, port in self.nodes}, local)
