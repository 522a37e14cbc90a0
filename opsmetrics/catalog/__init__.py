"""All registered queries. Importing this package fills the registry."""

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ["scans", "predicates", "joins", "aggregates", "windows", "ranking", "sets", "scalars",
           "streams", "changes", "counters", "blocking", "workload", "storage", "indexes",
           "backups", "jobs", "replication", "security", "events"]

for _name in MODULES:
    import_module(f".{_name}", __name__)

__all__ = ["ORACLES", "QUERIES"]
