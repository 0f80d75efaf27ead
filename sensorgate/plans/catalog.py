"""All registered queries."""

from importlib import import_module
from pathlib import Path

from sensorgate.plans import common

for _file in sorted(Path(__file__).parent.glob("*.py")):
    if _file.stem not in ("__init__", "common", "catalog"):
        import_module(f"sensorgate.plans.{_file.stem}")


def queries():
    return dict(common.QUERIES)


def oracle_sql():
    return dict(common.ORACLES)
