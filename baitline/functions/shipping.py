"""Sending this package's task code along with the tasks."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_with_tasks(module: str) -> None:
    """Serialise the module's functions by value.

    Executors then run them without having this package installed.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])
