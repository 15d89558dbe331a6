"""mailtriage: mail triage as Spark jobs (see README.md)."""
from __future__ import annotations

import sys as _sys


def _ship_by_value() -> None:
    """Python functions that run on executors (the grace-timer state function, the sparse
    vector helper) are serialised with their code, so executors need no copy of this
    package on their path."""
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(_sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: ship the package with --py-files instead
        pass


_ship_by_value()
