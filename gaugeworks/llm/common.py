"""What the operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import exists, shared_folder, written  # noqa: F401  used by the operators

#: Stands for a null doc_id wherever ids are ordered: smaller than any other.
NO_ID = -(2**63)

#: `[\x20\x09-\x0D]`, the white space of the contracts.
SPACES = " \t\n\x0b\x0c\r"


def ordered_id(column: str = "doc_id") -> Column:
    """The id as a long for ordering; a null id comes first."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


_STATE: dict[str, Any] = {}


def worker_state(token: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks, made once; only the last operator's is kept."""
    if token not in _STATE:
        forget_state()
        _STATE[token] = make()
    return _STATE[token]


def forget_state() -> None:
    """Frees what another operator's tasks have left in this Python worker."""
    if _STATE:
        _STATE.clear()
        gc.enable()
        gc.collect()


def slices(batch, rows: int = 512):
    """A record batch in parts, so that Python copies of a part only are held at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
