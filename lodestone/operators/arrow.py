"""Arrow batches inside tasks."""

from __future__ import annotations

_ROWS = 512


def slices(batches, rows: int = _ROWS):
    """Cut batches into pieces of few rows, without copying: long texts make even a default batch large."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
