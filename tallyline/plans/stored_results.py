"""Results that later runs look up: cost snapshots and finished job requests.

Both are tables of `sources/versions.py`, replaced by key and committed by manifest under
the name of the run: after a crash the run is repeated whole, after its commit it is
skipped, so no row is lost or stored twice. Of two runs at once the later one gets
`Conflict`; it repeats and then sees what the other has stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators import cost
from tallyline.operators import requests as work
from tallyline.sources.versions import VersionedTables

SNAPSHOTS, DONE = "cost_snapshots", "done_requests"


def store_snapshots(
    tables: VersionedTables,
    wanted: DataFrame,
    as_of: str,
    run: str,
    compute: Callable[[DataFrame], DataFrame] | None = None,
    force: bool = False,
) -> bool:
    """Compute and store the wanted snapshots (`REQUEST`, `cache_key`) that are stale; False if the run is done.

    A frozen period whose snapshot has the same cache key stays as it is. A new snapshot
    replaces the stored one of the same tenant and period. `compute` makes the rows to
    store from the stale ones; they keep `REQUEST` and `cache_key` and have the columns
    of the first run. With several wanted rows of one period all are stored.
    """
    if tables.has(run):
        return False
    stored = tables.read(SNAPSHOTS, wanted.select("cache_key").schema)
    stale = cost.stale_snapshots(wanted, stored, as_of, force)
    rows = (compute(stale) if compute else stale).withColumn("stored_by", F.lit(run))
    change = tables.change(run)
    change.replace(SNAPSHOTS, rows, cost.REQUEST)
    change.commit()
    return True


def finish_requests(
    tables: VersionedTables, requests: DataFrame, run: str, work_off: Callable[[DataFrame], None] | None = None
) -> bool:
    """Store the requests not done yet as done by this run, one per idempotency key; False if the run is done.

    `work_off` gets them, read from the rows to be committed, before they count as done:
    work lost in a crash is done again, work that counts is never repeated.
    """
    if tables.has(run):
        return False
    done = tables.read(DONE, requests.select("idempotency_key").schema)
    kept = work.dedupe_requests(requests, done).withColumn("done_by", F.lit(run))
    change = tables.change(run)
    written = change.replace(DONE, kept, ["idempotency_key"])
    if work_off:
        work_off(written)
    change.commit()
    return True
