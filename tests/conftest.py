from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyline.session import local_session  # noqa: E402

DATA = os.environ.get("TALLYLINE_TEST_DATA", "/root/testdata/sf0.001")
SCHEMA = (
    "tenant_id string, project_id string, event_id string, event_type string, timestamp timestamp, "
    "timestamp_text string, customer_id string, subscription_id string, invoice_id string, amount_cents bigint, "
    "currency string, plan_id string, period_start timestamp, period_end timestamp, ingest_seq bigint"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
T0 = datetime(2024, 1, 10, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffle_partitions=4)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


class Book:
    """Builds billing events one line at a time."""

    def __init__(self, tenant: str = "t1"):
        self.rows: list[dict] = []
        self.tenant = tenant

    def add(self, kind: str, second: float, sub: str | None = None, **more):
        seq = len(self.rows)
        row = dict.fromkeys(COLUMNS)
        row |= {
            "tenant_id": self.tenant,
            "project_id": "p1",
            "event_id": f"e{seq:03d}",
            "event_type": kind,
            "timestamp": at(second),
            "timestamp_text": at(second).strftime("%Y-%m-%dT%H:%M:%S.%fZ"),
            "customer_id": "c1",
            "subscription_id": sub,
            "currency": "USD",
            "ingest_seq": seq,
        }
        self.rows.append(row | more)
        return self

    def df(self, spark):
        return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in self.rows], SCHEMA)


START, END = "2024-01-01T00:00:00Z", "2024-01-31T23:59:59.999Z"
REF = "2024-02-20T00:00:00Z"


@pytest.fixture
def book():
    return Book()
