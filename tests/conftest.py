import os
import sys
from datetime import datetime

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

EVENT_SCHEMA = ("event_id string, customer_id string, session_id string, "
                "timestamp timestamp_ntz, event_type string, device string, page_category string")
TXN_SCHEMA = ("transaction_id string, customer_id string, transaction_timestamp timestamp_ntz, "
              "amount double, payment_method string, status string")
CUSTOMER_SCHEMA = ("customer_id string, signup_date timestamp_ntz, country string, "
                   "device_category string, acquisition_channel string")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session
    session = local_session("*", 8, driver_memory="4g",
                            extra={"spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()


def at(clock: str, day: str = "2024-09-02") -> datetime:
    """A time of day; the test worlds happen on one day unless they name another."""
    return datetime.fromisoformat(f"{day}T{clock}")


def event(eid, cust, sess, when, etype, device="web", page="p"):
    return (eid, cust, sess, when, etype, device, page)


def event_log(spark, text):
    """An events frame from lines of ``session user device type time``; ``-`` is NULL."""
    out = []
    for n, line in enumerate(text.strip().splitlines()):
        session, user, device, kind, clock = (None if w == "-" else w for w in line.split())
        out.append(event(f"ev{n}", user, session, clock and at(clock), kind, device))
    return spark.createDataFrame(out, EVENT_SCHEMA)


def rows(df, *cols):
    """Collected rows as tuples of the given columns, in result order."""
    return [tuple(r[c] for c in cols) for r in df.collect()]


def by_key(df, key_cols, value_col):
    return {tuple(r[c] for c in key_cols) if len(key_cols) > 1 else r[key_cols[0]]: r[value_col]
            for r in df.collect()}
