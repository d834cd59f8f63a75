"""A current account as a stream: entries booked together, a booking that comes too late, statements as snapshots, and a follower that prints what is booked."""

from __future__ import annotations

import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F

from tidelog.schema import NO_STREAM, NewEvent, VersionConflict, exact
from tidelog.sources.store import EventStore
from tidelog.streaming.follow import drain, follow_compactions, follow_streams


def entry(amount: int, memo: str) -> NewEvent:
    """An amount in pence, negative if it leaves the account."""
    return NewEvent.json("entry", {"amount": amount, "memo": memo})


class Statement:
    """Balance, and the lowest it has been."""

    def __init__(self, balance: int = 0, lowest: int = 0):
        self.balance, self.lowest = balance, lowest

    def apply(self, event) -> None:
        self.balance += json.loads(bytes(event["data"]))["amount"]
        self.lowest = min(self.lowest, self.balance)

    def snapshot(self) -> bytes:
        return f"{self.balance} {self.lowest}".encode()

    @classmethod
    def restore(cls, data: bytes) -> Statement:
        return cls(*map(int, data.split()))


def main(spark) -> dict:
    store, iban = EventStore.open_in_memory(spark), "GB-0001"
    info = store.append(iban, NO_STREAM, [entry(120_00, "salary"), entry(-45_50, "rent"), entry(-80_00, "bicycle")])
    first, version = store.rehydrate(Statement, iban)
    late = None
    store.append(iban, exact(version), [entry(-3_20, "coffee")])
    try:
        store.append(iban, exact(version), [entry(-999_00, "a booking made from an old view")])
    except VersionConflict as e:
        late = e.actual
    statement = store.compact(Statement, iban)
    store.append(iban, exact(3), [entry(20_00, "refund")])
    last, _ = store.rehydrate(Statement, iban)

    booked, announced = [], []
    with tempfile.TemporaryDirectory() as d:
        memo = F.get_json_object(F.col("data").cast("string"), "$.memo")
        drain(follow_streams(spark, store.log.root, [iban]), f"{d}/a", lambda df, _: booked.extend(r[0] for r in df.orderBy("version").select(memo).collect()))
        drain(follow_compactions(spark, store.log.root), f"{d}/b", lambda df, _: announced.extend(r["through_version"] for r in df.collect()))
    return {"booked": booked, "first": first.balance, "lowest": last.lowest, "late": late, "statement": (statement["through_version"], announced), "balance": last.balance, "versions": (info.first_version, info.last_version), "backlog": store.compaction_backlog(iban)}


if __name__ == "__main__":
    from tidelog.session import local_session

    print(json.dumps(main(local_session()), indent=1))
