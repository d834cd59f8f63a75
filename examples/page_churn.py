"""Churn of a replicated database: rounds of upserts, syncs and checkpoints, timed by phase; the restored file equals the live one."""

from __future__ import annotations

import os
import random
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidelog.functions import pages
from tidelog.operators.database import Database, logical_rows
from tidelog.sources.store import EventStore


def main(spark, rounds: int = 4, per_round: int = 200, notes: int = 400, seal_every: int = 2, seed: int = 5) -> list[tuple]:
    samples, draw = [], random.Random(seed)

    def phase(name: str, f) -> None:
        t = time.perf_counter()
        f()
        samples.append((name, (time.perf_counter() - t) * 1000))

    with tempfile.TemporaryDirectory() as d:
        store = EventStore(spark, f"{d}/store")
        db = Database(store, "churn", f"{d}/live.db")
        db.connection.execute("create table note(id integer primary key, words text)")

        def edit() -> None:
            """One transaction an edit: a note gets new words, some notes go."""
            for _ in range(per_round):
                at = draw.randrange(notes)
                if draw.random() < 0.1:
                    db.connection.execute("delete from note where id = ?", (at,))
                else:
                    db.connection.execute("replace into note values (?, ?)", (at, " ".join(draw.choices(["tide", "log", "page", "frame"], k=40))))

        for i in range(rounds):
            phase("write", edit)
            phase("sync", db.sync)
            if (i + 1) % seal_every == 0:
                phase("checkpoint", lambda: db.checkpoint(coalesce_at=3, purge=True))
        want = logical_rows(f"{d}/live.db")
        db.close()
        phase("open", lambda: Database(store, "churn", f"{d}/fresh.db").close())
        assert logical_rows(f"{d}/fresh.db") == want
    return pages.report(spark.createDataFrame(samples, "phase string, ms double")).orderBy("phase").collect()


if __name__ == "__main__":
    from tidelog.session import local_session

    for row in main(local_session()):
        print(row)
