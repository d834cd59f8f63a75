"""Command line: mirror a volume once or continuously, checkpoint it, verify it, list streams.

python -m tidelog.cli mirror ROOT VOLUME DIR [--follow] [--interval-ms N]
python -m tidelog.cli checkpoint ROOT VOLUME
python -m tidelog.cli verify ROOT VOLUME
python -m tidelog.cli streams ROOT
python -m tidelog.cli churn ROOT VOLUME [--rounds N]

TIDELOG_ROOT and TIDELOG_POLL_MS give defaults for ROOT ("-") and the interval.
"""

from __future__ import annotations

import argparse
import json
import os
import time
from typing import TextIO

from tidelog.operators.volume import Mirror, Replica, Volume, verify
from tidelog.session import local_session
from tidelog.sources.store import EventStore, EventStoreReader


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tidelog", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["mirror", "checkpoint", "verify", "streams", "churn"])
    parser.add_argument("root")
    parser.add_argument("rest", nargs="*")
    parser.add_argument("--follow", action="store_true")
    parser.add_argument("--rounds", type=int, default=10)
    parser.add_argument("--interval-ms", type=int, default=int(os.environ.get("TIDELOG_POLL_MS", "2000")))
    return parser.parse_args(argv)


def churn(volume: Volume, rounds: int, files: int = 50) -> dict:
    """Rounds of writes, renames and removals, each committed, every third sealed; milliseconds by phase, and what a new mount finds."""
    spent: dict[str, float] = {}

    def timed(phase: str, f) -> object:
        t = time.perf_counter()
        out = f()
        spent[phase] = spent.get(phase, 0.0) + (time.perf_counter() - t) * 1000
        return out

    for i in range(rounds):
        for k in range(files):
            volume.write_file(f"/f{k}", f"round {i}, file {k}".encode())
        volume.mutate(op="rename", **{"from": f"/f{i % files}", "to": f"/kept{i}"})
        volume.mutate(op="remove", path=f"/f{(i + 1) % files}")
        timed("commit", volume.commit)
        if i % 3 == 2:
            timed("checkpoint", volume.checkpoint)
    again = timed("mount", lambda: Volume(volume.store, volume.name))
    return verify(again) | {"same": again.image.nodes == volume.image.nodes, "ms": {k: round(v, 1) for k, v in spent.items()}}


def main(argv: list[str] | None = None, out: TextIO | None = None) -> int:
    """out: where the answers go, standard output if it is not given."""
    args = arguments(argv)
    root = os.environ["TIDELOG_ROOT"] if args.root == "-" else args.root
    spark = local_session()
    if args.command == "streams":
        print("\n".join(EventStore(spark, root).list_streams()), file=out)
    elif args.command == "churn":
        print(json.dumps(churn(Volume(EventStore(spark, root), args.rest[0]), args.rounds)), file=out)
    elif args.command == "checkpoint":
        print(json.dumps(Volume(EventStore(spark, root), args.rest[0]).checkpoint()), file=out)
    elif args.command == "verify":
        print(json.dumps(verify(Replica(EventStoreReader(spark, root), args.rest[0]))), file=out)
    else:
        replica = Replica(EventStoreReader(spark, root), args.rest[0])
        mirror = Mirror(replica, args.rest[1])
        print(json.dumps(mirror.materialize()), file=out, flush=True)
        while args.follow:
            time.sleep(args.interval_ms / 1000)
            try:
                if replica.sync():
                    print(json.dumps(mirror.materialize()), file=out, flush=True)
            except Exception as e:
                print(f"sync failed, will retry: {e}", file=out, flush=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
