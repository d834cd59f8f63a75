"""A volume with many commits over few paths, sealed now and then: a mount reads segments and the short backlog after them."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidelog.operators.volume import Volume, verify
from tidelog.sources.store import EventStore


def main(spark, commits: int = 1000, every: int = 250, paths: int = 10) -> dict:
    store = EventStore.open_in_memory(spark)
    volume = Volume(store, "vol")
    for i in range(commits):
        volume.write_file(f"/file-{i % paths}", f"contents {i}".encode())
        volume.commit()
        if (i + 1) % every == 0 and i + 1 < commits:
            volume.checkpoint()
    again = Volume(store, "vol")
    assert again.read_file("/file-0") == f"contents {commits - paths}".encode()
    return verify(again) | {"backlog": store.compaction_backlog("vol")}


if __name__ == "__main__":
    from tidelog.session import local_session

    print(main(local_session()))
