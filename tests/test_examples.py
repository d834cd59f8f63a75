from examples import bank_account, fs_snapshots, page_churn


def test_bank_account(spark):
    assert bank_account.main(spark) == {"booked": ["salary", "rent", "bicycle", "coffee", "refund"], "first": -5_50, "lowest": -8_70, "late": 3, "statement": (3, [3]), "balance": 11_30, "versions": (0, 2), "backlog": 1}


def test_snapshots_keep_the_backlog_short(spark):
    assert fs_snapshots.main(spark, commits=120, every=50) == {"nodes": 10, "files": 10, "bytes": sum(len(f"contents {i}") for i in range(110, 120)), "backlog": 40}


def test_page_churn(spark):
    rows = {r["phase"]: r["n"] for r in page_churn.main(spark, rounds=4, per_round=40)}
    assert rows == {"write": 4, "sync": 4, "checkpoint": 2, "open": 1}


def test_command_line(spark, tmp_path, capsys):
    from tidelog import cli
    from tidelog.operators.volume import Volume
    from tidelog.sources.store import EventStore

    v = Volume(EventStore(spark, str(tmp_path / "s")), "vol")
    v.write("/a/b", 0, b"xyz")
    v.commit()
    assert cli.main(["verify", str(tmp_path / "s"), "vol"]) == 0
    assert cli.main(["mirror", str(tmp_path / "s"), "vol", str(tmp_path / "out")]) == 0
    assert cli.main(["checkpoint", str(tmp_path / "s"), "vol"]) == 0
    assert cli.main(["streams", str(tmp_path / "s")]) == 0
    said = capsys.readouterr().out
    assert (tmp_path / "out/a/b").read_bytes() == b"xyz" and '"bytes": 3' in said and said.rstrip().endswith("vol")
