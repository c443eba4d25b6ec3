"""A feed as a streaming source, and a sink that has each batch once."""

import pytest

from cairn.streaming import feeds as FD
from cairn.streaming import state as S

SCHEMA = "name string, seq long, value string"


def _messages(a, b):
    return [{"name": f"n{i % 3}", "seq": i, "value": f"v{i}"} for i in range(a, b)]


def _run(spark, root, **options):
    rows = S.gossip(FD.gossip_feed(spark, f"{root}/feed", files=2)).select("name", "seq", "value")
    q = FD.keep_batches(rows, f"{root}/kept", f"{root}/check", every="0 seconds", **options)
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def _kept(spark, root):
    return sorted(r["seq"] for r in FD.read_batches(spark, f"{root}/kept", SCHEMA).collect())


def test_messages_come_once_over_restarts(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "feed").mkdir()
    for k in range(5):
        FD.publish_messages(spark, f"{root}/feed", _messages(4 * k, 4 * k + 4))
    _run(spark, root)
    assert _kept(spark, root) == list(range(20))
    _run(spark, root)  # nothing new
    assert FD.publish_messages(spark, f"{root}/feed", ["torn {", *_messages(20, 22), {"seq": 1}]) == "000000000006.jsonl"
    (tmp_path / "feed" / ".000000000007.jsonl").write_text('{"name": "hidden", "seq": 99}\n')
    _run(spark, root)
    assert _kept(spark, root) == list(range(22))


def test_a_stream_killed_after_the_write_has_each_record_once(spark, tmp_path):
    """Files are written, the commit isn't, or the commit is and the checkpoint isn't: the batch comes again and counts once."""
    root = f"file://{tmp_path}"
    (tmp_path / "feed").mkdir()
    FD.publish_messages(spark, f"{root}/feed", _messages(0, 4))

    def dies(_):
        raise RuntimeError("killed before the commit")

    with pytest.raises(Exception, match="killed before"):
        _run(spark, root, written=dies)
    assert _kept(spark, root) == []
    _run(spark, root)
    assert _kept(spark, root) == [0, 1, 2, 3]
    FD.publish_messages(spark, f"{root}/feed", _messages(4, 9))
    _run(spark, root)
    # As if the process had died between the sink's commit and the stream's own: its last commit is gone.
    done = sorted((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    done[-1].unlink()
    for crc in (tmp_path / "check" / "commits").glob(".*.crc"):
        crc.unlink()
    _run(spark, root)
    assert _kept(spark, root) == list(range(9))
