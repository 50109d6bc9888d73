"""The stream of transcripts: every line once, after restarts, with lines half written and files that are replaced."""

import json

import pytest

from tracelake.sources import hooks, transcripts


@pytest.fixture
def run(spark, tmp_path):
    folder, n = tmp_path / "in", 0
    folder.mkdir()

    def go() -> list[tuple]:
        """One query over what is there, from the checkpoint of the one before; the rows of all so far."""
        q = transcripts.stream(spark, str(folder)).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        q.awaitTermination()
        return sorted((r.session_id, r.line, r.value) for r in spark.read.schema(transcripts.LINES).parquet(str(tmp_path / "out")).collect())

    return folder, go


def test_every_line_once(run):
    folder, go = run
    (folder / "a.jsonl").write_text("one\ntwo\nthr")
    (folder / "b.jsonl").write_text("é\n")
    (folder / "other.txt").write_text("no\n")
    first = [("a", 0, "one"), ("a", 4, "two"), ("b", 0, "é")]
    assert go() == first
    assert go() == first
    with (folder / "a.jsonl").open("a") as f:
        f.write("ee\n\nfive\n")
    (folder / "sub").mkdir()
    (folder / "sub" / "c.jsonl").write_text("new\n")
    more = sorted([*first, ("a", 8, "three"), ("a", 14, ""), ("a", 15, "five"), ("c", 0, "new")])
    assert go() == more
    # Shorter than before: another file.
    (folder / "a.jsonl").write_text("uno\n")
    assert go() == sorted([*more, ("a", 0, "uno")])
    (folder / "b.jsonl").unlink()
    assert go() == sorted([*more, ("a", 0, "uno")])


@pytest.mark.parametrize("share,block", [(1, 3), (5, 2), (7, 64), (1000, 1)])
def test_parts_share_lines(tmp_path, monkeypatch, share, block):
    monkeypatch.setattr(transcripts, "SHARE", share)
    monkeypatch.setattr(transcripts, "BLOCK", block)
    lines = ["", "a", "bb", "é" * 9, "", "x y z", "0123456789" * 3, "end"]
    text = "".join(x + "\n" for x in lines).encode()
    (tmp_path / "s.jsonl").write_bytes(text + b"half a li")
    reader = transcripts.Reader(f"file://{tmp_path}")
    end = reader.latestOffset()
    assert list(end.values()) == [len(text)]
    for begin in (0, 1, 3, len(text)):
        start = {next(iter(end)): begin}
        got = [(p, v) for part in reader.partitions(start, end) for b in reader.read(part) for p, v in zip(b.column("line").to_pylist(), b.column("value").to_pylist())]
        at, want = 0, []
        for x in lines:
            want += [(at, x)] if at >= begin else []
            at += len(x.encode()) + 1
        assert got == want


def test_thoughts_of_a_stream(run, spark, tmp_path):
    folder, go = run
    say = lambda x: json.dumps({"type": "assistant", "message": {"content": [{"type": "thinking", "thinking": x}]}}) + "\n"
    (folder / "s.jsonl").write_text(say("first") + say("first") + "broken\n")
    go()
    with (folder / "s.jsonl").open("a") as f:
        f.write(say("second"))
    go()
    lines = spark.read.schema(transcripts.LINES).parquet(str(tmp_path / "out"))
    assert sorted(r.content for r in hooks.transcript(lines, from_line=-1).collect()) == ["first", "second"]
