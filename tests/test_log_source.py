"""Lines of growing files: each once, over batches and restarts."""

import random

from patchloom.streaming import log_source


def drained(frame, table, checkpoint):
    """Run until all is read; rows land in a memory table, batches are counted."""
    seen = []
    query = frame.writeStream.option("checkpointLocation", str(checkpoint)).foreachBatch(
        lambda df, n: seen.append([tuple(r) for r in df.collect()])).start()
    query.processAllAvailable()
    query.stop()
    table += [r for batch in seen for r in batch]
    return [b for b in seen if b]


def test_every_line_once_over_restarts(spark, tmp_path):
    rng = random.Random(4)
    logs, got, want, pending = tmp_path / "logs", [], [], {}
    (logs / "deep").mkdir(parents=True)
    names = ["a.log", "b.log", "deep/c.log"]
    for round_ in range(3):
        for name in names[: round_ + 1]:
            path = logs / name
            at = path.stat().st_size if path.exists() else 0
            text = pending.pop(name, "")
            with open(path, "a", newline="") as out:
                for k in range(rng.randint(1, 60)):
                    line = text + f"{name} {round_} {k} " + rng.choice(["", "é" * rng.randint(0, 300), "\x0b \x85"])
                    out.write(line[len(text) :] + rng.choice(["\n", "\r\n"]))
                    want.append((name, line))
                    text = ""
                if rng.random() < 0.7:
                    out.write("unfinished ")
                    pending[name] = "unfinished "
            assert path.stat().st_size > at
        (logs / "_hidden").write_text("no\n")
        frame = log_source.log_lines(spark, str(logs), str(tmp_path / "progress"), max_bytes=400, split_bytes=100)
        batches = drained(frame, got, tmp_path / "checkpoint")
        assert len(batches) > 1
        assert all(sum(len(r[2].encode()) + 1 for r in b) < 400 + 700 * len(names) for b in batches)
    assert sorted((f[len(str(logs)) + 1 :], line) for f, _, line in got) == sorted(want)
    assert len({(f, pos) for f, pos, _ in got}) == len(got)


def test_a_batch_that_failed_is_read_again(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "x.log").write_text("".join(f"{k}\n" for k in range(50)))
    frame = log_source.log_lines(spark, str(tmp_path / "logs"), str(tmp_path / "progress"), max_bytes=40)
    got = []

    def fail(df, n):
        rows = [int(r["line"]) for r in df.collect()]
        if n == 1:
            raise ValueError("lost")
        got.extend(rows)

    query = frame.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(fail).start()
    try:
        query.processAllAvailable()
    except Exception:
        pass
    query.stop()
    assert 0 < len(got) < 50
    again = log_source.log_lines(spark, str(tmp_path / "logs"), str(tmp_path / "progress"), max_bytes=40)
    query = again.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(
        lambda df, n: got.extend(int(r["line"]) for r in df.collect())).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(got) == list(range(50))


def test_lines_without_a_line_feed_wait(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "x.log").write_text("no end")
    got = []
    frame = lambda: log_source.log_lines(spark, str(tmp_path / "logs"), str(tmp_path / "p"))
    assert drained(frame(), got, tmp_path / "c") == []
    with open(tmp_path / "logs" / "x.log", "a") as out:
        out.write(" yet\n")
    drained(frame(), got, tmp_path / "c")
    assert [(r[1], r[2]) for r in got] == [(0, "no end yet")]
