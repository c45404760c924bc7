from tracewright.streaming import deploy


def lines(path, name, rows):
    (path / name).write_text("".join(f"Jan 12 {t} lab {x}\n" for t, x in rows))


def run(spark, frame, name):
    query = frame.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        query.processAllAvailable()
        query.processAllAvailable()  # the batch without rows that the watermark of the first one asks for
        return spark.table(name).collect()
    finally:
        query.stop()


def test_streams(spark, tmp_path):
    failed = [(f"10:00:{i:02d}", f"sshd[1]: Failed password for u{i} from 9.9.9.9 port 1 ssh2") for i in range(6)]
    lines(tmp_path, "a.log", [*failed, ("10:01:00", "sshd[1]: Accepted password for u1 from 9.9.9.9 port 1 ssh2"), ("10:02:00", "sudo: u1 : TTY=x ; USER=root ; COMMAND=/bin/id")])
    events = deploy.as_corr_events(deploy.auth_stream(spark, str(tmp_path), year=2026))
    assert [r.username for r in run(spark, deploy.login_then_sudo(events), "sudo")] == ["u1"]
    lines(tmp_path, "b.log", [("12:00:00", "sshd[1]: Failed password for z from 8.8.8.8 port 1 ssh2")])
    windows = run(spark, deploy.failure_windows(events, slide="10 minutes", late="1 minute"), "fails")
    assert [(r.fails, r.users) for r in windows] == [(6, 6)]
    sessions = run(spark, deploy.activity_sessions(events, late="1 minute"), "sessions")
    assert [(r.hostname, r.events) for r in sessions] == [("lab", 8)]
