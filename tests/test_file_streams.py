"""Streams of mails and journals: stopped, given more files, started again; nothing is lost or read twice."""

from email.message import EmailMessage

from folioscope.sources import files


def drained(rows, to, kind):
    """The sink after all files that are there have been read."""
    query = rows.writeStream.format("parquet").option("path", f"{to}/{kind}").option("checkpointLocation", f"{to}/{kind}-log").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return rows.sparkSession.read.parquet(f"{to}/{kind}")


def mail(folder, name, *attached):
    message = EmailMessage()
    message.set_content("body")
    for n in attached:
        message.add_attachment(f"text of {n}".encode(), maintype="text", subtype="plain", filename=n)
    (folder / name).write_bytes(message.as_bytes())


def test_mails_are_read_once_across_restarts(spark, tmp_path):
    inbox = tmp_path / "inbox"
    (inbox / "deep").mkdir(parents=True)
    mail(inbox, "a.eml", "one.txt", "two.md", "left.exe")
    mail(inbox / "deep", "b.eml", "three.txt")
    (inbox / "c.txt").write_text("no mail")
    attached = lambda: files.attachments(files.scan_stream(spark, str(inbox), "*.eml", 1)).select("name", "content")
    assert sorted(r.name for r in drained(attached(), tmp_path, "mail").collect()) == ["one.txt", "three.txt", "two.md"]
    mail(inbox, "d.eml", "four.txt")
    mail(inbox, "e.eml")
    for _ in range(2):  # the second time there is nothing new
        got = drained(attached(), tmp_path, "mail").collect()
        assert sorted((r.name, bytes(r.content).decode().strip()) for r in got) == [(n, f"text of {n}") for n in ("four.txt", "one.txt", "three.txt", "two.md")]


def test_journals_are_read_once_across_restarts(spark, tmp_path):
    path = f"{tmp_path}/journal"
    kind = "run long, event string"
    files.write_journal(spark.createDataFrame([(1, "start"), (1, "end")], kind), path)
    assert drained(files.journal_stream(spark, path, kind, 1), tmp_path, "rows").count() == 2
    files.write_journal(spark.createDataFrame([(2, "start"), (2, None)], kind), path)
    got = drained(files.journal_stream(spark, path, kind, 1), tmp_path, "rows").collect()
    assert sorted((r.run, r.event or "") for r in got) == [(1, "end"), (1, "start"), (2, ""), (2, "start")]
