import pytest
from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.operators import reports
from threadloom.operators.store import KnowledgeBase, mail_rows
from threadloom.sources import archives, commits, contexts, pages
from threadloom.streaming import collect

MAIL = "subject string, `from` string, date string, body string, message_id string, in_reply_to string, `references` array<string>, source_url string, input_pos bigint"


def mail(spark, *rows):
    return spark.createDataFrame([(s, f, "2024-01-01", b, m, r, refs, "", k) for k, (s, f, b, m, r, refs) in enumerate(rows)], MAIL)


@pytest.fixture
def kb(spark, tmp_path):
    return KnowledgeBase(spark, f"file://{tmp_path}/kb")


def test_mails(spark, kb):
    first = mail(spark, ("a", "A One <a@x>", "b", " <1@x> ", "", ["<0@x>", "<z@x>"]), ("b", "x", "b", "  ", "", []), ("c", "x", "b", "<1@x>", "", []))
    assert kb.insert_emails(mail_rows(first, "all", 5.0)) == (1, 1)
    assert kb.insert_emails(mail_rows(first, "all", 6.0)) == (0, 2)
    row = kb.read("emails").first()
    assert (row["id"], row["message_id"], row["from_name"], row["from_email"], row["refs"], row["created_at"]) == (1, "<1@x>", "A One", "A One <a@x>", "<0@x> <z@x>", 5.0)
    assert kb.sql("select count(*) n from emails").first()["n"] == 1
    with pytest.raises(ValueError, match="read"):
        kb.sql("drop table emails")


def test_threads(spark, kb):
    make = lambda *rows: spark.createDataFrame(rows, "id string, subject string, start_date string, email_count bigint, participant_count bigint, created_at double")
    kb.upsert_threads(make(("t", "s", "d1", 1, 1, 1.0)))
    kb.upsert_threads(make(("t", "new", "d2", 5, 2, 2.0), ("u", "x", "d3", 1, 1, 2.0)))
    got = {r["id"]: (r["subject"], r["start_date"], r["email_count"]) for r in kb.read("threads").collect()}
    assert got == {"t": ("new", "d1", 5), "u": ("x", "d3", 1)}
    kb.set_hidden(spark.createDataFrame([("u",)], "id string"))
    fields = {c: "v" for c in ("summary_zh", "key_points", "consensus", "design_decisions", "related_files", "related_functions", "tags")}
    kb.update_summaries(spark.createDataFrame([("t", *fields.values())], ", ".join(["id string", *[f"{c} string" for c in fields]])))
    got = {r["id"]: (r["hidden"], r["processed"], r["summary_zh"]) for r in kb.read("threads").collect()}
    assert got["u"][0] == 1
    assert got["t"][1:] == (1, "v")


def test_topics_reports_cache(spark, kb):
    topic = lambda *r: spark.createDataFrame([r], "name string, display_name string, description string, keywords string, created_at double")
    kb.upsert_topics(topic("n", "N", "d", "[]", 1.0))
    kb.upsert_topics(topic("n", "M", "", "", 2.0))
    assert tuple(kb.read("topics").select("id", "display_name", "description").first()) == (1, "M", "d")
    kb.link_topics(spark.createDataFrame([("t", 1, 0.1, 1.0), ("t", 1, 0.9, 2.0)], schemas.LINKS))
    assert [r["confidence"] for r in kb.read("thread_topics").collect()] == [0.9]
    assert kb.insert_report("t", "c", ["a"], "summary", 1.0) == 1
    kb.put_cache(spark.createDataFrame([("k", "b", "old", 1.0)], "cache_key string, backend string, translated string, created_at double"))
    kb.put_cache(spark.createDataFrame([("k", "b", "new", 2.0)], "cache_key string, backend string, translated string, created_at double"))
    assert tuple(kb.read("cache").select("translated", "access_count").first()) == ("new", 1)
    kb.clear_cache("b")
    assert kb.read("cache").count() == 0


def test_repair(spark, kb, emails, threads):
    kb.write("emails", emails([{"id": 1, "message_id": "m", "thread_id": "real"}, {"id": 2, "message_id": "dup", "thread_id": "has"}, {"id": 3, "message_id": "x", "thread_id": "made", "date": "d", "from_email": "f"}]))
    kb.write("threads", threads([{"id": k, "root_message_id": r, "hidden": 0, "created_at": 1.0} for k, r in (("m", ""), ("dup", ""), ("has", ""), ("alone", "alone"), ("byroot", "x"))]))
    kb.repair(9.0)
    got = {r["id"]: (r["hidden"], r["email_count"]) for r in kb.read("threads").collect()}
    assert got == {"real": (0, None), "dup": (1, None), "has": (0, None), "alone": (1, None), "made": (0, None)}


def test_queue_and_stream(spark, kb, tmp_path):
    kb.create_job(spark.createDataFrame([("lanes", "running", 1.0)], "keywords string, status string, created_at double"))
    kb.update_job(spark.createDataFrame([(1, "done")], "id bigint, status string"))
    assert tuple(kb.read("collect_jobs").select("id", "status").first()) == (1, "done")
    folder = tmp_path / "in"
    rows = mail(spark, ("lanes: a", "x", "b", "<1@x>", "", []), ("Re: lanes: a", "y", "b", "<2@x>", "<1@x>", ["<1@x>"]), ("other", "x", "b", "<3@x>", "", []), ("[GIT PULL] lanes", "x", "b", "<4@x>", "", []))
    rows.write.json(str(folder))
    for _ in range(2):  # a second run finds nothing new
        collect.start(kb, collect.read_mail_stream(spark, str(folder)), str(tmp_path / "cp"), 1, lambda: 5.0, ["lanes"]).awaitTermination()
        assert [r["root_message_id"] for r in kb.read("collect_queue").collect()] == ["<1@x>"]
        assert kb.read("emails").count() == 2
    tried = []

    def fetch(items):
        tried.append(items.count())
        return items.select("root_message_id", F.lit(False).alias("ok"))

    assert collect.work(kb, 1, fetch, lambda: 6.0)["failed"] == 1
    assert len(tried) == collect.ATTEMPTS
    kb.reset_queue()
    assert kb.read("collect_queue").first()["status"] == "pending"
    kb.set_queue_status(kb.read("collect_queue").select("job_id", "root_message_id", F.lit("downloading").alias("status"), F.lit(0).alias("retry_count"), F.lit(7.0).alias("updated_at")))
    done = collect.work(kb, 1, lambda items: items.select("root_message_id", F.lit(True).alias("ok")), lambda: 8.0)
    assert (done["completed"], done["total"]) == (1, 1)
    kb.delete_queue(spark.createDataFrame([(1,)], "job_id bigint"))
    assert kb.read("collect_queue").count() == 0


MBOX = """From a@x Mon Jan  2 10:00:00 2023
Subject: =?utf-8?b?w6k=?= x
From: A <a@x>
Message-ID: <1@x>
References: <0@x>,<z@x>

hi

From b@x Mon Jan  2 11:00:00 2023
X-Only: y

nothing
"""
MULTI = """From c@x Mon Jan  2 12:00:00 2023
Subject: m
From: c
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=B

--B
Content-Type: text/plain

one
--B
Content-Type: text/plain; charset=latin-1
Content-Transfer-Encoding: quoted-printable

tw=F6
--B--
"""


def test_archives(spark, tmp_path):
    import gzip

    (tmp_path / "a.mbox").write_text(MBOX)
    (tmp_path / "b.mbox.gz").write_bytes(gzip.compress(MULTI.encode()))
    (tmp_path / "c.html").write_text("<!DOCTYPE html><html>error</html>")
    rows = {r["message_id"] or r["subject"]: r for r in archives.read_mbox(spark, str(tmp_path)).collect()}
    assert rows["<1@x>"]["subject"] == "é x"
    assert rows["<1@x>"]["references"] == ["<0@x>", "<z@x>"]
    assert rows["m"]["body"].replace("\n", "") == "onetwö"
    assert len(rows) == 2
    spark.dataSource.register(archives.MboxDataSource)
    read = spark.read.format("mbox").option("mode", "thread").load(str(tmp_path)).collect()
    assert sorted(r["body"].strip() for r in read) == ["hi", "nothing", "one"]


def test_pages(spark):
    feed = '<entry><title>S &amp; T</title><name>N</name><email>e@x</email><updated>2024</updated><link href="https://h/all/m@x/"/><pre>b &lt;1&gt;</pre></entry>'
    row = pages.atom_entries(spark.createDataFrame([(feed * 2,)], ["value"])).collect()
    assert len(row) == 2
    assert (row[0]["subject"], row[0]["from"], row[0]["message_id"], row[0]["body"]) == ("S & T", "N <e@x>", "<m@x>", "b <1>")
    html = "<table><tr><td>Subject</td><td>hello</td></tr></table><pre>a<br>b &amp; c</pre>"
    got = pages.mail_pages(spark.createDataFrame([("https://h/l/2024/1/2/33", html)], "url string, html string")).first()
    assert (got["subject"], got["date"], got["body"]) == ("hello", "2024-1-2", "a\nb & c")
    day = pages.day_index(spark.createDataFrame([('<a href="/l/2024/1/2/3">x &lt;</a>',)], ["html"])).first()
    assert tuple(day) == (0, "/l/2024/1/2/3", "x <")


SHOW = "commit {0}\nAuthor: A B <a@b.c>\nDate:   {1}\n\n    [PATCH v2 3/7] mm/slab: fix do_the_thing_now\n\n    body\n\n mm/slab_common.c | 3 +\n 1 file changed\n"


def test_commits(spark):
    texts = [(SHOW.format("0123456789abcdef", "Mon, 2 Jan 2023 10:00:00 +0200"),), (SHOW.format("ffff456789abcdef", "Thu, 5 Jan 2023 10:00:00 +0200"),), (SHOW.format("eeee456789abcdef", "Sun, 5 Feb 2023 10:00:00 +0200"),), ("",)]
    rows = commits.commits(spark.createDataFrame(texts, ["value"]))
    row = rows.where("hash like '0123%'").first()
    assert (str(row["date"]), row["files"], row["patch_index"], row["subsystems"], row["date_from"], row["date_to"]) == ("2023-01-02 10:00:00", ["mm/slab_common.c"], 3, ["mm"], "2022-11-03", "2023-01-16")
    assert row["search_terms"] == ["mm/slab: fix do_the_thing_now", "mm/slab", "do_the_thing_now", "slab_common"]
    assert {tuple(r) for r in commits.related(rows).collect()} == {("0123456789abcdef", "ffff456789abcdef"), ("ffff456789abcdef", "0123456789abcdef")}


RULE = "=" * 70


def document(*blocks):
    return f"Hash: abc\nSubject : s\n{RULE}\n# Lore 邮件线程 (3)\n{RULE}\n\n" + "\n\n".join(blocks) + f"\n{RULE}\n# 请基于以上内容\nask"


def test_trim(spark):
    doc = document("## [讨论] " + "a" * 50, "## [讨论] " + "b" * 45, "## [讨论] " + "c" * 20)
    run = lambda text, size: contexts.trim(spark.createDataFrame([(text,)], ["content"]), size).first()
    assert run(doc, 10_000)["content"] == doc
    blocks = ["## [讨论] " + c * n for c, n in (("a", 592), ("b", 492), ("c", 292))]
    fixed = len(document())
    greedy = run(document(*blocks), fixed + 200 + 1000)
    assert (greedy["emails_kept"], greedy["emails_dropped"]) == (2, 1)
    assert "b" * 45 not in greedy["content"]
    assert run("no mails " * 50, 100)["trimmed_size"] == 100
    assert run(doc, 150)["emails_kept"] == 0
    long = run(document("## [PATCH摘要] " + "x" * 5000), 3000)
    assert "正文已截断" in long["content"]


def test_artifacts(spark):
    files = spark.createDataFrame([("d07f09a1f99c_translated", ".html", "a.html", 5, "2024-01-02"), ("d07f09a1f99c_full", ".txt", "a.txt", 9, "2024-01-03"), ("notes", ".txt", "n.txt", 1, "2024-01-01")], "stem string, ext string, relpath string, size_kb bigint, mtime string")
    got = [(r["id"], r["commit_hash"], r["status"], r["primary_path"], r["files"]) for r in reports.artifacts(files).collect()]
    assert got == [("d07f09a1f99c", "d07f09a1f99c", "translated", "a.html", 2), ("notes", "", "packed", "n.txt", 1)]
    assert "d07f09a1f99c" in reports.dashboard(reports.artifacts(files))


def test_answers(spark):
    df = spark.createDataFrame([('```json\n{"summary": "s", "tags": ["a"]}\n```',), ("plain text",)], ["x"])
    got = [r[0] for r in df.select(reports.answer_fields(F.col("x"))).collect()]
    assert (got[0]["summary"], got[0]["tags"], got[1]["summary"]) == ("s", ["a"], "plain text")


def test_a_writer_that_dies_leaves_the_version_before(spark, kb, monkeypatch):
    mails = lambda *ids: mail_rows(mail(spark, *[("s", "a@x", "b", i, "", []) for i in ids]), "all", 1.0)
    kb.insert_emails(mails("<1>"))

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # rows are written, the marker is not
        m.setattr(KnowledgeBase, "_commit", dies)
        with pytest.raises(KeyboardInterrupt):
            kb.insert_emails(mails("<2>"))
    assert [r["message_id"] for r in kb.read("emails").collect()] == ["<1>"]
    assert kb.insert_emails(mails("<2>", "<3>")) == (2, 0)
    assert sorted(r["message_id"] for r in kb.read("emails").collect()) == ["<1>", "<2>", "<3>"]
    # added rows are written alone, beside the older folders, and are joined when there are many
    monkeypatch.setattr("threadloom.operators.store.FOLDERS", 3)
    for k in range(4, 8):
        kb.insert_emails(mails(f"<{k}>"))
    assert kb.read("emails").count() == 7 and len(kb._parts("emails", kb.version("emails"))) <= 3
    assert len({r["id"] for r in kb.read("emails").collect()}) == 7


def test_json_mails_are_written_once(spark, tmp_path):
    kind = "topic string, message_id string, subject string"
    df = spark.createDataFrame([("t", "<1>", "a"), ("t", "<1>", "b"), ("u", "<1>", "a"), ("t", None, "x"), ("t", "", "y")], kind)
    path = f"{tmp_path}/out"
    assert archives.write_json_mails(df, path) == 4
    assert archives.write_json_mails(df, path) == 0
    assert archives.write_json_mails(spark.createDataFrame([("t", "<2>", "c"), ("t", "<1>", "z")], kind), path) == 1
    assert spark.read.json(path).count() == 5


def test_folders_of_mails_and_topics(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"subject": "x"}, {"subject": "y"}]')
    (tmp_path / "b.json").write_text('{"name": "sched", "search_keywords": ["k"]}')
    got = {r["path"].rsplit("/", 1)[1]: r["mails"] for r in archives.read_mail_counts(spark, str(tmp_path)).collect()}
    assert got == {"a.json": 2, "b.json": 0}
    (tmp_path / "a.json").unlink()
    (tmp_path / "c.json").write_text("{}")
    topics = {r["name"]: (r["display_name"], r["search_keywords"], r["description"]) for r in archives.read_topics(spark, str(tmp_path)).collect()}
    assert topics == {"sched": ("sched", ["k"], ""), "c": ("c", [], "")}


def test_topics_jobs_and_threads_of_a_run(spark, kb):
    answers = spark.createDataFrame([("t", ["A", "B", " "], 0.5), ("u", ["A"], None)], "thread_id string, topics array<string>, confidence double")
    assert kb.auto_topics(answers, 1.0) == 3 and kb.auto_topics(answers, 2.0) == 3
    assert kb.read("topics").count() == 2 and kb.read("thread_topics").count() == 3
    job = kb.open_job("k", 1.0)
    assert kb.open_job("k", 2.0) == job != kb.open_job("l", 2.0)
    kb.update_job(spark.createDataFrame([(job, "done")], "id bigint, status string"))
    assert kb.open_job("k", 3.0) != job
    mails = mail(spark, ("root", "a@x", "b", "<1>", "", []), ("Re: root", "b@x", "b", "<2>", "<1>", ["<1>"])).withColumn("thread_id", F.lit("<1>"))
    assert kb.store_thread(mails, "all", 1.0) == (2, 1) and kb.store_thread(mails, "all", 2.0) == (0, 1)
    assert tuple(kb.read("threads").select("id", "root_message_id", "subject", "email_count", "participant_count").first()) == ("<1>", "<1>", "root", 2, 2)
    assert [r["id"] for r in collect.unfinished(kb.read("threads")).collect()] == ["<1>"]
    kb.set_translated_path(spark.createDataFrame([("<1>", "p.html")], "id string, translated_html_path string"))
    assert collect.unfinished(kb.read("threads")).count() == 0
    hashed = kb.read("threads").withColumn("source_hash", F.lit("old"))
    assert collect.unfinished(hashed, spark.createDataFrame([("<1>", "new")], "id string, source_hash string")).count() == 1
