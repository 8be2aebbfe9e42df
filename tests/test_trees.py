import random

from threadloom.operators import listings, reports, trees


def test_sizes_and_places_against_brute_force(spark):
    rng = random.Random(3)
    up = {0: None, 1: None}
    for k in range(2, 200):
        up[k] = rng.choice([None, *range(k)]) if k % 17 else None
    for k in range(200, 260):  # a deep chain
        up[k] = k - 1
    df = spark.createDataFrame([(str(k), None if p is None else str(p), k) for k, p in up.items()], "node string, parent string, id int")
    kids = {}
    for k, p in up.items():
        kids.setdefault(p, []).append(k)
    size, place = {}, {}

    def walk(k, at):
        place[k], n = at, 1
        for c in kids.get(k, []):
            n += walk(c, at + n)
        size[k] = n
        return n

    for root in kids[None]:
        walk(root, 1)
    assert {int(r["node"]): r["size"] for r in trees.subtree_sizes(df).collect()} == size
    assert {int(r["node"]): r["place"] for r in trees.depth_first(df, "id").collect()} == place
    assert trees.subtree_sizes(df.limit(0)).count() == 0
    assert trees.depth_first(df.limit(0), "id").count() == 0


BUILT = "mid string, parent string, root string, depth int, id bigint, sent_at timestamp, from_email string, subject string"


def test_a_hot_thread_is_cut_into_parts(spark, emails):
    rows = [(f"<{k}>", None if k == 0 else "<0>", "<0>", int(k > 0), k, None, "a@x", f"s{k}") for k in range(1200)] + [("<x>", None, "<x>", 0, 5000, None, "b@x", "t")]
    built = spark.createDataFrame(rows, BUILT)
    mails = emails([{"id": r[4], "thread_id": r[2], "body": f"body {r[4]}", "date": f"{r[4]:05}"} for r in rows])
    got = {(r["root"], r["part"]): r["text"] for r in reports.markdown(built, mails, "T").collect()}
    assert sorted(got) == [("<0>", 0), ("<0>", 1), ("<0>", 2), ("<x>", 0)]
    assert got["<0>", 0].startswith("# T\n\nReplies: 1199\n\n## s0") and got["<0>", 1].count("### ") == 500 and "### s500\n" in got["<0>", 1]
    assert {r["root"] for r in reports.markdown(built, mails, "T", replies=False).collect()} == {"<0>", "<x>"}
    texts = {r["thread_id"]: r["text"] for r in reports.thread_texts(mails, limit=2).collect()}
    assert texts["<0>"].endswith("... 1198 more mails") and texts["<0>"].count("--- ") == 2
    prompts = {r["thread_id"]: r["text"] for r in listings.thread_prompts(mails, root=3, replies=2, size=100).collect()}
    assert prompts["<0>"] == "# \n[]\nbod\n\n[]\nbody 1\n\n[]\nbody 2"


def test_filters_and_pages(spark, emails, threads):
    mails = emails([{"id": 1, "from_name": "Ann", "subject": "[PATCH] x", "body": "diff --git a b"}, {"id": 2, "from_name": "Bob", "subject": None, "body": "Lanes " + "y" * 300}, {"id": 3}, {"id": 4, "body": "diff --git " + "z" * 9000}], extra=True)
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(listings.mail_filter(mails)) == {1, 2, 3, 4}
    assert ids(listings.mail_filter(mails, "lanes")) == {2} and ids(listings.mail_filter(mails, author="ann", tag="[PATCH摘要]")) == {1}
    assert ids(listings.small_diffs(mails)) == {1}
    cards = threads([{"id": "a", "subject": "One", "tags": '["x"]', "processed": 1, "hidden": 0, "email_count": 2, "end_date": "2"}, {"id": "b", "subject": "two <b>", "processed": 0, "hidden": 0, "end_date": "3"}, {"id": "c", "hidden": 1}])
    assert ids(listings.card_filter(cards, tag="x")) == {"a"} and ids(listings.card_filter(cards, "TWO", processed=0)) == {"b"}
    assert [r["id"] for r in listings.sorted_cards(cards, "mails").orderBy("place").collect()] == ["a", "b", "c"]
    told = spark.createDataFrame([(1, "T", "full", "text & more", "[]", 5.0)], "id bigint, topic string, report_type string, content string, source_thread_ids string, created_at double")
    pages = {(r["kind"], r["page"]): r["html"] for r in reports.knowledge_pages(cards, told, size=1).collect()}
    assert sorted(pages) == [("reports", 0), ("threads", 0), ("threads", 1)]
    assert "two &lt;b&gt;" in pages["threads", 0] and "text &amp; more" in pages["reports", 0] and '<span class="tag">x</span>' in pages["threads", 1]
    assert reports.knowledge_pages(cards.limit(0), told.limit(0)).count() == 0
