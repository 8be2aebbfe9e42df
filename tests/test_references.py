from threadloom.operators import references as R

REMOVED = "record_kind string, record_key string"


def brute(emails, threads, removals):
    one = lambda s: (lambda t: f"<{t}>" if t else None)((s or "").strip().strip("<>").strip())
    mail, thread, filed = {}, {}, {}
    for e in emails:
        for table, k in ((mail, one(e.get("message_id"))), (filed, one(e.get("thread_id")))):
            if k:
                table[k] = min(table.get(k, 1e300), e["created_at"])
    for t in threads:
        thread[one(t["id"])] = min(thread.get(one(t["id"]), 1e300), t["created_at"])
    gone = {(k, one(x)) for k, x in removals}
    refs = [("emails", "thread_id", e, e.get("thread_id"), "thread", thread) for e in emails] + [("emails", "in_reply_to", e, e.get("in_reply_to"), "mail", mail) for e in emails]
    refs += [("threads", "root_message_id", t, t.get("root_message_id"), "mail", mail) for t in threads] + [("threads", "id", t, t["id"], "", filed) for t in threads]
    for table, field, row, key, kind, held in refs:
        if (k := one(key)) and (k not in held or held[k] > row["created_at"]):
            yield table, field, str(row["id"]), "late" if k in held else "deleted" if (kind, k) in gone else "missing"


def test_against_brute_force(spark, emails, threads):
    import random

    rng = random.Random(1)
    form = lambda k: rng.choice(["<{}>", "{}", " <{}", "{}> \n"]).format(k)
    e = [{"id": k, "message_id": form(f"m{rng.randrange(60)}"), "thread_id": rng.choice([None, "", " ", form(f"t{rng.randrange(30)}")]), "in_reply_to": rng.choice([None, "<>", form(f"m{rng.randrange(90)}")]), "created_at": float(rng.randrange(100))} for k in range(150)]
    t = [{"id": f"<t{k}>", "root_message_id": form(f"m{rng.randrange(90)}"), "created_at": float(rng.randrange(100))} for k in range(40)]
    gone = [("mail", form(f"m{k}")) for k in range(60, 75)] + [("thread", form(f"t{k}")) for k in range(5)]
    found = R.orphans(emails(e, extra=True), threads(t), spark.createDataFrame(gone, REMOVED))
    assert sorted(tuple(r)[:4] for r in found.collect()) == sorted(brute(e, t, gone))
    assert sum(r["n"] for r in R.orphan_counts(found).collect()) == len(list(brute(e, t, gone)))


def test_empty_tables(spark, emails, threads):
    nothing = spark.createDataFrame([], REMOVED)
    assert R.orphans(emails([]), threads([]), nothing).count() == 0
    only = R.orphans(emails([{"id": 1, "message_id": "<a>", "in_reply_to": "<zz>", "created_at": None}]), threads([]), nothing).collect()
    assert [tuple(r)[:4] for r in only] == [("emails", "in_reply_to", "1", "missing")]
