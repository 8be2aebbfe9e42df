import random

import pytest

from threadloom.llm import answers as A
from threadloom.llm import encoding as E
from threadloom.llm import quotes as Q
from threadloom.llm import spam as S

CLEAN = ["Der Zähler läuft über, Größe prüfen", "Le délai élevé dans l’appel, déjà réglé", "It’s roughly 3 µs – not “fast” at all…", "Вопрос о блокировке и счётчике", "关于这个函数的加锁问题", "François, Søren and Jürgen agree"]


def test_damage_is_found_and_undone(emails):
    rng = random.Random(4)
    rows = [{"id": k, "body": "\n".join(rng.choice(CLEAN) for _ in range(3)), "subject": rng.choice(CLEAN), "from_name": "René"} for k in range(400)]
    hurt = {}
    for k in range(0, 60):
        true, wrong = rng.choice([("utf-8", "cp1252"), ("utf-8", "cp850"), ("utf-8", "cp1251"), ("utf-8", "latin-1")])
        try:
            text = rows[k]["body"].encode(true).decode(wrong)
        except UnicodeError:
            continue
        hurt[k], rows[k]["body"] = rows[k]["body"], text
    rows += [{"id": 900, "body": 'The console prints "Ã¼" where the name has an umlaut.'}, {"id": 901, "body": "na�ve"}, {"id": 902}, {"id": 903, "body": "", "subject": "plain"}, {"id": 904, "body": "long é " * 20_000}]
    found = {(r["id"], r["field"]): r["restored"] for r in E.find(emails(rows, extra=True), ["body", "from_name", "subject"]).collect()}
    assert set(found) == {(k, "body") for k in hurt} | {(901, "body")}
    assert sum(found[k, "body"] == v for k, v in hurt.items()) >= 0.9 * len(hurt)
    assert E.find(emails([]), ["body"]).count() == 0


def test_undo():
    assert E.undo("Ã©", ("utf-8", "cp1252")) == "é"
    assert E.undo("â\x80\x99", ("utf-8", "cp1252")) == "’"
    assert E.undo("ÃƒÂ©", ("utf-8", "cp1252", "utf-8", "cp1252")) == "é"
    assert E.undo("中", ("utf-8", "cp1252")) is None


def lines(body, sender="Jane Doe <jane@firm.example>"):
    return Q.shape(body, sender)[0]


@pytest.mark.parametrize(
    ("body", "old"),
    [
        ("On Mon, 1 Jan 2024 10:00:00 +0000, A B wrote:\n> one\n> two\n\nmine\n", [1, 2, 3]),
        ("On Mon, 1 Jan 2024 10:00:00 +0000, A B <a@x>\nwrote:\n\n> one\n\nmine", [1, 2, 4]),
        ("* A B [Thu, 27 May 2021 18:48:39 -0400]:\n> x\nmine", [1, 2]),
        ("In message <a@x>\nA B wrote:\nAB>text\nmine", [1, 2, 3]),
        ("A B said:\n» x\n» y\n\nmine", [1, 2, 3]),
        ("mine\n\n-- \nJane\nFirm\n\nNOTICE: secret", [3, 4, 5, 7]),
        ("mine\n\nCheers,\nJane", [3, 4]),
        ("mine\n\nJane Doe\nSite Reliability, Firm", [3, 4]),
        ("mine\n\n-----Original Message-----\nFrom: A <a@x>\nSent: x\nSubject: s\n\nold text\n\nolder", [3, 4, 5, 6, 8, 10]),
        ("mine\n\nFrom: A <a@x>\nDate: unknown\nSubject: s\n\nold", [3, 4, 5, 7]),
        ("From: Author <a@x>\n\nmessage\n\nSigned-off-by: A\n---\n a.c | 2 +-\n\ndiff --git a b\n+x\n-- \n2.43.0", [11, 12]),
        ("mine\n\n_______________________________________________\nk mailing list -- k@x\nhttps://x", [3, 4, 5]),
        ("mine\r\n\r\nSent from my phone\r\n", [3]),
        ("> a line that is long enough to be cut at its end, so\nits rest\n> comes here\nmine", [1, 2, 3]),
        ("As A wrote: it is a guess.\n\n| a | b |\n| c | d |\n[  1.0] trace+0x1/0x2", []),
        ("Thanks for the work,\nit helps a lot and I like it.", []),
        ("", []),
    ],
)
def test_form(body, old):
    assert lines(body) == old


def test_windows(emails):
    text = "This sentence was written by the first author of it all\nand it goes on over a second line of some length here"
    closing = "\nMy unusual closing words\nalways the same"
    rows = [{"id": 1, "thread_id": "t", "date": "2024-01-01", "from_email": "a@x", "body": text}, {"id": 2, "thread_id": "t", "date": "2024-01-02", "in_reply_to": "x", "from_email": "b@x", "body": "new words here\n\n" + text}]
    rows += [{"id": 10 + k, "thread_id": f"u{k}", "date": "2024-01-01", "from_email": "c@x", "body": f"unique number {k} of the mails" + closing} for k in range(4)]
    rows += [{"id": 20, "thread_id": "t", "date": "2024-01-01", "in_reply_to": "y", "from_email": "d@x", "body": text}, {"id": 30}, {"id": 31, "body": "x" * 300_000}, {"id": 32, "body": ""}]
    got = {(r["id"], r["line_no"]) for r in Q.not_new(emails(rows, extra=True)).collect()}
    assert got == {(2, 3), (2, 4)} | {(10 + k, n) for k in range(4) for n in (2, 3)}
    assert Q.not_new(emails([])).count() == 0


def test_unmarked_text_of_mails_with_blank_links(emails):
    text = "This sentence was written by the first author of it all\nand it goes on over a second line of some length here"
    rows = [{"id": 1, "message_id": "<r>", "thread_id": "r", "date": "2024-01-01", "from_email": "a@x", "body": text}]
    rows += [{"id": 2, "message_id": "<m>", "thread_id": "<r>", "refs": "<r>", "date": "2024-01-02", "from_email": "b@x", "body": "new words\n\n" + text}, {"id": 3, "message_id": "<n>", "thread_id": "<r>", "in_reply_to": " ", "refs": "", "date": "2024-01-03", "from_email": "c@x", "body": text}]
    # stored again with other dates: the first mail of the thread, and an answer
    mine = "The answer has two lines of its own that nobody else wrote\nso they stay new however often the mail is stored again"
    rows += [{"id": 4, "message_id": "r", "thread_id": "<r>", "date": "2024-02-01", "from_email": "a@x", "body": text}]
    rows += [{"id": 5 + k, "message_id": "<o>", "thread_id": "<r>", "refs": "<r>", "date": f"2024-01-0{4 + k}", "from_email": "d@x", "body": mine} for k in range(2)]
    got = {(r["id"], r["line_no"]) for r in Q.not_new(emails(rows, extra=True)).collect()}
    assert got == {(2, 3), (2, 4), (3, 1), (3, 2)}


def test_authorship_covers_marked_lines_and_long_closings(emails):
    closing = "\n".join(f"closing line number {c}" for c in "abcdefghijklmnop")
    rows = [{"id": 1, "thread_id": "r", "message_id": "<r>", "date": "2024-01-01", "from_email": "a@x", "body": "The first words.\nYes."}]
    rows += [{"id": 2, "thread_id": "r", "message_id": "<s>", "in_reply_to": "<r>", "date": "2024-01-02", "from_email": "b@x", "body": "> The first words.\n> Yes.\n> Unknown.\nMine."}]
    rows += [{"id": 10 + k, "message_id": f"<u{k}>", "from_email": "c@x", "body": f"unique number {k} of the mails\n{closing}"} for k in range(4)]
    rows += [{"id": 20 + k, "message_id": "<same>", "from_email": "d@x", "body": "one mail\nstored thrice"} for k in range(3)]
    got = {}
    for r in Q.by_rule(emails(rows, extra=True)).collect():
        got.setdefault((r["id"], r["line_no"]), set()).add(r["rule"])
    assert got == {(2, 1): {"author", "form"}, (2, 2): {"author", "form"}, (2, 3): {"form"}} | {(10 + k, n): {"closing"} for k in range(4) for n in range(2, 18)}


def test_short_lines_and_code_of_unmarked_quotations(emails):
    text = "This sentence was written by the first author of it all\nand it goes on over a second line until its last word\nends.\n\n- one();\n+ two();\n\nA paragraph of one line that is long enough\n\nYes."
    loose = "One line that stands in a paragraph alone\n\nAnother line that stands in a paragraph alone"
    rows = [{"id": 1, "message_id": "<r>", "thread_id": "r", "date": "2024-01-01", "from_email": "a@x", "body": f"{text}\n\n{loose}"}]
    rows += [{"id": 2, "thread_id": "r", "in_reply_to": "<r>", "date": "2024-01-02", "from_email": "b@x", "body": f"Yes.\nI agree with all of it.\n\n{text}\n\nNo.\nYes."}]
    rows += [{"id": 3, "thread_id": "r", "in_reply_to": "<r>", "date": "2024-01-03", "from_email": "c@x", "body": f"Mine.\n\n{loose}"}]
    rows += [{"id": 4, "thread_id": "r", "in_reply_to": "<r>", "date": "2024-01-04", "from_email": "d@x", "body": "A paragraph of one line that is long enough\n\nYes."}]
    got = {(r["id"], r["line_no"]) for r in Q.not_new(emails(rows, extra=True)).collect()}
    assert got == {(2, n) for n in (4, 5, 6, 8, 9, 11, 13)} | {(3, 3), (3, 5)}


ENDS = {("sentences", "。"): (50, 100), ("sentences", "H"): (1, 3000), ("sentences", "."): (1, 900), ("heading", "H"): (50, 600), ("unknown", "。"): (9, 9)}
COPY = "The lock is taken twice here and nobody on the list has seen why the second reader waits for the first one"


@pytest.mark.parametrize(
    ("answer", "prompt", "want"),
    [
        (None, "x", "empty"), (" ​", "x", "empty"), ("N/A", "x", "empty"), ("```\n```", "x", "empty"),
        ("抱歉，我无法翻译这段内容。", "x y", "refusal"), ("I'm unable to process this message.", "x", "refusal"), ("生成失败: read timed out after 15s", "x", "refusal"),
        ("抱歉回复晚了，上一个版本归到了错误的文件夹。", "Sorry for the late answer, it went to the wrong folder.", None),
        ("THE LOCK IS TAKEN TWICE HERE.", "The lock is taken\ntwice here.", "copied"), ("原文：The lock is taken twice here.", "The lock is taken twice here.", "copied"),
        ("+\tfoo_bar(ctx);", "+\tfoo_bar(ctx);", None), ("CONFIG_A=y", "CONFIG_A=y", None), ("Fixes: abcdef123456 (\"x y\")", "Fixes: abcdef123456 (\"x y\")", None),
        ("Une phrase tout autre que celle qui fut demandée.", "The lock is taken twice here.", "wrong_language"), ("함수에서 잠금이 두 번 잡히는 문제가 있습니다.", "The lock.", "wrong_language"),
        ("这里的锁会被获取两", "The lock is taken twice here.", "truncated"), ("这里的锁会被…", "The lock is taken twice here.", "truncated"), ("第一句。", "First one. Second one. Third one.", "truncated"),
        (COPY.replace("seen why", "asked why"), COPY, "copied"), ("主题“" + COPY[:60], COPY[:70], "truncated"), ("这句话停在 io/ledger/stripe-seal.", "It stops in io/ledger/stripe-seal.c here.", "truncated"),
        ("很抱歉，我无法翻译这段内容。" + "这里有很多别的话。" * 60, "x y.", "refusal"), ("这里有很多别的话。" * 60 + "请提供需要翻译的原文。", "One. " * 60, "refusal"),
        ("We cannot refuse the request at this point.", "We cannot refuse the request at this point.", "copied"), ("plan for the “slow” path of it", "Plan for the “slow” path of it", "copied"),
        ("第一句。第二句。第三句。", "First one. Second one. Third one.", None), ("基准测试环境", "Benchmark setup", None),
    ],
)
def test_defects(answer, prompt, want):
    assert A.defect(answer, prompt, ENDS, summary=False) == want


def test_answers(spark, emails, threads):
    import hashlib

    key = lambda b, t: hashlib.sha256(f"{b}:{t}".encode()).hexdigest()
    cache = spark.createDataFrame([(key("b", "One sentence here."), "b", "这里有一句话。", 1.0, 1), (key("b", "Another one."), "b", "Another one.", 1.0, 1), ("unknown", "b", "这是没有原文的话。", 1.0, 1)], "cache_key string, backend string, translated string, created_at double, access_count int")
    paras = spark.createDataFrame([(1, 1, 1, "One sentence here."), (2, 1, 2, "Another one."), (3, 1, 3, None)], "paragraph_id bigint, email_id bigint, para_no int, text_orig string")
    body = "The quick change to the\n> lanes code is fine and needs no further review."
    talks = threads([{"id": "<t>", "subject": "s", "summary_zh": "The quick change to the lanes code is fine", "processed": 1}, {"id": "<u>", "subject": "s", "summary_zh": "摘要完整。", "processed": 1}, {"id": "<v>", "processed": 0}])
    got = {tuple(r) for r in A.judge(cache, paras, talks, emails([{"id": 1, "thread_id": "t", "body": body}])).collect()}
    assert got == {("translation_cache", key("b", "Another one."), "copied"), ("threads", "<t>", "copied")}
    assert A.judge(cache.limit(0), paras.limit(0), threads([]), emails([])).count() == 0


def test_spam(spark):
    rng = random.Random(5)
    nouns, verbs = "lock table lane budget cursor thread patch reader queue window".split(), "holds frees moves wakes drops".split()
    # no frame comes twice in an honest text: a text that says one sentence six times has repeated collocations
    frames = ["The {} {} the {} before it is gone.", "We saw that this {} never {} our {} under load.", "Please check whether any {} still {} that {} after boot.", "On my machine one {} often {} a {} twice.", "Without it each {} slowly {} some {} again.", "I think your {} wrongly {} their {} on error.", "Later another {} quietly {} every {} at exit.", "Nobody knows why his {} sometimes {} her {} here."]
    honest = [" ".join(f.format(rng.choice(nouns), rng.choice(verbs), rng.choice(nouns)) for f in rng.sample(frames, 6)) for _ in range(300)]
    shop = "cheap loan casino bonus discount hosting premium keygen replica watch insurance".split()
    stuffed = [" - ".join(" ".join(rng.sample(shop, 2)) for _ in range(3)) + " - " + " - ".join([" ".join(rng.sample(shop, 2))] * 20) for _ in range(20)]
    salad = ["Tags: " + ", ".join(rng.choice(shop + nouns) for _ in range(60)) for _ in range(10)]
    logs = ["\n".join(f"[ {k}.123456]  wake_lane_{k}+0x1/0x2" for k in range(30)), "\n".join(f"CONFIG_LANE_{k}=y" for k in range(30))]
    texts = [None, "", "  ", *honest, *stuffed, *salad, *logs, honest[0] + "\n\n" + stuffed[0] * 3]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id bigint, text string, words string")
    found = {r["doc_id"] for r in S.judge(df).where("share > 0.5").collect()}
    first = 3 + len(honest)
    want = set(range(first, first + 30)) | {len(texts) - 1}
    assert found == want
    only_salad = {r["doc_id"] for r in S.kinds(df).where("2 * salad_chars > chars").collect()}
    assert only_salad >= set(range(first + 20, first + 30)) and not only_salad & set(range(first))
    assert S.judge(df.limit(0)).count() == 0
    assert S.judge(df.limit(3)).count() == 0


def test_queries_run(spark):
    import os

    from threadloom.llm import queries

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    columns = {"p3_found": ["sender_a", "sender_b"], "p5_found": ["id", "line_no"], "p6_found": ["id", "field"], "p7_found": ["rec_table", "rec_key", "defect"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"]}
    for name, q in queries.registry.queries.items():
        df = q(spark, folder)
        assert df.count() > 0, name
        assert df.columns == columns.get(name, df.columns)
