import pytest
from pyspark.sql import functions as F

from threadloom.functions import backends, bodies
from threadloom.functions import mailtext as M
from threadloom.operators import search, threads

DIFF = "text\n\nSigned-off-by: A\n---\n a.c | 3 +\n 1 file changed\n\ndiff --git a/mm/a.c b/mm/a.c\n--- a/mm/a.c\n+++ b/mm/a.c\n@@ -1,2 +1,3 @@ static int run(void)\n+x\n"


@pytest.mark.parametrize(
    ("sender", "subject", "body", "want"),
    [
        ("tip-bot2 for x", "s", "b", M.DROP),
        ("kernel test robot <lkp@intel.com>", "s", "all fine", M.DROP),
        ("x <lkp@intel.com>", "s", "a.c:1: Warning: y", M.LOW),
        ("a", "[PATCH v2 0/7] s", "diff --git", M.MEDIUM),
        ("a", "[PATCH 3/7] s", "x\ndiff --git a b", M.LOW),
        ("a", "Re: [PATCH 3/7] s", "> diff --git a b", M.LOW),
        ("a", "Re: s", "we ran hackbench", M.MEDIUM),
        ("a", "Re: s", "x" * 3000 + "hackbench", M.HIGH),
        (None, None, None, M.HIGH),
    ],
)
def test_priority(spark, sender, subject, body, want):
    df = spark.createDataFrame([(sender, subject, body)], "f string, s string, b string")
    assert df.select(M.priority_of(F.col("f"), F.col("s"), F.col("b"))).first()[0] == want


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_expressions(spark):
    c = F.col("x")
    assert one(spark, M.contained_id(c), x="a>") == "<a>"
    assert one(spark, M.contained_id(c), x="  ") == ""
    assert one(spark, M.without_signature(c), x="hi  \n-- \nme\n-- \nx") == "hi"
    assert one(spark, M.base_subject(c), x="Re: RE:  [PATCH] x ") == "[PATCH] x"
    assert one(spark, M.reply_depth(c), x="Re: re: x") == 2
    assert tuple(one(spark, M.patch_tag(c), x="[PATCH v2 3/7] x")) == (3, 7, "v2", False)
    assert tuple(one(spark, M.patch_tag(c), x="[PATCH 0/7]")) == (0, 7, "", True)
    assert tuple(one(spark, M.patch_tag(c), x="[RFC PATCH 1/2]")) == (0, 0, "", False)
    assert tuple(one(spark, M.patch_sort_key(c), x="[PATCH v3 00/15] x")) == (0, 0)
    assert one(spark, M.reply_target(c), x="hi\nOn Mon, 1 Jan 2024, Foo Bar <Foo@bar> wrote:\n> x") == "foo@bar"
    assert one(spark, M.code_files(c), x=DIFF + "see kernel/sched/fair.c too") == ["kernel/sched/fair.c", "mm/a.c"]
    assert one(spark, M.code_functions(c), x=DIFF) == ["static int run(void)"]
    assert one(spark, M.is_licence(c), x="Copyright X. Without warranty.") is True
    assert one(spark, M.json_list(c), x='["a", "b"]') == ["a", "b"]
    assert one(spark, M.json_list(c), x="plain") == ["plain"]
    assert one(spark, M.json_list(c), x="") == []
    assert one(spark, M.json_list(c), x="[broken") == ["[broken"]
    assert one(spark, M.list_name(c), x="lkml") == "all"
    assert one(spark, M.list_name(c), x="other") == "other"
    assert len(one(spark, M.group_subject(c), x="Re: " + "word " * 30)) <= 60
    assert one(spark, M.unwanted_subject(c), x="[git pull] fixes") is True
    assert one(spark, M.wanted(c, F.lit("x" * 2000 + " lanes"), ["lanes"]), x="s") is False
    assert one(spark, M.escape_html(c, quotes=True), x="<a href=\"x\">'&") == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;"


def test_keywords(spark):
    assert M.parse_keywords("a AND b or c") == ("and", ["a", "b or c"])
    assert M.parse_keywords("a OR b") == ("or", ["a", "b"])
    assert M.parse_keywords("Foo and bar") == ("plain", ["foo and bar"])


@pytest.mark.parametrize("line", ["   foo_bar+0x44/0x5c", " kernel/a.c |    4 +++-", "[    0.000000] Booting", "CONFIG_SMP=y", "commit 0123456789ab", "#0: ffff8880", "t=1 V=2", "rename from a", "1,234,567  cycles", "Some Name (3):", "----", "> +	x();", "Foo  BAR  12"])
def test_code_lines(line):
    assert bodies.is_code_line(line)


@pytest.mark.parametrize("line", ["Well, that is embarrassing :-(", "I believe this will still have those issues", "", "Thanks for the patch."])
def test_prose_lines(line):
    assert not bodies.is_code_line(line)


def test_bodies():
    quote = "\n".join(f"> {k}" for k in range(5))
    assert bodies.fold_quotes(quote + "\ntext") == "[...3 行引用已省略...]\n> 3\n> 4\ntext"
    assert bodies.fold_quotes(quote) == "[...5 行引用已省略...]"
    assert bodies.fold_quotes("> a\n> b\n> c") == "> a\n> b\n> c"
    assert bodies.strip_patch(DIFF) == "text\n\nSigned-off-by: A"
    assert bodies.strip_patch("a\n---\nb") == "a\n---\nb"
    assert bodies.split_diff(DIFF)[0] == "text\n\nSigned-off-by: A"
    assert bodies.split_diff("a\n```diff\n-x\n```\nb") == ("a\nb", "-x")
    assert bodies.merge_soft_breaks("one\ntwo\n> q\n1. a\nb") == "one two\n> q\n1. a b"
    assert bodies.chunks("ab\ncd\n" + "x" * 12, 5) == ["ab\ncd", "xxxxx", "xxxxx", "xx"]
    assert all(len(x) <= 7 for x in bodies.chunks("some words\nof any length\n\nhere", 7))
    assert not bodies.should_translate("short")
    assert bodies.untranslatable("Signed-off-by: A\nAcked-by: B")
    assert not bodies.untranslatable("This is a sentence that needs a translation.")
    assert bodies.comment_text(["+ /* hello", "+  * world */"]) == "hello world"
    assert max(map(len, bodies.wrap("word " * 60).split("\n"))) <= 80


def test_alignment_is_monotone():
    originals = ["First paragraph about foo_bar and 42 lanes here.", "> quoted", "Second one with Baz_qux and 77 lanes to go."]
    translated = ["关于 foo_bar 和 42 条通道的第一段文字。", "第二段讲 Baz_qux 与 77 条通道的事情。"]
    assert bodies.align(translated, originals, [bodies.untranslatable(x) for x in originals]) == [0, None, 1]
    assert bodies.align([], originals, [False, True, False]) == [None, None, None]


def test_similarity_is_the_same_in_both_forms(spark):
    for a, b in [("关于 foo_bar 的 42", "About foo_bar and 42"), ("same", "same"), ("", "x"), ("测试", "test " * 50)]:
        assert one(spark, M.translation_score(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(bodies.similarity(a, b))


def test_backends():
    backend = backends.Dictionary({"Hello there, this is a line of prose.": "你好"})
    assert backends.translate_aligned(backend, "Hello there, this is a line of prose.\n\n> quoted") == [("Hello there, this is a line of prose.", "你好"), ("> quoted", None)]
    assert "\0CN\0" in backends.translate_comments(backend, "+ x(); // explain this call\n+ /* Copyright, no warranty given */")
    calls = []

    def fail(text):
        calls.append(text)
        if "bad" in text:
            raise ValueError
        return text.upper()

    assert backends.with_retries(fail, sleep=lambda _: None)("a\nbad\nc") == "A\nbad\nC"


DOCS = [{"id": 1, "message_id": "<a@x>", "subject": "sched/fair: fix", "body": "the fair sleeper"}, {"id": 2, "message_id": "<b@x>", "subject": "Sleepers FAIR", "body": "y"}, {"id": 3, "message_id": "<c@x>", "subject": "zz", "body": "sleeper fair é"}]


@pytest.mark.parametrize(
    ("query", "want"),
    [("fair sleeper", [1, 3]), ('"fair sleeper"', [1]), ("sleep*", [1, 2, 3]), ("fair NOT sched", [2, 3]), ("subject:fair", [1, 2]), ("vruntime OR fair", [1, 2, 3]), ("NEAR(fair sleeper,0)", [1, 3]), ("fair_sleeper", [1]), ("e", [3]), ("(fair OR zz) sleeper", [1, 3])],
)
def test_search(emails, query, want):
    assert [r["id"] for r in search.search(emails(DOCS), query).collect()] == want


@pytest.mark.parametrize("query", ["sched/fair", "a@x", "fair-sleeper", "", "nosuch:fair", "fair AND"])
def test_search_errors(emails, query):
    with pytest.raises(search.QueryError):
        search.search(emails(DOCS), query)


def test_fallback(emails):
    assert [r["id"] for r in search.search_or_like(emails(DOCS), "sched/f").collect()] == [1]


def rows(*mails):
    return [{"id": k, "message_id": m, "in_reply_to": r, "refs": refs, "subject": "s", "from_email": f"p{k % 2}", "date": f"2024-01-{k + 1:02}"} for k, (m, r, refs) in enumerate(mails)]


@pytest.mark.parametrize(
    ("mails", "roots"),
    [
        ((("a", "", ""), ("b", "a", ""), ("c", "b", "")), {"<a>": 3}),
        ((("x", "zz", ""),), {"<x>": 1}),
        ((("a", "", ""), ("b", "", "a")), {"<a>": 1, "<b>": 1}),
        ((("a", "", ""), ("b", "", "a"), ("c", "b", "a b")), {"<a>": 3}),
        ((("p", "q", ""), ("q", "p", "")), {"<p>": 2}),
        ((("s", "s", ""),), {"<s>": 1}),
        ((("a", "", ""), ("a", "", ""), ("", "", "")), {"<a>": 1}),
    ],
)
def test_threads(emails, mails, roots):
    built = threads.build(emails(rows(*mails)))
    assert {r["root"]: r["email_count"] for r in threads.summaries(built).collect()} == roots


def test_subject_tree(emails):
    made = [
        {"id": 1, "message_id": "<r>", "subject": "topic", "from_email": "A One <a@x>", "date": "2024-01-01"},
        {"id": 2, "message_id": "<s>", "in_reply_to": "<r>", "subject": "Re: topic", "from_email": "B Two <b@x>", "date": "2024-01-02"},
        {"id": 3, "message_id": "<t>", "in_reply_to": "<gone>", "subject": "Re: topic", "from_email": "C <c@x>", "date": "2024-01-03", "body": "On Mon, 2 Jan, B Two <b@x> wrote:\n> x"},
        {"id": 4, "message_id": "<u>", "in_reply_to": "<gone>", "subject": "Re: topic", "from_email": "D <d@x>", "date": "2024-01-04", "body": "hi"},
        {"id": 5, "message_id": "<v>", "in_reply_to": "<gone>", "subject": "Re: other", "from_email": "D <d@x>", "date": "2024-01-04"},
    ]
    got = {r["id"]: (r["parent_id"], r["how"]) for r in threads.subject_tree(emails(made)).collect()}
    assert got == {1: (None, "root"), 2: (1, "reply"), 3: (2, "quoted"), 4: (1, "time"), 5: (None, "root")}


def test_fixed_paragraphs_see_their_neighbours():
    data = "foo_bar  1,234,567\nbaz_qux  7,654,321"
    assert bodies.fixed_paragraphs([data, "Base run", data]) == [True, True, True]
    assert bodies.fixed_paragraphs([data, "This is fine.", data]) == [True, False, True]
    assert bodies.fixed_paragraphs(["Label: value here", data, "prose text stands here for itself"]) == [True, True, False]
    assert bodies.fixed_paragraphs(["Base run"]) == [False]


def test_rules_of_lines_paragraphs_and_links(spark):
    from threadloom.functions import bodies
    from threadloom.functions import mailtext as M

    assert bodies.is_code_line("/sys/kernel/debug/x") and bodies.is_code_line("/proc/meminfo")
    assert not bodies.is_code_line("Please look at /sys/kernel/debug for the state of it")
    assert not bodies.untranslatable("  \n ") and bodies.untranslatable("[... 5 lines of\nquotation left out ...]")
    df = spark.createDataFrame([("see https://bugs.example/1 and (https://lore.kernel.org/r/a@b).",), ("https://example.org/x",), (None,)], "body string")
    assert [r[0] for r in df.select(M.archive_link(F.col("body"))).collect()] == ["https://lore.kernel.org/r/a@b", "", ""]
    assert [tuple(r[0]) for r in spark.createDataFrame([(" a\nb\nc ",), ("a",), (None,)], "x string").select(M.answer_parts(F.col("x"))).collect()] == [("a", "b\nc"), ("a", ""), ("", "")]
