import random

import pandas as pd
import pytest

from threadloom.llm import names as N


def test_near_against_brute_force():
    rng = random.Random(0)

    def brute(a, b):
        out = set()
        for k in range(len(a) + 1):
            out |= {a[:k] + a[k + 1 :], *(a[:k] + c + a[k:] for c in "abc"), *(a[:k] + c + a[k + 1 :] for c in "abc" if k < len(a))}
            if k + 1 < len(a):
                out.add(a[:k] + a[k + 1] + a[k] + a[k + 2 :])
        return b in out

    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in "ab")
        if a != b:
            assert N.near(a, b) == brute(a, b), (a, b)


def test_trie_finds_all_within_bound():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 7))) for _ in range(300)})
    trie = N.Trie()
    for w in words:
        trie.add(w, w)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for w in words[:40]:
        assert set(trie.walk(w)) == {x for x in words if distance(w, x) <= 2}


def test_one_edit_in_any_order():
    assert N.one_edit("kenneth zebishire", "zebishire kenneah")
    assert N.one_edit("gamasing minghao", "gamsaing minghao")
    assert not N.one_edit("gamasing minghao", "gamasing michael")
    assert not N.one_edit("a b", "a b")
    assert N.one_edit("john smith", "jhn smyth") and N.one_edit("anna carla silva", "carla silva xnna")
    assert not N.one_edit("john smith", "jhn smxyth") and not N.one_edit("li bo", "lo ba")
    rest, name = ["gamasing", "gamsaing", "other"], ["gamasing ming", "gamsaing ming", "ming other"]
    shard = pd.DataFrame({"rest": rest * 2, "name": name * 2, "seeks": [False] * 3 + [True] * 3})
    assert N.trie_join(shard).values.tolist() == [["gamasing ming", "gamsaing ming"]]


def test_names_within_one_edit_meet_in_a_shard(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.choice([2, 2, 3, 3, 4, 4, 5, 6, 7, 8])))
    names = {" ".join(sorted([*rng.choice([["holm"], ["holm", "mia"], ["ab"]]), word()])) for _ in range(300)}
    for name in [*names]:  # the longer words rarely lie near each other by chance
        first, *rest = name.split()[::-1]
        k = rng.randrange(len(first))
        names.add(" ".join(sorted([*rest, first[:k] + rng.choice(["", "z", first[k] + "z", first[k : k + 2][::-1]]) + first[k + 1 :]])))
    names |= {f"holm {w}" for w in ("jan", "jon", "asa", "saa", "wang", "wnag", "as", "zo", "zoe")}
    names |= {"john smith", "jhn smyth", "anna carla silva", "carla silva xnna", "ana lopez maria", "lopez maria nna", "li wu", "li wo", "hmslo kennethe", "holms kenneht"}
    names = sorted(n for n in names if min(map(len, n.split())) > 1)
    want = {(a, b) for a in names for b in names if a < b and N.one_edit(a, b)}
    df = spark.createDataFrame([(n, n.split()) for n in names], "name string, tokens array<string>")
    for block in (2000, 7):  # whole shards, and shards of many blocks
        assert {tuple(r) for r in N.neighbours(df, 4, block).collect()} == want
    assert {("holm jan", "holm jon"), ("holm asa", "holm saa"), ("holm wang", "holm wnag"), ("holm as", "holm asa"), ("holm zo", "holm zoe"), ("jhn smyth", "john smith"), ("anna carla silva", "carla silva xnna")} <= want
    assert ("li wo", "li wu") not in want  # half of a two-letter word


@pytest.mark.parametrize(
    ("text", "tokens", "address"),
    [
        ('"Doe, Jané" <Jane+list@X.org>', ["doe", "jane"], "jane@x.org"),
        ("Dr. Søren K. Holm (Firm) <s@h>", ["holm", "soren"], "s@h"),
        ("Alex 'bar' Foo <a@b>", ["alex", "foo"], "a@b"),
        ("Foo Test Lab, Big Firm <ci@x>", ["foo", "laboratory", "test"], "ci@x"),
        ("JosÃ© Madeben <j@m>", ["jose", "madeben"], "j@m"),
        ("plain@x.y", [], "plain@x.y"),
        ("Nobody", ["nobody"], ""),
    ],
)
def test_parse(text, tokens, address):
    p = N.parse(text)
    assert (p["tokens"], p["address"]) == (tokens, address)


def test_link(emails):
    senders = [
        "Elizabeth Sistulday <elizabeth.sistulday@firm.example>", "Liz Sistulday <web1@mail.example>", "Sistulday, Elizabeth <web1@mail.example>", "E. Q. Sistulday <web2@mail.example>", "Elizabeth Sistuldya <web3@mail.example>",
        "elizabethsistulday@other.example", "Kenneth Nolkupire <kn@firm.example>", "KN <kn@firm.example>", "Kenneth Nolkupine <kenneth.nolkupine@else.example>", "Kenneth Nolkupire <kenneth.nolkupire@firm.example>", "", None, "   ", "Nolkupire Build Farm <ci@firm.example>", "Nolkupire Buildfarm <nolkupire.bld@web.example>",
    ]
    rows = [{"id": k, "from_email": s} for k, s in enumerate(senders * 2)]
    linked = {r["sender"]: r["entity"] for r in N.link(emails(rows, extra=True)).collect()}
    assert set(linked) == {s for s in senders if s and s.strip()}
    groups = {}
    for s, e in linked.items():
        groups.setdefault(e, set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, [set(senders[:6]), {senders[6], senders[7], senders[9]}, {senders[8]}, {senders[13], senders[14]}]))
    found = {tuple(r) for r in N.pairs(N.link(emails(rows))).collect()}
    assert all(a < b for a, b in found)
    assert len(found) == 15 + 3 + 1
    assert N.link(emails([])).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}") for k in range(40)] + [("x", "y")], "a string, b string")
    got = {r["node"]: r["label"] for r in N.components(edges).collect()}
    assert got == {f"n{k:02}": "n00" for k in range(41)} | {"x": "x", "y": "x"}
    assert {r["node"]: r["label"] for r in N.components(edges, few=3).collect()} == got
    assert N.components(edges.limit(0)).count() == 0


def test_lost_letters_and_short_forms(emails):
    senders = ["Alexander Nod\ufffddow <web1@mail.example>", "Alexander Nodaldow <a.n@firm.example>", "Haru Pamukay <web2@mail.example>", "Haruto Pamukay <h.p@firm.example>", "Harto Pamukay <h.p@firm.example>", "Hara Silvester <x@y>", "Harald Silvester <z@y>", "Hariet Silvester <w@y>"]
    got = {r["sender"]: r["entity"] for r in N.link(emails([{"id": k, "from_email": s} for k, s in enumerate(senders)])).collect()}
    assert got[senders[0]] != "" and len({got[s] for s in senders[2:5]}) == 1 and len({got[s] for s in senders[5:]}) == 3
    assert N.parse(senders[0])["tokens"] == ["alexander", f"nod{N.UNKNOWN}dow"]
