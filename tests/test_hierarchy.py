import random

import pytest

from threadloom.operators import hierarchy as H


def brute(parents):
    out = {}
    for node in parents:
        seen, k = [], node
        while k is not None and k not in seen:
            seen.append(k)
            k = parents[k]
        out[node] = (seen[-1], len(seen) - 1, seen[::-1]) if k is None else (min(seen[seen.index(k) :]), -1, None)
    return out


def links(spark, parents):
    return spark.createDataFrame([(k, p, f"{i // 7:03}{k}") for i, (k, p) in enumerate(parents.items())], "node string, parent string, place string")


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize(("partitions", "small"), [(4, 1_000_000), (5, 3), (2, 0)])
def test_random_forests_with_circles(spark, seed, partitions, small):
    rng = random.Random(seed)
    n = 60
    parents = {f"n{k:02}": rng.choice([None, f"n{max(0, k - rng.randrange(1, 4)):02}", f"n{rng.randrange(n):02}"]) for k in range(n)}
    got = {r["node"]: (r["root"], r["depth"], r["path"]) for r in H.resolve(links(spark, parents), paths=True, partitions=partitions, small=small).collect()}
    assert got == brute(parents)


def test_long_chain_and_self(spark):
    parents = {f"n{k:04}": f"n{k - 1:04}" if k else None for k in range(1500)} | {"self": "self", "below": "self"}
    got = {r["node"]: (r["root"], r["depth"]) for r in H.resolve(links(spark, parents), partitions=6).collect()}
    assert got["n1499"] == ("n0000", 1499)
    assert got["self"] == ("self", -1)
    assert got["below"] == ("self", -1)


def test_parents_of_mails(spark, emails):
    rows = [
        {"id": 3, "message_id": "<a>", "in_reply_to": "<zz>"},
        {"id": 1, "message_id": "a", "in_reply_to": ""},
        {"id": 4, "message_id": "<b>", "in_reply_to": "<gone>", "refs": "<a>, c <gone>"},
        {"id": 5, "message_id": "<c", "in_reply_to": "a>"},
        {"id": 6, "message_id": None, "in_reply_to": "<a>"},
        {"id": 7, "message_id": "  ", "refs": "<a>"},
        {"id": 8, "message_id": "<d>", "refs": "<x> <y>"},
    ]
    got = {r["node"]: r["parent"] for r in H.parent_links(emails(rows, extra=True)).collect()}
    assert got == {"<a>": None, "<b>": "<c>", "<c>": "<a>", "<d>": None}


def test_descendants_and_empty(spark, emails):
    solved = H.resolve(links(spark, {"a": None, "b": "a", "c": "b", "d": "a"}), paths=True)
    assert {tuple(r) for r in H.descendants(solved).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}
    assert H.resolve(H.parent_links(emails([]))).count() == 0
