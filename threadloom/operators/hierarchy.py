"""Parent-child rows to full hierarchies: path, depth, root, descendants and cycles of each node.

Depth is unknown and chains may be very deep, so no join per level is made. Nodes are laid out so that parents mostly
share a partition with their children (by thread, then storage order; a range partitioning, so no thread is bound to
one partition). Each partition contracts its own parent chains by pointer jumping to fragment exits: a node's fragment
head (the last ancestor inside the partition), the hops to it, and the head's parent outside. The heads with a parent
outside form a smaller quotient forest, which is solved in the same way with fewer partitions; then the heads' answers
are joined back to the fragments. A chain that runs into itself inside a partition is a local cycle; one that crosses
partitions becomes local in some quotient.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.tables import cut, one_form

LINK = ["node", "parent", "place", "weight", "least", "base_root", "base_depth", "trail", "base_path"]
FRAGMENT = "node string, head string, exit string, hops bigint, low string, head_place string, head_weight bigint, head_least string, head_trail array<string>, root string, depth bigint, trail array<string>, path array<string>"


def parent_links(emails: DataFrame) -> DataFrame:
    """(node, parent, place): one row for each distinct message id; parent is null where no mail held is named.

    The row with the lowest emails.id counts. The parent is the in_reply_to mail if it is held, else the last held id
    of refs. place orders mails so that threads stay together.
    """
    mails = emails.select(one_form("message_id").alias("node"), F.col("id"), one_form("in_reply_to").alias("reply"), "refs", one_form("thread_id").alias("thread")).where("node is not null")
    first = mails.groupBy("node").agg(F.min_by(F.struct("id", "reply", "refs", "thread"), F.col("id")).alias("m")).select("node", "m.*")
    held = mails.select(F.col("node").alias("held")).distinct()
    first = first.join(held.withColumnRenamed("held", "parent"), F.col("reply") == F.col("parent"), "left")
    refs = F.filter(F.transform(F.split("refs", r"[\s,]+"), one_form), lambda r: r.isNotNull())
    loose = first.where("parent is null").select("node", F.posexplode(refs).alias("pos", "ref"))
    last = loose.join(held, F.col("ref") == F.col("held")).groupBy("node").agg(F.max_by("ref", "pos").alias("last_ref"))
    return first.join(last, "node", "left").select("node", F.coalesce("parent", "last_ref").alias("parent"), F.concat_ws("\0", F.coalesce("thread", "node"), F.lpad(F.col("id").cast("string"), 20, "0")).alias("place"))


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contracts the parent chains of one partition of links.

    Of each node: head, its last ancestor inside the partition; exit, the head's parent outside; hops, the weights
    from the node to the head, and low, the least id on the way; root and depth where they are settled inside.
    """
    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return
    whole = pa.Table.from_batches(batches)
    node, parent = (whole[c].to_pandas().to_numpy(object) for c in ("node", "parent"))
    least, place = (whole[c].to_pandas().to_numpy(object) for c in ("least", "place"))
    weight, size = whole["weight"].to_numpy().astype(np.int64), len(node)
    named = np.array([p is not None for p in parent])
    up = np.full(size, -1)
    up[named] = pd.Index(node).get_indexer(parent[named])
    inside = up >= 0
    jump, hops = np.where(inside, up, np.arange(size)), np.where(inside, weight, 0)
    # the order of ids stands for the ids, so that the least on the way is found by numbers
    rank = np.empty(size, np.int64)
    order = np.argsort(least, kind="stable")
    rank[order] = np.arange(size)
    low = np.where(inside, rank, size)
    for _ in range(max(1, int(np.ceil(np.log2(size + 1))) + 1)):
        hops, low, jump = hops + hops[jump], np.minimum(low, low[jump]), jump[jump]
    circular = inside[jump]  # after as many steps as there are nodes only a circle still has a parent inside
    loop: dict[int, int] = {}
    for start in sorted(set(jump[circular].tolist())):
        if start not in loop:
            ring, k = [start], int(up[start])
            while k != start:
                ring.append(k)
                k = int(up[k])
            loop |= dict.fromkeys(ring, int(rank[ring].min()))
    base_root, base_depth = whole["base_root"].to_pandas().to_numpy(object), whole["base_depth"].to_pandas().to_numpy(float)
    open_ = named[jump] & ~circular
    root, depth = base_root[jump], np.where(base_depth[jump] < 0, -1, hops + np.nan_to_num(base_depth[jump]))
    for k in np.flatnonzero(circular):
        root[k], depth[k] = least[order[loop[int(jump[k])]]], -1
    root[open_] = None
    trails = paths = head_trail = pa.nulls(size, pa.list_(pa.string()))
    if whole["trail"].null_count < size:
        own, base = whole["trail"].to_pylist(), whole["base_path"].to_pylist()
        way: list = [None] * size
        full: list = [None] * size
        for k in np.argsort(np.where(circular, -1, hops), kind="stable"):
            if not circular[k]:
                way[k] = way[up[k]] + own[k] if inside[k] else []
                full[k] = None if open_[k] or base[jump[k]] is None else base[jump[k]] + way[k]
        trails, paths, head_trail = pa.array(way, pa.list_(pa.string())), pa.array(full, pa.list_(pa.string())), pa.array([own[k] for k in jump], pa.list_(pa.string()))
    text = lambda x: pa.array(x, pa.string())
    yield pa.RecordBatch.from_pydict(
        {
            "node": text(node),
            "head": text(node[jump]),
            "exit": text(np.where(open_, parent[jump], None)),
            "hops": pa.array(hops),
            "low": text([None if x >= size else least[order[x]] for x in low]),
            "head_place": text(place[jump]),
            "head_weight": pa.array(weight[jump]),
            "head_least": text(least[jump]),
            "head_trail": head_trail,
            "root": text(root),
            "depth": pa.array(depth.astype(np.int64), mask=open_),
            "trail": trails,
            "path": paths,
        }
    )


def double(links: DataFrame, nodes: int) -> DataFrame:
    """The answers of a quotient that is too large for one task, by pointer doubling over joins."""
    now = links.select("node", "parent", "weight", F.col("least").alias("low"), "trail")
    for _ in range(max(1, nodes.bit_length() + 1)):
        if now.where("parent is not null").join(now.where("parent is not null").select(F.col("node").alias("parent")), "parent", "left_semi").isEmpty():
            break  # every way has come to a root
        over = now.select(F.col("node").alias("parent"), F.col("parent").alias("next"), F.col("weight").alias("more"), F.col("low").alias("more_low"), F.col("trail").alias("more_trail"))
        step = now.join(over, "parent", "left")
        on = F.col("next").isNotNull()
        now = cut(
            step.select(
                "node",
                F.when(on, F.col("next")).otherwise(F.col("parent")).alias("parent"),
                F.when(on, F.col("weight") + F.col("more")).otherwise(F.col("weight")).alias("weight"),
                F.when(on, F.least("low", "more_low")).otherwise(F.col("low")).alias("low"),
                F.when(on, F.concat("more_trail", "trail")).otherwise(F.col("trail")).alias("trail"),
            )
        )
    ends = links.where("parent is null").select(F.col("node").alias("end"), "base_root", "base_depth", "base_path")
    rings = now.select(F.col("node").alias("ring"), F.col("low").alias("ring_low"))
    out = now.join(ends, F.coalesce("parent", "node") == F.col("end"), "left").join(rings, F.when(F.col("end").isNull(), F.col("parent")) == F.col("ring"), "left")
    far = F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.col("weight"))
    depth = F.when(F.col("end").isNull() | (F.col("base_depth") < 0), F.lit(-1)).otherwise(far + F.col("base_depth"))
    path = F.when(F.col("parent").isNull(), F.col("base_path")).otherwise(F.concat("base_path", "trail"))
    return out.select("node", F.coalesce("base_root", "ring_low").alias("root"), depth.cast("bigint").alias("depth"), path.alias("path"))


def solve(links: DataFrame, partitions: int, small: int) -> DataFrame:
    """(node, root, depth, path) of links whose parents are all nodes of links."""
    laid = links.repartitionByRange(partitions, "place") if partitions > 1 else links.repartition(1)
    fragments = cut(laid.select(*LINK).mapInArrow(contract, FRAGMENT))
    heads = fragments.where("root is null and node = head")
    met = heads.select(F.col("head").alias("h"), F.col("exit").alias("e"), "head_place", "head_weight", "head_least", "head_trail").join(
        fragments.select(F.col("node").alias("e"), "head", "hops", "low", "root", "depth", "trail", "path"), "e"
    )
    ended = F.col("root").isNotNull()
    quotient = cut(
        met.select(
            F.col("h").alias("node"),
            F.when(~ended, F.col("head")).alias("parent"),
            F.col("head_place").alias("place"),
            (F.col("head_weight") + F.when(ended, 0).otherwise(F.col("hops"))).alias("weight"),
            F.when(ended, F.col("head_least")).otherwise(F.least("head_least", "low")).alias("least"),
            F.col("root").alias("base_root"),
            F.when(F.col("depth") < 0, F.lit(-1)).otherwise(F.col("depth") + F.col("head_weight")).cast("bigint").alias("base_depth"),
            F.when(ended, F.col("head_trail")).otherwise(F.concat("trail", "head_trail")).alias("trail"),
            F.when(ended & (F.col("depth") >= 0), F.concat("path", "head_trail")).alias("base_path"),
        )
    )
    nodes = quotient.count()
    if not nodes:
        return fragments.select("node", "root", "depth", "path")
    if nodes <= small:
        answers = solve(quotient, 1, small)
    elif partitions > 2:
        answers = solve(quotient, partitions // 2, small)
    else:
        answers = double(quotient, nodes)
    answers = answers.select(F.col("node").alias("head"), F.col("root").alias("far_root"), F.col("depth").alias("far_depth"), F.col("path").alias("far_path"))
    depth = F.when(F.col("far_depth") < 0, F.lit(-1)).otherwise(F.col("far_depth") + F.col("hops")).cast("bigint")
    return fragments.join(answers, "head", "left").select(
        "node", F.coalesce("root", "far_root").alias("root"), F.coalesce("depth", depth).alias("depth"), F.coalesce("path", F.concat("far_path", "trail")).alias("path")
    )


#: Nodes that a task holds at a time when it contracts its part.
NODES = 200_000


def resolve(links: DataFrame, paths: bool = False, partitions: int | None = None, small: int = 1_000_000) -> DataFrame:
    """(node, parent, root, depth, path) of (node, parent, place).

    Nodes are distinct; a null parent makes a root (depth 0). At or below a circle, also one of length 1, root is the
    smallest id on that circle, depth is -1 and the path is null. path (from root to node) is filled only on demand.
    small: how many nodes one task may solve; a larger quotient is contracted again in fewer partitions and in the end
    solved by pointer doubling. A partition has about NODES nodes (a node takes some hundred bytes in Python, besides its
    path), so their number follows the input. An empty table gives an empty one.
    """
    rooted = F.col("parent").isNull()
    none = F.lit(None).cast("array<string>")
    full = links.select(
        "node",
        "parent",
        "place",
        F.lit(1).cast("bigint").alias("weight"),
        F.col("node").alias("least"),
        F.when(rooted, F.col("node")).alias("base_root"),
        F.when(rooted, F.lit(0)).cast("bigint").alias("base_depth"),
        (F.array("node") if paths else none).alias("trail"),
        (F.when(rooted, F.array("node")) if paths else none).alias("base_path"),
    )
    count = partitions or max(2, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-links.count() // NODES))
    solved = solve(full, count, small)
    return solved.join(links.select("node", "parent"), "node").select("node", "parent", "root", "depth", "path")


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, node, distance): every descendant of every node that is on no circle, from the paths."""
    flat = resolved.where("path is not null").select("node", "depth", F.posexplode("path").alias("pos", "ancestor"))
    return flat.where("pos < depth").select("ancestor", "node", (F.col("depth") - F.col("pos")).alias("distance"))
