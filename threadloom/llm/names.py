"""Linking the spellings under which one person or organisation writes.

Distinct sender texts are parsed into an address and a name; names are folded (diacritics, case, quotes, titles,
places in brackets, nicknames in quotes, single initials) into sorted tokens, so that token order doesn't matter; a
letter that was lost in decoding stays as a letter of its own.
Links are drawn between keys, not between all members of a group:

* texts with the same address, and names with the same tokens once short forms are expanded;
* names within one edit (insertion, deletion, substitution or swap) in one or two of their tokens, found by a trie join:
  names are sharded by what such edits leave whole (see `sharded`), each shard is a trie, a Levenshtein automaton with a
  band of its bound walks it for each name, and pairs found are checked token by token in every order;
* short forms and initials, and addresses that spell a name, where exactly one full name answers to them.

A shard beyond BLOCK names is cut into blocks; every block of searched names meets every block of seeking ones, so no task
holds more than two blocks and no pair is lost. Components come from contraction: each round every node joins the
neighbour of the smallest hash, and only edges between different nodes go on. Nothing but distinct keys is ever
shuffled, so a sender of a third of all rows counts once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Collection, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.tables import cut

# Short forms of given names.
SHORT_FORMS = {
    "alex": ["alexander", "aleksandra"], "al": ["albert", "alan"], "andy": ["andrew"], "drew": ["andrew"], "ann": ["anneke", "anna"], "toni": ["anton", "anthony", "antonio"], "tony": ["anthony", "anton", "antonio"],
    "barb": ["barbara"], "becky": ["rebecca"], "ben": ["benjamin"], "benny": ["benjamin"], "beth": ["elizabeth"], "bill": ["william"], "billy": ["william"], "bob": ["robert"], "bobby": ["robert"],
    "cathy": ["catherine"], "charlie": ["charles"], "chris": ["christopher", "christine"], "chuck": ["charles"], "dan": ["daniel"], "danny": ["daniel"], "dave": ["david"], "deb": ["deborah"], "debbie": ["deborah"],
    "dick": ["richard"], "dima": ["dmitri"], "ed": ["edward"], "eddie": ["edward"], "fran": ["frances", "francis"], "fred": ["frederick"], "greg": ["gregory"],
    "jack": ["john"], "jake": ["jacob"], "jen": ["jennifer"], "jenny": ["jennifer"], "jim": ["james"], "jimmy": ["james"], "joe": ["joseph"], "joey": ["joseph"], "jon": ["jonathan"],
    "kate": ["katherine"], "kathy": ["katherine"], "katie": ["katherine"], "ken": ["kenneth"], "kenny": ["kenneth"], "larry": ["lawrence"], "liz": ["elizabeth"], "maggie": ["margaret"], "matt": ["matthew"],
    "meg": ["margaret"], "mike": ["michael"], "mick": ["michael"], "misha": ["mikhail"], "nick": ["nicholas"], "pat": ["patrick", "patricia"], "patty": ["patricia"],
    "peggy": ["margaret"], "pepe": ["jose"], "pete": ["peter"], "phil": ["philip"], "ray": ["raymond"], "ren": ["rene", "renee"], "rich": ["richard"], "rick": ["richard"], "rob": ["robert"], "ron": ["ronald"], "sam": ["samuel", "samantha"],
    "sasha": ["aleksandra", "alexander"], "steve": ["stephen", "steven"], "sue": ["susan"], "susie": ["susan"], "ted": ["edward", "theodore"], "tim": ["timothy"], "tom": ["thomas"], "tommy": ["thomas"],
    "trish": ["patricia"], "vic": ["victor"], "vicky": ["victoria"], "will": ["william"], "zach": ["zachary"], "zack": ["zachary"],
}
# Letters that decomposition doesn't fold, and words of organisations in full.
LETTERS = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ð": "d", "þ": "th", "ı": "i"})
TITLES = {"dr", "prof", "mr", "mrs", "ms", "mx", "dipl", "ing", "phd", "jr", "sr", "msc"}
WORDS = {"bld": "build", "buildfarm": "build farm", "build-farm": "build farm", "testing": "test", "eng": "engineering", "engg": "engineering", "rel": "release", "releng": "release engineering", "lab": "laboratory", "labs": "laboratory", "dept": "department", "grp": "group", "mgmt": "management", "dev": "development", "ops": "operations"}
FILLERS = {"team", "the", "of", "and"}
#: A sign between letters, or beside letters beyond ASCII, is a letter that was lost in decoding.
LOST, UNKNOWN = re.compile(r"(?<=\w)[^\w\s!-/:-@\[-`{-~’‘“”–—]+(?=\w)"), "\u02bc"
ADDRESS = re.compile(r"<?([^<>\s,;\"']+@[^<>\s,;\"']+?)>?\s*$")
MISREAD = ["cp1252", "latin-1", "cp437", "cp850", "cp1250", "cp1251", "cp866", "mac_roman", "gbk", "iso8859-2"]


def fold(text: str) -> str:
    """Lower case without diacritics; other scripts stay."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(LETTERS)) if not unicodedata.combining(c)).lower()


def _readable(name: str) -> str:
    """A name of which the UTF-8 bytes were read in another character set, put right."""
    for _ in range(2):
        for wrong in MISREAD:
            try:
                back = name.encode(wrong).decode("utf-8")
            except UnicodeError:
                continue
            if back != name:
                name = back
                break
        else:
            return name
    return name


def parse(text: str) -> dict:
    """address, name tokens (sorted, folded), initials, and the words of the address of one sender text."""
    text = unicodedata.normalize("NFC", text)
    m = ADDRESS.search(text)
    address = m.group(1).lower() if m else ""
    local, _, domain = address.partition("@")
    local = local.split("+")[0]
    name = _readable(text[: m.start()] if m else text)
    name = re.sub(r"\([^)]*\)|'[^']*'|\[[^\]]*\]", " ", name.replace("’", "'"))
    first, comma, _ = name.partition(",")
    if comma and len(first.split()) > 1:  # a firm after the name, not a given name after a family name
        name = first
    name = LOST.sub(UNKNOWN, fold(name))
    words = [w for w in re.findall(r"[^\W_]+(?:-[^\W_]+)*", name) if w not in TITLES]
    words = [x for w in words for x in WORDS.get(w, w).split() if x not in FILLERS]
    long = sorted(w for w in words if len(w) > 1)
    return {"address": f"{local}@{domain}" if local else "", "tokens": long, "initials": sorted(w for w in words if len(w) == 1), "local": fold(local), "host": domain.split(".")[0]}


def expansions(tokens: list[str]) -> list[list[str]]:
    """The token lists with short forms written out, the given one first."""
    out = [tokens]
    for k, t in enumerate(tokens):
        out += [sorted([*tokens[:k], full, *tokens[k + 1 :]]) for full in SHORT_FORMS.get(t, [])]
    return out


def near(a: str, b: str) -> bool:
    """Whether two different words are one insertion, deletion, substitution or swap apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k + 2 :] == b[k + 2 :] and a[k : k + 2] == b[k : k + 2][::-1])
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


class Trie:
    """Words of one shard; `walk` moves the Levenshtein automaton of a word through it."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, value: str) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(value)

    def walk(self, word: str, bound: int = 2) -> Iterator[str]:
        """Values of the words within a Levenshtein distance (a swap counts 2).

        A state is the row of distances at one depth, cut to the band of 2 * bound + 1 places around the diagonal: band[k]
        belongs to place depth + k - bound of the word. Beyond the band every distance is over the bound.
        """
        n, far = len(word), bound + 1
        stack = [(self.root, 0, [k - bound if k >= bound else far for k in range(2 * bound + 1)])]
        while stack:
            node, depth, band = stack.pop()
            if "" in node and abs(n - depth) <= bound and band[n - depth + bound] <= bound:
                yield from node[""]
            at = depth - bound  # the place before the one that band[0] takes in the next row
            for c, child in node.items():
                if c:
                    new, least = [], far
                    for k in range(2 * bound + 1):
                        i = at + k + 1
                        if i < 0 or i > n:
                            new.append(far)
                            continue
                        d = band[k] + (i == 0 or word[i - 1] != c) if i else depth + 1
                        if k < 2 * bound and band[k + 1] < d:
                            d = band[k + 1] + 1
                        if k and new[k - 1] < d:
                            d = new[k - 1] + 1
                        new.append(d)
                        least = min(least, d)
                    if least <= bound:
                        stack.append((child, depth + 1, new))


def one_edit(a: str, b: str) -> bool:
    """Whether two names (tokens joined by blanks, in any order) agree but for one edit in one token of three letters or
    more, or for one edit in each of two tokens of four letters or more."""
    x, y = a.split(), b.split()
    for t in set(x) & set(y):
        for _ in range(min(x.count(t), y.count(t))):
            x.remove(t)
            y.remove(t)
    if len(x) == len(y) == 1:
        return near(x[0], y[0]) and max(len(x[0]), len(y[0])) >= 3
    if len(x) == len(y) == 2:
        return any(near(x[0], p) and near(x[1], q) and min(max(len(x[0]), len(p)), max(len(x[1]), len(q))) >= 4 for p, q in (y, y[::-1]))
    return False


#: Names of one block of a shard.
BLOCK = 2000


def trie_join(shard: pd.DataFrame) -> pd.DataFrame:
    """(a, b): the names of one pair of blocks within one edit, from (rest, name, seeks): names that seek walk the trie of
    the others."""
    trie = Trie()
    for rest, name, seeks in zip(shard["rest"], shard["name"], shard["seeks"], strict=True):
        if not seeks:
            trie.add(rest, name)
    found = set()
    for rest, a, seeks in zip(shard["rest"], shard["name"], shard["seeks"], strict=True):
        if seeks:
            # two words of one edit each are walked as one text
            found |= {(a, b) for b in trie.walk(rest, 4 if " " in rest else 2) if a < b and one_edit(a, b)}
    return pd.DataFrame(sorted(found), columns=["a", "b"])


def halves(word: Column) -> list[Column]:
    """Keys of a word, one of which it shares with any word one edit away: the letters before its middle or those
    after, by its own length and by that of a word one shorter. A swap may lie across the middle, so one letter there
    belongs to neither side. Words of up to four letters share the empty key."""
    n = F.length(word)
    keys = []
    for size in (n, n - 1):
        half = F.floor(size / 2).cast("int")
        long = size >= 4
        keys += [F.when(long, F.concat(F.lit("^"), F.substring(word, F.lit(1), half))), F.when(long, F.concat(F.lit("$"), F.right(word, size - half - 1)))]
    return [*keys, F.when(n <= 4, F.lit("-"))]


def sharded(names: DataFrame) -> DataFrame:
    """(name, rest, shard) of names(name, tokens): names within one edit in one or two of their tokens meet in a shard.

    The shard of one differing token is all other tokens and a key of it; that of two differing ones is all others and a
    key of each. The differing tokens are the rest, which the trie holds.
    """
    each = lambda words: F.array_distinct(F.array_compact(words))
    one = names.select("name", "tokens", F.posexplode("tokens").alias("i", "rest"))
    keys = lambda c: each(F.array(*halves(F.col(c))))
    whole = F.array_join(F.filter("tokens", lambda _, k: k != F.col("i")), " ")
    first = one.select("name", "rest", whole.alias("whole"), F.explode(keys("rest")).alias("key")).select("name", "rest", F.concat_ws("|", F.lit("1"), "whole", "key").alias("shard"))
    two = names.where("size(tokens) >= 2").select("name", "tokens", F.posexplode("tokens").alias("i", "x")).where("length(x) >= 3")
    two = two.select("name", "tokens", "i", "x", F.posexplode("tokens").alias("j", "y")).where("i < j and length(y) >= 3")
    others = F.array_join(F.filter("tokens", lambda _, k: (k != F.col("i")) & (k != F.col("j"))), " ")
    two = two.select("name", "x", "y", others.alias("whole"), F.explode(keys("x")).alias("kx"), keys("y").alias("ky"))
    two = two.select("name", "x", "y", "whole", "kx", F.explode("ky").alias("ky"))
    # an edit of a first letter may change the order of the tokens: the one of the smaller key is written first
    turn = F.col("kx") <= F.col("ky")
    xy, yx = F.concat_ws(" ", "x", "y"), F.concat_ws(" ", "y", "x")
    rest = F.when(F.col("kx") == F.col("ky"), F.array(xy, yx)).when(turn, F.array(xy)).otherwise(F.array(yx))
    second = two.select("name", F.explode(rest).alias("rest"), F.concat_ws("|", F.lit("2"), "whole", F.least("kx", "ky"), F.greatest("kx", "ky")).alias("shard"))
    return first.unionByName(second).distinct()


def neighbours(names: DataFrame, spread: int, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: all pairs of names(name, tokens) that one_edit accepts, by the trie join."""
    shards = cut(sharded(names))
    sizes = shards.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").select("shard", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = shards.join(sizes, "shard").withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sought = rows.select("shard", "name", "rest", F.lit(False).alias("seeks"), F.col("own").alias("trie"), others.alias("seeking"))
    seeking = rows.select("shard", "name", "rest", F.lit(True).alias("seeks"), others.alias("trie"), F.col("own").alias("seeking"))
    # most shards are two names: shards of one task are given to Python together
    both = sought.unionByName(seeking).repartition(spread, "shard", "trie", "seeking").sortWithinPartitions("shard", "trie", "seeking")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None  # a group may go on in the next batch
        for frame in frames:
            frame = frame if kept is None else pd.concat([kept, frame])
            key = list(zip(frame["shard"], frame["trie"], frame["seeking"], strict=True))
            last = key.index(key[-1]) if key else 0
            kept = frame.iloc[last:]
            yield from joined(frame.iloc[:last])
        if kept is not None:
            yield from joined(kept)

    def joined(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        found: set = set()
        key, at = list(zip(frame["shard"], frame["trie"], frame["seeking"], strict=True)), 0
        rest, name, seeks = frame["rest"].tolist(), frame["name"].tolist(), frame["seeks"].tolist()
        for k in range(1, len(key) + 1):
            if k == len(key) or key[k] != key[at]:
                made = trie_join(pd.DataFrame({"rest": rest[at:k], "name": name[at:k], "seeks": seeks[at:k]}))
                found.update(zip(made["a"], made["b"], strict=True))
                at = k
        yield pd.DataFrame(sorted(found), columns=["a", "b"])

    return both.mapInPandas(run, "a string, b string").distinct()


#: Up to so many edges are solved by one task, in some hundred megabytes.
FEW = 250_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of edges (a, b) by union-find."""
    up: dict[str, str] = {}

    def root(x: str) -> str:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.string()), pa.array([root(x) for x in up], pa.string())], names=["node", "label"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, label) of undirected edges (a, b); the label is the smallest node of the component.

    Contraction: in each round every node goes over to the node of the smallest hash among itself and its neighbours, with
    other hashes in every round; edges within a node vanish, so the edges and nodes of a round are a fraction of those of
    the round before, and nothing that is settled is joined again. What is small enough is solved in one task.
    """
    edges = cut(edges.where("a <> b").select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    labels = None  # node -> what it has become
    left = edges.count()
    turn = 0
    while left > few:
        order = lambda c: F.xxhash64(F.lit(turn), c)  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(F.struct(order(F.col("b")), F.col("b").alias("n"))).alias("m"))
        step = cut(step.select(F.col("a").alias("old"), F.when(F.struct(order(F.col("a")), F.col("a").alias("n")) < F.col("m"), F.col("a")).otherwise(F.col("m.n")).alias("new")))
        moved = edges.join(step, F.col("a") == F.col("old")).select(F.col("new").alias("a"), "b").join(step, F.col("b") == F.col("old")).select("a", F.col("new").alias("b"))
        edges = cut(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if labels is None:
            labels = step.select(F.col("old").alias("node"), F.col("new").alias("label"))
        else:
            labels = cut(labels.join(step, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")))
        left, turn = edges.count(), turn + 1
    rest = edges.coalesce(1).mapInArrow(_united, "node string, label string")
    if labels is None:
        return rest
    whole = labels.join(rest.select(F.col("node").alias("label"), F.col("label").alias("end")), "label", "left").select("node", F.coalesce("end", "label").alias("end"))
    whole = cut(nodes.join(whole, "node"))
    least = whole.groupBy("end").agg(F.min("node").alias("label"))
    return whole.join(least, "end").select("node", "label")


PARSED = "sender string, address string, name string, tokens array<string>, initials array<string>, local string, host string, expanded array<string>"


def _parse_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for sender in batch.column(0).to_pylist():
            p = parse(sender)
            rows.append({"sender": sender, "address": p["address"], "name": " ".join(p["tokens"]), "tokens": p["tokens"], "initials": p["initials"], "local": p["local"], "host": p["host"], "expanded": [" ".join(x) for x in expansions(p["tokens"])]})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("sender", pa.string()), ("address", pa.string()), ("name", pa.string()), ("tokens", pa.list_(pa.string())), ("initials", pa.list_(pa.string())), ("local", pa.string()), ("host", pa.string()), ("expanded", pa.list_(pa.string()))]))


#: The rules that draw edges; each can be left out to measure what it brings.
RULES = ("address", "tokens", "trie", "short", "stem", "initial", "spelled")


def link(emails: DataFrame, column: str = "from_email", rules: Collection[str] = RULES) -> DataFrame:
    """(sender, entity): each distinct non-null text of the column with the smallest key of its sender.

    Blank texts are one spelling of nobody and stand alone. Rows and ties don't matter, only distinct texts. A single
    token names nobody (many have the same given name); texts that have no more are linked by their address. Extra
    columns are not read; an empty table gives an empty one.
    """
    texts = emails.select(F.col(column).alias("sender")).where(F.col("sender").isNotNull() & (F.trim("sender") != "")).distinct()
    # texts and shards are small, so the number of tasks is given: by size they would all go into a few
    spread = max(2, int(emails.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = cut(texts.repartition(spread).mapInArrow(_parse_all, PARSED))
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    edge = lambda df, a, b: df.select(a.alias("a"), b.alias("b"))
    sender, address, full = node("s", F.col("sender")), node("a", F.col("address")), node("n", F.col("name"))
    addressed, named = known.where("address <> ''"), known.where("size(tokens) >= 2")
    names = cut(named.groupBy("name").agg(F.first("tokens").alias("tokens"), F.first("expanded").alias("expanded"), F.collect_set(F.concat("local", F.lit("@"), "host")).alias("addresses")))

    # names within one edit, unless their differing words are each spelled by an address of their own: two senders
    of = lambda c: names.select(F.col("name").alias(c), F.col("addresses").alias(f"at_{c}"))
    differing = lambda x, y: F.filter(F.array_except(F.split(x, " "), F.split(y, " ")), lambda w: F.length(w) >= 4)
    spelt = lambda c: F.exists(f"in_{c}", lambda w: F.exists(f"at_{c}", lambda x: F.contains(x, w)))

    def one_sender(found: DataFrame) -> DataFrame:
        judged = found.join(of("a"), "a").join(of("b"), "b").withColumns({"in_a": differing("a", "b"), "in_b": differing("b", "a")})
        return judged.where(~F.coalesce(spelt("a") & spelt("b"), F.lit(False)) | F.arrays_overlap("at_a", "at_b")).select("a", "b")

    typed = one_sender(cut(neighbours(names, spread))) if "trie" in rules else names.select(F.col("name").alias("a"), F.col("name").alias("b")).limit(0)
    typed = cut(typed)
    # forms that answer to one full name: expanded short forms, initials with a surname, addresses that spell a name; the
    # spellings of a name that the trie join has linked count as one
    same = components(typed).select(F.col("node").alias("name"), "label")
    names = cut(names.join(same, "name", "left").withColumn("label", F.coalesce("label", "name")))
    plain = names.where(F.size("tokens") == 2).select("name", "label", F.col("tokens")[0].alias("x"), F.col("tokens")[1].alias("y"))
    either = plain.select("name", "label", F.col("x").alias("given"), F.col("y").alias("family")).unionByName(plain.select("name", "label", F.col("y").alias("given"), F.col("x").alias("family")))
    short = names.select(F.col("name").alias("form"), F.explode(F.expr("slice(expanded, 2, size(expanded))")).alias("name")).join(names.select("name", "label"), "name")
    # two names of one family of which one given name is short and begins as the other does, and no third begins so
    stems = either.withColumn("size", F.length("given")).where("length(family) >= 4")
    stem = lambda n: stems.where(F.col("size") >= n).groupBy("family", F.substring("given", 1, n).alias("stem")).agg(F.count_distinct("label").alias("n"), F.min(F.struct("size", "label", "name")).alias("form"), F.max(F.struct("size", "label", "name")).alias("whole")).where("n = 2 and form.label <> whole.label and form.size < whole.size")
    cuts = stem(3).where("form.size <= 5").unionByName(stem(2).where("form.size = 2")).select(F.col("form.name").alias("a"), F.col("whole.name").alias("b"))
    initial = known.where("size(tokens) = 1 and size(initials) >= 1").select("sender", F.col("tokens")[0].alias("family"), F.explode("initials").alias("first")).join(either.withColumn("first", F.substring("given", 1, 1)), ["family", "first"])
    spelled = either.select("name", "label", F.explode(F.array(F.concat("given", "family"), F.concat_ws(".", "given", "family"), F.concat_ws("_", "given", "family"), F.concat_ws("-", "given", "family"))).alias("local"))
    spelled = addressed.select("address", "local").distinct().join(spelled, "local")
    once = lambda df, key: df.groupBy(key).agg(F.count_distinct("label").alias("n"), F.min("name").alias("name")).where("n = 1")
    drawn = {
        "address": edge(addressed, sender, address),
        "tokens": edge(named, sender, full),
        "trie": edge(typed, node("n", F.col("a")), node("n", F.col("b"))),
        "short": edge(once(short, "form"), node("n", F.col("form")), full),
        "stem": edge(one_sender(cuts), node("n", F.col("a")), node("n", F.col("b"))),
        "initial": edge(once(initial, "sender"), sender, full),
        "spelled": edge(once(spelled, "address"), address, full),
    }
    labels = components(reduce(DataFrame.unionByName, [drawn[r] for r in rules]))
    return labels.where(F.col("node").startswith("s:")).select(F.expr("substr(node, 3)").alias("sender"), F.col("label").alias("entity"))


def pairs(linked: DataFrame) -> DataFrame:
    """(sender_a, sender_b), sender_a < sender_b: the spellings of each sender in pairs."""
    b = linked.select(F.col("sender").alias("sender_b"), F.col("entity"))
    return linked.select(F.col("sender").alias("sender_a"), "entity").join(b, "entity").where("sender_a < sender_b").select("sender_a", "sender_b")
