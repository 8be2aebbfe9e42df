"""Encoding of a corpus with a public byte-level BPE tokenizer.

Texts are split by the tokenizer's pattern; each distinct word is encoded once per Python worker. A short word is a
contiguous array of part boundaries with the rank of each adjacent pair: the array is scanned for its minimum, that
boundary is deleted, and the two neighbouring ranks are refreshed, until no pair has a rank. A long word (more bytes
than SHORT, such as a text without blanks) takes the same merges in the same order from a heap, so that very long
texts cost n log n instead of n squared.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The splitting pattern of the tokenizer's vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHORT = 128
#: Words remembered by one worker; the memory is emptied when full, results don't depend on it.
REMEMBERED = 300_000
NEVER = 1 << 60

_loaded: dict[int, tuple[dict[bytes, int], dict[str, list[int]]]] = {}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a short word, from a contiguous array of boundaries and adjacent ranks."""
    cuts = list(range(len(word) + 1))
    pair = [ranks.get(word[i : i + 2], NEVER) for i in range(len(word) - 1)]
    while pair and (least := min(pair)) != NEVER:
        i = pair.index(least)
        del cuts[i + 1], pair[i]
        if i < len(pair):
            pair[i] = ranks.get(word[cuts[i] : cuts[i + 2]], NEVER)
        if i:
            pair[i - 1] = ranks.get(word[cuts[i - 1] : cuts[i + 1]], NEVER)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids with a heap of (rank, place) and linked parts."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # `after` is the end of the part that begins at an index
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, width = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or after[j] - i != width:
            continue
        end = after[i] = after[j]
        alive[j] = 0
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end] - i))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end - p))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    if (whole := ranks.get(word)) is not None:
        return [whole]
    return merge_short(word, ranks) if len(word) <= SHORT else merge_long(word, ranks)


def read_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}


def encoder(vocabulary: bytes) -> Callable[[str], list[int]]:
    """The encoding of a text by a vocabulary file; a worker reads the same file once."""
    import regex

    split = regex.compile(PATTERN).findall
    key = hash(vocabulary)
    if key not in _loaded:
        _loaded[key] = read_ranks(vocabulary), {}
    ranks, known = _loaded[key]

    def encode(text: str) -> list[int]:
        ids: list[int] = []
        for word in split(text):
            if (found := known.get(word)) is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = encode_word(word.encode("utf-8", "surrogatepass"), ranks)
                if len(word) <= SHORT:
                    known[word] = found
            ids += found
        return ids

    return encode


def _vocabulary(df: DataFrame, tokenizer: str):
    """The file (about 1 MB, a fixed size) for the workers; read on the driver, so that no worker needs the path."""
    with open(tokenizer, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, ids): the token ids of each row's text, without special tokens.

    A null text and an empty one have the ids []. Strings of special tokens in a text are ordinary text. Rows are
    neither dropped nor merged; other columns are not read. An empty table gives an empty one.
    """
    sent = _vocabulary(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_ = encoder(sent.value)
        for batch in batches:
            ids = pa.array([encode_(x) if x else [] for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, to: str = "tokens") -> DataFrame:
    """df with the number of tokens of a text; 0 for null and empty texts. A column of that name is replaced."""
    sent = _vocabulary(df, tokenizer)

    @F.pandas_udf("bigint")
    def size(texts):  # noqa: ANN001, ANN202
        encode_ = encoder(sent.value)
        return texts.map(lambda x: len(encode_(x)) if x else 0)

    size.__annotations__ = {}
    return df.withColumn(to, size(F.col(text)))
