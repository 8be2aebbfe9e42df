"""Keyword-stuffed pages and link lists, by pointwise mutual information and repeated collocations.

Texts are cut into paragraphs and words. Over the whole corpus each pair of neighbouring words has its number of
occurrences and its number of documents, and each word its number as left and as right neighbour. From these counts a
paragraph gets two means over its neighbours:

* pmi, the pointwise mutual information: a salad of words that don't belong together has a low one;
* burst, the log of occurrences per document: collocations that come again and again within pages have a high one.

A paragraph is of that sort if its pmi is below SALAD of the mean over all neighbours of the corpus, or if burst is more
than REPEATED of its pmi, which is the part of the association that repetition within documents explains. A document is flagged if more than half of its characters
lie in such paragraphs. Paragraphs of which half the lines have the form of logs, settings, patches, trailers, test
output or name lists are the exact check: they have no words, whatever their counts.

Every paragraph of two words or more is judged and every pair of words counts, however rare. Pairs are counted from
partial sums. The only table broadcast is that of pairs more frequent than 1/WARM of all incidences of a pair in a
paragraph, so it has less than WARM rows; all others are joined by shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.tables import cut

STRUCTURED = re.compile(
    r"^\s*(?:\[\s*\d+\.\d+\]|(?:# )?CONFIG_|(?:not )?ok \d+|TAP version|1\.\.\d+|[A-Z]:\s|[+\-] ?\t|[+\-@]{2}|[+-](?! )|diff --git|index [0-9a-f]+"
    r"|[*\-•]?\s*<?https?://[^\s/]+/(?:\w{1,2}/)?[0-9a-f]{6,}/?>?\s*$|[A-Z][a-z]+(?:-[A-Za-z]+)*-by:|(?:Cc|Fixes|Link|From|Subject|Date|To):|\S[^\n]*\(\d+\):$|\[\d+\]:?\s)"
)
WORD = re.compile(r"[぀-ヿ㐀-鿿]+|[^\W\d_]+(?:[’'][^\W\d_]+)?")
IDENTIFIER = re.compile(r"\b\w*[a-z0-9]_\w+(?:\(\))?|\b(?:[a-z]+/)+[\w.-]+\.(?:c|h|S|rst)\b|\b[0-9a-f]{7,40}\b|\b0x[0-9a-f]+")
UNSPACED = re.compile(r"[぀-ヿ㐀-鿿]")
#: Documents turned into words at a time, and how many different tokens a task remembers the words of.
SLICE, REMEMBERED = 256, 200_000
#: A pair is broadcast if it has more than 1/WARM of all incidences, so less than WARM pairs are.
WARM = 100_000
#: Below this part of the corpus's mean PMI a paragraph is a salad; above this part of its own PMI repetition is excessive.
SALAD, REPEATED = 0.5, 0.07
#: Occurrences and documents that every pair is given beside its own, so that rare pairs show no repetition.
PRIOR = 5.0


def words_of(text: str) -> list[str]:
    """Lower-case words without identifiers, hashes and paths; scripts without blanks give pairs of characters."""
    out: list[str] = []
    for w in WORD.findall(IDENTIFIER.sub(" ", text)):
        w = w.lower()
        if not w.isascii() and not (w.isalpha() and unicodedata.is_normalized("NFKC", w)):
            continue  # odd characters are no words
        out += [w[i : i + 2] for i in range(max(1, len(w) - 1))] if UNSPACED.match(w) else [w]
    return out


class Words(dict):
    """The hashes of the words of each token between blanks; forgotten when too many."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        made = self[token] = tuple(xxhash.xxh64_intdigest(w) - (1 << 63) for w in words_of(token))
        return made


def paragraphs(text: str, words: Words) -> Iterator[tuple[int, Counter]]:
    """(characters, pairs of neighbouring words) of each paragraph; no pairs where structured."""
    for p in re.split(r"\n\s*\n", text):
        tokens = p.split()
        if not tokens:
            continue
        lines = [x for x in p.split("\n") if x and not x.isspace()]
        if 2 * sum(STRUCTURED.match(x) is not None for x in lines) >= len(lines):
            yield sum(map(len, tokens)), Counter()
        else:
            near = [h for t in tokens for h in words[t]]
            yield sum(map(len, tokens)), Counter(zip(near, near[1:], strict=False))


#: One array a field: an array of structs takes more than twice the room. k is negative in the first paragraph of a
#: document with the pair.
PARAGRAPH = "doc_id bigint, para int, chars bigint, a array<bigint>, b array<bigint>, k array<int>"


def cut_texts(docs: DataFrame) -> DataFrame:
    """The paragraphs of all texts with their distinct pairs, how often each stands there and whether it is the first
    paragraph of the document with it; null and blank texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids, paras, chars, sizes = [], [], [], []
                left, right, k = [], [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    seen: set = set()
                    for i, (n, pairs) in enumerate(paragraphs(text, words) if text else ()):
                        ids.append(doc)
                        paras.append(i)
                        chars.append(n)
                        sizes.append(len(pairs))
                        left += [x for x, _ in pairs]
                        right += [y for _, y in pairs]
                        k += [n if x in seen else -n for x, n in pairs.items()]
                        seen.update(pairs)
                starts = pa.array([0, *accumulate(sizes)], pa.int32())
                lists = [pa.ListArray.from_arrays(starts, pa.array(v, kind)) for v, kind in ((left, pa.int64()), (right, pa.int64()), (k, pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paras, pa.int32()), pa.array(chars, pa.int64()), *lists], names=["doc_id", "para", "chars", "a", "b", "k"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PARAGRAPH)


def pairs_of() -> Column:
    """The pairs of a paragraph as rows (a, b, k)."""
    return F.inline(F.arrays_zip("a", "b", "k"))


def collocations(paras: DataFrame) -> DataFrame:
    """(a, b, n, occ, pmi, burst) of every pair of neighbouring words of the corpus; n is its number of paragraphs.

    The counts of words are sums over the table of pairs, which is much smaller than the corpus; a frequent word is
    summed before the shuffle, and its rows in the joins are left to AQE's splitting of skewed partitions.
    """
    pair = paras.select(pairs_of()).groupBy("a", "b").agg(F.sum(F.abs("k")).alias("occ"), F.count_if(F.col("k") < 0).alias("docs"), F.count("*").alias("n"))
    pair = cut(pair)
    left = pair.groupBy("a").agg(F.sum("occ").alias("na"))
    right = pair.groupBy("b").agg(F.sum("occ").alias("nb"))
    total = pair.agg(F.sum("occ")).first()[0] or 1
    pmi = F.log("occ") + F.log(F.lit(float(total))) - F.log("na") - F.log("nb")
    burst = F.log((F.col("occ") + PRIOR) / (F.col("docs") + PRIOR))
    return pair.join(left, "a").join(right, "b").select("a", "b", "n", "occ", pmi.alias("pmi"), burst.alias("burst"))


def means(paras: DataFrame) -> DataFrame:
    """(doc_id, para, chars, pmi, burst, usual): the means over the neighbours of each paragraph that has two words or
    more; usual is the mean pmi over all neighbours of the corpus."""
    known = cut(collocations(paras))
    incidences, usual = known.agg(F.sum("n"), F.sum(F.col("pmi") * F.col("occ")) / F.sum("occ")).first()
    incidences, usual = incidences or 1, usual or 0.0
    warm = F.col("n") > incidences / WARM
    hot = F.broadcast(known.where(warm).select("a", "b", F.col("pmi").alias("hot_pmi"), F.col("burst").alias("hot_burst")))
    tried = paras.select("doc_id", "para", "chars", pairs_of()).withColumn("k", F.abs("k")).join(hot, ["a", "b"], "left")
    sums = lambda df, pmi, burst: df.groupBy("doc_id", "para", "chars").agg(F.sum(F.col("k") * F.col(pmi)).alias("up"), F.sum(F.col("k") * F.col(burst)).alias("again"), F.sum("k").alias("k"))
    cold = tried.where("hot_pmi is null").select("doc_id", "para", "chars", "a", "b", "k").join(known.where(~warm).select("a", "b", "pmi", "burst"), ["a", "b"])
    both = sums(tried.where("hot_pmi is not null"), "hot_pmi", "hot_burst").unionByName(sums(cold, "pmi", "burst"))
    return both.groupBy("doc_id", "para", "chars").agg((F.sum("up") / F.sum("k")).alias("pmi"), (F.sum("again") / F.sum("k")).alias("burst"), F.lit(usual).alias("usual"))


def kinds(docs: DataFrame) -> DataFrame:
    """(doc_id, chars, bad_chars, salad_chars, share): every document with text, how much of it is of that sort, and how
    much of that by a low PMI.

    Null, empty and blank texts have no row. Repeated texts each count, and count in the corpus as often as they
    occur. doc_id must be unique. Extra columns are not read; an empty table gives an empty one.
    """
    paras = cut(cut_texts(docs))
    salad, repeated = F.col("pmi") < SALAD * F.col("usual"), F.col("burst") > REPEATED * F.col("pmi")
    chars = lambda when: F.when(when, F.col("chars")).otherwise(0)
    none = F.lit(0).cast("bigint")
    found = means(paras).where(salad | repeated).select("doc_id", none.alias("chars"), F.col("chars").alias("bad_chars"), chars(salad).alias("salad_chars"))
    rows = paras.select("doc_id", "chars", none.alias("bad_chars"), none.alias("salad_chars")).unionByName(found)
    summed = rows.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("chars", "bad_chars", "salad_chars")))
    return summed.withColumn("share", F.col("bad_chars") / F.col("chars"))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, chars, bad_chars, share) of every document with text; see kinds."""
    return kinds(docs).drop("salad_chars")
