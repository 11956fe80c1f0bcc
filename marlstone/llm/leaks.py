"""Passages of held-out test items inside a training corpus.

The items form a BM25 index over runs of five words: posting lists in the order of the items, in blocks with the greatest
impact of each. Every passage of every document is a query, answered by block-max WAND: lists advance item by item; the
lists' greatest impacts find the next item that can reach its threshold at all, the blocks' greatest impacts skip what
can't, and only what is left is scored in full. Impacts are given as shares of the item's own threshold, the least that any
of its leaks can score, so retrieval loses none. What is retrieved is verified word by word, exactly: a stretch of the item
within its edit distance must be in that passage.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.words import words
from marlstone.session import cut_lineage

#: Consecutive words of the item that a leak has at least, and of how many words one may be edited.
STRETCH, ONE_EDIT_IN = 25, 8
#: Words of the longest leak that holds no shorter one: of two parts of STRETCH words or more, one has no more than its
#: share of the edits.
LONGEST = 2 * STRETCH - 1
#: Words in a row that a leak has unedited at the least: its edits can't part the other words into shorter runs.
ANCHOR = min(-(-(n - n // ONE_EDIT_IN) // (n // ONE_EDIT_IN + 1)) for n in range(STRETCH, LONGEST + 1))
#: Words of a passage, and from one passage's start to the next: any leak of LONGEST words and its added words lies in one.
PASSAGE, STEP = 112, 56
assert PASSAGE - STEP + 1 >= LONGEST + LONGEST // ONE_EDIT_IN
#: Words of a term. Single words can't tell texts of one subject apart; a leak keeps an unedited run of ANCHOR words.
GRAM = 5
assert GRAM <= ANCHOR
#: BM25 parameters.
K1, B = 1.2, 0.75
#: Postings in a block.
BLOCK = 64
#: A score that reaches the threshold; a little less than 1, for sums in single precision.
REACHED = 1 - 1e-4
#: Characters of items that one index holds, about 6 bytes of memory each; so much is broadcast at most.
INDEX_CHARS = 64_000_000
#: Characters of documents that a task compares at a time, and of the items whose thresholds are worked out at a time.
BATCH_CHARS = 2_000_000


@dataclass
class ItemIndex:
    """vocabulary: word -> 1, 2, ...; terms: sorted codes of GRAM words; sequences: word numbers of the items one after another.

    The postings of term t are item[start[t] : start[t + 1]] and gain[...], its greatest gain upper[t]; its blocks are
    last[block[t] : block[t + 1]], the last item of each, and most[...], the greatest gain of each.
    """

    item_ids: list[int]
    sequences: np.ndarray
    bounds: np.ndarray
    vocabulary: dict[str, int]
    terms: np.ndarray
    start: np.ndarray
    item: np.ndarray
    gain: np.ndarray
    upper: np.ndarray
    block: np.ndarray
    last: np.ndarray
    most: np.ndarray
    #: The lists as wand reads them, one number at a time; made where they are read.
    views: tuple[memoryview, ...] | None = None

    @classmethod
    def build(cls, items: Sequence[tuple[int, str]]) -> ItemIndex:
        vocabulary: dict[str, int] = {}
        ids, sequences = [], []
        for item_id, text in items:
            found = words(text)
            if len(found) >= STRETCH:  # a shorter item can't have a leak
                ids.append(item_id)
                sequences.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in found], np.int32))
        grams = [codes(s) for s in sequences]
        lengths = np.array([len(g) for g in grams], np.int64)
        every = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        terms, term = np.unique(every, return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), lengths)
        # (term, item) pairs with their frequency, by term and then item
        pairs, pair_of, tf = np.unique(term * max(1, len(ids)) + owner, return_inverse=True, return_counts=True)
        term_of, item_of = pairs // max(1, len(ids)), pairs % max(1, len(ids))
        frequency = np.bincount(term_of, minlength=len(terms))
        idf = np.log1p((len(ids) - frequency + 0.5) / (frequency + 0.5))
        mean = lengths.mean() if len(ids) else 1.0
        gain = idf[term_of] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item_of] / mean))
        ends = np.cumsum(lengths)
        impacts = np.split(gain[pair_of], ends[:-1]) if len(ids) else []
        gain = (gain / thresholds(impacts)[item_of]).astype(np.float32) if len(ids) else gain.astype(np.float32)
        start = np.concatenate([[0], np.cumsum(frequency)]).astype(np.int64)
        upper = np.maximum.reduceat(gain, start[:-1]) if len(terms) else np.empty(0, np.float32)
        blocks = -(-frequency // BLOCK)
        block = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
        begin = np.repeat(start[:-1], blocks) + (np.arange(block[-1]) - np.repeat(block[:-1], blocks)) * BLOCK
        end = np.minimum(begin + BLOCK, np.repeat(start[1:], blocks))
        most = np.maximum.reduceat(gain, begin) if len(begin) else np.empty(0, np.float32)
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sequences])]).astype(np.int64)
        sequence = np.concatenate(sequences) if sequences else np.empty(0, np.int32)
        last = item_of[end - 1].astype(np.int32) if len(end) else np.empty(0, np.int32)
        return cls(ids, sequence, bounds, vocabulary, terms, start, item_of.astype(np.int32), gain, upper, block, last, most)

    def lists(self) -> tuple[memoryview, ...]:
        if self.views is None:
            self.views = tuple(memoryview(a) for a in (self.start, self.item, self.gain, self.block, self.last, self.most, self.upper))
        return self.views

    def sequence(self, i: int) -> np.ndarray:
        return self.sequences[self.bounds[i] : self.bounds[i + 1]].astype(np.int64)

    def numbers(self, found: list[str]) -> np.ndarray:
        """Word numbers; 0 for a word that no item has."""
        number = self.vocabulary.get
        return np.fromiter(map(number, found, repeat(0)), np.int64, len(found))

    def term_numbers(self, sequence: np.ndarray) -> np.ndarray:
        """The term at each place; len(terms) where there is none."""
        code = codes(sequence)
        at = np.minimum(np.searchsorted(self.terms, code), len(self.terms) - 1)
        return np.where(self.terms[at] == code, at, len(self.terms))


def codes(sequence: np.ndarray) -> np.ndarray:
    """Codes of GRAM words in a row, from their numbers; 0 where a word is unknown (number 0).

    Equal words give equal codes. Should different ones ever do so, a passage scores more, and is verified.
    """
    n = len(sequence) - GRAM + 1
    if n < 1:
        return np.empty(0, np.uint64)
    known = np.ones(n, bool)
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(GRAM):
            word = sequence[i : n + i].astype(np.uint64)
            known &= word > 0
            code = (code + word) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(32)
    return np.where(known, code | np.uint64(1), np.uint64(0))


def _least_scores(impacts: list[np.ndarray], stretch: int) -> np.ndarray:
    """Of each item the least score of a leak of `stretch` words: each edit spoils GRAM terms in a row, the dearest ones."""
    width, edits = stretch - GRAM + 1, stretch // ONE_EDIT_IN
    windows = [np.lib.stride_tricks.sliding_window_view(g, min(width, len(g))) for g in impacts]
    columns = np.zeros((width, sum(len(w) for w in windows)))  # a window a column, shorter ones padded
    first = np.concatenate([[0], np.cumsum([len(w) for w in windows])[:-1]]).astype(np.int64)
    for at, w in zip(first, windows, strict=True):
        columns[: w.shape[1], at : at + len(w)] = w.T
    sums = np.concatenate([np.zeros((1, columns.shape[1])), np.cumsum(columns, axis=0)])
    spoilt = np.zeros((width + 1, columns.shape[1]))
    for _ in range(edits):
        more = np.zeros_like(spoilt)
        for i in range(1, width + 1):
            j = max(0, i - GRAM)
            more[i] = np.maximum(more[i - 1], spoilt[j] + sums[i] - sums[j])
        spoilt = more
    return np.minimum.reduceat(sums[-1] - spoilt[-1], first)


def least_score(impacts: np.ndarray, stretch: int = STRETCH) -> float:
    return float(_least_scores([impacts], stretch)[0])


def thresholds(impacts: list[np.ndarray]) -> np.ndarray:
    """The least that a leak of any allowed length scores. With each further edit a leak may be longer; of the lengths that
    bear as many edits the shortest scores least.
    """
    out = np.full(len(impacts), np.inf)
    lengths = [STRETCH, *range((STRETCH // ONE_EDIT_IN + 1) * ONE_EDIT_IN, LONGEST + 1, ONE_EDIT_IN)]
    sizes = np.cumsum([len(g) for g in impacts])
    for some in np.split(np.arange(len(impacts)), np.searchsorted(sizes, np.arange(100_000, sizes[-1] if len(sizes) else 0, 100_000))):
        for stretch in lengths:
            long = [i for i in some if len(impacts[i]) >= stretch - GRAM + 1]
            if long:
                out[long] = np.minimum(out[long], _least_scores([impacts[i] for i in long], stretch))
    return out


def wand(index: ItemIndex, terms: list[int], times: list[int]) -> list[int]:
    """The items whose score reaches their threshold, for a query of distinct terms and how often each occurs."""
    start, item, gain, block, last, most, greatest = index.lists()
    upper = [greatest[t] * n for t, n in zip(terms, times, strict=True)]
    cursors = sorted((item[start[t]], start[t], k) for k, t in enumerate(terms))
    found = []

    def advance(some: list[tuple[int, int, int]], target: int) -> list[tuple[int, int, int]]:
        """The cursors moved to the first item from `target` on; those without one are dropped."""
        out = []
        for at, place, k in some:
            if at < target:
                end = start[terms[k] + 1]
                place = place + 1 if place + 1 == end else bisect_left(item, target, place + 1, end)
                if place == end:
                    continue
                at = item[place]
            out.append((at, place, k))
        return out

    while True:
        reach = 0.0
        for pivot, (at, _, k) in enumerate(cursors):  # noqa: B007
            reach += upper[k]
            if reach >= REACHED:
                break
        else:
            return found  # no further item can reach it
        wanted = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == wanted:
            pivot += 1
        upto, rest = cursors[: pivot + 1], cursors[pivot + 1 :]
        bound, beyond = 0.0, rest[0][0] if rest else len(index.item_ids)
        for _, _, k in upto:
            t = terms[k]
            b, end = block[t], block[t + 1]
            if end - b > 1:
                b = bisect_left(last, wanted, b, end)
            elif last[b] < wanted:
                continue
            if b < end:
                bound += most[b] * times[k]
                if last[b] < beyond:
                    beyond = last[b] + 1
        if bound < REACHED:  # no item before `beyond` can reach it either
            moved = advance(upto, max(beyond, wanted + 1))
        elif upto[0][0] == wanted:
            if sum(gain[place] * times[k] for _, place, k in upto) >= REACHED:
                found.append(wanted)
            moved = advance(upto, wanted + 1)
        else:
            moved = advance(upto, wanted)
        cursors = sorted(moved + rest)


def retrieve(index: ItemIndex, documents: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(document, item, words, terms) of every passage that reaches the item's threshold."""
    if not len(index.terms):
        return
    none = len(index.terms)
    width = PASSAGE - GRAM + 1
    # All documents in one row, so far apart that no passage touches two.
    gap = np.zeros(PASSAGE, np.int64)
    row = np.concatenate([gap, *(x for d in documents for x in (d, gap))])
    begins = PASSAGE + np.concatenate([[0], np.cumsum([len(d) + PASSAGE for d in documents])[:-1]])
    terms = index.term_numbers(row)
    reach = np.concatenate([[0.0], np.cumsum(np.append(index.upper, 0)[terms].astype(np.float64))])
    starts = np.arange(0, len(terms) - width + 1, STEP)
    # The first step of WAND for all passages at once: where all lists together don't reach it, there is no pivot.
    for s in starts[reach[starts + width] - reach[starts] >= REACHED - 1e-6].tolist():
        passage = terms[s : s + width]
        known = np.flatnonzero(passage != none)
        asked = Counter(passage[known].tolist())
        items = wand(index, list(asked), list(asked.values()))
        if items:
            owner = int(np.searchsorted(begins, s + known[0], side="right")) - 1
            for i in items:
                yield owner, i, row[s : s + PASSAGE], passage


def _tails(a: list[int], b: list[int], most: int) -> list[int]:
    """For 0, 1, ... words of a, the fewest edits against any beginning of b, while they are at most `most`."""
    above, out, ends = list(range(min(most, len(b)) + 1)), [0], len(b)  # above[j]: edits against j words of b
    for i, x in enumerate(a, 1):
        size, held = min(i + most, ends) + 1, len(above)
        row = [most + 1] * size
        if i <= most:
            row[0] = i
        least = row[0]
        for j in range(max(1, i - most), size):  # farther from the diagonal there are more edits
            edits = above[j - 1]
            if x != b[j - 1]:
                if row[j - 1] < edits:
                    edits = row[j - 1]
                if j < held and above[j] < edits:
                    edits = above[j]
                edits += 1
            row[j] = edits
            if edits < least:
                least = edits
        if least > most:
            break
        out.append(least)
        above = row
    return out


def _runs(places: dict[int, list[int]], terms: np.ndarray, none: int) -> list[tuple[int, int, int]]:
    """Longest common runs of at least GRAM words: (start in passage, start in item, words); places: of each term in the item."""
    diagonals: dict[int, list[int]] = defaultdict(list)
    known = np.flatnonzero(terms != none)
    for p, t in zip(known.tolist(), terms[known].tolist(), strict=True):
        for i in places.get(t, ()):
            diagonals[p - i].append(p)
    runs = []
    for shift, found in diagonals.items():
        begin = last = found[0]
        for p in [*found[1:], None]:
            if p is None or p != last + 1:
                runs.append((begin, begin - shift, last - begin + GRAM))
                begin = p
            last = p
    return runs


def has_stretch(item: np.ndarray, document: np.ndarray, runs: list[tuple[int, int, int]]) -> bool:
    """Whether some stretch of at least STRETCH words of the item is in the document with at most one edit in ONE_EDIT_IN words.

    Some such stretch has at most LONGEST words and a run of ANCHOR unedited ones. To edit nothing where the words agree
    is never dearer, so the stretch may take in that run as far as it goes, and what lies before and after it is
    compared apart.
    """
    edits = LONGEST // ONE_EDIT_IN
    beyond = LONGEST - ANCHOR
    for p, i, n in runs:
        if n < ANCHOR:
            continue
        if n >= STRETCH:
            return True
        if min(i, p + edits) + n + min(len(item) - i - n, len(document) - p - n + edits) < STRETCH:
            continue
        right = _tails(item[i + n : i + n + beyond].tolist(), document[p + n : p + n + beyond + edits].tolist(), edits)
        left = _tails(item[max(0, i - beyond) : i][::-1].tolist(), document[max(0, p - beyond - edits) : p][::-1].tolist(), edits)
        for x, ex in enumerate(left):
            for y, ey in enumerate(right):
                if n + x + y >= STRETCH and ONE_EDIT_IN * (ex + ey) <= n + x + y:
                    return True
    return False


def leaks_of(index: ItemIndex, documents: Sequence[list[str]]) -> list[tuple[int, int]]:
    """(place of the document, item id) of every leak, each once; documents as lists of words."""
    held: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
    hits: set[tuple[int, int]] = set()
    for d, i, passage, terms in retrieve(index, [index.numbers(found) for found in documents]):
        if (d, i) in hits:
            continue
        if i not in held:
            sequence = index.sequence(i)
            places: dict[int, list[int]] = defaultdict(list)
            for at, t in enumerate(index.term_numbers(sequence).tolist()):
                places[t].append(at)
            held[i] = sequence, dict(places)
        sequence, places = held[i]
        if has_stretch(sequence, passage, _runs(places, terms, len(index.terms))):
            hits.add((d, i))
    return sorted((d, index.item_ids[i]) for d, i in hits)


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([" ".join(words(t)) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of about BATCH_CHARS characters at a time, so that a task's memory doesn't grow with the texts' number."""
    for batch in rows:
        ids, texts, chars = [], [], 0
        for at in range(batch.num_rows):
            ids.append(batch.column(0)[at].as_py())
            texts.append(batch.column(1)[at].as_py())
            chars += len(texts[-1])
            if chars >= BATCH_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
        if ids:
            yield ids, texts


def leaks(items: DataFrame, documents: DataFrame, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text", index_chars: int = INDEX_CHARS) -> DataFrame:
    """item_id, doc_id of every document that holds a leak of an item, each pair once.

    * A leak is STRETCH consecutive words of the item or more, of which one in ONE_EDIT_IN may be replaced, dropped or added.
    * Null and empty texts on either side have no words; items with fewer words than STRETCH have no leaks. Null ids are
      left out. Texts are compared whole, whatever their length; equal texts under several ids are cases of their own.
    * One index holds the items up to `index_chars` characters, some 100,000 items, which bounds what is broadcast, and the
      corpus is gone through once. Beyond, items are dealt out to several indexes by a hash; then the corpus is read and
      normalised once and written down, and each index goes through that. What is found doesn't depend on it: an item's
      threshold is the least that its leaks score, whatever the weights are.
    * Either table may be empty and may have other columns.
    """
    spark = documents.sparkSession
    chosen = items.select(items[item_id].cast("bigint").alias("item_id"), items[item_text].alias("text")).filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    corpus = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[doc_text].alias("text")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    schema = "item_id bigint, doc_id bigint"
    chars = chosen.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if not chars:
        return spark.createDataFrame([], schema)
    parts = -(-chars // index_chars)
    if ready := parts > 1:
        corpus = cut_lineage(corpus.mapInArrow(_normalised, "doc_id bigint, text string"))

    def compared(part: int) -> DataFrame:
        some = chosen.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toArrow()  # about index_chars
        index = spark.sparkContext.broadcast(ItemIndex.build(list(zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True))))

        def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, texts in _batches(rows):
                found = leaks_of(index.value, [t.split() if ready else words(t) for t in texts])
                yield pa.record_batch([pa.array([i for _, i in found], pa.int64()), pa.array([ids[d] for d, _ in found], pa.int64())], names=["item_id", "doc_id"])

        return corpus.mapInArrow(find, schema)

    out = compared(0)
    for part in range(1, parts):
        out = out.unionByName(compared(part))
    return out.distinct()
