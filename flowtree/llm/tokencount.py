"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts are cut into pre-tokens by a pattern. The distinct pre-tokens of a batch that have not been counted before are
held as ragged numpy arrays of symbols; in each round every sequence applies its lowest-rank pair, the leftmost of equals, all
sequences at once, until no sequence has a pair left. The symbols that survive are the tokens. A pair's rank is that
of its joined bytes in the vocabulary. Pre-tokens longer than LONG bytes are merged all together in order of rank: their
symbols are arrays linked to their neighbours, and a round applies one rank wherever it stands, touching no other
symbol, so that time follows the length. Should a merge make a pair of a lower rank than its own beside others of its
round, that pre-token is counted again by single merges; vocabularies made by merging in order of rank have no such pair.

The vocabulary is read on the driver, from the path given, and its pair table travels with the tasks.

Defined results: a null text has a null count, an empty text 0. Special tokens are ordinary text. Texts of any length
are counted whole. Rows of a null doc_id and repeated rows are counted like others. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import labelled

#: Production parameters: the vocabulary (token in base64 and rank a line) and the pre-token pattern that it goes with.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes beyond which pre-tokens are merged in linked arrays; characters of text handled at a time; pre-tokens and their characters remembered.
LONG, CHUNK, REMEMBERED, REMEMBERED_CHARS = 256, 1 << 20, 400_000, 16 << 20
_NONE = np.int64(1 << 40)


@dataclass
class Pairs:
    """Sorted keys left << 20 | right with the symbol (rank) that each pair joins to; symbols of single bytes."""

    keys: np.ndarray
    joined: np.ndarray
    bytes: np.ndarray

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        k = (left << np.int64(20)) | right
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.joined[at], _NONE)


def vocabulary(path: str = VOCABULARY) -> Pairs:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    keys, joined = [], []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                keys.append(left << 20 | right)
                joined.append(rank)
    order = np.argsort(keys, kind="stable")
    return Pairs(np.array(keys, np.int64)[order], np.array(joined, np.int64)[order], np.array([ranks[bytes([b])] for b in range(256)], np.int64))


def merged(words: list[bytes], pairs: Pairs) -> np.ndarray:
    """The token count of each pre-token."""
    counts = np.zeros(len(words), np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    long = np.flatnonzero(lengths > LONG)
    if len(long):
        counts[long] = linked([words[k] for k in long], pairs)
    which = np.flatnonzero((lengths > 0) & (lengths <= LONG))
    if not len(which):
        return counts
    symbols = pairs.bytes[np.frombuffer(b"".join([words[k] for k in which]), np.uint8)]
    sizes = lengths[which]
    owner = np.repeat(np.arange(len(which)), sizes)
    ranks = _adjacent(symbols, owner, pairs)
    while len(symbols):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        least = np.minimum.reduceat(ranks, starts)
        sizes = np.diff(np.append(starts, len(owner)))
        over = least == _NONE
        if over.any():
            counts[which[owner[starts[over]]]] = sizes[over]
            stay = np.repeat(~over, sizes)
            symbols, owner, ranks = symbols[stay], owner[stay], ranks[stay]
            if not len(symbols):
                break
            least, sizes = least[~over], sizes[~over]
            starts = np.cumsum(sizes) - sizes
        hits = np.flatnonzero(ranks == np.repeat(least, sizes))
        at = hits[np.append(True, owner[hits[1:]] != owner[hits[:-1]])]  # the leftmost of each sequence
        symbols[at] = least
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        new = np.cumsum(keep) - 1
        symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
        at = new[at]
        touched = np.concatenate([at, at[at > 0] - 1])
        ranks[touched] = _pair_at(symbols, owner, touched, pairs)
    return counts


def _pair_at(symbols: np.ndarray, owner: np.ndarray, at: np.ndarray, pairs: Pairs) -> np.ndarray:
    nxt = np.minimum(at + 1, len(symbols) - 1)
    return np.where((at + 1 < len(symbols)) & (owner[at] == owner[nxt]), pairs.of(symbols[at], symbols[nxt]), _NONE)


def _adjacent(symbols: np.ndarray, owner: np.ndarray, pairs: Pairs) -> np.ndarray:
    return _pair_at(symbols, owner, np.arange(len(symbols)), pairs)


def linked(words: list[bytes], pairs: Pairs) -> np.ndarray:
    """The token count of each of some long pre-tokens."""
    symbols = pairs.bytes[np.frombuffer(b"".join(words), np.uint8)]
    ends = np.cumsum([len(w) for w in words])
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    n = len(symbols)
    after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
    after[ends - 1] = -1
    before[np.append(0, ends[:-1])] = -1
    rank, waiting, heap, odd = np.full(n, _NONE), {}, [], set()

    def look(at: np.ndarray) -> np.ndarray:
        """Ranks the pairs that begin at ``at`` anew, and puts them in line."""
        nxt = after[at]
        found = np.where(nxt >= 0, pairs.of(symbols[at], symbols[nxt]), _NONE)
        rank[at] = found
        order = np.argsort(found, kind="stable")
        order = order[: np.searchsorted(found[order], _NONE)]
        cuts = np.flatnonzero(np.diff(found[order])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            r = int(found[part[0]])
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(heap, r)
            waiting[r].append(at[part])
        return found

    look(np.arange(n))
    while heap:
        r = heapq.heappop(heap)
        at = np.unique(np.concatenate(waiting.pop(r)))
        at = at[alive[at] & (rank[at] == r)]
        if not len(at):
            continue
        # of pairs that overlap, every second one from the left
        begins = np.append(True, after[at[:-1]] != at[1:])
        place = np.arange(len(at))
        at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
        right = after[at]
        symbols[at], alive[right], after[at] = r, False, after[right]
        follows = after[at] >= 0
        before[after[at][follows]] = at[follows]
        touched = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
        lower = touched[look(touched) < r]
        if len(lower):
            several, times = np.unique(owner[at], return_counts=True)
            odd.update(np.intersect1d(owner[lower], several[times > 1]).tolist())
    counts = np.bincount(owner[alive], minlength=len(words))
    for k in odd:
        counts[k] = one_by_one(words[k], pairs)
    return counts


def one_by_one(word: bytes, pairs: Pairs) -> int:
    """The token count by single merges."""
    symbols = pairs.bytes[np.frombuffer(word, np.uint8)]
    while len(symbols) > 1:
        ranks = pairs.of(symbols[:-1], symbols[1:])
        at = int(np.argmin(ranks))
        if ranks[at] == _NONE:
            break
        symbols[at] = ranks[at]
        symbols = np.delete(symbols, at + 1)
    return len(symbols)


class Counter:
    """Counts the tokens of texts, remembering pre-tokens (which ones are remembered never changes a count)."""

    def __init__(self, pairs: Pairs, pattern: str = PATTERN) -> None:
        self.pairs, self.find, self.known, self.size = pairs, regex.compile(pattern).findall, {}, 0

    def count(self, texts: list[str | None]) -> list[int | None]:
        out: list[int | None] = []
        k = 0
        while k < len(texts):
            size, end = 0, k
            while end < len(texts) and (end == k or size + len(texts[end] or "") <= CHUNK):
                size += len(texts[end] or "")
                end += 1
            found = [None if t is None else self.find(t) for t in texts[k:end]]
            if len(self.known) > REMEMBERED or self.size > REMEMBERED_CHARS:
                self.known.clear()
                self.size = 0
            new = list(set().union(*(f for f in found if f)) - self.known.keys())
            self.size += sum(map(len, new))
            self.known.update(zip(new, merged([w.encode("utf-8", "surrogatepass") for w in new], self.pairs).tolist()))
            out += [None if f is None else sum(map(self.known.__getitem__, f)) for f in found]
            k = end
        return out


def token_counts(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of every row; no shuffle."""
    pairs = vocabulary(path)
    counter: list[Counter] = []

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not counter:
            counter.append(Counter(pairs, pattern))
        texts = batch.column(1)
        try:
            texts = texts.to_pylist()
        except UnicodeDecodeError:
            texts = [None if b is None else b.decode("utf-8", "replace") for b in texts.cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counter[0].count(texts), pa.int64())], ["doc_id", "n_tokens"])

    return labelled.scored(docs, ["doc_id", "text"], "doc_id long, n_tokens long", count)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
