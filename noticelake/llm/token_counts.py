"""Token counts of texts under a byte-level BPE vocabulary.

Rank-synchronous array merging: the pre-tokens of a batch that have not been counted yet are held as one
ragged numpy array of symbols. Each round finds every sequence's lowest-ranked pair and applies it in all
sequences at once; a sequence leaves when no pair of it has a rank. The symbols that are left are counted. Pre-tokens
beyond LONG characters, which would keep the others' array in many rounds, have one of their own each.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, load

#: characters from which a pre-token is counted by itself
LONG = 400
NO_RANK = np.iinfo(np.int64).max
SPACE = r"\p{White_Space}"
#: fixed values: the split pattern of the byte-level pre-tokenizer
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|{SPACE}+(?![^{SPACE}])|{SPACE}+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class MergeTable:
    """The merges of a tokenizer file as sorted arrays: pair key, rank, merged symbol."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.size = max(vocab.values()) + 1
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        keys, first = np.unique(keys, return_index=True)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.keys, self.ranks, self.made = keys, first.astype(np.int64), made[first]
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        found = self.keys[at] == keys
        return np.where(found, self.ranks[at], NO_RANK), self.made[at]


def count_symbols(words: list[bytes], table: MergeTable) -> np.ndarray:
    """Symbols left of each (non-empty) word when all merges are done."""
    symbols = table.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    lengths, live = np.fromiter(map(len, words), np.int64, len(words)), np.arange(len(words))
    left = lengths.copy()
    while len(live):
        starts = np.zeros(len(live), np.int64)
        np.cumsum(lengths[:-1], out=starts[1:])
        key = np.empty(len(symbols), np.int64)
        key[:-1] = symbols[:-1] * table.size + symbols[1:]
        key[starts + lengths - 1] = -1
        rank, made = table.look_up(key)
        lowest = np.minimum.reduceat(rank, starts)
        of = np.repeat(np.arange(len(live)), lengths)
        hit = (rank == lowest[of]) & (rank != NO_RANK)
        # of hits that follow each other (a a a) every other one counts, from the left
        at = np.flatnonzero(hit)
        if len(at):
            new_run = np.ones(len(at), bool)
            new_run[1:] = np.diff(at) > 1
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            symbols[at] = made[at]
            lengths = lengths - np.bincount(of[at], minlength=len(live))
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, of = symbols[keep], of[keep]
        left[live] = lengths
        on = lowest != NO_RANK
        if not on.all():
            symbols = symbols[on[of]]
            live, lengths = live[on], lengths[on]
    return left


def count_long(word: bytes, table: MergeTable) -> int:
    """The same for one long word, in time about linear in its length.

    Rounds go by rank again, but each looks only at the places where its rank stands: places are filed by the rank of
    the pair that starts there, and after a merge only the places beside it are filed anew.
    """
    symbols = table.of_byte[np.frombuffer(word, np.uint8)]
    n = len(symbols)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    rank = np.full(n, NO_RANK)
    made = np.zeros(n, np.int64)
    filed: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def file(at: np.ndarray) -> None:
        pair = after[at] < n
        rank[at[~pair]] = NO_RANK
        at = at[pair]
        rank[at], made[at] = table.look_up(symbols[at] * table.size + symbols[after[at]])
        at = at[rank[at] != NO_RANK]
        at = at[np.argsort(rank[at], kind="stable")]
        ranks, first = np.unique(rank[at], return_index=True)
        for r, places in zip(ranks.tolist(), np.split(at, first[1:]), strict=True) if len(at) else ():
            if r not in filed:
                filed[r] = []
                heappush(heap, r)
            filed[r].append(places)

    file(np.arange(n - 1))
    left = n
    while heap:
        r = heappop(heap)
        at = np.unique(np.concatenate(filed.pop(r)))
        at = at[rank[at] == r]
        if not len(at):
            continue
        # of pairs that overlap (a a a) every other one counts, from the left
        new_run = np.ones(len(at), bool)
        new_run[1:] = after[at[:-1]] != at[1:]
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        gone = after[at]
        symbols[at] = made[at]
        rank[gone] = NO_RANK
        after[at] = after[gone]
        follows = after[at] < n
        before[after[at][follows]] = at[follows]
        left -= len(at)
        beside = before[at]
        file(np.unique(np.concatenate([at, beside[beside >= 0]])))
    return left


class TokenCounter:
    """Counts tokens of texts. Remembers the counts of up to `most` pre-tokens."""

    def __init__(self, path: str, most: int = 300_000) -> None:
        self.table, self.most, self.known = MergeTable(path), most, {}
        self.find = regex.compile(PRE_TOKEN).findall
        self.split = regex.compile("|".join(map(regex.escape, self.table.special))).split if self.table.special else None

    def count(self, texts: list[str]) -> list[int]:
        special, words = [], []
        for t in texts:
            parts = self.split(t) if self.split and any(s in t for s in self.table.special) else [t]
            special.append(len(parts) - 1)
            words.append(self.find(parts[0]) if len(parts) == 1 else [w for p in parts for w in self.find(p)])
        if len(self.known) > self.most:
            self.known.clear()
        new = set()
        for w in words:
            new.update(w)
        new = list(new - self.known.keys())
        if new:
            short = [w for w in new if len(w) <= LONG]
            if short:
                self.known.update(zip(short, count_symbols([w.encode() for w in short], self.table).tolist(), strict=True))
            self.known.update((w, count_long(w.encode(), self.table)) for w in new if len(w) > LONG)
        get = self.known.__getitem__
        return [n + sum(map(get, w)) for n, w in zip(special, words, strict=True)]


@lru_cache(2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row, in one pass without a shuffle.

    tokenizer: path of a byte-level BPE tokenizer file that every executor can read. Strings of its special
    tokens inside a text count as one token each. A null or empty text has 0 tokens; null ids and repeated
    rows pass through; an empty table gives no rows; extra columns are ignored. Time is linear in a text's length, also
    where it is one unbroken word; memory is bounded by the largest single text.
    """

    def run(batches):
        tokens = counter(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts: list[int] = []
            for a, b in chunks(texts):
                counts += tokens.count(texts[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])], names=["id", "b", "n", "o"]
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.octet_length(text).cast("long").alias("b"))
    return rows.mapInArrow(run, "id long, b long, n long, o boolean").toDF(id_col, "n_bytes", "n_tokens", "over_limit")


def op2(spark, sf_dir):
    import public_tokenizers

    return count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
