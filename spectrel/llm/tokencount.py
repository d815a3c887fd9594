"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged numpy array of symbols. In every round each sequence looks up the ranks of its
neighbouring pairs, takes its lowest, and merges that pair wherever it stands (from the left, without overlap), all sequences
at the same time. Sequences without a mergeable pair leave. What is left of a sequence is its number of tokens.

Rounds of long sequences would look at all symbols again and again. These keep the ranks of their pairs, by rank; every turn takes the
lowest rank of all (which is the lowest of every sequence that has it), merges, and looks up the pairs beside the merged ones only.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spectrel.llm.common import per_text, read, tokenizer_file

#: The byte-level pre-tokenizer's pattern.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries in a worker's table of known pre-tokens and the longest one that it keeps (bytes as UTF-8 or letters); beyond it starts anew.
KNOWN, KEPT = 300_000, 200
#: Bytes from which on a pre-token is merged as a long one.
LONG = 1500
NONE = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable and no space, else the next free one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class RankMerger:
    """Counts the tokens of byte-level BPE pre-tokens."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        pre = spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or not pre or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["dropout"] or model["ignore_merges"]:
            raise ValueError("only plain byte-level BPE without a normalizer is understood")
        vocab = model["vocab"]
        self.byte_id = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = np.array([vocab[a] for a, _ in merges], dtype=np.int64), np.array([vocab[b] for _, b in merges], dtype=np.int64)
        key, rank = (left << 32) | right, np.arange(len(merges), dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], rank[order]
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take white space or stand as whole words aren't understood")
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.known: dict[str, int] = {}

    def rank_of(self, key: np.ndarray) -> np.ndarray:
        """The rank of each pair; a large number for a pair that doesn't merge."""
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, pieces: list[bytes]) -> np.ndarray:
        """How many tokens each piece has."""
        count = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        out = count.copy()
        sym = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), count)
        while len(sym) > 1:
            n = len(sym)
            same = seq[1:] == seq[:-1]
            rank = np.full(n, NONE)
            rank[:-1][same] = self.rank_of((sym[:-1][same] << 32) | sym[1:][same])
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, n])
            least_of = np.repeat(least, length)
            alive = least_of < NONE
            hit = alive & (rank == least_of)
            # of places that follow one another (a pair of equal symbols), every second from the left merges
            start = hit & ~np.r_[False, hit[:-1]]
            begin = np.maximum.accumulate(np.where(start, np.arange(n), -1))
            hit &= (np.arange(n) - begin) % 2 == 0
            at = np.flatnonzero(hit)
            sym[at] = self.merged[rank[at]]
            np.subtract.at(out, seq[at], 1)
            gone = np.zeros(n, dtype=bool)
            gone[at + 1] = True
            stay = alive & ~gone
            sym, seq = sym[stay], seq[stay]
        return out

    def merge_long(self, pieces: list[bytes]) -> np.ndarray:
        """The same for long pieces: a linked list of symbols, and places by the rank of the pair that begins there."""
        count = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        out, n = count.copy(), int(count.sum())
        sym = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), count)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[np.cumsum(count) - 1] = -1
        before[np.cumsum(count) - count] = -1
        rank = np.full(n, NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look_up(at: np.ndarray) -> None:
            """Ranks of the pairs that begin at the places, which wait for their turn."""
            at = at[after[at] >= 0]
            found = self.rank_of((sym[at] << 32) | sym[after[at]])
            rank[at] = found
            at, found = at[found < NONE], found[found < NONE]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cut = np.flatnonzero(np.diff(found)) + 1
            for r, some in zip(found[np.r_[0, cut]].tolist() if len(found) else [], np.split(at, cut), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(some)

        look_up(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            # of pairs that overlap (equal symbols), every second from the left
            start = np.r_[True, after[at[:-1]] != at[1:]][: len(at)]
            begin = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0)) if len(at) else at
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            sym[at] = self.merged[r]
            rank[gone] = NONE
            after[at] = after[gone]
            has = after[at] >= 0
            before[after[at[has]]] = at[has]
            np.subtract.at(out, seq[at], 1)
            beside = before[at]
            changed = np.unique(np.concatenate([at, beside[beside >= 0]]))
            rank[changed] = NONE
            look_up(changed)
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of every text; a special string counts as the one token that the library's default makes of it."""
        known, found, extra = self.known, [], np.zeros(len(texts), dtype=np.int64)
        if len(known) > KNOWN:
            known.clear()
        for i, text in enumerate(texts):
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                extra[i] = len(parts) - 1
                found.append([p for part in parts for p in self.pattern.findall(part)])
            else:
                found.append(self.pattern.findall(text))
        fresh = list(set().union(*found).difference(known)) if found else []
        long = [p for p in fresh if len(p) > KEPT]
        fresh = [p for p in fresh if len(p) <= KEPT]
        for at in range(0, len(fresh), 50_000):
            block = fresh[at : at + 50_000]
            known.update(zip(block, self.merge([p.encode() for p in block]).tolist(), strict=True))
        rare: dict[str, int] = {}
        for size, do in ((False, self.merge), (True, self.merge_long)):
            block = [(p, b) for p in long if (len(b := p.encode()) > LONG) == size]
            if block:
                rare.update(zip([p for p, _ in block], do([b for _, b in block]).tolist(), strict=True))
        get = known.__getitem__ if not rare else lambda p: rare[p] if len(p) > KEPT else known[p]
        return extra + np.fromiter((sum(map(get, f)) for f in found), dtype=np.int64, count=len(texts))


_mergers: dict[str, RankMerger] = {}


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 1024, keep: list[str] | None = None) -> DataFrame:
    """docs and n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    A null text counts as empty (0, 0, false); so does an empty one. Rows that repeat are counted each. Columns of docs with
    the names of new ones are replaced; an empty table gives an empty table. Nothing is shuffled; a worker holds one step of
    texts and a table of known pre-tokens of bounded size.
    """

    def make():
        merger = _mergers.get(path) or _mergers.setdefault(path, RankMerger(path))

        def do(texts):
            raw = [t or b"" for t in texts]
            n = merger.count([t.decode("utf-8", "replace") for t in raw])
            return [[len(t) for t in raw], n, n > limit]

        return do

    return per_text(docs, text, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], make, keep)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_counts() of all documents, over the limit from 1,025 tokens on; edge cases as defined there."""
    return token_counts(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), keep=["doc_id"])
