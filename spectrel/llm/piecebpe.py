"""SentencePiece (merge type) encoding and decoding by backtracking.

The encoding that merging would give is found from the left: at every place the longest piece that an Aho-Corasick automaton
matches is tried first; it may follow the piece before it only if merging the two pieces' joined text gives just these two;
where no piece fits, the place is marked in a bit field as failed and the last piece is shortened. No piece holds a space
mark after another character, or a Latin letter next to anything but such letters and marks (verified at load), so text is encoded
in units between such places, and units already seen are taken from a table of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spectrel.llm.common import per_text, read, tokenizer_file

MARK = "▁"
#: Latin letters; and units: space marks, then Latin letters only or other characters only.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
UNIT = re.compile(f"{MARK}*(?:[{LATIN}]+|[^{LATIN}{MARK}]+)|{MARK}+")
#: Entries in a worker's tables of units already encoded and of pairs of pieces; and letters of the longest unit that is kept.
KNOWN, PAIRS, KEPT = 300_000, 300_000, 300


class Known(dict):
    """Of units already encoded their decimal ids, joined by commas, and the bytes that these ids stand for."""

    def __init__(self, coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, unit: str) -> tuple[str, bytes]:
        joined = ",".join(map(str, self.coder.unit_ids(unit)))
        out = joined, self.coder.bytes_of(joined)
        if len(unit) <= KEPT:
            self[unit] = out
        return out


def wire(data: bytes):
    """(field number, value) of a protocol buffer's message: an int, or bytes."""
    at = 0

    def number():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class PieceBpe:
    """Encoder and decoder for a SentencePiece model of type BPE with the identity normalizer and byte fallback."""

    def __init__(self, path: str):
        raw = open(path, "rb").read()
        norm = dict(next((v for k, v in wire(raw) if k == 3), b"") and wire(next(v for k, v in wire(raw) if k == 3)))
        train = dict(wire(next(v for k, v in wire(raw) if k == 2)))
        self.prefix, strip, escape = norm.get(3, 1), norm.get(4, 1), norm.get(5, 1)
        if train.get(3) != 2 or norm.get(2) or strip or not escape or train.get(24, 0):
            raise ValueError("only BPE models with the identity normalizer that keep white space are understood")
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if lib.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.unk, self.control = lib.unk_id(), {i for i in range(n) if lib.is_control(i)}
        if len(self.byte_of) != 256 or any(lib.is_unused(i) for i in range(n)):
            raise ValueError("only models with byte fallback and without unused pieces are understood")
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.byte_of and i not in self.control and i != self.unk}
        if any(UNIT.fullmatch(p) is None for p in self.ids):
            raise ValueError("a piece crosses a place at which text is cut into units")
        self.score = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.fits: dict[int, bool] = {}
        self.good = {p: i for p, i in self.ids.items() if self.remerge(p) == [p]}  # merging never gives the others
        self.longest = max(map(len, self.good))
        self.automaton = ahocorasick.Automaton()
        for p, i in self.good.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.known = Known(self)
        self.surface = {str(i): bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.control else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)}
        self.surface[str(self.unk)] = " ⁇ ".encode()

    def remerge(self, text: str) -> list[str]:
        """The pieces by merging: again and again the neighbours whose joined piece has the highest score, the leftmost of equals."""
        n = len(text)
        sym, nxt, prv = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, text[i : i + 2]) for i in range(n - 1) if (s := self.score.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = nxt[i] if sym[i] else n
            if j >= n or sym[i] + sym[j] != joined:
                continue
            sym[i], sym[j] = joined, ""
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for a, b in ((prv[i], i), (i, nxt[i])):
                if a >= 0 and b < n and (s := self.score.get(sym[a] + sym[b])) is not None:
                    heapq.heappush(heap, (-s, a, sym[a] + sym[b]))
        return [s for s in sym if s]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the pieces stay two pieces where their joined text is merged."""
        if len(self.fits) > PAIRS:
            self.fits.clear()
        x, y = self.pieces[a], self.pieces[b]
        self.fits[a << 32 | b] = got = self.remerge(x + y) == [x, y]
        return got

    def unit_ids(self, unit: str) -> list[int]:
        """The ids of a unit, by backtracking; a character that is no piece becomes its bytes."""
        if (i := self.good.get(unit)) is not None:
            return [i]
        n, fits = len(unit), self.fits
        # the longest matches from the left, tried first at every place, are the result if each fits the one before
        out, covered, last = [], 0, -1
        for _, (length, i) in self.automaton.iter_long(unit):
            if last >= 0 and not (fits[last << 32 | i] if last << 32 | i in fits else self.compatible(last, i)):
                break
            covered += length
            last = i
            out.append(i)
        if covered == n:
            return out
        # (length, id) of the pieces that start at each place, the longest last; (1, -1) for a character that is no piece
        pieces: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, i) in self.automaton.iter(unit):
            pieces[end + 1 - length].append((length, i))
        for x in pieces:
            if not x:
                x.append((1, -1))
        failed = 0  # a bit for each place that no further encoding starts from
        done: list[tuple[int, int]] = []
        at, last = 0, -1
        options = pieces[0]
        k = len(options)
        while at < n:
            while k:
                k -= 1
                length, i = options[k]
                if not failed >> at + length & 1 and (last < 0 or i < 0 or (fits[last << 32 | i] if last << 32 | i in fits else self.compatible(last, i))):
                    done.append((k, at))
                    last, at = i, at + length
                    if at < n:
                        options = pieces[at]
                        k = len(options)
                    break
            else:
                failed |= 1 << at
                if not done:
                    raise ValueError("no encoding was found")
                k, at = done.pop()
                options = pieces[at]
                last = pieces[done[-1][1]][done[-1][0]][1] if done else -1
        out = []
        for k, at in done:
            i = pieces[at][k][1]
            out += [i] if i >= 0 else [self.id_of_byte[b] for b in unit[at].encode()]
        return out

    def marked(self, text: str) -> str:
        return (MARK * bool(self.prefix) + text).replace(" ", MARK) if text else ""

    def units(self, text: str) -> list[tuple[str, bytes]]:
        if len(self.known) > KNOWN:
            self.known.clear()
        return list(map(self.known.__getitem__, UNIT.findall(self.marked(text))))

    def bytes_of(self, joined: str) -> bytes:
        """What decimal ids joined by commas stand for."""
        return b"".join(map(self.surface.__getitem__, joined.split(",")))

    def coded(self, text: str) -> tuple[str, str]:
        """(decimal ids joined by commas, the text of these ids)."""
        found = self.units(text)
        joined = ",".join([j for j, _ in found])
        return joined, self.plain(joined, b"".join([b for _, b in found]))

    def encode_units(self, text: str) -> list[str]:
        """For each unit of the text its decimal ids, joined by commas."""
        return [j for j, _ in self.units(text)]

    def encode_joined(self, text: str) -> str:
        """Decimal ids joined by commas."""
        return ",".join(self.encode_units(text))

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in s.split(",")] if (s := self.encode_joined(text)) else []

    def decode_units(self, parts: list[str]) -> str:
        """The text of ids, given as decimal ids joined by commas, in any number of parts."""
        joined = ",".join(parts)
        return self.plain(joined, self.bytes_of(joined)) if parts else ""

    def plain(self, joined: str, raw: bytes) -> str:
        """The text of ids from their bytes."""
        if not joined:
            return ""
        try:
            text = raw.decode()
        except UnicodeDecodeError:  # bytes that are no characters
            return self.decode(map(int, joined.split(",")))
        return text[1:] if self.prefix and text[:1] == " " and self.opens_with_mark(joined) else text

    def opens_with_mark(self, joined: str) -> bool:
        first = int(joined.split(",", 1)[0])
        return first != self.unk and self.pieces[first].startswith(MARK)

    def decode(self, ids) -> str:
        """The text of ids: space marks become spaces, the first piece loses the mark of the added prefix, runs of byte pieces become
        their characters, U+FFFD for each byte that is none; control pieces are left out."""
        out: list[str] = []
        run = bytearray()
        first = True

        def flush():
            nonlocal run
            data, run = bytes(run), bytearray()
            at = 0
            while at < len(data):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(data[at : at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    at += 1

        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                first = False
                continue
            if run:
                flush()
            if i in self.control:
                continue
            p = " ⁇ " if i == self.unk else self.pieces[i]
            if first and self.prefix and p.startswith(MARK):
                p = p[1:]
            first = False
            out.append(p.replace(MARK, " "))
        if run:
            flush()
        return "".join(out)


_coders: dict[str, PieceBpe] = {}


def coder(path: str) -> PieceBpe:
    return _coders.get(path) or _coders.setdefault(path, PieceBpe(path))


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """docs, n_tokens, ids_text (decimal ids joined by commas), decoded, and token_ids (array) unless ids is false.

    A null text is treated as empty: no ids, an empty decoded text. Rows that repeat are encoded each; columns of docs with the
    names of new ones are replaced; an empty table gives an empty table. Nothing is shuffled.
    """
    out = [("n_tokens", T.LongType()), ("ids_text", T.StringType()), ("decoded", T.StringType())]
    out += [("token_ids", T.ArrayType(T.IntegerType()))] * ids

    def make():
        c = coder(path)

        def do(texts):
            both = [c.coded(t.decode("utf-8", "replace") if t else "") for t in texts]
            got = [g for g, _ in both]
            return [[g.count(",") + 1 if g else 0 for g in got], got, [d for _, d in both], *([[np.fromstring(g, dtype=np.int32, sep=",") for g in got]] if ids else [])]

        return do

    return per_text(docs, text, out, make, keep)


def digests(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """n_tokens and the SHA-256 of encode_decode's ids_text and decoded, made where they are made, so that the texts needn't leave the worker."""

    def make():
        c = coder(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def do(texts):
            cols: list[list] = [[], [], []]
            for t in texts:
                joined, decoded = c.coded(t.decode("utf-8", "replace") if t else "")
                for col, v in zip(cols, (joined.count(",") + 1 if joined else 0, sha(joined), sha(decoded)), strict=True):
                    col.append(v)
            return cols

        return do

    return per_text(docs, text, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], make, keep)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode_decode() of all documents, as digests; edge cases as defined there."""
    return digests(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), keep=["doc_id"])
