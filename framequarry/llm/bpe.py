"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one token can stand last in its encoding: the one whose
left neighbour (the last token of what precedes it) it may follow. Storing that token per prefix
gives the encoding by walking back, exact appends (prefixes never change) and re-encoding near an
edit (the table after the edit falls into step with the old one again).

Null texts encode like empty ones: no ids, the digest of no bytes. Texts of any length are encoded
whole. Extra columns of the input are ignored; every row gets one row.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_batches, batches_of, record

#: Bounds of a worker's memos, in entries; a full memo starts anew.
MEMO_UNITS, MEMO_PAIRS = 250_000, 500_000
NEVER = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 bytes, blank, rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class PrefixCoder:
    """Encoder and decoder over a table of ranks (ids are ranks)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._rights: dict[int, tuple[int, ...]] = {}
        self._lefts: dict[int, tuple[int, ...]] = {}
        self._pairs: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) == 1:
                self._rights[rank] = self._lefts[rank] = (rank,)
                continue
            halves = self._two_halves(token, rank)
            if halves:
                left, right = halves
                self._rights[rank] = (*self._rights[right], rank)
                self._lefts[rank] = (*self._lefts[left], rank)

    def _two_halves(self, token: bytes, below: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None if merging never makes it."""
        get, parts = self.ranks.get, [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = get(parts[i] + parts[i + 1], NEVER)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        left, right = (get(p) for p in parts)
        return (left, right) if left in self._lefts and right in self._rights else None

    def may_follow(self, first: int, second: int) -> bool:
        """Whether the bytes of both, encoded together, stay these two tokens.

        Replays the merges on either side of the border, lowest rank first: the border holds if at
        no time the two tokens that touch it would merge before one of them grows.
        """
        key = first << 20 | second
        known = self._pairs.get(key)
        if known is not None:
            return known
        left, right, i, j, holds = self._rights[first], self._lefts[second], 0, 0, True
        while True:
            across = self.ranks.get(self.token[left[i]] + self.token[right[j]], NEVER)
            grow_left = left[i + 1] if i + 1 < len(left) else NEVER
            grow_right = right[j + 1] if j + 1 < len(right) else NEVER
            if across < grow_left and across <= grow_right and across < NEVER:
                holds = False
                break
            if grow_left == NEVER and grow_right == NEVER:
                break
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1
        if len(self._pairs) >= MEMO_PAIRS:
            self._pairs.clear()
        self._pairs[key] = holds
        return holds

    def extend(self, data: bytes | bytearray, last: list[int], upto: int | None = None) -> None:
        """Fill in the last tokens of the prefixes of `data` that `last` lacks."""
        ranks, spine, follows, longest, token = self.ranks.get, self._lefts, self.may_follow, self.longest, self.token
        for end in range(len(last) + 1, (len(data) if upto is None else upto) + 1):
            for start in range(max(0, end - longest), end):
                rank = ranks(bytes(data[start:end]))
                if rank is not None and rank in spine and (start == 0 or follows(last[start - 1], rank)):
                    last.append(rank)
                    break
            else:
                raise ValueError("the ranks do not cover every byte")

    def walk_back(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.token[last[end - 1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """One piece of the split text; a piece that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(piece, last)
        return self.walk_back(last)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class PrefixEncoding:
    """A growing or edited byte string and the last token of each of its prefixes."""

    def __init__(self, coder: PrefixCoder, data: bytes = b""):
        self.coder, self.data, self.last = coder, bytearray(), []
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.coder.extend(self.data, self.last)

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace data[start:stop]; returns how many prefixes were computed anew.

        After the edit the old table is taken over as soon as as many entries in a row agree with it
        as the longest token has bytes: what follows depends on nothing further back.
        """
        tail, shift = self.last[stop:], start + len(new)
        self.data[start:stop] = new
        del self.last[start:]
        self.coder.extend(self.data, self.last, shift)
        same, done = 0, len(new)
        for k, old in enumerate(tail):
            if same >= self.coder.longest:
                self.last += tail[k:]
                return done
            self.coder.extend(self.data, self.last, shift + k + 1)
            same, done = (same + 1 if self.last[-1] == old else 0), done + 1
        return done

    def ids(self) -> list[int]:
        return self.coder.walk_back(self.last)


_TWO_SPACES = re.compile(r"\s[ \n]")
_SAFE_CUT = re.compile(r"(?<!\s)([ \n])")


def units_of(text: str) -> list[str]:
    """Cut a text where no match of the split pattern can reach across: before a lone blank or line end."""
    if "\0" in text:
        return [text]
    if _TWO_SPACES.search(text):
        return _SAFE_CUT.sub("\0\\1", text).split("\0")
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


class TextCoder:
    """Splits texts by the pattern and encodes each match; remembers the units it has met.

    The units of a batch that are new are split and encoded in one go: an automaton over the
    vocabulary names every token that ends at each byte, and the table of last tokens is filled
    from left to right, a mark no token holds keeping the pieces apart.
    """

    MARK, START = "\u0100", -1

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.coder, self.pieces_of = PrefixCoder(ranks), regex.compile(pattern).findall
        self.units: dict[str, bytes] = {}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if rank in self.coder._lefts:
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, by one pass over all of them."""
        ranks, pairs, follows, start = self.coder.ranks, self.coder._pairs, self.coder.may_follow, self.START
        raw = [piece.encode() for piece in pieces]
        text = self.MARK + self.MARK.join([x.decode("latin-1") for x in raw])
        last = [start] * len(text)
        done = -1
        for end, (rank, size) in self.automaton.iter(text):
            if end != done:
                before = last[end - size]
                if before != start:
                    holds = pairs.get(before << 20 | rank)
                    if holds is None:
                        holds = follows(before, rank)
                    if not holds:
                        continue
                last[end] = rank
                done = end
        lengths, out, at = self.lengths, [], 0
        for x in raw:
            at += len(x) + 1
            whole = ranks.get(x)
            if whole is not None:
                out.append(whole.to_bytes(4, "little"))
                continue
            end, stop, ids = at - 1, at - 1 - len(x), []
            while end > stop:
                rank = last[end]
                ids.append(rank)
                end -= lengths[rank]
            out.append(np.array(ids[::-1], "<u4").tobytes() if len(ids) > 8 else b"".join([i.to_bytes(4, "little") for i in reversed(ids)]))
        return out

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of new units. Units that end in white space are split alone, all others joined: a cut before a lone blank is safe."""
        joined = [u for u in units if u and u[0] in " \n" and not u[-1].isspace()]
        alone = [u for u in units if not (u and u[0] in " \n" and not u[-1].isspace())]
        pieces, counts = [], []
        for group in ([joined], [[u] for u in alone]):
            for part in group:
                if not part:
                    continue
                found = self.pieces_of("".join(part))
                pieces += found
                if len(part) == 1:
                    counts.append(len(found))
                else:
                    ends = np.cumsum([len(u) for u in part])
                    counts += np.bincount(np.searchsorted(ends, np.cumsum([len(x) for x in found])), minlength=len(part)).tolist()
        ids, out, at = self.encode_pieces(pieces), {}, 0
        for unit, n in zip(joined + alone, counts, strict=True):
            out[unit] = ids[at] if n == 1 else b"".join(ids[at : at + n])
            at += n
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [units_of(text) for text in texts]
        if len(self.units) >= MEMO_UNITS:
            self.units.clear()
        known = self.units
        fresh = list({u for units in cut for u in units if u not in known})
        learnt = self._learn(fresh) if fresh else {}
        known.update({u: ids for u, ids in learnt.items() if len(u) <= 64})
        if any(len(u) > 64 for u in learnt):
            known = known | learnt
        return [b"".join(map(known.__getitem__, units)) for units in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return self.coder.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def text_coder(path: str, pattern: str) -> TextCoder:
    """One per worker and vocabulary: workers outlive their tasks."""
    return TextCoder(read_ranks(path), pattern)


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves (binary).

    A narrow map over the rows: no shuffle, and a lost executor repeats only its own partitions.
    """
    path, split = default_ranks()
    path, split = ranks_path or path, pattern or split
    arrow_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(path, split)
        for whole in batches:
            for batch in batches_of(whole):
                ids = coder.encode_all([text or "" for text in batch.column("text").to_pylist()])
                columns = {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": [len(x) // 4 for x in ids],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(coder.decode(x)).hexdigest() for x in ids],
                }
                yield record(schema, **columns, **({"ids": ids} if with_ids else {}))

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, kinds)
