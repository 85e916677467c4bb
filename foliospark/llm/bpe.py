"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece the table holds the last token of that prefix's encoding. It is
unique: the encoding of a prefix ends in token t exactly if t's bytes end the prefix and t may
follow the last token of what stands before it, that is if merging both tokens' bytes gives back
these two tokens. The table makes appends exact (old entries stay) and confines an edit to the
bytes from it to where the table agrees with the old one over the length of the longest token.

Null text counts as empty: no tokens. Any text, however long, is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from .pretokens import ChunkCache, pattern
from .shared import text_batches

PAIR_ENTRIES, NEVER = 1_000_000, 1 << 60
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PrefixEncoder:
    """BPE by the ranks of a vocabulary, through tables of last tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spines: dict[int, tuple[list[int], list[int]]] = {}
        self.found = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.found.add_word(token.decode("latin-1"), (rank, len(token)))
        self.found.make_automaton()

    def merged(self, data: bytes, below: int = NEVER) -> list[int]:
        """The merges of a rank under below, lowest rank first, applied to a short byte string."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [self.ranks.get(parts[i] + parts[i + 1], NEVER) for i in range(len(parts) - 1)]
            least = min(ranked)
            if least >= below:
                break
            at = ranked.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def spine(self, token: int) -> tuple[list[int], list[int]]:
        """The tokens that are merged at the token's left and right edge, from byte to token; empty if merges never make it."""
        known = self.spines.get(token)
        if known is None:
            data = self.tokens[token]
            if len(data) == 1:
                known = ([token], [token])
            else:
                parts = self.merged(data, token)
                if len(parts) == 2:
                    left, right = self.spine(parts[0])[0], self.spine(parts[1])[1]
                    known = (left + [token], right + [token]) if left and right else ([], [])
                else:
                    known = ([], [])
            self.spines[token] = known
        return known

    def follows(self, left: int, right: int) -> bool:
        """Whether right may stand after left in an encoding (left -1: at its start).

        Follows the merges at both sides of the seam in the order of their ranks; the pair is
        invalid if at some time the two tokens at the seam would merge before either side goes on.
        """
        key = (left, right)
        if len(self.pairs) >= PAIR_ENTRIES:
            self.pairs.clear()
        ys = self.spine(right)[0]
        xs = self.spine(left)[1] if left >= 0 else ()
        if left < 0 or not ys or not xs:
            self.pairs[key] = bool(ys) and left < 0
            return self.pairs[key]
        i = j = 0
        tokens, rank = self.tokens, self.ranks.get
        while True:
            next_x = xs[i + 1] if i + 1 < len(xs) else NEVER
            next_y = ys[j + 1] if j + 1 < len(ys) else NEVER
            seam = rank(tokens[xs[i]] + tokens[ys[j]], NEVER)
            if seam < next_x and seam <= next_y and seam != NEVER:
                ok = False
                break
            if next_x == next_y == NEVER:
                ok = True
                break
            if next_x <= next_y:
                i += 1
            else:
                j += 1
        self.pairs[key] = ok
        return ok

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """Fill the table of last tokens from len(last) on."""
        pairs, filled = self.pairs, len(last)
        begin = max(0, filled - self.longest + 1)
        for at, (token, size) in self.found.iter(data[begin:upto].decode("latin-1")):
            end = begin + at + 1
            if end > filled:  # among the tokens that end here, the one that may follow is unique
                start = end - size
                if start >= 0:
                    left = last[start - 1] if start else -1
                    ok = pairs.get((left, token))
                    if ok or (ok is None and self.follows(left, token)):
                        last.append(token)
                        filled = end
        return last

    def read(self, last: list[int]) -> list[int]:
        """The encoding of the whole prefix, read backwards from its last token."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return out[::-1]

    def piece(self, data: bytes) -> list[int]:
        """A piece that is itself a token is that token, as in the library; others go by the table."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.read(self.extend(data, []))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PieceTable:
    """A piece with its table: exact appends, and edits that recompute only what they reach."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, data, encoder.extend(data, [])
        self.recomputed = len(data)

    def ids(self) -> list[int]:
        whole = self.encoder.ranks.get(self.data)
        return [whole] if whole is not None else self.encoder.read(self.last)

    def append(self, more: bytes) -> None:
        self.recomputed = len(more)
        self.data += more
        self.encoder.extend(self.data, self.last)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes start:end; later entries are taken over once a token's length of them agrees."""
        old, shift, begun = self.last, len(new) - (end - start), start
        self.data = self.data[:start] + new + self.data[end:]
        self.last, same = old[:start], 0
        while len(self.last) < len(self.data):
            at = len(self.last)
            self.encoder.extend(self.data, self.last, at + 1)
            same = same + 1 if at >= start + len(new) and self.last[at] == old[at - shift] else 0
            if same >= self.encoder.longest:
                self.recomputed = len(self.last) - begun
                self.last += old[len(self.last) - shift :]
                return
        self.recomputed = len(self.last) - begun


class TextEncoder:
    """Whole texts: the split pattern, then each match by itself."""

    def __init__(self, ranks_path: str, split: str):
        self.pieces = PrefixEncoder(load_ranks(ranks_path))
        self.split = pattern(split)
        self.chunks = ChunkCache(self._chunk)

    def encode(self, text: str) -> list[int]:
        return [i for m in self.split.findall(text) for i in self.pieces.piece(m.encode("utf-8", "surrogatepass"))]

    def _chunk(self, chunk: str) -> tuple[str, bytes]:
        ids = self.encode(chunk)
        return ",".join(map(str, ids)), self.pieces.decode(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and the digests of the ids and of what they decode to."""
        ids, decoded = zip(*self.chunks.values(text), strict=True) if text else ((), ())
        joined = ",".join(ids)
        n = joined.count(",") + 1 if joined else 0
        return n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()


@lru_cache(maxsize=2)
def text_encoder(ranks_path: str, split: str) -> TextEncoder:
    """One encoder in each Python worker, so that tasks go on with its caches."""
    return TextEncoder(ranks_path, split)


def encode(docs: DataFrame, ranks_path: str, split: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every text; null text gives an empty array, null ids of documents stay null."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = text_encoder(ranks_path, split)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [encoder.encode(t or "") for t in batch["text"]]})

    return _narrow(docs, id_col, text_col).mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text_bytes): the bytes of each row's ids; null ids give empty bytes, an unknown id fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = PrefixEncoder(load_ranks(ranks_path))
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_bytes": [pieces.decode([] if ids is None else list(ids)) for ids in batch["ids"]]})

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")).mapInPandas(run, "doc_id long, text_bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, split: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes every text, decodes the ids, and digests both.

    One row per input row, repeated and null ids of documents included; other columns are ignored.
    """
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = text_encoder(ranks_path, split)
        for batch in batches:
            rows = [encoder.digest(t or "") for t in batch["text"]]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return _narrow(docs, id_col, text_col).mapInPandas(run, ENCODED)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
