"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Every byte prefix of a piece has exactly one token that can end its encoding. It is found from the
shorter prefixes: a token that matches the end of the prefix is the one if it is compatible with the
last token of what precedes it, that is, if encoding the two tokens' bytes gives these two tokens.
Storing that one token per prefix gives the encoding by walking back from the end, allows bytes to be
appended exactly, and lets an edit re-encode only from its place until the table agrees again.

Texts are cut by the vocabulary's pattern and each match is encoded separately, so a piece's ids can be
kept and used again. Special tokens are ordinary text.

Defined results: null and empty texts have no ids and decode to nothing; texts and pieces of any
length take time in proportion to their bytes; repeated rows are encoded row by row; only the named
columns are read, and kept columns called as the results are left out.
"""

from __future__ import annotations

import base64
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, id_type, load, small_batches, worker_model

#: Pieces whose ids a worker keeps; beyond that those not used lately are dropped.
CACHE_PIECES = 300_000
#: Answers and edges kept likewise; a table that is full is emptied.
CACHE_PAIRS, CACHE_EDGES = 300_000, 20_000
_LONG_PIECE = 256


def merge_pairs(data: bytes, ranks: dict[bytes, int]) -> tuple[bytes, ...]:
    """Plain BPE: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(parts)


class PieceCache(dict):
    """Ids of pieces in two generations: when the young one is full the old one goes, so what is used stays."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.pop(piece, None)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= _LONG_PIECE:
            if len(self) >= self.size // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def _substrings(data: bytes) -> set[bytes]:
    return {data[i:j] for i in range(len(data)) for j in range(i + 2, len(data) + 1)}


class Vocabulary:
    """Ranks of byte strings, and the pattern that cuts texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.longest = max(map(len, ranks))
        # lengths of the tokens that end in three given bytes: only these are looked up
        tails: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                tails.setdefault(token[-3:], set()).add(len(token))
        self._tails = {k: (*sorted(v, reverse=True), 2, 1) for k, v in tails.items()}
        self._pairs: dict[int, bool] = {}
        self._splits: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self._pieces = PieceCache(lambda p: np.array(self.encode_piece(p.encode()), dtype="<u4").tobytes(), CACHE_PIECES)

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """Read a rank file: one base64 token and its rank a line."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}, pattern)

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes the token; None for a single byte or a token that no merge reaches."""
        if token not in self._splits:
            if len(self._splits) > 2 * CACHE_EDGES:
                self._splits.clear()
            rest = {k: v for k in _substrings(token) if (v := self.ranks.get(k)) is not None and k != token}
            parts = merge_pairs(token, rest)
            self._splits[token] = parts if len(parts) == 2 else None
        return self._splits[token]

    def reachable(self, token: bytes) -> bool:
        """Whether encoding the token's bytes gives the token."""
        return len(token) == 1 or self.split(token) is not None

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The tokens that stand at the token's right (1) or left (0) end while it is merged, from its outer byte up, each with the rank that ends its time."""
        edge = self._edges[side].get(token)
        if edge is None:
            edge, part, until = [], token, 1 << 60
            while True:
                edge.append((part, until))
                both = self.split(part) if len(part) > 1 else None
                if both is None:
                    break
                part, until = both[side], self.ranks[part]
            if len(self._edges[side]) > CACHE_EDGES:
                self._edges[side].clear()
            self._edges[side][token] = edge = edge[::-1]
        return edge

    def compatible(self, a: bytes, b: bytes) -> bool:
        """Whether encoding ``a + b`` gives ``a, b``: no merge crosses the border.

        Follows what stands left and right of the border as the merges within a and b go on; of equal
        ranks the left one is merged first.
        """
        key = self.ranks[a] << 32 | self.ranks[b]
        ok = self._pairs.get(key)
        if ok is not None:
            return ok
        left, right, i, j, ok = self._edge(a, 1), self._edge(b, 0), 0, 0, self.reachable(b)
        while ok:
            (x, x_until), (y, y_until) = left[i], right[j]
            rank = self.ranks.get(x + y)
            if rank is not None and rank < x_until and rank <= y_until:
                ok = False
            elif x_until <= y_until:
                if i + 1 == len(left):
                    break
                i += 1
            else:
                j += 1
        if len(self._pairs) > CACHE_PAIRS:
            self._pairs.clear()
        self._pairs[key] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            # a piece that is itself a token is that token, as in the public encoders
            return [whole]
        ranks, tails, short, pairs, last, ids = self.ranks, self._tails, (2, 1), self._pairs, [b""], [0]
        for end in range(1, len(piece) + 1):
            for length in tails.get(piece[end - 3 : end], short) if end > 2 else short:
                start = end - length
                if start < 0:
                    continue
                token = piece[start:end]
                rank = ranks.get(token)
                if rank is not None:
                    if start:
                        ok = pairs.get(ids[start] << 32 | rank)
                        if ok is None:
                            ok = self.compatible(last[start], token)
                    else:
                        ok = self.reachable(token)
                    if ok:
                        last.append(token)
                        ids.append(rank)
                        break
            else:
                raise ValueError(f"the vocabulary has no token for byte {piece[end - 1]}")
        out, end = [], len(piece)
        while end:
            out.append(ids[end])
            end -= len(last[end])
        return out[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")

    def encode_bytes(self, text: str | None) -> bytes:
        kept = self._pieces
        return b"".join([kept[p] for p in self.pattern.findall(text or "")])

    def decode(self, ids) -> bytes:
        """Bytes of a sequence of ids."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


class PrefixTable:
    """The last token of each byte prefix of a growing or edited byte string."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), [b""]

    def _find(self, end: int) -> bytes:
        v = self.vocabulary
        for start in range(max(0, end - v.longest), end):
            token = bytes(self.data[start:end])
            if token in v.ranks:
                before = self.last[start]
                if v.compatible(before, token) if before else v.reachable(token):
                    return token
        raise ValueError(f"the vocabulary has no token for byte {self.data[end - 1]}")

    def append(self, data: bytes) -> None:
        """Add bytes at the end."""
        first = len(self.data) + 1
        self.data += data
        for end in range(first, len(self.data) + 1):
            self.last.append(self._find(end))

    def edit(self, start: int, stop: int, data: bytes) -> int:
        """Replace ``data[start:stop]``; returns how many prefixes were computed anew.

        Once as many successive prefixes as the longest token has bytes keep their last tokens, all
        later ones do, as each depends on the bytes and last tokens just before it.
        """
        old, shift = self.last, len(data) - (stop - start)
        self.data[start:stop] = data
        self.last = old[: start + 1]
        same = done = 0
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._find(end))
            done += 1
            if end > start + len(data):
                same = same + 1 if self.last[end] == old[end - shift] else 0
                if same >= self.vocabulary.longest:
                    self.last += old[end - shift + 1 :]
                    break
        return done

    def ids(self) -> list[int]:
        """The encoding of all bytes."""
        out, end = [], len(self.data)
        while end:
            token = self.last[end]
            out.append(self.vocabulary.ranks[token])
            end -= len(token)
        return out[::-1]


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file, read once by each worker."""
    return worker_model(("bpe", path, pattern), lambda: Vocabulary.load(path, pattern))


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _kept(keep: tuple[str, ...], id_col: str) -> tuple[str, ...]:
    return tuple(c for c in keep if c not in (id_col, "ids", "data", "n_tokens", "ids_sha256", "decoded_sha256"))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: its id (and the columns ``keep``) and ``ids``, the token ids as little-endian unsigned 32-bit integers (binary).

    ``path`` is the rank file's place on every executor. No shuffle.
    """
    small_batches(docs.sparkSession)
    keep = _kept(keep, id_col)

    def run(batches):
        v = vocabulary(path, pattern)
        for batch in by_bytes(batches, 1):
            ids = [v.encode_bytes(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(ids, pa.binary())], names=[id_col, *keep, "ids"])

    schema = ", ".join([*(f"`{c}` {id_type(docs, c)}" for c in (id_col, *keep)), "ids binary"])
    return docs.select(id_col, text_col, *keep).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``encode_documents``: id (and ``keep``), ids, and ``data``, the decoded bytes."""
    keep = _kept(keep, id_col)

    def run(batches):
        v = vocabulary(path, pattern)
        for batch in batches:
            data = [v.decode(np.frombuffer(x.as_buffer(), dtype="<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], batch.column(1), pa.array(data, pa.binary())], names=[id_col, *keep, "ids", "data"])

    schema = ", ".join([*(f"`{c}` {id_type(encoded, c)}" for c in (id_col, *keep)), "ids binary, data binary"])
    return encoded.select(id_col, "ids", *keep).mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Both in one pass, so that a task needs one worker and one vocabulary: id, ``keep``, ids, data."""
    small_batches(docs.sparkSession)
    keep = _kept(keep, id_col)

    def run(batches):
        v = vocabulary(path, pattern)
        for batch in by_bytes(batches, 1):
            ids = [v.encode_bytes(t) for t in batch.column(1).to_pylist()]
            data = [v.decode(np.frombuffer(x, dtype="<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(ids, pa.binary()), pa.array(data, pa.binary())], names=[id_col, *keep, "ids", "data"])

    schema = ", ".join([*(f"`{c}` {id_type(docs, c)}" for c in (id_col, *keep)), "ids binary, data binary"])
    return docs.select(id_col, text_col, *keep).mapInArrow(run, schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode with the public vocabulary: id, ``keep``, ids, data, n_tokens and the SHA-256 of ids and data."""
    out = encode_and_decode(docs, *public_vocabulary(), id_col, text_col, keep)
    return out.withColumns({"n_tokens": F.expr("octet_length(ids) div 4").cast("long"), "ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("data", 256)})


def op4_bpe(spark, sf_dir) -> DataFrame:
    return round_trip(load(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
