"""Byte-level BPE by monoid tree reduction.

``encode`` cuts a piece in halves down to short leaves, merges the leaves directly, and joins two encoded neighbours by
re-encoding a window of tokens around the seam. The window grows until the token before it and the token after it are
both stable, that is, until encoding (outer token + nearest inner token) gives back just these two tokens. For a
rank-merged vocabulary a sequence in which every neighbouring pair is stable is *the* encoding of its bytes, so nothing
beyond the window can change. ``decode`` concatenates token bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters and numbers of Unicode versions later than the pattern's own tables; there they count as other characters.
_LATER_L = (
    r"՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    r"\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    r"\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_LATER_N = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"

#: Pieces whose encoding is kept per worker in each of two generations; the older one is dropped when the newer is full.
CACHE = 250_000
#: Ids below which decoding is direct.
RUN = 256

#: The pattern over the first 256 code points, where the standard library's matcher is the faster one. No two
#: alternatives that start with the same character change places, so the matches are the same.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_LATIN_OF = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TreeBpe:
    """Encoder and decoder for one rank table. ``leaf``: bytes below which a piece is merged directly."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = 5):
        self.ranks, self.leaf = ranks, leaf
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.later = regex.compile(f"[{_LATER_L}{_LATER_N}]").search
        exact = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|[L1N1])").replace(r"\p{L}+", r"[\p{L}--[L1]]+").replace(r"\p{N}+", r"[\p{N}--[N1]]+")
        self.split_exact = regex.compile("(?V1)" + exact.replace("L1", _LATER_L).replace("N1", _LATER_N)).findall
        self.memo: dict[bytes, list[int]] = {}
        self.stable: dict[tuple[int, int], bool] = {}
        self.split_latin = re.compile(_LATIN).findall if pattern == _LATIN_OF else None
        self.cache: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}

    def pieces(self, text: str) -> list[str]:
        if self.split_latin:
            try:
                text.encode("latin-1")
                return self.split_latin(text)
            except UnicodeEncodeError:
                pass
        return self.split_exact(text) if self.later(text) else self.split(text)

    def merge(self, data: bytes) -> list[int]:
        """Repeatedly merge the leftmost neighbouring pair of lowest rank, found by a scan."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        if len(data) > 128:
            return self.merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while pairs:
            best = min(pairs)
            if best == 1 << 60:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]

    def merged(self, data: bytes) -> list[int]:
        """``merge``, remembered for leaves and windows of a few bytes."""
        if (found := self.memo.get(data)) is None:
            found = self.merge(data)
            if len(data) <= 12:
                if len(self.memo) >= CACHE:
                    self.memo.clear()
                self.memo[data] = found
        return found

    def merge_long(self, data: bytes) -> list[int]:
        """The same merges with a heap over a linked list of parts: n log n for long windows."""
        ranks, n = self.ranks, len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has been merged since
            part[i] += part[j]
            part[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
        return [ranks[p] for p in part if p is not None]

    def is_stable(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens are the encoding of their own bytes."""
        known = self.stable.get((left, right))
        if known is None:
            if len(self.stable) >= CACHE:
                self.stable.clear()
            known = self.stable[left, right] = self.merge(self.bytes[left] + self.bytes[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings: the monoid's operation."""
        if not left or not right:
            return left + right
        i, j, step = len(left), 0, 1  # the window holds left[i:] and right[:j]
        window: list[int] = []
        while True:
            before = not i or self.is_stable(left[i - 1], window[0] if window else right[0])
            after = j == len(right) or self.is_stable(window[-1] if window else left[-1], right[j])
            if before and after:
                return left[:i] + window + right[j:]
            if not before:
                i = max(0, i - step)
            if not after:
                j = min(len(right), j + step)
            step *= 2
            window = self.merged(b"".join(map(self.bytes.__getitem__, left[i:] + right[:j])))

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def encode_piece(self, piece: str) -> tuple[tuple[int, ...], str]:
        """Ids of a piece, and the ids in decimal, joined by commas."""
        if (found := self.older.get(piece)) is None:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            ids = (whole,) if whole is not None else tuple(self.encode_bytes(data))
            found = ids, ",".join(map(str, ids))
        if len(piece) <= 64:
            if len(self.cache) >= CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[piece] = found
        return found

    def encode_both(self, text: str) -> tuple[list[int], str]:
        """Token ids of a text, and their decimal list. Pieces never merge: joining them is concatenation."""
        get, encode = self.cache.get, self.encode_piece
        found = []
        for p in self.pieces(text) if text else ():
            if (x := get(p)) is None:
                x = encode(p)
                get = self.cache.get
            found.append(x)
        return list(chain.from_iterable([x[0] for x in found])), ",".join([x[1] for x in found])

    def encode(self, text: str) -> list[int]:
        return self.encode_both(text)[0]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, concatenated up a tree of halves; runs of up to RUN ids are leaves."""

        def up(start: int, end: int) -> bytes:
            if end - start <= RUN:
                return b"".join(map(self.bytes.__getitem__, ids[start:end]))
            half = (start + end) // 2
            return up(start, half) + up(half, end)

        return up(0, len(ids))


_coders: dict[tuple[str, str], TreeBpe] = {}


def coder(path: str, pattern: str) -> TreeBpe:
    """One coder per worker process and vocabulary file."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = TreeBpe(load_ranks(path), pattern)
    return _coders[path, pattern]


def bpe(text: Column, path: str, pattern: str, with_ids: bool = False) -> Column:
    """A struct of n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    A null or empty text has no tokens: 0 and the hashes of the empty string. ``path`` names the rank file, which must
    lie at the same place on every worker.
    """
    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    @F.arrow_udf(f"struct<{fields}>")
    def run(texts: pa.Array) -> pa.Array:
        own = coder(path, pattern)
        counts, hashes, decoded, lists = [], [], [], []
        for value in texts:
            ids, decimal = own.encode_both(value.as_py() or "")
            counts.append(len(ids))
            hashes.append(hashlib.sha256(decimal.encode()).hexdigest())
            decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            if with_ids:
                lists.append(pa.array(ids, pa.int32()))
        out = [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            starts = [0]
            for n in counts:
                starts.append(starts[-1] + n)
            flat = pa.concat_arrays(lists) if lists else pa.array([], pa.int32())
            out, names = [*out, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), flat)], [*names, "ids"]
        return pa.StructArray.from_arrays(out, names)

    return run(text)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) for each row; other columns are not read, so they may have any
    name.

    One row out per row in, repeated rows and null ids included; null and empty texts have no ids; an empty table gives an
    empty one. Very long texts are encoded in whole; of tied merges the leftmost goes first.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    done = docs.select("doc_id", bpe(F.col("text"), path, pattern, with_ids).alias("_bpe"))
    return done.select("doc_id", *(F.col(f"_bpe.{n}").alias(n) for n in names))
