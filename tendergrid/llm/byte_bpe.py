"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by a heap over linked bytes.

The rank file is read once on the driver, the tables built from it are bounded
by the vocabulary and broadcast. Texts are encoded where they lie, without a
shuffle. Texts are cut before every space that is followed by something else than
white space, where a match of the pattern always begins. A worker resolves a few
texts at a time and remembers short words only, up to REMEMBERED bytes of them;
a long one (a text without spaces is one word) is forgotten with its texts. Words
are remembered in two halves: once the newer is full, the older is forgotten but
for the words met again meanwhile, so the frequent ones are never merged anew.

Null text counts as empty and gives no ids. Repeated rows each get their ids.
An empty table gives an empty result. Added columns replace none: callers name
what to keep.
"""

import base64
import re
import struct
from heapq import heapify, heappop, heappush
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Bytes of words, their ids and the table around them that a worker remembers, in both halves.
REMEMBERED = 96 << 20
ENTRY_BYTES = 250
# Code points of a word worth remembering, and of texts resolved together.
LONGEST, TOGETHER = 64, 1 << 20
# Bytes of a piece in which looking over all pairs is faster than a heap, and the rank of no token.
SHORT, NONE = 24, 1 << 40
# Texts taken from an Arrow batch at a time.
TEXTS = 256
# A space with white space after it; this \s holds all of Unicode's.
_WIDE_GAP = re.compile(r" \s")
_CUT = re.compile(r"(?= \S)")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str) -> list[str]:
    """The text, cut before every space that something else than white space follows."""
    if text[-1:] == " " or "\0" in text or _WIDE_GAP.search(text):
        return _CUT.split(text)
    return text.replace(" ", "\0 ").split("\0")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _hashes(tokens: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens))


def _slots(hashes: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    mixed = (hashes ^ (seeds.astype(np.uint64) * _MIX)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    return ((mixed * _MIX) >> np.uint64(33)).astype(np.int64) % size


class PerfectHash:
    """Hash and displace: every bucket of keys has the first seed that sends it to free slots.

    As many slots as keys. Buckets of one key name their slot outright, as -1 - slot.
    """

    def __init__(self, tokens: list[bytes] = ()):
        size = len(tokens)
        self.buckets = size + 1
        hashes = _hashes(tokens)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        members = np.split(order, np.cumsum(np.bincount(bucket, minlength=self.buckets))[:-1])
        self.seeds = np.zeros(self.buckets, np.int64)
        self.keys: list[bytes | None] = [None] * size
        self.values = np.zeros(size, np.int64)
        taken = np.zeros(size, bool)
        single = []
        for number in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[number]
            if len(own) == 1:
                single.append(number)
            if len(own) < 2:
                continue
            seed = 0
            while True:
                slots = _slots(hashes[own], np.full(len(own), seed), size)
                if not taken[slots].any() and len(set(slots.tolist())) == len(own):
                    break
                seed += 1
            self.seeds[number] = seed
            self._put(tokens, own, slots, taken)
        for number, slot in zip(single, np.flatnonzero(~taken), strict=False):
            self.seeds[number] = -1 - slot
            self._put(tokens, members[number], np.array([slot]), taken)

    def _put(self, tokens, own, slots, taken):
        taken[slots] = True
        for place, key in zip(slots.tolist(), own.tolist(), strict=True):
            self.keys[place] = tokens[key]
            self.values[place] = key

    def find(self, tokens: list[bytes]) -> list[int]:
        """Index of each token among the keys, -1 for strangers."""
        if not self.keys:
            return [-1] * len(tokens)
        hashes = _hashes(tokens)
        seeds = self.seeds[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(seeds < 0, -1 - seeds, _slots(hashes, np.maximum(seeds, 0), len(self.keys)))
        values = self.values[slots].tolist()
        return [
            value if self.keys[slot] == token else -1
            for token, slot, value in zip(tokens, slots.tolist(), values, strict=True)
        ]


def first_pairs(ranks: dict[bytes, int]) -> list[list[int]]:
    """Rank of each pair of bytes, -1 for none."""
    return [[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[list[int]]) -> list[int]:
    """Ranks of the parts of a piece; always merges the leftmost pair of lowest rank.

    The heap holds rank and start in one number. An entry counts while the pair
    that starts there still has that rank; ranks are unique, so it is then the same pair.
    """
    size = len(piece)
    shift = size.bit_length()
    mask = (1 << shift) - 1
    rank_of = ranks.get
    left, right = list(range(-1, size - 1)), list(range(1, size + 1))
    pair = [pairs[a][b] for a, b in zip(piece, piece[1:])]  # noqa: B905
    pair.append(-1)
    heap = [rank << shift | i for i, rank in enumerate(pair) if rank >= 0]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i = entry & mask
        if pair[i] != entry >> shift:
            continue
        gone = right[i]
        after = right[i] = right[gone]
        pair[gone] = pair[i] = -1
        if after < size:
            left[after] = i
            rank = pair[i] = rank_of(piece[i : right[after]], -1)
            if rank >= 0:
                heappush(heap, rank << shift | i)
        before = left[i]
        if before >= 0:
            rank = pair[before] = rank_of(piece[before:after], -1)
            if rank >= 0:
                heappush(heap, rank << shift | before)
    ids, i = [], 0
    while i < size:
        ids.append(ranks[piece[i : right[i]]])
        i = right[i]
    return ids


def merge_short(piece: bytes, ranks: dict[bytes, int], pairs: list[list[int]]) -> list[int]:
    """What `merge` returns, by looking for the leftmost lowest rank each time."""
    starts = list(range(len(piece) + 1))
    pair = [pairs[a][b] for a, b in zip(piece, piece[1:])]  # noqa: B905
    pair = [rank if rank >= 0 else NONE for rank in pair]
    rank_of = ranks.get
    while pair:
        lowest = min(pair)
        if lowest == NONE:
            break
        i = pair.index(lowest)
        del pair[i], starts[i + 1]
        if i < len(pair):
            pair[i] = rank_of(piece[starts[i] : starts[i + 2]], NONE)
        if i:
            pair[i - 1] = rank_of(piece[starts[i - 1] : starts[i + 1]], NONE)
    return [ranks[piece[a:b]] for a, b in zip(starts, starts[1:])]  # noqa: B905


def tables(ranks: dict[bytes, int], pattern: str) -> dict:
    """What an encoder needs, in plain types; `words` and `older` are its memory, which grows with use."""
    # White space in the library the rank files are made for is the Unicode property alone.
    pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
    return {
        "ranks": ranks,
        "tokens": list(ranks),
        "pairs": first_pairs(ranks),
        "by_rank": {rank: token for token, rank in ranks.items()},
        "hash": vars(PerfectHash(list(ranks))),
        "pattern": pattern.replace(r"\S", r"\P{White_Space}"),
        "words": {},
        "older": {},
        "held": [0],
    }


class Encoder:
    """Text to packed ids (little-endian unsigned 32 bit) and back."""

    def __init__(self, tables: dict):
        import regex

        self.ranks, self.tokens, self.pairs = tables["ranks"], tables["tokens"], tables["pairs"]
        self.by_rank, self.words, self.older = tables["by_rank"], tables["words"], tables["older"]
        self.held = tables["held"]
        self.hash = PerfectHash()
        vars(self.hash).update(tables["hash"])
        self.split = regex.compile(tables["pattern"]).findall

    def _learn(self, texts: set[str]) -> None:
        """Resolve the pieces of new words together; the frequent ones are known already."""
        split, words, older, known = self.split, self.words, self.older, {}
        cut = {}
        for text in texts:
            found = cut[text] = split(text)
            known.update(dict.fromkeys(found))
        # A piece may have been met as a word of its own.
        pieces = []
        for piece in known:
            met = words.get(piece) or older.get(piece)
            if met is None:
                pieces.append(piece)
            else:
                known[piece] = met
        tokens = [piece.encode() for piece in pieces]
        ranks, pairs = self.ranks, self.pairs
        for piece, token, place in zip(pieces, tokens, self.hash.find(tokens), strict=True):
            if place >= 0:
                ids = [ranks[self.tokens[place]]]
            else:
                ids = (merge_short if len(token) <= SHORT else merge)(token, ranks, pairs)
            known[piece] = struct.pack(f"<{len(ids)}I", *ids)
        # So that the same piece with another mark after it need not be merged again.
        kept = [piece for piece in pieces if len(piece) <= LONGEST and piece not in cut]
        words.update(zip(kept, map(known.__getitem__, kept), strict=True))
        self.held[0] += len(kept) * ENTRY_BYTES + 8 * sum(map(len, kept))
        for text, found in cut.items():
            words[text] = known[found[0]] if len(found) == 1 else b"".join([known[piece] for piece in found])

    def encode(self, texts: list[str]) -> list[bytes]:
        made, start = [], 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= TOGETHER):
                size += len(texts[end])
                end += 1
            made += self._encode(texts[start:end])
            start = end
        return made

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [_words(text) for text in texts]
        new = set()
        for parts in cut:
            new.update(parts)
        # In time of the new texts: difference_update would go through all that is remembered.
        new = {word for word in new if word not in self.words}
        again = [word for word in new if word in self.older]
        self.words.update(zip(again, map(self.older.__getitem__, again), strict=True))
        self._learn(new.difference(again))
        ids = self.words.__getitem__
        made = [b"".join(map(ids, parts)) for parts in cut]
        long = [word for word in new if len(word) > LONGEST]
        for word in long:
            del self.words[word]
        # Four bytes an id, and no more ids than bytes.
        self.held[0] += (len(new) - len(long)) * ENTRY_BYTES + 8 * (sum(map(len, new)) - sum(map(len, long)))
        if self.held[0] > REMEMBERED // 2:
            self.older.clear()
            self.older.update(self.words)
            self.words.clear()
            self.held[0] = 0
        return made

    def decode(self, packed: list[bytes]) -> list[bytes]:
        return Decoder(self.by_rank).decode(packed)


class Decoder:
    """Packed ids to bytes; all it needs are the tokens by rank."""

    def __init__(self, by_rank: dict[int, bytes]):
        self.by_rank = by_rank

    def decode(self, packed: list[bytes]) -> list[bytes]:
        token = self.by_rank.__getitem__
        return [b"".join(map(token, np.frombuffer(ids, "<u4").tolist())) for ids in packed]


class Shared(NamedTuple):
    """Broadcasts of what the workers of either way need; those that decode hold no table for encoding."""

    encode: Any
    decode: Any


def _added(rows: DataFrame, shared: Shared, read: str, add: str, method: str) -> DataFrame:
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(add, T.BinaryType())])

    worker, given = {"encode": Encoder, "decode": Decoder}[method], getattr(shared, method)

    def run(batches):
        work = getattr(worker(given.value), method)
        blank = "" if method == "encode" else b""
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                made = work([value or blank for value in batch.column(read).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*names, add])

    return rows.mapInArrow(run, schema)


def share(rows: DataFrame, path: str, pattern: str) -> Shared:
    """The tables as broadcasts; their size is that of the vocabulary."""
    made, context = tables(read_ranks(path), pattern), rows.sparkSession.sparkContext
    return Shared(context.broadcast(made), context.broadcast(made["by_rank"]))


def encode(rows: DataFrame, encoder, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the packed ids of a text column."""
    return _added(rows, encoder, text, ids, "encode")


def decode(rows: DataFrame, encoder, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes that packed ids stand for."""
    return _added(rows, encoder, ids, decoded, "decode")


def round_trip(rows: DataFrame, encoder, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows without the text, with its packed ids and the bytes that those decode to.

    One worker does both ways, so a core holds one worker's memory and the ids pass to the JVM once.
    """
    fields = [field for field in rows.schema.fields if field.name != text]
    names = [field.name for field in fields]
    schema = T.StructType([*fields, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.BinaryType())])

    def run(batches):
        work = Encoder(encoder.encode.value)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                packed = work.encode([value or "" for value in batch.column(text).to_pylist()])
                made = [pa.array(packed, pa.binary()), pa.array(work.decode(packed), pa.binary())]
                yield pa.RecordBatch.from_arrays([*map(batch.column, names), *made], [*names, ids, decoded])

    return rows.mapInArrow(run, schema)


def digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, number of tokens, digests of the ids and of the decoded bytes."""
    made = round_trip(documents.select("doc_id", "text"), share(documents, path, pattern))
    return made.select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
