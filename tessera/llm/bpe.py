"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each match of the split pattern is merged by itself. Its adjacent pairs wait in buckets, one
per merge rank, that hold linked-list positions (leftmost first); a three-level bitmap over
the ranks finds the next rank by find-first-set, so a merge costs the same however long the
pre-token is. Entries whose pair has changed since are stale and skipped when they come up.
Pre-tokens not seen before share one queue, which changes no result and spreads its cost.

Words repeat. A slice of texts is cut at single spaces and its distinct pieces are looked at once each (a piece between
single spaces is split by the pattern alike in any text; a text with a space beside other white space is split
whole); ids then go to the texts as one gather of numbers. A worker remembers the ids of pre-tokens in two
generations of ``MEMORY_BYTES``: a full one becomes the old one, and words met again come back from there.

Defined results: null text is encoded as the empty text (no ids, empty bytes); special tokens
are ordinary text; rows repeat as they are; a null ``doc_id`` keeps its row; an empty table
gives no row; other columns are kept as they are unless they are called as one of the new ones, which then
replaces them.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ranges, slices

MEMORY_BYTES = 72 << 20  # of remembered words, a generation
MERGED_BYTES = 1 << 18
ENCODED_BYTES = 8 << 20  # of text at once
WORD_BYTES = 190         # that an entry takes beside its letters and ids
#: A piece that the pattern cuts into its letters and its marks, if it has any.
LETTERS = r"^(?P<letters>[A-Za-z]+)(?P<marks>[.,;:!?]*)\z"
#: A space beside another white space: there the pattern looks across.
TOUCHING = r" [\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}] "


def load_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of positions per rank under a bitmap of three levels of 64-bit words."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.bucket: dict[int, list[int]] = {}

    def open(self, rank: int, positions: list[int]) -> None:
        """A new bucket."""
        self.bucket[rank] = positions
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def take(self) -> tuple[int, list[int]]:
        """The least rank and its bucket, removed; rank -1: empty."""
        if not self.top:
            return -1, []
        i = (self.top & -self.top).bit_length() - 1
        m = self.mid[i]
        i = i << 6 | (m & -m).bit_length() - 1
        w = self.low[i]
        rank = i << 6 | (w & -w).bit_length() - 1
        self.low[i] = w = w & (w - 1)
        if not w:
            self.mid[i >> 6] &= ~(1 << (i & 63))
            if not self.mid[i >> 6]:
                self.top &= ~(1 << (i >> 6))
        return rank, self.bucket.pop(rank)


class Words:
    """Ids of words in one flat array, grown as needed."""

    def __init__(self):
        self.row: dict[str, int] = {}
        self.ids = np.zeros(1 << 12, np.int32)
        self.end = np.zeros(1 << 10, np.int64)  # of the row before
        self.bytes = 0

    def add(self, words: list[str], flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Append words that are not there yet; their rows."""
        n, fill = len(self.row), int(self.end[len(self.row)])
        if n + len(words) >= len(self.end):
            self.end = np.concatenate([self.end, np.zeros(n + len(words), np.int64)])
        if fill + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(fill + len(flat), np.int32)])
        self.ids[fill:fill + len(flat)] = flat
        self.end[n + 1:n + 1 + len(words)] = fill + np.cumsum(size)
        self.row.update(zip(words, range(n, n + len(words))))
        self.bytes += WORD_BYTES * len(words) + 4 * len(flat) + sum(map(len, words))
        return np.arange(n, n + len(words))

    def take(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these rows, flat, and the size of each."""
        size = self.end[row + 1] - self.end[row]
        return self.ids[ranges(self.end[row], size)], size


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        top = max(ranks.values(), default=0)
        self.queue = RankQueue(top)
        self.known, self.old = Words(), Words()
        vocab: list[bytes] = [b""] * (top + 1)
        self.first = np.full(1 << 16, -1, np.int64)  # rank of each pair of bytes
        for t, r in ranks.items():
            vocab[r] = t
            if len(t) == 2:
                self.first[t[0] << 8 | t[1]] = r
        self.tokens = pa.array(vocab, pa.large_binary())
        self.numbers = pa.array([b"%d " % r for r in range(top + 1)], pa.large_binary())

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token. All go through one queue: no pair crosses their bounds."""
        get, queue = self.ranks.get, self.queue
        bucket = queue.bucket
        data = b"".join(pieces)
        n = len(data)
        if not n:
            return [[] for _ in pieces]
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        pairs = np.append(self.first[raw[:-1] << 8 | raw[1:]], -1)
        pairs[ends[sizes > 0] - 1] = -1
        waiting = np.flatnonzero(pairs >= 0)
        order = waiting[np.argsort(pairs[waiting], kind="stable")]
        ranks = pairs[order]
        cut = np.flatnonzero(np.diff(ranks, prepend=-1))
        for r, at in zip(ranks[cut].tolist(), np.split(order, cut[1:]) if len(cut) else []):
            queue.open(r, at.tolist())
        pair, stop = pairs.tolist(), np.repeat(ends, sizes).tolist()
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        for e, k in zip(ends.tolist(), sizes.tolist()):
            if k:
                prev[e - k] = -1
        while True:
            rank, line = queue.take()
            if rank < 0:
                break
            line.sort()  # leftmost first
            for done, i in enumerate(line, 1):
                if pair[i] != rank:
                    continue  # stale
                back = False
                j = nxt[i]
                k = nxt[j]
                nxt[i] = k
                pair[j] = pair[i] = -1
                if k < stop[i]:
                    prev[k] = i
                    new = get(data[i:nxt[k]])
                    if new is not None:
                        pair[i] = new
                        if new in bucket:
                            bucket[new].append(i)
                        else:
                            queue.open(new, [i])
                        back = new <= rank
                h = prev[i]
                if h >= 0:
                    new = get(data[h:k])
                    if new is None:
                        pair[h] = -1
                    elif pair[h] != new:
                        pair[h] = new
                        if new in bucket:
                            bucket[new].append(h)
                        else:
                            queue.open(new, [h])
                        back = back or new <= rank
                if back:  # a rank that comes first again: the rest of this bucket waits
                    rest = bucket.get(rank)
                    if rest is not None:
                        rest += line[done:]
                    elif done < len(line):
                        queue.open(rank, line[done:])
                    break
        out, ranks = [], self.ranks
        for e, k in zip(ends.tolist(), sizes.tolist()):
            i, ids = e - k, []
            while i < e:
                j = nxt[i]
                ids.append(ranks[data[i:j]])
                i = j
            out.append(ids)
        return out

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the size of each; a bounded number of bytes is merged at a time."""
        ranks, out, size = self.ranks, [], np.empty(len(words), np.int64)
        line, at, held = [], [], 0
        parts: list = [None] * len(words)
        for i, w in enumerate(words):
            raw = w.encode()
            whole = ranks.get(raw)
            if whole is not None:
                parts[i] = (whole,)
                continue
            line.append(raw)
            at.append(i)
            held += len(raw)
            if held > MERGED_BYTES:
                for j, ids in zip(at, self.merge(line)):
                    parts[j] = ids
                line, at, held = [], [], 0
        for j, ids in zip(at, self.merge(line)):
            parts[j] = ids
        size[:] = [len(x) for x in parts]
        for x in parts:
            out += x
        return np.array(out, np.int32), size

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, flat, and the size of each."""
        known, old = self.known, self.old
        row = np.fromiter(map(known.row.get, words, repeat(-1)), np.int64, len(words))
        miss = np.flatnonzero(row < 0).tolist()
        if miss:
            before = np.fromiter((old.row.get(words[i], -1) for i in miss), np.int64, len(miss))
            again = np.array(miss, np.int64)[before >= 0]
            row[again] = known.add([words[i] for i in again.tolist()], *old.take(before[before >= 0]))
            new = [i for i, k in zip(miss, before.tolist()) if k < 0]
            fresh = [words[i] for i in new]
            row[new] = known.add(fresh, *self._merged(fresh))
        out = known.take(row)
        if known.bytes > MEMORY_BYTES:
            # older words are still found, and come back when they are; those not met in the meantime are forgotten
            self.known, self.old = Words(), known if known.bytes < 2 * MEMORY_BYTES else Words()
        return out

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the n + 1 offsets of the texts in them."""
        # very many short lists and no cycles: the cycle collector would only walk them over and over
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode_texts(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        whole = pc.match_substring_regex(texts, TOUCHING).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        first = lists.offsets.to_numpy().astype(np.int64)
        first -= first[0]
        coded = lists.flatten().dictionary_encode()
        # an item is a piece with the space before it, or a text's first piece, or a whole text
        item = coded.indices.to_numpy().astype(np.int64)
        heads = coded.dictionary.take(coded.indices.take(pa.array(first[:-1]))).to_pylist()
        for i in np.flatnonzero(whole).tolist():
            heads[i] = texts[i].as_py()
        item[first[:-1]] = np.arange(len(coded.dictionary), len(coded.dictionary) + n)
        words, count = self._cut(coded.dictionary, heads)
        distinct = words.dictionary_encode()
        flat, size = self.ids_of(distinct.dictionary.to_pylist())
        # words to items, items to texts
        number = distinct.indices.to_numpy()
        start, size = (np.cumsum(size) - size)[number], size[number]
        flat = flat[ranges(start, size)]
        end = np.concatenate([[0], np.cumsum(size)])
        stop = np.cumsum(count)
        start, size = end[stop - count], end[stop] - end[stop - count]
        flat = flat[ranges(start[item], size[item])]
        return flat, np.concatenate([[0], np.cumsum(size[item])])[first]

    def _cut(self, pieces: pa.Array, heads: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The pre-tokens of every item, flat, and how many each has: of " " + piece for all pieces, then of the heads."""
        parts = pc.extract_regex(pieces, LETTERS)  # letters and at most one run of marks: cut without the pattern
        plain = np.asarray(pc.is_valid(parts))
        letters, marks = (parts.field(i).filter(pa.array(plain)) for i in (0, 1))
        marked = np.asarray(pc.binary_length(marks)) > 0
        other = list(map(self.split, pc.binary_join_element_wise("", pieces.filter(pa.array(~plain)), " ").to_pylist()))
        other += map(self.split, heads)
        count = np.empty(len(pieces) + len(heads), np.int64)
        at = np.concatenate([np.flatnonzero(~plain), np.arange(len(pieces), len(count))])
        count[at] = [len(ws) for ws in other]
        at_plain = np.flatnonzero(plain)
        count[at_plain] = 1 + marked
        words = pa.concat_arrays([pc.binary_join_element_wise("", letters, " "), marks.filter(pa.array(marked)),
                                  pa.array([w for ws in other for w in ws], pa.string())])
        # bring them into the order of the items
        start = np.cumsum(count) - count
        place = np.concatenate([start[at_plain], start[at_plain[marked]] + 1, ranges(start[at], count[at])])
        order = np.empty_like(place)
        order[place] = np.arange(len(place))
        return words.take(pa.array(order)), count

    def encode(self, text: str) -> list[int]:
        return self.encode_texts(pa.array([text]))[0].tolist()

    def decode_texts(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The bytes of every text."""
        return _joined(self.tokens, ids, at)

    def decimals(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The decimal ids of every text, each followed by a space."""
        return _joined(self.numbers, ids, at)


def _joined(parts: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """For each stretch of ``ids``, its parts one behind the other: they lie so already, only offsets differ."""
    got = parts.take(pa.array(ids))
    _, offsets, data = got.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(offsets[at].tobytes()), data])


_ENCODERS: dict = {}


def _encoder(key: int, ranks, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary, so that its memory of words lives on."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


#: What can be asked for, with its SQL type.
OUTPUTS = {"ids": "array<int>", "decoded": "binary", "n_tokens": "long", "ids_sha256": "string",
           "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text",
                  outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Every row with the columns ``outputs`` added: the ids, their number, the bytes they decode to, and the SHA-256
    of the decimal ids joined by one space and of the decoded bytes."""
    ranks = load_ranks(ranks_path)  # the vocabulary: its size is fixed by the file
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    rest = docs.drop(*outputs)
    names = rest.columns

    def run(batches):
        enc = _encoder(hash((ranks_path, len(shared.value))), shared.value, pattern)
        digest = lambda x: pa.array([hashlib.sha256(v.as_buffer() or b"").hexdigest() for v in x])
        for b in slices(batches, text_col, ENCODED_BYTES):
            flat, at = enc.encode_texts(pc.fill_null(b.column(text_col), ""))
            made = {"n_tokens": lambda: pa.array(np.diff(at)), "ids": lambda: pa.ListArray.from_arrays(
                pa.array(at.astype(np.int32)), pa.array(flat))}
            if {"decoded", "decoded_sha256"} & set(outputs):
                text = enc.decode_texts(flat, at)
                made["decoded"] = lambda: text.cast(pa.binary())
                made["decoded_sha256"] = lambda: digest(text)
            if "ids_sha256" in outputs:
                # the last space of a text is not part of it
                lines = pc.binary_slice(enc.decimals(flat, at), 0, -1)
                made["ids_sha256"] = lambda: digest(lines)
            yield pa.RecordBatch.from_arrays([*b.columns, *[made[c]() for c in outputs]], [*names, *outputs])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields]
    return rest.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(
        run, ", ".join([*kinds, *[f"{c} {OUTPUTS[c]}" for c in outputs]]))
