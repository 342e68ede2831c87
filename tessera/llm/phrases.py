"""Phrase collocation mining: frequent n-grams from an FM-index per shard, scored by their weakest cut.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+``. A
shard is a bounded amount of text of one language, written once as word ids with a separator between pieces. Its
index is the BWT of the ids and the BWT of the ids reversed, both sorted to a depth of eight words. A phrase is a pair of
synchronised intervals, one in each; extending it to the right steps in the reversed BWT, to the left in the other, for
all phrases of a shard at once, and gives every extension with its count. An n-gram is only enumerated if the parts of it
that are already known are frequent in the whole corpus, so a shard's output stays small.

Rounds: the words, their pairs, then all longer phrases. In a round every shard sends its phrases with their counts,
packed into one block a bucket; a bucket adds up the shards' counts and returns the frequent phrases, and to every
block one bit for each of its phrases. The shards stay where they were written (a table bucketed by shard): only the
bits travel back to them; a shard's index is built where it is read (two sorts of numbers cost less than
moving or keeping two more copies of the text), and the same extensions find the intervals again. A bucket holds one entry a shard
of a phrase at most, however often the phrase occurs.

A phrase of ``a`` occurrences cut in two parts of ``l`` and ``r`` occurrences among ``n`` words scores
floor(1000 a n / (l r)); its lowest cut counts (ties: the shortest first part). A phrase is dropped if one that
contains it is as frequent; that is decided by its extensions by one word, which are at least as frequent as any
longer one. Numbers are exact (decimals of 38 digits).

Defined results: null text is empty, a null language is ``und`` (with rows that say so); equal rows count as often as
they occur; a text of any length is whole in one shard; an empty table gives no row; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import input_bytes, ranges, save, slices
from tessera.llm.substr import _mix
from tessera.session import scratch_path

SHARD_BYTES = 8 << 20   # of text; more only where one document has more
HELD_BYTES = 24 << 20   # texts of all languages that a task holds back at most
TABLE_BYTES = 96 << 20  # text behind one bucket of shards
BUCKET_BYTES = 32 << 20  # text behind one bucket of phrases
DEPTH = 8               # words that the suffixes are sorted by
SALTS = 64
LONGEST = 5

BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if c in BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
SHARD = "shard long, lang string, total long, words binary, ids binary"
BLOCKS = "bucket long, shard long, lang string, block binary"
#: A frequent phrase, or the bits of a block.
FOUND = "lang string, phrase string, f long, shard long, bucket long, bits binary"


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and for each whether a piece begins with it."""
    data = b"\n".join(texts).translate(_TABLE)
    raw = np.frombuffer(data, np.uint8)
    gap = (raw == 32) | (raw == 10)
    start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]) if len(gap) else gap)
    piece = np.cumsum(raw == 10)[start]
    words = pc.ascii_split_whitespace(pa.array([data.decode()])).flatten()
    words = words.filter(pc.greater(pc.binary_length(words), 0))
    return words, np.concatenate([[True], piece[1:] != piece[:-1]])[:len(start)]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions of the (circular) text by the ``DEPTH`` symbols that begin there, by prefix doubling."""
    n, rank, width = len(symbols), symbols.astype(np.int64), 1
    place, at = n.bit_length(), np.arange(n)
    while width < DEPTH:
        bits = int(rank.max()).bit_length()
        key = rank << bits | np.roll(rank, -width)
        if 2 * bits + place <= 63:  # positions ride along: one sort of plain numbers
            key = np.sort(key << place | np.arange(n))
            at, key = key & (1 << place) - 1, key >> place
        else:
            at = np.argsort(key, kind="stable")
            key = key[at]
        rank = np.empty_like(rank)
        rank[at] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        width *= 2
    return at


def build(texts: list[bytes]) -> tuple[int, bytes, bytes] | None:
    """(number of words, vocabulary, ids), the latter two packed; None without words."""
    words, begins = split_words(texts)
    if not len(words):
        return None
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)  # symbols in the order of the words: neighbours look alike and pack well
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    text = np.zeros(len(words) + int(begins.sum()), np.int64)  # symbol 0 separates pieces
    text[np.arange(len(words)) + np.cumsum(begins)] = rank[coded.indices.to_numpy()] + 1
    vocabulary = pc.binary_join(pa.ListArray.from_arrays([0, len(order)], coded.dictionary.take(order)), "\n")
    return len(words), _zip(vocabulary[0].as_buffer().to_pybytes()), _pack_symbols(text)


def _pack_symbols(symbols: np.ndarray) -> bytes:
    """All lowest bytes, then all second bytes, and so on."""
    return _zip(symbols.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack_symbols(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzip(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


class Index:
    """A shard's index: the BWTs of its ids and of its ids reversed with their LF mappings, and the inverse of the first."""

    def __init__(self, words: int, ids: np.ndarray):
        self.width = words + 1
        self.bwt, self.rbwt = (t[suffix_order(t) - 1] for t in (ids, ids[::-1]))
        self.psi, self.lf = self._maps(self.bwt)
        _, self.rlf = self._maps(self.rbwt)
        count = np.bincount(ids, minlength=self.width)
        self.first = np.repeat(np.arange(self.width), count)  # first symbol of every row
        self.count, self.start = count[1:], np.cumsum(count)[:-1]  # of every word

    @staticmethod
    def _maps(bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        psi = np.sort(bwt << 32 | np.arange(len(bwt))) & 0xFFFFFFFF
        lf = np.empty_like(psi)
        lf[psi] = np.arange(len(psi))
        return psi, lf

    def extend(self, lo: np.ndarray, rlo: np.ndarray, n: np.ndarray, right: bool):
        """Every extension by one word of the phrases with these intervals: (lo, rlo, n)."""
        bwt, lf, own, other = (self.rbwt, self.rlf, rlo, lo) if right else (self.bwt, self.lf, lo, rlo)
        row = ranges(own, n)
        group = np.repeat(np.arange(len(n)), n)
        key = group * self.width + bwt[row]
        place = len(row).bit_length()
        if len(row) and int(key[-1] + self.width).bit_length() + place <= 63:
            key = np.sort(key << place | np.arange(len(row)))
            at, key = key & (1 << place) - 1, key >> place
        else:
            at = np.argsort(key, kind="stable")
            key = key[at]
        cut = np.flatnonzero(np.diff(key, prepend=-1))
        size = np.diff(np.append(cut, len(key)))
        # rows of the other interval are sorted by the new word, separators first
        group = group[at[cut]]
        there = other[group] + cut - (np.cumsum(n) - n)[group]
        here = lf[row[at[cut]]]
        word = key[cut] % self.width > 0
        out = (there, here) if right else (here, there)
        return out[0][word], out[1][word], size[word]

    def grow(self, lo: np.ndarray, rlo: np.ndarray, n: np.ndarray, known: int, longest: int):
        """(length, lo, rlo, n) of longer phrases whose parts of ``known`` words are all among the given ones."""
        frequent = np.zeros(len(self.bwt), bool)
        frequent[ranges(lo, n)] = True
        for size in range(known, longest):
            right = size % 2 == 1
            lo, rlo, n = self.extend(lo, rlo, n, right)
            end = lo  # the new part of ``known`` words: at the end, or at the start
            for _ in range(size + 1 - known if right else 0):
                end = self.psi[end]
            keep = frequent[end]
            lo, rlo, n = lo[keep], rlo[keep], n[keep]
            yield size + 1, lo, rlo, n

    def symbols(self, lo: np.ndarray, size: int) -> list[np.ndarray]:
        """Word numbers of the phrases of ``size`` words that begin at these rows."""
        out = []
        for _ in range(size):
            out.append(self.first[lo] - 1)
            lo = self.psi[lo]
        return out


class Shard:
    """One row of the index table, with the ways to its phrases."""

    def __init__(self, row: dict, buckets: int):
        self.shard, self.lang, self.buckets = row["shard"], row["lang"], buckets
        self.vocabulary = pa.array(_unzip(row["words"]).decode().split("\n"))
        self.ids = _unpack_symbols(row["ids"])
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.vocabulary.cast(pa.binary()).to_pylist()),
                                  np.uint64, len(self.vocabulary))
        self.seed = np.uint64(xxhash.xxh3_64_intdigest(self.lang.encode()))

    def words(self) -> tuple[list[np.ndarray], np.ndarray]:
        """(word numbers, counts) of all words."""
        return [np.arange(len(self.vocabulary))], np.bincount(self.ids, minlength=len(self.vocabulary) + 1)[1:]

    def frequent(self, words: list[np.ndarray], bits: dict[int, bytes]) -> np.ndarray:
        """Whether the bit of each phrase (given by its words' numbers) is set."""
        at, cut = self._deal(words)
        keep = np.zeros(len(at), bool)
        for to, a, z in cut:
            if to in bits:
                keep[at[a:z]] = np.unpackbits(np.frombuffer(bits[to], np.uint8), count=z - a)
        return keep

    def _deal(self, words: list[np.ndarray]):
        """The order of the phrases by bucket, and each bucket's stretch of it."""
        h = np.full(len(words[0]), self.seed)
        for i in words:
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + self.hashes[i])
        to = (h % np.uint64(self.buckets)).astype(np.int64)
        at = np.argsort(to, kind="stable")
        start = np.flatnonzero(np.diff(to[at], prepend=-1))
        return at, list(zip(to[at[start]].tolist(), start.tolist(), [*start[1:].tolist(), len(at)]))

    def pack(self, words: list[np.ndarray], n: np.ndarray) -> pa.Table:
        """One row a bucket with the phrases that belong there and their counts."""
        at, cut = self._deal(words)
        if not cut:
            return _NO_BLOCKS
        phrases = pc.binary_join_element_wise(*[self.vocabulary.take(pa.array(i[at])) for i in words], " ")
        bodies = pc.binary_join(pa.ListArray.from_arrays(pa.array([a for _, a, _ in cut] + [len(at)], pa.int32()), phrases),
                                "\n")
        n = n[at].astype(np.int32)
        blocks = [_zip((z - a).to_bytes(8, "little") + n[a:z].tobytes() + body.as_buffer().to_pybytes() + b"\n")
                  for (_, a, z), body in zip(cut, bodies)]
        return pa.table([pa.array([to for to, _, _ in cut]), pa.array([self.shard] * len(blocks)),
                         pa.array([self.lang] * len(blocks)), pa.array(blocks, pa.binary())],
                        names=["bucket", "shard", "lang", "block"])

    def grown(self, bits: dict[int, dict[int, bytes]]):
        """(words, counts) of the phrases whose known parts are frequent: pairs, or with the bits of pairs all longer ones."""
        index = Index(len(self.vocabulary), self.ids)
        keep = self.frequent(self.words()[0], bits[1])
        size, lo, rlo, n = next(index.grow(index.start[keep], index.start[keep], index.count[keep], 1, 2))
        pairs = index.symbols(lo, size)
        if 2 not in bits:
            yield pairs, n
            return
        keep = self.frequent(pairs, bits[2])
        for size, lo, rlo, n in index.grow(lo[keep], rlo[keep], n[keep], 2, LONGEST):
            yield index.symbols(lo, size), n


_NO_BLOCKS = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.binary())],
                      names=["bucket", "shard", "lang", "block"])


def _sum_blocks(least: int, answer: bool):
    """The phrases of a bucket with at least ``least`` occurrences in all shards; with ``answer``, every block's bits."""
    def run(table: pa.Table) -> pa.Table:
        by_lang: dict[str, list] = {}
        for row in zip(*(table.column(c).to_pylist() for c in ("lang", "shard", "bucket", "block"))):
            by_lang.setdefault(row[0], []).append(row[1:])
        phrases, answers = [], []
        for lang, blocks in by_lang.items():
            sizes, numbers, bodies = [], [], []
            for _, _, block in blocks:
                raw = _unzip(block)
                sizes.append(int.from_bytes(raw[:8], "little"))
                numbers.append(np.frombuffer(raw, np.int32, sizes[-1], 8))
                bodies.append(raw[8 + 4 * sizes[-1]:])
            # every phrase ends with a newline, so the bodies are an array as they stand
            data = b"".join(bodies)
            ends = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1])
            coded = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]) \
                .dictionary_encode()
            which = coded.indices.to_numpy()
            f = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(f, which, np.concatenate(numbers))
            often = f >= least
            kept = pc.binary_slice(coded.dictionary.filter(pa.array(often)), 0, -1).cast(pa.binary()).cast(pa.string())
            phrases.append((pa.array([lang] * len(kept), pa.string()), kept, pa.array(f[often])))
            if answer:
                bits = np.split(often[which], np.cumsum(sizes)[:-1])
                answers += [(shard, bucket, np.packbits(x).tobytes()) for (shard, bucket, _), x in zip(blocks, bits)]
        lang, phrase, f = (pa.concat_arrays(x) for x in zip(*phrases))
        k = len(answers)
        shard, bucket, bits = zip(*answers) if answers else ((), (), ())
        none = lambda n, t: pa.nulls(n, t)
        return pa.table(
            [pa.concat_arrays([lang, none(k, pa.string())]), pa.concat_arrays([phrase, none(k, pa.string())]),
             pa.concat_arrays([f, none(k, pa.int64())]),
             pa.concat_arrays([none(len(f), pa.int64()), pa.array(shard, pa.int64())]),
             pa.concat_arrays([none(len(f), pa.int64()), pa.array(bucket, pa.int64())]),
             pa.concat_arrays([none(len(f), pa.binary()), pa.array(bits, pa.binary())])],
            names=["lang", "phrase", "f", "shard", "bucket", "bits"])
    return run


def _shards(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """One row a shard with its vocabulary and ids."""
    def run(batches):
        base = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        made = 0

        def flush(lang: str):
            nonlocal made
            size.pop(lang)
            packed = build(held.pop(lang))
            if packed:
                made += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip((base + made, lang, *packed), (
                        pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                    ["shard", "lang", "total", "words", "ids"])

        for b in slices(batches, "text", shard_bytes // 4):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                if size.get(lang, 0) and size[lang] + len(text) > shard_bytes:
                    yield from flush(lang)
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text) + 1
            while sum(size.values()) > 3 * shard_bytes:
                yield from flush(max(size, key=size.get))
        for lang in list(size):
            yield from flush(lang)

    return docs.mapInArrow(run, SHARD)


def _save_by_shard(spark: SparkSession, shards: DataFrame, buckets: int) -> DataFrame:
    """The shards as a table bucketed by shard, so that they need not move again to meet their bits."""
    path = scratch_path(spark, "phrases")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    shards.write.bucketBy(buckets, "shard").option("path", path).saveAsTable(name)
    return spark.table(name)


def count_phrases(docs: DataFrame, least: int = 100, lang_col: str = "lang", text_col: str = "text",
                  shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f) of all phrases of up to 5 words with at least ``least`` occurrences, (lang, n))."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts, size = int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(rows, "text")
    buckets = max(parts, size // BUCKET_BYTES)
    shards = _save_by_shard(spark, _shards(rows, shard_bytes), max(parts, size // TABLE_BYTES))
    total = shards.groupBy("lang").agg(F.sum("total").alias("n"))

    def words(table: pa.Table) -> pa.Table:
        own = Shard(table.to_pylist()[0], buckets)
        return own.pack(*own.words())

    def longer(shard: pa.Table, answers: pa.Table) -> pa.Table:
        if not shard.num_rows or not answers.num_rows:
            return _NO_BLOCKS
        own, bits = Shard(shard.to_pylist()[0], buckets), {}
        for r in answers.to_pylist():
            bits.setdefault(r["size"], {})[r["bucket"]] = r["bits"]
        return pa.concat_tables([_NO_BLOCKS, *[own.pack(*x) for x in own.grown(bits)]])

    answers, tables = None, []
    for size in (1, 2, 3):
        if size == 1:
            blocks = shards.groupBy("shard").applyInArrow(words, BLOCKS)
        else:
            blocks = shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(longer, BLOCKS)
        found = save(blocks.groupBy("bucket").applyInArrow(_sum_blocks(least, size < 3), FOUND), f"phrases-{size}")
        back = found.where(F.col("shard").isNotNull()).select("shard", F.lit(size).alias("size"), "bucket", "bits")
        answers = back if answers is None else answers.unionByName(back)
        tables.append(found.where(F.col("phrase").isNotNull()).select("lang", "phrase", "f"))
    out = tables[0].unionByName(tables[1]).unionByName(tables[2])
    return out.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f"), total


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text",
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each language's ``top`` phrases by score, occurrences and text: (lang, rank, phrase, a, l, r, n, score)."""
    found, total = count_phrases(docs, least, lang_col, text_col, shard_bytes)
    found = save(found, "phrases")
    part = lambda a, z: F.array_join(F.slice("w", a, z), " ")
    size = F.col("size")
    longer = found.where(size > 2).withColumn("w", F.split("phrase", " "))
    around = (longer.select("lang", "f", F.explode(F.array(part(F.lit(1), size - 1), part(F.lit(2), size - 1)))
                            .alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("around")))
    phrases = (found.where(size > 1).join(around, ["lang", "phrase"], "left")
               .where(F.coalesce("around", F.lit(0)) < F.col("f")).withColumn("w", F.split("phrase", " ")))
    cuts = (phrases.select("lang", "phrase", F.col("f").alias("a"), "size", "w",
                           F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
            .select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"),
                    part(F.col("k") + 1, size).alias("right")))
    of = lambda side, n: found.select("lang", F.col("phrase").alias(side), F.col("f").alias(n))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(total, "lang")
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = (cuts.withColumn("up", exact("a") * (F.col("n") * 1000).cast("decimal(19,0)"))
            .withColumn("down", exact("l") * exact("r")).withColumn("score", F.expr("up div down")))
    best = (cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("c"))
            .select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    few = best.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return few.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                                                  "score")
