"""Benchmark decontamination: BM25 over test items, searched with block-max WAND.

The test items are the index; every passage of every document is a query. An index goes to every task, so items beyond
``part_bytes`` are cut into parts, each with an index of its own over the statistics of all items; documents are
searched with one part after the other, and the results are those of a single index. Impacts are BM25 weights divided by the item's own score, so an item that
lies whole in a passage scores 1 and one threshold serves all items. A passage is a window
of ``width`` words every ``width / 2`` words, with ``width`` at least twice the longest item:
every item-long stretch of a document lies whole in some passage.

Retrieval gives all items above the threshold, in two steps that share the block maxima:
* for all passages of a slice at once, the sum of the block maxima of a passage's terms bounds
  what any item of a block can score; blocks below the threshold are skipped;
* in the passages that are left, WAND with block maxima: cursors in item order, a pivot by the
  terms' maxima, a check by block maxima, whole scoring only of items that may pass.
Each item found is verified in the passage: of the distinct word shingles of its question and of
its answer, the shares given must occur in the passage. Where the answer is only assumed, an item with changed
words counts as well: in a stretch of the passage not much longer than the item must be ``edited_share`` of the
distinct shingles of the item as a whole and the answer's share of its distinct words.

Words are runs of ``[^\\x20\\x09-\\x0D]``, ASCII-lower-cased, without leading and trailing ASCII
punctuation. Without an answer column, the last third of an item's words is its answer.

Defined results: null or empty texts and items without a word match nothing; an item shorter than
a shingle uses all its words as one shingle; equal items are found each; repeated rows are
judged each alone; a null ``doc_id`` keeps its rows; an empty table on either side gives no
link; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import distinct, flat_words, ranges, save, slices

K1, B = 1.2, 0.75
PART_BYTES = 2 << 20  # of items in one index, which takes some 90 times as much memory
PUNCT = string.punctuation


def terms_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Normalised words, flat, and row offsets; words of punctuation only stay as empty strings."""
    words, at = flat_words(pc.ascii_lower(text))
    return pc.ascii_trim(words, PUNCT), at


def _shingles(ids: list, size: int) -> set:
    size = min(size, len(ids))
    return {tuple(ids[i:i + size]) for i in range(len(ids) - size + 1)} if ids else set()


@dataclass
class Index:
    """Postings by term in item order; blocks are ``block`` consecutive items."""

    words: list  # of term numbers
    item_ids: list
    questions: list  # sets of shingles of term numbers
    answers: list
    wholes: list | None  # with assumed answers: (shingles, answer's terms, words) of every item
    start: np.ndarray  # postings of term t: start[t]:start[t+1]
    items: np.ndarray
    impacts: np.ndarray
    b_start: np.ndarray  # blocks of term t: b_start[t]:b_start[t+1]
    b_block: np.ndarray
    b_top: np.ndarray
    block: int
    top: np.ndarray  # largest impact of a term
    wide: np.ndarray  # whether a term is in more than a fifth of the blocks
    blocks: int
    longest: int
    sizes: tuple  # shingle sizes
    # the same postings as plain lists, for the cursors
    item_list: list
    impact_list: list
    spans: list  # of term t: first and last posting, largest impact
    block_top: dict  # term * blocks + block: largest impact


@dataclass
class Corpus:
    """What BM25 needs to know of all items where an index holds a part of them."""

    n: int  # items with any word
    words: int
    longest: int
    counts: Callable[[list[str]], dict[str, int]]  # of given terms: the items that hold them


def build_index(items: list[tuple], shingle: int, block: int = 2, assumed: bool = False,
                corpus: Corpus | None = None) -> Index:
    """``items``: (id, question words, answer words); ``assumed``: the answers are no more than a guess; ``corpus``:
    the statistics of all items, if these are a part of them."""
    vocab: dict[str, int] = {}
    docs = [(i, [vocab.setdefault(w, len(vocab)) for w in q], [vocab.setdefault(w, len(vocab)) for w in a])
            for i, q, a in items if q or a]
    n = len(docs)
    mean = sum(len(q) + len(a) for _, q, a in docs) / max(n, 1)
    df = np.zeros(len(vocab) + 1, np.int64)
    for _, q, a in docs:
        df[list(set(q + a))] += 1
    total = n
    if corpus:
        total, mean, known = corpus.n, corpus.words / max(corpus.n, 1), corpus.counts(list(vocab))
        df[:len(vocab)] = [known[w] for w in vocab]
    idf = np.log1p((total - df + 0.5) / (df + 0.5))
    post: list[list[tuple[int, float]]] = [[] for _ in vocab]
    for j, (_, q, a) in enumerate(docs):
        ids, tf = np.unique(q + a, return_counts=True)
        w = idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (len(q) + len(a)) / mean))
        w = w / w.sum()
        for t, x in zip(ids.tolist(), w.tolist()):
            post[t].append((j, x))
    start = np.cumsum([0] + [len(p) for p in post])
    it = np.array([j for p in post for j, _ in p], np.int64)
    imp = np.array([x for p in post for _, x in p], np.float64)
    b_start, b_block, b_top = [0], [], []
    for p in post:
        best: dict[int, float] = {}
        for j, x in p:
            best[j // block] = max(best.get(j // block, 0.0), x)
        b_block += best.keys()
        b_top += best.values()
        b_start.append(len(b_block))
    sh = lambda ids: _shingles(ids, shingle)
    blocks = -(-n // block)
    return Index(
        list(vocab), [d[0] for d in docs], [sh(q) for _, q, _ in docs], [sh(a) for _, _, a in docs],
        [(sh(q + a), set(a), len(q + a)) for _, q, a in docs] if assumed else None, start, it, imp,
        np.array(b_start), np.array(b_block, np.int64), np.array(b_top), block,
        np.array([max(x for _, x in p) for p in post] or [0.0]), np.diff(b_start) * 5 > blocks, blocks,
        corpus.longest if corpus else max([len(q) + len(a) for _, q, a in docs], default=0),
        tuple(sorted({min(shingle, len(x)) for _, q, a in docs for x in (q, a) if x})), it.tolist(), imp.tolist(),
        [(lo, hi, max(x for _, x in p)) for lo, hi, p in zip(start.tolist(), start[1:].tolist(), post)],
        {t * blocks + k: x for t in range(len(post))
         for k, x in zip(b_block[b_start[t]:b_start[t + 1]], b_top[b_start[t]:b_start[t + 1]])})


def block_max_wand(ix: Index, terms: list[int], least: float,
                   open_blocks: list[int] | None = None) -> list[tuple[int, float]]:
    """All items whose summed impacts over the distinct ``terms`` are at least ``least``.

    ``open_blocks`` (sorted): the only blocks where an item can pass, if that is known.
    """
    items, impacts, block_top = ix.item_list, ix.impact_list, ix.block_top
    end, size, blocks = len(ix.item_ids), ix.block, ix.blocks
    # a cursor: [current item, position, end, largest impact, term's first key among block maxima]
    first = open_blocks[0] * size if open_blocks else 0
    cur = []
    for t in terms:
        lo, hi, top = ix.spans[t]
        lo = bisect_left(items, first, lo, hi) if first else lo
        if lo < hi:
            cur.append([items[lo], lo, hi, top, t * blocks])
    out = []
    while cur:
        cur.sort()
        total, pivot = 0.0, -1
        for i, c in enumerate(cur):
            total += c[3]
            if total >= least:
                pivot = i
                break
        if pivot < 0:
            break
        item = cur[pivot][0]
        while pivot + 1 < len(cur) and cur[pivot + 1][0] == item:
            pivot += 1
        block = item // size
        if sum(block_top.get(c[4] + block, 0.0) for c in cur[:pivot + 1]) < least:
            # no item of this block before the next cursor can pass
            to = (block + 1) * size
            if pivot + 1 < len(cur):
                to = min(to, cur[pivot + 1][0])
        elif cur[0][0] == item:
            score = sum(impacts[c[1]] for c in cur[:pivot + 1])
            if score >= least:
                out.append((item, score))
            to = item + 1
        else:
            to = item
        if open_blocks:
            i = bisect_left(open_blocks, to // size)
            to = max(to, open_blocks[i] * size) if i < len(open_blocks) else end
        gone = False
        for c in cur[:pivot + 1]:
            if c[0] < to:
                c[1] = i = bisect_left(items, to, c[1], c[2])
                c[0] = items[i] if i < c[2] else end
                gone |= i >= c[2]
        if gone:
            cur = [c for c in cur if c[0] < end]
    return out


def _overlap(want: set, have: dict) -> float:
    if not want:
        return 1.0
    size = len(next(iter(want)))
    return len(want & have[size]) / len(want)


def _edited(whole: tuple, words: list, share: float, a_share: float) -> bool:
    """Whether a stretch of ``words`` holds the shares of an item's shingles and of its answer's words."""
    want, answer, n = whole
    size, room = len(next(iter(want))), n + max(n // 4, 2)
    hits = [(i, s) for i in range(len(words) - size + 1) if (s := tuple(words[i:i + size])) in want]
    if len({s for _, s in hits}) < share * len(want):
        return False
    return any(len({s for j, s in hits[h:h + room] if j <= i + room - size}) >= share * len(want)
               and len(answer.intersection(words[i:i + room])) >= a_share * len(answer)
               for h, (i, _) in enumerate(hits))


def search_slice(ix: Index, ids: np.ndarray, at: np.ndarray, width: int, least: float,
                 q_share: float, a_share: float, edited_share: float) -> list[tuple]:
    """(row, item, passage start, score, question share, answer share) of every verified match."""
    half = width // 2
    n = np.diff(at)
    row_of = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(ids)) - at[:-1][row_of]
    hit = np.flatnonzero(ids >= 0)
    if not len(hit):
        return []
    # passage p of a row holds words p * half .. p * half + width - 1; a word is in at most two
    per_row = np.maximum(-(-(n - width) // half), 0) + 1
    first_p = np.cumsum(per_row) - per_row
    p = pos[hit] // half
    r = row_of[hit]
    t = ids[hit].astype(np.int64)
    v = len(ix.words)
    keys = []
    for back in (0, 1):
        ok = (p - back >= 0) & (p - back < per_row[r])
        keys.append((first_p[r[ok]] + p[ok] - back) * v + t[ok])
    key = distinct(np.concatenate(keys))
    passage, term = key // v, key % v
    # no item of a block can score more than the sum of its block maxima; terms of many blocks
    # have small impacts and count with their largest one, which bounds as well
    wide = ix.wide[term]
    n_pass = int(per_row.sum())
    common = np.bincount(passage[wide], weights=ix.top[term[wide]], minlength=n_pass)
    passage_r, term_r = passage[~wide], term[~wide]
    cnt = ix.b_start[term_r + 1] - ix.b_start[term_r]
    e = ranges(ix.b_start[term_r], cnt)
    cell = np.repeat(passage_r, cnt) * ix.blocks + ix.b_block[e]
    order = np.argsort(cell)
    cell, gain = cell[order], ix.b_top[e][order]
    new = np.flatnonzero(np.diff(cell, prepend=-1))
    bound = np.add.reduceat(gain, new) if len(new) else gain
    of = cell[new] // ix.blocks
    ok = bound + common[of] >= least - 1e-9
    everywhere = np.flatnonzero(common >= least - 1e-9)
    left = distinct(np.concatenate([of[ok], everywhere]))
    out = []
    if not len(left):
        return out
    lo, hi = np.searchsorted(passage, left), np.searchsorted(passage, left, side="right")
    rows = np.searchsorted(first_p, left, side="right") - 1
    of_open, block_open = of[ok], (cell[new] % ix.blocks)[ok]
    b_lo, b_hi = np.searchsorted(of_open, left), np.searchsorted(of_open, left, side="right")
    everywhere = set(everywhere.tolist())
    for g, x, y, row, b0, b1 in zip(left.tolist(), lo.tolist(), hi.tolist(), rows.tolist(), b_lo.tolist(),
                                    b_hi.tolist()):
        blocks = None if g in everywhere else block_open[b0:b1].tolist()
        found = block_max_wand(ix, term[x:y].tolist(), least - 1e-9, blocks)
        if not found:
            continue
        s = int((g - first_p[row]) * half)
        words = ids[at[row] + s:min(at[row] + s + width, at[row + 1])].tolist()
        have = {k: {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} for k in ix.sizes}
        for item, score in found:
            q, a = _overlap(ix.questions[item], have), _overlap(ix.answers[item], have)
            if q >= q_share and a >= a_share or ix.wholes and _edited(ix.wholes[item], words, edited_share, a_share):
                out.append((row, item, s, score, q, a))
    return out


def _item_words(q: pa.Array, a: pa.Array) -> list[tuple[list[str], list[str]]]:
    """The words of questions and answers."""
    both = []
    for col in (q, a):
        words, at = terms_of(pc.fill_null(col, ""))
        words = words.to_pylist()
        both.append([[w for w in words[x:z] if w] for x, z in zip(at[:-1].tolist(), at[1:].tolist())])
    return list(zip(*both))


def _corpus(rows: DataFrame) -> Corpus:
    """Statistics of all items, by a distributed count of their terms."""
    def run(batches):
        for b in slices(batches, "q"):
            df, n, total, longest = Counter(), 0, 0, 0
            for q, a in _item_words(b.column("q"), b.column("a")):
                df.update(set(q + a))
                size = len(q) + len(a)
                n, total, longest = n + (size > 0), total + size, max(longest, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*df, None], pa.string()), pa.array([*df.values(), n]), pa.array([0] * len(df) + [total]),
                 pa.array([0] * len(df) + [longest])], ["term", "n", "words", "longest"])

    part = rows.select("q", "a").mapInArrow(run, "term string, n long, words long, longest long")
    known = save(part.groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"),
                                          F.max("longest").alias("longest")), "terms")
    whole = known.where(F.col("term").isNull()).first()

    def counts(terms: list[str]) -> dict[str, int]:
        asked = rows.sparkSession.createDataFrame([(t,) for t in terms], "term string")
        return {r.term: r.n for r in asked.join(known.select("term", "n"), "term").toLocalIterator()}
    return Corpus(whole.n, whole.words, whole.longest, counts)


def read_items(items: DataFrame, id_col: str, question_col: str, answer_col: str | None,
               part_bytes: int) -> tuple[Corpus | None, Iterator[list[tuple]]]:
    """Parts of the items as (id, question words, answer words), read one after the other; with more than one, what an
    index needs to know of all items."""
    rows = items.select(F.col(id_col).alias("id"), F.col(question_col).alias("q"),
                        (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("a"))
    weight = F.octet_length(F.concat_ws(" ", "q", "a")) + 64
    size = rows.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]

    def parts() -> Iterator[list[tuple]]:
        out, held = [], 0
        for x in rows.withColumn("size", weight).orderBy("id", "q", "a").toLocalIterator():
            if out and held + x["size"] > part_bytes:
                yield out
                out, held = [], 0
            held += x["size"]
            q, a = _item_words(pa.array([x["q"]], pa.string()), pa.array([x["a"]], pa.string()))[0]
            if not answer_col:
                k = len(q) - len(q) // 3
                q, a = q[:k], q[k:]
            out.append((x["id"], q, a))
        yield out
    return _corpus(rows) if size > part_bytes else None, parts()


def find_items(docs: DataFrame, items: DataFrame, least: float = 0.7, q_share: float = 0.6,
               a_share: float = 0.6, edited_share: float = 0.5, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", question_col: str = "text", answer_col: str | None = None,
               part_bytes: int = PART_BYTES, keep: bool = False) -> DataFrame:
    """One row per document and item found in it: (doc_id, item_id, passages, score, question_share,
    answer_share), the shares and score of the best passage.

    ``keep``: instead give every input row, with an added column ``leaked`` (the item ids found; it replaces one of
    that name).
    """
    corpus, parts = read_items(items, item_id_col, question_col, answer_col, part_bytes)
    search = dict(least=least, q_share=q_share, a_share=a_share, edited_share=edited_share, text_col=text_col)
    indexes = (build_index(part, shingle, assumed=not answer_col, corpus=corpus) for part in parts)
    if keep and corpus is None:
        return _search(docs.drop("leaked"), next(indexes), keep=True, **search)
    if not keep:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col)
        return reduce(DataFrame.unionByName, (_search(rows, ix, **search) for ix in indexes))
    # more than one index: rows that are equal in id and text find the same items
    key = F.xxhash64(F.coalesce(text_col, F.lit("")), F.col(id_col).isNull())
    keyed = docs.drop("leaked").withColumns({"__id0": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "__key": key})
    rows = keyed.select("__id0", "__key", text_col)
    pairs = reduce(DataFrame.unionByName, (_search(rows, ix, **search) for ix in indexes))
    leaked = pairs.groupBy("__id0", "__key").agg(F.array_sort(F.collect_set("item_id")).alias("leaked"))
    none = F.array().cast("array<bigint>")
    return (keyed.join(leaked, ["__id0", "__key"], "left")
            .select(*[F.col(f"`{c}`") for c in docs.columns if c != "leaked"], F.coalesce("leaked", none).alias("leaked")))


def _search(docs: DataFrame, ix: Index, least: float, q_share: float, a_share: float, edited_share: float,
            text_col: str, keep: bool = False) -> DataFrame:
    """The pairs of one index, with the columns of ``docs`` but the text; or with ``keep`` every row and ``leaked``."""
    width = 2 * max(ix.longest, 16)
    shared = docs.sparkSession.sparkContext.broadcast(ix)  # of at most part_bytes of items
    own = [c for c in docs.columns if c != text_col]

    def found(b):
        ix = shared.value
        words, at = terms_of(b.column(text_col))
        ids = pc.fill_null(pc.index_in(words, value_set=pa.array(ix.words, pa.string())), -1).to_numpy()
        # words of punctuation only are dropped on both sides
        real = np.asarray(pc.binary_length(words)) > 0
        before = np.zeros(len(real) + 1, np.int64)
        np.cumsum(real, out=before[1:])
        return search_slice(ix, ids[real], before[at], width, least, q_share, a_share, edited_share)

    def pairs(batches):
        for b in slices(batches, text_col):
            best: dict[tuple, list] = {}
            for row, item, _, score, q, a in found(b):
                x = best.setdefault((row, item), [0, score, q, a])
                x[0] += 1
                if (q + a, score) > (x[2] + x[3], x[1]):
                    x[1:] = score, q, a
            hits = sorted(best.items())
            at = pa.array([r for (r, _), _ in hits], pa.int64())
            passages, score, q, a = zip(*(x for _, x in hits)) if hits else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).take(at) for c in own], pa.array([shared.value.item_ids[i] for (_, i), _ in hits], pa.int64()),
                 pa.array(passages, pa.int64()), *[pa.array(x, pa.float64()) for x in (score, q, a)]],
                [*own, "item_id", "passages", "score", "question_share", "answer_share"])

    def marks(batches):
        for b in slices(batches, text_col):
            hits: dict[int, set] = {}
            for row, item, *_ in found(b):
                hits.setdefault(row, set()).add(shared.value.item_ids[item])
            leaked = [sorted(hits.get(i, ())) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaked, pa.list_(pa.int64()))],
                                             [*b.schema.names, "leaked"])

    kinds = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields}
    if keep:
        return docs.mapInArrow(marks, f"{', '.join(kinds.values())}, leaked array<long>")
    return docs.mapInArrow(pairs, f"{', '.join(kinds[c] for c in own)}, item_id long, passages long, score double, "
                                  "question_share double, answer_share double")
