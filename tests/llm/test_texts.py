"""SimHash, substring dedup, BPE, PII and decontamination against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

from tessera.llm import bpe, decontam, pii, queries, simhash, substr  # noqa: E402
from tests.llm.fixtures import WORD, awkward_docs, frame, vocabulary  # noqa: E402


def plain_fingerprint(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not ws:
        return 0
    sh = [" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, ids):
    group = list(range(len(fps)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            group[top(j)] = top(i)
    least = defaultdict(lambda: None)
    for i, d in enumerate(ids):
        if d is not None:
            t = top(i)
            least[t] = d if least[t] is None else min(least[t], d)
    return [least[top(i)] for i in range(len(fps))]


def test_simhash_equals_plain(spark):
    rows = awkward_docs()
    got = simhash.near_duplicates(frame(spark, rows), tile_rows=4)
    fps = [plain_fingerprint(t) for _, t in rows]
    want = Counter((d, f, c) for (d, _), f, c in zip(rows, fps, plain_components(fps, [d for d, _ in rows])))
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got.collect()) == want


@pytest.mark.parametrize("parts", [2, 4, 8])
def test_simhash_links_are_whole(spark, parts):
    r = random.Random(parts)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(15)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), parts=parts, tile_rows=7)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    want = plain_components(fps, signed)
    sizes = Counter(want)
    assert {k: v for k, v in got.items()} == {f: w for f, w in zip(signed, want) if sizes[w] > 1}


def test_keep_one_leaves_one_row_a_group(spark):
    rows = awkward_docs()
    docs = frame(spark, rows)
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    fps = [plain_fingerprint(t) for _, t in rows]
    assert kept.count() == len({top for top in _groups(fps)})


def _groups(fps):
    return plain_components(fps, list(range(len(fps))))


def plain_repeats(rows, k):
    words = [WORD.findall(t or "") for _, t in rows]
    n = Counter(tuple(w[i:i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - k + 1):
            if n[tuple(w[i:i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


@pytest.mark.parametrize("k, m, share", [(35, 5, None), (10, 3, None), (10, 3, 0.002), (4, 4, None), (1, 1, None)])
def test_substring_equals_plain(spark, monkeypatch, k, m, share):
    rows = awkward_docs(seed=k)
    rows += [(900, "aa bb " * 40), (901, "aa bb " * 30 + "cc")]
    if share:  # every common gram is hot, and buckets are tiny
        monkeypatch.setattr(substr, "hot_grams", lambda docs, m, s=share: _hot(rows, m, s))
        monkeypatch.setattr(substr, "BUCKET_BYTES", 500)
    got = substr.remove_repeats(frame(spark, rows), k=k, m=m)
    assert Counter(tuple(r) for r in got.collect()) == plain_repeats(rows, k)


def _hot(rows, m, share):
    import pyarrow as pa
    words, at, g = substr._grams(pa.array([t for _, t in rows]), m)
    c = Counter(g.tolist())
    return np.array(sorted(x for x, n in c.items() if n >= max(2, share * len(g))), np.uint64)


def test_hot_grams_finds_heavy_hitters(spark):
    rows = [(i, "the hot passage of words " * 3 + f"w{i} x{i} y{i}") for i in range(200)]
    hot = substr.hot_grams(frame(spark, rows), 2, share=0.01)
    import pyarrow as pa
    _, _, g = substr._grams(pa.array(["the hot passage of words"]), 2)
    assert set(g.tolist()) <= set(hot.tolist())
    assert len(hot) <= 2 / 0.01


def test_windows_with_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substr, "rolling", lambda h, w: np.zeros(max(len(h) - w + 1, 0), np.uint64))
    got = substr.repeated_windows([b"a b c d", b"b c d e", b"x y z"], np.zeros(3), 3)
    assert [x.tolist() for x in got] == [[False, True], [True, False], [False]]


def test_bpe_equals_tiktoken(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = awkward_docs() + [(500, "ab" * 30000), (501, "a  b   c\n\n d's 'll  <|endoftext|> 12345 ₿　x ")]
    got = bpe.encode_decode(frame(spark, rows), path, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == enc.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_bpe_with_ranks_out_of_order():
    """Ranks that no training gives: a merge may make a pair of a lower rank."""
    r = random.Random(1)
    for _ in range(200):
        tokens = [bytes([c]) for c in b"abc"] + list({bytes(r.choice(b"abc") for _ in range(r.randint(2, 4)))
                                                      for _ in range(12)})
        order = list(range(len(tokens)))
        r.shuffle(order)
        ranks = dict(zip(tokens, order))
        enc = bpe.Encoder(ranks, ".+")
        for _ in range(5):
            piece = bytes(r.choice(b"abc") for _ in range(r.randint(1, 14)))
            parts = [piece[i:i + 1] for i in range(len(piece))]
            if piece in ranks:
                parts = [piece]
            while True:
                best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks),
                           default=None)
                if best is None:
                    break
                i = best[1]
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            if piece not in ranks:
                assert enc.merge([piece, b"", piece]) == [[ranks[p] for p in parts], [], [ranks[p] for p in parts]]


def plain_base(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = []
    for kind, pat, ok in (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(x) <= 255 for x in s.split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda s, d: 13 <= len(d) <= 19 and luhn(d)),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 9 <= len(d) <= 15)):
        out += [(kind, *m.span()) for m in re.finditer(pat, text) if ok(m.group(), re.sub("[^0-9]", "", m.group()))]
    return out


def test_pii_long_runs_take_linear_time():
    import time
    n = 1_000_000
    for t, want in [("1.2.3." + "0" * 5000 + "1", [("ip", 0, 5007)]), ("1.2.3." + "0" * 5000 + "999", []),
                    ("7" * n, []), ("1." * n, [("ip", i, i + 7) for i in range(0, 2 * n - 7, 8)]), ("+" + "1 " * n, []),
                    ("a@" * n, []), ("." * n, []), ("4111-" * (n // 5), []), ("+1" * (n // 2), []), ("GB82 " * (n // 5), [])]:
        t0 = time.monotonic()
        got = [x[:3] for x in pii.find_spans(t) if x[0] in pii.KINDS[:4]]
        assert time.monotonic() - t0 < 30 and got == want


def test_pii_context_is_whole_words():
    assert pii._score("tel", "the hotel +1", 10, 12) == pii.START["tel"]
    assert pii._score("tel", "his tel: +1", 9, 11) == pii.START["tel"] + 0.3
    assert pii._score("ip", "a ship 1.2.3.4 locally", 7, 14) == pii.START["ip"]
    assert pii._score("ip", "two hosts 1.2.3.4", 10, 17) == 0.9
    # a word that the window cuts does not count
    far = "hotel" + " " * (pii.CONTEXT - 3) + "1.2.3.4"
    assert pii._score("tel", far, far.index("1"), len(far)) == pii.START["tel"]


def test_pii_base_equals_plain():
    r = random.Random(4)
    bits = ["a.b@c.de", "x@y", "@", "a@b.c@d.e", "..@-.-", "1.2.3.4", "256.1.1.1", "001.2.3.4.5", "4111 1111 1111 1111",
            "4111-1111-1111-1111", "41111111111111112", "+1 (555) 010-9999", "+49 30 1234567", "+1", "é", " ", "\n", "-",
            "%", "0", "12345678901234567890123", "z"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
        got = pii.find_spans(t)
        assert [x[:3] for x in got if x[0] in pii.KINDS[:4]] == plain_base(t), t
        assert all(0 <= s < e <= len(t) for _, s, e, _ in got)


def test_pii_checksums_and_context():
    kinds = lambda t: [(k, t[s:e]) for k, s, e, _ in pii.find_spans(t)]
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in kinds("bank account GB82 WEST 1234 5698 7654 32 now")
    assert not [k for k, _ in kinds("bank account GB83 WEST 1234 5698 7654 32 now") if k == "iban"]
    assert ("ssn", "123-45-6789") in kinds("his SSN 123-45-6789")
    assert not [k for k, _ in kinds("part 123-45-6789") if k == "ssn"]
    assert ("tel", "+1 (269) 555-3296") in kinds("at +1 (269) 555-3296 4524132264652876 and")
    assert pii.mask("a a@b.cd b", pii.find_spans("a a@b.cd b")) == "a <email> b"


def test_iban_before_capital_words():
    ibans = lambda t: [t[s:e] for k, s, e, _ in pii.find_spans(t) if k == "iban"]
    for iban in ("ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "BE68 5390 0754 7034", "GB82 WEST 1234 5698 7654 32"):
        for after in ("", " BIC", " EUR 500", " KBC", " BANK 1000 NV", ", ok", " GB82 WEST 1234 5698 7654 32"):
            assert ibans(f"to {iban}{after} ..") == [iban] + [after[1:]] * after.startswith(" GB82"), (iban, after)
    assert ibans("AB13 3456 7890 BE68 5390 0754 7034 x") == ["BE68 5390 0754 7034"]
    assert ibans("to ES92 2100 0418 4502 0005 1332 BIC") == []


def test_pii_rows(spark):
    rows = awkward_docs() + [(700, "mail a@b.cd or 10.0.0.1")]
    docs = frame(spark, rows)
    got = pii.find_pii(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.KINDS[:4]] == plain_base(r.text or "")
        assert r.masked == (pii.mask(r.text, pii.find_spans(r.text)) if r.text else r.text)


def test_pii_query(spark, tmp_path):
    rows = [r for r in awkward_docs() if r[0] is not None]
    rows += [(700 + i, t) for i, t in enumerate([
        "mail a@b.cd or 10.0.0.1, ssn 123-45-6789", "card 4111 1111 1111 1111 call +1 (555) 010-9999 é 1.2.3.4",
        "𝒳 a.b@c.de x@y.zz 256.1.1.1 IBAN GB82 WEST 1234 5698 7654 32"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_pii(spark, str(tmp_path))
    assert [c for c, _ in got.dtypes] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = Counter()
    for d, t in rows:
        base, full = plain_base(t or ""), pii.find_spans(t or "")
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert [x[:3] for x in full if x[0] in pii.KINDS[:4]] == base
        want[d, *(sum(k == b[0] for b in base) for k in pii.KINDS[:4]), hashlib.sha256(line.encode()).hexdigest(),
             ",".join(f"{k}:{s}:{e}" for k, s, e, _ in full)] += 1
    assert Counter(tuple(r) for r in got.collect()) == want
    assert any("ssn:" in w[6] and "iban:" not in w[6] for w in want) and any("iban:" in w[6] for w in want)


def test_wand_equals_full_scoring():
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [(i, [r.choice(words) for _ in range(r.randint(1, 20))], [r.choice(words) for _ in range(r.randint(0, 6))])
             for i in range(70)]
    for block in (1, 2, 5, 100):
        ix = decontam.build_index(items, 3, block)
        number = {w: t for t, w in enumerate(ix.words)}
        for _ in range(60):
            terms = sorted({number[w] for w in r.sample(words, r.randint(1, 50)) if w in number})
            score = Counter()
            for t in terms:
                for p in range(ix.start[t], ix.start[t + 1]):
                    score[int(ix.items[p])] += float(ix.impacts[p])
            for least in (0.2, 0.5, 0.9):
                want = {i for i, s in score.items() if s >= least}
                assert {i for i, _ in decontam.block_max_wand(ix, terms, least)} == want


def test_decontamination_equals_plain(spark):
    rows = awkward_docs()
    r = random.Random(9)
    texts = [t for _, t in rows if t and 60 < len(t.split()) < 200]
    items = [(i, " ".join(t.split()[10:10 + r.randint(8, 40)])) for i, t in enumerate(texts[:12])]
    items += [(50, None), (51, ""), (52, "!!! ..."), (53, items[0][1]), (54, "unseen words only here and nowhere else")]
    rows += [(800, "Intro " + items[2][1].upper().replace(" ", ",  ") + " end"), (801, items[3][1][: len(items[3][1]) // 3])]
    got = decontam.find_items(frame(spark, rows), frame(spark, items, "item_id long, text string", extra=("id", "q", "a")))
    found = {(x.doc_id, x.item_id) for x in got.collect()}
    norm = lambda t: [w for w in (x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for x in WORD.findall((t or "").lower())) if w]  # noqa: E731,E501
    for d, t in rows:
        w = norm(t)
        text = " " + " ".join(w) + " "
        for i, x in items:
            q = norm(x)
            if q and " " + " ".join(q) + " " in text:
                assert (d, i) in found, (d, i)   # whole items are always found
    clean = {d for d, t in rows if not t or len(t.split()) < 6} - {801}
    assert not {d for d, _ in found} & clean
    assert not [x for x in found if x[1] in (50, 51, 52, 54)]


def test_items_in_parts_give_what_one_index_gives(spark):
    r = random.Random(8)
    words = vocabulary(500, 8)
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(6, 30)))) for i in range(40)] + [(90, None), (91, "")]
    rows = [(i, " ".join(r.choice(words) for _ in range(30)) + " " + items[i % 40][1] + " x " + items[i * 7 % 40][1])
            for i in range(60)] + awkward_docs()
    docs = frame(spark, rows, extra=("id", "leaked", "term", "n", "item_id"))
    its = spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: Counter((x.doc_id, x.item_id, x.passages, round(x.score, 9), x.question_share, x.answer_share)
                             for x in df.collect())
    whole = key(decontam.find_items(docs, its))
    assert len(whole) > 100
    assert key(decontam.find_items(docs, its, part_bytes=1500)) == whole
    corpus, parts = decontam.read_items(its, "item_id", "text", None, 1500)
    assert corpus.n == 40 and len(list(parts)) > 3
    kept = [decontam.find_items(docs, its, part_bytes=b, keep=True) for b in (1 << 20, 1500)]
    assert kept[0].columns == kept[1].columns
    a, b = (Counter((x.doc_id, x.text, tuple(x.leaked)) for x in k.collect()) for k in kept)
    assert a == b and sum(a.values()) == len(rows)


def test_decontamination_finds_edited_items(spark):
    words = vocabulary(400, 11)
    short, long = words[:15], words[20:57]
    items = [(1, " ".join(short)), (2, " ".join(long))] + [(10 + i, " ".join(words[60 + i * 15:75 + i * 15])) for i in range(20)]
    around = lambda w: " ".join(words[360:380] + w + words[380:400])
    rows = [(i, around(short[:i] + ["changed"] + short[i + 1:])) for i in range(15)]
    rows += [(100 + i, around(long[:i] + ["changed"] + long[i + 1:33] + ["other"] + long[34:])) for i in range(25, 32)]
    rows += [(200, around(short[:10])), (201, around(long[:25]))]  # without the answer
    got = decontam.find_items(spark.createDataFrame(rows, "doc_id long, text string"),
                              spark.createDataFrame(items, "item_id long, text string"))
    want = {(i, 1) for i in range(15)} | {(100 + i, 2) for i in range(25, 32)}
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want


def test_empty_tables(spark):
    none = frame(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    assert substr.remove_repeats(none).count() == 0
    assert pii.find_pii(none).count() == 0
    assert decontam.find_items(none, items).count() == 0
    assert decontam.find_items(frame(spark, awkward_docs()), items).count() == 0
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert bpe.encode_decode(none, path, public_tokenizers.PATTERN).count() == 0


def test_digests_of_queries(spark, tmp_path):
    from tessera.llm import queries
    rows = [(1, "Hello world"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: r for r in queries.op4_bpe(spark, str(tmp_path)).collect()}
    assert (got[2].n_tokens, got[2].ids_sha256, got[2].decoded_sha256) == (0, sha(b""), sha(b""))
    assert got[1].decoded_sha256 == sha(b"Hello world") and got[1].ids_sha256 == sha(b"15496 995")
    got = {r.doc_id: r for r in queries.op6_simhash(spark, str(tmp_path)).collect()}
    assert got[2].fingerprint == "0" * 16
    assert got[1].fingerprint == f"{xxhash.xxh64_intdigest(b'hello world', 42):016x}"
