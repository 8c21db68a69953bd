"""The training-data operators against brute force on small tables."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from streamweft.llm import components, exact_dedup, gbt, jpeg, line_dedup, media, mixing, packing, quality, simhash, substring_dedup, token_counts, token_files
from streamweft.llm.tokens import encoder, tokenizer_path
from streamweft.llm.words import split_words

EXTRA = "doc_id long, text string, n_tokens string, sequence_id int"


def table(spark, rows, parts=3):
    """Rows with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], EXTRA).repartition(parts)


def prose(rng, n, words=None):
    words = words or [f"w{k}" for k in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


WEIRD = ["", None, "  \n", "it's <|endoftext|> 'tis don't 'S", "Éé ǅ ﬁ Ω Σας İ 日本 \x1c a\x85b c 1234 ²½", "ÀÿÞß×÷ <b>", "x" * 5000, "á.b,c!!** 9é9 " * 300]


def test_encoder_equals_the_library(library):
    texts = pa.array([*WEIRD, *(prose(random.Random(k), 50, ["Abc.", "déjà", "x1y22", "re-do", "THE!"]) for k in range(20))])
    enc = encoder(tokenizer_path())
    ids, at = enc.encode(texts, end_id=7)
    for k, t in enumerate(texts.to_pylist()):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids + [7]
    assert (enc.counts(texts) == np.diff(at) - 1).all()


def test_other_vocabularies_go_through_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    own, texts = Tokenizer.from_file(path), [*WEIRD, "plain text"]
    enc = encoder(path)
    ids, at = enc.encode(pa.array(texts), end_id=3)
    assert not enc.quick and encoder(tokenizer_path()).quick
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == own.encode(t or "", add_special_tokens=False).ids + [3]


def test_word_hashes_are_positional_and_equal_for_equal_words():
    w = split_words(pa.array(["a b c d e", "x a b c d e", None, " "]))
    for n in (1, 2, 3, 5):
        g = w.ngrams(n, w.hashes())
        assert (g[:5][w.inside(n)[:5]] == g[6:][w.inside(n)[6:]]).all()
    assert w.first.tolist() == [0, 5, 11, 11, 11]


def test_packing(spark, library):
    rng = random.Random(1)
    docs = [(k, prose(rng, rng.choice([1, 5, 30, 90, 400]))) for k in range(120)] + [(200, None), (201, ""), (None, "a b"), (5, "again")]
    got = packing.pack_documents(table(spark, docs), limit=256, with_ids=True).collect()
    seqs = {}
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.start == r.piece * 256
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)
    assert sum(r.length for r in got) == total and len(seqs) <= total / 256 * 1.03 + 1
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_packing_spreads_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 10)
    rows = packing.pack_documents(table(spark, [(None, None)] * 300 + [(1, "a b c")] * 50), limit=64).collect()
    assert len(rows) == 350 and len({(r.sequence_id, r.offset) for r in rows}) == 350
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 64)


def test_patterns_are_all_enumerated():
    lengths = np.array([3, 4, 5, 6, 7, 10, 11, 12, 14])
    want = {tuple(sorted(c, reverse=True)) for c in itertools.combinations_with_replacement(lengths.tolist(), 3) if sum(c) == 21} | {(a, b, 0) for a in lengths.tolist() for b in lengths.tolist() if a >= b and a + b == 21}
    assert {tuple(r) for r in packing.exact_patterns(lengths, 21).tolist()} == want


def test_packing_plan_uses_every_piece():
    hist = np.zeros(65, np.int64)
    hist[[3, 7, 20, 30, 34, 44, 61, 64]] = [50, 9, 40, 31, 31, 12, 13, 5]
    used = np.zeros(65, np.int64)
    for items, n in packing.plan(hist, 64):
        assert sum(v * m for v, m in items) <= 64
        for v, m in items:
            used[v] += n * m
    assert (used == hist).all()


def test_token_counts(spark, library):
    docs = [(k, t) for k, t in enumerate([*WEIRD, *(prose(random.Random(k), k) for k in range(40))])]
    lengths = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in docs]
    hist = token_counts.length_histogram(table(spark, docs))
    for r in hist.collect():
        assert r.n_docs == lengths.count(r.length) and r.docs_at_least == sum(n >= r.length for n in lengths)
        assert r.tokens_at_least == sum(n for n in lengths if n >= r.length) and r.truncated_total == sum(min(n, r.length) for n in lengths)
    assert token_counts.truncated_total(hist, 9).first()[0] == sum(min(n, 9) for n in lengths)
    assert token_counts.quantile(hist, 0.5).first()[0] == sorted(lengths)[(len(lengths) - 1) // 2]
    empty = token_counts.length_histogram(table(spark, []))
    assert empty.count() == 0 and token_counts.quantile(empty, 0.5).first()[0] is None


def test_token_files(spark, library):
    docs = [(k * 7 % 101, t) for k, t in enumerate([*WEIRD, *(prose(random.Random(k), 30) for k in range(60))])] + [(None, "no id")]
    got = sorted(token_files.token_file_round_trip(table(spark, docs, 5)).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t) in zip(got, sorted(docs, key=lambda d: (d[0] is not None, d[0])), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.token_file_round_trip(table(spark, [])).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 11, 16, 17, 32])
def test_bit_packing(bits, tmp_path):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    assert (token_files.unpack_bits(token_files.pack_bits(ids, bits), 1001, bits) == ids).all()
    with open(tmp_path / "s", "wb") as f:
        w = token_files.ShardWriter(f, bits, 64)
        w.add(np.array([4, 9]), ids[:700], np.array([0, 300, 700]))
        w.add(np.array([12]), ids[700:], np.array([0, 301]))
        assert w.close() == (3, 1001)
    r = token_files.open_shard(f"file://{tmp_path}/s")
    assert (r.document(1) == ids[300:700]).all() and (r.tokens(650, 960) == ids[650:960]).all() and r.doc_ids.tolist() == [4, 9, 12]


def test_exact_dedup(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 3)
    docs = [(1, "a b"), (2, "ab  "), (2, "ab  "), (None, "a\tb   "), (-(1 << 63), None), ((1 << 63) - 1, ""), (None, "zz"), (4, "z z"), (5, "é é"), (6, "éé"), *((k, "hot text") for k in range(10, 40))]
    df = table(spark, docs)
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toArrow())
    want = sorted(con.execute(exact_dedup.SQL).fetchall(), key=str)
    got = exact_dedup.exact_dedup_groups(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == want
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns and kept.count() == len({hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).digest() for _, t in docs})
    assert exact_dedup.exact_dedup_groups(table(spark, [])).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = [prose(rng, 300).split() for _ in range(6)]
    docs, group = [], {}
    for k in range(90):
        words = list(base[k % 6])
        for _ in range(k % 3):
            words[rng.randrange(300)] = f"new{rng.randrange(99)}"
        docs.append((k, "  ".join(words)))
        group[k] = k % 6
    docs += [(100 + k, prose(rng, 200)) for k in range(40)] + [(200, ""), (201, None), (202, "one two"), (203, "one  two"), (None, "one two"), (None, "lonely"), (300, "p"), (300, "q")]
    got = simhash.near_duplicates(table(spark, docs), cap=16).collect()
    ids = {r.doc_id: r.class_id for r in got if r.doc_id is not None and r.doc_id != 300}
    assert len(got) == len(docs) and all(ids[k] == group[k] for k in range(90)) and all(ids[100 + k] == 100 + k for k in range(40))
    assert ids[201] == 200 and ids[203] == 202 and sorted(str(r.class_id) for r in got if r.doc_id is None) == ["202", "None"]
    kept = simhash.near_dedup(table(spark, docs))
    assert kept.count() == 6 + 40 + 1 + 1 + 1 + 2 and kept.columns == table(spark, docs).columns
    assert simhash.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("texts", [2, 10_000, 220_000, 2_000_000, 13_000_000, 100_000_000, 10**11])
def test_near_pairs_meet_at_every_size(texts):
    low, high = simhash.distance_limits(simhash.SIMILARITY)
    sampled, tables = simhash.table_plan(texts, simhash.SIMILARITY)
    middle = round(simhash.BITS * np.arccos(1.6 / 1.8) / np.pi)
    once = np.prod([(simhash.BITS - middle - k) / (simhash.BITS - k) for k in range(sampled)])
    assert low < middle < high and (1 - once) ** tables <= simhash.MISS and texts / 2**sampled <= simhash.MEAN
    assert simhash.lost_share(sampled, tables, 0.8) <= simhash.MISS < simhash.lost_share(sampled, tables - 1, 0.8) if tables > 1 else True


def _varied(rng, words, share):
    """The words with about a ``share`` of all five-word shingles changed."""
    out = list(words)
    for _ in range(round(share * len(out) / 5)):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**9)}"
    return out


def _shingles(text):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _similar(a, b):
    return len(a & b) >= 0.8 * len(a | b) if a and b else a == b


def test_sampled_buckets_find_similar_pairs_at_every_size():
    """Signatures of real pairs of similarity 0.8 and more, at the bits and tables of small and of huge corpora."""
    rng = random.Random(11)
    texts, pairs = [], []
    while len(pairs) < 150:
        base = prose(rng, 300).split()
        a, b = " ".join(base), " ".join(_varied(rng, base, rng.choice([0.08, 0.1, 0.12])))
        if _similar(_shingles(a), _shingles(b)):
            pairs.append((len(texts), len(texts) + 1))
            texts += [a, b]
    ones = np.unpackbits(simhash.signatures(*simhash.shingle_hashes(split_words(pa.array(texts)))), axis=1)
    high = simhash.distance_limits(0.8)[1]
    for size in (2**14, 2**24, 2**34):
        sampled, tables = simhash.table_plan(size, 0.8)
        orders = simhash._orders(tables, 512, sampled)
        met = [any((ones[a, o] == ones[b, o]).all() for o in orders) and (ones[a] != ones[b]).sum() <= high for a, b in pairs]
        assert np.mean(met) >= 0.93


def test_near_duplicates_equal_brute_force(spark):
    """Similarities about 0.8 on both sides, chains of links, copies, short, empty, null and long texts."""
    rng = random.Random(12)
    docs, k = [], 0
    for _ in range(25):
        words = prose(rng, rng.choice([40, 200, 300])).split()
        for _ in range(rng.randint(1, 4)):
            docs.append((k, " ".join(words)))
            words = _varied(rng, words, rng.choice([0, 0.02, 0.05, 0.1, 0.15, 0.25]))
            k += 1
    long_ = prose(rng, 60_000)
    docs += [(k, long_), (k + 1, long_ + " tail"), (k + 2, None), (k + 3, "  "), (k + 4, "a b"), (k + 5, "a  b"), (k + 6, "a b c")]
    sets = {i: _shingles(t) for i, t in docs}
    class_ = {i: i for i, _ in docs}
    for i in class_:
        for j in class_:
            if j < i and _similar(sets[i], sets[j]) and class_[i] != class_[j]:
                low, high = sorted((class_[i], class_[j]))
                class_ = {x: low if c == high else c for x, c in class_.items()}
    got = {r.doc_id: r.class_id for r in simhash.near_duplicates(table(spark, docs), tables=60).collect()}
    assert got == class_ and len(set(class_.values())) > 30 and sum(i != c for i, c in class_.items()) > 15


def test_link_group_finds_whole_components():
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 1 << 63, (6, 8)).astype(np.uint64)
    chain = [sig[0]]
    for k in range(20):
        nxt = chain[-1].copy()
        nxt[k % 8] ^= np.uint64((1 << 30) - 1)
        chain.append(nxt)
    every = np.stack([*chain, *sig[1:]])
    links, heads = simhash.link_group(np.arange(len(every)), every, 40)
    assert len(links) == 20 and len(heads) == 6


def test_large_buckets_are_compared_whole(spark):
    """One table, one bucket far over the cap: a hot class, pairs whose ends are near each other only, and a chain."""
    rng = np.random.default_rng(7)
    base = np.zeros(512, np.uint8)

    def flipped(row, n):
        out = row.copy()
        out[8 + rng.permutation(504)[:n]] ^= 1
        return out

    orders = simhash._orders(1, 512, 8)[0]
    back = np.argsort(np.concatenate([orders, np.setdiff1d(np.arange(512), orders)]))
    rows = [flipped(base, 30) for _ in range(150)]
    for _ in range(60):
        far = flipped(base, 240)
        rows += [far, flipped(far, 70)]
    for _ in range(10):
        rows.append(flipped(rows[-1], 75))
    packed = np.packbits(np.stack(rows)[:, back], axis=1)
    df = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(packed)], "id long, signature binary").repartition(3)
    limit = 78
    near = np.bitwise_count(packed[:, None] ^ packed[None]).sum(2, dtype=int) <= limit
    want = np.arange(len(rows))
    for _ in rows:
        want = np.where(near, want[None], len(rows)).min(1)
    assert len(set(want[:150])) == 1 and len(set(want)) > 50
    for cap in (16, 10_000):
        got = {r.node: r.component for r in simhash._linked(df, 8, 1, 512, limit, limit, cap, None).collect()}
        assert [got.get(k, k) for k in range(len(rows))] == want.tolist()


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60) if k % 20 != 19] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    rng.shuffle(edges)
    df = spark.createDataFrame([e if rng.random() < 0.5 else e[::-1] for e in edges], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    want = {**{k: k // 20 * 20 for k in range(60)}, 60: 60, **{k: 100 for k in range(100, 130)}}
    want.pop(60)
    assert got == want


def _lines_like(rng):
    base = ["".join(rng.choice("abé ") for _ in range(40)).strip().ljust(30, "x") for _ in range(10)]

    def change(s):
        s = list(s)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            k = rng.randrange(len(s))
            s[k : k + rng.choice([0, 1])] = rng.choice(["", "q", "z", "é"])
        return "".join(s)

    return [(k, "\n".join(change(rng.choice(base)) for _ in range(rng.randint(1, 5)))) for k in range(40)]


def test_line_dedup(spark):
    df = table(spark, [*_lines_like(random.Random(5)), (90, ""), (91, "short\nshort"), (92, "short\n \n\n short \nshorts")])
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toArrow())
    want = sorted(con.execute(line_dedup.SQL).fetchall())
    got = line_dedup.dropped_lines(df).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, ",".join(map(str, r.dropped))) for r in got) == want and sum(w[2] for w in want) > 20
    dropped = {r.doc_id: set(r.dropped) for r in got}
    for r in line_dedup.line_dedup(df).join(df.select(F.col("doc_id"), F.col("text").alias("before")), "doc_id").collect():
        assert r.text == "\n".join(x for k, x in enumerate(r.before.split("\n")) if k not in dropped[r.doc_id])


def test_line_dedup_edge_cases(spark):
    df = table(spark, [(1, "x" * 30 + "\nkeep"), (2, "x" * 30 + "\r\n  " + "x" * 31 + "\n"), (2, "y" * 30), (2, "y" * 30), (None, "x" * 30), (None, None), (5, "")])
    got = sorted((str(r.doc_id), r.n_lines, r.dropped) for r in line_dedup.dropped_lines(df).collect())
    assert got == [("1", 2, []), ("2", 1, []), ("2", 1, []), ("2", 3, [0, 1]), ("5", 1, []), ("None", 0, []), ("None", 1, [0])]
    long_ = " ".join(f"w{k}" for k in range(30_000))
    df = table(spark, [(1, "a\nb\na"), (2, f"b\n{long_}"), (3, f"{long_}!\n\n\na")])
    assert sorted((r.doc_id, r.dropped) for r in line_dedup.dropped_lines(df).collect()) == [(1, [2]), (2, [0]), (3, [0, 3])]
    assert line_dedup.dropped_lines(table(spark, [])).count() == 0 and line_dedup.line_dedup(df).columns == df.columns


def test_pipeline_drops_short_exact_repeats(spark):
    import corpus_pipeline

    long_ = "y" * 30
    docs = [(1, f"All rights reserved.\n\nshort a\n{long_}"), (2, f" All rights reserved. \n\nshort b\n{long_}z"), (3, "short a\nshort a"), (4, "new\nnew\n")]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.dedup_lines(spark, df, "").collect()}
    assert got == {1: (docs[0][1], len(docs[0][1])), 2: ("\nshort b", 8), 4: ("new\n", 4)}


def test_edit_distance(spark):
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(p + (x != y), d[j] + 1, d[j - 1] + 1)
        return d[-1]

    rng = random.Random(3)
    pairs = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "x string, y string").select("x", "y", F.col("x").cast("binary").alias("a"), F.col("y").cast("binary").alias("b"))
    for k in (1, 2, 3):
        for df_ in (df, line_dedup.trimmed(df, "a", "b")):
            assert all(r.w == (distance(r.x, r.y) <= k) for r in df_.withColumn("w", line_dedup.within_edits("a", "b", k)).collect())


def _without_repeats(docs):
    seen, out = {}, {}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        w = re.findall("[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen[key] = 1
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_substring_dedup(spark):
    rng = random.Random(1)
    docs = [(k, prose(rng, rng.choice([0, 5, 19, 20, 21, 60]), ["a", "b"])) for k in range(50)] + [(None, prose(rng, 50, ["a", "b"])), (100, None), (101, "a " * 300), (102, "x\n" * 25 + "a " * 100)]
    passage = prose(rng, 80)
    docs += [(200 + k, f"{prose(rng, 40)} {passage} {prose(rng, 30)}") for k in range(12)]
    df = table(spark, docs, 4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup_digests(df).collect()}
    assert got == _without_repeats(docs)
    again = substring_dedup.substring_dedup_digests(df.repartition(40)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in again} == got
    whole = {r.doc_id: r for r in substring_dedup.substring_dedup(df).collect()}
    assert [tuple(s) for s in whole[205].spans] == [(40, 120)] and all(hashlib.sha256(r.kept_text.encode()).hexdigest() == got[i][2] for i, r in whole.items())
    assert substring_dedup.substring_dedup_digests(table(spark, [])).count() == 0
    twice = substring_dedup.substring_dedup_digests(table(spark, [(1, "a " * 30), (1, "a " * 30), (1, "b " * 30)])).collect()
    assert len(twice) == 3


def test_paths_are_compacted_where_nothing_branches(spark):
    """Edges 1 to 9 in a row in three documents; one of them leaves after 5, another enters at 8 from elsewhere."""
    rows = [(e, 1, e) for e in range(1, 10)] + [(e, 2, 20 + e) for e in range(1, 6)] + [(e, 3, 40 + e) for e in range(8, 10)] + [(77, 3, 47)] + [(e, 4, e) for e in range(1, 10)] + [(77, 5, 3)]
    at_ = {(d, at): e for e, d, at in rows}
    df = spark.createDataFrame([(e, at_.get((d, at + 1)), d, 0, at) for e, d, at in rows], "edge long, next long, id long, tie long, start int")
    assert sorted(tuple(r) for r in substring_dedup.compacted_paths(df).collect()) == [(1, 5), (6, 2), (8, 2), (77, 1)]


def test_long_passages_of_other_words_stay(spark):
    """Windows that share a hash but not their words are no repeats."""
    ids = [(1, "a " * 10 + "x " * 30), (2, "b " * 10 + "x " * 30), (3, "")]
    df = table(spark, ids)
    _, once = substring_dedup._texts(df, "doc_id", "text")
    spans = spark.createDataFrame([(7, 5, 1, 0, 0), (7, 5, 2, 0, 0), (8, 5, 1, 0, 12), (8, 5, 2, 0, 11)], "path long, n int, id long, tie long, start int")
    got = {(r.path, r.id): r.digest for r in substring_dedup._verified(once, spans, 20).collect()}
    assert got[7, 1] != got[7, 2] and got[8, 1] == got[8, 2]


@pytest.mark.parametrize("parts", [1, 4])
def test_substring_dedup_keeps_a_copy_of_repeated_rows(spark, parts):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    docs = [(1, a), (1, a), (1, b), (2, a), (None, c), (None, c), (None, f"{b} tail")]
    got = substring_dedup.substring_dedup(table(spark, docs, parts)).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.kept_text) for r in got) == sorted([("1", 0, a), ("1", 0, a), ("1", 0, b), ("2", 40, ""), ("None", 0, c), ("None", 0, c), ("None", 40, "tail")])


def _labelled(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(400):
        good, toxic = k % 4 != 0, k % 10 == 3
        t = prose(rng, 60) + "." if good else " ".join(w + rng.choice(["***", "%%", "&&&"]) for w in prose(rng, 60).split())
        docs.append((k, t + (" nasty vile words" if toxic else "")))
        labels.append((k, int(good), int(toxic)))
    return table(spark, [*docs, (900, None), (901, ""), (None, "plain text here")]), spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    df, labels = _labelled(spark)
    got = {r.doc_id: r for r in quality.classify_quality(df, labels).collect()}
    for k in range(400):
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
    held = [k for k in range(400) if got[k].held_out]
    assert np.mean([got[k].predicted == (k % 4 != 0) for k in held]) > 0.95
    assert got[900].score == got[901].score and all(0 <= r.score <= 1 for r in got.values())
    assert quality.keep_quality(df, labels).columns == df.columns
    assert {r.score for r in quality.classify_quality(df, labels.limit(0)).collect()} == {0.5}
    assert quality.classify_quality(table(spark, []), labels).count() == 0


def test_trees_learn_a_step():
    x = np.random.default_rng(0).random((500, 3))
    y = ((x[:, 1] > 0.4) & (x[:, 2] < 0.7)).astype(float)
    assert ((gbt.fit(x, y).score(x) > 0.5) == (y > 0)).mean() > 0.98
    assert gbt.fit(np.zeros((0, 1)), np.zeros(0)).score(np.zeros((2, 4))).tolist() == [0.5, 0.5]


def test_trees_are_traversed_as_written():
    """Flattened forests against a walk of one row down one tree at a time."""
    rng = np.random.default_rng(3)
    x = rng.random((300, 6))
    x[::7, 2] = x[::5, 3][: len(x[::7])] if len(x[::5]) >= len(x[::7]) else 0.5
    forest = gbt.fit(x, (x[:, 0] + x[:, 4] > 1).astype(float), trees=12, depth=3)
    inner = forest.feature.shape[1]
    for row, score in zip(x[:60], forest.score(x[:60]), strict=True):
        total = forest.base
        for t in range(len(forest.feature)):
            node = 0
            while node < inner:
                node = 2 * node + (2 if row[forest.feature[t, node]] > forest.threshold[t, node] else 1)
            total += forest.leaf[t, node - inner]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_of_repeated_ids_and_long_texts(spark):
    df, labels = _labelled(spark)
    extra = table(spark, [(1, "other words for a known id."), (1, "other words for a known id."), (950, "plain " * 200_000)])
    got = quality.classify_quality(df.unionByName(extra), labels).collect()
    assert len(got) == 406 and sum(r.doc_id == 1 for r in got) == 3 and len({r.score for r in got if r.doc_id == 1}) <= 2 and all(0 <= r.score <= 1 for r in got)
    clash = df.withColumns({"score": F.lit(-5.0), "c0": F.lit("c"), "__text": F.lit("t")})
    kept = quality.keep_quality(clash, labels)
    assert kept.columns == clash.columns and {(r.score, r.c0, r["__text"]) for r in kept.collect()} == {(-5.0, "c", "t")}


@pytest.mark.parametrize("targets", [(0.9, 1.1, 1.0), (1.25, 0.5, 0.05), (1.0, 2.0, 0.2)])
def test_mixing_equals_a_small_least_squares(targets):
    """Projected gradient over rows against coordinate descent on the same weighted problem."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([4, 2, 0.5], 400)
    n = rng.integers(1, 900, 400).astype(float)
    before = n @ p
    goal = before * np.array(targets)
    inverse = np.linalg.pinv((p * n[:, None]).T @ p, rcond=1e-9, hermitian=True)
    steps = mixing.descend(lambda steps: mixing.domain_sums(n, p, mixing._rates(p, steps)), lambda totals: goal)
    rates = mixing._rates(p, steps)
    mine = (rates * n) @ p
    assert (rates >= 0).all() and len(steps) < 15
    r = np.ones(400)
    for _ in range(400):  # exact coordinate descent of (t(r) - goal)' inverse (t(r) - goal), r >= 0
        total = (r * n) @ p
        for k in range(400):
            a = n[k] * p[k]
            change = max(-r[k], -(a @ inverse @ (total - goal)) / (a @ inverse @ a))
            r[k] += change
            total = total + change * a
    other = (r * n) @ p
    size = lambda t: (t - goal) @ inverse @ (t - goal)
    assert np.abs(other / goal - 1).max() < 0.03 and np.abs(mine / goal - 1).max() < 0.01 and size(mine) <= size(other) + 1e-6 * goal.sum()


def test_mixing(spark):
    df, labels = _labelled(spark)
    got = mixing.mixing_rates(df, labels).collect()
    n, p, r = (np.array(a, float) for a in ([x.n_tokens for x in got], [[x.p_high, x.p_low, x.p_toxic] for x in got], [x.rate for x in got]))
    before, after = n @ p, (n * r) @ p
    want = before * [mixing.MULTIPLES[d] for d in mixing.DOMAINS]
    assert (r >= 0).all() and np.allclose(p.sum(1), 1) and np.abs(after - want).max() < 0.02 * before.sum() and np.abs(after / want - 1).max() < 0.05
    assert all(x.copies in (np.floor(x.rate), np.floor(x.rate) + 1) for x in got)
    mixed = mixing.mix_documents(df, labels)
    assert mixed.columns == df.columns and mixed.count() == sum(x.copies for x in got)
    exact = mixing.mixing_rates(df, labels, targets=dict(zip(mixing.DOMAINS, (before * [0.9, 1.1, 1.0]).tolist(), strict=True))).collect()
    assert np.allclose(sum(x.n_tokens * x.rate * np.array([x.p_high, x.p_low, x.p_toxic]) for x in exact), before * [0.9, 1.1, 1.0], rtol=1e-3)
    assert mixing.mixing_rates(table(spark, []), labels).count() == 0 and mixing.mixing_rates(df, labels.limit(0)).count() == df.count()


def test_media_round_trip(spark):
    docs = [(1, None), (2, ""), (None, "\x00" * 100), (4, "é" * 7000), (5, "plain"), (6, "plain"), (7, "".join(map(chr, range(1, 400))))]
    got = media.media_round_trip(table(spark, docs)).collect()
    texts = {i: (t or "").encode() for i, t in docs}
    for r in got:
        b = texts[r.doc_id]
        p = b + bytes(max(1, -(-len(b) // 64)) * 64 - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    same = [tuple(r)[1:] for r in got if r.doc_id in (5, 6)]
    assert same[0] == same[1] and media.media_round_trip(table(spark, [])).count() == 0


def _jpeg_of(blocks, width, height, sampling, interval, rng):
    """A baseline file of given quantised blocks (in scan order), written bit by bit with flat Huffman
    codes: 4 bits for DC sizes, 8 for AC symbols.  Shares nothing with the encoder under test."""
    seg = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    symbols = [r << 4 | z for r in range(16) for z in range(1, 11)] + [0x00, 0xF0]
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    quantiser = [rng.randint(1, 60) for _ in range(64)]
    out += seg(0xDB, bytes([0, *quantiser])) + seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling)))
    out += seg(0xC4, bytes([0x00, 0, 0, 0, 12] + [0] * 12 + list(range(12)))) + seg(0xC4, bytes([0x10] + [0] * 7 + [len(symbols)] + [0] * 8 + symbols))
    out += seg(0xDD, interval.to_bytes(2, "big")) * (interval > 0) + seg(0xDA, bytes([len(sampling)]) + b"".join(bytes([c + 1, 0]) for c in range(len(sampling))) + b"\0\x3f\0")
    layout = [0] if len(sampling) == 1 else [c for c, (h, v) in enumerate(sampling) for _ in range(h * v)]
    bits, last, scan = "", [0] * len(sampling), b""

    def value(v):
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, "b").zfill(size) if size else ""

    def flush():
        full = bits + "1" * (-len(bits) % 8)
        return b"".join(bytes([int(full[k : k + 8], 2)]) + (b"\0" if full[k : k + 8] == "1" * 8 else b"") for k in range(0, len(full), 8))

    for k, block in enumerate(blocks):
        mcu, place = divmod(k, len(layout))
        if place == 0 and interval and mcu and mcu % interval == 0:
            scan += flush() + bytes([0xFF, 0xD0 + (mcu // interval - 1) % 8])
            bits, last = "", [0] * len(sampling)
        size, code = value(int(block[0]) - last[layout[place]])
        last[layout[place]] = int(block[0])
        bits += format(size, "04b") + code
        run = 0
        for v in block[1:].tolist():
            if v == 0:
                run += 1
                continue
            while run > 15:
                bits += format(symbols.index(0xF0), "08b")
                run -= 16
            size, code = value(v)
            bits += format(symbols.index(run << 4 | size), "08b") + code
            run = 0
        if run:
            bits += format(symbols.index(0), "08b")
    return out + scan + flush() + b"\xff\xd9", quantiser


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1), (1, 1), (1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("interval", [0, 1, 3])
def test_jpeg_files_of_another_writer(spark, sampling, interval):
    rng, gen = random.Random(interval), np.random.default_rng(interval)
    h, v = sampling[0] if len(sampling) > 1 else (1, 1)
    width, height = 45, 61
    wide, high = -(-width // (8 * h)), -(-height // (8 * v))
    per = 1 if len(sampling) == 1 else sum(a * b for a, b in sampling)
    blocks = np.zeros((wide * high * per, 64), np.int64)
    blocks[:, 0] = gen.integers(-60, 60, len(blocks))
    for b in blocks:
        at = gen.integers(1, 64, gen.integers(0, 12))
        b[at] = gen.integers(-300, 300, len(at))
    data, quantiser = _jpeg_of(blocks, width, height, sampling, interval, rng)
    ((frame, coef),) = jpeg.decode_batch([data])
    assert (frame.width, frame.height) == (width, height) and (coef == blocks).all()
    pixels = jpeg.thumbnail(frame, coef)
    assert pixels.shape == (-(-height // 8), -(-width // 8))
    for y in range(pixels.shape[0]):
        for x in range(pixels.shape[1]):
            first = ((y // v) * wide + x // h) * per + (y % v) * h + x % h
            assert pixels[y, x] == np.clip(round(int(blocks[first, 0]) * quantiser[0] / 8 + 128 + 1e-12), 0, 255) or abs(int(blocks[first, 0]) * quantiser[0] / 8 % 1 - 0.5) < 1e-9
    rows = spark.createDataFrame([(1, bytearray(data), "w"), (2, None, "w"), (3, bytearray(b"no image"), "w"), (4, bytearray(data[: len(data) // 2]), "w"), (5, bytearray(data), "w")], "id long, media binary, width string")
    got = {r[0]: r for r in media.media_features(rows, columns=("id",)).collect()}
    want = (width, height, jpeg.thumbnail_hash(pixels))
    assert tuple(got[1])[1:] == tuple(got[5])[1:] == want and all(tuple(got[k])[1:] == (None,) * 3 for k in (2, 3))
    assert media.media_features(rows.limit(0), columns=("id",)).count() == 0


def test_jpeg_decoder():
    rng = np.random.default_rng(1)
    sizes = np.array([64, 128, 64 * 7, 64 * 300])
    payload = rng.integers(0, 256, sizes.sum()).astype(np.uint8)
    payload[64 * 4 : 64 * 9] = 128
    payload[64 * 20 : 64 * 40] = 255
    at = 0
    for (frame, coef), n in zip(jpeg.decode_batch(jpeg.encode_payloads(payload, sizes)), sizes, strict=True):
        assert media.payload_of(frame, coef) == payload[at : at + n].tobytes()
        pixels = jpeg.thumbnail(frame, coef)
        assert pixels.shape == (frame.height // 8, frame.width // 8) and (pixels.ravel()[: n // 64] == payload[at : at + n].reshape(-1, 64)[:, 0]).all()
        at += n
    with pytest.raises(ValueError):
        jpeg.decode_batch([b"no image"])
