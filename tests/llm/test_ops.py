"""Each operator on small tables: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns; against brute force."""

import base64
import collections
import hashlib
import math
import os
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from winaudit.functions.scratch import scratch_path
import corpus_pipeline
from winaudit.llm import bpe, components, embeddings, exact_dedup, jaccard, license_scan, maxent, mixing, quality, url_filter, warc, words, workers
from winaudit.llm import rows as llm_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return WORD.findall(low(text))


LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
BASE = " ".join(f"alpha{i} beta{i % 7}" for i in range(40))
TEXTS = [
    (1, "Hello World. Größe"), (2, "hello world. Größe"), (3, None), (4, ""), (5, "  \n\t "), (6, LONG), (7, LONG.upper()), (8, BASE), (9, BASE + " tail"), (10, BASE.replace("alpha5", "omega")),
    (11, "one two three"), (12, "ONE two  three"), (13, "GRÖSSE hello"), (14, BASE), (15, "double  spaces\n\nand tabs\t'll don't 漢字 😀"), (None, "no id"), (16, "hello world. Größe"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names clash with those that the operators use inside."""
    df = spark.createDataFrame([(i, t, f"s{(i or 0) % 3}" if i != 11 else None, "x", 1, True) for i, t in TEXTS], "doc_id long, text string, source string, id string, n int, keep boolean")
    return df.withColumns({"ids": F.lit("y"), "size": F.lit(2), "node": F.lit(3), "host_mean": F.lit(0.5), "row_id": F.lit(9), "text_sha256": F.lit("z"), "lang": F.lit("en")}).repartition(3)


def test_exact_dedup(spark, docs):
    groups = collections.defaultdict(list)
    for i, t in TEXTS:
        groups[low(t)].append(i)
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(TEXTS)
    text_of = dict(TEXTS)
    for r in got:
        g = groups[low(text_of[r.id])]
        top = max((x for x in g if x is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (top, len(g), r.id == top)
        assert r.text_sha256 == hashlib.sha256(low(text_of[r.id]).encode()).hexdigest()
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted((max((x for x in g if x), default=0)) for g in groups.values())
    repeated = docs.unionAll(docs)
    assert exact_dedup.drop_exact_duplicates(repeated).count() == len(groups)
    assert sum(r.kept for r in exact_dedup.exact_groups(repeated).collect()) == len(groups)
    assert exact_dedup.exact_groups(docs.where("false")).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs.where("false")).count() == 0


def test_chunks_rebuild_texts(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab .,\nÉ漢") for _ in range(n)) for n in (0, 1, 1023, 1024, 1025, 9000, 30_000)] + ["a" * 50_000, LONG]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.select((F.array_join(exact_dedup.chunks(F.col("t")), "") == F.col("t")).alias("same")).where("not same").count() == 0
    cut = lambda t: {r.c for r in spark.createDataFrame([(t,)], "t string").select(F.explode(exact_dedup.chunks(F.col("t"))).alias("c")).collect()}
    assert len(cut(LONG) & cut("inserted " + LONG)) > 0.8 * len(cut(LONG))


def test_url_filter(spark):
    urls = [None, "no scheme", "http://A.Example.NET/en/x?q", "http://net/", "http://net", "https://b.net#f", "http://x.example.com/de/", "http://x.example.com/deep", "http://a.org/fr/?://net/", "http://badnet/", "http://u:p@h.net:80/a"]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), (None, "/", "block"), ("net", "/", "allow")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")

    def want(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in rules[:4] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    for bound in (url_filter.MAX_FILTER_BYTES, 5, 0):  # one cascade, and several
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, table, max_bytes=bound).collect()}
        assert got == {i: want(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(pages.where("false"), table).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, table.where("false")).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    levels = url_filter.build_cascade(keys.where("listed"), keys)
    assert len(levels) > 1
    assert keys.where(url_filter.is_listed(F.col("key"), levels) != F.col("listed")).count() == 0


def test_license_scan(spark):
    mit = next(t for n, t in license_scan.KNOWN if n == "MIT" and len(t) > 500)
    variant = mit.replace("Copyright (c)", "COPYRIGHT (C) 2021 Some One").replace("sublicense", "sub-licence").replace('"', "'").upper()
    rows = [(1, mit), (2, variant), (3, "Some text.\nreleased under the  MIT Licence\nmore"), (4, None), (5, ""), (6, mit + " extra"), (7, LONG), (8, "Released under the MIT License.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0"), (1, mit)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    got = license_scan.scan(df, license_scan.known_licenses(spark)).collect()
    assert len(got) == len(rows)
    seen = {r.id: (r.license, list(r.notices)) for r in got}
    assert seen[1][0] == seen[2][0] == "MIT"
    assert seen[3] == (None, ["MIT"])
    assert seen[6][0] is None
    assert seen[8] == (None, ["CC-BY-NC-4.0", "MIT"])
    assert all(seen[i] == (None, []) for i in (4, 5, 7))
    assert license_scan.scan(df.where("false"), license_scan.known_licenses(spark)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts")
def test_license_texts_from_a_folder(spark):
    """Published texts of the folder are found again in capitals, wrapped anew and in comment marks, below a copyright notice; cut ones are not."""
    folder = "/usr/share/common-licenses"
    known = license_scan.read_licenses(spark, f"file://{folder}")
    texts = {n: open(f"{folder}/{n}", encoding="utf-8").read() for n in ("Apache-2.0", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0")}
    rows = [(f"{n}|up", t.upper()) for n, t in texts.items()] + [(f"{n}|wrapped", "\n\n".join(textwrap.fill(p, 58) for p in t.split("\n\n"))) for n, t in texts.items() if n in ("MPL-2.0", "CC0-1.0")]  # in the others wrapping moves copyright lines of an appendix
    rows += [(f"{n}|comment", "\n".join("# " + x for x in t.split("\n"))) for n, t in texts.items()] + [(f"{n}|below", f"Copyright 2021 Some One\nand others\n\n{t}") for n, t in texts.items()]
    rows += [(f"{n}|cut", t[: len(t) // 2]) for n, t in texts.items()]
    got = {r.id: r.license for r in license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string"), known).collect()}
    same = lambda a, b: a == b or {a, b} in ({"GPL", "GPL-3"}, {"LGPL", "LGPL-3"})  # noqa: E731  links of the folder
    assert [i for i, x in got.items() if (x is not None if i.endswith("|cut") else x is None or not same(x, i.split("|")[0]))] == []


def test_license_scan_of_wrapped_and_spelled_texts(spark):
    """Published texts wrapped at any width, below copyright lines of many kinds; and spellings side by side."""
    import textwrap

    full = {n: t for n, t in license_scan.PUBLISHED if len(t) > 500}
    heads = ["Copyright (c) 2021 Some One", "Copyright 2020, 2021 The Authors. All rights reserved.", "(C) 1999 X", "© Some One", "Copyright Some One <a@b.c>", "Copyright (c)"]
    rows = [(f"{n}-{w}-{k}", head + "\n\n" + "\n\n".join(textwrap.fill(x, w) for x in t.split("\n\n"))) for n, t in full.items() for w in (30, 47, 72, 10_000) for k, head in enumerate(heads)]
    rows += [(f"{n}--untitled", t.split("\n\n", 1)[1]) for n, t in full.items() if t.startswith(tuple(license_scan.TITLES))]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string"), license_scan.known_licenses(spark)).collect()
    assert len(got) == len(rows) and {r.id: r.license for r in got if r.license != r.id.rsplit("-", 2)[0]} == {}
    body = full["MIT"].split("\n\n", 2)[2]
    shipped = {
        "holder below": f"MIT License\n\nCopyright (c) 2020\nJane Doe\n\n{body}", "more below": f"The MIT License (MIT)\n\nCopyright (c) 2020 Jane Doe\nand contributors\n\n{body}",
        "no blank line": f"The MIT License\nCopyright (c) 2020 Jane Doe\n{body}", "comment": "/*\n" + "".join(f" * {x}\n" for x in f"MIT License\n\nCopyright 2020 Jane Doe\n  and others\n\n{body}".split("\n")) + " */",
    }
    got = license_scan.scan(spark.createDataFrame(list(shipped.items()) + [("cut", f"MIT License\n\nCopyright (c) 2020\n{body}"[:-30])], "doc_id string, text string"), license_scan.known_licenses(spark)).collect()
    assert {r.id: r.license for r in got} == dict.fromkeys(shipped, "MIT") | {"cut": None}
    pairs = [("organisation organisation sub licence sub licence", "organization organization sublicense sublicense"), ("favour favour favour", "favor favor favor")]
    forms = spark.createDataFrame(pairs, "a string, b string").select(license_scan.canonical(F.col("a")).alias("a"), license_scan.canonical(F.col("b")).alias("b")).collect()
    assert all(r.a == r.b for r in forms)


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://d/", ""), (5, "http://e/ ü", "é" * 30_000), (6, "u\n\tv w", LONG), (7, "u", "<p>x</p>"), (7, "u", "<p>x</p>")]
    pages = spark.createDataFrame([(i, u, h, 5) for i, u, h in rows], "page_id long, url string, html string, length int").repartition(2)
    folder = scratch_path(spark, "warc-test")
    index = warc.write_archives(warc.record_types(pages), folder, file_bytes=2000)
    assert index.select("file").distinct().count() > 1
    got = sorted((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_pages(index, folder).collect())
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = max(j for j, _, g in rows if (g or "") == (h or ""))
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert got == sorted(want, key=lambda x: x[0])
    big = warc.record_types(pages, min_bytes=100)
    assert {r.record_type for r in big.collect()} == {"response"}
    assert warc.read_records(index.where("id = 6"), folder).first().url == "u%0A%09v%20w"
    assert warc.read_records(index.where("id = 5"), folder).first().payload == ("é" * 30_000).encode()
    empty = warc.write_archives(warc.record_types(pages.where("false")), folder)
    assert warc.read_pages(empty, folder).count() == 0


def test_coalesced_reads():
    places = [("a", 0, 10), ("a", 10, 5), ("a", 100, 5), ("a", 5000, 5), ("b", 0, 50), ("b", 60, 100)]
    runs = list(warc.coalesced(places, read_bytes=120, gap=90))
    assert [(f, s, e) for f, s, e, _ in runs] == [("a", 0, 105), ("a", 5000, 5005), ("b", 0, 50), ("b", 60, 160)]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Tokenizer(ranks, public_tokenizers.PATTERN)


def test_bpe(spark, docs, reference):
    plain, _ = reference
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    one = bpe.with_ids(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    two = bpe.with_decoded(bpe.with_ids(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    for df in (one, two):
        got = df.select("text", "ids", "decoded").collect()
        assert len(got) == len(TEXTS)
        for r in got:
            assert np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(r.text or "")
            assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.with_ids(docs.where("false"), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_appends_and_edits(reference):
    plain, own = reference
    rng = random.Random(4)
    alphabet = "abcdeéñßABC 01\n\t'srelv.,!?  😀\x1c　漢字の<|endoftext|>"
    for _ in range(400):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(50)))
        text = bpe.EncodedText(own, s)
        a = rng.randrange(len(s) + 1)
        b = rng.randrange(a, len(s) + 1)
        new = "".join(rng.choice(alphabet) for _ in range(rng.randrange(6)))
        text.replace(a, b, new)
        assert text.ids == plain.encode_ordinary(text.text)
        text.append(new + "'re")
        assert text.ids == plain.encode_ordinary(s[:a] + new + s[b:] + new + "'re")
    text = bpe.EncodedText(own, LONG)
    text.replace(1000, 1001, "y")
    assert text.recomputed < 100
    assert own.encode("ab" * 20_000) == np.array(plain.encode_ordinary("ab" * 20_000), "<u4").tobytes()


def test_bpe_tables_may_overflow(reference, monkeypatch):
    plain, own = reference
    monkeypatch.setattr(bpe, "MAX_PIECES", 20)
    small = bpe.Tokenizer(own.vocabulary.ranks, public_tokenizers.PATTERN)
    for part in (LONG[:3000], BASE, LONG[2000:6000], BASE):
        assert np.frombuffer(small.encode(part), "<u4").tolist() == plain.encode_ordinary(part)


def test_bpe_small_tables_cut_batches_small(spark, docs, reference):
    plain, own = reference
    path, most = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), 50
    small = bpe.Tokenizer(own.vocabulary.ranks, public_tokenizers.PATTERN, most)
    texts = [f"word{i} and numb{i * 7} " * (1 + i % 9) for i in range(400)] + ["z" * 5000, None, ""]
    parts = list(bpe._slices(pa.RecordBatch.from_pydict({"text": texts}), "text", small.part_chars))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts
    for part in parts:
        inside = [x or "" for x in part.column("text").to_pylist()]
        assert part.num_rows == 1 or sum(map(len, inside)) <= most * bpe.CHARS_A_PIECE
        for text, ids in zip(inside, small.encode_all(inside), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text)
        assert max(map(len, (small._packed, small._words))) <= most + max(sum(map(len, inside)), small.part_chars)
    for r in bpe.with_ids(docs.withColumn("was", F.col("text")), path, public_tokenizers.PATTERN, most=most, same="fine").collect():
        assert r.fine and np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(r.was or "")


def shingles(text):
    w = tokens(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return [(i, len(s), least.get(root(x)) if s else i) for x, (i, s) in enumerate(sets)]


def near_copies(seed, n=70):
    """Groups of edited copies, a passage that many share, and very short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["lorem", "ipsum", "dolor"]) + str(rng.randrange(400))
    shared = [word() for _ in range(30)]
    bases = [[word() for _ in range(size)] for size in (6, 9, 12, 25, 60, 150)]
    rows = []
    for i in range(n):
        b = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = [word()]
        if rng.random() < 0.3:
            b = shared + b
        rows.append((i, " ".join(b)))
    return rows


@pytest.mark.parametrize("costly", [64, 3])
def test_jaccard(spark, docs, costly):
    rows = TEXTS + [(100 + i, t) for i, t in near_copies(costly)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, costly=costly).collect()), key=str)
    assert got == sorted(brute_components(rows), key=str)


@pytest.mark.parametrize("how", [{"block": 8, "crowded": 6, "most": 1}, {"name_bits": 5, "crowded": 6, "block": 1024, "most": 1}])
def test_jaccard_of_crowded_groups_and_shared_names(spark, how):
    """Leaders, cells of several blocks, cells worked twice, and sets that share the first digest."""
    rng = random.Random(7)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(120):
        b = list(base)
        for _ in range(rng.randrange(9)):
            b[rng.randrange(60)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(b)))
    rows += [(1000 + i, t) for i, t in near_copies(11, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, **how).collect())
    assert got == sorted(brute_components(rows))


def test_near_stage_tells_null_and_repeated_ids_apart(spark):
    """Against brute force: of each component the smallest (id, nulls last) stays, and every text without near copies."""
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(60))
    three, nobody, nine = text(), text(), text()
    keep = [(3, three), (7, text()), (7, text()), (None, text()), (None, text()), (None, ""), (None, None), (7, ""), (8, text()), (8, text()), (9, nine)]
    gone = [(7, three + " more"), (None, nine + " more"), (9, nine + " other")]
    pair = [(None, nobody), (None, nobody + " more")]  # one of them stays
    df = spark.createDataFrame(keep + gone + pair, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, df, "").collect())
    one = collections.Counter(p for p in pair if p in got)
    assert one.total() == 1 and got[next(iter(one))] == 1
    nines = [r for r in ((9, nine), (9, nine + " other")) if r in got]
    assert len(nines) == 1 and got[nines[0]] == 1
    assert got - one - collections.Counter(nines) == collections.Counter(keep[:-1])


def test_near_stage_keeps_one_of_equal_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h")] * 3 + [(None, "i j k l m n o p")] * 2 + [(2, "")] * 2, "doc_id long, text string")
    got = sorted(r.text for r in corpus_pipeline.near_stage(spark, df, "").collect())
    assert got == ["", "", "a b c d e f g h", "i j k l m n o p"]


def test_jaccard_of_empty_table(spark, docs):
    assert jaccard.jaccard_components(docs.where("false")).count() == 0


def test_index_keys_cover_all_similar_pairs():
    """Any two sets that are similar enough and differ share a key, whatever is left out of the universe."""
    rng = np.random.default_rng(3)
    for size in (4, 5, 8, 9, 15, 17, 33, 80, 200):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            drop = int(rng.integers(0, len(a) // 9 + 1))
            add = rng.integers(0, 1 << 63, int(rng.integers(0, len(a) // 9 + 1)), dtype=np.uint64)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], add]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            left_out = np.unique(a[rng.random(len(a)) < rng.choice([0, 0.3, 0.9, 1])] >> np.uint64(64 - jaccard._FREQUENCY_BITS))
            times = rng.integers(65, 1000, len(left_out))
            with np.errstate(over="ignore"):
                assert np.intersect1d(jaccard.index_keys(a, left_out, times), jaccard.index_keys(b, left_out, times)).size
            p, q = jaccard.sketch(a), jaccard.sketch(b)
            w = min(len(p), len(q))
            assert np.bitwise_count(jaccard.folded(p, w) ^ jaccard.folded(q, w)).sum() <= len(a) + len(b) - 2 * both


def test_hashed_words_match_words():
    rng = random.Random(3)
    for _ in range(100):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("aAbB  \n\x1c\x85é漢.") for _ in range(rng.randrange(30))) for _ in range(6)]
        hashes, per = words.words(pa.array(["pad", *texts])[1:])
        flat = [w for t in texts for w in tokens(t)]
        assert np.diff(per).tolist() == [len(tokens(t)) for t in texts]
        assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
        assert [len(s) for s in words.shingle_sets(pa.array(texts, pa.string()))] == [len(shingles(t)) for t in texts]


def test_words_of_any_length_have_hashes_of_their_own():
    word = "a"
    while len(word) < 2048:  # where a polynomial modulo 2 ** 64 fails
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [w[:n] for n in (2048, 300, 257, 256, 255, 64, 9, 8, 7) for w in (word, word.translate(str.maketrans("ab", "ba")))] + ["a" * n for n in range(1, 300)] + ["\0" * n for n in range(1, 40)]
    hashes, per = words.words(pa.array(texts))
    assert np.diff(per).tolist() == [1] * len(texts) and len(set(hashes.tolist())) == len(set(texts))
    joined, _ = words.words(pa.array([" ".join(texts)]))
    assert joined.tolist() == hashes.tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 200: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sainte_lague(spark):
    def plain(weights, seats):
        won = dict.fromkeys(weights, 0)
        for _ in range(seats):
            won[max(sorted(weights), key=lambda k: weights[k] / (2 * won[k] + 1))] += 1
        return won

    rng = random.Random(1)
    rows, want = [], {}
    for g, (n, seats) in enumerate([(1, 5), (3, 10), (7, 2), (20, 100), (5, 0), (6, 61)]):
        w = {k: float(rng.choice([1, 2, 3, 10, 500])) for k in range(n)}
        rows += [(g, k, x, seats) for k, x in w.items()]
        want |= {(g, k): s for k, s in plain(w, seats).items()}
    rows.append((9, 0, 0.0, 4))
    want[9, 0] = 0
    df = spark.createDataFrame(rows, "g int, k int, w double, seats long")
    got = {(r.g, r.k): r.quota for r in mixing.sainte_lague(df, ["g"], "k", "w", "seats").collect()}
    assert got == want
    got = {r.k: r.quota for r in mixing.sainte_lague(df.where("g = 3"), [], "k", "w", "seats").collect()}
    assert got == {k: s for (g, k), s in want.items() if g == 3}


def test_mixing(spark, docs):
    rows = [(i, " ".join(["w"] * (i % 50)), ["b", "a", "ä", None, "Z"][i % 5] if i % 3 else "a") for i in range(300)]
    df = spark.createDataFrame([(i, t, s, 0) for i, t, s in rows], "doc_id long, text string, source string, size int")
    out = mixing.mix(df, shard=500).collect()
    assert len(out) == 300
    source = {i: s for i, _, s in rows}
    per = collections.defaultdict(int)
    for i, t, s in rows:
        per[s] += len(tokens(t))
    order = sorted((s for s in per if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, stopped = 1.5 * sum(per.values()), {}, set()
    while True:
        left = total - sum(2 * per[s] for s in stopped)
        level = left / sum(weight[s] for s in order if s not in stopped)
        more = {s for s in order if s not in stopped and weight[s] * level > 2 * per[s]}
        if not more:
            break
        stopped |= more
    target = {s: 2.0 * per[s] if s in stopped else weight[s] * level for s in order}
    taken = collections.defaultdict(int)
    for r in out:
        assert r.source_size == per[source[r.id]]
        assert r.target == pytest.approx(target[source[r.id]])
        assert r.taken <= 2 * r.size
        taken[source[r.id]] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 3 * mixing.BLOCK)
    again = {r.id: r.taken for r in mixing.mix(df.repartition(5), shard=500).collect()}
    assert again == {r.id: r.taken for r in out}
    assert mixing.mix(docs).count() == len(TEXTS)
    assert mixing.mix(docs.where("false")).count() == 0
    assert [r.taken for r in mixing.mix(docs.where("text is null")).collect()] == [0]


def plain_shares(weights, seats):
    won = dict.fromkeys(weights, 0)
    for _ in range(seats):
        won[max(sorted(weights), key=lambda k: weights[k] / (2 * won[k] + 1))] += 1
    return won


def test_mixing_takes_what_plain_apportionment_takes(spark):
    """taken and the repeated rows against a plain computation: quotas seat by seat, shards laid out document by document."""
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "b", None, "c"])) for i in range(200)] + [(7, "w w w", "a"), (7, "w w w", "a"), (None, "w w", "b")]
    df = spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id long, text string, source string, row int, at string").repartition(3)
    size = lambda t: len(t.split())
    sums = collections.Counter()
    for _, t, s in rows:
        sums[s] += size(t)
    order = [*sorted(s for s in sums if s), None]
    target = {r.source: r.target for r in mixing.laid_out(df).select("source", "target").distinct().collect()}
    seats = plain_shares({k: target[s] for k, s in enumerate(order)}, round(sum(target.values()) / mixing.BLOCK))
    laid = mixing.laid_out(df, shard=200).select("id", "source", "at", "size", "shards", "shard", "taken", F.xxhash64("source", F.lit(0)).alias("x")).collect()
    first = {(r.k, r.j): r.h for r in spark.createDataFrame([(k, j) for k in range(len(order)) for j in range(60)], "k long, j long").select("k", "j", F.xxhash64("k", "j", F.lit(17)).alias("h")).collect()}
    for k, s in enumerate(order):
        mine = [r for r in laid if r.source == s and r.size]
        assert {r.shards for r in mine} <= {math.ceil(sums[s] / 200)}
        words = collections.Counter()
        for r in mine:
            assert r.shard == r.at % r.shards
            words[r.shard] += r.size
        quota = plain_shares({j: float(w) for j, w in words.items()}, seats[k]) if words else {}
        for j, w in words.items():
            n = math.ceil(w / mixing.BLOCK)
            q = min(quota[j], 2 * n)
            start = first[k, j] % n
            times = [q // n + ((b - start) % n < q % n) for b in range(n)]
            at = 0
            for r in sorted((r for r in mine if r.shard == j), key=lambda r: r.at):
                if sum(x.at == r.at for x in mine) == 1:
                    assert r.taken == sum(times[x // mixing.BLOCK] for x in range(at, at + r.size))
                at += r.size
    text_of = collections.Counter((r.doc_id, r.text) for r in mixing.repeated(df, shard=200).collect())
    for r in laid:
        t = [t for i, t, s in rows if i == r.id and s == r.source and size(t) == r.size][0]
        if r.id != 7:
            assert text_of[r.id, t] == (int(r.taken / r.size + 0.5) if r.size else 0)
    assert text_of[7, "w w w"] % 2 == 0 and mixing.repeated(df).columns == df.columns
    assert mixing.repeated(df.where("false")).count() == 0


@pytest.mark.parametrize("few", [100, 0])
def test_rows_are_taken_out_by_key(spark, few):
    df = spark.createDataFrame([(i % 40 if i % 7 else None, f"t{i % 50}", 1, "y") for i in range(400)] + [(1, None, 2, "z")], "doc_id long, text string, id int, key string").repartition(3)
    gone = spark.createDataFrame([(i, f"t{i}") for i in range(0, 40, 3)] + [(None, "t14"), (None, "t0")], "id long, text string").select("id", F.xxhash64("text").alias("key"))
    out = set_ = {(i, f"t{i}") for i in range(0, 40, 3)} | {(None, "t14"), (None, "t0")}
    want = collections.Counter((r.doc_id, r.text) for r in df.collect() if (r.doc_id, r.text) not in set_)
    out = llm_rows.without_rows(df, gone, "doc_id", F.xxhash64("text"), few=few)
    assert out.columns == df.columns and collections.Counter((r.doc_id, r.text) for r in out.collect()) == want
    one = llm_rows.one_of_each(df, gone, "doc_id", F.xxhash64("text")).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in one))) == sorted(map(str, {(r.doc_id, r.text) for r in df.collect()} & set_))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, weight int")


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + (0.02 if i % 3 else 0.25) * rng.standard_normal(16)).astype(float).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(60)]  # copies
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None] + [1.0] * 15), (405, [float("inf")] + [1.0] * 15), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (None, rows[0][1])]
    x = np.array([np.float32(v) for i, v in rows[:360]], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    got = {r.id: r for r in embeddings.near_duplicates(vectors(spark, rows), block=32).collect()}
    assert len(got) == len(rows)
    found = sum(got[i].n_links for i in range(360))
    assert all(got[i].n_links <= links[i].sum() for i in range(360))
    assert found >= 0.9 * links.sum()
    assert got[0].n_links >= 60 and len({got[i].component_id for i in (0, *range(300, 360))}) == 1
    for i in range(400, 406):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[407].n_links, got[407].component_id, got[407].kept) == (1, 406, False)
    assert all(r.kept == (r.id == r.component_id) for r in got.values() if r.id is not None)
    assert got[None].n_links == 0
    assert embeddings.near_duplicates(vectors(spark, rows).where("false")).count() == 0
    assert embeddings.near_duplicates(vectors(spark, rows).where("vec_id = 400")).count() == 1


def test_embeddings_recall_holds_with_wide_substrings(spark, monkeypatch):
    """Pairs at cosine 0.90 to 0.92 meet as surely with the 16-bit substrings of millions of vectors."""
    n = 300
    monkeypatch.setattr(embeddings, "OCCUPANCY", 2 * n / 2**16)
    rng = np.random.default_rng(3)
    x, u = rng.standard_normal((2, n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    u -= (u * x).sum(1)[:, None] * x
    u /= np.linalg.norm(u, axis=1)[:, None]
    t = rng.uniform(0.901, 0.92, n)[:, None]
    rows = list(enumerate(np.concatenate([x, t * x + np.sqrt(1 - t * t) * u]).tolist()))
    got = {r.id: r for r in embeddings.near_duplicates(vectors(spark, rows)).collect()}
    assert sum(got[n + i].component_id == i for i in range(n)) >= 0.97 * n


def test_rotation_codes_are_balanced():
    x = np.random.default_rng(0).standard_normal((2000, 32)) + 0.3
    mean, projection = embeddings.learn(x, rotations=2)
    share = ((x - mean) @ projection >= 0).mean(0)
    assert np.abs(share - 0.5).max() < 0.06
    r = projection[:, :32]
    assert np.allclose(r.T @ r, np.eye(32), atol=1e-8)


def test_quality(spark, docs):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["the", "river", "runs", "down", "green", "hills"]) for _ in range(60)) + "." for _ in range(80)]
    bad = [" ".join(w + "###" for w in t.upper().split()) for t in good[:40]]
    rows = [(i, t, f"h{i % 4}", "good") for i, t in enumerate(good)] + [(1000 + i, t, "spam" if i % 2 else None, "bad") for i, t in enumerate(bad)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kind string").withColumn("host_mean", F.lit(1.0))
    labels = df.where("doc_id % 2 = 0").select("doc_id", (F.col("kind") == "good").cast("int").alias("quality"))
    labels = labels.unionAll(spark.createDataFrame([(None, 1), (5, None), (7, 9)], "doc_id long, quality int"))
    kind = {i: k for i, _, _, k in rows}
    out = quality.judged(df, labels, F.col("source"), F.lit("p")).collect()
    assert len(out) == len(rows)
    assert all(r.keep == (kind[r.id] == "good") for r in out)
    bounded = quality.judged(df, labels, F.col("source"), F.lit("p"), max_rows=40).collect()
    assert sum(r.keep == (kind[r.id] == "good") for r in bounded) > 0.95 * len(rows)
    edge = quality.judged(docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(edge) == len(TEXTS)
    assert all(0 < r.p_quality < 1 for r in edge)
    assert all(r.keep for r in quality.judged(docs, labels.where("false"), F.col("source"), F.col("lang")).collect())
    assert quality.judged(docs.where("false"), labels, F.col("source"), F.col("lang")).count() == 0
    # Rejected rows go, and columns named like results or inner ones stay as they are; repeated rows, ids and texts each count.
    clash = df.unionAll(df.where("doc_id in (3, 1003)")).withColumns({c: F.lit("as it was") for c in ("keep", "p_quality", "__h", "__p", "key", "host", "path", "row", "id")})
    left = quality.kept(clash, labels, F.col("source"), F.lit("p"))
    assert left.columns == clash.columns
    got = left.collect()
    assert sorted(r.doc_id for r in got) == sorted([*range(80), 3])
    assert all(r.keep == r["__h"] == r.key == r.row == "as it was" and r.host_mean == 1.0 for r in got)


def test_quality_equals_a_plain_computation(spark):
    """p_quality from p_text and the sites, computed again."""
    rng = random.Random(8)
    rows = [(i % 90, " ".join(rng.choice(["fine", "plain", "words", "CLICK", "###", "now"]) for _ in range(rng.randrange(0, 40))), rng.choice(["a", "b", None]), rng.choice(["x", "y", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 90, 2)], "doc_id long, quality int")
    out = quality.judged(df, labels, F.col("source"), F.col("lang"))
    keys = df.select("doc_id", "source", "lang", quality.judged_key(F.col("text"), F.col("source"), F.col("lang")).alias("key")).distinct()
    got = out.join(keys, (F.col("id") == F.col("doc_id")) & (out["key"] == keys["key"])).select("source", "lang", "p_text", "host_mean", "path_mean", "p_quality", "keep").collect()
    assert len(got) == len(rows)
    _, prior = quality.site_posteriors(out.join(keys, (F.col("id") == F.col("doc_id")) & (out["key"] == keys["key"])).select(F.col("source").alias("host"), F.col("lang").alias("path"), F.col("p_text").alias("p")))
    odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for r in got:
        host = [x.p_text for x in got if x.source == r.source]
        path = [x.p_text for x in got if (x.source, x.lang) == (r.source, r.lang)]
        host_mean = (sum(host) - r.p_text + prior["host"] * prior["top"]) / (len(host) - 1 + prior["host"])
        path_mean = (sum(path) - r.p_text + prior["path"] * host_mean) / (len(path) - 1 + prior["path"])
        p = 1 / (1 + math.exp(-(odds(r.p_text) + odds(path_mean) - odds(prior["top"]))))
        assert (r.host_mean, r.path_mean, r.p_quality) == (pytest.approx(host_mean), pytest.approx(path_mean), pytest.approx(p))
        assert r.keep == (r.p_quality >= 0.5)


def test_site_posteriors_equal_a_plain_computation(spark):
    rng = np.random.default_rng(4)
    rows = [(f"h{h}", f"p{q}" if q else None, float(np.clip(rng.normal(0.2 + 0.15 * h + 0.05 * q, 0.1), 0.01, 0.99))) for h in range(5) for q in range(3) for _ in range(1 if h == 4 else 40 * (q + 1))]
    sites, prior = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {(r.host, r.path): (r.host_mean, r.path_mean) for r in sites.collect()}
    p = np.array([r[2] for r in rows])
    top = p.mean()

    def strength(sites, above):
        n, mean = np.array([len(x) for x in sites]), np.array([x.mean() for x in sites])
        noise = sum(((x - x.mean()) ** 2).sum() for x in sites) / n.sum()
        return float(np.clip(noise / max(((n * (mean - above) ** 2).sum() - len(n) * noise) / n.sum(), 1e-9), 5, 1e6))

    of = lambda keep: np.array([r[2] for r in rows if keep(r)])
    hosts = {h: of(lambda r, h=h: r[0] == h) for h, _, _ in rows}
    k = strength(list(hosts.values()), top)
    host_mean = {h: (x.sum() + k * top) / (len(x) + k) for h, x in hosts.items()}
    paths = {(h, q): of(lambda r, h=h, q=q: r[:2] == (h, q)) for h, q, _ in rows}
    k2 = strength(list(paths.values()), np.array([host_mean[h] for h, _ in paths]))
    assert prior == pytest.approx({"top": top, "host": k, "path": k2})
    assert got.keys() == paths.keys()
    for (h, q), x in paths.items():
        assert got[h, q] == pytest.approx((host_mean[h], (x.sum() + k2 * host_mean[h]) / (len(x) + k2)))


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", 0.9)] * 200 + [("low", "p", 0.1)] * 200 + [("tiny", "p", 0.1)]
    sites, prior = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {r.host: r.host_mean for r in sites.collect()}
    assert abs(got["low"] - 0.1) < abs(got["tiny"] - 0.1)
    assert got["low"] < got["tiny"] < prior["top"] + 0.01


def test_quality_leaves_the_document_out_of_its_site(spark):
    df = spark.createDataFrame([(i, f"word{i} text of number {i} and more", "a" if i else "b") for i in range(30)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, quality int")
    out = {r.id: r for r in quality.judged(df, labels, F.col("source"), F.lit("p")).collect()}
    top = np.mean([r.p_text for r in out.values()])
    assert out[0].host_mean == pytest.approx(top) and out[0].path_mean == pytest.approx(top)  # alone in its site: the prior is all it has
    assert out[0].p_quality == pytest.approx(out[0].p_text)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    out = quality.judged(docs, labels.where(~odd), F.col("source"), F.col("lang")).join(labels.where(odd).select(F.col("doc_id").alias("id"), "quality"), "id").where("quality in (0, 1)")
    rows = out.select("quality", "p_quality", "keep").collect()
    good, bad = ([r.p_quality for r in rows if r.quality == v] for v in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(good) > 50 and len(bad) > 10 and auc >= 0.95
    assert np.mean([r.keep for r in rows if r.quality == 1]) >= 0.95 and np.mean([r.keep == (r.quality == 1) for r in rows]) >= 0.92


def test_lm_scores(spark, docs):
    rng = random.Random(0)
    langs = {"en": ["the", "of", "and", "house", "tree"], "fr": ["le", "de", "et", "maison", "arbre"]}
    texts = [" ".join(rng.choice(langs[lang]) for _ in range(rng.randrange(5, 60))) for lang in ("en", "fr") * 150]
    rows = [(500 + i, t) for i, t in enumerate(texts)] + TEXTS
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, score int").repartition(3)
    out = maxent.score_texts(df).collect()
    assert len(out) == len(rows)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    count = collections.Counter()
    for i, t in rows:
        if not held(i):
            count.update([*tokens(t), None])
    n, v = sum(count.values()), len(count)
    text_of = dict(rows)
    sums = np.zeros(2)
    for r in out:
        ts = [*tokens(text_of[r.id]), None]
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.id), len(ts), sum(count[x] > 0 for x in ts), n)
        assert r.score < 0
        if r.held_out and r.id is not None and r.id >= 500:
            sums += (r.base_score, r.score)
    assert sums[1] > sums[0]  # held-out texts become likelier
    assert maxent.score_texts(df.where("false")).count() == 0
    again = {n: {r.id: r.score for r in maxent.score_texts(df.where("doc_id >= 500").repartition(n)).collect()} for n in (2, 5)}
    assert all(again[5][i] == pytest.approx(x, rel=1e-6) for i, x in again[2].items())  # however the table is partitioned
    alone = maxent.score_texts(df.where("doc_id is null")).first()
    assert (alone.train_tokens, alone.n_known) == (0, 0)
    assert math.isfinite(alone.score)


def test_lm_learns_from_the_third_word_before():
    """Texts that repeat three words: only the skip of two tells the next word."""
    rng = np.random.default_rng(2)
    word = np.unique(rng.integers(0, 1 << 63, 30, dtype=np.uint64))
    t = np.concatenate([np.tile(rng.choice(word, 3, replace=False), 20) for _ in range(1500)])
    bounds = np.arange(0, len(t) + 1, 60)
    voc = maxent.Vocabulary(word, np.array([(t == w).sum() for w in word]), np.zeros(maxent.SHARES))
    at, found = voc.look_up(t)
    rows, classes = maxent.features(voc.numbers_of(at, found), bounds, maxent.ROWS), voc.classes_of(t, at, found)
    weights = voc.start()
    squares = tuple(np.zeros_like(w) for w in weights)
    train = len(t) - 6000
    for _ in range(maxent.EPOCHS):
        for a in range(0, train, 8192):
            maxent._update(weights, squares, rows[a : min(a + 8192, train)], classes[a : min(a + 8192, train)])
    mean = lambda w: maxent.log_class(w, rows[train:], classes[train:]).mean()
    assert mean(weights) > mean(voc.start()) + 0.5
    assert maxent.EPOCHS >= 2 and maxent.CLASSES >= 96 and rows.shape[1] == 5


def test_lm_update_equals_its_formula():
    rng = np.random.default_rng(3)
    rows, columns = rng.integers(1, 50, (2000, 5)).astype(np.int32), rng.integers(0, maxent.WITHIN, 2000)
    rows[:, 0] = 0
    weights = rng.standard_normal((maxent.ROWS, maxent.WITHIN)).astype(np.float32)
    gradient = -np.exp(maxent.log_softmax(weights, rows)).astype(float)
    gradient[np.arange(2000), columns] += 1
    want = np.zeros(weights.shape)
    np.add.at(want, rows.ravel(), np.repeat(gradient, 5, 0))
    squares, new = np.zeros_like(weights), weights.copy()
    maxent._step(new, squares, rows, columns, *maxent._sorted(rows))
    assert np.allclose(new - weights, maxent.STEP * want / np.sqrt(want**2 + 1), atol=1e-3)


def test_lm_update_moves_the_tokens_groups_alone():
    """Both steps against the formula, group by group."""
    rng = np.random.default_rng(6)
    rows, classes = rng.integers(1, 30, (3000, 5)).astype(np.int32), rng.integers(0, maxent.CLASSES - maxent.WITHIN, 3000)
    rows[:, 0] = 0
    old = tuple(rng.standard_normal(w.shape).astype(np.float32) for w in maxent.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, int), np.ones(maxent.SHARES)).start())
    new, squares = tuple(w.copy() for w in old), tuple(np.zeros_like(w) for w in old)
    maxent._update(new, squares, rows, classes)
    flat, within = rows * maxent.GROUPS + (classes // maxent.WITHIN)[:, None], classes % maxent.WITHIN
    for w, n, r, c in ((old[0], new[0], rows, classes // maxent.WITHIN), (old[1], new[1], flat, within)):
        gradient = -np.exp(maxent.log_softmax(w, r)).astype(float)
        gradient[np.arange(3000), c] += 1
        want = np.zeros(w.shape)
        np.add.at(want, r.ravel(), np.repeat(gradient, 5, 0))
        assert np.allclose(n - w, maxent.STEP * want / np.sqrt(want**2 + 1), atol=1e-3)


def test_lm_look_up_and_packing():
    rng = np.random.default_rng(5)
    known = np.unique(np.concatenate([rng.integers(0, 1 << 63, 3000, dtype=np.uint64) << np.uint64(1), np.arange(50, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(50, dtype=np.uint64)]))
    voc = maxent.Vocabulary(known, rng.integers(1, 100, len(known)), np.zeros(maxent.SHARES))
    ask = np.concatenate([known, known + np.uint64(1), rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
    at, found = voc.look_up(ask)
    assert (found == np.isin(ask, known)).all() and (voc.hashes[at[found]] == ask[found]).all()
    bounds = np.array([0, 1, 5, 40, 41, len(known)])
    numbers = voc.numbers_of(*voc.look_up(known))
    ends = numbers.copy()
    ends[bounds[1:] - 1] |= maxent.ENDS
    rows, classes = maxent.unpacked(ends.tobytes(), (np.arange(len(known)) % 96).astype(np.uint8).tobytes(), maxent.ROWS)
    assert (rows == maxent.features(numbers, bounds, maxent.ROWS)).all() and rows.max() < maxent.ROWS and (classes == np.arange(len(known)) % 96).all()
    assert (maxent.hashed_rows(0), maxent.hashed_rows(1 << 28), maxent.hashed_rows(1 << 40)) == (1 << 14, 1 << 15, 1 << 16)


def test_lm_is_a_distribution(spark):
    """Over all known words and the unknown one of each share, probabilities after a context sum to one."""
    rng = np.random.default_rng(0)
    known = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64) << np.uint64(1))
    counts = rng.integers(1, 500, len(known))
    frequent = np.argsort(-counts)[:200]
    rare = np.setdiff1d(np.arange(len(known)), frequent)
    mass = np.zeros(maxent.SHARES)
    np.add.at(mass, (known[rare] >> np.uint64(64 - maxent._SHARE_BITS)).astype(int), counts[rare] + maxent.SMOOTH)
    voc = maxent.Vocabulary(known[frequent], counts[frequent], mass)
    weights = tuple(w + rng.standard_normal(w.shape).astype(np.float32) for w in voc.start())
    p = np.exp(maxent.log_class(weights, np.tile(np.array([[0, 1, 2, 3, 4]], np.int32), (maxent.CLASSES, 1)), np.arange(maxent.CLASSES)))
    at, found = voc.look_up(known)
    cls = voc.classes_of(known, at, found)
    total = (p[cls] * (counts + maxent.SMOOTH) / voc.mass[cls]).sum()
    unknown = p[maxent.SINGLES + maxent.BANDS :] * maxent.SMOOTH / voc.mass[maxent.SINGLES + maxent.BANDS :]
    live = p[voc.mass > 0].sum()
    assert total + unknown.sum() == pytest.approx(live, abs=1e-5)


def test_tidy_tasks_yield_all_and_give_memory_back(monkeypatch):
    back = []
    monkeypatch.setattr(workers, "give_back", lambda: back.append(1))
    assert list(workers.tidy(lambda batches: (2 * b for b in batches))(iter([1, 2, 3]))) == [2, 4, 6] and len(back) == 1
    assert list(workers.tidy(lambda batches: iter(()))(iter(()))) == [] and len(back) == 2
    stopped = workers.tidy(lambda batches: (b for b in batches))(iter([1, 2, 3]))
    assert next(stopped) == 1
    stopped.close()
    assert len(back) == 3
