"""Operators on small tables with every odd case, and against plain versions."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftline.llm import components, extraction, linededup, mixing, mpegts, neardup, outliers, packing, quality_model, sharding, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, key string, n long, cell int, g string"
WORD = re.compile("[^\x20\x09-\x0d]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{k % 977} x{k % 1013}" for k in range(30_000))
PROSE = [" ".join(f"{a}{(k * 7 + j * j) % 97}" for j in range(60)) for k, a in enumerate("abcdefgh")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", "y", 1, 2, "z") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows, columns with clashing names."""
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, "  \n\t ", "en", None), (4, LONG, "en", "a"), (5, PROSE[0], "de", "b"), (6, PROSE[0], "de", "c"), (7, PROSE[0] + " more", None, None)]
    rows += [(8, PROSE[1], "en", "a"), (8, PROSE[1], "en", "a"), (None, PROSE[2], "en", "a"), (10, "one", "en", "a"), (11, "É ß 日本\n\n$$$ x", "fr", "a")]
    rows += [(20 + k, PROSE[k % 8] + f" tail{k}", "en", "a") for k in range(30)]
    return docs_of(spark, rows).repartition(3).persist()


def plain_rules(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            line = line
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {p for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_outliers_base(spark, odd):
    extra = docs_of(spark, [(90, "a b c d e f g h\na b c d e f g h\n x\nx", "en", "a"), (91, "a b c d e f g h a b c d e f g h a b", "en", "a"), (92, "x " * 40, "en", "a")])
    both = odd.unionByName(extra)
    got = outliers.outlier_rules(both).collect()
    text = {r.doc_id: r.text for r in both.collect()}
    assert len(got) == both.count()
    for r in got:
        want = plain_rules(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_outliers_reject_what_differs(spark):
    rows = [(k, " ".join(f"{'abcdefghij'[(k + j) % 10]}{(k * j) % 83:04d}" for j in range(80)), "en", "s") for k in range(300)]
    rows += [(1000 + k, re.sub(" ", "*** ", t), lang, s) for k, (_, t, lang, s) in enumerate(rows[:30])]
    got = {r.doc_id: r.kept for r in outliers.outlier_rules(docs_of(spark, rows)).collect()}
    assert not any(got[1000 + k] for k in range(30)) and sum(got[k] for k in range(300)) >= 290


FLOOR = np.diag(np.square(outliers.FLOORS))


def plain_scatter(x, target):
    """The regularised scatter of a subset's rows, of a group of n rows whose subset this is."""
    rows, n = x
    drawn = 30 / (n + 30)
    return (1 - drawn) * outliers._consistency(0.75) * np.cov(rows.T, bias=True) + drawn * target + FLOOR


def plain_estimate(x, target, starts=60):
    """The least determinant of any start, by plain concentration steps; all subsets are starts in small groups."""
    n = len(x)
    h = math.ceil(0.75 * n)
    rng = np.random.default_rng(5)
    subsets = itertools.combinations(range(n), h) if n <= 9 else [rng.choice(n, 6, replace=False) for _ in range(starts)]
    best = None
    for subset in subsets:
        rows, before = x[list(subset)], math.inf
        while True:
            centre, scatter = rows.mean(0), plain_scatter((rows, n), target)
            now = np.linalg.slogdet(scatter)[1]
            d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
            if len(rows) >= h and (best is None or now < best[0]):
                best = (now, d2)
            if now > before - 1e-9 and len(rows) >= h:
                break
            before, rows = now if len(rows) >= h else math.inf, x[d2 <= np.sort(d2)[h - 1]]
    return best


def test_outliers_have_the_least_determinant(spark):
    rng = np.random.default_rng(3)
    groups = {}
    for g, n in enumerate([1, 2, 3, 5, 8, 8, 9, 9, 40, 120, 300]):
        x = rng.normal(0, (0.1, 0.6, 0.8, 0.7), (n, 4)) @ np.linalg.cholesky(0.6 * np.eye(4) + 0.4) + rng.normal(0, 1, 4)
        x[: n // 6] += rng.choice([-9, 9], 4)
        groups[f"g{g}"] = x
    df = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "g string, x0 double, x1 double, x2 double, x3 double")
    centred = df.join(outliers._quartiles(df), "g")
    s = outliers._common_scatter(centred, 0.75)
    target = np.zeros((4, 4))
    for (i, j), v in zip(outliers.PAIRS, s):
        target[i, j] = target[j, i] = v
    got = df.join(outliers._estimates(df, 0.75, 30.0), "g").select("g", *outliers.DIMS, outliers._distance().alias("d2"), *[f"l{i}{i}" for i in range(4)])
    found = collections.defaultdict(list)
    for r in got.collect():
        found[r.g].append(r)
    for g, x in groups.items():
        det, d2 = plain_estimate(x, target)
        own = 2 * sum(math.log(found[g][0][f"l{i}{i}"]) for i in range(4))
        assert own == pytest.approx(det, abs=1e-6)
        plain = {tuple(np.round(r, 9)): d for r, d in zip(x, d2)}
        for r in found[g]:
            assert r.d2 == pytest.approx(plain[tuple(np.round([r.x0, r.x1, r.x2, r.x3], 9))], abs=1e-5, rel=1e-5)


def test_small_groups_are_judged_too(spark):
    text = lambda k: " ".join(f"{'abcdefghij'[(k + j) % 10]}{(k * j) % 83:04d}" for j in range(80))
    rows = [(k, text(k), "en", f"s{k // 10}") for k in range(300)] + [(1000 + k, text(k).replace(" ", "*** "), "en", f"s{k}") for k in range(30)]
    got = {r.doc_id: r.kept for r in outliers.outlier_rules(docs_of(spark, rows)).collect()}
    assert not any(got[1000 + k] for k in range(30)) and sum(got[k] for k in range(300)) >= 295


def test_shards(spark, odd):
    many = odd.unionByName(docs_of(spark, [(100 + k, PROSE[k % 5] * (1 + k % 7), "en" if k % 3 else "de", f"s{k % 4}") for k in range(1500)] + [(5000 + k, "same text " * 20, "en", f"s{k % 3}") for k in range(700)]))
    got = sharding.kd_shards(many, 16).collect()
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    largest = max(r["size"] for r in got)
    assert set(size) == set(range(16)) and max(size.values()) - min(size.values()) <= 2 * largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == many.count()
    text = {r.doc_id: r.text or "" for r in many.collect()}
    assert all((r["size"], r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode())) for r in got)
    by_bytes = sharding.kd_shards(many, target_bytes=100_000).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(by_bytes) > 8 and all(r.n <= 1.1 * 100_000 + largest for r in by_bytes)
    again = {(r.doc_id, r.text_crc32, r.shard) for r in sharding.kd_shards(many.repartition(7), 16).collect()}
    assert again == {(r.doc_id, r.text_crc32, r.shard) for r in got}


def plain_tree(rows, n, first, scale, tolerable):
    """Shards of rows (i, w, three coordinates, h_text, h_row) by plain recursion."""
    if n == 1 or not rows:
        return {r[0]: first for r in rows}
    spread = lambda d: (max(r[2 + d] for r in rows) - min(r[2 + d] for r in rows)) / scale[d]
    dim = max(range(3), key=lambda d: (spread(d), -d))
    want, left, right, rest = sum(r[1] for r in rows) * (n // 2) / n, [], [], rows
    for column, whole in ((2 + dim, tolerable), (5, tolerable), (6, math.inf)):
        weight = collections.Counter()
        for r in rest:
            weight[r[column]] += r[1]
        for b in sorted(weight):
            if want - weight[b] <= 0:
                break
            want -= weight[b]
        left += [r for r in rest if r[column] < b]
        right += [r for r in rest if r[column] > b]
        rest = [r for r in rest if r[column] == b]
        if weight[b] <= whole:
            (right if want < weight[b] / 2 else left).extend(rest)
            break
    return plain_tree(left, n // 2, first, scale, tolerable) | plain_tree(right, n - n // 2, first + n // 2, scale, tolerable)


@pytest.mark.parametrize("n_shards", [2, 7, 16, 33])
def test_shards_are_those_of_a_plain_tree(spark, n_shards):
    rng = np.random.default_rng(n_shards)
    rows = [(k, int(rng.integers(1, 900)), int(rng.integers(0, 5)) * 700, int(rng.integers(0, 3)) * 1300, int(rng.integers(0, 300)), int(rng.integers(0, 40)) * 99, int(rng.integers(0, 4096))) for k in range(900)]
    rows += [(1000 + k, 500, 700, 1300, 7, 99, int(rng.integers(0, 4096))) for k in range(400)]
    df = spark.createDataFrame(rows, "key long, w long, c_source int, c_lang int, c_size int, h_text int, h_row int").repartition(3)
    scale = [max(1, max(r[c] for r in rows) - min(r[c] for r in rows)) for c in (2, 3, 4)]
    want = plain_tree(rows, n_shards, 0, scale, 0.01 * sum(r[1] for r in rows) / n_shards)
    assert {r.key: r.first for r in sharding.kd_leaves(df, n_shards, 0.01).collect()} == want


def brute_groups(rows, n, up):
    sets, root = {}, {}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = WORD.findall(low)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= up * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n, similarity", [(3, 0.85), (5, 0.8)])
def test_near_duplicates_are_those_of_all_pairs(spark, odd, n, similarity):
    words = lambda seed, k: [f"w{(seed * 7919 + j * 104729) % 9973}" for j in range(k)]
    rows = []
    for group in range(12):
        base = words(group, 30 + group * 15)
        for v in range(8):
            w = list(base)
            for e in range(v):
                w[(e * 13 + v * 7) % len(w)] = f"edit{group}_{v}_{e}"
            rows.append((1000 + group * 10 + v, " ".join(w), "en", "a"))
    df = odd.where("doc_id is not null").unionByName(docs_of(spark, rows))
    want = brute_groups([(r.doc_id, r.text) for r in df.select("doc_id", "text").distinct().collect()], n, round(similarity * 100))
    got = neardup.near_duplicates(df, n, similarity).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_rows_without_id(spark):
    got = neardup.near_duplicates(docs_of(spark, [(None, PROSE[0], "en", "a"), (3, PROSE[0], "en", "a"), (None, "other words here", "en", "a"), (None, None, "en", "a")]), 3, 0.85)
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got.collect() if r.component_id) == [(58, 3, False), (58, 3, True)]
    assert got.where("component_id is null and kept").count() == 2


def test_near_duplicates_of_several_texts_under_one_id(spark):
    rows = [(2, PROSE[0], "en", "a"), (2, PROSE[1], "en", "a"), (1, PROSE[0] + " more", "en", "a"), (9, PROSE[1] + " more", "en", "a"), (2, PROSE[0], "en", "a")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs_of(spark, rows), 3, 0.85).collect())
    assert got == [(1, 59, 1, True), (2, 58, 1, False), (2, 58, 1, False), (2, 58, 2, True), (9, 59, 2, False)]


def test_near_duplicates_by_other_keys(spark):
    rows = docs_of(spark, [(k, PROSE[k % 2], "en", "a") for k in range(6)]).withColumn("doc_id", F.format_string("d%d", "doc_id"))
    assert sorted(r.doc_id for r in neardup.near_duplicates(rows, 3, 0.85).where("kept").collect()) == ["d0", "d1"]


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 200), (200, 150), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components.connected_components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 150: 100, 200: 100}
    assert components.connected_components(edges.limit(0)).count() == 0


def plain_line_dedup(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        keys = [tuple(x.strip(" \t\n\x0b\f\r") for x in lines[k : k + 3]) for k in range(len(lines) - 2)]
        covered = set()
        for k, key in enumerate(keys):
            if key in seen:
                covered |= {k, k + 1, k + 2}
            seen.add(key)
        out[i] = len(covered)
    return out


def test_line_dedup(spark, odd):
    a = "\n".join(f"line {k} of the text" for k in range(8))
    rows = [(201, a), (202, "intro\n" + a + "\n\noutro"), (203, "line 1 of the text\nline 2 of the text\nnew"), (204, "x\ny\nz\nx\ny\nz\nx\ny"), (205, "\n\nx\n \ny \nz\nlast"), (206, "x\ny")]
    df = odd.where("doc_id <> 8").unionByName(docs_of(spark, [(i, t, "en", "a") for i, t in rows]))
    got = {r.doc_id: r for r in linededup.remove_repeated_lines(df).collect()}
    want = plain_line_dedup([(r.doc_id, r.text) for r in df.collect()])
    assert {i: r.n_removed for i, r in got.items()} == want
    assert got[202].text == "intro\noutro" and got[204].text == "x\ny\nz" and got[205].text == "last" and got[206].text == "x\ny" and got[203].n_removed == 0
    assert got[1].text is None and got[4].text == LONG and got[202].removed_lines[0] == "line 0 of the text"
    assert set(df.columns) <= set(next(iter(got.values())).asDict())


def test_line_dedup_of_rows_without_id_and_of_clashing_columns(spark):
    a = "\n".join(f"line {k} of the text" for k in range(4))
    other = "\n".join(f"other {k} of the text" for k in range(4))
    rows = [(None, a, "en", "a"), (None, "x\n" + a, "en", "a"), (None, other, "en", "a"), (5, other, "en", "a"), (5, a + "\ny", "en", "a"), (5, a + "\ny", "en", "a")]
    df = docs_of(spark, rows).withColumn("n_lines", F.lit("clash")).withColumn("_siftline_lines", F.lit(1))
    got = linededup.remove_repeated_lines(df)
    assert len(set(got.columns)) == len(got.columns)
    assert sorted((r.doc_id or 0, r.text, r.n_removed) for r in got.collect()) == sorted([(0, "", 4), (0, "x", 4), (0, "", 4), (5, other, 0), (5, a + "\ny", 0), (5, a + "\ny", 0)])


def test_streams_are_read_back(spark, odd):
    text = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    got = mpegts.transport_streams(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        p = mpegts.padded(text[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        s = mpegts.mux(p)
        assert (r.media_bytes, r.media_sha256, r.breaks) == (len(s), hashlib.sha256(s).hexdigest(), 0)


def test_archives(spark):
    rows = [(1, "u1", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "u3", None), (4, "u4", ""), (5, "u5", "é" * 50_000), (None, "u6", "<p>a</p>"), (None, "u7", "solo"), (2, None, "<p>a</p>"), (1, "u1", "<p>a</p>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha string, n long")
    got = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()), key=str)
    least = {"<p>a</p>": 1, "": 3, "é" * 50_000: 5, "solo": None}
    want = [(i or -1, len((h or "").encode()), warc.digest((h or "").encode()), "response" if least[h or ""] in (i, None) else "revisit", None if least[h or ""] in (i, None) else least[h or ""]) for i, _, h in rows]
    assert got == sorted(want, key=str)
    small = warc.archive_pages(pages, min_payload=9).collect()
    assert {r.record_type for r in small} == {"response"}


def test_packing_holds_every_id_once(spark, odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(odd, TOKENIZER, capacity=256).collect()
    ids = {r.doc_id: np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4") for r in odd.collect()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, p in pieces.items():
        times = 2 if i == 8 else 1
        assert sum(n for _, n in p) == times * len(ids[i])
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= 256


def test_packing_is_the_same_however_rows_are_dealt(spark, odd):
    rows = lambda df: sorted(str((r.doc_id, r.start, r.ids_crc32, r.sequence_id, r.offset)) for r in df.collect())
    many = odd.unionByName(docs_of(spark, [(8, PROSE[1], "en", "a")] * 40 + [(None, "x", "en", "a")] * 40))
    once = rows(packing.pack(many, TOKENIZER, bucket_pieces=20))
    assert once == rows(packing.pack(many.repartition(7), TOKENIZER, bucket_pieces=20))
    assert max(collections.Counter(r.sequence_id for r in packing.pack(many, TOKENIZER).collect()).values()) <= packing.MAX_SEGMENTS


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        total, spill = sum(w[s] for s in free), 0.0
        for s in list(free):
            target[s] += left * w[s] / total
        for s in list(free):
            if target[s] >= most * sizes[s]:
                spill += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
        left = spill
    return target


def test_mixing(spark, odd):
    rows = [(300 + k, " ".join(["w"] * (1 + k % 90)), "en", ["b", "c", "dé", "z", None][k % 5]) for k in range(900)]
    df = odd.unionByName(docs_of(spark, rows))
    got = mixing.mix_sources(df, cell_rows=20).collect()
    assert len(got) == df.count()
    sizes, largest, taken, target = collections.Counter(), collections.Counter(), collections.Counter(), {}
    for r in got:
        s = None if r.src == mixing.NO_SOURCE else r.src
        sizes[s] += r["size"]
        largest[s] = max(largest[s], r["size"])
        taken[s] += r["size"] * r.copies
        target[s] = r.target
        assert 0 <= r.copies <= 2 and r.source_size >= r["size"]
    want = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= largest[s] + 1e-6
    again = mixing.mix_sources(df.repartition(5), cell_rows=20)
    key = lambda r: (r.doc_id or 0, r.src, r["size"], r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))


def test_mixing_of_many_rows_without_id(spark):
    df = docs_of(spark, [(None, "w " * (1 + k % 3), "en", "a") for k in range(400)] + [(9, "v v", "en", "b")] * 300)
    got = mixing.mix_sources(df, cell_rows=50).collect()
    taken = collections.Counter()
    for r in got:
        taken[r.src] += r["size"] * r.copies
    assert len(got) == 700 and all(abs(taken[r.src] - r.target) <= 3 for r in got)


def test_mixing_keeps_expectations(spark):
    """Over many ids each document's copies are, on average, its source's target by its size."""
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 7 as int))").alias("text"), F.expr("case when id % 3 = 0 then 'a' else 'b' end").alias("source"))
    got = mixing.mix_sources(df, cell_rows=200).groupBy("src", "size").agg(F.avg("copies").alias("mean"), F.first(F.col("target") / F.col("source_size")).alias("want"), F.count("*").alias("n")).collect()
    assert all(abs(r["mean"] - r.want) < 5 * 0.5 / r.n**0.5 for r in got) and len(got) == 14


def test_targets_of_many_sources(spark):
    sizes = {f"host{k:03d}": 1 + (k * 37) % 501 for k in range(300)} | {None: 50, "é": 7}
    totals = spark.createDataFrame([(mixing.NO_SOURCE if s is None else s, 1, n) for s, n in sizes.items()], "src string, n long, source_size long").repartition(5)
    got = {None if r.src == mixing.NO_SOURCE else r.src: r.target for r in mixing.source_targets(totals, (5.0, 2.0, 1.0), 1.5, 2.0).collect()}
    want = plain_targets(sizes)
    assert all(got[s] == pytest.approx(want[s]) for s in sizes)


def test_quality_scores(spark, odd):
    rows = [(400 + k, (" ".join(PROSE[k % 8].split()[: 20 + k % 30]) if k % 4 else re.sub(" ", "*** ", PROSE[k % 8])), "en", "a") for k in range(300)]
    labels = spark.createDataFrame([(i, int("***" not in t), 0) for i, t, _, _ in rows] + [(400, None, 0)], "doc_id long, quality int, toxic int")
    df = odd.unionByName(docs_of(spark, rows))
    got = {r.doc_id: r for r in quality_model.quality_scores(df, labels).collect()}
    assert len(got) == df.select("doc_id").distinct().count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[i], int("***" not in t)) for i, t, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and np.mean([r.predicted == y for r, y in held]) > 0.95
    assert got[1].score == got[2].score
    none = quality_model.quality_scores(df, labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5}


def test_extraction_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a b, c.</p></article>", "t"), (2, None, None, "t"), (1, "u", "<article><p>a b, c.</p></article>", "t"), (None, "v", "", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extraction.extract(pages).collect()) == [(0, "v", "", 0), (1, "u", "a b, c.", 7), (1, "u", "a b, c.", 7), (2, "", "", 0)]


EMPTY = {
    "shards": lambda d, p, x: sharding.kd_shards(d, 16), "rules": lambda d, p, x: outliers.outlier_rules(d), "near": lambda d, p, x: neardup.near_duplicates(d, 3, 0.85),
    "lines": lambda d, p, x: linededup.remove_repeated_lines(d), "streams": lambda d, p, x: mpegts.transport_streams(d), "archives": lambda d, p, x: warc.archive_pages(p),
    "packing": lambda d, p, x: packing.pack(d, TOKENIZER), "mixing": lambda d, p, x: mixing.mix_sources(d), "scores": lambda d, p, x: quality_model.quality_scores(d, x), "text": lambda d, p, x: extraction.extract(p),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables(spark, odd, name):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert EMPTY[name](odd.limit(0), pages, labels).count() == 0
