"""The pipeline's stages, each against a plain version on its own input."""

import collections
import zlib

import numpy as np
import pytest
from test_spark import PROSE, TOKENIZER, brute_groups, plain_line_dedup, plain_rules, plain_targets

import corpus_pipeline as P
from siftline.llm import workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def results(spark):
    rows = []
    for k in range(240):
        text = " ".join(f"{a}{(k * 31 + j * j * 7) % 211}" for j, a in enumerate("abcdefghij" * 6))
        rows.append((k, text if k % 9 else "\n".join(text[i : i + 40] for i in range(0, len(text), 40)), "en", f"s{k % 3}"))
    rows += [(1000 + k, rows[k][1], "en", "s0") for k in range(20)]  # copies
    rows += [(1100 + k, rows[k + 30][1] + " one more", "en", "s1") for k in range(20)]  # near copies
    rows += [(1200 + k, "intro\n" + rows[9 * k][1] + "\noutro", "en", "s2") for k in range(5)]  # passages
    rows += [(1300, None, "en", "s0"), (1301, "", None, None), (1302, "short", "en", "s0"), (1303, "$$$ ### *** " * 30, "en", "s0"), (None, PROSE[0], "en", "s0"), (7, rows[7][1], "en", "s1"), (5, rows[5][1], "en", rows[5][3])]
    rows += [(6, rows[60][1] + " quite different " + PROSE[3], "en", "s1"), (None, PROSE[4], "en", "s1"), (None, PROSE[4], "en", "s2"), (None, rows[70][1], "en", "s0"), (1400, "long " + " ".join(f"w{k % 9973}v{k % 7}" for k in range(60_000)), "en", "s0")]
    docs = workspace.stage(spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS), "test")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(workspace.stage(stage(spark, out[-1], ""), "test"))
    return [(df.columns, [tuple(r) for r in df.collect()]) for df in out]


def test_columns_stay(results):
    assert [name for name, _ in P.STAGES] == ["quality rules", "line dedup", "near-duplicates", "mixing", "packing"]
    assert all(columns == list(P.COLUMNS) for columns, _ in results[:5])


def test_rejected_documents_go(results):
    before, after = results[0][1], results[1][1]
    assert not collections.Counter(after) - collections.Counter(before)
    for row in set(before) - set(after):
        n, _, _, _, repeated = plain_rules(row[1])
        assert n < 20 or 100 * repeated > 30 * n or row[0] > 1000 or (row[0] or 0) < 240
    for row in after:
        n, _, _, _, repeated = plain_rules(row[1])
        assert n >= 20 and 100 * repeated <= 30 * n
    clean = [r for r in before if r[0] is not None and r[0] < 240]
    assert len(set(after) & set(clean)) >= 0.97 * len(set(clean))


def test_repeated_lines_go(results):
    before, after = results[1][1], {r[0]: r for r in results[2][1]}
    ids = [r[0] for r in before]
    removed = plain_line_dedup([(r[0], r[1]) for r in before if r[0] is not None and ids.count(r[0]) == 1])
    for r in before:
        if ids.count(r[0]) > 1 or r[0] is None:
            continue
        lines = len([x for x in r[1].split("\n") if x.strip()])
        if removed[r[0]] == lines:
            assert r[0] not in after
        else:
            assert len([x for x in after[r[0]][1].split("\n") if x.strip()]) == lines - removed[r[0]]
            assert after[r[0]][4] == len(after[r[0]][1])


def test_one_of_each_group_stays(results):
    before, after = results[2][1], results[3][1]
    texts = sorted({(r[0] is None, r[0] or 0, r[1]) for r in before})  # documents, in the order of their ids
    groups = brute_groups([(k, t[2]) for k, t in enumerate(texts)], 5, 80)
    roots = [k for k, (_, root) in groups.items() if k == root]
    want = sorted((texts[k][0], texts[k][1], texts[k][2]) for k in roots)
    got = sorted((r[0] is None, r[0] or 0, r[1]) for r in after)
    ids = lambda rows: collections.Counter((missing, i) for missing, i, _ in rows)
    assert ids(got) == ids(want) and len({g for g in got}) == len(got)
    assert set(after) <= set(before)
    assert collections.Counter(r[0] for r in after)[6] == 2 and sum(r[0] is None for r in after) == 2


def test_mix_follows_the_targets(results):
    before, after = results[3][1], results[4][1]
    size = lambda r: plain_rules(r[1])[0]
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in before:
        sizes[r[3]] += size(r)
        largest[r[3]] = max(largest[r[3]], size(r))
    for r in after:
        taken[r[3]] += size(r)
    want = plain_targets(sizes)
    assert set(after) <= set(before) and max(collections.Counter(after).values()) <= 2
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in sizes)


def test_sequences_hold_every_id(results):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    columns, pieces = results[5]
    got, want = collections.Counter(), collections.Counter()
    for r in results[4][1]:
        ids = np.array(whole.encode(r[1], add_special_tokens=False).ids + [1], "<u4")
        for start in range(0, len(ids), 2041):  # a piece's loss is its length less one, and at most 2040
            want[r[0], start, zlib.crc32(ids[start : start + 2041].tobytes())] += 1
    filled = collections.Counter()
    for r in pieces:
        x = dict(zip(columns, r))
        got[x["doc_id"], x["start"], x["ids_crc32"]] += 1
        filled[x["sequence_id"]] += x["length"]
    assert got == want and max(filled.values()) <= 2048


def test_odd_tables_pass(spark):
    odd = [(k, PROSE[k % 8] + f" tail{k}", "en", "a", 9, 1, "x") for k in range(12)] + [(None, None, None, None, None, None, None)]
    schema = DOCS + ", n_lines int, key string"
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in P.STAGES[:4]:
            docs = workspace.stage(stage(spark, docs, ""), "test")
            assert docs.columns == [*P.COLUMNS, "n_lines", "key"] and docs.count() <= 2 * len(rows)
        assert (P.STAGES[4][1](spark, docs, "").count() > 0) == bool(rows)


def test_run_is_the_stages_in_order(spark, results, tmp_path):
    spark.createDataFrame([r for r in results[0][1]], DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    digest = lambda rows: sorted((str(r["doc_id"]), r["start"], r["ids_crc32"]) for r in rows)
    assert digest(P.run(spark, f"file://{tmp_path}").collect()) == digest([dict(zip(results[5][0], r)) for r in results[5][1]])
