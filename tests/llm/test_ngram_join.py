"""The n-gram Jaccard join against all pairs on small tables."""

import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

pytest.importorskip("plumbline.llm.queries")

from plumbline.llm import ngram_join  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ngrams(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    size = min(3, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def similar(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 90 * (len(a) + len(b) - both)


def brute_components(texts):
    sets = [ngrams(t) for t in texts]
    name = list(range(len(texts)))
    changed = True
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            if name[i] != name[j]:
                name[i] = name[j] = min(name[i], name[j])
                changed = True
    return [(len(s), n) for s, n in zip(sets, name)], len(pairs)


def made_texts(seed):
    """Families of texts at and around the limit, common passages, short texts and copies."""
    draw = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    texts = [None, "", " \n", "one", "One", "one two", "ONE  two", "one two three", "the the the the", "é É"]
    for family in range(24):
        base = [draw.choice(["a", "b", f"w{draw.randrange(400)}"]) for _ in range(draw.choice([4, 12, 30, 31, 60, 200, 700]))]
        if family % 3 == 0:
            base += common
        for _ in range(draw.choice([2, 5, 14])):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 3, max(1, len(base) // 60), len(base) // 35])):
                place = draw.randrange(len(copy))
                copy[place : place + draw.choice([0, 1, 1])] = [f"n{draw.randrange(5000)}"]
            texts.append(draw.choice([" ", "\n"]).join(copy))
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, block", [(1, 256), (2, 3)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", block)
    texts = made_texts(seed)
    wanted, pairs = brute_components(texts)
    assert pairs > 60
    rows = [(i, t, "c", 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[5], rows[5], (None, texts[-1], None, None, None)],
                                 "doc_id long, text string, cid string, n_ngrams int, component int").repartition(3)
    found = ngram_join.ngram_join(docs).collect()
    assert len(found) == len(rows) + 3
    for row in found:
        if row.doc_id is None:
            assert row.component_id is None
        else:
            assert (row.n_ngrams, row.component_id) == wanted[row.doc_id], row.doc_id


def test_empty_table_and_lone_rows(spark):
    docs = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (9, "x y z")], "doc_id long, text string")
    rows = ngram_join.ngram_join(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(7, 2, 7), (7, 2, 7), (9, 1, 9)]
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0


def unit_members(sets, order):
    rows = []
    for cid, own in enumerate(sets):
        ranked = sorted(own, key=lambda g: order[g])
        taken = ranked[: ngram_join.prefix_length(len(own))]
        rows.append((0, cid, [order[g] for g in taken], taken, list(range(len(taken))), np.sort(np.array(own, np.uint64)).tobytes()))
    return pd.DataFrame(rows, columns=["block", "cid", "dfs", "hs", "places", "ngrams"]).map(
        lambda v: np.array(v, np.int64) if isinstance(v, list) else v)


def test_filters_lose_no_pair_and_drop_most():
    draw = random.Random(3)
    universe = [draw.getrandbits(62) for _ in range(3000)]
    sets = []
    for _ in range(30):
        base = draw.sample(universe, draw.choice([20, 100, 300]))
        sets += [draw.sample(base, len(base) - draw.randrange(len(base) // 9 + 1)) for _ in range(6)]
    # an order with its own rank per n-gram; the quarter needn't come first for the filters to hold
    members = ngram_join._Members(unit_members(sets, {g: i for i, g in enumerate(universe)}))
    i, j = ngram_join.candidates(members, members, True)
    assert len(set(zip(i, j))) == len(i) and (i < j).all()
    linked = {(x, y) for x in range(len(sets)) for y in range(x + 1, len(sets)) if similar(set(sets[x]), set(sets[y]))}
    assert linked <= set(zip(i.tolist(), j.tolist())) and len(linked) > 40
    assert len(i) < 3 * len(linked)
    both = ngram_join.overlaps(members, members, i, j)
    assert both.tolist() == [len(set(sets[x]) & set(sets[y])) for x, y in zip(i, j)]
    assert len(i) > ngram_join.FEW_PAIRS or len(i) < 40 or (ngram_join.overlaps(members, members, i[:40], j[:40]) == both[:40]).all()


def test_matrix_and_pairwise_overlaps_agree(monkeypatch):
    draw = random.Random(8)
    sets = [draw.sample(range(10**6, 10**6 + 500), draw.randrange(1, 200)) for _ in range(25)]
    members = ngram_join._Members(unit_members(sets, {g: g for s in sets for g in s}))
    i, j = np.triu_indices(25, 1)
    want = [len(set(sets[x]) & set(sets[y])) for x, y in zip(i, j)]
    for few, columns in ((0, 7), (0, 4096), (10**6, 1)):
        monkeypatch.setattr(ngram_join, "FEW_PAIRS", few)
        monkeypatch.setattr(ngram_join, "COLUMNS", columns)
        assert ngram_join.overlaps(members, members, i, j).tolist() == want


def test_batches_hold_every_text_once():
    texts = pa.array(["x" * n for n in (5, 0, 9, 30, 1, 1, 1)])
    ngram_join.BATCH_BYTES, kept = 10, ngram_join.BATCH_BYTES
    try:
        assert list(ngram_join.batches_of(texts)) == [(0, 2), (2, 3), (3, 4), (4, 7)]
    finally:
        ngram_join.BATCH_BYTES = kept
