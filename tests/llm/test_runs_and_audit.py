"""Periodic runs and the filter audit against brute force on small tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("plumbline.llm.queries")

from plumbline.llm import filter_audit, periodic_runs  # noqa: E402
from plumbline.llm.queries import QUERIES  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(12, 2 * q):
                block = words[i : i + length]
                if not any(block[d:] == block[:-d] for d in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_words(draw):
    """Words with runs of short and long periods, runs inside runs, and borders of equal periods."""
    kind, letters = draw.random(), draw.choice([1, 2, 3, 40])
    some = lambda n: [draw.randrange(letters) for _ in range(n)]
    words = []
    if kind < 0.2:
        return some(draw.randint(0, 120))
    if kind < 0.6:
        while len(words) < draw.randint(20, 300):
            unit = some(draw.randint(1, draw.choice([3, 20, 60])))
            words += [unit[i % len(unit)] for i in range(int(len(unit) * draw.uniform(1, 6)))]
        return words
    if kind < 0.8:
        unit = some(draw.randint(1, 4))
        for _ in range(draw.randint(2, 5)):
            turn = draw.randrange(len(unit))
            words += [unit[(turn + i) % len(unit)] for i in range(draw.randint(2, 80))]
        return words + words if draw.random() < 0.5 else words
    a, b = [0], [0, 1]
    while len(b) < draw.randint(30, 250):
        a, b = b, b + a
    return b


def test_runs_equal_brute_force():
    draw = random.Random(5)
    texts = [periodic_words(draw) for _ in range(600)]
    laid, starts = [], []
    for words in texts:
        starts.append(len(laid))
        laid += [*words, -1 - len(laid)]
    runs = periodic_runs.find_runs(np.array(laid, np.int64), max(map(len, texts)))
    place = np.searchsorted(starts, runs[:, 0], side="right") - 1
    got = collections.defaultdict(list)
    for i, (start, length, period) in zip(place, runs.tolist()):
        got[i].append((start - starts[i], length, period))
    wanted = [brute_runs(words) for words in texts]
    assert max(q for runs in wanted for _, _, q in runs) > 100
    assert [got[i] for i in range(len(texts))] == wanted


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def described(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    runs = brute_runs(words)
    lost = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in lost)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    shas = [hashlib.sha256(t.encode()).hexdigest() for t in (listed, kept)]
    return (len(runs), *best, milli, *shas)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(9)
    names = ["the", "of", "Über", "a b", "x\x1cy", " ", "and,", "l'été"]
    made = []
    for _ in range(160):
        words = [names[w % len(names)] + str(w // len(names) or "") for w in periodic_words(draw)]
        made.append(draw.choice(["", " ", "\n"]) + draw.choice([" ", "\t", " \r\n", "\x0b\x0c"]).join(words))
    return [*made, None, "", " \n\t ", "one", "ha " * 5000, " ".join(map(str, range(3000))) + " ha" * 13, made[0]]


def test_query_of_runs_equals_brute_force(spark, texts, tmp_path):
    rows = [(i, t, "x", 1, "c") for i, t in enumerate(texts)]
    rows += [rows[3]]
    schema = "doc_id long, text string, start string, n_runs int, period string"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    for row in found:
        if texts[row.doc_id] is None or len(texts[row.doc_id]) < 15000:
            assert tuple(row)[1:] == described(row.doc_id, texts[row.doc_id]), row.doc_id
    long_one = next(r for r in found if r.doc_id == len(texts) - 3)
    assert zlib.crc32(str(long_one.doc_id).encode()) % 10 and tuple(long_one)[1:6] == (1, 0, 5000, 1, 5000000)


def test_runs_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b " * 9), (1, None), (1, None)], "doc_id long, text string")
    rows = periodic_runs.periodic_runs(periodic_runs.with_planted_runs(docs)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_runs, r.length, r.collapsed) for r in rows] == [
        (None, 1, 18, b"a b"), (1, 0, None, b""), (1, 0, None, b"")]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def brute_audit(rows, labels):
    """Applies the filters one after the other, for every part and order."""
    good, toxic = ({d for d, *v in labels if v[i] == 1} for i in (0, 1))

    def failed(i):
        doc_id, text, _ = rows[i]
        text = text or ""
        words = WORD.findall(text)
        same = [d for d, t, _ in rows if (t or "") == text and d is not None]
        checks = (
            len(words) < 100,
            100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            re.search(r"[#$%&*|]", text) is not None,
            doc_id is not None and min(same) < doc_id,
        )
        return {"ABCDE"[k] for k, c in enumerate(checks) if c}

    fails = [failed(i) for i in range(len(rows))]
    out, shapley = {}, collections.Counter()
    for part in {lang or "" for _, _, lang in rows}:
        own = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [i for i in left if name in fails[i]]
                left = [i for i in left if name not in fails[i]]
                all_failing = sum(name in fails[i] for i in own)
                out[part, "".join(order), step] = [
                    len(left), len(gone), all_failing - len(gone), sum(fails[i] == {name} for i in own),
                    sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone)]
                shapley[part, name] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    draw = random.Random(4)
    rows = []
    for i in range(150):
        words = [draw.choice(["w", "W", "WW", "é"]) + str(draw.randrange(draw.choice([40, 900]))) for _ in range(draw.choice([60, 100, 180]))]
        text = draw.choice([" ", "\n\t"]).join(words) + draw.choice(["", "", " #", "|"])
        rows.append((i, text, draw.choice(["en", "de", None])))
    rows += [(i + 200, rows[draw.randrange(20)][1], draw.choice(["en", "de", "fr"])) for i in range(80)]
    rows += [rows[0], rows[0], (None, rows[0][1], "en"), (None, "x", "en"), (None, "x", None), (990, None, "fr"), (991, "", "fr")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(0, 260, 2)] + [(0, 1, 0), (0, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "e") for r in rows], "doc_id long, text string, lang string, mask int, good string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.filter_audit(docs.repartition(5), marks).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found}
    labelled = [(d, q, t) for d, q, t in labels if d is not None]
    assert len(found) == len(got) == 4 * 600
    assert got == brute_audit(rows, labelled)
    assert filter_audit.filter_audit(docs.limit(0), marks).count() == 0
