"""The training-data operators against brute force on small tables."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("plumbline.llm.queries")

from plumbline.llm import byte_bpe, decontamination, language, licenses, near_duplicates  # noqa: E402
from plumbline.llm import quality_classifier, quality_rules, suffix_tree, token_files  # noqa: E402
from plumbline.llm.common import scratch_path  # noqa: E402
from plumbline.llm.html_text import extract, visible_text  # noqa: E402

WORDS = "the of and alpha beta gamma delta omega Über naïve 12 x, y. l'été re-do ICH".split()


def made_texts(n: int, seed: int = 3) -> list:
    draw = random.Random(seed)
    texts = [" ".join(draw.choice(WORDS) + draw.choice(["", "", "\n"]) for _ in range(draw.randint(0, 70))) for _ in range(n)]
    return [*texts, None, "", " \t\n ", "one", texts[0], texts[0], "z" * 4000, "the of " * 600]


@pytest.fixture(scope="module")
def texts():
    return made_texts(40)


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Nulls, blanks, copies, long texts, a null doc_id, a repeated row and clashing columns."""
    rows = [(i, t, "en" if i % 2 else None, 1, "c") for i, t in enumerate(texts)]
    rows += [(None, "null id text", None, None, None), rows[0]]
    schema = "doc_id long, text string, lang string, n_words int, rule string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_bpe_equals_the_library(docs, texts, empty):
    import tiktoken

    path, pattern = byte_bpe.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = by_id(byte_bpe.encode_documents(docs))
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert rows[i].token_ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(docs).count() == docs.count()
    assert byte_bpe.encode_documents(empty).count() == 0


def test_bpe_joins_are_stable_for_any_cut():
    path, pattern = byte_bpe.default_vocabulary()
    monoid = byte_bpe.Monoid(byte_bpe.load_ranks(path))
    draw = random.Random(5)
    for _ in range(300):
        letters = draw.sample("abcdefghijklmnoprstuvwxyz éß", draw.randint(1, 5))
        data = "".join(draw.choice(letters) for _ in range(draw.randint(0, 120))).encode()
        whole = monoid.merge(data)
        at = draw.randint(0, len(data))
        assert monoid.join(monoid.merge(data[:at]), monoid.merge(data[at:])) == whole == monoid.encode(data)
        assert monoid._merge_long(data) == whole
        assert monoid.decode(np.array(whole, "<u4")) == data


def test_token_files(spark, docs, texts, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = scratch_path(spark, "test-tokens")
    token_files.write_tokens(docs, path, page_bytes=4096)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    order = [(None, "null id text"), (0, texts[0]), *enumerate(texts)]
    rows = sorted(token_files.digests(token_files.with_start(spark, path)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start))
    start = 0
    for (key, text), row in zip(order, rows, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (key, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    some = token_files.read_tokens(spark, path, ["n_tokens"], F.col("doc_id") >= 0)
    assert some.columns == ["n_tokens"] and some.count() == len(rows) - 1
    none = scratch_path(spark, "test-tokens")
    token_files.write_tokens(empty, none)
    assert token_files.digests(token_files.with_start(spark, none)).count() == 0


def test_token_ids_equal_the_library_with_its_default_flags():
    """Added tokens in texts, blanks of all kinds, and texts that share chunks."""
    import public_tokenizers as P
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    draw = random.Random(11)
    parts = [" ", "  ", " \u00a0", " \u3000x", "\n", " \x1c", "<|endoftext|>", "<|endoftext", "the", " of", "l'été", "12,", " Ü", "\x85", "\u2003 ", "\u200b "]
    texts = ["".join(draw.choices(parts, k=draw.randrange(30))) for _ in range(3000)]
    texts += ["<|endoftext|>", " <|endoftext|> ", "a<|endoftext|><|endoftext|>b", "", " ", "x " * 5000]
    offsets, ids = token_files.BatchEncoder(path)(pa.array(texts), 0)
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*library.encode(text, add_special_tokens=False).ids, 0], repr(text)
    assert list(token_files.parts_of(pa.array(["a" * (3 << 20)] * 3 + ["b"]))) == [(0, 1), (1, 2), (2, 4)]
    assert list(token_files.parts_of(pa.array([], pa.string()))) == []


def test_a_run_of_letters_is_kept_once():
    from plumbline.llm.chunks import TextEncoder

    asked = []

    def piece(text):
        asked.append(text)
        return text.encode() + b"|"

    encode = TextEncoder(lambda chunk: [chunk], piece)
    assert encode("Oh ab. ab, ab a1 ab. a1") == b"Oh| ab|.| ab|,| ab| a1| ab|.| a1|"
    assert asked == ["Oh", " ab", ".", ",", " a1"]
    assert sorted(encode.rest) == ["a1", "ab", "ab,", "ab."] and " ab" not in encode.rest.pieces


def test_token_file_encoding(spark, docs):
    import glob

    import pyarrow.parquet as pq

    path = scratch_path(spark, "test-tokens")
    token_files.write_tokens(docs, path)
    part = next(f for f in glob.glob(f"{path}/part-*") if pq.ParquetFile(f).metadata.num_rows)
    column = pq.ParquetFile(part).metadata.row_group(0).column(4)
    assert "DELTA_BINARY_PACKED" in column.encodings and not column.has_dictionary_page


def brute_components(ids, texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set()))
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, sets):
            for j, b in zip(ids, sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return {i: (len(s), label[i]) for i, s in zip(ids, sets)}


def test_near_duplicates_equal_brute_force(spark, empty):
    draw = random.Random(9)
    base = [draw.choice(WORDS) + str(draw.randint(0, 99)) for _ in range(80)]
    texts = made_texts(20)
    for _ in range(60):  # a chain of edits around the limit
        copy = list(base)
        for _ in range(draw.randint(0, 4)):
            copy[draw.randrange(80)] = str(draw.random())
        texts.append(" ".join(copy))
    rows = [(i, t, 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, texts[-1], 0)], "doc_id long, text string, component int").repartition(4)
    want = brute_components(range(len(texts)), texts)
    found = by_id(near_duplicates.near_duplicates(docs))
    assert found.pop(None).component_id is None
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in found.items())
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_large_groups_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_MEMBERS", 8)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base[:k % 60], f"edit{k}", *base[k % 60 + 1 :]])) for k in range(50)]
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0} and sum(r.kept for r in found) == 1


def test_estimate_is_corrected_for_chance():
    from plumbline.llm.shingles import minima, mix, packed_bits

    x = mix(np.arange(4000, dtype=np.uint64))
    for a, b in ((0, 1.0), (1000, 0.6), (4000, 0.0)):
        y = np.concatenate([x[a:], mix(np.arange(9000, 9000 + a, dtype=np.uint64))])
        got = near_duplicates.estimate(*(packed_bits(minima(v)).view(np.uint64)[None, :] for v in (x, y)))
        assert abs(got[0, 0] - b) < 0.2


def test_suffix_tree(spark, docs, texts, empty):
    found = [r for r in suffix_tree.score_documents(docs, p_min=0.002).collect()]
    rows = [*enumerate(texts), (None, "null id text"), (0, texts[0])]
    counts, tokens = collections.Counter(), 0
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), None]
        if zlib.crc32((str(i) if i is not None else "").encode()) % 5 != 1:
            counts.update(words)
            tokens += len(words)
    base = {}
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), None]
        logs = sum(np.log10((counts[w] + 0.5) / (tokens + 0.5 * (len(counts) + 1))) for w in words)
        base[i] = (len(words), sum(counts[w] > 0 for w in words), logs)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_tokens, r.n_known) == base[r.doc_id][:2] and r.train_tokens == tokens
        assert r.base_score == pytest.approx(base[r.doc_id][2])
    assert sum(r.score for r in found) > sum(r.base_score for r in found)
    assert suffix_tree.score_documents(empty).count() == 0


def test_suffix_tree_distributions_sum_to_one(spark, docs):
    training = suffix_tree._texts(docs).select("text")
    model = suffix_tree.learn(training, p_min=0.001)
    tree = model.tree
    assert len(tree.contexts[0])
    counts = {bytes(r.word): r.c for r in model.counts.collect()}
    rare = sum(c + 0.5 for w, c in counts.items() if w not in tree.ids) + 0.5
    rare /= model.tokens + 0.5 * (model.distinct + 1)
    after = np.array([suffix_tree.END, *range(suffix_tree.FIRST, tree.width)])
    for k, context in enumerate(tree.contexts[0].tolist()):
        gain = tree.lengthen(1, np.full(len(after), context), after, np.zeros(len(after)))
        assert (10 ** (gain + tree.base[after])).sum() + rare * 10 ** tree.default[0][k] == pytest.approx(1)


def test_language_sums_all_segmentations():
    vocabulary = language.load(language.default_vocabulary())
    chance = np.random.default_rng(0).random((vocabulary.width, 3)) * 1e-3

    def total(text, column):
        if not text:
            return 1.0
        out = 0.0
        for k in range(1, min(len(text), language.LONGEST_PIECE) + 1):
            piece = vocabulary.pieces.get(text[:k], vocabulary.unknown if k == 1 else None)
            out += chance[piece, column] * total(text[k:], column) if piece is not None else 0.0
        return out

    words = ["the", "therein", "日本", "über", "", "xqz", "station"]
    got = language.log_chances(words, vocabulary, chance)
    for word, row in zip(words, got):
        assert np.exp(row) == pytest.approx([total(language.SPACE + word, c) for c in range(3)])
    assert np.isfinite(language.log_chances(["ab" * 5000], vocabulary, chance)).all()


def test_language_prediction(spark, empty):
    german, english = "der die und das nicht mit auf von", "the and of that with from this was"
    rows = [(i, (german if i % 2 else english) + f" {i}", "de" if i % 2 else "en") for i in range(40)]
    rows += [(90, None, "de"), (91, "12 34 !!", None), (92, "und die der", None), (None, "of the", "en")]
    found = by_id(language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(found[i].lang_pred == ("de" if i % 2 else "en") for i in range(40))
    assert found[90].lang_pred == found[91].lang_pred == "und" and found[90].score == 0
    assert found[92].lang_pred == "de" and found[None].lang_pred == "en"
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items() if i is not None)
    assert language.identify(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.identify(unlabelled).first().lang_pred == "und"


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, docs, texts, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = by_id(quality_rules.quality_rules(docs, labels))
    for i, t in enumerate(texts):
        want = brute_statistics(t)
        assert tuple(rows[i][c] for c in quality_rules.BASE) == want
        assert rows[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert rows[i].kept == (not rows[i].base_failed)  # nothing was learned
    assert rows[3].doc.n_words == 1 and set(rows[3].doc.asDict()) == set(docs.columns)
    assert quality_rules.quality_rules(empty, labels).count() == 0


def test_learned_rules_separate(spark):
    draw = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = [f"w{draw.randint(0, 4000)}" + ("%%%" if bad and draw.random() < 0.6 else "") for _ in range(90)]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    rules = quality_rules.learn(docs, marks)
    assert rules.rules and any(c.measure == "symbols_per_word" for r in rules.rules for c in r)
    for r in quality_rules.judge(docs, rules).collect():
        assert r.kept == (r.doc_id % 5 != 0)
        first = 0  # the ordered list, read by hand
        values = {m: eval(e, {"__builtins__": {}}, r.asDict()) for m, e in quality_rules.MEASURES.items()}
        for k, rule in enumerate(rules.rules, 1):
            if all((values[c.measure] > c.limit) == c.above for c in rule):
                first = k
                break
        assert r.rule == (0 if r.base_failed else first)


def test_classifier(spark, docs, empty):
    draw = random.Random(4)
    pool = "the and of to in that alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo".split() * 4 + [f"word{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = [draw.choice(pool) for _ in range(120)]
        if i % 6 == 0:
            words = [w.upper() + "%%!!" for w in words] if i % 12 else words[:3] * 40
        rows.append((i, " ".join(words)))
    found = by_id(quality_classifier.classify(spark.createDataFrame(rows, "doc_id long, text string")).select("doc.doc_id", "score", "weak", "kept"))
    assert sum(r.kept == (i % 6 != 0) for i, r in found.items()) >= 396
    assert all(r.kept for i, r in found.items() if i % 6)
    assert quality_classifier.classify(docs).count() == docs.count()
    assert quality_classifier.classify(docs).select("doc.*").columns == docs.columns
    assert quality_classifier.classify(empty).count() == 0


def test_em_recovers_accuracies():
    draw = np.random.default_rng(1)
    n, good = 40_000, 0.7
    truth = draw.random(n) < good
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.88, 0.92])
    votes = np.where(draw.random((n, 8)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[draw.random((n, 8)) < 0.3] = quality_classifier.SILENT
    codes, counts = np.unique(votes @ 3 ** np.arange(7, -1, -1), return_counts=True)
    model = quality_classifier.fit_labellers(codes, counts.astype(float))
    assert model.good == pytest.approx(good, abs=0.02)
    assert list(model.accuracy().values()) == pytest.approx(list(right), abs=0.03)


def brute_windows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return words


def test_decontamination(spark, docs, texts, empty):
    items = [(1, texts[2]), (2, "alpha beta"), (10, texts[5]), (10, texts[6]), (3, None), (4, "?!"), (5, "one"), (None, "omega"), (6, " ".join(["the of"] * 20))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = by_id(decontamination.decontaminate(docs, benchmark))
    for i, t in enumerate(texts):
        words, hit, hits = brute_windows(t), set(), set()
        for item, text in items:
            other = brute_windows(text)
            m = min(10, len(other))
            windows = {tuple(other[k : k + m]) for k in range(len(other) - m + 1)} if m and item is not None else ()
            for k in range(len(words) - m + 1 if m else 0):
                if tuple(words[k : k + m]) in windows:
                    hits.add(str(item))
                    hit.update(range(k, k + m))
        r = found[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(hits), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(hits)).encode()).hexdigest()
    assert decontamination.decontaminate(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontamination.decontaminate(docs, benchmark).count() == docs.count()
    assert decontamination.decontaminate(empty, benchmark).count() == 0


def test_decontamination_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "STEP", 3)
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    rows = [(1, "a Alpha b")] * 7 + [(1, "b")] * 4 + [(None, "alpha")] * 3 + [(None, None)] * 2 + [(2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([("x", "alpha")], "item_id string, text string")
    found = decontamination.decontaminate(docs, benchmark).select("doc_id", "n_words", "n_hit", "contaminated").collect()
    want = [(1, 3, 1, True)] * 7 + [(1, 1, 0, False)] * 4 + [(None, 1, 1, True)] * 3 + [(None, 0, 0, False)] * 2 + [(2, 0, 0, False)]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_licenses(spark, docs, texts, empty):
    notices = {"a": "alpha beta gamma", "b": "the of the of the", "mit": licenses.NOTICES["MIT"], "one": "word"}
    rows = [(1, "x y\nReleased under  the MIT-License!\n"), (2, "released under the MIT licence"), (3, None), (4, "alpha beta gamma"), (4, "alpha beta gamma")]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.unit, r.license, round(r.dice, 6)) for r in licenses.scan(extra, notices, 0.7).collect())

    def pairs(text):
        w = brute_windows(text)
        return set(zip(w, w[1:]))

    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        for unit, part in enumerate([t or "", *lines] if len(lines) > 1 else [None, *lines]):
            for name, notice in notices.items():
                p, q = pairs(part), pairs(notice)
                if p and q and (d := 2 * len(p & q) / (len(p) + len(q))) >= 0.7:
                    want.append((i, unit, name, round(d, 6)))
    assert found == sorted(want) and len(found) >= 4
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(docs).count() == 0


PAGE = """<title>no</title><h1>Head  line</h1><p>One <b>two</b><p>three<br>four<div>five<span hidden>no</span> six</div>
<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c<p>more</ul><pre> keep
   this</pre><table><tr><th>Name<th>Value<tr><td>alpha<td>1<tr><td rowspan=2>r<td>22<tr><td>333</table>
<div style="display: none">zz</div>tail &amp; end<script>var a="</p>"</script>"""


def test_html_layout():
    assert visible_text(PAGE).split("\n") == [
        "Head line", "", "One two", "", "three", "four", "", "five six", "", "- a", "- b", "  3. x", "  4. y", "- c", "",
        "  more", "", " keep", "   this", "", "Name  | Value", "alpha | 1", "r     | 22", "        333", "", "tail & end",
    ]
    assert visible_text("<div>" * 5000 + "x" + "<b>" * 500 + "y").replace("\n", "") == "xy"
    assert visible_text(None) == visible_text("") == visible_text("<p>") == ""


def test_html_table(spark):
    rows = [(1, PAGE, 5), (2, None, 6), (2, None, 6), (None, "a<br>b", 7)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text int")
    found = extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_lines) for r in found) == [(0, 2), (1, 26), (2, 0), (2, 0)]
    assert extract(pages.limit(0)).count() == 0


def test_suffix_tree_small_counts_and_long_contexts(spark):
    phrase = "one two three four five six".split()
    draw = random.Random(5)
    noise = [" ".join(f"w{draw.randrange(3000)}" for _ in range(200)) for _ in range(150)]
    # after "b c d" comes y if "a" came before, else z; no shorter context tells them apart
    telling = ["a b c d y" if i % 2 else "e b c d z" for i in range(60)]
    few = [" ".join(phrase)] * 9
    docs = spark.createDataFrame(list(enumerate(noise + telling + few)), "doc_id long, text string").repartition(3)
    training = suffix_tree._texts(docs).select("text")
    large = spark.createDataFrame([(" ".join(f"w{draw.randrange(3000)}" for _ in range(2000)).encode(),) for _ in range(150)], "text binary")
    keys = suffix_tree._Keys()

    def run(words):
        out = 0
        for w in words.split():
            out = suffix_tree._signed(out * suffix_tree.FACTOR + keys[w.encode()])
        return out

    model = suffix_tree.learn(training)
    assert not model.unfinished
    kept = [{r.key for r in level.where("kept AND listed").collect()} for level in model.levels]
    assert {run("a b c d y"), run("e b c d z")} <= kept[3]
    # nine occurrences stay in a corpus ten times as large
    grown = suffix_tree.learn(training.union(large))
    assert all(run("five six") in {r.key for r in m.levels[0].where("kept AND listed").collect()} for m in (model, grown))
    scores = by_id(suffix_tree.score(suffix_tree._texts(docs), model))
    for r in scores.values():
        assert r.score <= 1e-9
    # every value by join gives the same scores
    near, suffix_tree.HOT = suffix_tree.HOT, 2.0
    try:
        far = by_id(suffix_tree.score(suffix_tree._texts(docs), model))
    finally:
        suffix_tree.HOT = near
    assert {i: r.n_known for i, r in far.items()} == {i: r.n_known for i, r in scores.items()}
    assert [far[i].score for i in sorted(far)] == pytest.approx([scores[i].score for i in sorted(scores)])


def test_html_omitted_head_and_body_tags():
    for body in ("<p>Hello <b>you</b>", "Hello <b>you</b>", "</head><p>Hello <b>you</b>", "<body>Hello <b>you</b>"):
        page = f"<html><head><meta charset=utf-8>\n<title>t</title><style>p {{}}</style>\n{body}"
        assert visible_text(page) == "Hello you"
    assert visible_text("<head><noscript><link></noscript><template><p>no</template><script>1</script><p>yes") == "yes"
    assert visible_text("<head><noscript><p>x</noscript></head><p>yes") == "yes"


def test_html_table_omitted_tags_and_stray_text():
    rows = ["a | b", "c | d"]
    for inside in (
        "<colgroup><col><col><tr><td>a<td>b<tr><td>c<td>d",
        "<colgroup><col>\n<tbody><td>a<td>b<tr><td>c<td>d",
        "<thead><td>a<td>b<tbody><td>c<td>d",
        "<tr><td>a<td>b<tbody><tr><td>c<td>d",
        "<td>a<td>b<tr><td>c<td>d",
    ):
        assert visible_text(f"<table>{inside}</table>").split("\n") == rows
    assert visible_text("<table><caption>cap<tr><td>a<td>b<tr><td>c<td>d</table>").split("\n") == ["cap", *rows]
    stray = "<table><tr>one <b>two</b><td>a<td>b</tr><tbody>three<tr><td>c<td>d</tr></tbody></table>after"
    assert visible_text(stray).split("\n") == ["one twothree", *rows, "", "after"]
    nested = "<table><tr><td>x<table><tr><td>in</table>y<td>z</table>"
    assert [w for w in visible_text(nested).split() if w != "|"] == ["x", "z", "in", "y"]
    assert visible_text("<table><colgroup>lost<tr><td>a</table>").split("\n") == ["lost", "a"]


ODD_NAMES = ["quality", "key", "a.b", "my col", "doc", "s", "b`t", "id", "tk", "kept"]


def odd_documents(spark):
    draw = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        words = draw.choices(vocabulary if i % 3 else vocabulary[:4], k=120)
        rows.append((i, " ".join(words), *[f"{n}{i}" for n in ODD_NAMES]))
    fields = ", ".join("`" + n.replace("`", "``") + "` string" for n in ODD_NAMES)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "x") for i in range(60)], "doc_id long, quality int, text string")
    return spark.createDataFrame(rows, f"doc_id long, text string, {fields}"), labels


def test_rules_and_classifier_keep_odd_columns(spark):
    docs, labels = odd_documents(spark)
    rules = quality_rules.quality_rules(docs, labels)
    assert rules.where("kept").select("doc.*").columns == docs.columns
    want = {r.doc_id: tuple(r) for r in docs.collect()}
    for row in rules.select("doc.*").collect():
        assert tuple(row) == want[row.doc_id]
    judged = quality_classifier.classify(docs)
    assert judged.select("doc.*").columns == docs.columns
    assert sorted(tuple(r) for r in judged.select("doc.*").collect()) == sorted(want.values())
    plain = quality_rules.quality_rules(docs.select("doc_id", "text"), labels).select("doc_id", "kept", "rule")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, rules.select("doc_id", "kept", "rule").collect()))


def test_repeated_rows_are_compared_once(spark, monkeypatch):
    """Thousands of equal rows of near copies meet in a unit once per class; other texts of a doc_id too."""
    draw = random.Random(4)
    base = [f"w{draw.randrange(900)}" for _ in range(300)]
    near = [*base[:298], "x", "y"]
    rows = [(1, " ".join(base))] * 1500 + [(2, " ".join(near))] * 1500 + [(2, "quite another text of five words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    signed = near_duplicates.signatures(docs).where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "keys", "bits")])
    classes = near_duplicates.stored(signed, "test-classes")
    groups = near_duplicates.components(near_duplicates.candidate_ties(classes), "test-groups")
    found = near_duplicates.confirmed_links(docs, classes.drop("keys"), groups)
    assert [tuple(r) for r in found.collect()] == [(1, 2)]
    result = near_duplicates.near_duplicates(docs).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, result)) == [(1, 1, 1500), (2, 1, 1501)]
