"""Divergence of sources, language-model scores and spelling variants, against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from wardline.llm import divergence, maxent, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, value long, word string"
WORDS = "alpha beta gamma Delta épsilon zeta-eta iota1 kappa' LAMBDA mü nu".split()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def groups(spark):
    """Documents of several languages and sources: null and empty fields, repeated rows, ties, a group without terms."""
    rng = random.Random(4)
    rows = []
    for i in range(160):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", "c", None])
        text = " ".join(rng.choice(WORDS[: 3 + i % 9]) for _ in range(rng.randrange(0, 30)))
        rows.append((i if i % 17 else None, rng.choice([text, text, text, None, "", "12 34"]), lang, source))
    rows += [rows[3], rows[3], (900, "only once", "xx", "s"), (901, None, "xx", "t"), (902, "1 2", "yy", "s")]
    frame = spark.createDataFrame([(*r, 1, "z", 2, "w") for r in rows], SCHEMA)
    return rows, frame.repartition(3)


def brute_divergence(rows, top):
    counts, docs, seen = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        seen.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in seen}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        sources = sorted(g[1] for g in seen if g[0] == lang)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top])):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("cells, rare", [(1 << 22, 8), (4, 8), (1 << 22, 1)])
def test_divergence_matches_brute_force(groups, monkeypatch, cells, rare):
    monkeypatch.setattr(divergence, "_CELLS", cells)
    monkeypatch.setattr(divergence, "RARE", rare)
    rows, frame = groups
    for top in (200, 3):
        found = divergence.audit(frame, top=top)
        assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, found.collect())) == brute_divergence(rows, top)


def test_divergence_of_nothing(groups):
    assert divergence.audit(groups[1].limit(0)).collect() == []


def test_terms_do_not_depend_on_blocks_and_shares_are_exact(monkeypatch):
    text = ("Éa b1c D_d " * 50).encode()
    whole = Counter(t for part in divergence.text_terms(text) for t in part if t)
    monkeypatch.setattr(divergence, "_BLOCK", 7)
    assert Counter(t for part in divergence.text_terms(text) for t in part if t) == whole
    big = np.array([10**15, 3], np.int64)
    assert divergence.shares(big, 10**16, 7).tolist() == [1 + 10**9 * (c + 1) // (10**16 + 7) for c in big.tolist()]


def test_slices_are_cut_within_a_batch_of_rows():
    builder = divergence._Builder(1)
    terms = [f"t{i:04}" for i in range(3000)]
    out = []
    for at in range(0, 3000, 700):
        part = terms[at : at + 700]
        n = np.ones(len(part), np.int64)
        out += builder.add("en", pa.array(part), ["s"] * len(part), n, n, np.arange(len(part)))
    out += builder.flush()
    assert sorted(t for row in out for t in row["terms"]) == terms
    assert max(len(row["terms"]) for row in out) <= divergence.FEW
    assert sum(sum(row["sizes"]) for row in out) == 3000


@pytest.fixture(scope="module")
def sentences(spark):
    """Sentences in which the next word follows from the one before, with words seen once."""
    rng = random.Random(8)
    rows = []
    for i in range(400):
        at, words = rng.randrange(20), []
        for _ in range(rng.randrange(0, 60)):
            words.append(f"w{at}" + ("." if rng.random() < 0.1 else "") if rng.random() < 0.9 else f"rare{rng.randrange(10**6)}é")
            at = (at * 3 + rng.choice([1, 1, 1, 2])) % 20
        rows.append((i, " ".join(words).upper() if i % 5 else " ".join(words) + "\n"))
    rows += [(400, None), (401, ""), (None, "w1 w2"), (None, "w1 w2"), (7, "w1"), (403, " \t\x0b")]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, "z", 2, "w") for i, t in rows], SCHEMA)
    return rows, frame.repartition(3)


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute_base(rows):
    tokens = lambda text: [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), ""]
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        of = tokens(text)
        out.append((i is not None, i or 0, held(i), len(of), sum(counts[t] > 0 for t in of), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in of), 6)))
    return sorted(out)


def test_base_scores_match_brute_force_and_the_model_is_better(sentences):
    rows, frame = sentences
    found = maxent.score(frame).collect()
    assert found[0].__fields__ == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert sorted((r[0] is not None, r[0] or 0, *r[1:5], round(r[5], 6)) for r in found) == brute_base(rows)
    test = [r for r in found if r.held_out]
    per_token = lambda name: sum(r[name] for r in test) / sum(r.n_tokens for r in test)
    assert per_token("score") > per_token("base_score") + 0.5
    assert all(r.score <= 1e-6 for r in found)


def test_long_texts_go_on_in_the_next_chunk(sentences, monkeypatch):
    rows, frame = sentences
    parts = maxent.chunks(frame, "doc_id", "text", size=16)
    sizes = [n - lead for r in parts.collect() for n, lead in zip(r["size"], r["lead"])]
    assert max(sizes) <= 16 + 2 and sum(sizes) == sum(r[3] for r in brute_base(rows))
    monkeypatch.setattr(maxent, "_BLOCK", 5)
    text = b"Ab  cde\x0bf " * 9 + b"x" * 40 + b" y"
    assert [w for part in maxent.text_tokens(text) for w in part] == [*text.lower().split(), b""]


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(2)
    head = [(b"w%d" % i, 5000 - i) for i in range(maxent.WIDTH * maxent.HEAD_CLASSES)]
    bounds = maxent.bin_bounds(3000)
    counts = np.concatenate([rng.integers(1, 9, 300), rng.integers(9, 3000, 40)])
    shape = rng.integers(0, maxent.SHAPES, len(counts))
    mass = np.zeros(maxent.BINS * maxent.SHAPES)
    np.add.at(mass, (np.searchsorted(bounds, counts, side="right") - 1) * maxent.SHAPES + shape, counts)
    model = maxent.Model(10**6, 1364, head, bounds, mass, np.append(mass, 100.0))
    for weights in model.weights:
        weights[:] = rng.normal(0, 1, weights.shape)
    features = model.features(np.array([7, 8, 9], np.uint32), np.arange(3))
    first = np.exp(model.logs(0, model.prior, model.rows(features)))
    codes = model.codes(counts, np.full(len(counts), -1), shape)
    for at in range(3):
        total = first[at, maxent.UNSEEN] + (first[at, codes] * np.exp(model.in_tail(counts, shape))).sum()
        for c in range(maxent.HEAD_CLASSES):
            inside = np.exp(model.logs(1, model.inside[np.full(3, c)], model.rows(features, np.full(3, c))))
            total += first[at, c] * inside[at].sum()
        assert abs(total - 1) < 1e-4


def planted(rng, words=400):
    """A model with trees over words of few slots and many counts, and those words as columns of a chunk."""
    head = [(b"w%d" % i, 5000 - i) for i in range(maxent.WIDTH * maxent.HEAD_CLASSES)]
    counts = np.sort(np.concatenate([rng.integers(1, 9, words - 40), rng.integers(9, 3000, 40)]))
    shape, names = rng.integers(0, maxent.SHAPES, words), (rng.integers(0, 1 << 20, words) * maxent.SLOTS + rng.integers(0, 60, words)).astype(np.uint32)
    bounds = maxent.bin_bounds(3000)
    kind = (np.searchsorted(bounds, counts, side="right") - 1) * maxent.SHAPES + shape
    held, tokens = np.zeros((maxent.BINS * maxent.SHAPES, maxent.SLOTS)), np.zeros((maxent.BINS * maxent.SHAPES, maxent.SLOTS))
    np.add.at(held, (kind, names % maxent.SLOTS), 1)
    np.add.at(tokens, (kind, names % maxent.SLOTS), counts)
    met: Counter = Counter()
    ranks = np.zeros(words, np.int32)
    for i, key in enumerate(zip(names % maxent.SLOTS, shape)):
        ranks[i], met[key] = met[key], met[key] + 1
    model = maxent.Model(10**6, 1364, head, bounds, tokens.sum(1), np.append(tokens.sum(1), 100.0))
    model.plant(held, tokens, dict(Counter(zip(counts.tolist(), shape.tolist()))))
    return model, kind, (counts, shape, np.full(words, -1), names, ranks)


def test_words_of_a_class_add_up_to_one_in_every_context():
    rng = np.random.default_rng(5)
    model, kind, words = planted(rng)
    paths = model.paths(*words)
    ids = np.arange(len(kind))

    def chances(features):
        of, side, _, odds = model.steps(paths, ids, np.repeat(features[:, None], len(ids), 1))
        return np.exp(-np.bincount(of, np.logaddexp(0, np.where(side, -odds, odds)), len(ids)))

    contexts = model.features(np.array([7, 8, 9], np.uint32), np.arange(3)).T
    flat = [chances(f) for f in contexts]
    share = np.exp(model.in_tail(words[0], words[1]))
    assert np.array_equal(flat[0], flat[1]) and abs(np.log(flat[0] / share)).max() < 0.8
    assert np.allclose(flat[0][words[0] == 1], share[words[0] == 1], rtol=1e-4)
    model.weights[2][:] = rng.normal(0, 1, model.weights[2].shape)
    for at in contexts:
        p = chances(at)
        assert np.allclose(np.bincount(kind, p)[np.unique(kind)], 1, atol=1e-4) and abs(np.log(p / flat[0])).max() > 1


def test_rare_words_are_learnt_from_what_stands_before(spark):
    """Forty rare words, each after its own frequent word: the one before tells which of the class it is."""
    rng = random.Random(9)
    pairs = [(f"a{i}", f"pair{i}") for i in range(40)]
    rows = []
    for i in range(1400):
        rows.append((i, " ".join(f"{a} {b}" if rng.random() < 0.5 else a for a, b in rng.sample(pairs, 10)), "en", "s", 1, "z", 2, "w"))
    rows += [(i, " ".join(f"fill{k}" for k in range(300)), "en", "s", 1, "z", 2, "w") for i in range(1400, 3000)]
    asked = iter(i for i in range(5000, 9000) if held(i))
    own, other = ([(next(asked), f"a{i} pair{(i + k) % 40}", "en", "s", 1, "z", 2, "w") for i in range(40)] for k in (0, 1))
    found = maxent.score(spark.createDataFrame(rows + own + other, SCHEMA).coalesce(2)).filter("doc_id >= 5000").collect()
    mean = lambda part: sum(r.score for r in found if r.doc_id in {x[0] for x in part}) / 40
    assert mean(own) > mean(other) + 0.7


def test_numbers_of_words_do_not_depend_on_the_order_of_rows(monkeypatch):
    words = [b"b", b"a", b"\xc3\xa9", b"x", b"a", b"b", b"none"]
    table = pa.table({
        "chunk": pa.array([1, 1, 1, 2, 2, 3, 3], pa.int64()), "place": pa.array([0, 1, 2, 0, 1, 0, 1], pa.int32()), "words": pa.array(words, pa.binary()),
        "n": pa.array([1, 1, 4, 5, 1, 1, 0], pa.int64()), "slot": pa.array([6] * 7, pa.int32()),
    })

    def numbers(t):
        out = [r for b in maxent.number(iter(t.to_batches(max_chunksize=2))) for r in b.to_pylist()]
        return {r["chunk"]: maxent.open_block(r["block"]).tolist() for r in out if r["block"]}, [r for r in out if not r["block"]]

    blocks, rest = numbers(table)
    assert blocks == {1: [[0, 1, 2], [2, 2, 4], [0, 1, 0]], 2: [[0, 1], [5, 2], [2, 1]], 3: [[0, 1], [2, 0], [0, 0]]}
    assert [(r["word"], r["count"]) for r in rest if r["word"]] == [(b"x", 5), (b"\xc3\xa9", 4), (b"a", 2), (b"b", 2)]
    assert sorted((r["slot"], r["shape"], r["count"], r["words"]) for r in rest if r["words"]) == [(6, 0, 2, 2), (6, 0, 5, 1), (6, 1, 4, 1)]
    again = numbers(table.take([6, 4, 2, 0, 1, 3, 5]))
    assert again == (blocks, rest)
    assert list(maxent.number(iter([]))) == []


def test_learning_lowers_the_loss():
    rng = np.random.default_rng(3)
    model = maxent.Model(100, 64, [(b"%d" % i, 10) for i in range(maxent.WIDTH * maxent.HEAD_CLASSES)], maxent.bin_bounds(10), np.zeros(maxent.BINS * maxent.SHAPES), np.zeros(maxent.BINS * maxent.SHAPES + 1))
    names = rng.integers(0, 30, 4000).astype(np.uint32)
    features = model.features(names, np.arange(4000))
    target, rows, count = (names % maxent.HEAD_CLASSES).astype(np.int64), model.rows(features), np.zeros(maxent.ROWS, np.float32)
    target[1:] = target[:-1].copy()
    loss = lambda: -model.logs(0, model.prior, rows)[np.arange(4000), target].mean()
    before = loss()
    for _ in range(5):
        model.learn(0, model.prior, rows, target, count)
    assert loss() < 0.5 * before and count.sum() == 5 * 3 * 4000


def test_scores_without_training_documents_and_of_nothing(spark, sentences):
    only = next(i for i in range(1000) if held(i))
    rows = maxent.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in rows] == [(only, True, 3, 0, 0, 0.0, 0.0)]
    assert maxent.score(sentences[1].limit(0)).collect() == []


@pytest.fixture(scope="module")
def spelled(spark):
    """Frequent words with rare variants, chains of forms, ties, short runs, and letters beyond ASCII."""
    rng = random.Random(6)
    often = ["scaffolding", "maintenance", "permission", "überprüfung", "ÿyyyyyyy", "aaaaaaaa", "aaaaaaab"]
    letters = "abcdefghijklmnopqrstuvwxyzàéüÿ×"
    out = []
    for word in often:
        out += [word] * rng.choice([300, 40])
        for _ in range(40):
            at = rng.randrange(len(word))
            out += [rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])] * rng.choice([1, 2, 3, 4])
    out += ["chained"] * 2000 + ["chainedx"] * 100 + ["chainedxy"] * 6 + ["abcdef"] * 9
    rng.shuffle(out)
    rows = [(i if i % 9 else None, rng.choice([" ", "\n", "1", "_"]).join(out[i * 12 : i * 12 + 12])) for i in range(len(out) // 12 + 1)]
    rows += [(1000, None), (1001, ""), (1002, "MAINTENANCE Maintenance Überprüfung"), rows[2], rows[2]]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, "z", 2, "w") for i, t in rows], SCHEMA)
    return rows, frame.repartition(3)


def brute_words(rows):
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def edits(word, letters):
    for at in range(len(word) + 1):
        yield word[:at] + word[at + 1 :]
        for x in letters:
            yield word[:at] + x + word[at:]
            yield word[:at] + x + word[at + 1 :]


def brute_variants(rows):
    words = brute_words(rows)
    letters = list(map(chr, spelling.LETTERS))
    near = {w: {x for x in edits(w, letters) if x in words and x != w} for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w] or "", root, n, len(near[w]), words.get(form[w], 0)))
    return sorted(out)


@pytest.mark.parametrize("symbols", [None, 2, 26])
def test_variants_match_brute_force(spelled, symbols):
    rows, frame = spelled
    found = spelling.group_variants(frame, symbols=symbols)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted((r[0], r[1] or "", *r[2:5], r[5] or 0) for r in found.collect())
    assert got == brute_variants(rows)
    roots = {r[0]: r[2] for r in got}
    assert roots["chainedxy"] == roots["chainedx"] == "chained"


def test_variants_of_nothing(spelled):
    assert spelling.group_variants(spelled[1].limit(0)).collect() == []


def test_neighbourhoods_of_reduced_words_are_full():
    rng = random.Random(9)
    symbols = 3
    words = sorted({"".join(rng.choice("ABC") for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    texts = spelling._Texts(pa.array(words))
    own = {h: w for w, h in zip(words, texts.own()[1].tolist())}
    row, names = texts.neighbours(symbols)
    met = {tuple(sorted((words[r], own[h]))) for r, h in zip(row.tolist(), names.tolist()) if h in own}
    want = {tuple(sorted((w, x))) for w in words for x in [w, *edits(w, "ABC")] if x in own.values()}
    assert met == want


def test_runs_do_not_depend_on_blocks(monkeypatch):
    text = "scaffold x" * 30 + "überprüfung" * 9 + " a"
    whole = [r for part in spelling.runs(text) for r in part]
    monkeypatch.setattr(spelling, "_BLOCK", 4)
    assert [r for part in spelling.runs(text) for r in part] == whole


def test_every_training_token_is_learnt_from():
    """A word seen three times where no word is seen twice: without the token itself its class holds no word."""
    bounds = maxent.bin_bounds(9)
    mass, drop = np.zeros(maxent.BINS * maxent.SHAPES), np.zeros(maxent.BINS * maxent.SHAPES + 1)
    at = (np.searchsorted(bounds, 3, side="right") - 1) * maxent.SHAPES
    mass[at] = drop[at] = 3
    model = maxent.Model(3, 1, [], bounds, mass, drop)
    packed = zstandard.ZstdCompressor().compress(np.zeros(3, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())
    row = {
        "tokens": packed, "size": [3], "lead": [0], "train": [True], "counts": np.array([3], np.int64).tobytes(),
        "names": np.array([7], np.uint32).tobytes(), "heads": np.array([-1], np.int32).tobytes(), "shapes": np.array([0], np.int8).tobytes(),
    }
    met = [np.zeros(maxent.ROWS, np.float32) for _ in range(2)]
    maxent.train_chunk(model, row, met)
    assert met[0].sum() == 3 * maxent.TEMPLATES
