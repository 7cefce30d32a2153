"""Languages, tokens, packing and benchmark tiles."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardline.llm import language, packing, tiling, tokens

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    profiles = language.fit_profiles(docs.filter(~language.held_out()))
    found = language.predict(docs.filter(language.held_out()), profiles, keep=("lang",))
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert found.filter("score < 0 or score > 1").isEmpty()


def test_languages_of_odd_texts(spark, docs, none, texts):
    taught = spark.createDataFrame([("en", "the cat and the dog"), ("fr", "le chat et le chien"), (None, "x"), ("de", None)], "lang string, text string")
    profiles = language.fit_profiles(taught.withColumn("doc_id", F.lit(1)))
    assert sorted(profiles) == ["en", "fr"]
    got = {r.doc_id: r for r in language.predict(docs, profiles).collect()}
    for i, text in enumerate(texts):
        letters = any(c.isalpha() for c in text or "")
        assert (got[i].lang_pred == "und") == (not letters) and 0 <= got[i].score <= 1
    assert language.predict(none, profiles).collect() == [] and language.fit_profiles(none) == {}
    assert {r.lang_pred for r in language.predict(docs, {}).collect()} == {"und"}


@pytest.mark.parametrize("block", [1, 2, 3, 97])
@pytest.mark.parametrize("text", ["Der Hund läuft; the dog runs 12 km, l'été ... " * 50, "  ...  ", ". ΟΔΟΣ ΣΑΣ\n", "a", "12 a  b" * 9])
def test_grams_do_not_depend_on_blocks(monkeypatch, block, text):
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "BLOCK", block)
    keys, counts = language.gram_counts(text)
    assert keys.tolist() == whole[0].tolist() and counts.tolist() == whole[1].tolist()


def ids_of(text):
    return Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, none, texts, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        model = Tokenizer.from_file(path)
        encode = lambda t: model.encode(t, add_special_tokens=False).ids
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, path).collect()}
    want = {i: (len((t or "").encode()), n := len(encode(t or "")), n > 2048) for i, t in enumerate(texts)}
    assert got == want
    assert tokens.token_counts(none, path).collect() == []


def test_pieces_are_exact_at_odd_boundaries():
    odd = ["It's. can't!! x²... É́. é.,  ñ….", "\x85a\x1cb ΑΣ. ΑΣ", "<|ENDOFTEXT|> a<|endoftext|>. B<|startoftext|>!", "I'LL're. ſ. K. ﬁ. ½%", "a\u0301. x\u0301., ẹ́.x"]
    encoder = tokens.Encoder(WORD_BPE)
    for text in odd:
        pieces = encoder.pieces(text.encode())
        known = encoder.learn(set(pieces), tuple)
        assert [i for p in pieces for i in known[p]] == ids_of(text)


def test_packing_round_trip(docs, none, texts):
    want = defaultdict(list)
    for i, t in [*enumerate(texts), (7, texts[7])]:
        want[i].append(np.array([*ids_of(t), packing.END], "<u4"))
    rows = packing.pack(docs, WORD_BPE).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r.doc_id][0]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for i, copies in want.items():
        held = np.zeros(len(copies[0]), int)
        for start, length in pieces[i]:
            held[start : start + length] += 1
        assert (held == len(copies)).all()
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding == 0
    assert packing.pack(none, WORD_BPE).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_remainder(seed):
    rng = np.random.default_rng(seed)
    window = 64
    hist = rng.integers(0, [1, 30, 500, 3][seed] + 1, window)
    if seed == 0:
        hist[:] = 0
        hist[47] = 1000  # one length only: must be cut
    rows, ends = packing.plan(hist, window)
    filled = defaultdict(list)
    for length, a, b, sequence, offset in rows.tolist():
        for rank in range(a, b):
            if sequence >= 0:
                filled[sequence + rank - a].append((offset, length))
            else:
                for _, piece, s, o in packing.stream_pieces(offset + (rank - a) * length, length, ends, window):
                    filled[s].append((o, piece))
    assert sum(n for parts in filled.values() for _, n in parts) == int((hist * np.arange(window)).sum())
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == window or at & (at - 1) == 0 and at < window
    assert set(filled) == set(range(packing.sequences_of(ends, window)))
    ranks = defaultdict(list)
    for length, a, b, *_ in rows.tolist():
        ranks[length].append((a, b))
    for length, runs in ranks.items():
        assert [0, *(b for _, b in sorted(runs))] == [*(a for a, _ in sorted(runs)), hist[length]]


def test_tiles_find_reordered_passages(spark, none):
    item = "The first clause of it stands here; and then the second clause follows it, while the third one ends the test."
    words = item.split()
    moved = " ".join(["Lead"] + words[12:] + ["in", "between"] + words[:12] + ["tail"])
    rows = [(1, "x y " + item.upper() + " z"), (2, moved), (3, " ".join(words[:8])), (4, "nothing at all"), (5, None), (6, ""), (7, item * 50), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (10, None), (11, "!?"), (12, "tiny item")], "item_id long, text string")
    for limit in (1, 1 << 20):  # one item a block, and all at once
        got = {(r.doc_id, r.item_id): r for r in tiling.contaminated(docs, items, block_bytes=limit).collect()}
        assert sorted(got, key=str) == sorted([(1, 9), (2, 9), (7, 9), (None, 9)], key=str)
        assert got[2, 9].tiles == 2 and got[2, 9].coverage == 1.0
    assert tiling.contaminated(docs, items.limit(0)).collect() == []
    assert tiling.contaminated(none, items).collect() == []


def test_tiling_takes_the_longest_first():
    doc = np.array([1, 2, 3, 4, 5, 6, 0, 5, 6, 7, 8, 9, 10, 11], np.uint64)
    item = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11], np.uint64)
    index = tiling.Index([(1, b"")], 2)
    index.words, index.ids = [item], [1]
    seeds = tiling.window_hashes(item, 2)
    order = np.argsort(seeds)
    index.seeds, index.owner, index.place, index.sizes = seeds[order], np.zeros(len(seeds), int), np.arange(len(seeds))[order], [2]
    found = tiling.tiles(doc, item, index.joined(doc)[0], 2)
    assert found == [(7, 4, 7), (0, 0, 4)]
