"""Each method against brute force, an exact round trip or held-out accuracy."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from quarterdeck.llm import bpe, packing, pieces, quality, simhash, token_files, topk, toxicity
from quarterdeck.llm.queries import QUERIES, SQL
from tools import compare

FOLDER = entry.SMOKE_DIR


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert compare.difference(QUERIES[name](spark, FOLDER), compare.database(FOLDER), SQL[name]) is None


ALPHABET = [" ", "  ", "\n", "\t", "a", "the", " the", "'s", "é", "1", "23", "!", "...", "\r\n", "<|endoftext|>", "漢字", "\x1c",
            "\x85", "​", "🙂", "\x00", "_", "'", "ll", "A", " ", "　", "\x0b", "²", "ß", "▁", "Ω", "́"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join) | st.text(max_size=40))
def test_ids_are_the_librarys(text):
    library = bpe.encoder(bpe.TOKENIZER).library
    assert bpe.encode_with_end([text])[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, bpe.END_ID]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=20).map("".join) | st.text(max_size=30), min_size=1, max_size=5))
def test_pieces_spell_the_text(texts):
    words = pieces.vocabulary(pieces.MODEL)
    keys = [str(i) for i in range(len(texts))]
    for ids, text in zip(pieces.sample(keys, texts, words), texts):
        assert pieces.spelled(ids, words.spelling) == text


def test_segmentations_have_their_share():
    words, text = pieces.vocabulary(pieces.MODEL), "hello"
    by = {p.decode(): i for i, p in enumerate(words.spelling) if np.isfinite(words.weight[i])}

    def ways(rest):
        if not rest:
            yield ()
        for n in range(1, len(rest) + 1):
            if rest[:n] in by:
                yield from ((by[rest[:n]], *more) for more in ways(rest[n:]))

    weight = {w: math.exp(sum(words.weight[i] for i in w)) for w in ways(" " + text)}
    n = 20_000
    drawn = Counter(tuple(x.tolist()) for x in pieces.sample([str(i) for i in range(n)], [text] * n, words))
    assert set(drawn) <= set(weight)
    for way, w in weight.items():
        p = w / sum(weight.values())
        assert abs(drawn[way] / n - p) < 5 * math.sqrt(p / n) + 1e-4


def test_draws_depend_on_the_row_alone():
    words = pieces.vocabulary(pieces.MODEL)
    texts = ["some words of a text\nand more", "other words", "a text"]
    together = pieces.sample(["a", "b", "c"], texts, words)
    alone = [pieces.sample([k], [t], words)[0] for k, t in zip("abc", texts)]
    assert all((x == y).all() for x, y in zip(together, alone))
    assert any((a != b).any() if len(a) == len(b) else True for a, b in zip(together, pieces.sample(["x", "y", "z"], texts, words)))


def fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labelled(fps):
    """Smallest position reachable over links of at most four bits."""
    out = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, j in combinations(range(len(fps)), 2):
            if out[i] != out[j] and (fps[i] ^ fps[j]).bit_count() <= 4:
                low, high = sorted((out[i], out[j]))
                out = [low if x == high else x for x in out]
                changed = True
    return out


def test_fingerprints(spark):
    rows = QUERIES["op5_simhash"](spark, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [fingerprint(texts[i]) for i in ids]
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{x:016x}" for i, x in zip(ids, fps)}
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: ids[k] for i, k in zip(ids, labelled(fps))}


@pytest.mark.parametrize("home_rows", [simhash.HOME_ROWS, 3])
def test_links_of_chains_and_crowds(spark, monkeypatch, home_rows):
    """Links a few bits apart in chains and crowds, also where every crowded anchor is dealt out in blocks."""
    monkeypatch.setattr(simhash, "HOME_ROWS", home_rows)
    draw, fps = random.Random(5), set()
    for _ in range(6):
        x = draw.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            for b in draw.sample(range(64), draw.choice([1, 2, 4, 5, 6])):
                x ^= 1 << b
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r["a"]: r["root"] for r in simhash.components(simhash.links(frame)).collect()}
    found = [roots.get(x, x) for x in fps]
    expected = labelled([x & ((1 << 64) - 1) for x in fps])
    assert found == [fps[k] for k in expected]


def test_every_part_value_has_a_home_and_meets_its_neighbours():
    flips = simhash._flips(21)
    for value in random.Random(1).sample(range(1 << 21), 200):
        syndrome = 0
        for i in range(simhash.CODE_BITS):
            syndrome ^= (value >> i & 1) * (i + 1)
        anchors = {value ^ m for m in flips[syndrome]}
        for anchor in anchors:
            left = 0
            for i in range(simhash.CODE_BITS):
                left ^= (anchor >> i & 1) * (i + 1)
            assert left == 0 and (anchor ^ value).bit_count() <= 2
        assert any((a ^ value).bit_count() <= 1 for a in anchors)


def test_fullest_is_the_fullest():
    draw = random.Random(3)
    for _ in range(200):
        room = draw.randrange(1, 30)
        lengths = [draw.randrange(1, 25) for _ in range(draw.randrange(0, 9))]
        best = max(s for k in range(len(lengths) + 1) for c in combinations(lengths, k) if (s := sum(c)) <= room)
        got = packing.fullest(room, np.bincount(lengths, minlength=40))
        assert sum(got) == best and not Counter(got) - Counter(lengths)


def test_columns_of_texts_are_encoded_as_each_text(monkeypatch):
    library = bpe.encoder(bpe.TOKENIZER).library
    some = ["a", "Hello", " ", "  ", "\n", "\t", ".", ",", "!?", "\x01", "\x01.", "\x1c", "\x85", "<|endoftext|>", "é", "ä.", "中文", "ß,", "1.5", "'s", "\xa0", "😀", "e\u0301,"]
    draw = np.random.default_rng(5)
    texts = [None, "", " ", ".", *("".join(draw.choice(some, n)) for n in draw.integers(0, 12, 600))]
    for block in (1, 40, 1 << 22):
        monkeypatch.setattr(bpe, "BLOCK", block)
        for text, ids in zip(texts, bpe.encode_with_end(texts), strict=True):
            assert ids.tolist() == [*library.encode(text or "", add_special_tokens=False).ids, bpe.END_ID]


def test_a_word_is_coded_once_in_a_block(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PARTS", 0)
    monkeypatch.setattr(bpe, "CACHE_TOKENS", 0)
    encoder = bpe.Encoder(bpe.TOKENIZER)
    monkeypatch.setattr(bpe, "encoder", lambda name: encoder)
    coded, model = [], encoder.model

    class Counted:
        def tokenize(self, letters):
            coded.append(letters)
            return model.tokenize(letters)

    encoder.model = Counted()
    assert len({x.tobytes() for x in bpe.encode_with_end(["One word, another word, one more word."] * 300)}) == 1
    # At the start of each text there is one more, "One", which stands before the first cut.
    assert len([x for x in coded if x != "One"]) < 20


def test_packing_is_tight(spark):
    out = QUERIES["op8_best_fit_packing"](spark, "/root/testdata/sf0.01").toPandas()
    used = out.groupby("sequence_id").length.sum()
    assert used.max() <= 1024 and len(used) <= 1.005 * math.ceil(out.length.sum() / 1024) + 1
    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id").text
    for doc, rows in out.sort_values("piece").groupby("doc_id"):
        ids = bpe.encode_with_end([texts[doc]])[0]
        assert rows.start.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() == len(ids)
        assert (rows.length.iloc[1:] == 1024).all()
        assert [zlib.crc32(ids[s : s + n]) for s, n in zip(rows.start, rows.length)] == rows.ids_crc32.tolist()


def test_sequences_are_views(tmp_path):
    path, ids = f"{tmp_path}/x.arrow", np.arange(5000, dtype=np.uint32) % 50_000
    writer = token_files.SequenceWriter(path, 16, np.dtype("<u2"))
    assert writer.add(ids[:7]) == 0 and writer.add(ids[7:]) == 7
    writer.close()
    file = token_files.SequenceFile(path)
    got, mask = file.sequence(3)
    assert got.tolist() == ids[48:64].tolist() and not got.flags.owndata and all(mask.to_pylist())
    assert file.sequence(312)[1].to_pylist() == [i < 8 for i in range(16)]
    assert [x.tolist() for x in file.spans([(0, 7), (7, 4993)])] == [ids[:7].tolist(), ids[7:].tolist()]


def test_token_files(spark):
    out = QUERIES["op9_token_files"](spark, "/root/testdata/sf0.01").toPandas().sort_values("doc_id")
    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").sort_values("doc_id")
    ids = bpe.encode_with_end(texts.text.tolist())
    assert out.n_tokens.tolist() == [len(x) for x in ids] and out.ids_crc32.tolist() == [zlib.crc32(x) for x in ids]
    assert out.start.tolist() == (out.n_tokens.cumsum() - out.n_tokens).tolist()


def test_tiles_and_ties():
    draw = np.random.default_rng(2)
    v = draw.integers(-3, 4, (300, 5)).astype(float)
    ids = draw.permutation(300)
    found = topk.best_in_tile(ids[:20], v[:20], ids, v, 10)
    got = {}
    for q, c, s in zip(*[x.tolist() for x in found]):
        got.setdefault(q, []).append((-s, c))
    for q, row in zip(ids[:20].tolist(), v[:20]):
        assert got[q] == sorted((-int(s), int(c)) for s, c in zip(v @ row, ids) if c != q)[:10]


def test_trees_learn():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    trees = quality.fit(x[:3000], y[:3000])
    assert ((trees.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.97


def accuracy(spark, name, label, folder="/root/testdata/sf0.1"):
    out = QUERIES[name](spark, folder).toPandas().merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    out = out[out.held_out]
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    return out, out[label]


def test_quality_held_out(spark):
    out, y = accuracy(spark, "op6_quality_classifier", "quality")
    assert (out.predicted == y).mean() > 0.99


def test_toxicity_held_out(spark):
    out, y = accuracy(spark, "op4_toxicity", "toxic")
    caught, named = (out.predicted[y == 1]).mean(), y[out.predicted == 1].mean()
    assert caught > 0.6 and named > 0.95


def test_unlabelled_positives_are_not_learnt_as_clean():
    """Half of the toxic texts are unlabelled; their word is still toxic."""
    draw = np.random.default_rng(4)
    toxic = draw.random(2000) < 0.2
    positive = toxic & (draw.random(2000) < 0.5)
    doc = np.concatenate([np.flatnonzero(toxic), np.arange(2000)])
    word = np.concatenate([np.zeros(toxic.sum(), int), draw.integers(1, 20, 2000)])
    bias, w = toxicity.fit(doc, word, positive, 20, 0.2 * 0.5 / 0.9)
    assert w[0] + bias > 0 > bias and abs(w[1:]).max() < w[0]
