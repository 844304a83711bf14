"""Window packing, collocations and hard negatives: against brute force, and on odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarterdeck.llm import collocations, negatives, windows
from quarterdeck.llm.queries import QUERIES
from quarterdeck.llm.word_bpe import word_encoder

FOLDER = entry.SMOKE_DIR
NAN, INF = float("nan"), float("inf")
LIBRARY = word_encoder(windows.TOKENIZER).library
ALPHABET = [" ", "  ", "\n", "\t", "a", "The", "'S", "'s", "É", "1", "23", "!", "...", "\r\n", "<|endoftext|>", "<|ENDOFTEXT|>", "<|start",
            "oftext|>", "漢字", "\x1c", "\x85", "​", "🙂", "\x00", "_", "LL", "\xa0", "　", "\x0b", "²", "ß", "İ", "▁", "ΣΑΣ", "́", "e",
            "가", "ᆨ", "か", "゙", "K"]


def library_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, windows.END_ID]


# Window packing


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=20).map("".join) | st.text(max_size=40))
def test_word_ids_are_the_librarys(text):
    got = np.frombuffer(word_encoder(windows.TOKENIZER).encode(text), "<u4").tolist()
    assert got == library_ids(text)[:-1]


def test_long_texts_are_cut_at_white_space(monkeypatch):
    from quarterdeck.llm import word_bpe

    monkeypatch.setattr(word_bpe, "BLOCK", 5)
    for text in ("one two  three\nfour", "x" * 40, " a b", "a " * 9, "unbroken-start then more words"):
        assert np.frombuffer(word_encoder(windows.TOKENIZER).encode(text), "<u4").tolist() == library_ids(text)[:-1]


def test_combinations_are_all():
    for total, depth, largest in ((7, 3, 6), (12, 4, 11), (5, 2, 5)):
        expected = {tuple(sorted(c, reverse=True)) for n in range(1, depth + 1)
                    for c in np.ndindex(*(largest + 1,) * n) if sum(c) == total and all(c)}
        found = windows.combinations(total, depth, largest)
        assert set(found) == expected and len(found) == len(expected)


def test_least_squares_meets_its_conditions():
    draw = np.random.default_rng(1)
    for _ in range(40):
        a, b = draw.integers(0, 3, (6, 14)).astype(float), draw.integers(0, 50, 6).astype(float)
        x = windows.non_negative_least_squares(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6 * b.sum()).all() and np.abs(slope[x > 0]).max(initial=0) <= 1e-6 * b.sum()


def test_plans_use_every_piece_once():
    draw = np.random.default_rng(2)
    for _ in range(30):
        lengths = [n for n in (1, 2, 3, 5, 7, 8, 16, 24, 32, 40, 48, 56, 64) if draw.random() < 0.7]
        counts = {n: int(draw.integers(1, 60)) for n in lengths}
        used = Counter()
        for p in windows.plan(counts, 64, 8, 3):
            assert sum(p.lengths) <= 64 and p.times > 0
            used.update({n: k * p.times for n, k in Counter(p.lengths).items()})
        assert used == counts


def check_spans(out, texts):
    """Pieces cover every document once and have the ids' crc."""
    for doc, rows in out.sort_values("start").groupby("doc_id"):
        ids = np.array(library_ids(texts[doc]), "<u4")
        assert rows.start.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and set(rows.doc_tokens) == {len(ids)}
        assert rows.length.sum() == len(ids)
        assert [zlib.crc32(ids[s : s + n]) for s, n in zip(rows.start, rows.length)] == rows.ids_crc32.tolist()


def check_places(out, window=windows.WINDOW):
    """Pieces lie in sequences without gaps."""
    placed = out.sort_values(["sequence_id", "offset"])
    assert (placed.offset == placed.groupby("sequence_id").length.cumsum() - placed.length).all()
    assert placed.groupby("sequence_id").length.sum().max() <= window


def test_window_packing(spark):
    out = QUERIES["op11_window_packing"](spark, "/root/testdata/sf0.01").toPandas()
    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id").text
    assert set(out.doc_id) == set(texts.index)
    check_spans(out, texts)
    check_places(out)
    padded = sum(windows.padding(int(n)) for n in out.groupby("sequence_id").length.sum())
    assert padded <= 0.005 * out.length.sum()


def test_window_packing_of_odd_rows(spark):
    texts = {1: "some words " * 3000, 2: None, 3: "", 4: " \t\n", 5: "one", 6: "x" * 60_000, 7: "漢字 🙂 \x1c <|endoftext|>"}
    rows = [(i, t, "s") for i, t in texts.items()] + [(None, "no id", "s"), (8, "twice", "s"), (8, "twice", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string").withColumn("length", F.lit("clash"))
    out = windows.pack(docs).toPandas()
    assert out.doc_id.isna().sum() == 1 and (out.doc_id == 8).sum() == 2
    assert out[out.doc_id.isin([2, 3, 4])].length.tolist() == [1, 1, 1]
    check_spans(out[out.doc_id.isin(list(texts))], texts)
    check_places(out)
    assert windows.pack(docs.limit(0)).count() == 0


# Collocations


def brute_collocations(rows, least, within, best):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 5):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= within * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def made_texts(n=400):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(25)] + ["The", "É\x01", "x\xa0y", "\x02"]
    ends = [" ", " ", " ", "  ", "\t", ". ", "\n", "!?", "\r", "\x0b"]
    rows = [(draw.choice(["en", "de", None]), "".join(draw.choice(words[: draw.choice([3, 8, 29])]) + draw.choice(ends) for _ in range(draw.randrange(60)))) for _ in range(n)]
    return rows + [("en", None), ("fr", ""), (None, None), ("en", "a b c d " * 200), ("en", "solo" * 9000)]


@pytest.mark.parametrize("budget", [collocations.BUDGET, 4000, 160])
def test_collocations(spark, monkeypatch, budget):
    """Also where most beginnings are extended, and tasks send on what they hold again and again."""
    if budget < 4000:
        monkeypatch.setattr(collocations, "HELD", 50)
        monkeypatch.setattr(collocations, "BLOCK", 300)
        monkeypatch.setattr(collocations, "HASHED", 4096)
        monkeypatch.setattr(collocations, "HELD_NUMBERS", 100)
    rows = made_texts()
    docs = spark.createDataFrame([(g, t, "p") for g, t in rows], "lang string, text string, phrase string").repartition(5)
    out = collocations.collocations(docs.withColumn("n", F.lit("clash")), least=20, best=15, budget=budget)
    assert sorted(tuple(r) for r in out.collect()) == brute_collocations(rows, 20, 80, 15)


def test_groups_get_a_suffix_once_from_all_tasks(spark, monkeypatch):
    subtree = collocations.subtree

    def once_each(rows):
        assert rows.group_by(["lang", "suffix"]).aggregate([]).num_rows == rows.num_rows
        return subtree(rows)

    monkeypatch.setattr(collocations, "subtree", once_each)
    rows = [("en", "a b c d e. a b"), ("de", "a b c")] * 60
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(12)
    out = {(r["lang"], r["phrase"]): r["f"] for r in collocations.phrase_counts(docs).filter("words > 1").collect()}
    en = {"a b": 120, "b c": 60, "c d": 60, "d e": 60, "a b c": 60, "b c d": 60, "c d e": 60, "a b c d": 60, "b c d e": 60}
    assert out == {**{("en", p): n for p, n in en.items()}, ("de", "a b"): 60, ("de", "b c"): 60, ("de", "a b c"): 60}


def test_suffixes_of_every_place(monkeypatch):
    """In pieces of a few bytes, and of single suffixes longer than that."""
    text = b"a bb a ccc" + b"x" * 40 + b" dd\na bb"
    words = collocations.Words("en", text)
    at, n = np.array([0, 1, 2, 3, 5]), np.array([4, 3, 3, 2, 2], np.int8)
    for size in (1, 10, 60, 1 << 20):
        monkeypatch.setattr(collocations, "HASHED", size)
        parts = [(p, a.to_pylist()) for p, a in words.phrases(n, at)]
        assert [p.start for p, _ in parts] == [0, *(p.stop for p, _ in parts[:-1])] and parts[-1][0].stop == 5
        assert all(len(a) == 1 or sum(map(len, a)) <= size for _, a in parts)
        long = b"ccc" + b"x" * 40
        assert sum((a for _, a in parts), []) == [b"a bb a " + long, b"bb a " + long, b"a " + long + b" dd", long + b" dd", b"a bb"]


def test_no_collocations(spark):
    docs = spark.createDataFrame([(None, None), ("en", ""), ("en", " . ")], "lang string, text string")
    assert collocations.collocations(docs).count() == 0 and collocations.collocations(docs.limit(0)).count() == 0


def test_subtree_counts_are_sums_of_leaves():
    rows = pa.table({"lang": ["en"] * 4 + ["de"], "suffix": [b"a b c", b"a b", b"a b d e", b"a b c", b"a b"], "n": [3, 5, 2, 1, 7]})
    out = {(r["lang"], r["phrase"]): r["n"] for r in collocations.subtree(rows).to_pylist()}
    assert out == {("en", b"a b"): 11, ("en", b"a b c"): 4, ("en", b"a b d"): 2, ("en", b"a b d e"): 2, ("de", b"a b"): 7}


def test_scores_beyond_64_bits(spark):
    row = spark.sql(f"""SELECT (CAST({collocations.FACTOR} AS DECIMAL(18)) * CAST(a AS DECIMAL(19))) DIV (CAST(l AS DECIMAL(19)) + CAST(r AS DECIMAL(19))) AS s
        FROM VALUES (9000000000000000000L, 9000000000000000001L, 9000000000000000000L) t(a, l, r)""").first()
    assert row["s"] == 2_000_000 * 9_000_000_000_000_000_000 // 18_000_000_000_000_000_001


# Hard negatives


def brute_negatives(rows, asks, positives=5, some=3):
    """Rows: id, label, vector. A row per anchor, positive and negative."""
    fit = [(i, g, [int(np.floor(256 * float(x))) for x in v]) for i, g, v in rows
           if i is not None and g is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, g, v) in enumerate(fit):
        if not asks(i):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, h) for m, (j, h, w) in enumerate(fit) if m != n]
        for s, j, _ in sorted((x for x in scored if x[2] == g), key=lambda x: x[:2])[:positives]:
            near = sorted((t, k) for t, k, h in scored if h != g and 50 * -s <= 100 * -t <= 95 * -s)[:some]
            out.extend((i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(near, 1))
    return sorted(out)


@pytest.mark.parametrize("scale", [1, 1e6, 1e15])
def test_packed_products_are_exact(scale):
    draw = np.random.default_rng(5)
    for sign in (1, -1):
        c = np.floor(scale * sign * draw.random((37, 9)) * draw.choice([-1, 1], (37, 9)))
        a = np.floor(scale * draw.normal(size=(11, 9)))
        packed = negatives.Packed(c, a)
        exact = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in c] for p in a]
        assert packed.scores(a).tolist() == np.clip(np.array(exact, dtype=object), negatives.LEAST, negatives.MOST).tolist()
        assert packed.narrow == (scale < 1e4)


def test_bounds():
    for s in (0, 1, 2, 7, 99, 100, 101, 12345, -1, -7, -100, 2**63 - 1, -(2**63)):
        low, high = (int(x[0]) for x in negatives.bounds(np.array([s])))
        assert low == -(-50 * s // 100) and high == 95 * s // 100


@pytest.mark.parametrize("rows", [negatives.LEAST_SHARD_ROWS, 16])
def test_hard_negatives(spark, monkeypatch, rows):
    monkeypatch.setattr(negatives, "LEAST_SHARD_ROWS", rows)
    monkeypatch.setattr(negatives, "CELLS", 300)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", rows)
    draw = random.Random(8)
    data = [(draw.randrange(60), draw.choice([0, 0, 0, 1, 2, None]), [draw.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for _ in range(150)]
    data += [(10, 1, [1.0] * 4)] * 9 + [(20, 2, []), (21, 2, [0.5]), (None, 1, [1.0] * 4), (22, 1, None), (23, 1, [NAN]), (24, 1, [INF]), (25, 1, [None])]
    frame = spark.createDataFrame(data, "vec_id long, label int, embedding array<float>").withColumn("row", F.lit("clash"))
    out = negatives.mine(frame, F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in out.collect()) == brute_negatives(data, lambda i: i % 10 == 0)
    assert negatives.mine(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_hard_negatives_beyond_longs(spark):
    data = [(0, 1, [1e300, 1.0]), (1, 1, [1e300, 1.0]), (2, 2, [1e300, 1.0]), (3, 2, [2.0, 3.0])]
    out = negatives.mine(spark.createDataFrame(data, "vec_id long, label int, embedding array<double>"), F.col("vec_id") == 0)
    assert out.count() == 0  # both scores are the greatest long, and the one is not below the other
