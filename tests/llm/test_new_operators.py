"""Spelling variants, quality rules and whitening against brute force and on odd rows."""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import quality, queries, spelling, whitening
from newsloom.llm.shared import table

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
DOCS = "doc_id bigint, text string, lang string, source string, word string, n bigint, kept string"


def docs_of(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*row, "clash", 7, "clash") for row in rows], DOCS)


# --- spelling variants -------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    counts = Counter()
    for key, text, *_ in rows:
        for run in spelling.RUN.findall((text or "").translate({c: c + 32 for c in range(65, 91)})):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    close = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and near(v, w)] for w in words}
    form = {}
    for word, others in close.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[word] = best if best and words[best] >= 2 * words[word] else None
    found = []
    for word, n in words.items():
        root = word
        while form[root]:
            root = form[root]
        found.append((word, form[word], root, n, len(close[word]), words.get(form[word])))
    return sorted(found, key=str)


def variants(spark, rows, **options):
    found = spelling.variants(docs_of(spark, rows), **options)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("split", [1 << 17, 8, 3])
def test_variants_equal_brute_force(spark, split):
    chance = random.Random(5)
    rows = []
    for at in range(60):
        words = ["".join(chance.choice("abé") for _ in range(chance.choice((4, 5, 5, 6, 7, 8, 9, 16, 17)))) for _ in range(15)]
        rows.append((at if at % 9 else None, " ".join(w for w in words for _ in range(chance.choice((1, 3, 9, 30)))).title(), None, None))
    rows += [rows[3], (99, None, None, None), (100, "", None, None), (101, "ÀBCDE Àbcde àbcde xÀbcde " * 4, None, None)]
    got = variants(spark, rows, split=split)
    assert got == plain_variants(rows) and sum(row[1] is not None for row in got) > 20


def test_forms_lead_to_a_root(spark):
    rows = [(1, "house " * 40 + "housee " * 20 + "houseee " * 10 + "houseeee " * 5 + "abcdf " * 3 + "abcde " * 6 + "abcdg " * 6, None, None)]
    got = {row[0]: row for row in variants(spark, rows)}
    assert got["houseeee"][1:3] == ("houseee", "house") and got["houseee"][5] == 20
    # Equally frequent near words: the first in code-point order.
    assert got["abcdf"][1] == "abcde" and got["abcde"][1] is None
    assert variants(spark, []) == [] and variants(spark, [(1, "once only seen", None, None)]) == []


def test_very_long_words(spark):
    long = "ab" * 30_000
    text = " ".join([long] * 8 + [long[:40_000] + "z" + long[40_000:]] * 3 + ["a" * 90_000] * 4)
    rows = [(1, text, None, None)]
    if any(zlib.crc32(f"1:{w}".encode()) % 97 == 0 for w in set(text.split())):
        pytest.fail("choose another id")
    got = variants(spark, rows)
    assert [(len(w), f and len(f), n, near) for w, f, _, n, near, _ in got] == [(90_000, None, 4, 0), (60_000, None, 8, 1), (60_001, 60_000, 3, 1)]


def test_composition_equals_brute_force():
    chance = random.Random(1)
    for at in range(200):
        words = sorted({"".join(chance.choice("ab" if at % 2 else "abc") for _ in range(chance.randint(0, 6))) for _ in range(30)})
        one = spelling.Acceptor(words)
        assert sorted(one.endings(one.start)) == words
        got = sorted(tuple(sorted(pair)) for pair in spelling.Composition(one, one).pairs())
        assert got == sorted(tuple(sorted((x, y))) for k, x in enumerate(words) for y in words[:k] if near(x, y))
        a, b = words[::2], words[1::2]
        got = sorted(spelling.Composition(spelling.Acceptor(a), spelling.Acceptor(b)).pairs())
        assert got == sorted((x, y) for x in a for y in b if near(x, y))


def test_equal_continuations_are_one_state():
    endings = ["ing", "ed", "er", "s"]
    machine = spelling.Acceptor(sorted(stem + end for stem in ("walk", "talk", "jump", "play") for end in endings))
    assert len(machine.arcs) < 20


# --- quality rules ----------------------------------------------------------------------------


def plain_counts(text):
    words = (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force():
    chance = random.Random(3)
    texts = ["", " \n", "a", "é é #\n#\n #", "a b c d e f g h a b c d e f g h", "x " * 9, "x " * 8, "l\r\nl\r\nl"]
    texts += [" ".join(chance.choice("ab") for _ in range(n)) for n in (7, 15, 16, 40, 300)]
    texts += ["\n".join(" ".join(chance.choice(["ü", "*b", "c"]) for _ in range(3)) for _ in range(40))]
    for text in texts:
        assert quality.counts(text.encode()) == plain_counts(text), text


def sentence(chance, n, scale=1):
    return " ".join("".join(chance.choice("abcdefgh") for _ in range(chance.choice((3, 5, 7)) * scale)) for _ in range(n))


def test_cutoffs_follow_the_language_and_source(spark):
    chance = random.Random(8)
    rows = [(at, sentence(chance, 40), "en", "s") for at in range(150)]
    # Long words are usual in one source and odd in the other.
    rows += [(1000 + at, sentence(chance, 40, 4), "en", "long") for at in range(120)]
    rows += [(1, sentence(chance, 40, 4), "en", "s"), (1001, sentence(chance, 40), "en", "long")]
    rows += [(2000, "a# b% c& d| " * 3 + sentence(chance, 30), "en", "s"), (2001, sentence(chance, 30) + "\none line\n" * 40, "en", "s")]
    # Too few for cutoffs of their own: their language's, then all documents'.
    rows += [(3000, sentence(chance, 40), "en", "small"), (3001, sentence(chance, 40), "xx", None), (3002, sentence(chance, 40, 40), None, None)]
    rows += [(4000, None, "en", "s"), (4001, "", None, None), (4002, "few words", "en", "s"), (None, sentence(chance, 40), "en", "s")]
    rows += [(4003, sentence(chance, 30_000), "en", "s")] * 2
    found = quality.judge(docs_of(spark, rows)).collect()
    assert len(found) == len(rows)
    dropped = {(r.id, tuple(r.reasons)) for r in found if not r.kept}
    assert (1, ("word_length",)) in dropped and (1001, ("word_length",)) in dropped
    assert any(key == 2000 and "symbols" in reasons for key, reasons in dropped)
    assert (3002, ("word_length",)) in dropped
    assert {key for key, _ in dropped} == {1, 1001, 2000, 2001, 3002, 4000, 4001, 4002}
    assert all(r.base_failed for r in found if r.id in (4000, 4001, 4002))
    assert quality.judge(docs_of(spark, [])).count() == 0


def test_sketches_merge_and_are_close(spark):
    chance = random.Random(9)
    rows = [(at, sentence(chance, chance.randint(20, 60)), "en", f"s{at % 3}") for at in range(400)]
    measured = quality.document_counts(docs_of(spark, rows))
    merged = quality.sketches(measured)
    values = sorted(r.v for r in measured.select(F.expr(quality.FIGURES["word_length"][0]).alias("v")).collect())
    whole = merged.where("level = 2 AND figure = 'word_length'").orderBy("bin").collect()
    assert sum(r.n for r in whole) == 400 == merged.where("level = 0 AND figure = 'word_length'").agg(F.sum("n")).first()[0]
    for share in (0.25, 0.5, 0.75):
        upto = 0
        for row in whole:
            upto += row.n
            if upto >= share * 400:
                break
        exact = values[int(share * 400) - 1]
        assert row.bin <= exact < row.bin * (1 + 2 / 2**quality.BITS) + 1


# --- whitening -----------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, n string, component string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(*row, "clash", "clash") for row in rows], VECTORS)


def check_whitened(rows, found, components=16):
    """`found` against numpy over the grid."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    grid = {i: tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) for i, v in usable}
    fit = np.array(sorted(set(grid.values())), np.float64)
    n, sums = len(fit), [sum(int(v[k]) for v in set(grid.values())) for k in range(fit.shape[1])]
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = min(components, int((values > 1e-9 * max(values[0], 1)).sum()))
    assert len(found) == real * len(usable)
    for row in found:
        k, x = row.component - 1, grid[row.id]
        assert row.n == n and int(row.deviation) == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        want = (np.array(x) - np.array(sums) / n) @ vectors[:, k] / np.sqrt(values[k])
        assert abs(abs(row.whitened) - abs(want)) < 1e-6
        assert row.explained == pytest.approx(values[k] / values.sum(), rel=1e-9) and row.identity_error < 1e-6


@pytest.mark.parametrize("length", [3, 40])
def test_whitening_equals_numpy(spark, length):
    chance = np.random.default_rng(length)
    spread = np.geomspace(3.0, 0.3, length)
    rows = [(at, (chance.standard_normal(length) * spread).tolist()) for at in range(300)]
    rows += [(1000 + at, rows[at][1]) for at in range(40)]
    odd = [(2000, None), (2001, []), (2002, [1.0] * (length - 1) + [None]), (2003, [1.0] * (length - 1) + [float("nan")]), (2004, [float("inf")] * length)]
    found = whitening.whiten(vectors_of(spark, rows + odd)).collect()
    check_whitened(rows + odd, found)
    signs = {}
    for row in found:
        signs.setdefault((row.id % 1000 if row.id < 1040 and row.id >= 1000 else row.id, row.component), []).append(row.whitened)
    assert all(max(v) - min(v) < 1e-9 for v in signs.values())


def test_whitening_of_odd_tables(spark):
    frame = vectors_of(spark, [(1, [1.0, 2.0])] * 3 + [(None, [1.0, 2.0]), (4, [0.0])])
    assert whitening.whiten(frame).count() == 0 and whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame).columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    # Two dimensions that move together leave one direction; a NULL id stays an id.
    line = vectors_of(spark, [(None if at == 5 else at, [at / 4, at / 4]) for at in range(20)])
    found = whitening.whiten(line).collect()
    assert sorted(str(r.id) for r in found) == sorted(["None", *(str(k) for k in range(20) if k != 5)])
    assert {r.component for r in found} == {1} and found[0].explained == pytest.approx(1.0)
    # Values far beyond what squares of bigints hold stay exact.
    big = [(at, [float(at) * 2**50, 1.0]) for at in range(3)]
    got = {r.id: int(r.deviation) for r in whitening.whiten(vectors_of(spark, big)).collect()}
    assert got[0] == (3 * 2**56) ** 2 and got[1] == 0


def test_close_eigenvalues_are_certified(spark):
    """Forty directions of nearly one size, where unfiltered iteration would not separate the first ones."""
    chance = np.random.default_rng(2)
    turn = np.linalg.qr(chance.standard_normal((40, 40)))[0]
    rows = [(at, (turn @ (chance.standard_normal(40) * np.linspace(9, 8, 40))).tolist()) for at in range(800)]
    fit = whitening.grid(vectors_of(spark, rows)).select("x").distinct().cache()
    found = whitening.leading(fit, whitening.centre_of(fit, 40), 5)
    grid = np.array([r.x for r in fit.collect()], float)
    exact = np.linalg.eigvalsh(np.cov(grid.T, bias=True))[::-1]
    fit.unpersist()
    assert np.allclose(found.values, exact[:5], rtol=1e-11) and found.trace == pytest.approx(exact.sum())
    assert found.residuals.max() <= whitening.ROUNDED * exact[0]


@needs_data
@pytest.mark.parametrize("name", ["op11_spelling_variants", "op13_whitening"])
def test_queries_equal_brute_force(spark, name):
    got = queries.QUERIES[name](spark, SF).collect()
    if name.startswith("op11"):
        docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
        assert sorted(map(tuple, got), key=str) == plain_variants(docs)
    else:
        rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
        check_whitened(rows, [r.asDict() and type("Row", (), {**r.asDict(), "id": r.vec_id}) for r in got])
