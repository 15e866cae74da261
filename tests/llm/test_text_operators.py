"""Decontamination, curriculum, SimHash, language and tokens against brute force on small rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from newsloom.llm import curriculum, decontaminate, language, shared, simhash, token_counts, token_files, tokenizing
from newsloom.session import work_dir

DOC = "doc_id bigint, text string, lang string, source string, size string, id string"
WORD_FILE, BYTE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*row, "clash", "clash") for row in rows], DOC)


def sample(seed=1, count=60):
    chance = random.Random(seed)
    words = "the of and harbour river stone Lamp, night. été über niño 42 a-b x".split()
    rows = []
    for at in range(count):
        text = " ".join(chance.choice(words) for _ in range(chance.choice([1, 3, 20, 60, 300])))
        rows.append((at, text, "en", f"s{at % 4}"))
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, " \n\t", "fr", None), (None, "no id here", "en", "s1")]
    rows += [(103, rows[4][1], "en", "s2"), (104, rows[4][1].replace("the", "THE"), "en", "s2"), (5, rows[5][1], "en", "s1")]
    rows.append((105, "long " * 20_000 + "end", "en", "s3"))
    return rows


# --- components ---------------------------------------------------------------------------


def groups_of(pairs):
    found = {}

    def root(x):
        while found.setdefault(x, x) != x:
            x = found[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        found[max(a, b)] = min(a, b)
    return {x: root(x) for x in found}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    chance = random.Random(seed)
    pairs = [(chance.randrange(80), chance.randrange(80)) for _ in range(45)] + [(200 + k, 201 + k) for k in range(30)]
    frame = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in shared.components(frame).collect()}
    assert got == groups_of((a, b) for a, b in pairs if a != b)


def test_components_of_nothing(spark):
    assert shared.components(spark.createDataFrame([], "a string, b string")).count() == 0


# --- SimHash ------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_equals_brute_force(spark):
    rows = sample()
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    want = {(i, t): plain_fingerprint(t) for i, t, *_ in rows}
    assert sorted(g.fingerprint % 2**64 for g in got) == sorted(want[i, t] for i, t, *_ in rows)
    near = [(a, b) for a, b in combinations(rows, 2) if bin(want[a[:2]] ^ want[b[:2]]).count("1") <= 4]
    joined = groups_of((a[0], b[0]) for a, b in near if a[0] is not None and b[0] is not None)
    for g in got:
        if g.id is not None:
            assert g.component_id == joined.get(g.id, g.id)


@pytest.mark.parametrize("limit", [0, 1, 4])
def test_links_connect_what_is_close(spark, monkeypatch, limit):
    """Balls of close fingerprints, small and hot, against all pairs."""
    monkeypatch.setattr(simhash, "HOT_KEY", 8)
    chance = random.Random(limit)
    values = set()
    for _ in range(25):
        centre = chance.getrandbits(64)
        for _ in range(chance.choice([1, 2, 40])):
            value = centre
            for bit in chance.sample(range(64), chance.randrange(4)):
                value ^= 1 << bit
            values.add(value - (1 << 64) if value >> 63 else value)
    values = sorted(values)
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint bigint")
    got = {r.node: r.component for r in shared.components(simhash.links(frame, limit)).collect()}
    close = [(a, b) for a, b in combinations(values, 2) if bin((a ^ b) % 2**64).count("1") <= limit]
    assert got == groups_of(close)


def test_allocation_is_the_cheapest():
    costs = [[5.0, 9.0, 30.0, 90.0, 200.0], [1.0, 20.0, 25.0, 80.0, 200.0], [2.0, 3.0, 70.0, 90.0, 200.0]]
    ways = [
        (sum(c[e] for c, e in zip(costs, es) if e >= 0), list(es))
        for es in [(a, b, c) for a in range(-1, 5) for b in range(-1, 5) for c in range(-1, 5)]
        if sum(e + 1 for e in es) == 5
    ]
    assert sum(c[e] for c, e in zip(costs, simhash.allocate(costs, 4)) if e >= 0) == min(ways)[0]


def test_keep_one(spark):
    rows = [(3, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (2, "other words in this one here", "en", "s"), (None, "a b c d e f", "en", "s")]
    kept = simhash.keep_one(docs_of(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2"]
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_keep_one_judges_shared_ids_by_their_text(spark):
    copied, alone = "a b c d e f", "quite other words stand in this one"
    rows = [(1, copied, "en", "s"), (5, copied, "en", "s"), (5, alone, "en", "s"), (7, alone, "en", "s"), (7, alone, "en", "s")]
    got = [(r.doc_id, r.text) for r in simhash.keep_one(docs_of(spark, rows)).collect()]
    assert sorted(got) == [(1, copied), (5, alone)]


def test_keep_one_leaves_no_copies_of_repeated_or_unnamed_rows(spark):
    copied, close = "a b c d e f", "one text that stands alone in here"
    rows = [(1, copied, "en", "s")] * 50 + [(4, copied, "en", "s")] * 3 + [(None, close, "en", "s")] * 40 + [(None, copied, "de", "s")] * 5
    got = [(str(r.doc_id), r.text) for r in simhash.keep_one(docs_of(spark, rows)).collect()]
    assert sorted(got) == [("1", copied), ("None", close)]


# --- decontamination ------------------------------------------------------------------------

ITEMS = "item_id bigint, text string, id bigint, n_words string"


def plain_contamination(docs, items):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def words(text):
        return pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    found = []
    for doc in docs:
        own, hit, ids = words(doc[1]), set(), set()
        for item in items:
            test = words(item[1])
            length = min(13, len(test))
            grams = {tuple(test[k : k + length]) for k in range(len(test) - length + 1)} if test else set()
            for k in range(len(own) - length + 1 if grams else 0):
                if tuple(own[k : k + length]) in grams:
                    hit.update(range(k, k + length))
                    ids.add(item[0])
        found.append((doc[0], len(own), len(hit), sorted(ids - {None})))
    return found


@pytest.mark.parametrize("block", [1 << 24, 60])
def test_contamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    passage = " ".join(f"w{k}" for k in range(30))
    items = [
        (7, passage), (8, "W3 w4, w5"), (9, None), (10, "--"), (11, "river " * 20), (11, "harbour stone"), (None, "niño 42 été"),
        (12, "über " + passage[20:60]),
    ]
    docs = sample(2, 40) + [
        (200, f"{passage} and {passage}", "en", "s"), (201, "x " + passage[4:70] + "!", "en", "s"), (202, "river " * 13, "en", "s"),
        (203, "river " * 12, "en", "s"), (204, "w3-w4/w5 w3 w4 w5", "en", "s"),
    ]
    tests = spark.createDataFrame([(*item, 1, "x") for item in items], ITEMS)
    got = decontaminate.contamination(docs_of(spark, docs), tests).collect()
    order = lambda row: (str(row[0]), row[1], row[2])
    assert sorted(((r.id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=order) == sorted(
        plain_contamination(docs, items), key=order
    )


def test_matches_are_the_longest(spark):
    text = "a " + " ".join(f"w{k}" for k in range(20)) + " b"
    tests = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(40)), 1, "x")], ITEMS)
    row = decontaminate.contamination(docs_of(spark, [(1, text, "en", "s")]), tests).first()
    assert [tuple(m) for m in row.matches] == [(1, 1, 0, 20)] and row.n_hit == 20


def test_decontaminate_drops_a_twentieth(spark):
    fill = " ".join(f"f{k}" for k in range(400))
    item = " ".join(f"w{k}" for k in range(13))
    docs = [(1, f"{item} {fill}", "en", "s"), (2, f"{item} {' '.join(fill.split()[:247])}", "en", "s"), (3, None, "en", "s")]
    tests = spark.createDataFrame([(1, item, 1, "x")], ITEMS)
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs_of(spark, docs), tests).collect()) == [1, 3]
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.decontaminate(docs_of(spark, docs), none).count() == 3
    assert decontaminate.contamination(docs_of(spark, []), tests).count() == 0


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 60])
def test_decontaminate_judges_shared_ids_by_their_text(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [" ".join(f"{letter}{k}" for k in range(13)) for letter in "vw"]
    docs = [(None, items[0], "en", "s"), (None, "clean words", "en", "s"), (4, items[1], "en", "s"), (4, "clean", "en", "s"), (None, None, "en", "s")]
    tests = spark.createDataFrame([(at, item, 1, "x") for at, item in enumerate(items)], ITEMS)
    left = decontaminate.decontaminate(docs_of(spark, docs), tests).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == [("4", "clean"), ("None", "None"), ("None", "clean words")]


# --- curriculum ----------------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[at % 3] for at, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_targets_and_taken(spark):
    rows = sample(3, 200) + [(300, "tiny", "en", "a"), (301, None, "en", "b")]
    got = curriculum.assign(docs_of(spark, rows)).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len([w for w in re.split("[\x20\x09-\x0d]+", text or "") if w])
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    taken = {}
    for row in got:
        assert row.source_size == sizes[row.source] and row.target == pytest.approx(want[row.source])
        assert 0 <= row.taken <= 3 * row["size"] and row.taken == sum(p.words for p in row.passes)
        assert all(0 <= p.position <= 1 for p in row.passes)
        taken[row.source] = taken.get(row.source, 0) + row.taken
    for source, words in taken.items():
        assert abs(words - want[source]) <= 1
    again = curriculum.assign(docs_of(spark, rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert curriculum.assign(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("schedule", curriculum.SCHEDULES)
def test_time_inverts_the_integral(spark, schedule):
    frame = spark.range(101).withColumn("share", shared.F.col("id") / 100)
    rows = frame.select("share", curriculum.time_of(shared.F.col("share"), schedule).alias("t")).collect()
    times = np.linspace(0, 1, 20_001)
    rates = np.interp(times, *zip(*schedule))
    reached = np.concatenate([[0], np.cumsum((rates[1:] + rates[:-1]) / 2)])
    reached /= reached[-1]
    for row in rows:
        assert row.t == pytest.approx(np.interp(row.share, reached, times), abs=1e-3)


def test_training_rows_are_whole_and_ordered(spark):
    rows = sample(4, 50)
    docs = docs_of(spark, rows)
    got = curriculum.training_rows(docs)
    assert got.columns == docs.columns
    texts = {(r[0], r[1]) for r in rows}
    assert all((r.doc_id, r.text) in texts for r in got.collect())


# --- language ------------------------------------------------------------------------------

ENGLISH = "the man with this other thing then thought that their weather was rather there".split()
FRENCH = "quelle belle journée nous avons été avec ces enfants qui étaient dans une maison où".split()


def two_languages(seed=0, count=80):
    chance = random.Random(seed)
    rows = []
    for at in range(count):
        words = ENGLISH if at % 2 else FRENCH
        rows.append((at, " ".join(chance.choice(words) for _ in range(40)), "en" if at % 2 else "fr", "s"))
    return rows


def test_language_on_held_out_rows(spark):
    rows = two_languages()
    extra = [(500, None, "en", "s"), (501, "12 34 !?", "en", "s"), (502, "", None, "s"), (None, "the thing that thought", None, "s")]
    mixed = " ".join(ENGLISH * 4 + FRENCH * 2)
    docs = docs_of(spark, rows + extra + [(503, mixed, None, "s"), (504, "the man with this thought " * 30_000, None, "s")])
    model = language.learn(language.learning_rows(docs))
    assert model.languages == ["en", "fr"]
    got = {r.id: r for r in language.identify(docs, model).collect()}
    assert all(got[i].lang_pred == label for i, _, label, _ in rows)
    for at in (500, 501, 502):
        assert (got[at].lang_pred, got[at].score, got[at].mixture) == ("und", 0.0, [])
    assert got[None].lang_pred == "en" and got[504].lang_pred == "en"
    assert [m.lang for m in got[503].mixture] == ["en", "fr"] and 0.5 < got[503].score < 0.9
    assert sorted(r.doc_id for r in language.keep_identified(docs.where("doc_id is not null")).collect())[-3:] == [79, 503, 504]


def test_held_out_rows_teach_nothing(spark):
    rows = two_languages()
    out = [(i, t, "xx", s) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, t, label, s) for i, t, label, s in rows]
    assert language.learn(language.learning_rows(docs_of(spark, out))).languages == ["en", "fr"]


def test_shares_are_those_of_most_likelihood():
    """Against a search over all pairs of languages and a fine grid of shares."""
    chance = np.random.default_rng(4)
    table = chance.dirichlet(np.full(40, 0.2), 5).T + 1e-9
    chances = np.full((language.BUCKETS, 5), 1e-12)
    chances[:40] = table / table.sum(axis=0)
    for pair, share in (((0, 3), 0.7), ((1, 2), 0.5), ((4, 4), 1.0)):
        drawn = chance.choice(40, 4000, p=share * chances[:40, pair[0]] + (1 - share) * chances[:40, pair[1]] + 0.0) if share < 1 else chance.choice(40, 4000, p=chances[:40, pair[0]])
        model = language.Model(list("abcde"), chances)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(language, "trigrams", lambda text: drawn.astype(np.uint32))
            got = dict(model.mixture("x"))
        counts = np.bincount(drawn, minlength=40)
        grid = [(float(counts @ np.log(s * chances[:40, a] + (1 - s) * chances[:40, b])), a, b, s)
                for a in range(5) for b in range(a + 1, 5) for s in np.linspace(0.01, 0.99, 99)]
        value, a, b, s = max(grid)
        alone, one = max((float(counts @ np.log(chances[:40, k])), k) for k in range(5))
        if value - alone <= language.PENALTY * np.log(4000):
            assert got == {"abcde"[one]: 1.0}
        else:
            assert set(got) == {"abcde"[a], "abcde"[b]} and got["abcde"[a]] == pytest.approx(s, abs=0.02)


def test_unlabelled_texts_stay(spark):
    rows = [(1, "some words", None, "s"), (1, "some words", None, "s"), (2, "12 34", None, "s"), (3, None, None, None), (None, "é", None, None)]
    kept = language.keep_identified(docs_of(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]
    assert language.keep_identified(docs_of(spark, [])).count() == 0


def test_rare_labels_are_bounded(spark):
    rows = [(at, "the words of a text", f"l{at % 7}" if at > 6 else "l0", "s") for at in range(40)]
    model = language.learn(docs_of(spark, rows), languages=3)
    assert len(model.languages) == 3 and "l0" in model.languages


def test_nothing_to_learn_from(spark):
    docs = docs_of(spark, [(1, "some words", None, "s")])
    model = language.learn(language.learning_rows(docs))
    assert language.identify(docs, model).first().lang_pred == "und"
    assert language.identify(docs_of(spark, []), model).count() == 0


# --- tokens --------------------------------------------------------------------------------

ODD = [
    "", " ", "\n", "a\n\nb", "  lead", "trail  ", "tab\tand\x0bfeed\x0c", "I'LL don't it's", "<|endoftext|>", "x<|endoftext|>y <|startoftext|>",
    "Ünïcode ÀÉ ß İstanbul Σίσυφος", "é combining", "日本語 テスト", " nbsp em", "1234 56", "...!!! ?!", "a" * 5000, "🙂 emoji 👩‍👩‍👧", "x\x1cy\x85z", "<|EndOfText|>",
]


def test_word_encoder_equals_the_library():
    library, tool = Tokenizer.from_file(WORD_FILE), tokenizing.WordEncoder(WORD_FILE)
    for text in ODD + [t for _, t, *_ in sample() if t]:
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert tool.encode(text) == want, text[:50]


def test_length_counter_equals_the_library():
    library, tool = Tokenizer.from_file(BYTE_FILE), tokenizing.LengthCounter(BYTE_FILE)
    for text in ODD + [t for _, t, *_ in sample() if t]:
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert tool.count(text, {}) == want == tool.count(text, {"the": 1}), text[:50]


def test_caches_empty_themselves(monkeypatch):
    library = Tokenizer.from_file(WORD_FILE)
    monkeypatch.setattr(tokenizing, "WORD_BYTES", 300)
    monkeypatch.setattr(tokenizing, "PIECE_BYTES", 300)
    tool = tokenizing.WordEncoder(WORD_FILE)
    for text in ("one two three four", "five six one two", "Seven, eight. nine"):
        assert tool.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_token_counts(spark):
    rows = [(at, text, "en", "s") for at, text in enumerate(ODD)] + [(None, None, "en", "s"), (3, ODD[3], "en", "s")]
    library = Tokenizer.from_file(BYTE_FILE)
    got = token_counts.token_counts(docs_of(spark, rows), BYTE_FILE, limit=100).collect()
    want = [
        (i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100)
        for i, t, *_ in rows
    ]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.token_counts(docs_of(spark, []), BYTE_FILE).count() == 0


def test_frequent_units_come_from_all_rows(spark, monkeypatch):
    rows = [(at, "early " * 3, "en", "s") for at in range(50)] + [(99, "late word " * 400, "en", "s"), (100, None, "en", "s")]
    found = {r.unit: r.n for r in token_counts.frequent_units(docs_of(spark, rows).coalesce(1)).collect()}
    assert found["late"] == 399 and found["word"] == 400 and found["early"] == 100
    units, lengths = token_counts.frequent_lengths(docs_of(spark, rows), BYTE_FILE)
    assert units.decode().split("\0")[0] == "word" and len(lengths) == len(units.split(b"\0"))
    monkeypatch.setattr(token_counts, "TABLE_ENTRIES", 2)
    assert token_counts.frequent_lengths(docs_of(spark, rows).coalesce(1), BYTE_FILE)[0] == b"word\0late"
    assert token_counts.frequent_units(docs_of(spark, [])).count() == 0


def test_summaries_keep_what_is_frequent():
    seen = Counter({f"u{at}": at for at in range(1, 101)})
    cut = token_counts._cut(seen, 10)
    assert cut == {f"u{at}": at - 90 for at in range(91, 101)}
    assert token_counts._cut(seen, 100) is seen
    assert token_counts._cut(Counter({"a": 2, "b": 2, "c": 2}), 2) == {}


def test_token_files_round_trip(spark):
    rows = sample(5, 120)
    random.Random(0).shuffle(rows)
    folder = work_dir(spark, "tokens")
    manifest = token_files.write_tokens(docs_of(spark, rows), folder, WORD_FILE, length=64, rows=4, file_ids=3000)
    got = token_files.read_tokens(spark, folder, manifest).orderBy("start").collect()
    library = Tokenizer.from_file(WORD_FILE)
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in rows}
    assert [r.id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    start = 0
    known = {(i, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t, *_ in rows}
    for row in got:
        assert row.start == start and (row.id, row.n_tokens, row.ids_crc32) in known
        start += row.n_tokens
    assert start == sum(len(ids[r[1]]) for r in rows)
    # Random access: any sequence is a view of ids and mask, and the masked ids of a file are its documents'.
    for name, tokens in [(m.file, m.tokens) for m in manifest.collect()]:
        file = token_files.TokenFile(folder, name)
        parts = [file.sequence(k) for k in range(-(-tokens // 64))]
        assert all(len(part[0]) == 64 and not part[0].flags.owndata for part in parts)
        held = np.concatenate([part[0] for part in parts])[np.concatenate([np.array(part[1]) for part in parts])]
        assert len(held) == tokens == sum(file.documents.column("n_tokens").to_pylist())


def test_no_documents_no_files(spark):
    folder = work_dir(spark, "tokens")
    manifest = token_files.write_tokens(docs_of(spark, []), folder, WORD_FILE)
    assert manifest.count() == 0 and token_files.read_tokens(spark, folder, manifest).count() == 0
