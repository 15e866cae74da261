"""Spelling variants: words one edit apart, found by composing finite-state machines.

The vocabulary is an acceptor A, minimised so that states with equal continuations are one. E is the transducer that copies
its input and inserts, deletes or replaces one character exactly once. A o E o A accepts the pairs of near words. Before
the edit both copies of A have read the same, so they stand in one state; after it they must go on with the same
characters, which is the intersection of two states' continuations and is worked out once per pair of states.

No machine holds the whole vocabulary. Two near words, the shorter of m characters, share their first or their last h(m)
characters, where h(m) <= m / 2. So the composition falls apart by the state that the first h characters lead to, and for edits
among those by the state that the last h lead to in the reversed words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.shared import in_tasks, kept, sliced

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One in so many runs loses a character.
DELETE_EVERY = 97
#: Code points and occurrences of a word of the vocabulary.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: How much more frequent than a word its form has to be.
TIMES = 2
#: Distinct words a task counts before it sends them on.
FLUSH = 1 << 18
#: Words that one machine is made of, at least if there are as many, and words of one initial state above which it is split.
CHUNK, SPLIT = 1 << 14, 1 << 17


def runs_of(doc_id: str, text: bytes) -> Iterator[tuple[str, int]]:
    """The distinct words of a text, with their occurrences in it; a run whose hash DELETE_EVERY divides lacks a character."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
        h = zlib.crc32(run.encode(), start)
        if h % DELETE_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n) of every word with LEAST_LENGTH code points and LEAST_COUNT occurrences over all texts.

    Words are counted inside the tasks before the shuffle, in tables of bounded size. NULL texts have no words; a NULL id
    counts as an empty one.
    """
    chosen = docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.col(text_column).cast("binary").alias("text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for part in sliced(iter([batch]), 1):
                for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                    for word, n in runs_of(key, text.as_py() or b""):
                        if len(word) >= LEAST_LENGTH:
                            seen[word] += n
                    if len(seen) >= FLUSH:
                        yield sent()
        yield sent()

    counted = in_tasks(chosen, count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


# --- the machines ---------------------------------------------------------------------------


class Acceptor:
    """The minimal acceptor of sorted distinct words; arcs[state] maps a character to the next state, final says where words end."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}

        def state(arcs: dict[str, int], final: bool) -> int:
            key = (final, *arcs.items())
            at = known.get(key)
            if at is None:
                at = known[key] = len(self.arcs)
                self.arcs.append(arcs)
                self.final.append(final)
            return at

        # States of the last word's path that may still get arcs: [arcs so far, whether a word ends here].
        path: list[list] = [[{}, words[:1] == [""]]]
        last = ""
        for word in [*words, ""]:
            shared = 0
            while shared < min(len(last), len(word)) and last[shared] == word[shared]:
                shared += 1
            for depth in range(len(last), shared, -1):
                arcs, final = path.pop()
                path[-1][0][last[depth - 1]] = state(arcs, final)
            path.extend([{}, False] for _ in range(shared, len(word)))
            path[-1][1] = path[-1][1] or word != ""
            last = word
        self.start = state(*path[0])
        self._endings: dict[int, list[str]] = {}

    def endings(self, state: int) -> list[str]:
        """What can follow after a state."""
        found = self._endings.get(state)
        if found is None:
            found = self._endings[state] = []
            read: list[str] = []
            open_states = [(0, "", state)]
            while open_states:
                depth, char, at = open_states.pop()
                read[max(0, depth - 1) :] = char
                if self.final[at]:
                    found.append("".join(read))
                open_states.extend((depth + 1, char, to) for char, to in self.arcs[at].items())
        return found


class Composition:
    """A o E o B for acceptors A and B, which may be one."""

    def __init__(self, a: Acceptor, b: Acceptor):
        self.a, self.b, self.same = a, b, a is b
        self._common: dict[tuple[int, int, str], list[str]] = {}
        self._edits: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def common(self, p: int, q: int, first_not: str = "") -> list[str]:
        """What can follow after both state `p` of A and `q` of B, without what begins with `first_not`."""
        found = self._common.get((p, q, first_not))
        if found is not None:
            return found
        found = self._common[p, q, first_not] = []
        read: list[str] = []
        open_states = [(0, "", p, q)]
        while open_states:
            depth, char, p, q = open_states.pop()
            read[max(0, depth - 1) :] = char
            if self.same and p == q and depth:
                begun = "".join(read)
                found += [begun + rest for rest in self.a.endings(p)]
                continue
            if self.a.final[p] and self.b.final[q]:
                found.append("".join(read))
            to = self.b.arcs[q]
            for char, next_p in self.a.arcs[p].items():
                if char in to and (depth or char != first_not):
                    open_states.append((depth + 1, char, next_p, to[char]))
        return found

    def edits(self, p: int, q: int) -> list[tuple[str, str]]:
        """Continuations (x, y) from `p` and `q` whose first difference is here and the only one.

        Of one machine each pair comes once, as (shorter, longer) or with the smaller character first.
        """
        found = self._edits.get((p, q))
        if found is not None:
            return found
        a, b, found = self.a.arcs[p], self.b.arcs[q], []
        for x, next_p in a.items():
            for y, next_q in b.items():
                if x < y or (x != y and not self.same):
                    found += [(x + rest, y + rest) for rest in self.common(next_p, next_q)]
        # An inserted character differs from the one that follows it, else the difference would come later.
        for y, next_q in b.items():
            found += [(rest, y + rest) for rest in self.common(p, next_q, y)]
        if not self.same:
            for x, next_p in a.items():
                found += [(x + rest, rest) for rest in self.common(next_p, q, x)]
        self._edits[p, q] = found
        return found

    def pairs(self) -> Iterator[tuple[str, str]]:
        """All pairs, each once."""
        read: list[str] = []
        open_states = [(0, "", self.a.start, self.b.start)]
        while open_states:
            depth, char, p, q = open_states.pop()
            read[max(0, depth - 1) :] = char
            found = self.edits(p, q)
            if found:
                begun = "".join(read)
                for x, y in found:
                    yield begun + x, begun + y
            to = self.b.arcs[q]
            for char, next_p in self.a.arcs[p].items():
                if char in to:
                    open_states.append((depth + 1, char, next_p, to[char]))


# --- partitions by initial state ---------------------------------------------------------------


def shared_length(shorter: Column) -> Column:
    """h(m): the largest power of two that is at most m / 2."""
    return F.pow(F.lit(2), F.floor(F.log2(shorter.cast("double")) + 1e-9) - 1).cast("int")


def shared_length_of(shorter: int) -> int:
    return 1 << (shorter.bit_length() - 2)


def initial_states(words: DataFrame) -> DataFrame:
    """(back, h, state, word, n): the states a word belongs to, by its first and its last h characters.

    A word is the shorter or the longer one of a pair, so h follows from its length and from one less; mostly that is one h.
    """
    length = F.length("word")
    hs = F.array_distinct(F.array(shared_length(length), shared_length(length - 1)))
    both = words.select("word", "n", F.explode(hs).alias("h")).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    turned = both.withColumn("word", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))
    return turned.select("back", "h", F.expr("substring(word, 1, h)").alias("state"), "word", "n")


LINKS = "word string, n_near bigint, best_n bigint, best string"


def _linked(found: Iterator[tuple[str, str]], back: bool, h: int, counts: dict[str, int], links: dict[str, list]) -> None:
    """Adds pairs of words, read from the initial state of `h` characters, to what each word links to."""
    for x, y in found:
        if shared_length_of(min(len(x), len(y))) != h:
            continue
        if back:
            x, y = x[::-1], y[::-1]
            # The partition by first characters has these.
            if x[:h] == y[:h]:
                continue
        for word, other in ((x, y), (y, x)):
            n = counts[other]
            mine = links.get(word)
            if mine is None:
                links[word] = [1, n, other]
            else:
                mine[0] += 1
                if n > mine[1] or (n == mine[1] and other < mine[2]):
                    mine[1], mine[2] = n, other


def _sent(links: dict[str, list]) -> pa.RecordBatch:
    columns = list(zip(*links.values())) or [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(links), pa.string()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
        ["word", "n_near", "best_n", "best"],
    )


def _pairs_within(start: str, words: list[str], others: list[str] | None = None) -> Iterator[tuple[str, str]]:
    """Near words among `words`, or between them and `others`, that all begin with `start` and differ behind it."""
    cut = len(start)
    a = Acceptor(sorted(word[cut:] for word in words))
    b = a if others is None else Acceptor(sorted(word[cut:] for word in others))
    for x, y in Composition(a, b).pairs():
        yield start + x, start + y


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the words of each initial state; rows (back, h, state, word, n) come sorted, so a state's words follow each other."""
    one, counts, links = None, {}, {}

    def closed() -> None:
        back, h, state = one
        original = {word[::-1]: n for word, n in counts.items()} if back else counts
        _linked(_pairs_within(state, list(counts)), back, h, original, links)

    for batch in batches:
        for back, h, state, word, n in zip(*(column.to_pylist() for column in batch.columns)):
            if (back, h, state) != one:
                if len(counts) > 1:
                    closed()
                one, counts = (back, h, state), {}
                if len(links) >= CHUNK:
                    yield _sent(links)
                    links = {}
            counts[word] = n
    if len(counts) > 1:
        closed()
    yield _sent(links)


def _compose_cell(cell: pa.Table) -> pa.Table:
    """Links within a part of a large initial state, or between two parts."""
    back, h, state, low, high = (cell.column(name)[0].as_py() for name in ("back", "h", "state", "low", "high"))
    words, counts, own = (cell.column(name).to_pylist() for name in ("word", "n", "own"))
    known = {word[::-1] if back else word: n for word, n in zip(words, counts)}
    first = [word for word, part in zip(words, own) if part == low]
    second = None if low == high else [word for word, part in zip(words, own) if part == high]
    links: dict[str, list] = {}
    _linked(_pairs_within(state, first, second), back, h, known, links)
    return pa.Table.from_batches([_sent(links)])


def near_words(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """(word, n_near, best_n, best) of every word of `words` (word, n; each once) that has a near word.

    best is its most frequent near word, the first in code-point order of several. A task reads the states of its partition one after
    the other and holds one at a time. A state of more than `split` words is dealt into parts of about that size, and all pairs
    of parts are composed, so no task holds more than two parts.
    """
    key = ["back", "h", "state"]
    placed = kept(initial_states(words))
    large = kept(placed.groupBy(*key).count().where(F.col("count") > split))
    small = placed if large.isEmpty() else placed.join(large, key, "left_anti")
    found = in_tasks(small.repartition(*key).sortWithinPartitions(*key), _compose, LINKS)
    if not large.isEmpty():
        parts = large.select(*key, F.ceil(F.col("count") / split).cast("int").alias("parts"))
        cells = (
            placed.join(parts, key)
            .withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select(*key, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "word", "n")
        )
        found = found.union(cells.groupBy(*key, "low", "high").applyInArrow(_compose_cell, LINKS))
    order = F.struct(-F.col("best_n"), F.col("best"), F.col("best_n").alias("shown"))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), F.min(order).alias("b"))
        .select("word", "n_near", F.col("b.shown").alias("best_n"), F.col("b.best").alias("best"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), form being no word's NULL: the last of the forms that follow from each word.

    Each round replaces every target by its own target, so a chain of k forms takes log2(k) rounds; counts at least double
    from a word to its form, so chains are short and without a circle. A word is the form of few others, its near words.
    """
    links = kept(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = kept(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", split: int = SPLIT) -> DataFrame:
    """One row (word, form, root, n, n_near, form_n) per word of the vocabulary of all texts.

    form is the word's most frequent near word (ties: first in code-point order) if that occurs at least TIMES as often, root what
    following forms ends at, the word itself without one. NULL and empty texts have no words, a NULL id counts as an empty
    one, rows that repeat count each. Columns beside the two are ignored; no documents or no frequent word give no rows.
    """
    words = kept(vocabulary(docs, id_column, text_column))
    near = near_words(words, split)
    is_form = F.col("best_n") >= TIMES * F.col("n")
    judged = kept(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
        )
    )
    last = roots(judged.where("form IS NOT NULL"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
