"""Spelling variant grouping: each word of a corpus with the words one edit away, its commoner form, and the root its forms lead to.

Words one edit apart share the first half of the word they are sought for, or else its last half; so a sorted list of all words and
one of all words reversed are searched, each for the partners that share the first half. Both lists are dealt into slices of neighbouring
words. A word goes to the slices that its first half reaches into, unless the prefix that a whole slice shares is already more than
one edit away from it. In a slice the words in reach are scanned in order: the three cells of the edit matrix around the diagonal are kept
for every letter, a word starts from the row of the prefix it shares with the one before, and where a row has no cell of one edit or
less, all words with that prefix are skipped.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespan.llm.common import release, stored, subset

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a letter.
THINNED = 199
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
GAP = re.compile("[^A-Za-zÀ-ÿ]")
#: Characters of a text looked at together; distinct words a task holds before it hands their counts on; words of a slice.
CHUNK, HELD, SLICE = 1 << 20, 200_000, 16_384
#: Copies of a root's row, so that the many words of a common form meet it in several tasks.
SALTS = 16
LAST = chr(0x10FFFF)


def runs(text: str) -> Iterator[list[str]]:
    """The runs of at least LEAST_LENGTH letters, A-Z in lower case; a long text in several lists."""
    start = 0
    while start < len(text):
        gap = GAP.search(text, start + CHUNK)
        end = gap.start() if gap else len(text)
        yield RUN.findall(text[start:end].encode().lower().decode())
        start = end


def words_of(doc_id, text: str) -> Counter:
    """How often each word stands in a document: a run, or what is left of it where its letter is deleted."""
    found = Counter()
    for some in runs(text):
        found.update(some)
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out = Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), seed)
        if h % THINNED == 0:
            run = run[: (k := h % len(run))] + run[k + 1 :]
        if len(run) >= LEAST_LENGTH:
            out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words with LEAST_COUNT occurrences in all documents. Tasks hand on counts, not occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = defaultdict(int)

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for word, n in words_of(doc_id, text.as_py() or "").items():
                    held[word] += n
                if len(held) >= HELD:
                    yield handed()
        if held:
            yield handed()
        release()

    rows = subset(docs, "doc_id", "text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def shared(a: str, b: str) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def _steps() -> list[int]:
    """All steps from one row of the edit matrix to the next. Of the row of d letters only the cells d - 1 .. d + 1 can be below two
    edits; they are kept as one number in base 3, two edits or more as 2. Of the next letter all that counts is whether it equals
    the query's letters at d - 1, d and d + 1: three bits."""
    out = []
    for row in range(27):
        left, here, right = row // 9, row // 3 % 3, row % 3
        for equal in range(8):
            a = min(left + (not equal & 4), here + 1, 2)
            b = min(here + (not equal & 2), right + 1, a + 1, 2)
            out.append(9 * a + 3 * b + min(right + (not equal & 1), b + 1, 2))
    return out


STEPS = _steps()
#: The rows of no letters and of a prefix shared with the query, and the one without a cell below two edits.
START, SAME, DEAD = 19, 10, 26


def padded(query: str) -> str:
    """The query with a blank before and three after, so that every letter compared with exists; blanks equal no letter."""
    return f" {query}   "


def prefix_fits(prefix: str, query: str) -> bool:
    """Whether some word with this prefix may be one edit away from `query`."""
    if query.startswith(prefix):
        return True
    if len(prefix) > len(query) + 1:
        return False
    row, q = START, padded(query)
    for d, letter in enumerate(prefix):
        row = STEPS[8 * row + 4 * (letter == q[d]) + 2 * (letter == q[d + 1]) + (letter == q[d + 2])]
    return row != DEAD


def half(word: str) -> int:
    """How many first letters a partner must share to be found in the list that `word` is sought in."""
    return len(word) // 2


class SortedWords:
    """A slice of a sorted word list, searched for the words one edit away."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, counts
        self.lcp = [0, *map(shared, words, words[1:])]  # with the word before

    def near(self, query: str) -> list[int]:
        """The places of the words that share half(query) letters with `query` and are one edit away."""
        words, lcp, steps, depth, n, q = self.words, self.lcp, STEPS, half(query), len(query), padded(query)
        at, end = bisect_left(words, query[:depth]), bisect_right(words, query[:depth] + LAST)
        rows = [SAME] * (n + 3)  # rows[d]: of the first d letters; known up to `known`
        out, known = [], depth
        while at < end:
            word = words[at]
            size = len(word)
            row = rows[known]
            for d in range(known, min(size, n + 1)):
                letter = word[d]
                row = rows[d + 1] = steps[8 * row + 4 * (letter == q[d]) + 2 * (letter == q[d + 1]) + (letter == q[d + 2])]
                if row == DEAD:
                    break
            else:
                d = n + 1  # of a longer word, no prefix of so many letters fits
                if -2 < n - size < 2 and row // (9, 3, 1)[n - size + 1] % 3 == 1:
                    out.append(at)
            at += 1
            if at < end:
                if lcp[at] > d:
                    at = bisect_right(words, word[: d + 1] + LAST, at, end)
                    if at == end:
                        break
                known = lcp[at]
        return out


def _directed(words: DataFrame, reverse: bool, size: int) -> DataFrame:
    """(word, n, n_near, near_n, near) per slice, for partners that share the first half: in one sorted list, of the words or of the
    words reversed. From the reversed list only partners that do not share the first half as well, which the other list gives."""
    spark = words.sparkSession
    turned = (lambda c: F.reverse(c)) if reverse else (lambda c: c)
    slices = max(1, ceil(words.count() / size))
    listed = words.select(turned(F.col("word")).alias("word"), "n")
    listed = stored(listed.repartitionByRange(slices, "word").withColumn("slice", F.spark_partition_id()), "spelling-list")
    # one row for each slice, of `size` words, at the driver
    edges = [tuple(r) for r in listed.groupBy("slice").agg(F.min("word").alias("a"), F.max("word").alias("b")).orderBy("a").collect()]
    numbers, firsts, lasts = ([e[k] for e in edges] for k in range(3))
    prefixes = [a[: shared(a, b)] for a, b in zip(firsts, lasts)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = [], [], []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                start = word[: half(word)]
                for k in range(bisect_left(lasts, start), bisect_right(firsts, start + LAST)):
                    if prefix_fits(prefixes[k], word):
                        for column, value in zip(out, (numbers[k], word, n)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["slice", "word", "n"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, found, words_, counts = None, None, [], []
        for batch in batches:
            out: tuple[list, list, list, list, list] = [], [], [], [], []
            for number, asks, word, n in zip(*(batch.column(c).to_pylist() for c in ("slice", "asks", "word", "n"))):
                if number != current:
                    current, found, words_, counts = number, None, [], []
                if not asks:
                    words_.append(word)
                    counts.append(n)
                    continue
                found = found or SortedWords(words_, counts)
                places = found.near(word)
                if reverse:  # a partner that differs only in what follows the first half is in the other list's answer
                    straight = word[::-1]
                    places = [p for p in places if words_[p][::-1][: half(word)] != straight[: half(word)]]
                if places:
                    best_n = max(counts[p] for p in places)
                    names = (words_[p][::-1] if reverse else words_[p] for p in places if counts[p] == best_n)
                    for column, value in zip(out, (word[::-1] if reverse else word, n, len(places), best_n, min(names))):
                        column.append(value)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["word", "n", "n_near", "near_n", "near"])

    sent = listed.select("word", "n").mapInArrow(send, "slice int, word string, n long").withColumn("asks", F.lit(True))
    rows = listed.withColumn("asks", F.lit(False)).unionByName(sent)
    # a slice's words come first, then those sought, which pass through one by one
    rows = rows.repartition(slices, "slice").sortWithinPartitions("slice", "asks", "word")
    return spark.createDataFrame([], NEAR) if not edges else rows.mapInArrow(search, NEAR)


NEAR = "word string, n long, n_near long, near_n long, near string"


def _roots(links: DataFrame, rounds: int) -> DataFrame:
    """(word, root) from links (word, form): forms of forms, twice as far in each round.

    The rows with their SALTS copies are merged by shuffle: Spark sees the size of the compressed files only and would broadcast them.
    """
    found = stored(links.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(rounds):
        far = found.select(F.col("word").alias("of"), F.col("root").alias("far"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows = found.withColumn("own", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
        rows = rows.join(far.hint("merge"), (rows["root"] == far["of"]) & (rows["own"] == far["salt"]), "left")
        found = stored(rows.select("word", F.coalesce("far", "root").alias("root")), "spelling-roots")
    return found


def spelling_variants(docs: DataFrame, size: int = SLICE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs (doc_id, text).

    A word is what a run of letters A-Z, a-z and U+00C0 to U+00FF leaves in lower case (A-Z only; see `words_of`), of at least 6 letters
    and with at least 5 occurrences (`n`). `n_near` counts the words one inserted, deleted or replaced letter away; the commonest of them
    (ties: the smallest) is the word's form if it is at least 5 times as common, and `root` is the last of the forms' forms.

    Null and empty texts have no words; a null doc_id counts as an empty one. Repeated rows count each time. Other columns are ignored. An
    empty table gives no rows. `size` is the number of words in a slice of the sorted lists and does not change the result.
    """
    words = stored(vocabulary(docs), "spelling-words")
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_n"), F.lit(None).cast("string").alias("near"))
    sides = none.unionByName(_directed(words, False, size)).unionByName(_directed(words, True, size))
    best = F.min(F.when(F.col("near_n").isNotNull(), F.struct((-F.col("near_n")).alias("minus"), F.col("near"))))
    near = sides.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    fits = -F.col("best.minus") >= RATIO * F.col("n")
    near = stored(near.select(
        "word", "n", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n"),
    ), "spelling-near")
    # a form is RATIO times as common, so a chain of forms cannot be longer than this
    top = words.agg(F.max("n")).first()[0] or LEAST_COUNT
    longest = 1 + int(log(top / LEAST_COUNT, RATIO) + 1e-9)
    roots = _roots(near.filter(F.col("form").isNotNull()), ceil(log(longest + 1, 2)))
    return near.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
