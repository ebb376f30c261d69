"""Groups of spelling variants by FM-index search with one error.

Words that differ by one put in, deleted or replaced letter agree in one of two halves of either word. So a word is looked
up twice: its first half is matched exactly, and the search goes on across the second half and may err once; then the same from the
last half backwards. Both run on an FM-index of a delimited vocabulary, #word#word#..., in which a
pattern is an interval of suffix ranks and one more letter on its left side narrows the interval by two look-ups. The first search
needs the index of the reversed text (letters are put on the right of the pattern), the second that of the text itself: together
the two directions of a bidirectional index; as a pattern begins at a delimiter, neither search ever changes direction.

The vocabulary is cut by halves: an entry is sent to the parts of every half under which a word of its length, one more or
one less can ask for it, and a word to the part of each of its halves, so an index holds a bounded part of the vocabulary. A half
that very many words have is dealt into blocks of entries and of askers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segpanel.llm.contamination import LOWER, UPPER
from segpanel.llm.stage import shuffle_partitions, staged

#: Entries of an index on average, and most entries of one half before its group is split.
PART = 30_000
LETTERS = "[A-Za-zÀ-ÿ]"
_FEW = 24


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (bytes; the last byte is 0 and the only 0) in their order, by doubling."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k:k + n]
    known = 8
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new)
        if new.all():
            return order
        later = np.zeros(n, np.uint64)
        later[:n - known] = rank[known:] if known < n else 0
        key, known = (rank << np.uint64(32)) | later, known * 2


class Index:
    """FM-index of #w1#w2#...# read from the right, so that ``step`` puts a letter on the right of the pattern."""

    def __init__(self, words: list[bytes]):
        text = np.frombuffer((b"#" + b"#".join(words) + b"#")[::-1] + b"\0", np.uint8)
        order = suffix_array(text)
        self.n = len(text)
        self.bwt = text[order - 1]
        self.letters = np.unique(self.bwt[self.bwt > ord("#")])
        #: Letters in the order of the sorted column, each with its place in the text's transform: a look-up gives the rank that follows.
        self.places = np.sort(self.bwt.astype(np.int64) * (self.n + 1) + np.arange(self.n))
        # Word that begins after the delimiter of each rank.
        marks = np.flatnonzero(text == ord("#"))
        self.word_of = np.full(self.n, -1, np.int64)
        rank = np.empty(self.n, np.int64)
        rank[order] = np.arange(self.n)
        self.word_of[rank[marks[:-1]]] = np.arange(len(marks) - 1)[::-1]

    def step(self, low: np.ndarray, high: np.ndarray, letter) -> tuple[np.ndarray, np.ndarray]:
        base = np.asarray(letter, np.int64) * (self.n + 1)
        return np.searchsorted(self.places, base + low), np.searchsorted(self.places, base + high)

    def following(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every letter that may come next: state, letter, low, high."""
        size = high - low
        few, many = np.flatnonzero(size <= _FEW), np.flatnonzero(size > _FEW)
        at = np.repeat(few, size[few])
        inside = np.arange(len(at)) - np.repeat(np.cumsum(size[few]) - size[few], size[few]) + low[at]
        pair = np.unique(at * 256 + self.bwt[inside])
        state, letter = pair >> 8, pair & 255
        state = np.concatenate([state, np.repeat(many, len(self.letters))])
        letter = np.concatenate([letter, np.tile(self.letters, len(many))])
        keep = letter > ord("#")
        state, letter = state[keep], letter[keep]
        a, b = self.step(low[state], high[state], letter)
        keep = b > a
        return state[keep], letter[keep], a[keep], b[keep]


def near_words(entries: list[bytes], asking: list[bytes], last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asking, entry) that differ by one letter put in, deleted or replaced behind the first half of the asking word.

    ``entries`` are distinct. The halves of a word of m letters have m // 2 and the rest; words are given reversed if ``last``.
    """
    index = Index(entries)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    sizes = np.array([len(w) for w in asking])
    for m in np.unique(sizes):
        who = np.flatnonzero(sizes == m)
        words = np.frombuffer(b"".join(asking[i] for i in who), np.uint8).reshape(len(who), m)
        half = m - m // 2 if last else m // 2
        own = np.arange(len(who))
        low, high = index.step(np.zeros(len(who), np.int64), np.full(len(who), index.n), np.full(len(who), ord("#")))
        for i in range(half):
            low, high = index.step(low, high, words[own, i])
            alive = high > low
            own, low, high = own[alive], low[alive], high[alive]
        erred = (np.empty(0, np.int64),) * 3  # states after the error: word, low, high
        for i in range(half, m + 1):
            if not len(own) and not len(erred[0]):
                break
            state, letter, a, b = index.following(low, high)
            erred = tuple(np.concatenate(p) for p in zip(erred, (own[state], a, b)))  # a letter put in
            if i == m:
                break
            who_next, low_next, high_next = erred
            a2, b2 = index.step(low_next, high_next, words[who_next, i])
            alive = b2 > a2
            other = letter != words[own[state], i]
            erred = tuple(np.concatenate(p) for p in zip(
                (who_next[alive], a2[alive], b2[alive]), (own[state][other], a[other], b[other]), (own, low, high)))  # replaced, deleted
            low, high = index.step(low, high, words[own, i])
            alive = high > low
            own, low, high = own[alive], low[alive], high[alive]
        if len(erred[0]):
            a, b = index.step(erred[1], erred[2], np.full(len(erred[0]), ord("#")))
            alive = b > a
            found.append((who[erred[0][alive]], index.word_of[a[alive]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left, right = (np.concatenate(c) for c in zip(*found))
    pair = np.unique(left * len(entries) + right)
    return pair // len(entries), pair % len(entries)


def vocabulary(docs: DataFrame, least: int = 7, often: int = 2, garble: int = 31) -> DataFrame:
    """word, n: runs of letters, A-Z as a-z, with ``least`` letters or more that occur ``often`` times or more.

    Where ``garble`` divides the crc32 of "<doc_id>:<run>", the run loses its letter number crc32 % length (0: no run does).
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(
        F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    if garble:
        # Equal runs of a document are garbled alike, so they are counted first.
        runs = runs.groupBy("doc_id", "run").agg(F.count("*").alias("n"))
        h = F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary"))
        place = (h % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), place), F.substr("run", place + 2))
        runs = runs.select(F.when(h % garble == 0, cut).otherwise(F.col("run")).alias("word"), "n").filter(F.length("word") >= least)
    else:
        runs = runs.select(F.col("run").alias("word"), F.lit(1).cast("long").alias("n"))
    return runs.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def _routed(words: DataFrame) -> DataFrame:
    """half (with its kind and length), role (0: entry, 1: asking), word, n."""
    size = F.length("word")

    def part(kind: str, letters):
        text = F.when(letters > 0, F.left("word", letters) if kind == "a" else F.right("word", letters))
        return F.concat(F.lit(kind), letters.cast("string"), F.lit(":"), text)
    lengths = [F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int"), F.floor((size + 1) / 2).cast("int")]
    lasts = [(size + k - F.floor((size + k) / 2)).cast("int") for k in (0, -1, 1)]
    entry = F.array_distinct(F.array(*[part("a", x) for x in lengths], *[part("b", x) for x in lasts]))
    asks = F.array(part("a", lengths[0]), part("b", lasts[0]))
    both = F.concat(F.transform(entry, lambda h: F.struct(h.alias("half"), F.lit(0).alias("role"))), F.transform(asks, lambda h: F.struct(h.alias("half"), F.lit(1).alias("role"))))
    return words.select(F.inline(both), "word", "n").filter("half is not null")


def near_pairs(words: DataFrame, part: int = PART) -> DataFrame:
    """word, near, near_n for every two words of ``words`` (word, n; distinct; a written table) that differ by one letter."""
    routed = _routed(words)
    # Halves of one word alone need no search.
    sizes = staged(routed.filter("role = 0").groupBy("half").agg(F.count("*").alias("size")).filter("size > 1"), "half-sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    buckets = max(shuffle_partitions(words.sparkSession), -(-total // part))
    rows = routed.join(sizes, "half").withColumn("blocks", F.ceil(F.col("size") / part).cast("int"))
    # A half with few words shares a bucket with others; one with many has groups of its own, each block of entries with each of askers.
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    several = F.col("blocks") > 1
    rows = rows.select(
        "role", "word", "n", F.substring("half", 1, 1).alias("kind"),
        F.when(several, F.xxhash64("half")).otherwise(F.pmod(F.xxhash64("half"), F.lit(buckets))).alias("bucket"),
        F.when(several, F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("other"))).otherwise(0).alias("entries"),
        F.when(several, F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("own"))).otherwise(0).alias("askers"))

    def search(key, table):
        last = key[0].as_py() == "b"
        role = table.column("role").to_numpy()
        texts = [w.encode("latin-1")[::-1] if last else w.encode("latin-1") for w in table.column("word").to_pylist()]
        entries = {texts[i]: i for i in np.flatnonzero(role == 0)}  # a word may come by two of its halves
        asking = [texts[i] for i in np.flatnonzero(role == 1)]
        left, right = near_words(list(entries), asking, last) if entries and asking else (np.empty(0, np.int64),) * 2
        left, right = np.flatnonzero(role == 1)[left], np.array(list(entries.values()), np.int64)[right]
        word, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
        return pa.table({"word": word.take(pa.array(left)), "near": word.take(pa.array(right)), "near_n": n.take(pa.array(right))})
    found = rows.groupBy("kind", "bucket", "entries", "askers").applyInArrow(search, "word string, near string, near_n long")
    return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root for ``forms`` (word, form; a written table): forms followed to the last, by doubling.

    A form occurs many times as often as its word, so the chains are short.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        later = staged(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if later.filter("moved").isEmpty():
            return later.select("word", "root")
        now = later.select("word", "root")


def spelling_forms(docs: DataFrame, least: int = 7, often: int = 2, times: int = 10, garble: int = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary of ``docs``.

    Words: maximal runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z as a-z, garbled as ``vocabulary`` states, with ``least``
    letters and ``often`` occurrences. n_near words differ from it by one letter put in, deleted or replaced; form is the most frequent
    of them (ties: the first in code-point order) if it occurs ``times`` times as often, else null, with form_n occurrences; root is the last of the forms' forms,
    or the word itself. Null and empty texts have no words; a null doc_id counts as an empty one; repeated rows count each;
    other columns are not looked at. No words: no rows. ``least`` must be 2 at least.
    """
    if least < 2:
        raise ValueError("words need two letters, so that both halves have one")
    words = staged(vocabulary(docs, least, often, garble), "vocabulary")
    # The largest n first, and of equal ones the first word.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    rows = staged(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n")), "word-forms")
    last = roots(rows.filter("form is not null").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
