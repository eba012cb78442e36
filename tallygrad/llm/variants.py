"""Spelling variants: rare words next to a much more frequent word that differs in one code point.

Words are cut to grams of variable length. The dictionary holds every bigram and,
up to a longest length, the sequences frequent enough to be worth a gram of their
own; a word's grams are, at each place, the longest one in the dictionary, without
those another one covers. One edit at a given place can change only certain grams,
those that reach it or that a longer gram could carry there. What it cannot change
follows from the word's part before the place and its part behind it alone, so two
words one edit apart agree in all grams that are out of its reach. Lists are merged
under that bound at once: a word is listed under the combination of all grams that
an edit leaves alone, once for each distinct combination over its places, and words
that meet in a list are verified. The numbers of words in a list follow from what
fits between two grams, not from how common a gram is.

Every pair is found in the list of the place where the words first differ, and only
there, so nothing is counted twice and no pairs are sorted out afterwards.

Defined results: a null text has no runs; a null id counts as empty; rows alike
each count; other columns do not matter; without words the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallygrad.llm.store import kept

# Letters of a run, and one in so many runs that loses a code point.
LETTERS = r"[A-Za-zÀ-ÿ]+"
DAMAGED = 31
#: Least code points and occurrences of a word, and how many times as frequent a word's form is.
LEAST_POINTS, LEAST_COUNT, MORE_FREQUENT = 7, 2, 10

SHORTEST_GRAM, LONGEST_GRAM = 2, 4
#: A longer sequence is a gram if it makes up this share of all sequences of its length, which bounds the dictionary.
GRAM_SHARE = 1 / 500

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(docs: DataFrame, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """(word, n): distinct words of all texts with their occurrences, in 1 of ``damaged`` runs a code point taken out.

    A run is lower-cased (A-Z only); when ``damaged`` divides the crc32 h of
    ``<doc_id>:<run>``, its code point h % length is missing.
    """
    id_text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    runs = docs.select(id_text.alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS})"), 1)).alias("run"))
    # A shorter run gives no word, damaged or not.
    runs = runs.where(F.char_length("run") >= least_points).select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    short = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    found = hashed.select(F.when(F.col("h") % damaged == 0, short).otherwise(F.col("run")).alias("word"))
    counts = found.where(F.char_length("word") >= least_points).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least_count)


def gram_dictionary(
    vocabulary: DataFrame, longest: int = LONGEST_GRAM, share: float = GRAM_SHARE, shortest: int = SHORTEST_GRAM
) -> frozenset[str]:
    """Sequences of more than ``shortest`` letters that are frequent among the distinct words.

    For each length at most 1 / ``share`` sequences can reach the share, which
    bounds what the driver gets and the tasks carry. A sequence's parts are as
    frequent as itself, so the dictionary holds all beginnings of its grams.
    """
    found = None
    for size in range(shortest + 1, longest + 1):
        places = F.sequence(F.lit(1), F.greatest(F.char_length("word") - size + 1, F.lit(1)))
        cut = vocabulary.select(F.explode(F.transform(places, lambda i: F.col("word").substr(i, F.lit(size)))).alias("gram"))
        counts = cut.where(F.char_length("gram") == size).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        found = counts if found is None else found.unionByName(counts)
    if found is None:
        return frozenset()
    found = kept(found, "grams")
    totals = found.groupBy(F.char_length("gram").alias("size")).agg(F.sum("n").alias("total"))
    frequent = found.withColumn("size", F.char_length("gram")).join(F.broadcast(totals), "size")  # one row per length
    grams = {r.gram for r in frequent.where(F.col("n") >= F.col("total") * share).select("gram").collect()}
    # Shares are of different totals, so a part may miss its own by a little.
    return frozenset(g for g in grams if all(g[:k] in grams for k in range(shortest + 1, len(g))))


class Grams:
    """Variable grams of words under a dictionary, and what an edit leaves of them."""

    def __init__(self, dictionary: Iterable[str], shortest: int = SHORTEST_GRAM):
        self.shortest = shortest
        self.dictionary = frozenset(dictionary)
        self.longest = max(map(len, self.dictionary), default=shortest)
        #: Proper beginnings of longer grams.
        self.beginnings = {g[:k] for g in self.dictionary for k in range(1, len(g))}
        #: Parts of grams that something stands before.
        self.inner = {g[i:j] for g in self.dictionary for i in range(1, len(g)) for j in range(i + 1, len(g) + 1)}

    def of(self, word: str) -> list[tuple[int, int]]:
        """(start, end) of the word's grams in order; none lies inside another."""
        found, reach = [], 0
        for start in range(len(word) - self.shortest + 1):
            end = start + self.shortest
            for stop in range(min(len(word), start + self.longest), end, -1):
                if word[start:stop] in self.dictionary:
                    end = stop
                    break
            if end > reach:
                found.append((start, end))
                reach = end
        return found

    def _first_changed(self, word: str, at: int) -> int:
        """Smallest start whose gram an edit at ``at`` may change: from there on a gram could reach the place."""
        for start in range(max(0, at - self.longest + 1), at):
            # Any letter can follow in a bigram; longer grams need their beginning in the dictionary.
            if at - start < self.shortest or word[start:at] in self.beginnings:
                return start
        return at

    def _covered_until(self, word: str, behind: int) -> int:
        """Grams from ``behind`` on that end here at the latest may be covered by a gram that comes from before it."""
        end = min(len(word), behind + 1)  # the end of a bigram
        for stop in range(min(len(word), behind + self.longest - 1), end, -1):
            if word[behind:stop] in self.inner:
                return stop
        return end

    def left_alone(self, word: str) -> dict[tuple[int, int], list[list[int]]]:
        """Combinations of grams that an edit leaves alone, with the places of that edit.

        A combination is (end of the grams before it, start of those behind it,
        counted from the word's end). Its places are two ranges [first, last]:
        of code points replaced or taken out, and of gaps something is put in
        (before the code point with that number); [1, 0] is none.
        """
        grams = self.of(word)
        size = len(word)
        before, behind = [], []
        n = first = 0  # grams before the first changed one, and the first behind that is left alone
        for at in range(size + 1):
            changed = self._first_changed(word, at)
            while n < len(grams) and grams[n][0] < changed:
                n += 1
            before.append(grams[n - 1][1] if n else 0)
            until = self._covered_until(word, at)
            while first < len(grams) and (grams[first][0] < at or grams[first][1] <= until):
                first += 1
            behind.append(size - grams[first][0] if first < len(grams) else 0)
        found: dict[tuple[int, int], list[list[int]]] = {}
        for kind, shift in ((0, 1), (1, 0)):
            for at in range(size + 1 - shift):
                places = found.setdefault((before[at], behind[at + shift]), [[1, 0], [1, 0]])[kind]
                places[:] = [min(places[0], at), at] if places[0] <= places[1] else [at, at]
        return found


def _lists(vocabulary: DataFrame, grams: Grams) -> DataFrame:
    """(word, n, key, first, last, first_gap, last_gap): each word once for every combination it is listed under."""
    def listed(batches):
        for batch in batches:
            rows, keys, places = [], [], []
            for i, word in enumerate(batch.column("word").to_pylist()):
                for (before, behind), (replaced, gaps) in grams.left_alone(word).items():
                    rows.append(i)
                    keys.append(f"{word[:before]}\0{word[len(word) - behind:]}")
                    places.append((*replaced, *gaps))
            columns = np.array(places, np.int32).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("word").take(pa.array(rows, pa.int64())), batch.column("n").take(pa.array(rows, pa.int64())),
                 pa.array(keys, pa.string()), *(pa.array(c) for c in columns)],
                names=["word", "n", "key", "first", "last", "first_gap", "last_gap"],
            )

    schema = "word string, n bigint, key string, first int, last int, first_gap int, last_gap int"
    # A vocabulary is a small table and cutting words is the work, so it is dealt out to more tasks than its bytes ask for.
    tasks = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = vocabulary.select("word", "n").repartition(tasks, "word")
    return dealt.mapInArrow(listed, schema).withColumn("key", F.xxhash64("key"))


def near_words(vocabulary: DataFrame, grams: Grams) -> DataFrame:
    """(word, n, other, other_n): all pairs of words one edit apart, both ways round, each once.

    Words meet in their lists; a pair counts in the list of the place where the
    two first differ. Equal hashes of different keys only add pairs to verify.
    """
    lists = kept(_lists(vocabulary, grams), "gram-lists")
    mine = lists.withColumn("size", F.char_length("word"))
    theirs = lists.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    gap = F.col("size") < F.char_length("other")
    first = F.when(gap, F.col("first_gap")).otherwise(F.col("first"))
    last = F.when(gap, F.col("last_gap")).otherwise(F.col("last"))
    here = (F.substring(F.col("word"), F.lit(1), first) == F.substring(F.col("other"), F.lit(1), first)) & (
        F.substring(F.col("word"), F.lit(1), last + 1) != F.substring(F.col("other"), F.lit(1), last + 1)
    )
    sizes = F.abs(F.col("size") - F.char_length("other")) <= 1
    near = (F.col("word") != F.col("other")) & sizes & (first <= last) & here & (F.levenshtein("word", "other", 1) == 1)
    return mine.join(theirs, "key").where(near).select("word", "n", "other", "other_n")


def variant_groups(vocabulary: DataFrame, more_frequent: int = MORE_FREQUENT, **options) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of (word, n).

    The form is the near word of largest n (ties: the first in code-point order)
    if that is at least ``more_frequent`` times the word's; the root is where
    following forms ends. Counts grow by that factor with each step, so following
    takes no more rounds than the logarithm of the largest.
    """
    vocabulary = kept(vocabulary, "vocabulary")
    near = near_words(vocabulary, Grams(gram_dictionary(vocabulary, **options)))
    # Partial sums per task; a large count and a small word in one value that has an order.
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best")
    )
    joined = vocabulary.join(best, "word", "left")
    enough = -F.col("best.less") >= more_frequent * F.col("n")
    formed = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    formed = kept(formed, "forms")
    return formed.join(roots(formed.select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by doubling the steps each round until no root has a form."""
    steps = kept(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "steps")
    while True:
        next_step = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = kept(steps.join(next_step, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                  F.col("further").isNotNull().alias("moved")), "steps")
        if longer.where("moved").isEmpty():
            return longer.select("word", "root")
        steps = longer.select("word", "root")
