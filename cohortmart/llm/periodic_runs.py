"""Periodic stretches of words: Re-Pair grammars, runs across the boundary of each nonterminal, translated to its places."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortmart.llm.common import crc_sql, fresh, table, words
from cohortmart.llm.ngrams import mix

#: A run has so many words at least, and repeats its period so often.
LEAST, TIMES = 24, 3
#: Words that one grammar is made of, about: whole texts are gathered until there are so many.
BATCH_WORDS = 1_000_000
#: Candidate periods that are compared at once.
AT_ONCE = 1_000_000
GRAM = 4
#: Primes and bases of the two hashes that stretches are compared by; final runs are compared word by word.
PRIME = (2**31 - 1, 2**31 - 19)
BASES = ((1_103_515_245, 1_664_525), (22_695_477, 134_775_813), (1_140_671_485, 214_013))


def _rules(seq: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Symbol, start, middle and end of each place where a nonterminal derives its words, round by round.

    In a round every pair of neighbours that is more frequent than the pairs it overlaps is replaced, all its places at
    once; a pair is replaced only if it has two places at least. What is left of a text in the end is halved: its symbols
    are paired from the left until there is one.
    """
    n = len(seq)
    start, end = np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64)
    symbols, width = int(seq.max(initial=-1)) + 1, 3 * n + 1
    known, named = np.zeros(0, np.int64), np.zeros(0, np.int64)
    live = np.ones(max(0, n - 1), bool)
    while len(seq) > 1:
        at = np.flatnonzero(live & (own[1:] == own[:-1]))
        pair, inverse, counts = np.unique(seq[at] * width + seq[at + 1], return_inverse=True, return_counts=True)
        frequency = counts[inverse]
        live[:] = False
        often = frequency > 1
        at, inverse, frequency = at[often], inverse[often], frequency[often]
        live[at] = True
        order = np.full(len(seq) + 1, -1, np.int64)
        order[at + 1] = frequency * len(pair) + inverse
        peak = at[(order[at + 1] >= order[at]) & (order[at + 1] >= order[at + 2])]
        # Neighbouring peaks are of one pair of one word: every other one is replaced.
        first = np.flatnonzero(np.diff(peak, prepend=-2) > 1)
        offset = peak - np.repeat(peak[first], np.diff(np.append(first, len(peak))))
        peak = peak[offset % 2 == 0]
        of = np.searchsorted(pair, seq[peak] * width + seq[peak + 1])
        used = np.bincount(of, minlength=len(pair))
        peak, of = peak[used[of] > 1], of[used[of] > 1]
        if not len(peak):
            break
        chosen, number = np.unique(of, return_inverse=True)
        there = np.minimum(np.searchsorted(known, pair[chosen]), max(0, len(known) - 1))
        old = known[there] == pair[chosen] if len(known) else np.zeros(len(chosen), bool)
        name = np.where(old, named[there] if len(known) else 0, symbols + np.cumsum(~old) - 1)
        symbols += int((~old).sum())
        known, named = np.append(known, pair[chosen][~old]), np.append(named, name[~old])
        by_key = np.argsort(known)
        known, named = known[by_key], named[by_key]
        yield name[number], start[peak], start[peak + 1], end[peak + 1], own[peak]
        touched = np.zeros(len(seq), bool)
        touched[peak] = True
        seq[peak], end[peak] = name[number], end[peak + 1]
        keep = np.ones(len(seq), bool)
        keep[peak + 1] = False
        live = np.append(live, False)[keep][:-1]
        seq, start, end, own, touched = seq[keep], start[keep], end[keep], own[keep], touched[keep]
        live |= touched[1:] | touched[:-1]
    while len(seq) > 1:
        first = np.flatnonzero(np.diff(own, prepend=-1))
        place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
        left = np.flatnonzero((place[:-1] % 2 == 0) & (own[1:] == own[:-1]))
        if not len(left):
            break
        yield symbols + np.arange(len(left)), start[left], start[left + 1], end[left + 1], own[left]
        symbols += len(left)
        end[left] = end[left + 1]
        keep = np.ones(len(seq), bool)
        keep[left + 1] = False
        seq, start, end, own = seq[keep], start[keep], end[keep], own[keep]


class _Compare:
    """Lengths of equal stretches by two polynomial hashes of all prefixes."""

    def __init__(self, ids: np.ndarray, bases: tuple[int, int]):
        self.parts = []
        for prime, base in zip(PRIME, bases, strict=True):
            power = np.ones(1, np.uint64)
            while len(power) <= len(ids):
                step = np.uint64(pow(base, len(power), prime))
                power = np.concatenate([power, power * step % np.uint64(prime)])
            value = mix(ids.astype(np.uint64) + np.uint64(base)) % np.uint64(prime)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[: len(ids)] % np.uint64(prime))]) % np.uint64(prime)
            self.parts.append((np.uint64(prime), power, sums))

    def _equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.ones(len(i), bool)
        for prime, power, sums in self.parts:
            near, far = (sums[i + size] + prime - sums[i]) % prime, (sums[j + size] + prime - sums[j]) % prime
            out &= near * power[j - i] % prime == far
        return out

    def _longest(self, most: np.ndarray, equal) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            same = equal(open_, middle)
            low[open_[same]], high[open_[~same]] = middle[same], middle[~same] - 1
        return low

    def forward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from i and from j > i on are the same, up to `most`."""
        return self._longest(most, lambda k, size: self._equal(i[k], j[k], size))

    def backward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before i and before j > i are the same, up to `most`."""
        return self._longest(most, lambda k, size: self._equal(i[k] - size, j[k] - size, size))


class _Grams:
    """Places of equal stretches of GRAM words, in order."""

    def __init__(self, ids: np.ndarray):
        h = np.zeros(max(0, len(ids) - GRAM + 1), np.uint64)
        for k in range(GRAM):
            h = mix(h + ids[k : k + len(h)].astype(np.uint64) + np.uint64(1))
        self.hash, self.size = h, len(ids) + 1
        order = np.argsort(h, kind="stable")
        group = np.cumsum(np.diff(h[order], prepend=h[order][:1]) != 0)
        self.keys = group * self.size + order
        self.order = order
        self.group = np.empty(len(h), np.int64)
        self.group[order] = group
        self.rank = np.empty(len(h), np.int64)
        self.rank[order] = np.arange(len(h))

    def upto(self, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the same stretches after `at`, up to place `last`: first rank and number."""
        low = self.rank[at] + 1
        return low, np.maximum(0, np.searchsorted(self.keys, self.group[at] * self.size + last, "right") - low)

    def since(self, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the same stretches before `at`, from place `first` on."""
        low = np.searchsorted(self.keys, self.group[at] * self.size + first, "left")
        return low, np.maximum(0, self.rank[at] - low)


def _expanded(count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index of the entry and number within it, for each of its `count` candidates, about AT_ONCE at a time."""
    done = np.cumsum(count)
    cut = np.unique(np.searchsorted(done, np.arange(0, done[-1] + AT_ONCE, AT_ONCE), "right")) if len(done) else np.zeros(0, np.int64)
    for low, high in zip(np.append(0, cut), np.append(cut, len(count)), strict=True):
        if count[low:high].sum():
            entry = np.repeat(np.arange(low, high), count[low:high])
            yield entry, np.arange(len(entry)) - np.repeat(done[low:high] - count[low:high] - (done[low - 1] if low else 0), count[low:high])


def _needed(q: np.ndarray) -> np.ndarray:
    """Words that the larger side of a boundary has beyond a period, at least."""
    return (np.maximum(LEAST, TIMES * q) + 1) // 2 - q


def crossing_runs(ids: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray, bases: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """Node, start, end and period of the runs within ids[low:high] that cross mid, maximal within these words.

    The larger side of a run has more than half of it, so a stretch at the boundary comes again one period away on that
    side. Places of equal stretches of four words give the candidate periods, hashes how far they reach. A multiple of a
    smaller period spans the same words, so of equal spans the smallest period stays.
    """
    grams, compare = _Grams(ids), _Compare(ids, bases)
    found = []
    most = (high - low) // TIMES
    right = np.flatnonzero(mid + GRAM <= high)
    first, count = grams.upto(mid[right], np.minimum(high[right] - GRAM, mid[right] + most[right]))
    for entry, k in _expanded(count):
        node = right[entry]
        b = mid[node]
        q = grams.order[first[entry] + k] - b
        need = _needed(q)
        fits = b + q + need <= high[node]
        node, b, q, need = node[fits], b[fits], q[fits], need[fits]
        same = grams.hash[b + need - GRAM] == grams.hash[b + q + need - GRAM]
        node, b, q = node[same], b[same], q[same]
        after = compare.forward(b, b + q, high[node] - b - q)
        before = compare.backward(b, b + q, b - low[node])
        found.append((node, b - before, b + q + after, q))
    left = np.flatnonzero(mid - GRAM >= low)
    at = mid[left] - GRAM
    first, count = grams.since(at, np.maximum(low[left], at - most[left]))
    for entry, k in _expanded(count):
        node = left[entry]
        b = mid[node]
        q = b - GRAM - grams.order[first[entry] + k]
        need = _needed(q)
        fits = b - q - need >= low[node]
        node, b, q, need = node[fits], b[fits], q[fits], need[fits]
        same = grams.hash[b - need] == grams.hash[b - q - need]
        node, b, q = node[same], b[same], q[same]
        before = compare.backward(b - q, b, b - q - low[node])
        after = compare.forward(b - q, b, high[node] - b)
        found.append((node, b - q - before, b + after, q))
    node, s, e, q = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
    long = e - s >= np.maximum(LEAST, TIMES * q)
    node, s, e, q = node[long], s[long], e[long], q[long]
    order = np.lexsort((q, e, s, node))
    node, s, e, q = node[order], s[order], e[order], q[order]
    new = (np.diff(node, prepend=-1) != 0) | (np.diff(s, prepend=-1) != 0) | (np.diff(e, prepend=-1) != 0)
    return node[new], s[new], e[new], q[new]


def find_runs(ids: np.ndarray, own: np.ndarray, bases: tuple[tuple[int, int], ...] = BASES) -> tuple[np.ndarray, ...]:
    """Text, start, end and smallest period of every run, in this order; ids are the words of all texts, own their texts.

    One grammar serves all texts. Runs across a nonterminal's boundary are sought once, at its first place, and moved to
    all its places. A run of a text crosses the boundary of the lowest nonterminal that holds it, and is found there whole;
    what is found of it in lower ones lies inside and goes.
    """
    symbol, low, mid, high, owner = [], [], [], [], []
    for s, a, b, c, o in _rules(ids.astype(np.int64), own.astype(np.int64)):
        large = c - a >= LEAST
        for out, x in zip((symbol, low, mid, high, owner), (s, a, b, c, o), strict=True):
            out.append(x[large])
    none = (np.zeros(0, np.int64),) * 4
    if not sum(map(len, symbol)):
        return none
    symbol, low, mid, high, owner = map(np.concatenate, (symbol, low, mid, high, owner))
    _, first, node_of = np.unique(symbol, return_index=True, return_inverse=True)
    node, s, e, q = crossing_runs(ids, low[first], mid[first], high[first], bases[0])
    # To all places of the nodes that have runs.
    by_node = np.argsort(node_of, kind="stable")
    begin = np.searchsorted(node_of[by_node], node)
    times = np.searchsorted(node_of[by_node], node, "right") - begin
    run = np.repeat(np.arange(len(node)), times)
    place = by_node[np.repeat(begin, times) + np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)]
    move = low[place] - low[first][node[run]]
    text, s, e, q = owner[place], s[run] + move, e[run] + move, q[run]
    order = np.lexsort((-e, s, q, text))
    text, s, e, q = text[order], s[order], e[order], q[order]
    group = np.cumsum((np.diff(text, prepend=-1) != 0) | (np.diff(q, prepend=-1) != 0))
    reach = np.maximum.accumulate(e + group * (len(ids) + 1))
    whole = np.append(True, e[1:] + group[1:] * (len(ids) + 1) > reach[:-1]) if len(e) else np.zeros(0, bool)
    text, s, e, q = text[whole], s[whole], e[whole], q[whole]
    order = np.lexsort((q, e, s, text))
    text, s, e, q = text[order], s[order], e[order], q[order]
    smallest = (np.diff(text, prepend=-1) != 0) | (np.diff(s, prepend=-1) != 0) | (np.diff(e, prepend=-1) != 0)
    text, s, e, q = text[smallest], s[smallest], e[smallest], q[smallest]
    if not all(np.array_equal(ids[a : b - p], ids[a + p : b]) for a, b, p in zip(s, e, q, strict=True)):
        if len(bases) == 1:
            raise ValueError("stretches of words that differ have equal hashes under all bases")
        return find_runs(ids, own, bases[1:])
    order = np.lexsort((q, s, text))
    return text[order], s[order], e[order], q[order]


def runs_of_texts(texts: list[str | None]) -> Iterator[tuple[list[tuple[int, int, int]], int, str]]:
    """For each text the runs as (start, length, period), the number of words, and the words that stay, parted by spaces."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    text, s, e, q = find_runs(ids, np.repeat(np.arange(len(texts)), sizes))
    begin = np.cumsum(sizes) - sizes
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    for k, each in enumerate(split):
        at = slice(cut[k], cut[k + 1])
        a, b, p = s[at] - begin[k], e[at] - begin[k], q[at]
        kept = each
        if len(a):
            steps = np.zeros(len(each) + 1, np.int64)
            np.add.at(steps, a + p, 1)
            np.add.at(steps, b, -1)
            kept = [each[i] for i in np.flatnonzero(np.cumsum(steps)[:-1] == 0)]
        yield list(zip(a.tolist(), (b - a).tolist(), p.tolist(), strict=True)), len(each), b" ".join(kept).decode("utf-8", "surrogatepass")


RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def repeated_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, runs (start, length, period, by start and period) and collapsed: the text without repetitions.

    Words are parted by ASCII white space. A run has 24 words and three periods at least, its period is the smallest, and no
    neighbouring word goes on with it. A word is left out of `collapsed` if it is in a run beyond that run's first period.
    Null, empty and blank texts have no words, no runs and an empty `collapsed`; repeated rows each get their result. A text
    is one grammar's at least, whatever its length; columns of these names that are there already are replaced. Nothing is
    shuffled.
    """
    kept = [c for c in docs.columns if c != text_col and c.lower() not in ("n_words", "runs", "collapsed")]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("n_words", T.LongType()).add("runs", T.ArrayType(RUN)).add("collapsed", T.StringType())
    (given,) = fresh(docs, "given_text")
    run = pa.struct([(f.name, pa.int64()) for f in RUN])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept))
            size = np.cumsum(np.array([len(t.as_py() or "") // 6 for t in texts]))
            done = 0
            while done < len(texts):
                before = size[done - 1] if done else 0
                upto = max(done + 1, int(np.searchsorted(size, before + BATCH_WORDS, "right")))
                part = batch.slice(done, upto - done)
                got = list(runs_of_texts(part.column(len(kept)).to_pylist()))
                runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in g[0]] for g in got], pa.list_(run))
                columns = [*part.columns[: len(kept)], pa.array([g[1] for g in got], pa.int64()), runs, pa.array([g[2] for g in got], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_words", "runs", "collapsed"])
                done = upto

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(given)).mapInArrow(search, schema)


def with_tails(doc_id: Column, text: Column) -> Column:
    """The contract's texts: those whose crc32 of the id ends in 0 get a periodic end, the others are as they are."""
    w = words(text)
    n = F.size(w).cast("long")
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    period = F.slice(w, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), 1, (n - a).cast("int"))
    made = F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_tails(F.col("doc_id"), F.col("text")).alias("text"))
    found = repeated_runs(docs)
    # The greatest length / period: by products of whole numbers, ties by start and period, the order the runs are in.
    best = F.reduce("runs", F.lit(None).cast(RUN), lambda x, r: F.when(x.isNull() | (r["length"] * x["period"] > x["length"] * r["period"]), r).otherwise(x))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000L * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_SQL = r"""
WITH d0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0, {crc} AS h FROM documents),
d1 AS (SELECT doc_id, w0, h, len(w0) AS n, h // 10 AS g FROM d0),
d2 AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM d1),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN list_concat(w0[1:a], list_transform(range(n - a), lambda i: w0[a + i % p + 1])) ELSE w0 END AS w FROM d2),
t AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 3),
r0 AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l
       FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m)
       GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT doc_id, s, l, min(q) AS q FROM r0 GROUP BY doc_id, s, l),
runs AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
best AS (SELECT * FROM r r1 WHERE NOT EXISTS (SELECT 1 FROM r r2 WHERE r2.doc_id = r1.doc_id AND (r2.l * r1.q > r1.l * r2.q
         OR (r2.l * r1.q = r1.l * r2.q AND (r2.s < r1.s OR (r2.s = r1.s AND r2.q < r1.q)))))),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE = _SQL.replace("{crc}", crc_sql("doc_id"))
