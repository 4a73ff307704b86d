"""Personal data: base patterns, and identifiers found through contexts that a bootstrap has learned from them.

Seed entities (the base spans) induce lexical patterns: the words on both sides of a value, the one or the two words before
it, the word after it, and the word on one side with the shape of the value. Patterns and values form a graph; scores go back and forth over it for some rounds. A pattern is as good as the share of its different
values that are believed to be personal data of one kind; a value that the base patterns miss is as good as the best
patterns that surround it. Values that good patterns agree on are added as spans. All of it are DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortmart.llm.common import stored, table

#: Kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the given patterns: the same matches without backtracking. A match begins where the one before ended or
#: where no character of its first class stands before, which is where the leftmost match begins anyway.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a cheap look at a text must find before a pattern is tried on it.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Candidates for new identifiers: words with a digit or an at-sign.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Runs of number words, which are candidates as a whole too.
_NUMBER = r"[+(]*+[0-9][0-9().,/+-]*+(?![^\x20\x09-\x0D])"
RUN = rf"(?<![^\x20\x09-\x0D]){_NUMBER}(?:[\x20\x09-\x0D]++{_NUMBER})++"
#: Marks that stand for the words beyond a text.
START, END = "\x02", "\x03"

ROUNDS = 3
#: A pattern counts from so many different values on, of which such a share must be of one kind.
SUPPORT, CONFIDENCE = 3, 0.8
#: A value must reach this score to be added.
ACCEPT = 0.8


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn check of a string of digits."""
    each = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.when(
            (F.length(digits) - i) % 2 == 1,
            F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int") + 1),
        ).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])?(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?){3}$")
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    return n.between(10, 15)


def _matches(text: Column, pattern: str, hint: str | None) -> tuple[Column, Column]:
    """The matches of a pattern and the gaps around them, by the same engine and so in step."""
    look = F.contains(text, F.lit(hint)) if hint else text.rlike("[0-9]")
    empty = F.array().cast("array<string>")
    return (
        F.when(look, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(empty),
        F.when(look, F.split(text, pattern, -1)).otherwise(empty),
    )


def _before(left: Column, gap: Column, words: int = 1) -> Column:
    """The word (or so many words) before a value: of the gap, or else of the match (or mark) that stands left of the gap."""
    more = r"(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)" + f"{{0,{words - 1}}}+"
    near = F.reverse(F.regexp_extract(F.reverse(F.concat(left, gap)), rf"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++{more})", 1))
    return F.lower(near)


def _after(gap: Column, right: Column) -> Column:
    return F.lower(F.regexp_extract(F.concat(gap, right), r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)", 1))


def _shape(value: Column) -> Column:
    """Runs of letters and of digits as one sign each."""
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}++", "a"), "[0-9]++", "9")


def _patterns(before: Column, two: Column, after: Column, shape: Column) -> Column:
    """Hashes of the patterns that a value stands in. A mark alone is none."""
    left, right = before != START, after != END
    each = {
        "both": (left | right, before, after), "left": (left, before), "right": (right, after), "two": (left & (two != before), two),
        "left shape": (left, before, shape), "right shape": (right, after, shape),
    }
    return F.array_compact(F.array(*[F.when(given, F.xxhash64(F.lit(name), *parts)) for name, (given, *parts) in each.items()]))


ALL_KINDS = (*KINDS, "other", "run")
#: Offsets are summed in blocks of so many matches, so that a text of very many matches takes no time of their square.
BLOCK = 256


def _running(values: Column, start: Column) -> Column:
    """Sums of the values before each one, from `start` on."""
    zero = F.struct(start.alias("s"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, zero, lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")), lambda acc: acc["out"])


def _with_starts(df: DataFrame) -> DataFrame:
    """Adds s_<kind>: where each match f_<kind> starts, in code points, from the gaps g_<kind> around the matches.

    One step to a projection: what a lambda looks at again and again has to be a column.
    """
    none = F.array().cast("array<int>")

    def step(df: DataFrame, made: Callable[[str], Column], to: str) -> DataFrame:
        return df.withColumns({f"{to}_{k}": made(k) for k in ALL_KINDS})

    def steps(k: str) -> Column:
        return F.transform(F.arrays_zip(F.col(f"f_{k}").alias("f"), F.slice(f"g_{k}", F.lit(2), F.size(f"f_{k}")).alias("g")), lambda x: F.length(x["f"]) + F.length(x["g"]))

    def blocks(k: str) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(f"n_{k}") - 1) / BLOCK).cast("int"))
        cut = F.transform(at, lambda b: F.slice(f"n_{k}", b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(f"n_{k}") > 0, cut).otherwise(F.array().cast("array<array<int>>"))

    def offsets(k: str) -> Column:
        totals = F.transform(f"b_{k}", lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v))
        return F.when(F.size(f"b_{k}") > 0, _running(totals, F.length(F.get(f"g_{k}", F.lit(0))))).otherwise(none)

    def starts(k: str) -> Column:
        pairs = F.arrays_zip(F.col(f"b_{k}").alias("b"), F.col(f"o_{k}").alias("o"))
        return F.flatten(F.transform(pairs, lambda x: _running(x["b"], x["o"])))

    for made, to in ((steps, "n"), (blocks, "b"), (offsets, "o"), (starts, "s")):
        df = step(df, made, to)
    return df


def _spans(kind: str) -> Column:
    """kind, start, end (code points), value and patterns (hashes) of the valid matches."""
    number = ALL_KINDS.index(kind)
    n = F.size(f"f_{kind}")
    zipped = F.arrays_zip(
        F.col(f"f_{kind}").alias("f"), F.slice(f"g_{kind}", F.lit(1), n).alias("a"), F.slice(f"g_{kind}", F.lit(2), n).alias("b"), F.col(f"s_{kind}").alias("s"),
        F.slice(F.concat(F.array(F.lit(START + " ")), f"f_{kind}"), F.lit(1), n).alias("l"), F.slice(F.concat(f"f_{kind}", F.array(F.lit(" " + END))), F.lit(2), n).alias("r"),
    )
    valid = zipped if kind not in KINDS else F.filter(zipped, lambda x: _valid(kind, x["f"]))
    return F.transform(
        valid,
        lambda x: F.struct(
            F.lit(number).alias("kind"), x["s"].alias("start"), (x["s"] + F.length(x["f"])).alias("end"), F.xxhash64(x["f"]).alias("value"),
            _patterns(_before(x["l"], x["a"]), _before(x["l"], x["a"], 2), _after(x["b"], x["r"]), _shape(x["f"])).alias("patterns"),
        ),
    )


def base_and_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base, candidates: spans of the base patterns, and of words with a digit or an at-sign and runs of number words."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("t"))
    cols: dict[str, Column] = {}
    for kind in KINDS:
        cols[f"f_{kind}"], cols[f"g_{kind}"] = _matches(F.col("t"), PATTERNS[kind], HINTS[kind])
    look = F.col("t").rlike("[0-9@]")
    empty = F.array().cast("array<string>")
    cols["f_other"] = F.when(look, F.regexp_extract_all("t", F.lit(CANDIDATE), 0)).otherwise(empty)
    cols["g_other"] = F.when(look, F.split("t", CANDIDATE, -1)).otherwise(empty)
    cols["f_run"], cols["g_run"] = _matches(F.col("t"), RUN, None)
    parts = _with_starts(keyed.select("doc_id", "text_key", *[c.alias(n) for n, c in cols.items()]))
    return parts.select(
        "doc_id", "text_key",
        F.array_sort(F.concat(*[_spans(k) for k in KINDS]), lambda a, b: _order(a, b)).alias("base"),
        F.concat(_spans("other"), _spans("run")).alias("candidates"),
    )


def _order(a: Column, b: Column) -> Column:
    key = lambda x: F.struct(x["start"], x["kind"], x["end"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def _occurrences(found: DataFrame) -> DataFrame:
    """doc_id, text_key, kind (null for candidates), start, end, value, pattern.

    A candidate that touches a base span is part of it and is left out. Spans are compared with those before and after them in
    the text only, so a text of very many spans takes no time of their square.
    """
    each = found.select("doc_id", "text_key", F.explode(F.concat("base", "candidates")).alias("s")).select("doc_id", "text_key", "s.*")
    seed = F.col("kind") < len(KINDS)
    text = Window.partitionBy("doc_id", "text_key")
    # Base spans come first among those that start together.
    up = text.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = text.orderBy(F.desc("start"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = each.withColumns({"reach": F.max(F.when(seed, F.col("end"))).over(up), "next": F.min(F.when(seed, F.col("start"))).over(down)})
    # A base span touches a candidate if it starts no later and reaches into it, or no earlier and begins within it.
    apart = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    kept = near.where(seed | apart).withColumn("kind", F.when(seed, F.col("kind")))
    return kept.select("doc_id", "text_key", "kind", "start", "end", "value", F.explode("patterns").alias("pattern"))


def bootstrap(occurrences: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE, accept: float = ACCEPT) -> DataFrame:
    """value, kind, belief of the values that the patterns vouch for, from an edge for each pattern and value.

    Each round scores patterns by the belief in their different values and then values by their patterns (1 less the
    product of the doubts). Values of the base patterns keep belief 1. Edges are counted before they are shuffled, so a
    context or a value that is very common is one edge for each partner.
    """
    edges = stored(occurrences.groupBy("pattern", "value").agg(F.max("kind").alias("seed")), "pii-edges")
    patterns = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count("seed").alias("seeds")).where((F.col("n") >= support) & (F.col("seeds") > 0))
    edges = stored(edges.join(patterns.select("pattern", "n"), "pattern"), "pii-graph")
    belief = None
    for _ in range(rounds):
        seeds = edges.where("seed IS NOT NULL").select("pattern", "value", "n", F.col("seed").alias("kind"), F.lit(1.0).alias("belief"))
        known = seeds
        if belief is not None:
            known = seeds.unionByName(edges.where("seed IS NULL").join(belief, "value").select("pattern", "value", "n", "kind", "belief"))
        rated = known.groupBy("pattern", "n", "kind").agg((F.sum("belief") / F.first("n")).alias("rate"), F.count("*").alias("k"))
        good = rated.where((F.col("rate") >= confidence) & (F.col("k") >= support - 1)).select("pattern", "kind", "rate")
        voted = edges.where("seed IS NULL").join(good, "pattern").groupBy("value", "kind")
        doubt = F.exp(F.sum(F.log(1.0 - F.col("rate") + F.lit(1e-6))))
        scored = voted.agg((1.0 - doubt).alias("belief"))
        best = scored.groupBy("value").agg(F.max_by(F.struct("kind", "belief"), F.struct("belief", -F.col("kind"))).alias("b"))
        belief = stored(best.select("value", "b.kind", "b.belief"), "pii-belief")
    return belief.where(F.col("belief") >= accept)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, **options: float) -> DataFrame:
    """doc_id, text_key, base, added, all: arrays of spans (kind, start, end; code points, end exclusive), in order.

    Null texts have no span. Rows that repeat an id are told apart by text_key, a hash of the text; equal rows get equal
    spans. Only doc_id and text are read.
    """
    found = stored(base_and_candidates(docs), "pii-spans")
    occurrences = stored(_occurrences(found), "pii-occurrences")
    believed = bootstrap(occurrences, **options).select("value", F.col("kind").alias("found"))
    new = occurrences.where("kind IS NULL").join(believed, "value").select("doc_id", "text_key", F.col("found").alias("kind"), "start", "end").distinct()
    # A word that is part of an added run is not a span of its own.
    before = Window.partitionBy("doc_id", "text_key").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    outer = new.withColumn("reach", F.max("end").over(before)).where("reach IS NULL OR reach < end")
    added = outer.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added")).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "added")
    slim = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    both = found.join(added, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    both = both.select("doc_id", "text_key", slim.alias("base"), F.coalesce("added", none).alias("added"))
    return both.withColumn("all", F.array_sort(F.concat("base", "added"), lambda a, b: _order(a, b)))


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_count("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))
