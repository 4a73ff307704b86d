"""Secret scans: a random forest tells secrets from other long strings.

Candidates are runs without white space and their parts between quotes, commas, braces, ampersands and assignment signs, if
they have at least LEAST characters or are assigned to a name; values of telling names are taken whatever they are. Features:
length, transitions between kinds of characters and between letters, share covered by dictionary words, the path, and the
neighbouring words. The forest is trained on labelled findings. Where there are none, findings with known labels are planted:
made secrets, and decoys that look like them, in copies of texts of the corpus; the labels come from what was planted,
not from the features.
"""

from __future__ import annotations

import math
import random
import re
import string
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmart.llm.common import below, stored, table

LEAST = 14
#: Texts that secrets and decoys are planted in, one in each: about so many at most.
PLANT_TEXTS = 4_000
#: A dictionary word is held by two texts at least, and by such a share of all texts or of those of one folder or language.
DICTIONARY_SHARE = 1e-4
#: A dictionary of so many words at most is broadcast, as hashes of eight bytes; a larger one is joined by a shuffle.
DICTIONARY_BROADCAST = 2_000_000
#: Characters of dictionary words that are looked for within a value.
SHORTEST, LONGEST = 4, 12
TREES, LEVELS = 20, 6
BEFORE, AFTER, PATH = 24, 8, 4

CHUNK = re.compile(r"(?<!\S)(?:\S{%d,}|[^\s:=]*[:=]\S*)" % LEAST)
#: Parts of a run, and parts of those, which keep padding signs at their end.
SEGMENT = re.compile(r"""[^"'`,;{}\[\]()<>&?|]+""")
PIECE = re.compile(r"[^:=]+(?:={1,2}(?![^:=]))?")
ASSIGNED = re.compile(r"""([A-Za-z_][A-Za-z0-9_.-]*)["'`]*[:=]+>?["'`(\[{<]*$""")
TELLING = re.compile(r"""(?i:password|passwd|pwd|secret|token|api[_-]?key)["'`]*\s*[:=]+>?\s*["'`(\[{<]*([^\s"'`,;{}\[\]()<>&]+)""")
NAME = re.compile(r"([A-Za-z_][A-Za-z0-9_.-]*)[:=]+")
OPENING, CLOSING = "\"'([{<", "\"')]}>.,:;!?"
WORD = re.compile(r"[^\W\d_]{4,}")
TEST_PATH = re.compile(r"test|mock|example|sample|fixture|doc", re.I)

FINDING = "doc_id long, path string, start long, end long, value string, key string, before string, after string, label int"


def value_of(run: str) -> tuple[int, int, str]:
    """Start and end of the value of a run, and the name that it is assigned to or ''."""
    a = len(run) - len(run.lstrip(OPENING))
    name = NAME.match(run, a)
    if name:
        a = name.end()
        a += len(run) - a - len(run[a:].lstrip(OPENING))
    return a, max(a, len(run.rstrip(CLOSING))), name[1] if name else ""


def candidates(text: str) -> dict[tuple[int, int], str]:
    """Start and end of each candidate of a text, in order, with the name it is assigned to within its run or ''."""
    found: dict[tuple[int, int], str] = {}

    def take(start: int, end: int, key: str) -> None:
        if end > start and (key or end - start >= LEAST) and not found.get((start, end)):
            found[start, end] = key

    for m in CHUNK.finditer(text):
        a, b, key = value_of(m[0])
        if b - a >= LEAST:
            take(m.start() + a, m.start() + b, key)
        for part in SEGMENT.finditer(m[0]):
            for piece in (part, *PIECE.finditer(m[0], part.start(), part.end())):
                a, b = piece.span()
                inner = value_of(m[0][a:b]) if piece is part else (0, 0, "")
                if inner[2]:
                    take(m.start() + a + inner[0], m.start() + a + inner[1], inner[2])
                else:
                    name = ASSIGNED.search(m[0], max(0, a - 80), a)
                    take(m.start() + a, m.start() + a + len(m[0][a:b].rstrip(".!")), name[1] if name else "")
    for m in TELLING.finditer(text):
        a, b = m.start(1), m.start(1) + len(m[1].rstrip(".!?:"))
        if b > a:
            found.setdefault((a, b), "")
    return dict(sorted(found.items()))


def _found(doc_id: int | None, path: str | None, text: str) -> Iterator[tuple]:
    for (start, end), key in candidates(text).items():
        yield doc_id, path, start, end, text[start:end], key, text[max(0, start - 60) : start], text[end : end + 60]


def findings(docs: DataFrame, path_col: str = "source") -> DataFrame:
    """One row for each candidate of each text, without a label; offsets in code points, end exclusive. Null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*row, None) for doc_id, path, text in zip(pdf["doc_id"], pdf["path"], pdf["text"], strict=True) for row in _found(doc_id, path, text)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FINDING.split(", ")], dtype=object)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(path_col).alias("path"), "text").where(F.col("text").isNotNull()).mapInPandas(run, FINDING)


def made_secret(rng: random.Random) -> tuple[str, str]:
    """A secret and what it stands in, with {} for it."""
    letters, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    some = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    kind = rng.randrange(6)
    if kind == 0:
        value = some(hexes, rng.choice((32, 40, 48, 64)))
    elif kind == 1:
        value = some(letters + "-_", rng.randrange(20, 48))
    elif kind == 2:
        value = rng.choice(("AKIA", "ASIA")) + some(string.ascii_uppercase + string.digits, 16)
    elif kind == 3:
        value = rng.choice(("ghp_", "sk_live_", "xoxb-")) + some(letters, rng.randrange(24, 40))
    elif kind == 4:
        value = some(letters, rng.randrange(7, 14)) + rng.choice("!#*+") + some(string.digits, 2)
    else:
        value = some(string.ascii_lowercase, rng.randrange(20, 34))
    name = rng.choice(("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "auth_token", "client_secret", "access_key"))
    name = name.upper() if rng.random() < 0.3 else name
    frames = (name + "={}", name + ' = "{}"', name + ": {}", '{{"user":"a","' + name + '":"{}"}}', "the " + name + " is {}", name + " {}", "https://x.org/a?b=1&" + name + "={}", "Authorization: Bearer {}")
    return value, rng.choice(frames)


def made_decoy(rng: random.Random, words: list[str]) -> tuple[str, str]:
    """What looks like a secret and is none: hashes, ids, numbers, names, paths, placeholders."""
    hexes = "0123456789abcdef"
    some = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    word = lambda: rng.choice(words)
    makers = (
        lambda: (some(hexes, 40), rng.choice(("commit {} was merged", "at revision {}", "commit: {}"))),
        lambda: (some(hexes, rng.choice((32, 64))), rng.choice(("sha256:{}", "md5={}", 'etag="{}"', "checksum {}", "digest: {}"))),
        lambda: (str(uuid.UUID(int=rng.getrandbits(128))), rng.choice(("id={}", "request {}", "uuid: {}", "trace_id={}"))),
        lambda: (some(string.digits, rng.randrange(14, 20)), rng.choice(("{}", "order {}", "number={}", "id: {}"))),
        lambda: ("-".join((word(), word(), str(rng.randrange(1990, 2030)), word())), rng.choice(("see {} now", "name={}", "{}"))),
        lambda: ("/".join(("src", word(), word(), word() + ".txt")), rng.choice(("in {}", "file={}", "path: {}"))),
        lambda: (f"{word()}.{word()}@{word()}.org", rng.choice(("mail {}", "user={}"))),
        lambda: (f"https://{word()}.org/{word()}/{word()}", rng.choice(("{}", "url={}", 'href="{}"'))),
        lambda: ("".join(x.title() for x in (word(), word(), word())), rng.choice(("{}", "class {}", "type={}"))),
        lambda: (rng.choice(("changeme", "example", "your-password-here", "xxxxxxxxxxxx", "placeholder", "undefined", "required", "password")), rng.choice(("password={}", "token: {}", 'secret = "{}"', "api_key={}"))),
        lambda: (rng.choice(("getToken", "os.environ", "config.password", "user.secret")), rng.choice(("password={}", "token = {}", "secret: {}"))),
        lambda: (f"20{rng.randrange(10, 30)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}T{rng.randrange(24):02d}:{rng.randrange(60):02d}:00Z", rng.choice(("{}", "time={}", "expires: {}"))),
        lambda: (word() + word() + word(), "{}"),
    )
    return rng.choice(makers)()


def planted_findings(docs: DataFrame, path_col: str = "source", texts: int = PLANT_TEXTS) -> DataFrame:
    """Findings with labels: about `texts` texts, picked by a hash of the id, get a secret or a decoy each between two words.

    The candidate that is the planted secret has label 1, those within or around a decoy have label 0; others have none and
    are left out. What is planted depends on the id and the text alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(path_col).alias("path"), "text").where(F.col("text").isNotNull())
    n = rows.count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, path, text in zip(pdf["doc_id"], pdf["path"], pdf["text"], strict=True):
                rng = random.Random(zlib.crc32(f"{doc_id} {text[:1000]}".encode()))
                words = sorted({w.lower() for w in WORD.findall(text[:20_000])} - {""}) or ["word"]
                secret = rng.random() < 0.5
                value, frame = made_secret(rng) if secret else made_decoy(rng, words)
                left, right = frame.replace("{{", "{").replace("}}", "}").split("{}", 1)
                cut = text.find(" ", rng.randrange(len(text) + 1))
                cut = len(text) if cut < 0 else cut
                start = cut + 1 + len(left)
                end = start + len(value)
                near = f"{text[max(0, cut - 200) : cut]} {left}{value}{right}{text[cut : cut + 200]}"
                shift = max(0, cut - 200)
                for _, _, a, b, *rest in _found(doc_id, path, near):
                    a, b = a + shift, b + shift
                    if secret and (a, b) == (start, end) or not secret and a < end and start < b:
                        out.append((doc_id, path, a, b, *rest, int(secret)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FINDING.split(", ")], dtype=object)

    return rows.where(below(F.struct("doc_id", F.xxhash64("text")), min(1.0, texts / max(n, 1)))).mapInPandas(run, FINDING)


def dictionary(docs: DataFrame, path_col: str = "source") -> DataFrame:
    """word: of the words of SHORTEST to LONGEST letters in all texts, those that are common enough somewhere.

    The share is taken of all texts, of those of each folder and, where docs has a column lang, of those of each language, so
    a small source or a rare language keeps its words in a large corpus.
    """
    folder = F.regexp_replace(F.coalesce(F.col(path_col).cast("string"), F.lit("")), "/[^/]*$", "")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    texts = docs.where(F.col("text").isNotNull()).select(folder.alias("folder"), lang.alias("lang"), F.lower("text").alias("text"))
    held = texts.select("folder", "lang", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}{%d,}" % SHORTEST), 0))).alias("word"))
    counts = stored(held.where(F.length("word") <= LONGEST).groupBy("word", "folder", "lang").agg(F.count("*").alias("n")), "secret-words")
    sizes = stored(texts.groupBy("folder", "lang").agg(F.count("*").alias("n")), "secret-sizes")
    size = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    common = lambda words, of: words.where(F.col("n") >= F.greatest(F.lit(2.0), DICTIONARY_SHARE * of)).select("word")
    kept = common(counts.groupBy("word").agg(F.sum("n").alias("n")), F.lit(size))
    for by in ("folder", "lang"):
        part = counts.groupBy("word", by).agg(F.sum("n").alias("n")).join(sizes.groupBy(by).agg(F.sum("n").alias("size")), by)
        kept = kept.unionByName(common(part, F.col("size")))
    return stored(kept.distinct(), "secret-dictionary")


def known_words(found: DataFrame, words: DataFrame) -> DataFrame:
    """k1, k2, known: the dictionary words within each different value, by a join of its parts to the dictionary."""
    values = found.select("k1", "k2", "value").dropDuplicates(["k1", "k2"])

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int, str]] = []
        for pdf in batches:
            for k1, k2, value in pdf.itertuples(index=False):
                lowered = value.lower()
                for m in WORD.finditer(lowered):
                    for begin in range(m.start(), m.end(), 4096):  # long runs of letters in pieces, so memory is bounded
                        end = min(m.end(), begin + 4096 + LONGEST - 1)
                        some = {lowered[a:b] for a in range(begin, end - SHORTEST + 1) for b in range(a + SHORTEST, min(end, a + LONGEST) + 1)}
                        out += [(k1, k2, w) for w in some]
                        if len(out) > 100_000:
                            yield pd.DataFrame(out, columns=["k1", "k2", "word"])
                            out = []
        if out:
            yield pd.DataFrame(out, columns=["k1", "k2", "word"])

    keys = words.select(F.xxhash64("word").alias("key"))
    if words.count() <= DICTIONARY_BROADCAST:
        keys = F.broadcast(keys)
    some = values.mapInPandas(parts, "k1 long, k2 long, word string").withColumn("key", F.xxhash64("word"))
    return some.join(keys, "key", "left_semi").groupBy("k1", "k2").agg(F.collect_set("word").alias("known"))


def _kinds(value: str) -> np.ndarray:
    return np.array([0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in value], np.int8)


def featurize(value: str, key: str, before: str, after: str, path: str | None, known: set[str]) -> list[float]:
    kinds = _kinds(value)
    n = len(value)
    moves = np.bincount(kinds[:-1] * 4 + kinds[1:], minlength=16) / max(n - 1, 1)
    counts = np.array(list({c: value.count(c) for c in set(value)}.values())) / n
    entropy = float(-(counts * np.log2(counts)).sum())
    covered = np.zeros(n, bool)
    lowered = value.lower()
    for m in WORD.finditer(lowered):
        for a in range(m.start(), m.end() - SHORTEST + 1):
            for b in range(min(m.end(), a + LONGEST), a + SHORTEST - 1, -1):
                if lowered[a:b] in known:
                    covered[a:b] = True
                    break
    one = np.zeros(BEFORE + AFTER + PATH)
    left = (key or (before.split() or [""])[-1]).lower()
    if left.strip(":=\"'") == "" and len(before.split()) > 1:
        left = before.split()[-2].lower() + "="
    left += "=" if key else ""
    right = (after.split() or [""])[0].lower()
    one[zlib.crc32(left.encode()) % BEFORE] = 1
    one[BEFORE + zlib.crc32(right.encode()) % AFTER] = 1
    one[BEFORE + AFTER + zlib.crc32((path or "").rpartition("/")[0].encode()) % PATH] = 1
    return [
        math.log(n), entropy, float(kinds.tolist().count(2)) / n, float((np.diff(kinds) != 0).mean()) if n > 1 else 0.0,
        covered.mean(), float("@" in value), float("." in value), float(bool(key)), float(before.rstrip(" \"'").endswith(("=", ":"))),
        float(bool(TEST_PATH.search(path or ""))), (path or "").count("/"), float(bool(re.fullmatch("[0-9a-f]+", value))),
        *moves.tolist(), *one.tolist(),
    ]


N_FEATURES = 12 + 16 + BEFORE + AFTER + PATH


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the feature columns x0, x1, ... and drops the context."""
    keyed = stored(found.withColumns({"k1": F.xxhash64("value"), "k2": F.xxhash64(F.lit("b"), "value")}), "secret-candidates")
    with_words = keyed.join(known_words(keyed, words), ["k1", "k2"], "left")
    names = [f"x{k}" for k in range(N_FEATURES)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [featurize(*row, set() if known is None else set(known)) for *row, known in pdf[["value", "key", "before", "after", "path", "known"]].itertuples(index=False)]
            yield pd.concat([pdf[["doc_id", "start", "end", "label"]], pd.DataFrame(np.array(x, float).reshape(-1, N_FEATURES), columns=names, index=pdf.index)], axis=1)

    return with_words.mapInPandas(run, "doc_id long, start long, end long, label int, " + ", ".join(f"{c} double" for c in names))


def train(labelled: DataFrame, seed: int = 11):
    """A forest for featured findings with a label of 0 or 1, all of which are learned. None for one class."""
    if {r["label"] for r in labelled.select("label").distinct().collect()} != {0, 1}:
        return None
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=LEVELS, seed=seed)
    return forest.fit(_vectors(labelled.orderBy(*labelled.columns)).select("features", F.col("label").cast("double").alias("label")))


def _vectors(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"x{k}" for k in range(N_FEATURES)], outputCol="features").transform(found)


def scan_secrets(docs: DataFrame, path_col: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, start, end, score, is_secret: every candidate of docs with the forest's judgement.

    `labelled` are findings (FINDING) with labels to learn from, a bounded number; by default they are planted. Repeated rows
    give repeated findings. Without labels of both kinds the score is 0. Only doc_id, the path column, text and, for the
    dictionary, lang are read.
    """
    clean = docs.select("doc_id", path_col, "text")
    words = dictionary(docs, path_col)
    known = planted_findings(clean, path_col) if labelled is None else labelled.where("label IN (0, 1)")
    found = stored(featured(findings(clean, path_col).unionByName(known), words), "secret-findings")
    model = train(found.where("label IS NOT NULL"))
    own = found.where("label IS NULL")
    if model is None:
        return own.select("doc_id", "start", "end", F.lit(0.0).alias("score"), F.lit(False).alias("is_secret"))
    score = vector_to_array("probability")[1]
    return model.transform(_vectors(own)).select("doc_id", "start", "end", score.alias("score"), (score >= 0.5).alias("is_secret"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
