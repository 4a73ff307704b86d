"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import collections
import hashlib
import os
import re
import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortmart.llm import chat, decontaminate, jaccard_join, language_id, mixing, pii, pivot_index, secrets, token_orc, toxicity
from cohortmart.llm.common import scratch_path
from tests.conftest import rows

LONG = " ".join(f"w{k % 997}x{k}" for k in range(12_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rep long, kind int"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t, "en" if k % 2 else None, None if k % 3 == 0 else f"s{k % 3}", len(t or ""), 0.5, 7, 1) for k, t in enumerate(texts)], DOCS)


TEXTS = [None, "", "   \n\t", "one", "one two three four", "a b c d e f g h", "a b c d e f g h", "a  b\nc d e f g h", "ñandú ß 中文 x@y.de", LONG, LONG + " end", "1234567890"]


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_language_id(spark, docs, empty):
    train = docs_of(spark, ["the cat and the dog", "el gato y el perro"] * 20).selectExpr("doc_id", "text", "IF(doc_id % 2 = 0, 'en', 'es') AS lang")
    model = language_id.train(train)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert len(got) == len(TEXTS) and [got[k]["lang_pred"] for k in (0, 1, 2, 11)] == ["und"] * 4 and got[0]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[9]["lang_pred"] in ("en", "es")
    assert [r["lang_pred"] for r in language_id.identify(train, model).orderBy("doc_id").limit(2).collect()] == ["en", "es"]
    assert language_id.identify(empty, model).count() == 0
    none = language_id.train(train.where("lang IS NULL"))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}


def test_language_id_is_multinomial_naive_bayes(spark):
    """Scores against a plain computation over the n-grams of each text."""
    learned = ["the cat and the dog", "el gato y el perro", "der hund und die katze"] * 5 + ["and so on", "un dos tres", "ein zwei", "the end"]
    lang = [("en", "es", "de")[k % 3] for k in range(15)] + ["en", "es", "de", "en"]
    model = language_id.train(spark.createDataFrame(list(zip(range(19), learned, lang, strict=True)), "doc_id long, text string, lang string"))

    def grams(text):
        found = []
        for n in language_id.ORDERS:
            for k in range(len(text) - n + 1):
                points = np.array([ord(c) for c in text[k : k + n]])
                found.append(int(language_id.hashed_ngrams(points)[n - 1][0]))
        return found

    names = sorted(set(lang))
    counts = {y: collections.Counter(g for t, own in zip(learned, lang, strict=True) if own == y for g in grams(t)) for y in names}
    for text in ["the dog", "perro y gato", "Die Katze", "tres and zwei", "x", "the 12"]:
        odds = []
        for y in names:
            total = sum(counts[y].values()) + 0.5 * language_id.BUCKETS
            odds.append(np.log(lang.count(y) / 19) + sum(np.log((counts[y][g] + 0.5) / total) for g in grams(text.lower())))
        p = np.exp(np.array(odds) - max(odds))
        got, score = language_id.score_texts(model, [text])
        assert got == [names[int(np.argmax(odds))]] and abs(score[0] - p.max() / p.sum()) < 1e-4


def test_language_id_on_held_out_documents(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("test tables are not there")
    got = language_id.query(spark, "/root/testdata/sf0.01").where("held_out").select("doc_id", "lang_pred")
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang")
    both = [(r["lang"], r["lang_pred"]) for r in got.join(known, "doc_id").collect() if r["lang_pred"] != "und"]
    assert len(both) > 200 and np.mean([a == b for a, b in both]) > 0.98


def test_language_id_knows_letters():
    model = language_id.LanguageModel(["en"], np.zeros((1, language_id.BUCKETS), np.float32), np.zeros(1))
    assert language_id.score_texts(model, ["\u00bd \u00b2", "\u2163", "\u4e2d", "_", "1a"])[0] == ["und", "und", "en", "und", "en"]


def test_language_id_counts_long_texts_once():
    text = "abcdefghij" * 500
    from cohortmart.llm.ngrams import pieces

    whole = sum(len(h) for _, p, k in pieces([text], 2) for _, h in language_id.ngrams_of(p, k))
    parts = sum(len(h) for _, p, k in pieces([text], 2, 64) for _, h in language_id.ngrams_of(p, k))
    assert whole == parts == 3 * len(text) - 3


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, h1 string"
    turns = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "yo", "x"), (2, 0, "user", "hi", "x"), (3, 0, "user", "hi", "x"), (3, 1, "assistant", "yo", "x"), (3, 1, "assistant", "yo", "x"),
             (4, 0, "user", None, "x"), (5, None, None, "z", "x"), (None, 0, "user", "lost", "x"), (None, 0, "user", "lost", "y"), (6, 0, "user", "hi", "x"), (6, 1, "assistant", "other", "x"), (7, 0, "", "hi", "x")]
    got = rows(chat.format_chats(spark.createDataFrame(turns, schema)).select("conv_id", "n_turns", "n_copies", "chat"))
    want = [(1, 2, 2, "<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>\n"), (4, 1, 1, "<|user|>\n\n<|end|>\n"), (5, 1, 1, "<|>\nz\n<|end|>\n".replace("<|>", "<||>")), (None, 1, 1, "<|user|>\nlost\n<|end|>\n"),
            (6, 2, 1, "<|user|>\nhi\n<|end|>\n<|assistant|>\nother\n<|end|>\n"), (7, 1, 1, "<||>\nhi\n<|end|>\n")]
    assert got == sorted(want, key=repr)
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


def jaccard_truth(texts):
    def shingles(t):
        w = (t or "").split()
        n = min(5, len(w))
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()

    sets = [shingles(t) for t in texts]
    links = [{j for j, b in enumerate(sets) if j != i and a and b and 5 * len(a & b) >= 4 * len(a | b)} for i, a in enumerate(sets)]
    part = list(range(len(texts)))
    for _ in texts:
        for i, near in enumerate(links):
            part[i] = min([part[i], *[part[j] for j in near]])
    return [(i, part[i], len(links[i]), part[i] == i) for i in range(len(texts))]


def test_jaccard_join(spark, docs, empty):
    got = rows(jaccard_join.near_duplicates(docs).select("doc_id", "class_id", "n_links", "kept"))
    assert got == sorted(jaccard_truth(TEXTS), key=repr)
    assert jaccard_join.near_duplicates(empty).count() == 0
    kept = jaccard_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8, 9, 11]


def test_jaccard_join_of_a_family_larger_than_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(60):
        words = list(base)
        for at in rng.choice(120, k % 6, replace=False):
            words[at] = f"z{k}_{at}"
        texts.append(" ".join(words))
    texts += [" ".join(rng.permutation(base)) for _ in range(10)]
    original = jaccard_join.block_pairs
    monkeypatch.setattr(jaccard_join, "block_pairs", lambda m, key, member, *rest: original(m, key, member, 7, *rest[1:]))
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    got = rows(jaccard_join.near_duplicates(docs_of(spark, texts)).select("doc_id", "class_id", "n_links", "kept"))
    assert got == sorted(jaccard_truth(texts), key=repr)


def test_jaccard_join_of_repeated_ids_and_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"o{k}" for k in range(40))
    data = [(5, other), (5, text), (7, text + " y"), (3, other), (3, other), (None, "one two"), (None, None), (8, None), (8, None)]
    table = spark.createDataFrame([(i, t, k, k) for k, (i, t) in enumerate(data)], "doc_id long, text string, __lost long, key_a long")
    got = rows(jaccard_join.near_duplicates(table).select("doc_id", "class_id", "n_links", "kept"))
    want = [(5, 3, 2, False), (3, 3, 2, True), (3, 3, 2, False), (5, 5, 1, True), (7, 5, 1, False), (None, None, 0, True), (None, None, 0, True), (8, 8, 0, True), (8, 8, 0, True)]
    assert got == sorted(want, key=repr)
    kept = jaccard_join.drop_near_duplicates(table)
    assert kept.columns == table.columns
    assert rows(kept.select("doc_id", "text")) == sorted([(5, text), (3, other), (None, "one two"), (None, None), (8, None), (8, None)], key=repr)


def base_spans(t):
    out = []
    for kind, (name, pattern) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")) or name == "card" and not (14 <= len(d) <= 19 and luhn) or name == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), kind, f"{name}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


PII_TEXTS = [
    *TEXTS, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 000.1.2.300 0001.2.3.4 256.1.1.1", "+1 (2) 345 67890 é 4111 1111-1111 1111 x +1.2 +1234567890+1 23456789012", "x" * 20_000 + "@" + ".a" * 500, "1." * 2000 + "@",
    "12345678901234567890 4111111111111111. 5500-0000-0000-0004,5500 0000 0000 0004", "\U0001F600 me@x.org é́ 10.0.0.1",
]


def test_pii_base_spans(spark, empty):
    found = pii.find_pii(docs_of(spark, PII_TEXTS))
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", pii._joined(found["base"]).alias("s")).collect()}
    assert {k: base_spans(t) for k, t in enumerate(PII_TEXTS)} == {k: [x for x in s.split(",") if x] for k, s in got.items()}
    assert pii.find_pii(empty).count() == 0


def test_pii_finds_unseen_identifiers_by_context(spark):
    texts = [f"please write to user{k}@mail.example.org for news" for k in range(8)] + ["please write to agent77(at)hidden for news", "room agent88 is free"]
    found = {r["doc_id"]: r for r in pii.find_pii(docs_of(spark, texts)).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in found[8]["added"]] == [(0, 16, 33)] and not found[9]["added"]
    assert all(len(found[k]["all"]) == 1 for k in range(9))


def test_pii_finds_runs_at_the_edge_of_a_text(spark):
    texts = [f"please call +49 30 55512{k:02d} 34 now" for k in range(20)] + ["please call 030 5551234", "call 040 777 99", "room 12 14 is free"]
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["added"]] for r in pii.find_pii(docs_of(spark, texts)).collect()}
    assert found[20] == [(3, 12, 23)] and found[21] == [(3, 5, 15)] and not found[22]


def test_pii_patterns_gain_and_precision(spark):
    """Identifiers that the base patterns miss, by one-sided contexts, two words and shapes, among numbers of other kinds."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    number = lambda: f"{rng.integers(10**8):08d}"
    texts, want = [], {}
    for k in range(240):
        before, after = f"{word()} {word()}", f"{word()} {word()}"
        kind = k % 10
        if kind < 5:
            texts.append(f"{before} reach me +49 30 {number()} {after}")
        elif kind == 5:
            value = f"030-{number()}"
            texts.append(f"{before} reach me {value} {after}")
            want[k] = (3, len(before) + 10, len(before) + 10 + len(value))
        elif kind < 8:
            texts.append(f"{before} paid me {number()} {after}")
        else:
            texts.append(f"{before} order {number()} {after}")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["added"]] for r in pii.find_pii(docs_of(spark, texts)).collect()}
    right = sum(found[k] == [v] for k, v in want.items())
    wrong = sum(bool(v) for k, v in found.items() if k not in want)
    assert right >= 0.9 * len(want) and wrong == 0


def test_pii_candidates_touch_no_base_span(spark):
    """Against a comparison of all pairs, with base spans within, around, beside and equal to candidates."""
    rng = np.random.default_rng(12)
    pieces = ["a@b.org", "x9", "!!1.2.3.4!!", "4111111111111111", "+49 30 1234567", "(5)", "77 88 99", "word", "1.2.3.4", "z@", "4111 1111 1111 1111", "12"]
    texts = [" ".join(rng.choice(pieces, 8)) for _ in range(60)]
    found = pii.base_and_candidates(docs_of(spark, texts)).cache()
    want = set()
    for r in found.collect():
        want |= {(r["doc_id"], c["start"], c["end"]) for c in r["candidates"] if not any(c["start"] < b["end"] and b["start"] < c["end"] for b in r["base"])}
    got = {(r["doc_id"], r["start"], r["end"]) for r in pii._occurrences(found).where("kind IS NULL").collect()}
    assert got == want and len(want) > 20


def test_pii_long_values_and_many_spans(spark):
    """Values that differ beyond 80 characters are different ones, and a text of many spans takes no time of their square."""
    long = "9" * 90
    texts = [f"mail to {'a' * 100}{k}@mail.example.org now" for k in range(6)] + [f"mail to {long}{k} now" for k in range(3)]
    assert all(len(r["added"]) == (r["doc_id"] > 5) for r in pii.find_pii(docs_of(spark, texts), confidence=0.6, accept=0.6).collect())
    crowd = " ".join(f"u{k}@example.org x{k}" for k in range(20_000))
    assert len(pii.find_pii(docs_of(spark, [crowd])).first()["base"]) == 20_000


def test_pii_query_digest(spark, tmp_path):
    docs_of(spark, PII_TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.query(spark, str(tmp_path)).collect():
        want = base_spans(PII_TEXTS[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r["n_email"] == sum(x.startswith("email") for x in want)


def test_mixing(spark, docs, empty):
    mixed = mixing.mix_copies(docs, chunk=3, fan_in=2)
    got = mixed.collect()
    assert len(got) == len(TEXTS) and all(0 <= r["copies"] <= 2 for r in got)
    assert [sorted((r["doc_id"], r["copies"]) for r in got)] == [sorted((r["doc_id"], r["copies"]) for r in mixing.mix_copies(docs, chunk=3, fan_in=2).collect())]
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_copies(empty).count() == 0


def test_mixing_targets_and_expectations(spark):
    texts = [" ".join(["w"] * (1 + k % 17)) for k in range(4000)]
    big = docs_of(spark, texts).selectExpr("doc_id", "text", "CASE WHEN doc_id % 10 < 3 THEN 'b' WHEN doc_id % 10 < 4 THEN NULL ELSE 'a' END AS source")
    got = mixing.mix_copies(big, chunk=50, fan_in=3).toPandas()
    got["taken"] = got["copies"] * got["size"]
    by = got.groupby(got["source"].fillna("?")).agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by["taken"] - by["target"]) <= 20).all() and abs(by["target"].sum() - 1.5 * by["size"].sum()) < 1e-6
    assert (by["target"] <= 2 * by["size"] + 1e-9).all()


@pytest.mark.parametrize("sf, small", [("sf0.01", 0.25), ("sf0.1", 0.25)])
def test_mixing_comes_near_every_target(spark, sf, small):
    """Independent targets, and the words taken of real sizes: off by 2 % at most, or by a document that is small in its source."""
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("test tables are not there")
    got = mixing.query(spark, path).toPandas()
    docs = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    size = collections.Counter()
    for source, n in docs.values():
        size[source] += n
    order = sorted(size, key=lambda x: (x is None, (x or "").encode()))
    weight, target, left, full = {x: (5, 2, 1)[k % 3] for k, x in enumerate(order)}, {}, 1.5 * sum(size.values()), set()
    while True:
        target = {x: 2.0 * size[x] if x in full else left * weight[x] / sum(weight[y] for y in order if y not in full) for x in order}
        more = {x for x in order if x not in full and target[x] >= 2 * size[x]}
        if not more:
            break
        full |= more
        left = 1.5 * sum(size.values()) - sum(2.0 * size[x] for x in full)
    assert set(got["doc_id"]) == set(docs) and len(got) == len(docs)
    taken = collections.Counter()
    for r in got.itertuples():
        source, n = docs[r.doc_id]
        assert (r.size, r.source_size) == (n, size[source]) and abs(r.target - target[source]) < 1e-6 * max(1, target[source]) and 0 <= r.taken <= 2 * n
        taken[source] += r.taken
    limit = {x: max(0.02 * target[x], float(np.quantile([n for s, n in docs.values() if s == x], small))) for x in order}
    assert {x: (taken[x], target[x], limit[x]) for x in order if abs(taken[x] - target[x]) > limit[x]} == {}


def test_pivotal_rounding_keeps_expectations():
    weight, p = [5.0, 3.0, 2.0, 1.0, 1.0], [0.2, 0.5, 0.7, 0.4, 0.9]
    total = np.zeros(5)
    for seed in range(4000):
        out, left = mixing.round_chunk(weight, p, [11, 22, 33, 44, 55], seed)
        assert abs(np.dot(weight, out) - np.dot(weight, p)) < 1e-9
        assert all(x in (0.0, 1.0) for k, x in enumerate(out) if k != left)
        total += out
    assert np.abs(total / 4000 - p).max() < 0.03


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("ba", "ko", "mi", "ta", "lu") for b in ("ra", "no", "se", "di")]
    texts = [" ".join(rng.choice(words, 30)) + (" vile grubword" if k % 5 == 0 else "") for k in range(600)]
    table = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(600)] + [(3, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(table.where("doc_id < 500"), labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_docs(table, model).collect()}
    assert np.mean([got[k] == int(k % 5 == 0) for k in range(500, 600)]) > 0.97
    odd = toxicity.score_docs(docs, model).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score_docs(empty, model).count() == 0
    assert toxicity.train(table, labels.where("toxic = 0")) is None
    assert {r["predicted"] for r in toxicity.score_docs(docs, None).collect()} == {0}
    kept = toxicity.reject_toxic(table, labels)
    assert kept.columns == table.columns and 450 < kept.count() < 510 and kept.first()["score"] == 0.5


def test_toxicity_counts_every_training_row(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in ("ba", "ko", "mi", "ta", "lu") for b in ("ra", "no", "se", "di")]
    texts = [" ".join(rng.choice(words, 20)) + (f" vile grub{k:04d}zz grub{k:04d}zz" if k % 2 else "") for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(3, 0)], "doc_id long, toxic int")
    docs = docs_of(spark, texts)
    model = toxicity.train(docs, labels, learn_rows=60)
    gains, backoffs = toxicity._looked_up(model, toxicity.WHOLE)
    points, cuts = toxicity.code_points([toxicity.running(t) for t in texts])
    place = toxicity.places(points, cuts)
    assert gains.get(toxicity._hashes(points, place))[1].all() and backoffs.get(toxicity._hashes(points, place, 1))[1].all()
    x = toxicity.features([f"grub{k:04d}zz" for k in range(1, 300, 2)] + ["bara", "", None], gains, backoffs)
    assert x[:-3].min() > x[-3:].max()
    small = docs.limit(40).unionByName(docs_of(spark, TEXTS, 1000))
    broadcast = rows(toxicity.score_docs(small, model))
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 0)
    monkeypatch.setattr(toxicity, "CHUNK_ROWS", 7)
    joined = rows(toxicity.score_docs(small, model))
    assert [r[:-2] + r[-1:] for r in joined] == [r[:-2] + r[-1:] for r in broadcast] and np.allclose([r[-2] for r in joined], [r[-2] for r in broadcast], atol=1e-6)


def test_toxicity_is_the_likelihood_difference_of_kneser_ney_models(spark):
    """The tables against a plain computation of both models."""
    texts = ["abba ab", "abab bab", "ab vile", "vile abb vile ab", "bab abba", "vile ba"] * 3
    toxic = [0, 0, 1, 1, 0, 1] * 3
    docs = docs_of(spark, texts)
    model = toxicity.train(docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))
    n, grams = toxicity.ORDER, []
    for t, y in zip(texts, toxic, strict=True):
        for w in t.split():
            padded = toxicity.START * (n - 1) + w + toxicity.END
            grams += [(padded[k : k + n], y) for k in range(len(w) + 1)]
    counts = [collections.Counter(g for g, y in grams if y == c) for c in (0, 1)]
    longest = sorted({g for g, _ in grams})

    def shared(g):
        """Interpolated continuation probability of the last character after the others, both classes together."""
        kinds = {x: len({y for y in ending[len(x) + 1] if y.endswith(x)}) for x in ending[len(g)] if x[:-1] == g[:-1]}
        lower = shared(g[1:]) if len(g) > 1 else 1 / (len(ending[1]) + 1)
        return max(kinds[g] - 0.75, 0) / sum(kinds.values()) + 0.75 * len(kinds) / sum(kinds.values()) * lower

    ending = {k: {g[n - k :] for g in longest} for k in range(1, n + 1)}
    want = {}
    for g in longest:
        same = [x for x in longest if x[:-1] == g[:-1]]
        both = sum(counts[0][x] + counts[1][x] for x in same)
        base = (max(counts[0][g] + counts[1][g] - 0.75, 0) + 0.75 * len(same) * shared(g[1:])) / both
        p = []
        for c in (0, 1):
            total, kinds = sum(counts[c][x] for x in same), sum(counts[c][x] > 0 for x in same)
            p.append((max(counts[c][g] - 1, 0) + kinds * base) / total if total else base)
        want[g] = np.log(p[1] + 1e-12) - np.log(p[0] + 1e-12)
    gains, _ = toxicity._looked_up(model, toxicity.WHOLE)
    points, cuts = toxicity.code_points([w + toxicity.END for t in sorted(set(texts)) for w in t.split()])
    place = toxicity.places(points, cuts)
    shown = np.stack([toxicity._seen(points, place, back) for back in range(n - 1, -1, -1)], axis=1).astype("<u4").view(f"<U{n}")[:, 0]
    got = dict(zip(shown.tolist(), gains.get(toxicity._hashes(points, place))[0].tolist(), strict=True))
    assert set(got) == set(want) and np.allclose([got[g] for g in want], list(want.values()), atol=1e-5)


def test_pivot_index(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    vectors = [*(b + 0.2 * rng.normal(size=16) for b in base for _ in range(5)), *[base[0]] * 4, 3 * base[1]]
    data = [(k, [float(x) for x in v], k % 3) for k, v in enumerate(vectors)]
    n = len(data)
    odd = [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] + [1.0] * 15, 0), (n + 4, [None] + [1.0] * 15, 0), (n + 5, [float("inf")] + [1.0] * 15, 0), (n + 6, [1.0, 2.0], 0)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, rep int")
    got = {r["vec_id"]: r for r in pivot_index.near_vectors(df).collect()}
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert len(got) == n + 7
    assert sum(got[k]["n_links"] for k in range(n)) >= 0.9 * near.sum() and all(got[k]["n_links"] <= near[k].sum() for k in range(n))
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k in range(n, n + 7))
    part = np.arange(n)
    for _ in range(n):
        part = np.minimum(part, np.where(near, part[None, :], n).min(axis=1))
    if all(got[k]["n_links"] == near[k].sum() for k in range(n)):
        assert [got[k]["component_id"] for k in range(n)] == part.tolist()
    assert pivot_index.near_vectors(df.limit(0)).count() == 0 and pivot_index.near_vectors(df.where(f"vec_id = {n}")).count() == 1


def test_pivot_index_of_odd_norms_and_lengths(spark):
    data = [[1.0, 0.0, 0.0], [1e-200, 1e-200, 0.0], [1e200, 0.0, 1e200], [1e200, 0.0, 1.0001e200], [3.0, 4.0], [3.0, 4.0], [0.3, 0.41], [5e-324, 0.0], [0.0, 1.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")
    want = [(0, 0, 0, True), (1, 0, 1, True), (2, 1, 2, True), (3, 1, 2, False), (4, 2, 4, True), (5, 2, 4, False), (6, 2, 4, False), (7, 0, 7, True), (8, 0, 8, True)]
    for _ in range(3):
        got = rows(pivot_index.near_vectors(df).select("vec_id", "n_links", "component_id", "kept"))
        assert got == want


def test_pivot_index_finds_dense_neighbours(spark, monkeypatch):
    """Recall and precision against all pairs, with a crowd of like vectors and blocks smaller than lists."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 32))
    vectors = [b + s * rng.normal(size=32) for b in base for s in (0.0, 0.2, 0.3, 0.4, 0.5)] + [base[0] + 0.25 * rng.normal(size=32) for _ in range(400)]
    monkeypatch.setattr(pivot_index, "BLOCK", 50)
    got = pivot_index.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")).toPandas().set_index("vec_id").sort_index()
    x = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert near.sum() > 50_000 and (got["n_links"].to_numpy() <= near.sum(axis=1)).all()
    assert got["n_links"].sum() >= 0.98 * near.sum()


def test_token_orc(spark, docs, empty):
    path = scratch_path(spark, "tokens")
    given = docs_of(spark, TEXTS + ["<|endoftext|> I'M İ ẖ H̱ don't 's ﬁ straße, x1.", "ΣΑΣ ''s KK é É"]).unionByName(docs.where("doc_id = 5"))
    got = sorted(token_orc.token_orc(given, path).collect(), key=lambda r: r["start"])
    texts = {r["doc_id"]: r["text"] for r in given.collect()}
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(token_orc.tokenizer_path()), 0
    assert [r["doc_id"] for r in got] == sorted([*texts, 5])
    for r in got:
        ids = [*tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    few = token_orc.read_token_orc(spark, path, [3, 9])
    assert sorted(r["doc_id"] for r in few.collect()) == [3, 9] and "In(doc_id" in few._jdf.queryExecution().toString().replace("PushedFilters: [In(doc_id", "In(doc_id")
    assert token_orc.token_orc(empty, scratch_path(spark, "none")).count() == 0


def test_token_orc_skips_row_groups(spark):
    """A look-up by id reads a row group or two of each stripe that may hold it, not the file."""
    path = scratch_path(spark, "groups")
    docs = spark.range(0, 12_000, 2, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"))
    token_orc.write_token_orc(token_orc.token_rows(docs, token_orc.tokenizer_path()).coalesce(1), path)

    def rows_read(ids):
        few = token_orc.read_token_orc(spark, path, ids)
        found = sorted(r["doc_id"] for r in few.collect())
        leaf = few._jdf.queryExecution().executedPlan().collectLeaves().head()
        return found, leaf.metrics().get("numOutputRows").get().value()

    assert rows_read([4000]) == ([4000], 1000)
    found, n = rows_read([4001])  # within the range of a row group: its Bloom filter rules it out, or seldom doesn't
    assert found == [] and n in (0, 1000)
    assert rows_read([-5, 50_000]) == ([], 0)


def test_word_encoder_on_every_letter_and_sign():
    """Words as a whole text has them, for every assigned letter or mark with some punctuation after, before and within."""
    enc = token_orc.WordEncoder(token_orc.tokenizer_path())
    signs = token_orc.PUNCTUATION.decode()
    texts = []
    for k, c in enumerate(c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] in "LM"):
        a, b = signs[k % len(signs)], signs[k // len(signs) % len(signs)]
        texts.append(f"ab{c}{a} {c}{b} x{b}{c}{a}{b} {c} {a}{c} I{c}.")
    for at in range(0, len(texts), 2000):
        part = texts[at : at + 2000]
        want = [np.asarray(e.ids, "<u4").tobytes() for e in enc.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert enc.encode([t.encode() for t in part]) == want


def test_word_encoder_forgets_within_bounds():
    enc = token_orc.WordEncoder(token_orc.tokenizer_path(), limit=10)
    texts = [f"word{k} Other{k}, thing" for k in range(50)]
    got = [x for t in texts for x in enc.encode([t.encode()])]
    assert got == [np.asarray(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts] and len(enc.known) < 40


def test_word_encoder_learns_in_bulk(monkeypatch):
    """Different words of many texts are one call of the model, and known words none; unusual ends of words still come out right."""
    enc = token_orc.WordEncoder(token_orc.tokenizer_path())
    calls = []
    once = enc._plain_ids
    monkeypatch.setattr(enc, "_plain_ids", lambda words: calls.append(len(words)) or once(words))
    texts = [f"Stra\u00dfe word{c}x, {c}{c}abc! \u00c9{c} the  THE, the\u0130 ((" for c in "abcdefgh"] + ["", " \t\n", "a<|endoftext|>b e\u0301", "\u0130"]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode([t.encode() for t in texts]) == want and len(calls) == 1
    assert enc.encode([t.encode() for t in texts[::-1]]) == want[::-1] and len(calls) == 1
    enc.last[:] = False  # a model that does not mark the ends of words
    assert once(["the", "stra\u00dfe"]) == [np.asarray(enc.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in ("the", "stra\u00dfe")]
    sliced = enc.encode_array(pa.array(texts).slice(2, 5))
    assert sliced[0].tobytes() == b"".join(want[2:7]) and sliced[1].tolist() == [len(w) // 4 for w in want[2:7]]


def test_known_words_are_small():
    """A known word takes less than 64 bytes."""
    enc = token_orc.WordEncoder(token_orc.tokenizer_path())
    enc.encode([f"thing{chr(97 + k % 26)}{chr(97 + k // 26)}, other".encode() for k in range(26 * 26)])
    assert len(enc.known) == 677 and enc.known.nbytes + enc.known_ids.nbytes < 64 * len(enc.known)


def test_secrets(spark, docs, empty):
    """Judged on secrets and decoys that are planted in other texts than those learned from."""
    rng = np.random.default_rng(2)
    words = [f"{a}{b}{c}" for a in ("bar", "kon", "mil", "tas") for b in ("ra", "no", "se") for c in ("t", "lin", "der")]
    texts = docs_of(spark, [" ".join(rng.choice(words, 40)) for _ in range(1500)])
    planted = secrets.planted_findings(texts).cache()
    learned, unseen = planted.where("doc_id % 3 > 0"), planted.where("doc_id % 3 = 0")
    found = secrets.featured(unseen.withColumn("label", unseen["label"]), secrets.dictionary(texts))
    model = secrets.train(secrets.featured(learned, secrets.dictionary(texts)))
    judged = model.transform(secrets._vectors(found)).select("label", "prediction").toPandas()
    right, said = (judged["label"] == 1) & (judged["prediction"] == 1), judged["prediction"] == 1
    assert (judged["label"] == 1).sum() > 100 and right.sum() / (judged["label"] == 1).sum() > 0.85 and right.sum() / said.sum() > 0.9
    hexes = "8f3a0c5d9e7b21640f3c8a5d7e9b1246"
    some = [f"the password={hexes} is old", f"commit {hexes}01234567 was merged", "see release-notes-2024-final now"]
    got = {(r["doc_id"], r["start"]): r["is_secret"] for r in secrets.scan_secrets(docs_of(spark, some), labelled=learned).collect()}
    assert got[0, 13] and not got[1, 7] and not got[2, 4]
    assert secrets.scan_secrets(empty).count() == 0
    assert {r["score"] for r in secrets.scan_secrets(docs_of(spark, some), labelled=learned.where("label = 0")).collect()} == {0.0}
    assert secrets.scan_secrets(docs).count() >= 0


def test_secret_candidates_take_linear_time():
    start = time.time()
    for text in ("a" + ")" * 400_000 + "x1", "(" * 400_000, "a=" * 200_000, "password" * 50_000, '"' * 400_000 + "=", "x" * 400_000):
        secrets.candidates(text)
    assert time.time() - start < 30


def test_secrets_dictionary_counts_every_text(spark):
    rare = [f"{a}{b}{c}" for a in ("zor", "quil") for b in ("bla", "mnu", "tre") for c in ("tt", "kk", "ss", "dd")]
    texts = ["common words everywhere"] * 6000 + [f"unten {w}" for w in rare for _ in range(2)] + ["onlyonce common"]
    words = {r["word"] for r in secrets.dictionary(docs_of(spark, texts)).collect()}
    assert words == {"common", "words", "everywhere", "unten", *rare}


def test_secrets_of_any_length_in_any_run(spark):
    letters = "qwkjhzxnbvplmrtyghdfsaqwexczvbnm"
    texts = ["login password=hunter2x9 works", f"api_key: {letters} set", '{"user":"a1","token":"t0k3nA9","secret":"Zz8yXx7wVv6u"}', f"https://x.org/a?id=4&token={letters}&secret=ab12", "the password: correcthorse"]
    found = secrets.findings(docs_of(spark, texts)).collect()
    wanted = {(0, "hunter2x9"), (1, letters), (2, "t0k3nA9"), (2, "Zz8yXx7wVv6u"), (3, letters), (3, "ab12"), (4, "correcthorse")}
    assert wanted <= {(r["doc_id"], r["value"]) for r in found}
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == r["value"] for r in found)


def contained_truth(texts, items):
    def shingles(t, n):
        w = (t or "").lower().split()
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    found = []
    for i, x in enumerate(items):
        n = min(5, len((x or "").split()))
        own = shingles(x, n) if n else set()
        for d, t in enumerate(texts):
            k = len(shingles(t, n) & own) if n else 0
            if own and k >= 0.8 * len(own):
                found.append((d, i, k / len(own)))
    return sorted(found)


def test_decontaminate(spark, docs, empty):
    item = " ".join(f"q{k}" for k in range(40))
    big = " ".join(f"z{k}" for k in range(900))
    cut = item.split()
    texts = [*TEXTS, f"Before {item.upper()} after", " ".join(cut[:36]), " ".join(cut[:20]), LONG[:5000] + " " + big + " " + item, " ".join(big.split()[:760]), " ".join(big.split()[:700])]
    items = [item, "a b c d e", "too short", None, "", big, item, "answer is forty two", "Zq"]
    texts += ["all know the Answer IS forty\ttwo now", "answer is forty", "a zq b"]
    table = docs_of(spark, texts).withColumnsRenamed({"n_chars": "doc_key", "kind": "__held"})
    bench = spark.createDataFrame(list(enumerate(items)) + [(0, item)], "item_id long, text string")
    got = rows(decontaminate.contained_items(table, bench).select("doc_id", "item_id", "containment"))
    assert got == sorted(contained_truth(texts, items), key=repr)
    kept = decontaminate.decontaminate(table, bench)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, *_ in got}
    assert decontaminate.contained_items(empty, bench).count() == 0 and decontaminate.contained_items(table, bench.limit(0)).count() == 0
