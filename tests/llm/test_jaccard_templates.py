"""Texts of one template with endings of their own: they look alike to the forest, link with nothing, and are not dealt."""

import random

from cohortmart.llm import jaccard_join
from tests.conftest import rows


def template_texts(n, seed=1):
    rnd = random.Random(seed)
    head = " ".join(f"t{k}" for k in range(104))
    return [head + " " + " ".join(f"w{rnd.randrange(10**9)}" for _ in range(50)) for _ in range(n)]


def test_texts_of_a_template_are_told_apart_by_wide_signatures(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FAMILY_BLOCK", 64)
    copies = [" ".join([*template_texts(1, 9)[0].split()[:150], *f"x{k} y z".split()]) for k in range(80)]
    texts = template_texts(300) + copies
    members = spark.createDataFrame([(0, k, t, 1, len(t.split())) for k, t in enumerate(texts)], "component long, node long, text string, copies long, n_words long")
    left = {r["node"]: r["component"] for r in jaccard_join.told_apart(members).collect()}
    assert set(left) == set(range(300, 380)) and set(left.values()) == {300}
    assert rows(jaccard_join.told_apart(members.limit(40))) == rows(members.limit(40))


def test_links_stay_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FAMILY_BLOCK", 64)
    rnd = random.Random(3)
    base = template_texts(6, 5)
    texts = template_texts(150) + [" ".join(w for w in b.split() if rnd.random() > 0.004 * (k % 6)) for b in base for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    near = [[k for k, b in enumerate(sets) if k != j and len(a & b) >= 0.8 * len(a | b) - 1e-9] for j, a in enumerate(sets)]
    part = list(range(len(texts)))
    for _ in range(len(texts)):
        new = [min([part[j], *(part[k] for k in near[j])]) for j in range(len(texts))]
        if new == part:
            break
        part = new
    got = rows(jaccard_join.near_duplicates(docs).select("doc_id", "class_id", "n_links"))
    assert got == sorted(((j, part[j], len(near[j])) for j in range(len(texts))), key=repr)
