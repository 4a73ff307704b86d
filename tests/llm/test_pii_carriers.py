"""Gain and precision of the bootstrapped patterns with texts of the test tables as carriers."""

import os
import random

import pytest

from cohortmart.llm import pii

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_identifiers_in_texts_of_the_tables(spark):
    """Six of seven planted identifiers have the form that the base patterns know; the others are found by what stands around
    them, and numbers of orders and rooms, and all numbers that the texts hold already, are left alone."""
    rnd = random.Random(12)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    number = lambda: f"{rnd.randrange(10**7):07d}"
    kinds = [("call us at ", "+49 30 {}", " before noon", False), ("call us at ", "030-{}", " before noon", True), ("our order no ", "030-{}", " of may", False)]
    kinds += [("mail it to ", "user{}@mail.example.org", " please today", False), ("mail it to ", "user{}(at)mail", " please today", True), ("see room ", "user{}(at)hall", " upstairs", False)]
    kinds = [kinds[0]] * 6 + [kinds[1]] + [kinds[2]] * 2 + [kinds[3]] * 6 + [kinds[4]] + [kinds[5]] * 2
    data, want = [], {}
    for k, r in enumerate(rows):
        text = r["text"] or ""
        before, form, after, wanted = kinds[k % 18]
        cut = text.find(" ", rnd.randrange(max(1, len(text))))
        cut = len(text) if cut < 0 else cut
        value, head = form.format(number()), f"{text[:cut]} {before}"
        data.append((r["doc_id"], f"{head}{value}{after}{text[cut:]}"))
        if wanted:
            want[r["doc_id"]] = (len(head), len(head) + len(value))
    found = pii.find_pii(spark.createDataFrame(data, "doc_id long, text string")).select("doc_id", "added").collect()
    added = {(r["doc_id"], s["start"], s["end"]) for r in found for s in r["added"]}
    right = {(d, *span) for d, span in want.items()}
    assert len(right) > 100 and len(added & right) >= 0.95 * len(right)
    assert len(added & right) >= 0.95 * len(added)
