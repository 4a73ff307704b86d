"""More labels than a matrix of languages has: the same languages and scores as with one matrix of all."""

from cohortmart.llm import language_id
from tests.conftest import rows


def test_matrices_one_after_the_other(spark, monkeypatch):
    words = {"en": "the cat and the dog", "es": "el gato y el perro", "de": "der hund und die katze", "fr": "le chien et le chat"}
    learned = [(k, " ".join(words[y].split()[k % 3 :]), y) for k in range(40) for y in [sorted(words)[k % 4]]] + [(100 + k, f"noise {k}", f"en-{k:03d}") for k in range(7)]
    train = spark.createDataFrame(learned, "doc_id long, text string, lang string")
    texts = [*words.values(), "Der Hund", "noise 5", None, "", "1234", "ÿ", "the " * 3000]
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, mass int")
    whole = language_id.train(train)
    want = {r["doc_id"]: r for r in language_id.identify(docs, whole).collect()}
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    parts = language_id.train(train)
    assert isinstance(parts, language_id.LanguageCounts) and len(list(parts.models())) == 4 and parts.languages == whole.languages
    got = language_id.identify(docs, parts)
    assert got.columns == ["doc_id", "mass", "lang_pred", "score"]
    for r in got.collect():
        assert r["lang_pred"] == want[r["doc_id"]]["lang_pred"] and abs(r["score"] - want[r["doc_id"]]["score"]) < 1e-6
    assert language_id.identify(docs.limit(0), parts).count() == 0 and len(rows(got)) == len(texts)
