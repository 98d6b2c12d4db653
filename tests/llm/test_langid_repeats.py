"""Repeated rows and ids cost no language its place in the model."""

from quillstone.llm import langid

TEXTS = {"de": "der hund und die katze %d", "en": "the dog and the cat %d", "es": "el perro y la gata %d", "fr": "le chien et la chatte %d"}


def test_repeated_rows_keep_every_language(spark):
    rows = [(100 * k + n, lang, text % n) for k, (lang, text) in enumerate(sorted(TEXTS.items())) for n in range(8)]
    once = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    want, got = langid.fit_model(once, 4), langid.fit_model(once.union(once), 4)
    assert got.languages == want.languages == sorted(TEXTS)
    assert (got.landmarks == want.landmarks).all() and (got.weights == want.weights).all()
    many = once.union(spark.createDataFrame([(0, "de", TEXTS["de"] % n) for n in range(50)], once.schema))
    assert langid.fit_model(many, 4).languages == sorted(TEXTS)
