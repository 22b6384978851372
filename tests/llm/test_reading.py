import random

from conftest import rows

from moraine.llm import reading as R

EASY = "cat dog sun run red big hat milk fish bed".split()
MID = "market budget season household project council service supplier owner result".split()
HARD = "heterogeneity estimator orthodoxy parameterisation hermeneutics provenance asymptotic stochastic ontological degeneracy".split()
LEVELS = [EASY, EASY + MID, MID, MID + HARD, HARD]


def corpus(n=500, seed=1):
    r = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        band = r.randrange(1, 6)
        w = []
        for _ in range(90):
            w.append(r.choice(LEVELS[band - 1]))
            if r.random() < 0.5:
                w.append(r.choice("the of and to in is a that for it".split()))
        docs.append((i, " ".join(w), "fr" if i % 9 == 0 else "en"))
        truth[i] = band
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus()
    labels = [(i, "ann", b) for i, b in truth.items() if i % 4 == 0] + [(0, "ann", truth[0]), (4, "b", None), (99_999, "b", 3)]
    D = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'x' AS id", "1 AS band", "2 AS level")
    got = {r.doc_id: r.band for r in R.reading_bands(D, spark.createDataFrame(labels, "doc_id long, annotator string, band int")).collect()}
    held = [i for i in truth if i % 4]
    assert set(got) == set(truth)
    assert sum(got[i] == truth[i] for i in held) / len(held) >= 0.9


OTHERS = {
    "de": "die behörde änderte die regeln für den garten und es ist nicht so in diesem jahr auf dem markt",
    "nl": "de gemeente wijzigde de regels voor de tuin en het is niet zo dat wij in dit jaar op de markt zijn",
    "it": "il comune ha cambiato le regole per il giardino e non è così che in questo anno siamo al mercato",
    "pl": "gmina zmieniła zasady dla ogrodu i nie jest tak że w tym roku jesteśmy na rynku a to jest do domu",
    "pt": "a câmara mudou as regras para o jardim e não é assim que no ano em que a gente vai ao mercado",
    "ru": "для этого нужен лёгкий берег и мы не были в этом году на рынке",
}


def test_other_languages_get_no_band(spark):
    docs, truth = corpus(300)
    docs += [(9000 + k, (text + " ") * 6, "en") for k, text in enumerate(OTHERS.values())]
    labels = [(i, "ann", b) for i, b in truth.items() if i % 3 == 0]
    D, L = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, annotator string, band int")
    assert {r.doc_id for r in R.reading_bands(D, L).collect()} == set(truth)


def test_likelihood_rises_until_it_settles(spark):
    docs, truth = corpus(400, 7)
    D = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    y = spark.createDataFrame([(i, float(b)) for i, b in truth.items() if i % 5 == 0], "id long, y double")
    common = R.common_words(D, y, "doc_id", "text", R.BITS)
    rows_ = R.features(D, common).join(y, "id", "left").persist()
    _, course = R.fitted(rows_, rows_.where("y IS NOT NULL"))
    assert len(course) > 1 and course[1] > course[0] and course[-1] - course[-2] < 0.01
    assert all(b - a > -0.02 for a, b in zip(course, course[1:]))


def test_edge_cases(spark):
    L = "doc_id long, annotator string, band int"
    D = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, "the cat is in the box and it is red " * 8), (5, "the estimator is of the form that is asymptotic " * 9000)], "doc_id long, text string")
    labels = spark.createDataFrame([(4, "a", 1), (5, "a", 5)], L)
    assert sorted((r.doc_id, r.band) for r in R.reading_bands(D, labels).collect()) == [(4, 1), (5, 5)]
    assert rows(R.reading_bands(D, labels.limit(0))) == []
    assert rows(R.reading_bands(D.limit(0), labels)) == []
    assert rows(R.reading_bands(D, spark.createDataFrame([(4, "a", 1), (5, "a", 1)], L))) == []
