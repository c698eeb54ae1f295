"""Language and toxicity: held-out accuracy, fixed cases, odd rows."""

import math
import random
import zlib

import zstandard

from riverlens.llm import langid, toxicity

SYLLABLES = {"en": ["th", "er", "ing", "on", "the"], "de": ["sch", "ung", "ein", "ö", "der"], "fr": ["é", "eau", "oui", "tre", "le"]}
SCHEMA = "doc_id long, text string, lang string, source string, score string"


def texts(n=600, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 80))]
        out.append((i, lang, words))
    return out


def odd(n):
    return [(n, None, "en", "a", None), (n + 1, "", None, None, "x"), (n + 2, "123 !!", "en", "a", "x"), (None, "the thing", "en", "a", "x"), (n + 3, "x", "en", "a", "x"), (n + 4, "the " * 20000, None, "a", "x")]


def test_languages_held_out(spark):
    data = [(i, " ".join(w), lang, "s", "x") for i, lang, w in texts()]
    data += [*odd(10_000), data[0]]
    got = langid.identify(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    assert len(got) == len(data)
    lang = {i: x for i, _, x, *_ in data}
    held = [r for r in got if r.held_out and r.doc_id < 10_000]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert [by[10_000 + k].lang_pred for k in range(3)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got) and by[10_004].lang_pred == "en"


def test_languages_without_anything_to_learn(spark):
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    one = langid.identify(spark.createDataFrame([(1, "text", None, "s", "x")], SCHEMA)).first()
    assert (one.lang_pred, one.score) == ("und", 0.0)


def test_filters_return_all_languages_of_an_ngram():
    grams = {f"l{i:02}": langid.gram_hashes(f"shared own{chr(97 + i)}word") for i in range(70)}
    f = langid.Filters(grams, {k: 1 for k in grams})
    assert len(f.planes) == 2
    lang, score = f.predict("ownbword")
    assert lang == "l01" and score > 0.02
    assert abs(f.predict("shared")[1] - 1 / 70) < 0.01


def toxic_rows(n=900, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i, _, w in texts(n, seed):
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["worthless", "pathetic", "disgusting", "stupid"]))
        docs.append((i, " ".join(w), "en", "s", "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = toxic_rows()
    data = [*docs, *odd(10_000), docs[0]]
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(spark.createDataFrame(data, SCHEMA).repartition(4), lab).collect()
    assert len(got) == len(data)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    found = [r for r in held if truth[r.doc_id]]
    assert sum(r.predicted for r in found) >= 0.9 * len(found)
    assert sum(r.predicted for r in held if not truth[r.doc_id]) <= 0.02 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    d = spark.createDataFrame(docs, SCHEMA)
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns and 0 < kept.count() < len(docs)


def test_dictionaries_and_scores_as_brute_force(spark):
    """Windows counted by hand, lengths compressed one by one, the logistic curve by hand."""
    docs, labels = toxic_rows(300, 5)
    texts_of, y = {d[0]: d[1] for d in docs}, {i: t for i, _, t in labels}
    n = [sum(t == k for t in y.values()) for k in (0, 1)]
    held = ({}, {})
    for i, t in texts_of.items():
        for w in {b" " + w + b" " for w in toxicity.words_of(t)}:
            held[y[i]][w] = held[y[i]].get(w, 0) + 1
    telling = {w: a for w, a in held[1].items() if a >= 3 and a * n[0] > 16 * held[0].get(w, 0) * n[1]}
    first = lambda d: b"".join(w for w, _ in sorted(d.items(), key=lambda x: (-x[1], x[0]))[::-1])
    usual = {w: b for w, b in held[0].items() if b > 1}
    some = spark.createDataFrame([(i, y[i], t) for i, t in texts_of.items()], "id long, y int, text string").repartition(3)
    toxic, ordinary = toxicity.dictionaries(some, (n[0], n[1]))
    assert toxic == first(telling) and b" stupid " in toxic and b" stupid " not in ordinary
    assert ordinary == first(usual)
    s = toxicity.Scorer(toxic, ordinary)
    s.calibrate([s.features(t) for t in texts_of.values()], [y[i] for i in texts_of])
    length = []
    for content in (ordinary, toxic):
        d = zstandard.ZstdCompressionDict(content + toxicity.TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        length.append(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    for text in [*list(texts_of.values())[:40], "", None, "one", "a b " * 3000]:
        w = toxicity.words_of(text)
        pairs = [b" " + b" ".join(w[i : i + 2]) + b" " for i in range(0, max(1, len(w)), 2)]
        x = sorted((max(0, len(length[0].compress(p + toxicity.TAIL)) - len(length[1].compress(p + toxicity.TAIL))) for p in pairs), reverse=True)
        past = [sum(v >= k for v in x) for k in toxicity.DISTANCES]
        f = [x[0], sum(x[:3]) / 3, sum(x[:10]) / 10, sum(x) / len(x), *(math.log(1 + p) for p in past), *(p / len(x) for p in past)]
        want = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(f, s.weights, strict=False)) + s.weights[-1]))))
        assert abs(s.score(text) - want) < 1e-9


def test_toxicity_with_one_label_or_none(spark):
    d = spark.createDataFrame([(1, "a b", "en", "s", "x"), (2, None, "en", "s", "x")], SCHEMA)
    for rows, want in (([], 0.0), ([(1, 1, 1)], 1.0)):
        lab = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert [r.score for r in toxicity.classify(d, lab).collect()] == [want, want]
    assert toxicity.classify(spark.createDataFrame([], SCHEMA), lab).count() == 0


def test_toxicity_learns_from_whole_texts(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(240):
        words = ["".join(rng.choices(SYLLABLES["en"], k=3)) for _ in range(1700)]
        toxic = rng.random() < 0.4
        if toxic:
            for w in ("worthless", "pathetic", "disgusting", "stupid") * 3:
                words.insert(rng.randrange(1600, len(words)), w)
        docs.append((i, " ".join(words), "en", "s", "x"))
        labels.append((i, 1, int(toxic)))
        assert not toxic or min(map(docs[-1][1].find, ("worthless", "pathetic", "disgusting", "stupid"))) > 10_000
    got = toxicity.classify(spark.createDataFrame(docs, SCHEMA).repartition(8), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == labels[r.doc_id][2] for r in held) >= 0.95 * len(held)


def test_toxicity_knows_all_salient_terms(spark):
    rng = random.Random(6)
    terms = ["".join(rng.choices("bcdfgjkmpqvwxz", k=11)) for _ in range(300)]
    docs, labels = [], []
    for i in range(3000):
        words = ["".join(rng.choices(SYLLABLES["en"], k=3)) for _ in range(20)]
        toxic = i % 6 == 0
        if toxic:
            kind = i // 6 % 30
            words += rng.sample(terms[10 * kind : 10 * kind + 10], 8)
        rng.shuffle(words)
        docs.append((i, " ".join(words), "en", "s", "x"))
        labels.append((i, 1, int(toxic)))
    got = toxicity.classify(spark.createDataFrame(docs, SCHEMA).repartition(8), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    found = [r.predicted for r in got if r.held_out and labels[r.doc_id][2]]
    assert sum(found) >= 0.95 * len(found)


def test_languages_of_any_number_are_learned(spark):
    rng = random.Random(8)
    own = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(6)] for _ in range(300)]
    data = [(9 * i + j, " ".join(rng.choices(w, k=8)), f"l{i:03}", "s", "x") for i, w in enumerate(own) for j in range(9)]
    got = langid.identify(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()
    lang = {i: x for i, _, x, *_ in data}
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_languages_as_brute_force(spark):
    """The query against plain sets of n-grams: no filter, no hashing."""
    data = [(i, " ".join(w), lang, "s", "x") for i, lang, w in texts(400, 9)]

    def grams(t):
        clean = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        return [clean[i : i + 4] for i in range(max(1, len(clean) - 3))]

    known = {}
    for i, t, lang, *_ in data:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            known.setdefault(lang, set()).update(grams(t))
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()}
    for i, t, *_ in data:
        seen = {k: sum(g in s for g in grams(t)) for k, s in known.items()}
        best = max(sorted(seen), key=seen.get)
        assert seen[got[i].lang_pred] >= seen[best] - 1
        assert abs(got[i].score - seen[got[i].lang_pred] / sum(seen.values())) < 0.02


def test_classifiers_with_clashing_names_and_long_texts(spark):
    docs, labels = toxic_rows(200, 3)
    data = [(*d[:4], 1, 2, 3) for d in docs] + [(9000, "thing " * 200_000, "en", "s", 1, 2, 3)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, score int, predicted int, y int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.classify(d, lab).columns == ["doc_id", "held_out", "score", "predicted"]
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns and kept.where("doc_id = 9000").count() == 1
    assert langid.identify(d).columns == ["doc_id", "held_out", "lang_pred", "score"]
