import collections
import random
import re

import duckdb
import pytest

from riverlens.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_words string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def rows(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(1, 160))]
        kind = i % 10
        if kind == 7:
            words = [w + "###" for w in words]
        elif kind == 8:
            words = words[:3] * 60
        elif kind == 9:
            words = [w.upper() + "!!" for w in words]
        seps = [" ", "\n", "\t", "  ", "\x0b", " "]
        text = "".join(w + rng.choice(seps) for w in words)
        if kind == 6:
            text += "\n" + "\n".join([" ".join(words[:5])] * 4) + "\n\n"
        out.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None]), "x"))
    odd = [None, "", " \n", "é ö " * 60, "😀 " * 70, "w " * 30000, "a b a b a b " * 20]
    return out + [(n + k, t, "en", "a", None) for k, t in enumerate(odd)] + [(None, "x " * 80, "en", "a", "x"), out[3]]


def base(text):
    w = [x for x in SPACE.split(text or "") if x]
    lines = [x for x in (text or "").split("\n") if SPACE.sub("", x)]
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {p for j, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for p in (j, j + 1, j + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_measures_by_hand_and_verdicts_by_sql(spark):
    data = rows()
    d = spark.createDataFrame(data, SCHEMA).repartition(6)
    got = quality.verdicts(d).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(((i, *base(t)) for i, t, *_ in data), key=str)
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    want = con.sql(quality.ORACLE_SQL.replace("documents", "(select doc_id::bigint as doc_id, text, lang, source from documents)")).fetchall()
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.kept for r in got} == {True, False}


def test_limits_follow_their_group(spark):
    """Two groups of differing cleanliness get differing limits for all five measures."""
    rng = random.Random(5)

    def text(dirt):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 6 + 3 * dirt))) for _ in range(rng.randint(150, 250))]
        for _ in range(rng.randint(0, 2 + 40 * dirt)):
            words[rng.randrange(len(words))] += "#"
        for _ in range(rng.randint(0, 2 + 40 * dirt)):
            k = rng.randrange(len(words))
            words[k] = words[k].upper()
        if dirt:
            words += words[:3] * rng.randint(2, 12)
        out = " ".join(words)
        return out + "\nsame line here" * (1 + rng.randint(10, 60) * dirt)

    data = [(i, text(i % 2), "en", "ab"[i % 2], "x") for i in range(600)]
    lim = {r.source: r for r in quality.limits(quality.sketches(quality.measure(spark.createDataFrame(data, SCHEMA)))).collect()}
    for m in quality.MEASURES:
        assert lim["b"][f"hi_{m}"] > lim["a"][f"hi_{m}"], m


def test_a_small_group_leans_on_its_language(spark):
    data = [(i, " ".join(["word" + str(j) for j in range(60 + i % 90)]), "en", "big", "x") for i in range(400)] + [(900, "w# " * 30 + " ".join(map(str, range(60))), "en", "tiny", "x")]
    lim = {r.source: r for r in quality.limits(quality.sketches(quality.measure(spark.createDataFrame(data, SCHEMA)))).collect()}
    assert abs(lim["tiny"].hi_symbols / lim["big"].hi_symbols - 1) < 0.3
    kept = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(data, SCHEMA)).collect()}
    assert not kept[900] and sum(kept.values()) > 390


def test_any_names_of_columns(spark):
    d = spark.createDataFrame(rows(60, 3), SCHEMA)
    odd = d.selectExpr("doc_id", "text", "lang", "source", "1 as q", "2 as doc", "3 as kept", "4 as _quality", "5 as _l", "6 as k_lang", "7 as hi_symbols", "8 as `a.b`", "9 as c", "10 as n_words")
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.keep_good(odd).count() == quality.keep_good(d).count()


def test_keep_good_keeps_columns_and_takes_an_empty_table(spark):
    d = spark.createDataFrame(rows(100, 3), SCHEMA)
    kept = quality.keep_good(d)
    assert kept.columns == d.columns
    assert kept.count() == sum(r.kept for r in quality.verdicts(d).collect())
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.verdicts(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_no_python_in_the_plan(spark):
    d = spark.createDataFrame(rows(20, 4), SCHEMA)
    for df in (quality.verdicts(d), quality.keep_good(d)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=5)) + str(k) for k in range(n)]


def planted(measure, rng, n_lines, finds):
    """A text of n_lines lines of ten words, with finds of just one measure."""
    lines = [words(rng, 10) for _ in range(n_lines)]
    for k in range(finds):
        line = lines[k % n_lines]
        if measure == "symbols":
            line[k // n_lines] += "#"
        elif measure == "capitals":
            line[k // n_lines] = line[k // n_lines].capitalize()
        elif measure == "length":
            line[k // n_lines] += "x" * 20
        elif measure == "repeats":  # the same words in lines that differ otherwise
            lines[k % n_lines] = ["one", "two", "three", "four", *line[4:]]
        else:
            lines[k % n_lines] = ["equal"]
    return "\n".join(" ".join(x) for x in lines)


@pytest.mark.parametrize("measure", quality.MEASURES)
def test_limits_come_from_finds_of_their_measure(spark, measure):
    """Two groups of equal lengths, in half of whose texts as many finds as in none of the others."""
    rng = random.Random(3)
    few, many = (2, 9) if measure in ("repeats", "dup_lines") else (6, 60)
    data = [(i, planted(measure, rng, 20, 0 if i % 3 == 0 else few if i % 2 else many), "en", "ab"[i % 2 == 0], None) for i in range(240)]
    data += [(1000 + i, planted(measure, rng, 20, 0), "fr", "c", None) for i in range(200)]
    lim = {r.source: r for r in quality.limits(quality.sketches(quality.measure(spark.createDataFrame(data, SCHEMA)))).collect()}
    assert lim["b"][f"hi_{measure}"] > 1.1 * lim["a"][f"hi_{measure}"]
    for m in set(quality.MEASURES) - {measure, "length", "capitals"} - ({"repeats"} if measure == "dup_lines" else set()):
        assert lim["b"][f"hi_{m}"] == lim["a"][f"hi_{m}"] == lim["c"][f"hi_{m}"], m


@pytest.mark.parametrize("measure", quality.MEASURES)
def test_limits_do_not_follow_lengths(spark, measure):
    """Texts four times as long with finds at the same rate; and without any."""
    rng = random.Random(4)
    for rate in (1, 0):
        data = [(i, planted(measure, rng, 12 * (1 + 3 * (i % 2)), 3 * rate * (1 + 3 * (i % 2)) if measure not in ("repeats", "dup_lines") else 0), "en", "ab"[i % 2], None) for i in range(160)]
        lim = {r.source: r for r in quality.limits(quality.sketches(quality.measure(spark.createDataFrame(data, SCHEMA)))).collect()}
        for m in quality.MEASURES:
            assert lim["a"][f"hi_{m}"] == pytest.approx(lim["b"][f"hi_{m}"], rel=0.12), m
