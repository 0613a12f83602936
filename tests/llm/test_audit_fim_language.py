"""Filter audits, fill-in-middle, language filters."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import filter_audit, fim, langid
from tablewright.llm.lookup import lookup
from tablewright.llm.wavelet import WaveletMatrix

WORDS = re.compile(r"[^ \t-\r]+")
TOKENS = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
ODD = [None, "", " ", "\n\t ", "a", " a", "a ", "é漢 字\x1c\x85 x y", "A <P> b", "x" * 70_000, "w " * 3000, "<S", "S> a b <"]


# --- filter audit ---


def brute_failures(rows):
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = WORDS.findall(text)
        bad = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": re.search("[#$%&*|]", text) is not None,
            "E": any((t or "") == text and i is not None and doc_id is not None and i < doc_id for i, t, *_ in rows),
        }
        out.append({k for k, v in bad.items() if v})
    return out


def brute_audit(rows, labels):
    failed, found = brute_failures(rows), {}
    good = [any(i == r[0] and q == 1 for i, q, _ in labels) for r in rows]
    toxic = [any(i == r[0] and t == 1 for i, _, t in labels) for r in rows]
    for part in {r[2] or "" for r in rows}:
        own = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, x in enumerate(order, 1):
                out = [k for k in left if x in failed[k]]
                left = [k for k in left if x not in failed[k]]
                shares[x] += len(out)
                found[part, "".join(order), step] = [
                    len(left), len(out), sum(x in failed[k] for k in own) - len(out), sum(failed[k] == {x} for k in own),
                    sum(good[k] for k in out), sum(toxic[k] for k in out),
                ]
        for (p, order, step), values in found.items():
            if p == part:
                values.append(shares[order[step - 1]])
    return found


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "A B C", "same words " * 60, " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(60)) + " #", "X" + " y" * 3]
    texts += [" ".join(f"{rng.choice('abX$')}{rng.randint(0, 60)}" for _ in range(rng.randint(0, 90))) for _ in range(20)]
    rows = [(k if rng.random() < 0.9 else rng.choice([None, 5]), rng.choice(texts), rng.choice(["a", "b", None, ""]), k) for k in range(150)]
    labels = [(rng.choice([None, *range(150)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, part int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labels = [x for x in labels if x[0] is not None]
    found = filter_audit.audit(docs, marks).collect()
    wanted = brute_audit(rows, labels)
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in found} == wanted and len(found) == len(wanted)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    unlabelled = filter_audit.audit(docs, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(unlabelled) == (0, 0)


def test_long_texts_are_cut_between_words():
    rules = filter_audit.FilterRules()
    for text in (b"ab cd\n" * 500, b"x" * 5000 + b" y", b" " * 5000, "é漢 ".encode() * 900):
        assert {filter_audit.text_failures(text, rules, step) for step in (1, 7, 64, 1 << 20)} == {filter_audit.text_failures(text, rules)}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 26, 1000, 10_007])
def test_positional_popcounts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    plain = [int(((words >> k) & 1).sum()) for k in range(32)]
    assert filter_audit.positional_popcounts(words).tolist() == plain


def test_lookup_with_hot_and_null_keys(spark):
    rows = [(k, None if k % 7 == 0 else 0 if k % 3 == 0 else k) for k in range(3000)]
    left = spark.createDataFrame(rows, "row long, key long")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(0, 3000, 2)], "key long, v string")
    found = lookup(left, table, ["key"], "row").collect()
    assert sorted((r.row, r.v) for r in found) == [(k, f"v{x}" if x is not None and x % 2 == 0 else None) for k, x in rows]


# --- fill in the middle ---


def test_wavelet_ranks_and_places():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 2000):
        symbols = rng.integers(0, 6, n).astype(np.uint8)
        matrix, at = WaveletMatrix(symbols, 3), np.arange(n + 1)
        for s in range(6):
            assert matrix.rank(s, at).tolist() == [0, *np.cumsum(symbols == s)]
        marked = np.flatnonzero(np.isin(symbols, (2, 3)))
        places = matrix.place_any((2, 3), np.arange(1, len(marked) + 2), np.zeros(len(marked) + 1, int), np.full(len(marked) + 1, n))
        assert places.tolist() == [*(marked + 1), n]


def brute_fim(doc_id, text):
    text = text or ""
    tokens = TOKENS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_equals_brute_force(spark):
    rng = random.Random(8)
    made = ["".join(rng.choice(["a", "é", "漢", " ", "\n", "\t", "<", "P>", "\x1c", "😀"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows = [(None if k % 50 == 49 else k % 700, t, "x") for k, t in enumerate((ODD + made) * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    found = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    joined = sorted((tuple(r) for r in found.collect()), key=repr)
    assert joined == sorted(((i, *brute_fim(i, t), t or "") for i, t, _ in rows), key=repr)
    assert {r[2] for r in joined} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0


def test_fill_in_middle_by_lines():
    texts = ["a\nb c\n\nd", "a\n", "\n", "one", ""]
    found = list(fim.cut_texts(pa.array(texts), [str(k) for k in range(5)], fim.FimPlan(unit="line", percent=100)))
    assert [f[0] for f in found] == [4, 1, 1, 1, 0]
    for text, (_, form, prefix, middle, output) in zip(texts, found, strict=True):
        if form != "plain":
            pieces = text[:prefix], text[prefix : prefix + middle], text[prefix + middle :]
            assert all(p == "" or p.endswith("\n") or text.endswith(p) for p in pieces)
            assert sorted(re.split("<[PSM]>", output.decode())[1:]) == sorted(pieces)


def test_unknown_units_are_refused(docs):
    with pytest.raises(ValueError, match="unit"):
        fim.transform(docs("a"), fim.FimPlan(unit="page"))


# --- languages ---


def test_filters_hold_all_their_grams():
    rng = np.random.default_rng(4)
    languages = 11
    grams = rng.integers(0, 1 << 40, 6000).astype(np.uint64)
    language = rng.integers(0, languages, 6000)
    made = langid.NgramFilter(grams, language, languages, langid.LanguagePlan())
    masks = made.masks(grams)
    assert all(masks[k >> 3, i] >> (k & 7) & 1 for i, k in enumerate(language))
    others = rng.integers(1 << 41, 1 << 42, 200_000).astype(np.uint64)
    hits = made.hits(others, np.zeros(len(others), np.int64), 1)
    assert np.allclose(hits[0] / len(others), made.false_positives, rtol=0.25, atol=2e-4)
    assert made.corrected(hits, np.array([len(others)])).max() < 0.0005 * len(others)


def test_ngrams_stay_inside_words():
    data, starts = langid.normalised(["Ab, c3d!", "", "..", "É"])
    grams, owner = langid.ngrams(data, starts, 3)
    plain = lambda g: int(g).to_bytes(8, "big")[-3:].decode(errors="replace")
    assert [(plain(g), o) for g, o in zip(grams, owner, strict=True)][:4] == [(" ab", 0), ("ab ", 0), (" c ", 0), (" d ", 0)]
    assert set(owner.tolist()) == {0, 3}


def test_languages_of_held_out_documents(sample):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.fit(sample, ~held_out)
    found = langid.predict(sample, model).join(sample.select("doc_id", "lang"), "doc_id").toPandas()
    own = found[[zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]]
    assert (own.lang_pred == own.lang).mean() >= 0.95
    assert found.score.between(0, 1).all() and len(found) == sample.count()


def test_odd_texts_have_a_language_or_none(spark):
    texts = [*ODD, "123 ...", "the 漢", "漢字"]
    rows = [(k % 9, t, "en" if k % 2 else None, "x") for k, t in enumerate(texts)] + [(None, "le la les des", "fr", "x"), (1, "the of and the", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, id string")
    model = langid.fit(docs, F.lit(True))
    found = langid.predict(docs.withColumn("lang", F.lit("zz")), model).collect()
    assert len(found) == len(rows)
    for text, r in zip([t for _, t, *_ in rows], found, strict=True):
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert r.lang_pred in {"und", "en", "fr"} and 0 <= r.score <= 1
    assert found[-1].lang_pred == "en" and found[-2].lang_pred == "fr"
    assert langid.predict(docs.limit(0), model).count() == 0
    nothing = langid.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    with pytest.raises(ValueError, match="languages"):
        langid.fit(docs, F.lit(True), langid.LanguagePlan(languages=1))


def test_masses_of_copies_in_one_language(spark):
    """One text that is most of a language does not hide the others of that language."""
    rng = random.Random(6)
    word = {"x": "alo emi uta ora ine".split(), "y": "krt vlk smr prst hrd".split()}
    make = lambda lang: " ".join("".join(rng.choice(word[lang]) for _ in range(2)) for _ in range(40))
    rows = [(k, "alo alo alo", "x") for k in range(400)] + [(1000 + k, make("xy"[k % 2]), "xy"[k % 2]) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.col("doc_id") % 3 != 1)
    found = langid.predict(docs, model).join(docs, "doc_id").where("lang_pred <> lang").count()
    assert found == 0
