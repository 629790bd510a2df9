"""Quality rules and classifier."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import boosting, classifier, kneserney, rules

from .conftest import hard_rows, line

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(repeated)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #|\n\t\x0b\x1c é", max_size=60))
def test_statistics_equal_brute_force(text):
    got = rules.statistics(text, kneserney.Model(np.zeros(0, np.int64), np.zeros(0, np.int64)))
    got.pop("log_perplexity")
    assert got == brute(text)


def test_rules_hard_rows(hard, empty, clashing):
    for df in (hard, clashing):
        rows = rules.report(df).collect()
        assert len(rows) == len(hard_rows())
        texts = {}
        for doc_id, text, *_ in hard_rows():
            texts.setdefault(doc_id, []).append(brute(text))
        for r in rows:
            got = {k: r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            assert got in texts[r.doc_id]
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert rules.report(empty).count() == 0
    assert rules.filtered(clashing).columns == clashing.columns


def test_counts_cover_whole_texts(hard):
    table = {r.key: r.n for r in kneserney.count(hard, 3).collect()}
    want = {}
    for _, text, *_ in hard_rows():
        for key in kneserney.ngram_keys(kneserney.code_points(text or ""), 3).tolist():
            want[key] = want.get(key, 0) + 1
    assert table == want


def test_model_sums_to_one():
    keys = np.concatenate([kneserney.ngram_keys(kneserney.code_points(line(s, 80)), 3) for s in range(20)])
    model = kneserney.Model(*np.unique(keys, return_counts=True), order=3)
    for context in [*np.unique(keys // 64)[:30].tolist(), 5 * 64 + 61, 63 * 64 + 63]:
        p = np.exp(model._logp(context * 64 + np.arange(64), 3).astype(float))
        assert abs(p.sum() - 1) < 1e-4


def test_bands_reject_odd_texts_and_keep_clean_ones(spark):
    rows = [(r.doc_id, r.kept, r.base_failed, r.quality) for r in rules.report(spark.read.parquet(f"{SF}/documents.parquet"))
            .join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()]
    clean = [k for _, k, failed, q in rows if q == 1 and not failed]
    junk = [k for _, k, _, q in rows if q == 0]
    assert sum(clean) / len(clean) > 0.97 and sum(junk) / len(junk) < 0.4


def test_letters_of_all_scripts_count(spark):
    """Words in disorder and letters in disorder are rejected in any script, prose is not."""
    import random
    rng = random.Random(8)
    rows, odd = [], set()
    for lang, letters in (("ru", "абвгдежзиклмнопрстуф"), ("el", "αβγδεζηθικλμνξοπρστυ"), ("th", "กขคงจชซณดตถทนบปผพมยร")):
        words = ["".join(rng.choices(letters, k=rng.randint(3, 7))) for _ in range(60)]
        after = {w: rng.sample(words, 4) for w in words}
        for n in range(90):
            text = [rng.choice(words)]
            while len(text) < 120:
                text.append(rng.choice(after[text[-1]]))
            if n < 6:  # same letters and blanks
                text = ["".join(rng.sample(w, len(w))) for w in text]
                odd.add(len(rows))
            rows.append((len(rows), " ".join(text), lang))
    got = {r.doc_id: r.kept for r in rules.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(got[i] for i in odd)
    assert sum(got[i] for i in got if i not in odd) > 0.9 * (len(got) - len(odd))
    points = kneserney.code_points("a\t7é Я漢😀\U0010ffff")
    assert kneserney.symbols(points, kneserney.WHOLE).tolist() == [
        97, 0, 48, 0xE9, 0, 0x42F, 3584 + 6, 0x6F22 & 4095, 3584 + 0x1F, 0x600, 3584 + 0x10F, 4095]


def test_trees_learn_and_are_deterministic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = boosting.fit(x[:3000], y[:3000])
    assert ((trees.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert np.array_equal(trees.score(x), boosting.fit(x[:3000], y[:3000]).score(x))
    none = boosting.fit(np.zeros((0, 5)), np.zeros(0))
    assert np.allclose(none.score(x[:3]), 0.5)


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = classifier.report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_classifier_hard_rows(spark, hard, empty, clashing):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (7, 1, None), (11, 0, 1), (None, 1, 0), (8, None, 0), (99, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    for df in (hard, clashing):
        rows = classifier.report(df, labels).collect()
        assert len(rows) == len(hard_rows())
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert classifier.report(empty, labels).count() == 0
    assert {r.score for r in classifier.report(hard, labels.limit(0)).collect()} == {0.5}
    assert classifier.filtered(clashing, labels).columns == clashing.columns
