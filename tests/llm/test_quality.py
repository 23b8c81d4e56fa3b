import re
import zlib

import numpy as np
import pyarrow as pa

from equiscan.llm import quality_classifier, quality_rules
from equiscan.llm.textbytes import Texts
from equiscan.llm.textstats import Statistics

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words, seen, lines, dup = WORDS.findall(text), {}, set(), 0
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for places in seen.values() if len(places) > 1 for i in places for j in range(8)}
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics_match_brute_force(documents, texts, messy):
    for docs in (documents, messy):
        for r in quality_rules.rate_documents(docs).collect():
            if r.doc_id is not None:
                text = texts.get(r.doc_id) if docs is documents else {m.doc_id: m.text for m in messy.collect()}[r.doc_id]
                got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                assert got == brute(text or "")
                assert r.base_failed == (got[0] < 20 or 100 * got[4] > 30 * got[0])


def test_texts_of_one_slice_do_not_leak_into_each_other():
    words = "a b c d e f g h"
    s = Statistics(Texts(pa.array([words, words, f"{words} {words}", "a\nb", "a\nb\na\n", None, ""])))
    assert s.n_repeat_words.tolist() == [0, 0, 16, 0, 0, 0, 0]
    assert s.n_dup_lines.tolist() == [0, 0, 0, 0, 1, 0, 0]
    assert s.n_distinct.tolist() == [8, 8, 8, 2, 2, 0, 0]
    assert s.most_frequent.tolist() == [1, 1, 2, 1, 2, 0, 0]
    assert s.n_same_as_last.tolist() == [0] * 7


def test_votes_separate_junk_without_labels(spark, small):
    big = small.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    rated = quality_rules.rate_documents(spark.read.parquet(f"{big}/documents.parquet")).join(labels, "doc_id").where("NOT base_failed").collect()
    right = [r.kept == bool(r.quality) for r in rated]
    assert sum(right) >= 0.97 * len(right)


def test_expectation_maximisation_finds_the_rules_that_are_right():
    random = np.random.Generator(np.random.PCG64(5))
    good = random.random(4000) < 0.8
    chances = np.array([[0.7, 0.3, 0.0], [0.02, 0.98, 0.0]]), np.array([[0.5, 0.2, 0.3], [0.05, 0.1, 0.85]]), np.array([[0.4, 0.5, 0.1], [0.02, 0.3, 0.68]])
    votes = np.stack([[random.choice(3, p=c[int(g)]) for g in good] for c in chances], 1)
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, chance = quality_rules.fit(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.05 and abs(chance[0, 0, 0] - 0.7) < 0.12
    assert ((quality_rules.posterior(patterns, share, chance) >= 0.5)[back.ravel()] == good).mean() > 0.93


def test_rules_on_awkward_rows(messy, no_documents):
    rows = quality_rules.rate_documents(messy).collect()
    assert len(rows) == messy.count()
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (2, 3, 4, 11))
    assert quality_rules.rate_documents(no_documents).collect() == []


def test_held_out_labels_are_predicted(spark, documents, small):
    big = small.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = quality_classifier.score_documents(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_held_out_labels_do_not_change_scores(spark, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.withColumn("quality", (quality_classifier.held_out("doc_id").cast("int") + labels["quality"]) % 2)
    score = lambda l: sorted((r.doc_id, r.score) for r in quality_classifier.score_documents(documents, l).collect())
    assert score(labels) == score(turned)


def test_flat_traversal_equals_a_walk_down_each_tree():
    random = np.random.Generator(np.random.PCG64(2))
    x = random.random((500, 6)).astype(np.float32)
    y = (x[:, 0] + (x[:, 1] > 0.5) > 1).astype(float)
    model = quality_classifier.fit(x, y, trees=10)
    for row, raw in zip(x, model.raw(x), strict=True):
        total = model.start
        for t in range(10):
            i = 0
            while i < 2**model.depth - 1:
                i = 2 * i + 1 + (row[model.feature[t, i]] > model.threshold[t, i])
            total += model.leaf[t, i - (2**model.depth - 1)]
        assert abs(total - raw) < 1e-9
    assert ((model.score(x) > 0.5) == y).mean() > 0.97


def test_classifier_on_awkward_rows(spark, messy, no_documents):
    labels = spark.createDataFrame([(1, 1, "x"), (1, 1, "x"), (5, 0, "x"), (7, None, "x"), (None, 1, "x"), (8, 0, "x"), (8, 1, "x")], "doc_id long, quality int, score string")
    rows = quality_classifier.score_documents(messy, labels).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(not r.held_out for r in rows if r.doc_id is None)
    assert {r.score for r in quality_classifier.score_documents(messy, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.score_documents(no_documents, labels).collect() == []
