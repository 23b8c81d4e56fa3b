"""License scan, decontamination and secret scan against brute force."""

import hashlib
import random
import re
import time
from collections import Counter

import duckdb
import pytest

from equiscan.llm import decontamination, license_scan, secret_scan
from equiscan.llm.queries import ORACLES, QUERIES
from equiscan.session import staged

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORDS.findall((text or "").translate(LOWER))


def base_phrases(text):
    words, starts, labels = words_of(text), [], set()
    for phrase, label in license_scan.BASE_PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += here
        labels |= {label} if here else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_base_equals_brute_force(documents, messy, texts):
    for r in license_scan.scan_licenses(documents).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_phrases(texts[r.doc_id])
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_notices_are_found_by_their_rare_words_and_mandatory_phrases(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    rows = [
        (1, f"some words before. {mit} and more"),
        (2, mit.replace("of this software", "of that software")),  # a mandatory phrase is broken
        (3, "permission was granted free of the software charge copy"),  # words out of place
        (4, "Licensed under CC BY-SA 4.0. All rights reserved. cc-by"),
        (5, "granted free of charge to any person obtaining a copy of this software"),  # begins before the text
        (6, "released under the MIT License. Released under the MIT license."),
    ]
    found = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].labels == "mit" and found[1].score == 1.0 and found[1].notices[0].first_word == 3
    assert found[2].labels == found[3].labels == found[5].labels == ""
    assert found[4].labels == "cc-by,cc-by-sa,reserved" and found[4].n_base == 3 and found[4].score == 1.0
    assert found[6].labels == "mit" and [n.first_word for n in found[6].notices] == [0, 5]


def test_a_text_with_all_notices_gets_all_labels(spark):
    text = ".\n".join(n.text for n in license_scan.NOTICES)
    found = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    labels = {n.label for n in license_scan.NOTICES}
    assert {n.label for n in found.notices if n.coverage == 1} == labels and labels <= set(found.labels.split(","))


def brute_notices(text):
    words, found = words_of(text), set()
    for n in license_scan.NOTICES:
        w = n.text.split()
        at = {i + j: p for m in n.mandatory for i in [len(f" {n.text} ".split(f" {m} ")[0].split())] for j, p in enumerate(m.split())}
        for base in range(-len(w), len(words)):
            here = lambda i: words[base + i] if 0 <= base + i < len(words) else None  # noqa: B023, E731
            if all(here(i) == p for i, p in at.items()):
                found.add((n.label, base, sum(here(i) == x for i, x in enumerate(w)) / len(w)))
    return found


def test_mandatory_phrases_in_place_suffice_in_a_corpus_that_uses_the_other_words(spark):
    alone = ["available under the Mozilla Public License version 2.0", "Eclipse Public License", "The MIT License", "this is free and unencumbered software"]
    alone += ["cc-by-nc", "x " * 50 + "gnu general public license version 2 or gnu general public license version 3"]
    common = ["mit lizenz by nc cc", "free software version 2 0", "license under the terms"] * 4
    texts = dict(enumerate([*alone, *common, " ".join(alone * 3), ". ".join(n.text for n in license_scan.NOTICES)]))
    rows = license_scan.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    got = {r.doc_id: {(n.label, n.first_word, n.coverage) for n in r.notices} for r in rows}
    assert got == {i: brute_notices(t) for i, t in texts.items()}
    assert [{n[0] for n in got[i]} for i in range(6)] == [{"mpl-2.0"}, {"epl"}, {"mit"}, {"unlicense"}, {"cc-by-nc"}, {"gpl-2.0", "gpl-3.0"}]


def test_notices_equal_brute_force(documents, texts):
    for r in license_scan.scan_licenses(documents).collect():
        assert {(n.label, n.first_word, n.coverage) for n in r.notices} == brute_notices(texts[r.doc_id])


def test_words_present_are_computed_once_a_text(spark, monkeypatch):
    """Not again for each set of indexed words that they are compared with."""
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return staged(df, name)

    monkeypatch.setattr(license_scan, "staged", kept)
    license_scan.scan_licenses(spark.createDataFrame([(1, "the mit license")], "doc_id long, text string")).collect()
    steps = [line for line in plans[0].splitlines() if "array_intersect(" in line]
    assert len(steps) == 1 and "lambdafunction(" not in steps[0]


def test_license_on_awkward_rows(messy, no_documents):
    rows = license_scan.scan_licenses(messy).collect()
    assert len(rows) == messy.count() and all(r.labels == "" and r.first_word is None for r in rows)
    assert license_scan.scan_licenses(no_documents).collect() == []


def brute_contamination(text, items, window=13):
    words, hit, named = words_of(text), set(), set()
    for item_id, item in items:
        w = words_of(item)
        m = min(len(w), window)
        grams = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(words) - m + 1 if m else 0):
            if tuple(words[i : i + m]) in grams:
                hit |= set(range(i, i + m))
                named.add(str(item_id))
    return len(words), len(hit), sorted(named)


def test_contamination_equals_brute_force_on_made_cases(spark):
    a, b = [f"a{i}" for i in range(30)], [f"b{i % 7}" for i in range(20)]
    items = [(1, " ".join(a)), (2, " ".join(b)), (3, "short item of six words here"), (4, "the"), (5, None), (6, "..."), (1, " ".join(a)), (None, " ".join(a[:13]))]
    docs = [
        (1, "x y " + " ".join(a[3:20]) + " z"),
        (2, " ".join(a[:12]) + " z " + " ".join(a[12:24])),  # no 13 in a row
        (3, " ".join(b * 3)),
        (4, "Short ITEM, of six words here! short item of six words here"),
        (5, "the the of the"),
        (6, " ".join(a[17:]) + " " + " ".join(a)),
        (7, " ".join(a[i] for i in (0, 2, 1, 4, 3, 6, 5, 8, 7, 10, 9, 12, 11, 13, 14))),  # near, never exact
        (8, None),
        (9, ""),
        (1, "x y " + " ".join(a[3:20]) + " z"),
    ]
    found = decontamination.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = sorted((r.doc_id, r.n_words, r.n_hit, tuple(r.items), r.contaminated, r.n_near) for r in found.collect())
    expected = []
    for doc_id, text in docs:
        n, hit, _ = brute_contamination(text, items)
        _, _, named = brute_contamination(text, [i for i in items if i[0] is not None])
        expected.append((doc_id, n, hit, tuple(named), hit > 0 and 20 * hit >= n))
    assert [r[:5] for r in rows] == sorted(expected)
    assert next(r for r in rows if r[0] == 7)[5] >= 1


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_same_as_sql(spark, small, key):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    df = QUERIES[key](spark, small)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[key]})").fetchall(), key=str)


def test_contamination_on_awkward_rows(spark, messy, no_documents):
    items = spark.createDataFrame([(1, "seven wise owls watch from an old oak near the mill", 1), (2, "w7 " * 3, 2)], "item_id long, text string, base int")
    rows = decontamination.find_contamination(messy, items).collect()
    assert len(rows) == messy.count()
    assert all(r.contaminated and r.items == ["1"] for r in rows if r.doc_id in (1, 7))
    assert all(r.n_words == 0 and not r.contaminated for r in rows if r.doc_id in (2, 3, 4, 11))
    assert all(r.n_hit == 0 for r in decontamination.find_contamination(messy, items.limit(0)).collect())
    assert decontamination.find_contamination(no_documents, items).collect() == []


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    return sorted(spans + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16])


def test_secret_base_equals_brute_force(spark, small, texts):
    rows = QUERIES["op9_linked_secrets"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base_spans(texts[r.doc_id])
        n = Counter(kind for _, _, kind, _ in spans)
        written = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()


ID, KEY = "AKIA" + "Z" * 16, "Ab3/" * 10


def secrets(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [[(s.kind, s.start, s.end) for s in r.spans] for r in sorted(secret_scan.scan_secrets(df).collect(), key=lambda r: r.doc_id)]


def test_weak_parts_count_only_beside_a_complement(spark):
    far = " ." * 200
    found = secrets(
        spark,
        f"é😀 {ID} and {KEY}",
        f"{ID}{far} {KEY}",
        f"just {KEY} here",
        "user = bob password: hunter2",
        "password: hunter2",
        "user = bob",
        f"see https://example.com/x with {KEY}",
        "see https://example.com/x",
        f"token = {KEY}",
    )
    assert found[0] == [("access", 3, 23), ("key", 28, 68)]
    assert [k for k, _, _ in found[1]] == ["access"] and found[2] == []
    assert [k for k, _, _ in found[3]] == ["user", "short"] and found[4] == found[5] == found[7] == []
    assert [k for k, _, _ in found[6]] == ["endpoint", "key"]
    assert [k for k, _, _ in found[8]] == ["assign"]


def test_a_failing_match_uses_up_its_text(spark):
    texts = ["token=secret: abcdefghijklmnop", "token: password=abcdefghijklmnop", "PassWd'  =  'x" + "y" * 20, "a" * 15 + " " + "b" * 16, "AKIAAKIA" + "A" * 9]
    assert secrets(spark, *texts) == [[(k, a, b) for a, _, k, b in base_spans(t)] for t in texts]


def test_secrets_on_awkward_rows(messy, no_documents):
    rows = secret_scan.scan_secrets(messy).collect()
    assert len(rows) == messy.count() and all(r.spans == [] for r in rows)
    assert secret_scan.scan_secrets(no_documents).collect() == []


def test_secrets_in_long_words_and_among_many_matches(spark):
    """Each of these took minutes or more where a pattern or a frame was walked anew from every place."""
    word, run = "x" * 300_000, "http" + "s" * 100_000
    many = " ".join(f"{i:016x}" for i in range(50_000))
    started = time.time()
    found = secrets(spark, f"://{word}", f"{run} ://", f"https://{word}", many, f"token=abcd {word}")
    assert found[:3] == [[], [], []] and len(found[3]) == 50_000 and found[4] == []
    assert time.time() - started < 60


def brute_links(text, scope):
    """Spans by comparing every weak part with every other part."""
    parts = []
    for nth, kind in enumerate(secret_scan.KINDS):
        for m in re.finditer(kind.pattern, text):
            if kind.least <= len(m.group(kind.value)) <= kind.most:
                parts.append((m.start(), nth, kind, m.end()))
    strong = [p for p in parts if not p[2].weak]
    clear = [p for p in parts if not p[2].weak or not any(s[0] < p[3] and p[0] < s[3] for s in strong)]
    out = []
    for start, nth, kind, end in clear:
        others = secret_scan.COMPLEMENTS.get(kind.role, ())
        linked = any(k.role in others and (start - e <= scope if (s, n) < (start, nth) else s - end <= scope) for s, n, k, e in clear if (s, n) != (start, nth))
        if not kind.weak or linked:
            out.append((kind.name, start, end))
    return [x for *_, x in sorted((s, [k.name for k in secret_scan.KINDS].index(n), (n, s, e)) for n, s, e in out)]


def test_links_equal_an_interval_join_of_all_pairs(spark):
    draw = random.Random(11)
    pieces = ["password=abcdef", "token: " + "q" * 20, "user=bob", "login: alice99", "https://host/x", "AKIA" + "B" * 16, "0123456789abcdef", "K" * 40, "words", "x" * 90, "secret=ab", "\n", "passwd = hunter2", "ftp://a"]
    texts = [" ".join(draw.choice(pieces) for _ in range(draw.randint(0, 25))) for _ in range(120)]
    assert secrets(spark, *texts) == [brute_links(t, secret_scan.SCOPE) for t in texts]
