import re

from quern.llm import queries
from quern.llm.license_scan import BASE, COVER, GAP, NOTICES, REFERENCES, STRETCH, scan_licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    places = [(i, label) for label, phrase in BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def brute_labels(text):
    """Labels and the best score: votes by diagonal, chains of near diagonals, then every window of each chain."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    labels, best = set(brute(text)[4].split(",")) - {""}, 1.0 if brute(text)[1] else 0.0
    at: dict = {}
    for i, pair in enumerate(zip(words, words[1:])):
        at.setdefault(pair, []).append(i)
    for label, phrase in [*NOTICES.items(), *REFERENCES]:
        p = phrase.split()
        votes = sorted((d - t, d, t) for t, pair in enumerate(zip(p, p[1:])) for d in at.get(pair, ()))
        spans: list = []
        for v in votes:
            if spans and v[0] - spans[-1][-1][0] <= GAP:
                spans[-1].append(v)
            else:
                spans.append([v])
        for span in spans:
            for _, first, _ in span:
                covered = {t for _, d, t in span if first <= d and d + 2 - first <= STRETCH * len(p)}
                if len(covered) >= COVER * (len(p) - 1):
                    labels.add(label)
                    best = max(best, len(covered) / (len(p) - 1))
    return ",".join(sorted(labels)), best


def test_stray_matches_do_not_hide_a_notice(spark):
    apache, cc0 = NOTICES["apache-2.0"], NOTICES["cc0"]
    rows = [(0, apache + " the license" * 30), (1, "to the " * 40 + cc0), (2, "to the " * 40 + cc0 + " to the" * 40), (3, "the license " * 200), (4, f"{apache} {cc0} " * 30)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute_labels(t) for i, t in rows}
    assert got[0][0] == "apache-2.0" and got[1][0] == got[2][0] == "cc0" and got[3][0] == "" and got[4][0] == "apache-2.0,cc0"


def test_query_against_brute_force(spark, sf, texts):
    rows = queries.op3_licenses(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(texts[r["doc_id"]])
        assert (r["labels"], r["score"]) == brute_labels(texts[r["doc_id"]])


def test_notices_survive_edits(spark):
    words = NOTICES["mit"].split()
    changed = words[:6] + ["indeed"] + words[6:12] + words[13:]  # one word more, one word less
    rows = [(0, " ".join(words).upper()), (1, "so " * 50 + " ".join(changed) + " end" * 20), (2, " ".join(words[:9]))]
    found = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0]["labels"] == found[1]["labels"] == "mit"
    assert found[0]["score"] == 1 and 0.7 <= found[1]["score"] < 1
    assert found[2]["labels"] == ""


def test_short_reference_lines(spark):
    lines = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Licensed under the Apache License, Version 1.1.": "",
        "Released under the MIT License.": "mit",
        "Available under the BSD 3-Clause License": "bsd",
        "Subject to the Mozilla Public License, version 2.0": "mpl-2.0",
        "Subject to the Eclipse Public License, Version 2.0": "",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "Released under the terms of a license": "",
    }
    rows = [(i, "some words before. " + line + " And after it") for i, line in enumerate(lines)]
    found = {r["doc_id"]: r["labels"] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [",".join(x for x in found[i].split(",") if x != "cc-by") for i in range(len(rows))] == list(lines.values())


def test_odd_rows(odd, plain, empty):
    rows = scan_licenses(odd).collect()
    assert len(rows) == odd.count()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"]) for r in rows) == sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, brute(r["text"])[0]) for r in plain.collect()
    )
    assert scan_licenses(empty).count() == 0


def test_plan_is_native(spark, sf):
    plan = queries.op3_licenses(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
