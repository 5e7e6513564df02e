import random

import pytest

from docframe.llm import licenses as lic


def brute_force(text):
    out = []
    for kind, no, part in lic.units(text or ""):
        a, found = lic.bigrams(part), []
        for name, template in lic.TEMPLATES:
            b = lic.bigrams(template)
            dice = 2.0 * len(a & b) / (len(a) + len(b)) if a and b else 0.0
            if dice >= lic.THRESHOLD:
                found.append((-dice, name))
        if found:
            out.append((kind, no, min(found)[1], -min(found)[0]))
    return out


TEXTS = [
    "Released under the MIT License.", "prose first\n  RELEASED under the -- mit LICENSE!!\nprose last", f"{lic.MIT_GRANT}\n\n{lic.MIT_DISCLAIMER}",
    f"Copyright 2020 X\n\n{lic.MIT_GRANT} {lic.MIT_DISCLAIMER}", lic.MIT_GRANT[:200], "license", "", None, "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.",
    "the " * 50_000 + "\nSPDX-License-Identifier: MIT", "İK Licensed under the Apache License, Version 2.0.", "a\n \t\nb\n\n\nReleased under the MIT License.",
]


def test_pruning_loses_nothing(spark, tmp_path):
    rows = [(i, t, "c", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "c", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, license string, no int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["unit"], r["no"], r["license"], r["dice"]) for r in lic.op8_licenses(spark, str(tmp_path)).collect())
    assert got == sorted((i is None, i or 0, *x) for i, t, _, _ in rows for x in brute_force(t))
    assert len(got) > 8


def test_same_rows_as_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(c.sql(lic.oracle()).fetchall())
    assert sorted(tuple(r) for r in lic.op8_licenses(spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("n", [1, 7, 50, 400])
def test_size_bounds(n):
    m = lic.Matcher(list(lic.TEMPLATES), 0.8)
    for size in m.sizes:
        best_possible = 2 * min(n, size) / (n + size)
        lo, hi = n * 0.8 / 1.2 - 1e-9, n * 1.2 / 0.8 + 1e-9
        assert (lo <= size <= hi) or best_possible < 0.8


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert lic.op8_licenses(spark, str(tmp_path)).collect() == []


def prose(n, seed=0):
    rng = random.Random(seed)
    words = "of the in and software license any terms stream copy is a under river stone light with for".split()
    return " ".join(rng.choice(words) + rng.choice(["", "", "ing"]) for _ in range(n))


GPL = dict((n, t) for n, t in lic.TEMPLATES)["GPL-3.0-or-later"]
BSD_2 = next(t for n, t in lic.TEMPLATES if n == "BSD-2-Clause")


def planted():
    gpl = GPL.replace("any later version. ", "any later version.\n\n")
    bsd = BSD_2.replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").replace(" THIS ", "\n\nTHIS ")
    body = dict(lic.bodies())
    return [
        (f"{prose(3000, 1)}\n\n{gpl}\n\n{prose(3000, 2)}", ["GPL-3.0-or-later"]),
        (f"{prose(900, 3)}\n\n{bsd}\n\n{prose(2000, 4)}", ["BSD-2-Clause"]),
        (f"{prose(50, 5)} This code is Licensed under the MIT License. See LICENSE in the project root for license information. {prose(60, 6)}", ["MIT"]),
        (f"{prose(80, 7)} Licensed under CC BY-SA 4.0. {prose(80, 8)} Licensed under CC BY-NC 4.0. {prose(80, 9)}", ["CC-BY-SA-4.0", "CC-BY-NC-4.0"]),
        (body["GPL-3.0"], ["GPL-3.0"]),
        (f"{prose(700, 10)}\n\n{body['Apache-2.0']}\n\n{prose(400, 11)}\n\n{gpl}", ["Apache-2.0", "GPL-3.0-or-later"]),
        (f"{prose(60, 12)} Licensed under the Apache License, Version 1.1. {prose(60, 13)} Licensed under CC BY-NC-ND 4.0. {prose(60, 14)} SPDX-License-Identifier: LGPL-2.1 {prose(9, 15)}", []),
        (prose(20_000, 16), []),
    ]


def test_licenses_inside_long_prose(spark, tmp_path):
    rows = [(i, t) for i, (t, _) in enumerate(planted())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {i: [] for i, _ in rows}
    for r in sorted(lic.op8_licenses(spark, str(tmp_path)).collect(), key=lambda r: (r["doc_id"], r["no"])):
        got[r["doc_id"]].append(r["license"])
    assert got == {i: names for i, (_, names) in enumerate(planted())}


def all_windows(text, templates, t):
    """Every window by the definition, the best one first, then the rest on either side of it."""
    words = lic.words_of(text)
    borders = [sum(len(lic.WORD.findall(x)) for x in text.split("\n")[:k]) for k in range(text.count("\n") + 2)]
    found = []
    for i in range(len(words)):
        for j in range(i + 2, len(words) + 1):
            a = set(zip(words[i:j], words[i + 1 : j]))
            for name, template in templates:
                b = lic.bigrams(template)
                dice = 2.0 * len(a & b) / (len(a) + len(b))
                if dice >= t and (j - i >= len(lic.words_of(template)) or (i in borders and j in borders)):
                    found.append((-dice, -len(b), name, i, j))
    taken = []
    for dice, _, name, i, j in sorted(found):
        if all(j <= lo or hi < i for lo, hi, *_ in taken):
            taken.append((i, j - 1, name, -dice))
    return sorted(taken)


@pytest.mark.parametrize("seed", range(40))
def test_windows_against_brute_force(seed):
    rng = random.Random(seed)
    templates = [("X", "a b c d e"), ("Y", "a b c d f g h a b"), ("Z", "q a b\nr s a b t")]
    parts = [rng.choice([*(t for _, t in templates), "a b c d", "b c d e", "n", "o\n", "a", "\n", "f g h", "s a b"]) for _ in range(rng.randint(1, 12))]
    text = " ".join(parts)
    assert lic.Windows(templates, 0.8).best(text, lic.bigrams(text)) == all_windows(text, templates, 0.8)
