from tagatlas.llm import licenses as L
from tests.llm.cases import documents, empty


def test_scan(spark):
    invented = ["Licensed under the Zelmi License, Version 4.0.", "Released under the Brova Public License, version 2."]
    prose = ["She renewed her licence for driving in town on a rainy Monday.", "mit der Lizenz", "No notice here.", "A copyright dispute went on for years between the two painters."]
    rows = [(k, "Some words first.\n" + n + "\nand more", f) for k, (f, n) in enumerate((f, n) for f, x in L.NOTICES.items() for n in x)]
    rows += [(1000 + k, t, "?") for k, t in enumerate(invented)] + [(2000 + k, t, "") for k, t in enumerate(prose)]
    rows += [(3000, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", "cc-by-nc,mit"), (3000, rows[0][1], rows[0][2])]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string, want string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.want == "?":
            assert (r.license_families, r.n_unknown) == ("", 1), r
        else:
            assert r.license_families == r.want, r
    assert next(r.n_notices for r in got if r.want == "cc-by-nc,mit") == 3
    assert L.scan(documents(spark)).where("license_families <> ''").count() == 0
    assert L.scan(documents(spark)).count() == documents(spark).count() and L.scan(empty(spark)).count() == 0


def test_held_out_accuracy():
    m = L.train()
    weights = dict(m.weights)
    rows = L.examples(99, 30)
    right = 0
    for w, c in rows:
        z = list(m.bias)
        for g in L.grams(w):
            for k, x in enumerate(weights.get(g, ())):
                z[k] += x
        right += m.classes[max(range(len(z)), key=z.__getitem__)] == c
    assert right / len(rows) > 0.95


def test_names_alone_and_wrapped_notices(spark):
    rows = [
        ("Distributed under LGPL-2.1 or later.", "", 0, 1),
        ("Released under AGPLv3.", "", 0, 1),
        ("BSD-3-Clause", "bsd", 1, 0),
        ("Apache-2.0", "apache-2.0", 1, 0),
        ("Released under MIT", "mit", 1, 0),
        ("Ich gehe mit der Katze. Apache helicopters flew by. A gnu runs.", "", 0, 0),
        ("This program is licensed under the terms of the\nGNU Affero General Public\nLicense, version 3", "agpl-3.0", 1, 0),
        ("/*\n * Prose here.\n * This work is licensed under a Creative\n * Commons Attribution-ShareAlike 4.0\n * International License.\n */", "cc-by-sa", 1, 0),
        ("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0", "apache-2.0,mit", 2, 0),
        ("Licensed under the Zelmi License, Version 4.0\nReleased under the MIT License", "mit", 1, 1),
    ]
    got = L.scan(spark.createDataFrame(rows, "text string, families string, notices long, unknown long")).collect()
    assert [(r.text, r.license_families, r.n_notices, r.n_unknown) for r in got if (r.license_families, r.n_notices, r.n_unknown) != (r.families, r.notices, r.unknown)] == []


def test_copies_are_spread_and_names_may_clash(spark):
    names = "doc_id long, text string, key string, row string, hit string, at int, salt int, run int, runs string, n_unknown string, families string, m map<string,int>"
    rows = [(k, "Released under the MIT License." if k % 3 == 0 else None if k % 3 == 1 else f"own {k}", "k", "r", "h", 1, 2, 3, "u", "old", "f", {"a": 1}) for k in range(90)]
    docs = spark.createDataFrame(rows, names)
    got = L.scan(docs).collect()
    assert len(got) == 90 and all((r.license_families, r.n_notices, r.n_unknown) == (("mit", 1, 0) if r.doc_id % 3 == 0 else ("", 0, 0)) for r in got)
    assert all((r.key, r.row, r.hit, r.at, r.salt, r.run, r.runs, r.families, r.m) == ("k", "r", "h", 1, 2, 3, "u", "f", {"a": 1}) for r in got)
    assert "text" not in L.scan(docs, keep_text=False).columns
