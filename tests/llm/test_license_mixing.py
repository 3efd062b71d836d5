"""Licence scan on written fixtures; mixing against a plain version."""

import hashlib
import itertools
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallywork.llm import license_scan, mixing
from samples import edge_pages, no_pages  # noqa: F401

MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files, to deal in it. The above copyright notice and this permission notice
shall be included in all copies or substantial portions. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the conditions are met. Redistributions of source code must retain the above
copyright notice. Redistributions in binary form must reproduce the above copyright notice."""
BSD3 = BSD + " Neither the name of X nor that of others may be used to endorse or promote products derived from this software."


def test_licences_by_their_sentences(spark):
    texts = {
        1: ["MIT"], 2: ["BSD-2-Clause"], 3: ["BSD-3-Clause"], 4: ["Apache-2.0"], 5: ["GPL-3.0"], 6: ["CC-BY-NC-4.0"], 7: ["MIT"],
        8: ["MIT", "Apache-2.0"], 9: [], 10: [], 11: [], 12: ["all-rights-reserved"], 13: ["GPL-or-later"], 14: [],
    }
    rows = [
        (1, MIT), (2, BSD), (3, BSD3), (4, "Title\nLicensed under the Apache License, Version 2.0.\nrest"),
        (5, "Some text. This work is licensed under the GNU General Public License, version 3."), (6, "Licensed under CC BY-NC 4.0."),
        (7, "x " * 50_000 + ". Released under the MIT License."), (8, MIT + "\n\nLicensed under the Apache License, Version 2.0."),
        (9, None), (10, ""), (11, "A license of its own making."), (12, "Copyright 1999 Me. All rights reserved."),
        (13, "You can redistribute it and/or modify it under the terms of the GNU General Public License as published; either version 2 "
             "of the License, or (at your option) any later version."), (14, "Binary first. Redistributions in binary form must reproduce "
             "the above copyright notice."),
    ]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert {r["page_id"]: r["licenses"] for r in got} == texts
    by_id = {r["page_id"]: r for r in got}
    assert by_id[11]["n_unknown"] == 1 and by_id[14]["n_known"] == 1 and by_id[9]["sentences"] == []


def written_out(pattern):
    """Every text of a pattern of words, groups, choices and optional parts; one for each "any characters" and class."""
    def expand(parsed):
        parts = []
        for op, arg in parsed:
            op = str(op)
            if op == "LITERAL":
                parts.append([chr(arg)])
            elif op == "IN":
                parts.append([chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])])
            elif op == "ANY":
                parts.append(["x"])
            elif op == "SUBPATTERN":
                parts.append(expand(arg[-1]))
            elif op == "BRANCH":
                parts.append([t for one in arg[1] for t in expand(one)])
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, one = arg
                low = max(low, str(one[0][0]) == "ANY")
                parts.append([t * n for t in expand(one) for n in {low, min(int(high), max(low, 1))}])
            elif op != "AT" and not op.startswith("ASSERT"):
                raise ValueError(op)
        return ["".join(t) for t in itertools.product(*parts)]
    return [" ".join(t.split()) for t in expand(re._parser.parse(pattern))]


def test_wrapped_and_commented_sentences(spark):
    sentences = [(name, text) for name, pattern in license_scan.SENTENCES for text in written_out(pattern)]
    assert {name for name, _ in sentences} == {name for name, _ in license_scan.SENTENCES}
    breaks = (" ", "\n", "\r\n  ", "\n# ", "\n// ", "\n * ")
    rows = [(i, f"Some words. {b.join(text.capitalize().split())}. More words.") for i, (b, (_, text)) in enumerate(itertools.product(breaks, sentences))]
    got = {r["page_id"]: r["sentences"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    wanted = [name for _ in breaks for name, _ in sentences]
    assert [(rows[i][1], got[i]) for i, name in enumerate(wanted) if name not in got[i]] == []
    for text in ("All rights\nreserved.", "dedicated to the public\ndomain", "available under the CC BY 4.0", "released under a CC BY 4.0"):
        one = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "page_id long, html string")).first()
        assert len(one["licenses"]) == one["n_known"] == 1


def test_licence_words_of_unknown_sentences(spark):
    texts = [("as, is", 0), ("as%%% is", 0), ("as  is", 1), ("as-is", 1), ("some rights\n# reserved", 1), ("under the CC licence", 1), ("basis", 0)]
    rows = [(i, text) for i, (text, _) in enumerate(texts)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert sorted((r["page_id"], r["n_unknown"], r["n_known"]) for r in got) == [(i, n, 0) for i, (_, n) in enumerate(texts)]


def test_versions_of_gnu_headers(spark):
    may = "This program is free software; you can redistribute it and/or modify it under the terms of "
    hope = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without more. " \
           "You should have received a copy of the GNU General Public License along with it."
    fsf = "as published by the Free Software Foundation"
    gpl, lesser, affero = (f"the GNU {x}General Public License" for x in ("", "Lesser ", "Affero "))
    later = "of the License, or (at your option) any later version."
    texts = [
        (f"{may}{gpl} version 2 {fsf}.{hope}", ["GPL-2.0"]), (f"{may}{gpl} {fsf}, either version 3 {later}{hope}", ["GPL-or-later"]),
        (f"{may}{gpl}\n# {fsf}; either version 2\n# {later}", ["GPL-or-later"]), (f"{may}{gpl} {fsf}; version 2 of the License.{hope}", ["GPL-2.0"]),
        (f"{may}{gpl} {fsf}; either version 2, or (at your option) any later version.", ["GPL-or-later"]), (f"{may}{gpl} {fsf}.{hope}", ["GPL"]),
        (f"{may}{gpl}, version 3.0, {fsf}.", ["GPL-3.0"]), (f"{may}version 2 of {gpl} {fsf}.", ["GPL-2.0"]),
        (f"{may}{gpl} version 2 or later.", ["GPL-or-later"]), (f"{may}version 2 of {gpl}, or any later version.", ["GPL-or-later"]),
        (f"{may}{lesser} {fsf}; either version 2.1 {later}", ["LGPL-or-later"]), (f"{may}{lesser} version 2.1 {fsf}.", ["LGPL-2.1"]),
        (f"{may}{affero} {fsf}, either version 3 {later}", ["AGPL-or-later"]), (f"{may}{affero}, version 3, {fsf}.", ["AGPL-3.0"]),
        (f"{may}{gpl} {fsf}, either version 2 of the License, or (at your option) version 3.", ["GPL-2.0", "GPL-3.0"]),
        (f"{may}{lesser}.", ["LGPL"]), (f"{may}{gpl}. It needs Python version 3 or later.", ["GPL"]),
        (MIT + f" {may}{gpl} version 2 {fsf}.", ["MIT", "GPL-2.0"]),
    ]
    rows = [(i, text) for i, (text, _) in enumerate(texts)]
    got = {r["page_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert [(text, got[i]["licenses"]) for i, (text, want) in enumerate(texts) if got[i]["licenses"] != want] == []
    assert got[1]["sentences"][:2] == ["gpl_redistribute", "gpl_or_later"] and (got[1]["n_known"], got[1]["n_unknown"]) == (3, 0)
    assert got[17]["sentences"][:3] == ["copyright_line", "mit_grant", "mit_notice"]  # the first two in one sentence


def test_licence_edges(edge_pages, no_pages):
    assert license_scan.scan_licenses(edge_pages).count() == edge_pages.count()
    assert license_scan.scan_licenses(no_pages).count() == 0


def plain_share(children, budget):
    """Rounds of sharing by weight until no child overflows: children is {name: (capacity, weight)}."""
    given, open_ = {}, dict(children)
    while open_:
        left, w = budget - sum(given.values()), sum(x[1] for x in open_.values())
        full = {k for k, (c, weight) in open_.items() if c * w <= left * weight}
        if not full:
            return given | {k: left * weight // w for k, (_, weight) in open_.items()}
        for k in full:
            given[k] = open_.pop(k)[0]
    return given


def plain_mix(rows, weights, share, epochs, seed):
    leaf = defaultdict(list)
    for ride_id, a, b, size in rows:
        leaf[a, b].append((ride_id, max(size or 0, 0)))
    size = {k: sum(s for _, s in v) for k, v in leaf.items()}

    def w(level, value):
        return weights[level].get(value, 1)
    capacity = {k: v * epochs if w(0, k[0]) and w(1, k[1]) else 0 for k, v in size.items()}
    total = sum(size.values()) * share[0] // share[1]
    tops = {a: sum(c for k, c in capacity.items() if k[0] == a) for a in {k[0] for k in leaf}}
    first = plain_share({a: (c, max(w(0, a), 1)) for a, c in tops.items()}, total)
    out = []
    for a in tops:
        second = plain_share({k: (capacity[k], max(w(1, k[1]), 1)) for k in leaf if k[0] == a}, first[a])
        for k, budget in second.items():
            full, rest = divmod(budget, size[k]) if size[k] else (0, 0)
            draw = {r: hashlib.md5(f"{seed}|{full + 1}|{r}".encode()).hexdigest() for r, _ in leaf[k]}
            reached = 0
            last = ""
            for d in sorted(set(draw.values())):
                if reached >= rest:
                    break
                last = d
                reached += sum(s for r, s in leaf[k] if draw[r] == d)
            out += [(r, e) for r, s in leaf[k] for e in range(1, full + 1 + (rest > 0 and draw[r] <= last))]
    return sorted(out)


def test_rides_mixed_to_weights(spark):
    kinds = ["classic_bike", "electric_bike", "docked_bike", None, "cargo"]
    rows = [(f"r{i}", kinds[min(i % 13, 4) if i % 3 else 0], "member" if i % 7 else ("casual" if i % 2 else None), i % 40) for i in range(700)]
    rows += [("r1", kinds[0], "member", 5)] * 3 + [("x", "cargo", "casual", None), ("y", "cargo", "casual", -4)]
    rides = spark.createDataFrame(rows, "ride_id string, rideable_type string, member_casual string, ride_length int")
    weights = ({"classic_bike": 1, "electric_bike": 6, "docked_bike": 3, "cargo": 0}, {"member": 1, "casual": 4})
    for share, epochs in (((1, 2), 1), ((1, 1), 3), ((5, 1), 2), ((0, 1), 2)):
        got = mixing.mix_to_weights(
            rides, ["rideable_type", "member_casual"], weights, ["ride_id"], "ride_length", share=share, max_epochs=epochs, seed=7)
        assert got.columns == [*rides.columns, "epoch"]
        assert sorted((r["ride_id"], r["epoch"]) for r in got.collect()) == plain_mix(rows, weights, share, epochs, 7)


def test_no_rides(spark):
    rides = spark.createDataFrame([], "ride_id string, rideable_type string, ride_length int")
    assert mixing.mix_to_weights(rides, ["rideable_type"], [{}], ["ride_id"], "ride_length", budget=10).count() == 0


@pytest.mark.parametrize("small", [100_000, 0])
def test_records_of_a_hot_leaf_stay_where_they_are(spark, monkeypatch, small):
    monkeypatch.setattr(mixing, "SMALL_ROWS", small)
    rows = [(i, "hot" if i % 10 else f"few{i % 3}", "x" * (i % 7)) for i in range(2000)] + [(5000, None, "y"), (5001, "hot", None), (5001, "hot", None)]
    records = spark.createDataFrame(rows, "id long, kind string, text string").withColumn("size", F.length("text"))
    mixed = mixing.mix_to_weights(records, ["kind"], [{"hot": 1}], ["id"], "size", share=(1, 2), max_epochs=2, seed=3)
    assert mixed.columns == [*records.columns, "epoch"]
    totals = {r["kind"]: r["s"] for r in mixed.groupBy("kind").agg(F.sum("size").alias("s")).collect()}
    whole = sum(len(t or "") for _, _, t in rows)
    caps = {k: (2 * sum(len(t or "") for _, kind, t in rows if kind == k), 1) for k in {k for _, k, _ in rows}}
    want = plain_share(caps, whole // 2)
    assert set(totals) <= set(want) and all(0 <= totals[k] - want[k] < 7 for k in totals)
    if small:
        plan = mixed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
