import re
from collections import Counter

import pytest
from helpers import clashing, frame, messy, prose, row
from test_decontaminate import cut

from arbiter.llm import licenses as L


def bag(w):
    return Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)


def plain(rows, notices, threshold=0.75):
    """Every window of every text, then the best a start and the best within the template's size."""
    out = []
    for r in rows:
        w = cut(r[1]) if r[1] is not None else []
        for name, t in dict.fromkeys(notices):
            b = bag(cut(t or ""))
            n, best = sum(b.values()), {}
            for i in range(len(w) if n and set(w) & set(cut(t)) else 0):
                for j in range(i + 1, min(len(w), i + 2 + int(n * (2 - threshold) / threshold + 1e-9)) + 1):
                    if w[i] not in (cut(t)):
                        break
                    a = bag(w[i:j])
                    dice = 2 * sum((a & b).values()) / (sum(a.values()) + n)
                    if dice >= threshold - 1e-12 and dice > best.get(i, (0, 0))[0]:
                        best[i] = (dice, j)
            for i, (dice, j) in best.items():
                if not any(abs(i - k) < n and (d > dice or (d == dice and k < i)) for k, (d, _) in best.items()):
                    out.append((r[0], i, j, name, t, round(dice, 9)))
    return sorted(map(str, out))


def found(df):
    return sorted(str((g.doc_id, g.start_word, g.end_word, g.license, g.template, round(g.dice, 9))) for g in df.collect())


ROWS = messy() + [row(30, prose(1, 30) + "\nLicensed under the APACHE license,  version 2.0\n" + prose(2, 30)), row(31, "licensed under cc-by 4.0!"),
                  row(32, "All rights reserved"), row(32, "all rights reserved\nall Rights, reserved."), row(33, "Released under a MIT License."),
                  row(34, "This work is licensed under the GNU General Public License version 3 or later"), row(35, "two line\nnotice text here"),
                  row(36, "reserved reserved rights all"), row(37, "word"), row(39, "all rights reserved " * 4), row(40, "a b a b a b c"), row(41, "x word, word and a b a b a"), row(38, "public public public public license")]


def test_matches_plain_python(spark):
    want = plain(ROWS, L.TEMPLATES)
    assert len(want) >= 8 and found(L.scan_licenses(clashing(spark, ROWS), L.templates(spark))) == want


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.9, 1.0])
def test_own_templates_and_thresholds(spark, threshold):
    notices = [("two", "two line\nnotice text here"), ("one", "word"), ("tie", "two line\nnotice text here"), ("null", None), ("blank", " "),
               ("quote", "all 'rights' reserved"), ("repeat", "a b a b a")]
    assert found(L.scan_licenses(frame(spark, ROWS), L.templates(spark, notices), threshold)) == plain(ROWS, notices, threshold)


GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright notice."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"""


def test_wrapped_embedded_and_whole_notices(spark):
    rows = [row(1, GPL), row(2, prose(1, 400) + "\n" + BSD + "\n" + prose(2, 400)), row(3, MIT),
            row(4, "Copyright 2020 Foo. Released under the MIT License."), row(5, prose(3, 50) + " Released under the MIT License. " + prose(4, 50)),
            row(6, prose(5, 3000)), row(7, "The terms of the license of the program are under the version of the public")]
    got = L.scan_licenses(frame(spark, rows), L.templates(spark)).collect()
    assert {(g.doc_id, g.license) for g in got} == {(1, "GPL-3.0"), (2, "BSD-3-Clause"), (3, "MIT"), (4, "MIT"), (5, "MIT")}
    assert found(L.scan_licenses(frame(spark, rows), L.templates(spark))) == plain(rows, L.TEMPLATES)


def test_many_templates_are_joined(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LITERALS", 3)
    assert found(L.scan_licenses(frame(spark, ROWS), L.templates(spark), max_broadcast=3)) == plain(ROWS, L.TEMPLATES)


def test_empty_tables(spark):
    assert L.scan_licenses(frame(spark, []), L.templates(spark)).count() == 0
    assert L.scan_licenses(frame(spark, ROWS), L.templates(spark, [])).count() == 0


def test_no_python_on_executors(spark):
    plan = L.scan_licenses(frame(spark, ROWS), L.templates(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("BatchEvalPython|Pandas|Arrow|MapInPython", plan)
