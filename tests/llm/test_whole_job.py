"""What the training-data operators must find beyond what the given tables hold."""

from __future__ import annotations

import textwrap

import duckdb
import pytest

from shelfmark.llm import common, decontam, licenses, line_dedup, mixing, sharding
from shelfmark.llm.common import OWN
from shelfmark.llm.queries import ORACLE_SQL, QUERIES


def test_near_copies_with_a_spoilt_short_answer_are_found():
    items = [(k, " ".join(f"q{k}x{j}" for j in range(30)) + f"? a{k} b{k} c{k} d{k} e{k}.") for k in range(20)]
    index = decontam.Index(items)
    checked = 0
    for k, (_, text) in enumerate(items):
        words = decontam.tokens(text)
        copies = [[*words[:p], "edited", *words[p + 1 :]] for p in range(len(words))] + [words[:-n] for n in (1, 2, 3)]
        near = [c for c in copies if index.overlap(index.numbers(c), k, {})[0] >= decontam.OVERLAP]
        checked += len(near)
        for found in index.find([" ".join(["before", *c, "after"]) for c in near]):
            assert index.ids[k] in {i for i, *_ in found}
    assert checked == 20 * 38
    assert index.find([" ".join(decontam.tokens(items[0][1])[:20])]) == [[]]


GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
HEADERS = {
    "GPL-3.0": GNU.format("", "3"), "GPL-2.0": GNU.format("", "2"), "LGPL-3.0": GNU.format("Lesser ", "3"), "LGPL-2.1": GNU.format("Lesser ", "2.1"), "AGPL-3.0": GNU.format("Affero ", "3"),
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
}


@pytest.mark.parametrize("name", sorted(HEADERS))
def test_wrapped_headers_are_joined(name):
    matcher = licenses.Matcher()
    for width in (30, 50, 60, 72, 90):
        for mark in ("// ", " * ", "# ", "rem ", ""):
            header = "\n".join(mark + x for x in textwrap.wrap(HEADERS[name], width))
            found, score = matcher.scan(f"#!/bin/sh\n{mark}Copyright (C) 2020 Some Author\n{header}\nimport os\n\nx = 1\n")
            assert found == name and score > 0.85, (width, mark, score)


def test_paragraphs_of_other_words_are_not_joined():
    matcher = licenses.Matcher()
    assert matcher.scan("Released under\n#\n# something else.\n#\n# the MIT License.\n") == matcher.scan("the MIT License.")


def test_boilerplate_of_small_sites_is_dropped(spark):
    rows = [(100 * n + k, f"https://site{n}.org/{k}", f"<p>Footer</p><p>own {k}</p>" + "<p>thrice</p>" * (k < 3) + "<p>twice</p>" * (k < 2)) for n in (1, 2, 3, 5, 19, 31) for k in range(n)]
    got = {r["page_id"]: r["text"].split("\n") for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i, lines in got.items():
        n, k = divmod(i, 100)
        assert f"own {k}" in lines and ("Footer" in lines) == (n < 3)
        assert ("twice" in lines) == (k < 2)
        assert ("thrice" in lines) == (k < 3 and (n < 3 or n == 31))


def test_line_dedup_equals_its_sql_and_drops_lines(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    rel = c.execute(ORACLE_SQL["op1_line_dedup"])
    got = QUERIES["op1_line_dedup"](spark, sf).select(*[d[0] for d in rel.description]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rel.fetchall()))
    assert sum(r["n_dropped"] for r in got) > 19


def test_planted_boilerplate_is_found(spark):
    """Sites of 4 to 400 pages, each line on a fifth to all of them; own lines, and lines two pages share, stay."""
    import random

    rng, rows, planted = random.Random(9), [], set()
    for site in range(40):
        n = rng.choice([4, 7, 15, 30, 80, 400])
        lines = [(f"site {site} footer {j}", rng.choice([0.3, 0.6, 1.0])) for j in range(6)]
        for k in range(n):
            on = [t for t, share in lines if rng.random() < share]
            planted |= {(site, k, t) for t in on}
            body = "".join(f"<p>own {site} {k} {j}</p>" for j in range(5)) + f"<p>pair {site} {k // 2}</p>"
            rows.append((site * 1000 + k, f"https://s{site}.org/{k}", body + "".join(f"<div>{t}</div>" for t in on)))
    got = {r["page_id"]: r["text"].split("\n") for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    left = sum(t in got[site * 1000 + k] for site, k, t in planted)
    assert left <= 0.1 * len(planted)
    for i, lines in got.items():
        site, k = divmod(i, 1000)
        assert [f"own {site} {k} {j}" for j in range(5)] == lines[:5] and f"pair {site} {k // 2}" in lines


def test_unclosed_tags_and_long_pages_take_little_time(spark):
    import time

    bad = ["<a" * 500_000, "<script " * 130_000, "<!-- " * 200_000, "</script   " * 90_000, "<p" * 400_000, "<style>" + " " * 1_000_000, "x" * 1_000_000, "<p>one</p>" * 100_000, "<p>one</p>" * 100_000, "<script>" + "</script " * 100_000]
    df = spark.createDataFrame([(k, "https://a.org", h) for k, h in enumerate(bad)], "page_id long, url string, html string").repartition(1)
    line_dedup.dedup_lines(df.limit(0)).collect()
    began = time.time()
    got = {r["page_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert time.time() - began < 30 and len(got) == len(bad)
    assert got[7]["n_lines"] == 100_000 and got[7]["n_dropped"] == 0 and got[6]["text"] == bad[6] and got[1]["n_lines"] == 0


def _hot(spark):
    """A third of the rows with a null id and one text, a third with a null id and texts of their own."""
    from pyspark.sql import functions as F

    k = F.col("id") % 3
    return spark.range(12_000).select(F.when(k == 2, F.col("id")).alias("doc_id"), F.when(k == 0, "the same text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"), F.lit("s").alias("source"))


def test_a_hot_key_is_numbered_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "BUCKET_ROWS", 1000)
    df = _hot(spark).repartition(6)
    placed = sharding.with_slots(sharding.assign(df)).cache()
    by: dict[int, list[int]] = {}
    for shard, slot in placed.select(f"{OWN}shard", f"{OWN}slot").collect():
        by.setdefault(shard, []).append(slot)
    assert sum(map(len, by.values())) == 12_000 and all(sorted(s) == list(range(len(s))) for s in by.values())
    same = placed.filter("text = 'the same text'").select(f"{OWN}slot").collect()
    assert len(same) == 4000 and len({s for s, in same}) == 4000
    agreed = lambda d: sorted(map(repr, sharding.with_slots(sharding.assign(d)).select("doc_id", "text", f"{OWN}shard", f"{OWN}slot").collect()))
    assert agreed(df) == agreed(df.repartition(5))
    mixed = lambda d: sorted(map(repr, mixing.mix(d, most=3).select("doc_id", "text", f"{OWN}copies").collect()))
    assert mixed(df) == mixed(df.repartition(5))
    monkeypatch.setattr(common, "BUCKET_ROWS", 1 << 18)
    assert agreed(df) == agreed(df.repartition(5))


def test_the_mix_does_not_depend_on_how_buckets_are_cut(spark, tmp_path, monkeypatch):
    """3,000 documents and 700 repeated rows: the same rows as in SQL, whether a bucket is cut at heavy hashes or not."""
    rows = [(k, " ".join(f"w{j}" for j in range(k % 37)), "en", f"s{k % 2}", 1) for k in range(3000)] + [(7, "one two three four five", "en", "s0", 1)] * 700 + [(None, "one two three four five six", "en", "s1", 1)] * 600
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rel = c.execute(ORACLE_SQL["op3_mixing"])
    names = [d[0] for d in rel.description]
    want = sorted(repr(tuple(r[names.index(n)] for n in sorted(names))) for r in rel.fetchall())
    for most in (1 << 18, 20):
        monkeypatch.setattr(common, "BUCKET_ROWS", most)
        assert sorted(repr(tuple(r[n] for n in sorted(names))) for r in QUERIES["op3_mixing"](spark, str(tmp_path)).collect()) == want


def test_sharding_equals_brute_force(spark):
    import hashlib
    import math

    weights = [1.0, 2.5, 0.5, 1.0]
    keys = [None, *range(300)]
    df = spark.createDataFrame([(k, "t") for k in keys], "doc_id long, text string")
    cost = lambda key, n, w: -math.log((int(hashlib.md5(f"{n}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w
    want = {}
    for k in keys:
        key = "~" if k is None else str(k)
        costs = [cost(key, n, w) for n, w in enumerate(weights)]
        best = costs.index(min(costs))
        want[k] = (best, 4 if cost(key, 4, 2.0) < costs[best] else best)
    got = {r["doc_id"]: (r[f"{OWN}shard"], r[f"{OWN}grown"]) for r in sharding.assign(df, weights=weights, new_weight=2.0).collect()}
    assert got == want and {g for _, g in want.values()} == {0, 1, 2, 3, 4}
