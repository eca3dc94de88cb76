from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from aerotrace.llm import licences
from aerotrace.llm.files import opened, read_bytes, written
from aerotrace.llm.snapshot_warc import (
    normalise_archives,
    read_archives,
    read_member,
    record,
    records,
    write_archives,
)
from aerotrace.session import scratch_dir

SNAPSHOTS = "snapshot_id long, blob_uri string, payload string, sha1 string, first string, archive string"


def pages():
    rows = [(i, f"http://x/{i}?q=é b", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "http://y\r\nX: 1", "line\r\n\r\nWARC/1.1\r\n\r\n"), (103, "u", "é\x00" * 500_000)]
    rows += [(59, "http://again", rows[59][2]), (None, "none", "<p>1</p>")]
    return [(*r, "c", "c", "c") for r in rows]


def through(spark, rows, **more):
    folder = scratch_dir(spark, "warc")
    data = spark.createDataFrame(rows, SNAPSHOTS).repartition(3)
    whole = write_archives(spark, data, folder, **more)
    members = normalise_archives(spark, whole, folder)
    return whole, members, read_archives(spark, members, data.schema["snapshot_id"].dataType).collect()


@pytest.mark.parametrize("least", [0, 6, 10**9])
def test_round_trip(spark, least):
    rows = pages()
    _, _, got = through(spark, rows, revisit_bytes=least)
    payload = [(k, (t or "").encode()) for k, _, t, *_ in rows]
    best = {}
    for k, b in payload:
        if k is not None:
            best[b] = max(k, best.get(b, k))
    want = []
    for k, b in payload:
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        again = len(b) >= least and k is not None and k != best[b]
        want.append((k, len(b), digest, "revisit" if again else "response", best[b] if again else None))
    cut = [(r["snapshot_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(cut, key=str) == sorted(want, key=str)
    texts = {(k, u): t for k, u, t, *_ in rows}
    for r in got:
        if r["record_type"] == "response":
            assert bytes(r["payload"]).decode() == (texts[(r["snapshot_id"], r["blob_uri"])] or "")


def test_members_stand_alone_and_the_whole_is_one_stream(spark):
    whole, members, _ = through(spark, pages())
    for row in whole.collect():
        raw = read_bytes(row["archive"])
        unzip = zlib.decompressobj(31)
        unzip.decompress(raw)
        assert unzip.eof and not unzip.unused_data
    for row in members.collect():
        index = [json.loads(x) for x in read_bytes(f"{row['archive']}.idx").splitlines()]
        raw = read_bytes(row["archive"])
        assert sum(x["length"] for x in index) == len(raw)
        everything = list(records(iter([gzip.decompress(raw)])))
        store, path = opened(row["archive"])
        for x, (_, block) in zip(index, everything, strict=True):
            fields, body = read_member(store, path, x["offset"], x["length"])
            assert body == block and fields["warc-record-id"] == x["id"]


def test_broken_archives_are_errors(spark):
    folder = scratch_dir(spark, "warc")
    with written(f"{folder}/cut.warc.gz") as out:
        out.write(gzip.compress(record("1", "u", b"payload", "D", None)[:-9]))
    cut = spark.createDataFrame([(f"{folder}/cut.warc.gz",)], "archive string")
    with pytest.raises(Exception, match="cut off"):
        normalise_archives(spark, cut, folder).count()


def test_no_pages(spark):
    assert through(spark, [])[2] == []


def test_licences_are_found_and_confirmed(spark):
    filler = "the quick aircraft climbs over quiet fields at noon while engines hum and crews talk about weather ahead"
    known = {
        1: ("Released under the MIT License.", "MIT"),
        2: ("Licensed under the Apache License, Version 2.0.", "Apache"),
        3: ("This work is licensed under the GNU General Public License, version 3.", "GPL"),
        4: ("LICENSED UNDER CC BY-NC 4.0.", "CC-BY-NC"),
    }
    rows = [(k, f"{filler}\n{filler} {k}\n{line}") for k, (line, _) in known.items()]
    rows += [(5, f"{filler} " * 5 + known[1][0] + f" {filler}" * 5)]  # inside a long line
    rows += [(6, None), (7, ""), (8, "\n\n  \n"), (9, filler), (10, "a licensed pilot under version control"), (1, rows[0][1])]
    rows += [(20 + i, f"{filler} {i}\nreport {i} of {filler[i : i + 40]}") for i in range(60)]
    data = spark.createDataFrame([(k, t, "c", "c", "c") for k, t in rows], "doc_id long, text string, row string, words string, p string")
    got = licences.scan_licences(spark, data).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: r for r in got}
    for k, (_, family) in known.items():
        assert found[k]["family"] == family and found[k]["families"] == [family] and found[k]["n_licensed"] == 1
        assert found[k]["similarity"] == 1.0 and found[k]["n_paragraphs"] == 3
    assert found[5]["family"] == "MIT"
    assert all(r["family"] is None and not r["families"] for r in got if r["doc_id"] > 5)
    assert found[6]["n_paragraphs"] == found[7]["n_paragraphs"] == found[8]["n_paragraphs"] == 0
    assert not found[9]["unknown_licence"]


def test_licences_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licences.scan_licences(spark, empty).count() == 0


def test_licences_across_lines_and_by_identifier(spark):
    filler = "the quick aircraft climbs over quiet fields at noon while engines hum and crews talk about weather ahead"
    gpl = (
        "This program is free software: you can redistribute it and/or modify\n"
        "it under the terms of the GNU General Public License as published by\r\n"
        "the Free Software Foundation, either version 3 of the License, or\n"
        "(at your option) any later version."
    )
    known = {
        1: ("All rights reserved.", "Proprietary"),
        2: (gpl, "GPL"),
        3: ("SPDX-License-Identifier: MIT", "MIT"),
        4: ("SPDX-License-Identifier: Apache-2.0", "Apache"),
        5: ("SPDX-License-Identifier: CC-BY-NC-4.0", "CC-BY-NC"),
        6: ("Distributed under the Boost Software License,\nVersion 1.0.", "Boost"),
    }
    rows = [(k, f"{filler}\n{filler} {k}\n{line}\n{filler}") for k, (line, _) in known.items()]
    rows += [(10, f"{filler}\nSPDX-License-Identifier: Acme-7\n"), (11, "all rights and duties of the crew"), (12, filler)]
    rows += [(20 + i, f"{filler} {i}\nreport {i} of {filler[i : i + 40]}") for i in range(60)]
    found = {r["doc_id"]: r for r in licences.scan_licences(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (_, family) in known.items():
        assert (k, found[k]["families"], found[k]["n_licensed"]) == (k, [family], 1)
    assert all(r["family"] is None for k, r in found.items() if k > 6)
    assert found[2]["n_paragraphs"] == 7


def test_licence_training_sees_every_text(spark, monkeypatch):
    rows = [(i, f"report {i} of the quiet crew\n" + " ".join(f"w{(i * 7 + j) % 400}" for j in range(100))) for i in range(1_800)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.col("doc_id"))
    tables, keep = {}, licences.stored

    def recorded(spark, df, label):
        tables[label] = keep(spark, df, label)
        return tables[label]

    monkeypatch.setattr(licences, "stored", recorded)
    monkeypatch.setattr(licences, "LogisticRegression", lambda **kw: LogisticRegression(**{**kw, "maxIter": 1}))
    licences.train(spark, texts)
    held = texts.where("pmod(xxhash64(text), 5) = 0").count()
    assert 0 < held < len(rows)
    assert tables["negatives"].count() == (len(rows) - held) * 4  # a line, and 100 words in three windows
    # every window of the held-back texts counts in the limits
    assert tables["probabilities"].agg(F.sum("n_all")).first()[0] == sum(
        r["n_paragraphs"] + r["n_across"]
        for r in licences.paragraphs(texts.where("pmod(xxhash64(text), 5) = 0")).where("n_paragraphs IS NOT NULL").collect()
    )


def test_licence_fit_costs_the_same_whatever_the_number_of_families(spark, monkeypatch):
    rows = [(i, f"report {i} of the quiet crew\n" + " ".join(f"w{(i * 7 + j) % 400}" for j in range(100))) for i in range(200)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.col("doc_id"))
    fits = []

    class Recorded(LogisticRegression):
        def fit(self, data):
            model = super().fit(data)
            fits.append((self.getFamily(), data.count(), model))
            return model

    monkeypatch.setattr(licences, "LogisticRegression", lambda **kw: Recorded(**{**kw, "maxIter": 3}))
    model = licences.train(spark, texts)
    learned = texts.where("pmod(xxhash64(text), 5) > 0").count() * 4  # a line, and 100 words in three windows
    (one, n, speaking), (many, stated, naming) = sorted(fits, key=lambda x: x[0])
    # every window of the texts is in the fit with one row of weights, none in that with a row a family
    assert (one, many, n) == ("binomial", "multinomial", stated + learned)
    assert speaking.coefficientMatrix.numRows == 1 and naming.numClasses == len(model.families) - 1
    words = spark.createDataFrame([(["released", "under", "the", "mit", "license"],), (["the", "quiet", "crew"],)], "words array<string>")
    p = [r["p"] for r in model.probabilities(words).collect()]
    assert all(len(x) == len(model.families) and abs(sum(x) - 1) < 1e-9 for x in p)
    assert p[0][0] < p[1][0]


def test_quotes_are_those_of_all_pairs(spark):
    known = licences.templates(spark)
    pairs = [set(r["pairs"]) for r in known.collect()]
    parts = sorted({tuple(p.split(" ")) for mine in pairs for p in mine})
    rows = [["quiet", *p, "crew"] for p in parts] + [[*a, *b] for a, b in zip(parts, parts[7:], strict=False)]
    rows += [[], ["crew"], ["within", "thebes"], ["the", "quiet", "crew", "of", "the"]]
    data = spark.createDataFrame([(w,) for w in rows], "words array<string>")
    got = {tuple(r["words"]): r["q"] for r in data.select("words", licences._quotes(F.col("words"), known).alias("q")).collect()}
    for w in rows:
        mine = {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
        assert got[tuple(w)] == any(len(mine & t) >= len(t) / 4 for t in pairs), w
