from matchloom.llm import licences
from matchloom.llm._common import documents

from ._fixtures import SCHEMA, odd_rows


def test_variants_of_a_licence_match(spark):
    mit = licences._MIT
    rows = [
        (1, mit),
        (2, "Copyright (c) 2020 Someone\n\n" + mit.upper()),
        (3, "© 2011 A. Person\nAll rights reserved.\n" + mit.replace(",", " ,").replace("sublicense", "sub-licence")),
        (4, mit + " and more"),
        (5, "Some words.\nReleased  under the MIT Licence\nreleased under the mit license.\nother\nLicensed under CC BY-NC 4.0."),
        (6, None),
        (7, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(docs, licences.known_licences(spark)).collect()}
    assert [got[k].licence for k in range(1, 8)] == ["MIT", "MIT", "MIT", None, None, None, None]
    assert got[1].text_digest == got[2].text_digest == got[3].text_digest
    assert (got[5].notice_lines, got[5].notices) == (3, "CC-BY-NC-4.0,MIT")


def test_whole_table_and_odd_rows(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = {r.doc_id: r for r in licences.scan_licences(docs, licences.known_licences(spark)).collect()}
    notices = [t for _, t in licences.KNOWN if "\n" not in t and len(t) < 100]
    for r in docs.collect():
        want = sum(line in notices for line in r.text.split("\n"))
        assert got[r.doc_id].notice_lines == want
    odd = spark.createDataFrame(odd_rows(), SCHEMA)
    assert licences.scan_licences(odd, licences.known_licences(spark)).count() == odd.count()
    assert licences.scan_licences(odd.limit(0), licences.known_licences(spark)).count() == 0
    twice = docs.limit(3).union(docs.limit(3))
    assert licences.scan_licences(twice, licences.known_licences(spark)).count() == 6


def test_entire_texts_of_common_licences(spark):
    """Whole texts with other spacing and case, bodies without the appendix, header forms, and a caller's own table."""
    whole = dict(reversed(licences.full_texts()))
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"} <= set(whole)
    texts = [(name, f"Copyright (c) 2021 Some Body\n\n{text.upper()}") for name, text in licences.full_texts()]
    docs = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scan_licences(docs, licences.known_licences(spark)).collect()}
    assert [got[k] for k in range(len(texts))] == [name for name, _ in texts]
    own = spark.createDataFrame([("Own-1.0", "My own terms.")], "licence string, licence_text string")
    assert licences.scan_licences(spark.createDataFrame([(1, "my own TERMS")], "doc_id long, text string"), own).first().licence == "Own-1.0"


def test_neighbours_and_repeated_rows(spark):
    """Variants side by side are all brought to one spelling; equal rows stay as many rows."""
    own = spark.createDataFrame([("X", "license license copyright owner copyright owner centre")], "licence string, licence_text string")
    docs = spark.createDataFrame([(1, "licence licence copyright holder copyright holder center"), (2, "LICENCE license copyright holder, copyright-owner centre\nother")] * 2, "doc_id long, text string")
    rows = sorted(map(tuple, licences.scan_licences(docs, own).drop("text_digest").collect()))
    assert rows == [(1, "X", 1, "X"), (1, "X", 1, "X"), (2, None, 1, "X"), (2, None, 1, "X")]
    none = own.limit(0)
    assert [r.licence for r in licences.scan_licences(docs, none).collect()] == [None] * 4
