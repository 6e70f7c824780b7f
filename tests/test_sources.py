"""Delimited-file readers (S1-S5, S9) on the tiny fixtures of FIXTURES.md §3."""

import os

import pytest
from pyspark.sql import functions as F

from trackml.operators import prepare
from trackml.sources import files

FEATURES_CSV = """MSD_TRACKID,a,b,c
TRAA,1.0,2,0
TRAB,2.5,3,1
TRAC,3.5
TRAD,4.5,1,1,9
TRAE,,7,0
TRAF,NaN,7,0
TRAG,xx,7,0
"""
LABELS_TSV = "TRAA\tRock\nTRAB\tPop\nTRAE\tJazz\nTRAF\tRock\nTRAA\tJazz\n"
SPLITS_TSV = "%comment line\nTRAA\tTRAIN\nTRAB\tTEST\nTRAE\tTRAIN\nTRAF\tTEST\n"
YEAR_CSV = "artist,MSD_TRACKID,year,song\nX,TRAA,1999,s1\nY,TRAB,2003,s2\nZ,TRAC,bad,s3\n"


def _write(d, name, text):
    path = os.path.join(d, name)
    with open(path, "w") as fh:
        fh.write(text)
    return path


@pytest.fixture()
def inputs(spark, tmp_dir):
    return files.read_track_inputs(spark, _write(tmp_dir, "f.csv", FEATURES_CSV),
                                   _write(tmp_dir, "l.cls", LABELS_TSV),
                                   _write(tmp_dir, "s.cls", SPLITS_TSV))


def test_features_drop_malformed(inputs):
    f = inputs["features"]
    assert f.columns == ["track_id", "a", "b", "c"]
    assert sorted(r.track_id for r in f.collect()) == ["TRAA", "TRAB", "TRAE", "TRAF"]
    # counts agree however the frame is pruned (trap T2)
    assert f.count() == 4
    assert f.select("track_id").count() == 4
    assert dict(f.dtypes)["a"] == "double"


def test_raw_scan_counts_all_lines(spark, tmp_dir):
    path = _write(tmp_dir, "f.csv", FEATURES_CSV)
    assert spark.read.option("header", True).csv(path).count() == 7


def test_assembler_invalid_handling(inputs):
    f = inputs["features"]
    with pytest.raises(Exception):
        prepare.assemble(f, ["a", "b", "c"], handle_invalid="error").collect()
    kept = prepare.assemble(f, ["a", "b", "c"], handle_invalid="skip")
    assert sorted(r.track_id for r in kept.collect()) == ["TRAA", "TRAB"]
    assert prepare.assemble(f, ["a", "b", "c"], handle_invalid="keep").count() == 4


def test_labels_and_splits(inputs):
    labels, splits = inputs["labels"], inputs["splits"]
    assert labels.columns == ["track_id", "label"]
    assert labels.count() == 5
    assert splits.columns == ["track_id", "subset"]
    assert sorted(r.track_id for r in splits.collect()) == ["TRAA", "TRAB", "TRAE", "TRAF"]


def test_join_multiplies_duplicate_keys(inputs):
    j = prepare.join_tracks(inputs["splits"], inputs["labels"], inputs["features"])
    assert j.columns == ["track_id", "subset", "label", "a", "b", "c"]
    assert j.where(F.col("track_id") == "TRAA").count() == 2
    assert j.count() == 5


def test_year_labels(spark, tmp_dir):
    y = files.read_year_labels_csv(spark, _write(tmp_dir, "y.csv", YEAR_CSV))
    assert y.columns == ["track_id", "year"]
    assert sorted((r.track_id, r.year) for r in y.collect()) == [("TRAA", 1999), ("TRAB", 2003)]


def test_connector_alias(spark, tmp_dir):
    path = _write(tmp_dir, "l.cls", LABELS_TSV)
    df = spark.read.format("com.databricks.spark.csv").option("sep", "\t").load(path)
    assert df.count() == 5


def test_packed_vectorize_matches_assembler_rules(inputs):
    from trackml.plans import jobs

    f = inputs["features"]
    packed, names = prepare.pack_features(f)
    assert names == ["a", "b", "c"]
    with pytest.raises(Exception):
        prepare.vectorize(packed, names, handle_invalid="error").collect()
    kept = prepare.vectorize(packed, names, handle_invalid="skip")
    assert sorted(r.track_id for r in kept.collect()) == ["TRAA", "TRAB"]
    keep = {r.track_id: r.features for r in
            prepare.vectorize(packed, names, handle_invalid="keep").collect()}
    assert len(keep) == 4 and keep["TRAE"][0] != keep["TRAE"][0]  # NaN
    # same vectors as VectorAssembler on the rows both keep
    va = {r.track_id: r.features for r in
          prepare.assemble(f, ["a", "b", "c"], handle_invalid="skip").collect()}
    assert {k: v.toArray().tolist() for k, v in va.items()} == \
        {r.track_id: r.features.toArray().tolist() for r in kept.collect()}
    # an invalid row that the join removes does not fail the job
    only_valid = inputs["splits"].where("track_id IN ('TRAA', 'TRAB')")
    staged, _ = jobs.prepare_genre({"splits": only_valid, "labels": inputs["labels"],
                                    "features": f})
    assert staged.count() == 3   # TRAA twice (two labels), TRAB once


def test_part_files_with_another_column_order_fail(spark, tmp_dir):
    import os

    from trackml.sources import files

    os.makedirs(f"{tmp_dir}/parts")
    for name, header in (("a.csv", "x,y"), ("b.csv", "y,x")):
        with open(f"{tmp_dir}/parts/{name}", "w") as fh:
            fh.write(f"{files.SOURCE_KEY},{header}\n1,1.0,2.0\n")
    with pytest.raises(Exception):
        files.read_features_csv(spark, f"{tmp_dir}/parts").collect()


def test_quarantine_keeps_raw_lines_and_reasons(spark, tmp_dir):
    lines = ['MSD_TRACKID,year,artist,song', '1,1999,"a, b",s', '2,1999', '3,1999,a,s,more',
             '4,n/a,a,"s, t"', '5,2001,"x ""y"" z",s', '6,,a,s', '7,1999,"a, b, c"',
             '8,2002,"open,s']
    with open(f"{tmp_dir}/years.csv", "w") as fh:
        fh.write("\n".join(lines) + "\n")
    parsed = files.parse_year_labels_csv(spark, f"{tmp_dir}/years.csv")
    assert {(r.track_id, r.year) for r in parsed.rows.collect()} == {
        ("1", 1999), ("5", 2001), ("6", None)}
    assert {(r.line, r.reason) for r in parsed.quarantine.collect()} == {
        (lines[2], "short"), (lines[3], "long"), (lines[4], "value"), (lines[7], "short"),
        (lines[8], "value")}
    # one parse: both read the same staged files
    assert parsed.rows.inputFiles() == parsed.quarantine.inputFiles()
    # rows read alone are the same
    assert files.read_year_labels_csv(spark, f"{tmp_dir}/years.csv").count() == 3


def test_quarantine_without_malformed_lines(spark, tmp_dir):
    with open(f"{tmp_dir}/l.tsv", "w") as fh:
        fh.write("1\tjazz\n2\trock\n")
    parsed = files.parse_labels_tsv(spark, f"{tmp_dir}/l.tsv")
    assert parsed.rows.count() == 2 and parsed.quarantine.count() == 0


def test_quarantine_of_an_empty_file(spark, tmp_dir):
    open(f"{tmp_dir}/e.tsv", "w").close()
    parsed = files.parse_splits_tsv(spark, f"{tmp_dir}/e.tsv")
    assert parsed.rows.count() == 0 and parsed.quarantine.count() == 0
