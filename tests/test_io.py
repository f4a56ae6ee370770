"""Readers and writers on small files."""

import json

import pytest

from clonoscope.sources import readers as R
from clonoscope.sources import writers as Wr
from clonoscope.streaming import streams as S


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path.parent)


def table(rows, sep="\t"):
    return "\n".join(sep.join(map(str, r)) for r in rows) + "\n"


def test_airr_repertoires(spark, tmp_path):
    head = ["sequence_id", "productive", "v_call", "j_call", "junction_aa", "duplicate_count"]
    put(tmp_path / "in" / "r1.tsv", table([head, ["1", "T", "IGHV1*01", "IGHJ2", "CASGVAGTFDYW", 1247], ["2", "F", "IGHV1", "IGHJ2", "CAAW", 4], ["3", "TRUE", "IGHV1", "na", "CA*W", -1]]))
    put(tmp_path / "in" / "r2.tsv", table([head, ["4", "T", "IGHV1", "IGHJ2", "CASGW", ""]]))
    (tmp_path / "meta.csv").write_text("filename,subject_id,cmv\nr1.tsv,s1,yes\nr2.tsv,s2,no\n")
    data = R.read_format(spark, "AIRR", str(tmp_path / "in"), kind="repertoire", metadata_file=str(tmp_path / "meta.csv"))
    rows = {r["sequence_id"]: r for r in data.sequences.collect()}
    assert set(rows) == {"1", "4"} and data.labels == ["cmv"]
    assert rows["1"]["cdr3_aa"] == "ASGVAGTFDY" and rows["1"]["duplicate_count"] == 1247 and rows["1"]["locus"] == "IGH" and rows["1"]["repertoire_id"] == "r1"
    assert rows["4"]["duplicate_count"] is None
    Wr.write_airr(data, str(tmp_path / "out"))
    back = spark.read.options(sep="\t", header="true").csv(str(tmp_path / "out" / "sequences"))
    assert {(r["sequence_id"], r["duplicate_count"]) for r in back.collect()} == {("1", "1247"), ("4", "-1")}
    Wr.write_dataset(data, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq" / "sequences")).count() == 2


def test_tenx_receptors(spark, tmp_path):
    head = "barcode,chain,v_gene,j_gene,productive,cdr3,cdr3_nt,reads,umis".split(",")
    rows = [["c1", "TRA", "TRAV1", "TRAJ1", "True", "CAAF", "TGTGCTGCTTTT", 9, 12], ["c1", "TRB", "TRBV1", "TRBJ1", "True", "CASF", "TGTGCTTCTTTT", 9, 13], ["c1", "TRB", "TRBV2", "TRBJ1", "True", "CAGF", "TGTGCTGGTTTT", 9, 1], ["c2", "TRA", "TRAV1", "TRAJ1", "True", "CAAF", "TGTGCTGCTTTT", 9, 2]]
    path = put(tmp_path / "x" / "a.csv", table([head, *rows], ","))
    got = R.read_format(spark, "TenxGenomics", path, kind="receptor", receptor_chains="TRA_TRB").sequences.orderBy("locus").collect()
    assert [(r["cell_id"], r["locus"], r["umi_count"], r["cdr3_aa"]) for r in got] == [("c1", "TRA", 12, "AA"), ("c1", "TRB", 13, "AS")]


def test_vdjdb(spark, tmp_path):
    head = ["complex.id", "Gene", "CDR3", "V", "J", "Epitope", "Meta"]
    meta = json.dumps({"subject.id": "s1", "frequency": "1/2"}).replace('"', '""')
    rows = [[c, g, "CASF", "TRBV1", "TRBJ1", "KLG", f'"{meta}"'] for c, g in ((3050, "TRA"), (3050, "TRB"), (15760, "TRB"), (15760, "TRA"), (15760, "TRA"))]
    path = put(tmp_path / "v" / "a.tsv", table([head, *rows]))
    data = R.read(spark, R.replace(R.FORMATS["VDJdb"], path=path))
    assert sorted(r["sequence_id"] for r in data.sequences.collect()) == ["15760_TRA_1", "15760_TRA_2", "15760_TRB", "3050_TRA", "3050_TRB"]


def test_other_formats(spark, tmp_path):
    path = put(tmp_path / "m" / "a.tsv", table([["cloneCount", "allVHitsWithScore", "allJHitsWithScore", "aaSeqCDR3", "nSeqCDR3"], [3, "TRBV1*00(5),TRBV2*00(3)", "TRBJ1*00(1)", "CASSF", "TGTGCTTCTTCTTTT"]]))
    r = R.read_format(spark, "MiXCR", path).sequences.first()
    assert (r["v_call"], r["j_call"], r["duplicate_count"], r["cdr3_aa"], r["cdr3"]) == ("TRBV1", "TRBJ1", 3, "ASS", "GCTTCTTCT")
    path = put(tmp_path / "o" / "a.tsv", table([["TGTGCTTCTTTT", "CASF", "TRBV1", "TRBJ1"]]))
    r = R.read_format(spark, "OLGA", path).sequences.first()
    assert (r["junction_aa"], r["cdr3"], r["locus"]) == ("CASF", "GCTTCT", "TRB")
    path = put(tmp_path / "g" / "a.csv", table([["nt_CDR3", "anchors_found", "is_inframe"], ["TGTGCTTCTTTT", 1, 1], ["TGTGCTTCTTTT", 0, 1], ["TGTGCTTCTTTT", 1, 0]], ","))
    got = R.read_format(spark, "IGoR", path).sequences.collect()
    assert len(got) == 1 and got[0]["cdr3_aa"] == "AS"
    read = "A" * 40 + "TGTGCTTCTTTT" + "C" * 35
    path = put(tmp_path / "i" / "a.tsv", table([["rearrangement", "amino_acid", "frame_type", "v_resolved", "j_resolved", "templates"], [read, "CASF", "In", "TCRBV03-01*01", "TCRBJ02-07", 4]]))
    r = R.read_format(spark, "ImmunoSEQRearrangement", path, remove_illegal=False).sequences.first()
    assert (r["v_call"], r["j_call"], r["duplicate_count"], r["vj_in_frame"], r["locus"]) == ("TRBV3-1*01", "TRBJ2-7", 4, "T", "TRB")


def test_patterns_and_motifs(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("id\tTRAV\tTRA_regex\tTRBV\tTRB_regex\n1\tTRAV1\tAC\t\tD.E\n2\t\t\tTRBV2\tF\n")
    got = {(r["pattern_id"], r["v_call"]) for r in R.read_patterns(spark, str(tmp_path / "p.tsv"), ["TRA", "TRB"]).collect()}
    assert got == {("1_TRA", "TRAV1"), ("1_TRB", None), ("2_TRB", "TRBV2")}
    (tmp_path / "m.tsv").write_text("indices\tamino_acids\n0&2\tA&C\n")
    r = R.read_motifs(spark, str(tmp_path / "m.tsv")).first()
    assert (r["motif"], r["positions"], r["letters"]) == ("0&2-A&C", [0, 2], ["A", "C"])


def test_ireceptor(spark, tmp_path):
    info = {"Repertoire": [{"repertoire_id": "r", "subject": {"subject_id": "s", "diagnosis": [{"disease_diagnosis": {"label": "flu"}}]}, "sample": [{"sample_processing_id": "p"}], "data_processing": [{"data_processing_id": "d"}]}]}
    put(tmp_path / "z" / "info.json", json.dumps(info))
    path = put(tmp_path / "z" / "a.tsv", table([["sequence_id", "junction_aa", "repertoire_id", "sample_processing_id", "data_processing_id"], ["1", "CASF", "r", "p", "d"]]))
    data = R.ireceptor(spark, path, R.Options())
    assert data.metadata.first()["flu"] is True and data.sequences.first()["repertoire_id"] == "r_p_d" == data.metadata.first()["repertoire_id"]


def test_stream(spark, tmp_path):
    head = ["sequence_id", "junction_aa", "v_call"]
    path = put(tmp_path / "s" / "a.tsv", table([head, ["1", "CASF", "TRBV1"]]))
    run = lambda: S.airr_stream(spark, path, head, R.Options(), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(60)
    assert run()
    put(tmp_path / "s" / "b.tsv", table([head, ["2", "CAGF", "TRBV1"]]))
    assert run()
    assert {r["sequence_id"] for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {"1", "2"}
    with pytest.raises(Exception):
        R.read(spark, R.Options(path=str(tmp_path / "nowhere"))).sequences.count()


def test_spec(spark, tmp_path):
    from clonoscope.plans.spec import run

    head = ["sequence_id", "junction_aa", "v_call", "duplicate_count"]
    path = put(tmp_path / "q" / "a.tsv", table([head, ["1", "CASSF", "TRBV1", 5], ["2", "CAGF", "TRBV1", 1]]))
    spec = {
        "datasets": {"d": {"format": "AIRR", "path": path}},
        "preprocessing": {"p": [{"by_count": {"least": 2}}]},
        "encodings": {"e": {"kmer_frequencies": {"key": "sequence_id", "seq": "cdr3_aa", "k": 2}}},
        "instructions": {"i": {"dataset": "d", "preprocessing": "p", "encoding": "e"}},
    }
    assert {(r["feature"], r["value"]) for r in run(spark, spec)["i"].collect()} == {("AS", 0.5), ("SS", 0.5)}
    with pytest.raises(ValueError):
        run(spark, spec | {"other": {}})
