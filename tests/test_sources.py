"""Readers and writers on small files."""

import gzip
import json

import pytest

from tessera.sources import files


def test_manifest(spark, tmp_path):
    cases = [{"Case_ID": "A", "CT": [{"path": "a"}], "WSI": [], "RNA_Seq": [{"File Path": " "}, {"File Path": "r2"}], "WXS": [{"path": "w"}]}, {"Case_ID": "B"}]
    (tmp_path / "m.json").write_text(json.dumps(cases, indent=1))
    m = files.case_manifest(spark, str(tmp_path / "m.json"))
    assert {r.Case_ID: r.reasons for r in files.missing_views(m).collect()} == {"A": ["missing_WSI"], "B": [f"missing_{v}" for v in files.VIEWS]}
    assert [(r.case_id, r.path) for r in files.first_paths(m, "RNA_Seq").collect()] == [("A", "r2")]


def expression_file(path, rows):
    lines = ["# a comment", "gene_id\tgene_name\tgene_type\tunstranded\tstranded_first\tstranded_second\ttpm_unstranded\tfpkm_unstranded\tfpkm_uq_unstranded"]
    lines += [f"N_{x}\t\t\t1\t1\t1\t\t\t" for x in "abcd"]
    path.write_text("\n".join([*lines, *("\t".join([f"E{i}", name, kind, count, "0", "0", tpm, "0", "0"]) for i, (name, kind, count, tpm) in enumerate(rows))]) + "\n")


def test_expression(spark, tmp_path):
    expression_file(tmp_path / "a.tsv", [("GENE1 ", "protein_coding", "10", "3.0"), ("GENE1", "protein_coding", "20", "x"), ("MIR1", "miRNA", "5", "9")])
    assert [(r.gene, r.tpm, r["count"]) for r in files.expression(spark, str(tmp_path / "a.tsv")).collect()] == [("GENE1", 3.0, 30)]
    expression_file(tmp_path / "b.tsv", [("GENE1", "protein_coding", "2.5", "3.0")])
    with pytest.raises(Exception, match="integer-valued"):
        files.expression(spark, str(tmp_path / "b.tsv")).collect()


def test_mutations(spark, tmp_path):
    with gzip.open(tmp_path / "a.maf.gz", "wt") as f:
        f.write("#version\nHugo_Symbol\tVariant_Classification\tVariant_Type\tChromosome\tStart_Position\nVHL\tMissense_Mutation\tSNP\tchr3\t100\n")
    rows = files.mutations(spark, str(tmp_path / "*.maf.gz")).collect()
    assert [(r.gene, r.start) for r in rows] == [("VHL", "100")]
    cases = spark.createDataFrame([(rows[0].file, "A"), ("nowhere", "B")], "file string, case_id string")
    assert files.mutations(spark, str(tmp_path / "*.maf.gz"), cases.limit(1)).first().case_id == "A"
    with pytest.raises(FileNotFoundError):
        files.mutations(spark, str(tmp_path / "*.maf.gz"), cases)


def test_states_round_trip(spark, tmp_path):
    rows = [("A", "success", [], ["c"], {"ct": "p"}), ("B", "fail", ["missing_CT"], [], {})]
    df = spark.createDataFrame(rows, "case_id string, qc string, missing_view_reason array<string>, candidate_cluster_ids array<string>, evidence map<string, string>")
    files.write_states(df, str(tmp_path / "s"))
    assert [r.case_id for r in files.patient_states(spark, str(tmp_path / "s")).collect()] == ["A"]
    files.write_states(df.union(df), str(tmp_path / "s"))
    with pytest.raises(ValueError):
        files.patient_states(spark, str(tmp_path / "s"))


def test_pairs_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("ct", 1, 2, 0.5), ("rna", 1, 2, 0.0)], "view string, i long, j long, value double")
    files.write_pairs(df, str(tmp_path / "p"))
    assert files.read_pairs(spark, str(tmp_path / "p"), 2).count() == 2
    with pytest.raises(ValueError):
        files.read_pairs(spark, str(tmp_path / "p"), 4)
    files.write_pairs(df.selectExpr("view", "j AS i", "i AS j", "value"), str(tmp_path / "q"))
    with pytest.raises(Exception, match="not a distance"):
        files.read_pairs(spark, str(tmp_path / "q")).collect()


def test_sample_sheet(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("case\tfile\tkind\nA\tf1, f2, f3\tTumor, Normal\n")
    rows = files.sample_sheet(spark, str(tmp_path / "s.tsv"), ["file", "kind"]).collect()
    assert [(r.case, r.file, r.kind) for r in rows] == [("A", "f1", "Tumor"), ("A", "f2", "Normal"), ("A", "f3", "Tumor")]


def test_trace_and_changes(spark, tmp_path):
    events = spark.createDataFrame([("n", float("nan")), ("m", 1.5)], "node string, value double")
    files.append_trace(events, str(tmp_path / "t"))
    files.append_trace(events, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 4
    old, new = (spark.createDataFrame(r, "k int, s string") for r in ([(1, "a"), (2, "b"), (3, "c")], [(1, "a"), (2, "x"), (4, "d")]))
    assert {r.k: r.state for r in files.changed(old, new, "k", "s").collect()} == {1: "same", 2: "changed", 3: "removed", 4: "new"}
