"""Synthetic raw files, libraries and tables, and the whole workflow on planted peaks."""

import base64
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.functions import arrays
from peakloom.operators import islands, rangejoin, spectra
from peakloom.params import Params, checked, typed
from peakloom.plans import workflows
from peakloom.sources import libraries, projects, raw, sinks


def mzml(scans, bits=64, packed=True, unit="minute", start="2024-01-02T03:04:05Z"):
    def data(values, name, accession):
        body = np.asarray(values, "<f8" if bits == 64 else "<f4").tobytes()
        body = base64.b64encode(zlib.compress(body) if packed else body).decode()
        kind = ("MS:1000523", "64-bit float") if bits == 64 else ("MS:1000521", "32-bit float")
        pack = ("MS:1000574", "zlib compression") if packed else ("MS:1000576", "no compression")
        return f'<binaryDataArray><cvParam accession="{kind[0]}" name="{kind[1]}"/><cvParam accession="{pack[0]}" name="{pack[1]}"/><cvParam accession="{accession}" name="{name}"/><binary>{body}</binary></binaryDataArray>'

    out = [f'<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><cvParam name="Q Exactive"/><run startTimeStamp="{start}"><cvParam name="positive scan"/><spectrumList>']
    for i, (level, rt, precursor, mz, intensity) in enumerate(scans):
        ion = f'<precursorList><precursor><selectedIonList><selectedIon><cvParam accession="MS:1000744" name="selected ion m/z" value="{precursor}"/></selectedIon></selectedIonList></precursor></precursorList>' if precursor else ""
        out.append(f'<spectrum index="{i}"><cvParam accession="MS:1000511" name="ms level" value="{level}"/><scanList><scan><cvParam accession="MS:1000016" name="scan start time" value="{rt if unit == "minute" else rt * 60}" unitName="{unit}"/></scan></scanList>{ion}<binaryDataArrayList>{data(mz, "m/z array", "MS:1000514")}{data(intensity, "intensity array", "MS:1000515")}</binaryDataArrayList></spectrum>')
    return "\n".join([*out, "</spectrumList></run></mzML>"])


def planted(shift=0.0, scale=1.0):
    scans = []
    for i in range(120):
        rt = i * 0.02
        mz, intensity = [], []
        for m, at, height in ((150.1, 0.6, 1e6), (150.1, 1.6, 8e5), (151.10335, 0.6, 9e4), (200.2, 1.0, 5e5), (320.3, 1.8, 6e5)):
            h = scale * height * np.exp(-0.5 * ((rt - at - shift) / 0.06) ** 2)
            if h > 2000:
                mz.append(m)
                intensity.append(h)
        order = np.argsort(mz) if mz else []
        scans.append((1, rt, None, [mz[k] for k in order], [intensity[k] for k in order]))
        if i == 52:
            scans.append((2, rt + 0.001, 200.2, [80.5, 120.25, 199.9], [900.0, 4000.0, 5000.0]))
    return scans


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("raw")
    (top / "a.one.mzML").write_text(mzml(planted()))
    (top / "b.mzML").write_text(mzml(planted(0.01, 0.9), 32, False, "second", "2024-01-02T02:00:00Z"))
    (top / "c.mzML").write_text(mzml(planted(-0.01, 1.1), start="nonsense"))
    (top / "broken.mzML").write_text("<mzML><spectrum>")
    return str(top)


def test_mzml(spark, folder):
    scans, errors = raw.read_scans(spark, folder)
    assert {r.sample_id: r.n for r in scans.groupBy("sample_id").agg(F.count("*").alias("n")).collect()} == {"a.one": 121, "b": 121, "c": 121}
    assert [r.sample_id for r in errors.collect()] == ["broken"]
    two = scans.where("sample_id = 'b' and level = 2").first()
    assert two.precursor_mz == 200.2 and (two.iso_lo, two.iso_hi) == (1.5, 1.5) and two.scan_id == 53 and two.rt == pytest.approx(1.041)
    raw.register(spark)
    assert spark.read.format("mzml").option("path", f"{folder}/b.mzML").load().where("level = 1").count() == 120


def test_mzxml(spark, tmp_path):
    body = base64.b64encode(struct.pack(">4f", 100.0, 5.0, 101.5, 7.0)).decode()
    (tmp_path / "x.mzXML").write_text(f'<mzXML><msRun><scan num="1" msLevel="1" retentionTime="PT90S"><peaks precision="32">{body}</peaks><scan num="2" msLevel="2" retentionTime="PT1M31S"><precursorMz windowWideness="4">100.0</precursorMz><peaks precision="32">{body}</peaks></scan></scan></msRun></mzXML>')
    rows = raw.read_scans(spark, str(tmp_path))[0].orderBy("scan_id").collect()
    assert [r.rt for r in rows] == [1.5, pytest.approx(91 / 60)] and rows[1].iso_lo == 2.0
    assert [(p.mz, p.intensity) for p in rows[0].peaks] == [(100.0, 5.0), (101.5, 7.0)]


def test_probe_and_runs(spark, folder):
    runs = {r.sample_id: r for r in projects.prepare(spark, folder).collect()}
    assert runs["b"].analytical_order == 0 and runs["a.one"].analytical_order == 1
    assert runs["a.one"].ms_type == "orbitrap" and runs["a.one"].ion_mode == "positive" and runs["c"].time is None
    assert {r.batch_id for r in runs.values()} == {0}


def test_workflow(spark, folder, tmp_path):
    out = workflows.untargeted(spark, folder, str(tmp_path / "out"), Params(correct_rt=False))
    aligned = out["aligned"].collect()
    found = sorted((round(r.mz, 2), round(r.rt, 1)) for r in aligned)
    assert found == [(150.1, 0.6), (150.1, 1.6), (151.1, 0.6), (200.2, 1.0), (320.3, 1.8)]
    assert all(r.detection_rate == 1.0 for r in aligned)
    isotope = next(r for r in aligned if round(r.mz, 1) == 151.1)
    assert isotope.is_isotope
    with_ms2 = next(r for r in aligned if round(r.mz, 1) == 200.2)
    assert [round(p.mz, 2) for p in with_ms2.ms2] == [80.5, 120.25]
    assert out["quant"].count() == 15 and [r.sample_id for r in out["errors"].collect()] == ["broken"]
    table = spark.read.csv(str(tmp_path / "out/aligned_feature_table"), sep="\t", header=True)
    assert len(table.columns) == 33 and table.count() == 5


def test_single_file(spark, folder):
    rows = workflows.process_single_file(spark, f"{folder}/a.one.mzML").collect()
    assert len(rows) == 5 and {r.group_id is not None for r in rows} == {True}
    with pytest.raises(ValueError, match="broken"):
        workflows.process_single_file(spark, f"{folder}/broken.mzML")


def test_stream(spark, folder, tmp_path):
    from peakloom.streaming.ingest import watch

    for _ in range(2):  # the second run finds nothing new
        watch(spark, folder, str(tmp_path / "features"), str(tmp_path / "state"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "features")).count() == 15


def test_libraries(spark, tmp_path):
    (tmp_path / "l.msp").write_text("NAME: one\nPRECURSORMZ: 100,5\nPRECURSORTYPE: [M+H]+\nIONMODE: Positive\nRetentionTime: 1.5\nSMILES: C(=O)O\nNum Peaks: 2\n50.1 10\n60.2\t20\n\nNAME: none\nNum Peaks: 0\n\nNAME: two\nPRECURSOR_MZ: 200\nNum Peaks: 1\n70 5\n")
    rows = libraries.load_library(spark, str(tmp_path / "l.msp")).orderBy("precursor_mz").collect()
    assert [r.name for r in rows] == ["one", "two"] and rows[0].precursor_mz == 100.5 and rows[0].retention_time == 1.5 and rows[0].smiles == "C(=O)O"
    assert [(p.mz, p.intensity) for p in rows[0].peaks] == [(50.1, 10.0), (60.2, 20.0)]
    (tmp_path / "l.json").write_text('[{"name":"x","precursor_mz":"10","peaks":[["1","2"],[3,4]]},{"name":"y","precursor_mz":20,"peaks":"5;6|7;8"},{"name":"z"}]')
    rows = libraries.load_library(spark, str(tmp_path / "l.json")).orderBy("precursor_mz").collect()
    assert [[tuple(p) for p in r.peaks] for r in rows] == [[(1, 2), (3, 4)], [(5, 6), (7, 8)]]
    with pytest.raises(ValueError):
        libraries.load_library(spark, "x.pkl")


def test_library_search(spark):
    from peakloom.operators import annotation
    from peakloom.schema import LIBRARY

    peaks = [(50.0, 10.0), (60.0, 20.0)]
    lib = spark.createDataFrame([(1, "a", 100.0, None, "Positive", 5.0, None, None, None, None, peaks, {}), (2, "b", 300.0, None, "positive", None, None, None, None, None, peaks, {})], LIBRARY)
    own = spark.createDataFrame([(7, 0, 100.001, 5.1, peaks), (8, 0, 100.001, 9.0, peaks), (9, 0, 555.0, 1.0, peaks)], "feature_id long, spectrum_id long, precursor_mz double, rt double, peaks array<struct<mz:double,intensity:double>>")
    found = {r.feature_id: (r.lib_id, r.search_mode, round(r.similarity, 6)) for r in annotation.search_library(own, lib, ion_mode="positive").collect()}
    assert found == {7: (1, "identity_search_with_rt", 1.0), 8: (1, "identity_search", 1.0), 9: (1, "fuzzy_search", 1.0)}


def test_sample_table(spark, tmp_path):
    (tmp_path / "s.csv").write_text("sample_name,IS_QC,is_blank,group\nb1,,Yes,x\ns1,,,y\nq1,yes,,\n")
    rows = projects.read_samples(spark, str(tmp_path / "s.csv")).orderBy("align_order").collect()
    assert [(r.sample_id, r.is_qc, r.is_blank) for r in rows] == [("q1", True, False), ("s1", False, False), ("b1", False, True)]


def test_params():
    with pytest.warns(UserWarning):
        p = checked({"centroid_mz_tol": 3.0, "feature_gap_tol": 7.0, "unheard": 1})
    assert p.centroid_mz_tol == 0.005 and p.feature_gap_tol == 7
    assert [typed(x) for x in ("1", "1.5", "Yes", "none", "x")] == [1, 1.5, True, None, "x"]


def test_golden_arrays(spark):
    df = spark.createDataFrame([([(100.0, 10.0), (100.004, 30.0), (100.010, 20.0)],)], "peaks array<struct<mz:double,intensity:double>>")
    out = df.select(arrays.centroid(F.col("peaks"), 0.005).alias("c"), arrays.clean(F.col("peaks"), 0, 1000, 10).alias("k"), arrays.decode_spectrum(arrays.encode_spectrum(F.col("peaks"))).alias("d")).first()
    assert [(round(p.mz, 6), p.intensity) for p in out.c] == [(100.003, 40.0), (100.01, 20.0)]
    assert [p.intensity for p in out.k] == [30.0, 20.0] and [tuple(p) for p in out.d] == [(100.0, 10.0), (100.004, 30.0), (100.01, 20.0)]
    iso = spark.createDataFrame([(200.0, [(200.0, 100.0), (201.0, 160.0), (202.0, 20.0)])], "mz double, peaks array<struct<mz:double,intensity:double>>")
    assert [p.intensity for p in iso.select(arrays.isotope_signals(F.col("mz"), F.col("peaks"), 0.01).alias("x")).first().x] == [100.0, 20.0]


def test_global_islands_match_local(spark):
    df = spark.range(3000).select(F.lit(0).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(100000)) / 1000).alias("v"))
    a = islands.islands(df, ["k"], "v", 0.05).groupBy("island").agg(F.min("v").alias("lo"), F.count("*").alias("n"))
    b = islands.global_islands(df, "v", 0.05).groupBy("island").agg(F.min("v").alias("lo"), F.count("*").alias("n"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    pairs = rangejoin.range_join(df.withColumnRenamed("v", "a"), df.select(F.col("v").alias("b")), "a", "b", 0.05).count()
    values = np.array([r.v for r in df.collect()])
    assert pairs == int((np.abs(values[:, None] - values[None]) < 0.05).sum())


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("f1", 100.00005, 1.0, [(50.0, 3.0)]), ("f2", 200.0, 2.0, None)], "feature_id string, mz double, rt double, ms2 array<struct<mz:double,intensity:double>>")
    text = "\n\n".join(r.value for r in sinks.msp_entries(rows).collect())
    assert "Num Peaks: 1\n50.0000\t3.0000" in text and "Num Peaks: 0" in text
    with pytest.raises(ValueError):
        sinks.msp(rows, str(tmp_path / "x.txt"))
    sinks.msp(rows, str(tmp_path / "x.msp"))
    assert spectra.lookup(rows, 100.0, 0.01).count() == 1


def test_exported_table_reads_back(spark, tmp_path):
    rows = [("1", 100.12345, 1.5, [(50.5, 10.0), (60.25, 20.0)], True), ("2", 200.0, 2.25, None, False)]
    own = spark.createDataFrame(rows, "feature_id string, mz double, rt double, ms2 array<struct<mz:double,intensity:double>>, is_isotope boolean")
    sinks.exported(own, ["feature_ID", "m/z", "RT", "MS2", "is_isotope", "annotation"]).write.csv(str(tmp_path / "t"), sep="\t", header=True)
    back = {r.feature_id: r for r in sinks.read_features_tsv(spark, str(tmp_path / "t")).collect()}
    assert (back["1"].mz, back["1"].rt, back["1"].is_isotope) == (100.1234, 1.5, True) and [tuple(p) for p in back["1"].ms2] == [(50.5, 10.0), (60.25, 20.0)]
    assert back["2"].ms2 is None and back["2"].annotation is None and not back["2"].is_isotope


def test_classifier_predicts_another_study(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = lambda shift: [(f, s, float(rng.lognormal(5, 0.2) * (4 if f < 5 and s % 2 else 1)), shift) for f in range(12) for s in range(30) if (f + s) % 11]
    matrix = spark.createDataFrame(values(0), "feature_id long, sample_id long, intensity double, shift int").drop("shift")
    labels = spark.createDataFrame([(s, float(s % 2)) for s in range(30)], "sample_id long, label double")
    model, columns, rows = workflows.build_classifier(matrix, labels)
    assert columns.count() == 12 and rows.count() == 30
    known = spark.createDataFrame([(f, 100.0 + f, 1.0) for f in range(12)], "known_id long, known_mz double, known_rt double")
    other = spark.createDataFrame([(500 + f, 100.001 + f, 1.1) for f in range(11)], "feature_id long, mz double, rt double")
    again = spark.createDataFrame([(500 + f, s, v) for f, s, v, _ in values(1)] + [(999, 77, 5.0)], "feature_id long, sample_id long, intensity double")
    found = {r.sample_id: r.prediction for r in workflows.predict_samples(model, columns, known, other, again).collect()}
    assert len(found) == 31 and sum(found[s] == s % 2 for s in range(30)) >= 28


def test_grouping_by_chromatograms_of_the_reference_file(spark):
    from peakloom.functions import chem
    from peakloom.operators import detection

    sodium = 100.0 - chem.BY_NAME["[M+H]+"][2] + chem.BY_NAME["[M+Na]+"][2]
    up, down = [1.0, 2.0, 5.0, 2.0, 1.0], [5.0, 2.0, 1.0, 2.0, 5.0]
    peaks = [(s, i, 1.0 + i * 0.01, m, v) for s, other in (("a", up), ("b", down)) for i in range(5) for m, v in ((100.0, up[i]), (sodium, other[i]))]
    peaks = spark.createDataFrame(peaks, "sample_id string, scan_id int, rt double, mz double, intensity double")
    for reference, n_groups in (("a", 1), ("b", 2)):
        rows = spark.createDataFrame([(0, "x", 100.0, 1.02, 9.0, reference), (0, "y", sodium, 1.02, 5.0, reference)], "sample_id int, fid string, mz double, rt double, height double, reference string")
        found = detection.group_ions(detection.pair_correlations(rows, peaks)).collect()
        assert len({r.group_id for r in found}) == n_groups
        assert {r.fid: r.adduct for r in found}["y"] == ("[M+Na]+" if n_groups == 1 else "[M+H]+")


MSP = "NAME: found\nPRECURSORMZ: 200.2\nPRECURSORTYPE: [M+H]+\nIONMODE: Positive\nNum Peaks: 2\n80.5 900\n120.25 4000\n\nNAME: moved\nPRECURSORMZ: 500.0\nIONMODE: Positive\nNum Peaks: 2\n80.5 900\n120.25 4000\n"


def test_single_file_is_annotated(spark, folder, tmp_path):
    (tmp_path / "l.msp").write_text(MSP)
    rows = workflows.process_single_file(spark, f"{folder}/a.one.mzML", Params(ms2_library_path=str(tmp_path / "l.msp"))).collect()
    found = {round(r.mz, 1): (r.annotation, r.search_mode, r.adduct, r.matched_peak_number) for r in rows if r.annotation}
    assert found == {200.2: ("found", "identity_search", "[M+H]+", 2)} and len(rows) == 5


def test_workflow_annotates_and_tests(spark, folder, tmp_path):
    (tmp_path / "l.msp").write_text(MSP)
    (tmp_path / "s.csv").write_text("sample_name,is_qc,is_blank,kind\na.one,,,x\nb,,,x\nc,,,y\n")
    params = Params(correct_rt=False, ms2_library_path=str(tmp_path / "l.msp"), run_statistics=True, by_group_name="kind")
    out = workflows.untargeted(spark, folder, str(tmp_path / "out"), params, str(tmp_path / "s.csv"))
    rows = {round(r.mz, 1): r for r in out["aligned"].collect() if r.annotation}
    assert set(rows) == {200.2} and rows[200.2].search_mode == "identity_search" and rows[200.2].ms2_reference_file in ("a.one", "b", "c")
    assert out["components"].count() == 3 and out["neighbours"].count() == 6 and "univariate" in out


def test_later_spectra_of_a_feature_are_searched(spark, tmp_path):
    """The best spectrum matches nothing, the third does: that becomes the feature's; the open search takes the first."""
    (tmp_path / "l.msp").write_text(MSP)
    s = lambda file, peaks: (1.0, peaks, file, 7, 0.5)
    strange, known = [(51.0, 9.0), (71.0, 9.0)], [(80.5, 900.0), (120.25, 4000.0)]
    kind = "array<struct<tic:double,ms2:array<struct<mz:double,intensity:double>>,ms2_reference_file:string,ms2_scan_id:int,precursor_ion_fraction:double>>"
    rows = [(1, 200.2, 1.0, strange, "a", 7, 0.5, [s("a", strange), s("b", strange), s("c", known)]), (2, 400.0, 1.0, known, "a", 7, 0.5, [s("a", known)]), (3, 400.0, 1.0, None, None, None, None, None)]
    own = spark.createDataFrame(rows, f"feature_id long, mz double, rt double, ms2 array<struct<mz:double,intensity:double>>, ms2_reference_file string, ms2_scan_id int, precursor_ion_fraction double, ms2_spectra {kind}")
    found = {r.feature_id: r for r in workflows.annotate(spark, own, Params(ms2_library_path=str(tmp_path / "l.msp"), fuzzy_search=True)).collect()}
    assert (found[1].annotation, found[1].ms2_reference_file, found[1].search_mode) == ("found", "c", "identity_search") and [p.mz for p in found[1].ms2] == [80.5, 120.25]
    assert found[2].search_mode == "fuzzy_search" and found[3].annotation is None and len(found) == 3
    assert {r.feature_id for r in workflows.annotate(spark, own, Params(ms2_library_path=str(tmp_path / "l.msp"))).collect() if r.annotation} == {1}


def test_batch_resumes_before_it_reads(spark, folder, tmp_path, monkeypatch):
    out, read = str(tmp_path / "features"), []
    original = workflows.raw.read_scans
    monkeypatch.setattr(workflows.raw, "read_scans", lambda s, p, *a: read.append(sorted(x.rsplit("/", 1)[-1] for x in p)) or original(s, p, *a))
    import shutil

    part = tmp_path / "part"
    part.mkdir()
    for name in ("a.one.mzML", "b.mzML"):
        shutil.copy(f"{folder}/{name}", part)
    assert workflows.batch_file_processing(spark, str(part), out).count() == 0
    assert [r.sample_id for r in workflows.batch_file_processing(spark, folder, out).collect()] == ["broken"]
    assert read == [["a.one.mzML", "b.mzML"], ["broken.mzML", "c.mzML"]]
    assert workflows.batch_file_processing(spark, str(part), out).count() == 0 and len(read) == 2
    assert spark.read.parquet(out).groupBy("sample_id").count().count() == 3


def test_classifier_is_built_on_annotated_features_and_assessed(spark):
    rng = np.random.default_rng(1)
    values = [(f, s, float(rng.lognormal(5, 0.2) * (4 if f < 5 and s % 2 else 1))) for f in range(12) for s in range(60)]
    matrix = spark.createDataFrame(values, "feature_id long, sample_id long, intensity double")
    labels = spark.createDataFrame([(s, float(s % 2)) for s in range(60)], "sample_id long, label double")
    features = [(f, f"name {f % 11}", "identity_search" if f != 9 else "fuzzy_search", 0.9 if f != 8 else 0.1, False, f == 7, 1.0) for f in range(12)]
    features = spark.createDataFrame(features, "feature_id long, annotation string, search_mode string, gaussian_similarity double, is_in_source_fragment boolean, is_isotope boolean, detection_rate double")
    _, columns, rows = workflows.build_classifier(matrix, labels, features=features)
    assert sorted(r.known_id for r in columns.collect()) == [0, 1, 2, 3, 4, 5, 6, 10]  # 11 repeats the name of 0
    found = workflows.assess_classifier(rows)
    assert found["folds"].count() == 5 and found["folds"].agg(F.avg("accuracy")).first()[0] > 0.9
    curve = [(r.fpr, r.tpr) for r in found["roc"].orderBy("place").collect()]
    assert curve[0] == (0, 0) and curve[-1] == (1, 1) and curve == sorted(curve)
    assert found["auc"].first().auc > 0.9


def test_roc_against_pairs(spark):
    """The area is the share of pairs in the right order, ties counted half."""
    from pyspark.ml.linalg import Vectors

    from peakloom.operators import learning

    rng = np.random.default_rng(2)
    rows = [(float(y), Vectors.dense([1 - p, p])) for y, p in ((int(rng.random() < 0.4), round(float(rng.random()), 1)) for _ in range(80))]
    roc = learning.roc_curve(spark.createDataFrame(rows, ["label", "probability"]))
    good, bad = [v[1] for y, v in rows if y], [v[1] for y, v in rows if not y]
    assert learning.area_under(roc).first().auc == pytest.approx(np.mean([(g > b) + 0.5 * (abs(g - b) < 1e-9) for g in good for b in bad]))
