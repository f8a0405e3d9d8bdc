"""Manifests, plans, projects and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from earmark.functions.columns import index_of_segment, sanitize_floats, segment_id, track_of_segment
from earmark.operators import project as D
from earmark.plans import variants as T
from earmark.sources import manifest as M
from earmark.sources import sinks


def test_segment_ids_keep_long_numbers(spark):
    df = spark.createDataFrame([("t", 7), ("t", 123456)], "t string, i bigint").select(segment_id(F.col("t"), F.col("i")).alias("s"))
    rows = df.select("s", track_of_segment(F.col("s")).alias("t"), index_of_segment(F.col("s")).alias("i")).collect()
    assert [(r.s, r.t, r.i) for r in rows] == [("t_seg_0007", "t", 7), ("t_seg_123456", "t", 123456)]


def test_csv_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,title,url,path,genre\nx,A,,/a.wav,pop\n,B,https://h/b.mp3,,pop\ny,C,\"  \",,pop\n")
    rows = M.manifest_scan(spark, str(tmp_path / "m.csv"))
    valid, rejects = M.manifest_validate(rows)
    assert {r.locator for r in valid.collect()} == {"/a.wav", "https://h/b.mp3"}
    assert [(r.id, r.reason) for r in rejects.collect()] == [("y", "blank locator")]
    enriched = {r.locator: r for r in M.manifest_enrich(valid, [F.col("locator")]).collect()}
    assert enriched["https://h/b.mp3"].id == "file_1" and enriched["/a.wav"].source_path == "/a.wav"


def test_empty_manifest_is_an_error(spark):
    with pytest.raises(ValueError):
        M.manifest_validate(spark.createDataFrame([], "id string, url string"))


def test_audio_listing(spark, tmp_path):
    for name in ("my_first_song.wav", "b.mp3", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    rows = {r.id: r for r in M.manifest_from_listing(M.list_audio(spark, str(tmp_path))).collect()}
    assert set(rows) == {"my_first_song", "b"} and rows["my_first_song"].title == "My First Song"


def test_project_file_order(spark):
    tracks = spark.createDataFrame([("t", "/m/x/song.wav"), ("u", "/m/x/other.wav")], "id string, file_path string")
    files = spark.createDataFrame([("/m/song.als",), ("/m/x/song_final.als",), ("/m/x/song.logicx",)], "path string")
    got = {r.id: r.project_path for r in M.link_projects(tracks, files).collect()}
    assert got == {"t": "/m/x/song.logicx", "u": None}


@pytest.mark.parametrize("path, kind", [("p/project1.als", "ableton"), ("project2.FLP", "flstudio"), ("project3.logicx", "logic"), ("not_daw.txt", None)])
def test_project_types(spark, path, kind):
    assert spark.createDataFrame([(path,)], "p string").select(M.detect_project_type(F.col("p"))).first()[0] == kind


def test_hot_checksum(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    rows = M.content_checksum(df, "text", "id").groupBy("copies").count().collect()
    assert {r.copies: r["count"] for r in rows} == {300: 300, 1: 600}


def test_variant_ids_are_unique_and_short(spark):
    matrix = {"x": {"enabled": True, "parameters": [{"k": "v" * 300}, {"k": "v" * 300 + "w"}, {"a": 1, "b": None}]}, "y": {"enabled": False, "parameters": [{}]}}
    rows = T.expand_matrix(spark.createDataFrame([("t1",), ("t2",)], "id string"), matrix).collect()
    ids = [r.transformed_id for r in rows]
    assert len(set(ids)) == 6 and max(map(len, ids)) == 200 and "t1__x__a_1_b_None" in ids
    assert {r.severity for r in rows} == {"moderate"}


def test_matrix_files(spark, tmp_path):
    config = {"transforms": {"gain": {"enabled": True, "parameters": [{"db": -3, "severity": "mild"}]}}}
    (tmp_path / "m.json").write_text(json.dumps(config))
    (tmp_path / "m.yaml").write_text("transforms:\n  gain:\n    enabled: true\n    parameters:\n      - db: -3\n        severity: mild\n")
    read = [T.matrix_entries(T.read_matrix(str(tmp_path / f"m.{e}"))) for e in ("json", "yaml")]
    assert T.matrix_entries(T.read_matrix(str(tmp_path / "m.json"), spark)) == read[0]
    assert read[0] == read[1] and read[0][0]["params"] == {"db": "-3"}


@pytest.mark.parametrize(
    "kind, severity, confidence, want",
    [("song_a_in_song_b", "severe", 0.99, 130), ("low_pass_filter", "moderate", None, 88), ("add_noise", "mild", 0.95, 28), (None, None, None, 20), ("other", "mild", 0.95, 14)],
)
def test_search_depth(spark, kind, severity, confidence, want):
    df = spark.createDataFrame([(kind, severity, confidence)], "k string, s string, c double")
    assert df.select(T.adaptive_topk(F.col("k"), F.col("s"), F.col("c"))).first()[0] == want


def test_floats_become_json(spark):
    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")], {"a": float("-inf")})], "x double, xs array<double>, m map<string,double>")
    assert [tuple(r) for r in sanitize_floats(df).collect()] == [(None, [1.0, None], {"a": None})]


def test_results_of_two_runs_stay_apart(spark, tmp_path):
    df = spark.createDataFrame([("q", float("nan"))], "query_id string, x double")
    for run in ("r1", "r2"):
        sinks.write_results(str(tmp_path), run, summary=df, stored=df)
    assert {r.run_id for r in spark.read.option("header", True).csv(str(tmp_path / "query_summary")).collect()} == {"r1", "r2"}
    assert spark.read.json(str(tmp_path / "query_results")).count() == 2


MINIMAL = '<Ableton Creator="Ableton Live 11.0"><LiveSet/></Ableton>'


def extract(spark, xml, dialect="ableton", path="/p/song.als"):
    return D.project_xml_extract(spark.createDataFrame([(path, xml)], "path string, xml string"), dialect)


def test_minimal_project(spark):
    p = extract(spark, MINIMAL)
    r = p.first()
    assert (r.version, r.midi_tracks, r.clips, r.error) == ("11.0", [], [], None)
    assert D.project_counts(p).first().total_notes == 0 and D.arrangement_length(p).first().total_length == 0.0
    assert D.explode_notes(p).count() == 1 and D.explode_automation(p).count() == 0


@pytest.mark.parametrize("xml", [None, "", "not xml", MINIMAL[:-5]])
def test_broken_project(spark, xml):
    assert extract(spark, xml).first().error == "not well-formed XML"


def test_nested_elements_and_brackets_in_attributes(spark):
    """A device inside a device, a track inside a track, and a closing bracket in a name."""
    xml = (
        "<Ableton Creator='Live'><Track Name='a > b'><DeviceChain Name='outer'><Parameter Name='p' Value='1'/><DeviceChain Name='inner'>"
        "<Parameter Name='q' Value='2'/></DeviceChain><Parameter Name='r' Value='3'/></DeviceChain><Track Name='sub'><AudioClip Name='c'/></Track></Track></Ableton>"
    )
    r = extract(spark, xml).first()
    assert r.arrangement_tracks == ["a > b", "sub"]
    chain = r.plugin_chains[0]
    assert chain.track_name == "a > b" and [d.device_name for d in chain.devices] == ["outer", "inner"]
    assert [[(p.parameter_name, p.value) for p in d.parameters] for d in chain.devices] == [[("p", 1.0), ("q", 2.0), ("r", 3.0)], [("q", 2.0)]]
    assert [(c.clip_name, c.track_name) for c in r.clips] == [("c", "a > b"), ("c", "sub")]


def test_note_defaults_and_bad_notes(spark):
    xml = "<A><MidiTrack><MidiClip><Note/><Note Note='x'/><Note Note='64' Velocity=\"9\" Time='1.5'/></MidiClip></MidiTrack><MidiTrack Name='B'/></A>"
    t = extract(spark, xml).first().midi_tracks
    assert [x.track_name for x in t] == ["Track 0", "B"] and t[1].notes == []
    assert [tuple(n) for n in t[0].notes] == [(60, 100, 0.0, 1.0, 0), (64, 9, 1.5, 1.0, 0)]


def test_comments_are_no_elements(spark):
    assert extract(spark, "<A><!-- <MidiTrack/> --><MidiTrack/></A>").first().midi_tracks[0].track_name == "Track 0"
    assert len(extract(spark, "<A><!-- <MidiTrack/> --><MidiTrack/></A>").first().midi_tracks) == 1


def test_logic_alternatives(spark):
    xml = (
        '<P version="10.7"><Region type="MIDI" name="Keys"><Note pitch="61" len="2"/></Region><Region type="Audio" name="Keys"><Note/></Region>'
        '<Sequence><Track name="T"><Region start="2" length="3"/></Track></Sequence><Tempo bpm="99"/><KeySignature key="G"/></P>'
    )
    r = extract(spark, xml, "logic", "/p/x.logicx").first()
    assert [(t.track_name, [n.note for n in t.notes]) for t in r.midi_tracks] == [("Keys", [61])]
    assert (r.clips[0].end_time, r.tempo_changes[0].tempo, r.key_changes[0].key, r.version) == (5.0, 99.0, "G", "10.7")


def test_schema_violations(spark):
    df = spark.createDataFrame([("p", "reaper", None, -1)], "path string, project_type string, version string, total_notes int")
    assert {r.violation for r in D.schema_check(df).collect()} == {"missing version", "unknown type reaper", "negative total_notes"}
