"""Project documents that are hostile or large."""

import tracemalloc
from xml.etree import ElementTree

import pytest

from earmark.operators import project as P

FULL = (
    '<Ableton Creator="Ableton Live 11.0"><LiveSet><Skip deep="1"><MidiTrack Name="m"><Other><MidiClip Time="1" Duration="2">{notes}</MidiClip></Other></MidiTrack></Skip>'
    '<Track Name="t"><DeviceChain Name="d"><x><Parameter Name="p" Value="0.5"/></x><Device Name="e"/></DeviceChain></Track><SampleRef>a/b.wav<u/>tail</SampleRef></LiveSet></Ableton>'
)


def extract(spark, *documents, dialect="ableton"):
    df = spark.createDataFrame([(f"/p/{i}.xml", x) for i, x in enumerate(documents)], "path string, xml string")
    return P.project_xml_extract(df, dialect).orderBy("path").collect()


def test_numbers_that_do_not_fit(spark):
    note = lambda n: f'<Note Note="{n}" Velocity="90" Time="1" Duration="1"/>'
    rows = extract(spark, *[FULL.format(notes=note(60) + note(n)) for n in ("99999999999", "-99999999999", "9" * 5000, "2147483647", "x", "1_0")])
    assert [[n.note for n in r.midi_tracks[0].notes] for r in rows] == [[60], [60], [60], [60, 2147483647], [60], [60]]
    assert [r.error for r in rows] == ["a number is too large"] * 3 + [None] * 3
    logic = f'<Logic><MIDIRegion name="r"><Note pitch="{1 << 40}"/><Note pitch="7"/></MIDIRegion></Logic>'
    assert extract(spark, logic, dialect="logic")[0].error == "a number is too large"


def test_nothing_ends_the_job(spark):
    rows = extract(spark, None, "", "<a", "<a></b>", "text", "<a>&#0;</a>", "<Ableton/>", "\x00", "<a b='1' b='2'/>", FULL.format(notes=""))
    assert [r.error is None for r in rows] == [False] * 6 + [True, False, False, True]


def tree(xml):
    root = ElementTree.fromstring(xml)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    return root


def test_kept_elements_give_the_parts_of_the_whole_tree():
    notes = "".join(f'<Note Note="{i}" Time="{i}"/><Junk><Note Note="{i}"/></Junk>' for i in range(5))
    for read, xml in ((P._ableton, FULL.format(notes=notes)), (P._ableton, f'<a xmlns="urn:x">{FULL.format(notes=notes)}</a>'), (P._logic, "<Logic><DocumentInfo>9.1<b/></DocumentInfo><Sequence><q><Track name='t'><Region start='1' length='2'/></Track></q></Sequence><TempoList><TempoEvent bpm='3'/></TempoList><Automation name='v'><Point time='1' value='2'/></Automation></Logic>")):
        assert read(P.parse(xml)) == read(tree(xml))


@pytest.mark.parametrize("size", [2_000, 200_000])
def test_memory_goes_with_what_is_kept(size):
    xml = FULL.format(notes='<Junk a="1">text</Junk>' * size)
    tracemalloc.start()
    root = P.parse(xml)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(1 for _ in root.iter()) == 8 and peak < 1 << 20
