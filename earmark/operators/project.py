"""Music-project metadata: from XML text to nested columns, and from those to flat tables.

One row holds one project document. Each is read by the standard parser as a stream of events in Arrow batches,
without a shuffle: only elements that some part is made of are kept, each below the nearest kept one, so
memory goes with what is extracted and not with the document. Elements are found at any depth, so nested
tracks and devices count as often as they stand.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Send the parser to workers with the task, so they need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Node = ElementTree.Element
Row = dict[str, object]

# ---------------------------------------------------------------- reading elements


def inside(node: Node, *names: str) -> list[Node]:
    """Elements below a node with the first of `names` that occurs there, in document order."""
    for name in names:
        found = [e for e in node.iter(name) if e is not node]
        if found:
            return found
    return []


def text_of(node: Node, *names: str) -> str | None:
    """First of the attributes that is there and not empty."""
    return next((node.attrib[n] for n in names if node.attrib.get(n)), None)


def whole(text: str) -> int:
    """A whole number that fits its column of 32 bits."""
    number = int(text)
    if not -(1 << 31) <= number < 1 << 31:
        raise ValueError("out of range")
    return number


def number_of(node: Node, kind: Callable, default: float, *names: str) -> float | None:
    """Attribute as a number: the default when missing, None when it is no number or doesn't fit its column."""
    text = text_of(node, *names)
    if text is None:
        return kind(default)
    try:
        return None if "_" in text else kind(text)
    except ValueError:
        return None


def body_of(node: Node) -> str | None:
    return (node.text or "").strip() or None


def complete(rows: Sequence[Row], *required: str) -> list[Row]:
    """Without the rows in which a number could not be read."""
    return [r for r in rows if all(r[k] is not None for k in required)]


# The elements that parts are made of, in both dialects, and those whose text counts.
ELEMENTS = frozenset(
    "ArrangementTrack Track MidiTrack AudioTrack MidiClip ClipSlot Note MidiNote Clip AudioClip Tempo TempoMasterTimeSignature Key KeySignature "
    "DeviceChain Device Parameter Value SampleRef AudioFile FileRef AutomationEnvelope Envelope Point AutomationPoint DocumentInfo Version MIDIRegion "
    "MIDI Region Sequence MainSequence Timeline MIDITrack MIDINote note TempoList TempoTrack TempoEvent Event DefaultTempo KeyChange Plugin AUPlugin "
    "Effect Insert Sample Automation AutomationTrack".split()
)
TEXTS = frozenset("SampleRef AudioFile FileRef DocumentInfo Version".split())
# Text that the parser gets at a time.
PIECE = 1 << 16


class Kept:
    """Target of the parser: the root and the wanted elements, each below the nearest kept one around it."""

    def __init__(self) -> None:
        self.root: Node | None = None
        self.open: list[Node | None] = []
        self.around: list[Node] = []
        self.text: list[str] | None = None
        self.nodes = 0

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        self._end_text()
        name = tag.rpartition("}")[2]
        if self.root is not None and name not in ELEMENTS:
            self.open.append(None)
            return
        node = ElementTree.Element(name, attributes)
        self.nodes += 1
        if self.root is None:
            self.root = node
        else:
            self.around[-1].append(node)
        self.open.append(node)
        self.around.append(node)
        self.text = [] if name in TEXTS else None

    def data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)

    def _end_text(self) -> None:
        """Text of an element is what stands before its first child."""
        if self.text is not None:
            self.around[-1].text = "".join(self.text)
            self.text = None

    def end(self, tag: str) -> None:
        self._end_text()
        if self.open.pop() is not None:
            self.around.pop()

    def close(self) -> Node | None:
        return self.root


def parse(xml: str | None) -> Node | None:
    """Root of a document with the wanted elements and plain tag names, None for text that is no well-formed XML."""
    parser = ElementTree.XMLParser(target=Kept())
    try:
        for at in range(0, len(xml or ""), PIECE):
            parser.feed(xml[at : at + PIECE])
        return parser.close()
    except (ElementTree.ParseError, ValueError):
        return None


# ---------------------------------------------------------------- D1

# Attribute names of notes by dialect.
ABLETON_NOTE = {"note": ("Note",), "velocity": ("Velocity",), "start": ("Time",), "duration": ("Duration",), "channel": ("Channel",)}
LOGIC_NOTE = {
    "note": ("pitch", "note", "key"), "velocity": ("velocity", "vel"), "start": ("startTime", "start", "time"),
    "duration": ("duration", "length", "dur"), "channel": ("channel",),
}


def _notes(nodes: Sequence[Node], names: dict[str, tuple[str, ...]]) -> list[Row]:
    rows = [
        {
            "note": number_of(e, whole, 60, *names["note"]),
            "velocity": number_of(e, whole, 100, *names["velocity"]),
            "start_time": number_of(e, float, 0.0, *names["start"]),
            "duration": number_of(e, float, 1.0, *names["duration"]),
            "channel": number_of(e, whole, 0, *names["channel"]),
        }
        for e in nodes
    ]
    return complete(rows, "note", "velocity", "start_time", "duration", "channel")


def _clip(e: Node, track: str, name: str, starts: Sequence[str], lengths: Sequence[str], names: Sequence[str], kind: str) -> Row:
    start, length = number_of(e, float, 0.0, *starts), number_of(e, float, 0.0, *lengths)
    end = None if start is None or length is None else start + length
    return {"clip_name": text_of(e, *names) or name, "start_time": start, "end_time": end, "track_name": track, "clip_type": kind.lower()}


def _chains(root: Node, tracks, devices, params, track_names, device_names, type_names, param_names, value_names) -> list[Row]:
    """Tracks with devices, devices with their parameters; a device inside another is one of its own too."""
    out = []
    for track in inside(root, *tracks):
        found = [
            {
                "device_name": text_of(e, *device_names) or "Unknown Device",
                "device_type": text_of(e, *type_names) or e.tag,
                "parameters": complete(
                    [{"parameter_name": text_of(p, *param_names) or "Unknown", "value": number_of(p, float, 0.0, *value_names)} for p in inside(e, *params)], "value"
                ),
            }
            for e in inside(track, *devices)
        ]
        if found:
            out.append({"track_name": text_of(track, *track_names) or "Unknown Track", "devices": found})
    return out


def _automation(root: Node, tags, names, points, times, values) -> list[Row]:
    curves = [
        {
            "parameter_name": text_of(e, *names) or "Unknown",
            "track_name": "Unknown",
            "points": complete([{"time": number_of(p, float, 0.0, *times), "value": number_of(p, float, 0.0, *values)} for p in inside(e, *points)], "time", "value"),
        }
        for e in inside(root, *tags)
    ]
    return [c for c in curves if c["points"]]


def _ableton(root: Node) -> Row:
    """Fixed values here and in `_logic`: names of tags and attributes, and what stands in for missing ones."""
    creator = text_of(root, "Creator")
    number = re.search(r"\d+\.\d+", creator or "")
    timeline = inside(root, "ArrangementTrack", "Track")
    named = [(e, text_of(e, "Name") or "Unknown Track") for e in timeline]
    midi = []
    for i, track in enumerate(inside(root, "MidiTrack")):
        clips = inside(track, "MidiClip", "ClipSlot")
        found = next((f for f in ([n for c in clips for n in c.iter(tag)] for tag in ("Note", "MidiNote")) if f), [])
        # Notes of a clip inside another clip count once.
        midi.append({"track_name": text_of(track, "Name") or f"Track {i}", "track_index": i, "notes": _notes(list(dict.fromkeys(found)), ABLETON_NOTE)})
    tempo = [
        {
            "time": number_of(e, float, 0.0, "Time"),
            "tempo": number_of(e, float, 120.0, "Value"),
            "time_signature": f"{text_of(e, 'Numerator')}/{text_of(e, 'Denominator') or '4'}" if text_of(e, "Numerator") else None,
        }
        for e in inside(root, "Tempo", "TempoMasterTimeSignature")
    ]
    return {
        "version": (number[0] if number else creator) if creator and "Ableton Live" in creator else creator or "Unknown",
        "midi_tracks": midi,
        "clips": complete(
            [_clip(c, name, "Unnamed Clip", ("Time",), ("Duration",), ("Name",), c.tag.replace("Clip", "") or "audio") for e, name in named for c in inside(e, "Clip", "AudioClip", "MidiClip")],
            "start_time", "end_time",
        ),
        "arrangement_tracks": [name for _, name in named],
        "tempo_changes": complete(tempo, "time", "tempo"),
        "key_changes": complete([{"time": number_of(e, float, 0.0, "Time"), "key": text_of(e, "Value") or "C major"} for e in inside(root, "Key", "KeySignature")], "time"),
        "plugin_chains": _chains(root, ("Track", "MidiTrack", "AudioTrack"), ("DeviceChain", "Device"), ("Parameter", "Value"), ("Name",), ("Name",), (), ("Name",), ("Value",)),
        "samples": [text_of(e, "Path", "RelativePath") or body_of(e) for e in inside(root, "SampleRef", "AudioFile", "FileRef")],
        "automation": _automation(root, ("AutomationEnvelope", "Envelope"), ("ParameterName",), ("Point", "AutomationPoint"), ("Time",), ("Value",)),
    }


def _logic(root: Node) -> Row:
    info = inside(root, "DocumentInfo", "Version")
    regions = inside(root, "MIDIRegion", "MIDI") or [e for e in inside(root, "Region") if text_of(e, "type") == "MIDI" or "MIDI" in (text_of(e, "class") or "")]
    sequence = inside(root, "Sequence", "MainSequence", "Timeline")
    named = [(e, text_of(e, "name", "trackName") or "Unknown Track") for e in (inside(sequence[0], "Track", "AudioTrack", "MIDITrack") if sequence else [])]
    listed = inside(root, "TempoList", "TempoTrack")
    tempo = [
        {"time": number_of(e, float, 0.0, "time", "position"), "tempo": number_of(e, float, 120.0, "bpm", "tempo", "value"), "time_signature": text_of(e, "timeSignature", "timeSig")}
        for e in (inside(listed[0], "TempoEvent", "Event") if listed else [])
    ] or [{"time": 0.0, "tempo": number_of(e, float, 120.0, "bpm", "value"), "time_signature": None} for e in inside(root, "Tempo", "DefaultTempo")[:1]]
    return {
        "version": text_of(root, "version", "appVersion", "LogicVersion") or (info and (text_of(info[0], "version") or body_of(info[0]))) or "Unknown",
        "midi_tracks": [
            {"track_name": text_of(e, "name", "trackName") or "Unknown Track", "track_index": i, "notes": _notes(inside(e, "Note", "MIDINote", "note"), LOGIC_NOTE)} for i, e in enumerate(regions)
        ],
        "clips": complete(
            [
                _clip(c, name, "Unnamed Region", ("start", "startTime", "position"), ("length", "duration", "regionLength"), ("name", "regionName"), text_of(c, "type", "regionType") or "audio")
                for e, name in named for c in inside(e, "Region")
            ],
            "start_time", "end_time",
        ),
        "arrangement_tracks": [name for _, name in named],
        "tempo_changes": complete(tempo, "time", "tempo"),
        "key_changes": complete([{"time": number_of(e, float, 0.0, "time", "position"), "key": text_of(e, "key", "value") or "C"} for e in inside(root, "KeySignature", "Key", "KeyChange")], "time"),
        "plugin_chains": _chains(
            root, ("Track", "AudioTrack", "MIDITrack"), ("Plugin", "AUPlugin", "Effect", "Insert"), ("Parameter",), ("name", "trackName"),
            ("name", "pluginName", "effectName"), ("type", "pluginType"), ("name", "parameterName"), ("value",),
        ),
        "samples": [text_of(e, "path", "filePath", "name") for e in inside(root, "AudioFile", "FileRef", "Sample")],
        "automation": _automation(root, ("Automation", "AutomationTrack"), ("parameter", "parameterName", "name"), ("Point", "AutomationPoint"), ("time", "position"), ("value",)),
    }


# Attributes that hold whole numbers, by dialect.
WHOLE = {d: [n for part in ("note", "velocity", "channel") for n in names[part]] for d, names in (("ableton", ABLETON_NOTE), ("logic", LOGIC_NOTE))}


def unfit(root: Node, dialect: str) -> bool:
    """Whether a whole number of some note is too large for its column."""
    for e in root.iter():
        for name in WHOLE[dialect] if e.tag in ("Note", "MidiNote", "MIDINote", "note") else ():
            digits = e.attrib.get(name, "").strip().lstrip("+-").lstrip("0")
            if len(digits) > 9 and digits.isdigit() and number_of(e, whole, 0, name) is None:
                return True
    return False


DIALECTS = {"ableton": _ableton, "logic": _logic}

_NOTE = "struct<note:int,velocity:int,start_time:double,duration:double,channel:int>"
PARTS = (
    f"version string, midi_tracks array<struct<track_name:string,track_index:int,notes:array<{_NOTE}>>>, "
    "clips array<struct<clip_name:string,start_time:double,end_time:double,track_name:string,clip_type:string>>, arrangement_tracks array<string>, "
    "tempo_changes array<struct<time:double,tempo:double,time_signature:string>>, key_changes array<struct<time:double,key:string>>, "
    "plugin_chains array<struct<track_name:string,devices:array<struct<device_name:string,device_type:string,parameters:array<struct<parameter_name:string,value:double>>>>>>, "
    "samples array<string>, automation array<struct<parameter_name:string,track_name:string,points:array<struct<time:double,value:double>>>>, error string"
)


def merge_regions(regions: Column) -> Column:
    """Regions with one track name become one track with all their notes; empty tracks are dropped."""
    names = F.array_distinct(F.transform(F.filter(regions, lambda r: F.size(r["notes"]) > 0), lambda r: r["track_name"]))

    def track(name: Column, index: Column) -> Column:
        own = F.filter(regions, lambda r: r["track_name"] == name)
        return F.struct(name.alias("track_name"), index.cast("int").alias("track_index"), F.flatten(F.transform(own, lambda r: r["notes"])).alias("notes"))

    return F.transform(names, track)


def project_xml_extract(documents: DataFrame, dialect: str) -> DataFrame:
    """Nested metadata of `documents(path, xml)`. Text that is no well-formed XML gets an `error` and no parts.

    A note whose number is none, or too large for its column, is left out; the latter gives an `error` beside the parts.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect: {dialect}")
    read, fields = DIALECTS[dialect], T.StructType.fromDDL(PARTS).fields
    names = [f.name for f in fields]
    schema = T.StructType([documents.schema["path"], *fields])
    arrow = to_arrow_schema(schema)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root = parse(xml)
                parts = {"error": "not well-formed XML"} if root is None else {**read(root), "error": "a number is too large" if unfit(root, dialect) else None}
                rows.append({"path": path, **{n: parts.get(n) for n in names}})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    found = documents.select("path", "xml").mapInArrow(extract, schema)
    folder = F.regexp_extract("path", "^(.*/)[^/]*$", 1)
    samples = F.transform(
        F.filter("samples", lambda p: p.isNotNull()),
        lambda p: F.struct(
            F.when(p.startswith("/"), p).otherwise(F.concat(folder, p)).alias("file_path"), F.regexp_extract(p, "([^/]+)/*$", 1).alias("sample_name")
        ),
    )
    tracks = merge_regions(F.col("midi_tracks")) if dialect == "logic" else F.col("midi_tracks")
    parts = {n: F.col(n) for n in names} | {"midi_tracks": tracks, "samples": samples}
    error = parts.pop("error")
    return found.select("path", F.lit(dialect).alias("project_type"), *[c.alias(n) for n, c in parts.items()], error)


# ---------------------------------------------------------------- D2 - D6


def project_counts(projects: DataFrame) -> DataFrame:
    """Sizes of the parts of each project."""
    size = lambda name: F.greatest(F.lit(0), F.coalesce(F.size(name), F.lit(0))).cast("bigint")
    notes = F.aggregate(F.coalesce("midi_tracks", F.array().cast(projects.schema["midi_tracks"].dataType)), F.lit(0), lambda acc, t: acc + F.size(t["notes"]))
    return projects.select(
        "path",
        "project_type",
        "version",
        size("midi_tracks").alias("midi_tracks"),
        notes.cast("bigint").alias("total_notes"),
        size("clips").alias("arrangement_clips"),
        size("tempo_changes").alias("tempo_changes"),
        size("key_changes").alias("key_changes"),
        size("plugin_chains").alias("plugin_chains"),
        size("samples").alias("sample_sources"),
        size("automation").alias("automation_tracks"),
    )


def explode_notes(projects: DataFrame) -> DataFrame:
    """One row for each note; projects and tracks without notes keep one row of NULLs."""
    return (
        projects.select("path", F.explode_outer("midi_tracks").alias("t"))
        .select("path", F.col("t.track_name").alias("track_name"), F.col("t.track_index").alias("track_index"), F.posexplode_outer("t.notes").alias("note_index", "_n"))
        .select("path", "track_name", "track_index", "note_index", "_n.note", "_n.velocity", "_n.start_time", "_n.duration", "_n.channel")
    )


def explode_devices(projects: DataFrame) -> DataFrame:
    """One row for each device parameter; devices without parameters keep one row."""
    return (
        projects.select("path", F.explode("plugin_chains").alias("c"))
        .select("path", F.col("c.track_name").alias("track_name"), F.posexplode("c.devices").alias("device_index", "d"))
        .select("path", "track_name", "device_index", F.col("d.device_name").alias("device_name"), F.col("d.device_type").alias("device_type"), F.explode_outer("d.parameters").alias("p"))
        .select("path", "track_name", "device_index", "device_name", "device_type", "p.parameter_name", "p.value")
    )


def explode_automation(projects: DataFrame) -> DataFrame:
    """One row for each automation point."""
    return (
        projects.select("path", F.posexplode("automation").alias("curve_index", "a"))
        .select("path", "curve_index", F.col("a.parameter_name").alias("parameter_name"), F.posexplode("a.points").alias("point_index", "p"))
        .select("path", "curve_index", "parameter_name", "point_index", "p.time", "p.value")
    )


def arrangement_length(projects: DataFrame) -> DataFrame:
    """End of the last clip, 0 without clips, and the names of the tracks."""
    ends = F.transform("clips", lambda c: c["end_time"])
    return projects.select("path", F.coalesce(F.array_max(ends), F.lit(0.0)).alias("total_length"), F.col("arrangement_tracks").alias("tracks"))


def project_stats(tracks: DataFrame, counts: DataFrame) -> DataFrame:
    """Tracks, tracks with a project, and notes for each MIDI track over the whole catalogue."""
    joined = tracks.select("track_id").join(
        counts.select("track_id", "total_notes", "midi_tracks", F.lit(True).alias("_has")), "track_id", "left"
    )
    per_track = F.when(F.sum("midi_tracks") > 0, F.sum("total_notes") / F.sum("midi_tracks")).otherwise(0.0)
    return joined.agg(
        F.count(F.lit(1)).alias("total_files"), F.count("_has").alias("total_with_project"), per_track.alias("avg_notes_per_track")
    )


def project_type_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy(F.coalesce("project_type", F.lit("unknown")).alias("project_type")).agg(F.count(F.lit(1)).alias("projects"))


# Columns that must be there, known programs and columns that count something.
REQUIRED = ("path", "project_type", "version")
KNOWN_TYPES = ("ableton", "flstudio", "logic")
COUNTS = (
    "midi_tracks", "total_notes", "arrangement_clips", "tempo_changes", "key_changes", "plugin_chains", "sample_sources", "automation_tracks",
)


def schema_check(counts: DataFrame) -> DataFrame:
    """Violations of the metadata schema, one row each: `(path, violation)`."""
    rules = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED]
    rules.append(F.when(~F.col("project_type").isin(*KNOWN_TYPES), F.concat(F.lit("unknown type "), F.col("project_type"))))
    rules += [F.when(F.col(c) < 0, F.lit(f"negative {c}")) for c in COUNTS if c in counts.columns]
    found = F.filter(F.array(*rules), lambda v: v.isNotNull())
    return counts.select("path", F.explode(found).alias("violation"))
