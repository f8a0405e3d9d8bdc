"""Registered queries for project metadata. Each run of 64 events is one project document."""

from __future__ import annotations

from pyspark.sql import functions as F

from earmark import fixtures as X
from earmark.checks.support import Parts, Query, r6, tidy
from earmark.operators import project as D

P = Parts()
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf))
        if sql:
            ORACLES[name] = P.sql(sql)
        return fn

    return wrap


def documents(spark, sf, dialect: str):
    """Project documents written from all events: a track for each event type, a note for each event.

    Devices stand inside devices and tracks inside tracks, and an attribute holds a closing bracket.
    """
    e = X.table(spark, sf, "events").withColumn("project", F.expr("event_id div 64")).withColumn("at", F.col("event_id") % 64 * 0.5)
    number, velocity = F.get_json_object("props", "$.k"), (F.floor("value") % 128).cast("string")
    at = F.col("at").cast("string")
    if dialect == "ableton":
        note = F.concat(F.lit('<Note Note="'), number, F.lit('" Velocity="'), velocity, F.lit('" Time="'), at, F.lit('"'), F.when(F.col("event_id") % 3 == 0, ' Duration="0.25"').otherwise(""), F.lit("/>"))
        track = F.concat(
            F.lit('<MidiTrack Name="'), F.col("event_type"), F.lit(' &amp; more"><ClipSlot><MidiClip Time="0" Duration="32"><Notes>'), F.col("notes"),
            F.lit('</Notes></MidiClip></ClipSlot><DeviceChain Name="Synth > all"><Parameter Name="size" Value="'), F.col("n").cast("string"), F.lit('"/><Parameter Name="bad" Value="x"/><DeviceChain Name="Inner"><Parameter Name="depth" Value="2"/></DeviceChain></DeviceChain></MidiTrack>'),
        )
        whole = F.concat(
            F.lit('<?xml version="1.0"?><Ableton Creator="Ableton Live 11.3.2"><LiveSet><Tracks>'), F.col("tracks"),
            F.lit('</Tracks><Track Name="Main"><AudioClip Name="intro" Time="4" Duration="'), F.col("n").cast("string"), F.lit('.5"/><AudioClip Time="1.5"/><Track Name="Sub"><AudioClip Name="deep" Time="2" Duration="1"/></Track></Track>'),
            F.lit('<Tempo Time="0" Value="128.0" Numerator="3"/><KeySignature Value="D minor"/><SampleRef Path="Samples/kick.wav"/>'),
            F.lit('<AutomationEnvelope ParameterName="Volume"><Point Time="0" Value="1"/><Point Time="8" Value="'), F.col("n").cast("string"), F.lit('"/></AutomationEnvelope></LiveSet></Ableton>'),
        )
        ending = ".als"
    else:
        note = F.concat(F.lit("<note key='"), number, F.lit("' vel='"), velocity, F.lit("' time='"), at, F.lit("'/>"))
        # Every event type is split into two regions of one name.
        track = F.concat(F.lit('<MIDIRegion name="'), F.col("event_type"), F.lit('">'), F.col("notes"), F.lit('</MIDIRegion><MIDIRegion name="'), F.col("event_type"), F.lit('"><Note/></MIDIRegion><MIDIRegion name="empty"/>'))
        whole = F.concat(F.lit('<LogicProject appVersion="10.7">'), F.col("tracks"), F.lit('<TempoList><TempoEvent position="2" bpm="'), F.col("n").cast("string"), F.lit('"/></TempoList></LogicProject>'))
        ending = ".logicx"
    # At most 64 events are collected for a project.
    notes = e.groupBy("project", "event_type").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", note.alias("note")))), lambda x: x["note"]), "").alias("notes"), F.count(F.lit(1)).alias("n")
    )
    tracks = notes.groupBy("project").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", track.alias("track")))), lambda x: x["track"]), "").alias("tracks"), F.sum("n").alias("n")
    )
    return tracks.select(F.concat(F.lit("/projects/p"), F.col("project").cast("string"), F.lit(ending)).alias("path"), whole.alias("xml"))


P.add(
    "ev",
    "SELECT event_id // 64 AS project, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) % 128 AS vel, (event_id % 64) * 0.5::DOUBLE AS beat FROM events",
)
P.add(
    "als_notes",
    "SELECT '/projects/p' || project || '.als' AS path, event_type || ' & more' AS track_name, dense_rank() OVER (PARTITION BY project ORDER BY event_type) - 1 AS track_index, "
    "row_number() OVER (PARTITION BY project, event_type ORDER BY event_id) - 1 AS note_index, k AS note, vel AS velocity, beat AS start_time, CASE WHEN event_id % 3 = 0 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS duration, 0 AS channel FROM ev",
)
P.add(
    "logic_notes",
    "SELECT '/projects/p' || project || '.logicx' AS path, event_type AS track_name, dense_rank() OVER (PARTITION BY project ORDER BY event_type) - 1 AS track_index, "
    "row_number() OVER (PARTITION BY project, event_type ORDER BY event_id) - 1 AS note_index, k AS note, vel AS velocity, beat AS start_time, 1.0::DOUBLE AS duration, 0 AS channel FROM ("
    "SELECT * FROM ev UNION ALL SELECT DISTINCT project, 9223372036854775807, event_type, 60, 100, 0.0::DOUBLE FROM ev)",
)
P.add("als", "SELECT path, count(*) AS n, count(DISTINCT track_name) AS t FROM als_notes GROUP BY path")
_NOTE = f"path, track_name, track_index, note_index, note, velocity, {r6('start_time')} AS start_time, {r6('duration')} AS duration, channel"


def _als(spark, sf):
    return D.project_xml_extract(documents(spark, sf, "ableton"), "ableton")


def _logic(spark, sf):
    return D.project_xml_extract(documents(spark, sf, "logic"), "logic")


@register(
    "project_xml_extract",
    "SELECT path, 'ableton' AS project_type, '11.3' AS version, CAST(NULL AS VARCHAR) AS error, '[{\"time\":0.0,\"tempo\":128.0,\"time_signature\":\"3/4\"}]' AS tempo_changes, '[{\"time\":0.0,\"key\":\"D minor\"}]' AS key_changes, "
    "'[{\"file_path\":\"/projects/Samples/kick.wav\",\"sample_name\":\"kick.wav\"}]' AS samples, "
    "'[{\"clip_name\":\"intro\",\"start_time\":4.0,\"end_time\":' || (4 + n) || '.5,\"track_name\":\"Main\",\"clip_type\":\"audio\"},{\"clip_name\":\"Unnamed Clip\",\"start_time\":1.5,\"end_time\":1.5,\"track_name\":\"Main\",\"clip_type\":\"audio\"},{\"clip_name\":\"deep\",\"start_time\":2.0,\"end_time\":3.0,\"track_name\":\"Main\",\"clip_type\":\"audio\"},{\"clip_name\":\"deep\",\"start_time\":2.0,\"end_time\":3.0,\"track_name\":\"Sub\",\"clip_type\":\"audio\"}]' AS clips FROM als",
)
def project_xml_extract(spark, sf):
    return _als(spark, sf).select("path", "project_type", "version", "error", "tempo_changes", "key_changes", "samples", "clips")


@register(
    "project_xml_extract_logic",
    "SELECT '/projects/p' || project || '.logicx' AS path, 'logic' AS project_type, '10.7' AS version, CAST(NULL AS VARCHAR) AS error, '[{\"time\":2.0,\"tempo\":' || count(*) || '.0}]' AS tempo_changes FROM ev GROUP BY project",
)
def project_xml_extract_logic(spark, sf):
    return _logic(spark, sf).select("path", "project_type", "version", "error", "tempo_changes")


@register(
    "project_xml_broken",
    "SELECT path, CASE WHEN n % 2 = 0 THEN 'not well-formed XML' END AS error, CASE WHEN n % 2 = 0 THEN 0 ELSE n END AS total_notes FROM als",
)
def project_xml_broken(spark, sf):
    """Projects with an even number of notes lose the end of their document."""
    size = F.size(F.regexp_extract_all("xml", F.lit("<Note "), F.lit(0)))
    broken = documents(spark, sf, "ableton").withColumn("xml", F.when(size % 2 == 0, F.expr("left(xml, length(xml) - 12)")).otherwise(F.col("xml")))
    projects = D.project_xml_extract(broken, "ableton")
    return D.project_counts(projects).select("path", "total_notes").join(projects.select("path", "error"), "path")


@register(
    "project_counts",
    "SELECT path, 'ableton' AS project_type, '11.3' AS version, t AS midi_tracks, n AS total_notes, 4 AS arrangement_clips, 1 AS tempo_changes, 1 AS key_changes, 1 AS plugin_chains, 1 AS sample_sources, 1 AS automation_tracks FROM als".replace(
        "1 AS plugin_chains", "0 AS plugin_chains"
    ),
)
def project_counts(spark, sf):
    """The one plain track has no devices, and it hides the MIDI tracks from the chains."""
    return D.project_counts(_als(spark, sf))


@register("explode_notes", f"SELECT {_NOTE} FROM als_notes")
def explode_notes(spark, sf):
    return D.explode_notes(_als(spark, sf))


@register("merge_regions", f"SELECT {_NOTE} FROM logic_notes")
def merge_regions(spark, sf):
    return D.explode_notes(_logic(spark, sf))


@register(
    "explode_devices",
    f"SELECT path, track_name, d.i AS device_index, d.device_name, 'DeviceChain' AS device_type, d.parameter_name, {r6('CAST(coalesce(d.v, n) AS DOUBLE)')} AS value "
    "FROM (SELECT path, track_name, count(*) AS n FROM als_notes GROUP BY ALL), (VALUES (0, 'Synth > all', 'size', NULL), (0, 'Synth > all', 'depth', 2), (1, 'Inner', 'depth', 2)) d(i, device_name, parameter_name, v)",
)
def explode_devices(spark, sf):
    docs = documents(spark, sf, "ableton").withColumn("xml", F.regexp_replace("xml", "<Track .*</Track>", ""))
    return D.explode_devices(D.project_xml_extract(docs, "ableton"))


@register(
    "explode_automation",
    f"SELECT path, 0 AS curve_index, 'Volume' AS parameter_name, i AS point_index, {r6('CAST(i * 8 AS DOUBLE)')} AS time, {r6('CAST(CASE i WHEN 0 THEN 1 ELSE n END AS DOUBLE)')} AS value FROM als, (VALUES (0), (1)) p(i)",
)
def explode_automation(spark, sf):
    return D.explode_automation(_als(spark, sf))


@register("arrangement_length", f"SELECT path, {r6('4.5 + n')} AS total_length, '[\"Main\",\"Sub\"]' AS tracks FROM als")
def arrangement_length(spark, sf):
    return D.arrangement_length(_als(spark, sf))


P.add(
    "all_counts",
    "SELECT path, 'ableton' AS project_type, t AS midi_tracks, n AS total_notes FROM als UNION ALL SELECT path, 'logic', count(DISTINCT track_name), count(*) FROM logic_notes GROUP BY path",
)


def _counts(spark, sf):
    return D.project_counts(_als(spark, sf)).unionByName(D.project_counts(_logic(spark, sf)))


@register(
    "project_stats",
    f"SELECT count(*) AS total_files, count(c.path) AS total_with_project, {r6('sum(total_notes) / sum(midi_tracks)')} AS avg_notes_per_track FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN all_counts c ON c.path IN ('/projects/p' || user_id || '.als', '/projects/p' || user_id || '.logicx')",
)
def project_stats(spark, sf):
    tracks = X.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("track_id")).distinct()
    counts = _counts(spark, sf).withColumn("track_id", F.regexp_extract("path", "p([0-9]+)[.]", 1))
    return D.project_stats(tracks, counts)


@register("project_type_counts", "SELECT project_type, count(*) AS projects FROM all_counts GROUP BY project_type")
def project_type_counts(spark, sf):
    return D.project_type_counts(_counts(spark, sf))


@register(
    "schema_check",
    "SELECT path, unnest(list_filter(["
    "CASE WHEN n % 3 = 0 THEN 'missing version' END, CASE WHEN n % 4 = 0 THEN 'unknown type reaper' END, CASE WHEN n < 16 THEN 'negative total_notes' END], lambda v: v IS NOT NULL)) AS violation FROM ("
    "SELECT path, total_notes % 31 AS n FROM all_counts)",
)
def schema_check(spark, sf):
    """Some rows are damaged first: no version, an unknown program or a negative count."""
    n = F.col("total_notes") % 31
    damaged = _counts(spark, sf).withColumns(
        {
            "version": F.when(n % 3 != 0, F.col("version")),
            "project_type": F.when(n % 4 == 0, "reaper").otherwise(F.col("project_type")),
            "total_notes": F.when(n < 16, -1).otherwise(F.col("total_notes")),
        }
    )
    return D.schema_check(damaged)
