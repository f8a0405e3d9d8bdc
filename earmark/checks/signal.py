"""Registered queries for signal transforms. The events of a user are one signal of 10 samples a second."""

from __future__ import annotations

from pyspark.sql import functions as F

from earmark import fixtures as X
from earmark.checks.support import Parts, Query, r6, tidy
from earmark.operators import programs
from earmark.operators import recursive as R
from earmark.operators import signal as A

SR = 10
HALF = 8
P = Parts()
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn) -> Query:
        QUERIES[name] = lambda spark, sf: tidy(fn(X.samples(spark, sf)))
        if sql:
            ORACLES[name] = P.sql(sql)
        return fn

    return wrap


P.add("samples", "SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value / 509.0 - 0.5 AS value FROM events")
P.add("sz", "SELECT track_id, count(*) AS n, max(abs(value)) AS peak, avg(value * value) AS power FROM samples GROUP BY track_id")
P.add("s", "SELECT * FROM samples JOIN sz USING (track_id)")
_OUT = f"SELECT track_id, idx, {r6('value')} AS value FROM "


def _cut(start: str, end: str) -> str:
    return (
        f"{_OUT} (SELECT track_id, idx - a AS idx, value FROM (SELECT *, CASE WHEN e0 - a0 < {SR} * 0.5 THEN 0 ELSE a0 END AS a, CASE WHEN e0 - a0 < {SR} * 0.5 THEN n ELSE e0 END AS e "
        f"FROM (SELECT *, {end} AS e0 FROM (SELECT *, {start} AS a0 FROM s))) WHERE idx >= a AND idx < e)"
    )


def _crop(start_sec: str, duration: float) -> str:
    return _cut(f"greatest(0, least(CAST(trunc(({start_sec}) * {SR}) AS BIGINT), n - 1))", f"least(a0 + {int(duration * SR)}, n)")


def _norm(inner: str, threshold: float = 1.0, to: float = 1.0) -> str:
    return f"SELECT track_id, idx, CASE WHEN mx > {threshold} THEN value / mx * {to}::DOUBLE ELSE value END AS value FROM (SELECT *, max(abs(value)) OVER (PARTITION BY track_id) AS mx FROM ({inner}))"


@register("crop", _crop("1.5::DOUBLE", 3.0))
def crop(s):
    return A.crop(s, 1.5, 3.0, SR)


@register("crop_first", _crop("0.0::DOUBLE", 5.0))
def crop_first(s):
    return A.crop_first(s, 5.0, SR)


@register("crop_middle", _crop(f"CASE WHEN n / {SR} - 3.0::DOUBLE < 0 THEN 0 ELSE (n / {SR} - 3.0::DOUBLE) / 2.0 END", 3.0))
def crop_middle(s):
    return A.crop_middle(s, 3.0, SR)


@register("crop_end", _crop(f"CASE WHEN n / {SR} - 2.5::DOUBLE < 0 THEN 0 ELSE n / {SR} - 2.5::DOUBLE END", 2.5))
def crop_end(s):
    return A.crop_end(s, 2.5, SR)


@register("slice_chop", _cut("least(25, n)", "greatest(a0, n - 30)"))
def slice_chop(s):
    return A.slice_chop(s, 2.5, 3.0, SR)


@register("gain_db", f"SELECT track_id, idx, {r6('value * pow(10, -6.0 / 20)')} AS value FROM samples")
def gain_db(s):
    return A.gain_db(s, -6.0)


@register("peak_normalize", _OUT + f"({_norm('SELECT * FROM samples', 0.4)})")
def peak_normalize(s):
    return A.peak_normalize(s, 0.4)


def _limited(source: str, ceiling: float) -> str:
    return (
        f"SELECT track_id, idx, CASE WHEN least(peak, top) > 0.99 THEN greatest(-top, least(top, value)) / least(peak, top) * 0.99 ELSE greatest(-top, least(top, value)) END AS value, value AS before, top "
        f"FROM (SELECT *, pow(10.0, least({ceiling}, 20 * log10(peak + 1e-10) - 3.0) / 20.0) AS top FROM (SELECT *, max(abs(value)) OVER (PARTITION BY track_id) AS peak FROM ({source})))"
    )


P.add("boosted", "SELECT track_id, idx, value * 4 AS value FROM samples")


@register("limit", _OUT + f"({_limited('SELECT * FROM boosted', 2.0)})")
def limit(s):
    return A.limit(s.withColumn("value", F.col("value") * 4), 2.0)


@register("limit_report", f"SELECT track_id, {r6('count(*) FILTER (WHERE abs(before) > top) / count(*) * 100')} AS clip_percentage FROM ({_limited('SELECT track_id, idx, value FROM samples', -8.0)}) GROUP BY track_id")
def limit_report(s):
    return A.limit_report(s, -8.0)


_t = "pow(10, -12.0 / 20)"


@register("compress_static", _OUT + f"(SELECT track_id, idx, CASE WHEN abs(value) > {_t} THEN sign(value) * ({_t} + (abs(value) - {_t}) / 4.0) ELSE value END AS value FROM samples)")
def compress_static(s):
    return A.compress_static(s, -12.0, 4.0)


def _envelope(value: str, span: int) -> str:
    return f"max(abs({value})) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN {span} PRECEDING AND CURRENT ROW)"


@register(
    "compress_envelope",
    _OUT + "(" + _norm(f"SELECT track_id, idx, CASE WHEN env > {_t} THEN value * (({_t} + (env - {_t}) / 2.0) / env) ELSE value END AS value FROM (SELECT *, {_envelope('value', 5)} AS env FROM boosted)", 1.0, 0.99) + ")",
)
def compress_envelope(s):
    return A.compress_envelope(s.withColumn("value", F.col("value") * 4), -12.0, 2.0, 500.0, SR)


@register("overlay_mix", _OUT + "(" + _norm("SELECT a.track_id, a.idx, a.value + b.value * b.value * 6 * pow(10, 0.3 / 20) AS value FROM samples a JOIN samples b ON a.track_id = b.track_id AND a.idx = b.idx WHERE b.idx < 50") + ")")
def overlay_mix(s):
    other = s.where("idx < 50").withColumn("value", F.col("value") * F.col("value") * 6)
    return A.overlay_mix(s, other, 0.3)


def _u(key: str, at: int) -> str:
    return f"((('0x' || substr(md5({key}), {at}, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0)"


def _normal(key: str) -> str:
    return f"(sqrt(-2.0 * ln({_u(key, 1)})) * cos(2.0 * pi() * {_u(key, 9)}))"


@register("add_noise", _OUT + "(" + _norm(f"SELECT track_id, idx, value + {_normal(chr(39) + '7|' + chr(39) + ' || track_id || ' + chr(39) + '|' + chr(39) + ' || idx')} * sqrt(power / pow(10, 1.0)) AS value FROM s") + ")")
def add_noise(s):
    return A.add_noise(s, 10.0, 7)


def _scaled_noise(noise_table: str, snr: float) -> str:
    return _norm(
        f"SELECT track_id, idx, value + noise * CASE WHEN got > 0 THEN sqrt(power / pow(10, {snr} / 10.0) / got) ELSE 1 END AS value FROM (SELECT *, avg(noise * noise) OVER (PARTITION BY track_id) AS got FROM ({noise_table}))"
    )


_pink = " + ".join(_normal(f"'3|' || track_id || '|' || (idx >> {k}) || '|{k}'") for k in range(4))


@register("add_colored_noise_pink", _OUT + f"({_scaled_noise(f'SELECT *, {_pink} AS noise FROM s', 12.0)})")
def add_colored_noise_pink(s):
    return A.add_colored_noise(s, 12.0, "pink", 3, SR, octaves=4)


def _fir(kernel: list[float], value: str = "value") -> str:
    half = len(kernel) // 2
    order = "OVER (PARTITION BY track_id ORDER BY idx)"
    terms = []
    for i, c in enumerate(kernel):
        d = i - half
        at = value if d == 0 else f"lag({value}, {d}, 0.0) {order}" if d > 0 else f"lead({value}, {-d}, 0.0) {order}"
        terms.append(f"{at} * {c!r}::DOUBLE")
    return "(" + " + ".join(terms) + ")"


_click_u = [_u("'5|' || track_id || '|click|' || j", at) for at in (1, 9)]
P.add(
    "clicks",
    "SELECT track_id, a + i AS idx, sum(exp(-50.0 * t) * sin(2.0 * pi() * 8000.0 * t) * size) AS click FROM (SELECT *, CASE WHEN l > 1 THEN i / (l - 1) ELSE 0.0 END AS t FROM ("
    "SELECT *, unnest(range(l)) AS i FROM (SELECT *, least(n, pos + 2) - a AS l FROM (SELECT *, greatest(0, pos - 2) AS a FROM ("
    f"SELECT track_id, n, CAST(floor({_click_u[0]} * n) AS BIGINT) AS pos, {_click_u[1]} + 0.5 AS size FROM (SELECT track_id, n, unnest(range(1, CAST(trunc(n / {SR} * 0.5) AS BIGINT) + 1)) AS j FROM sz)))) WHERE l > 0)) GROUP BY ALL",
)
_hiss_key = "'5|' || track_id || '|' || idx"
P.add("raw_hiss", f"SELECT *, {_normal(_hiss_key)} * sqrt(power / pow(10, 0.9) * 0.3) AS h FROM s")
P.add("vinyl", f"SELECT r.*, r.hiss + coalesce(c.click, 0.0) AS noise FROM (SELECT *, {_fir(A.fir_kernel('high_pass', 5000.0, None, SR, HALF), 'h')} AS hiss FROM raw_hiss) r LEFT JOIN clicks c ON c.track_id = r.track_id AND c.idx = r.idx")


@register("add_colored_noise_vinyl", _OUT + f"({_scaled_noise('SELECT * FROM vinyl', 9.0)})")
def add_colored_noise_vinyl(s):
    return A.add_colored_noise(s, 9.0, "vinyl", 5, SR, clicks_per_second=0.5, click_ms=400.0, half_width=HALF)


def _reverb(delay: int, wet: float, decay: float) -> str:
    taps = [int(delay * f) for f in A.TAP_FACTORS]
    fit = " + ".join(f"CAST({t} < n AS INT)" for t in taps)
    echo = " + ".join(f"CASE WHEN {t} < n THEN lag(value, {t}, 0.0) OVER (PARTITION BY track_id ORDER BY idx) ELSE 0.0 END" for t in taps)
    short = f"CASE WHEN idx = n - 1 AND n > 1 THEN first_value(value) OVER (PARTITION BY track_id ORDER BY idx) * {decay * wet!r}::DOUBLE ELSE 0.0 END"
    return f"SELECT track_id, idx, value + CASE WHEN {fit} > 0 THEN ({echo}) * {decay} * ({wet}::DOUBLE / ({fit})) ELSE {short} END AS value FROM s"


@register("reverb_taps", _OUT + "(" + _norm(_reverb(28, 0.6, 0.5), 0.99) + ")")
def reverb_taps(s):
    return A.reverb_taps(s, 2800.0, 0.6, 0.5, False, SR)


@register("reverb_taps_smooth", _OUT + "(" + _norm(f"SELECT track_id, idx, {_fir(A.fir_kernel('low_pass', None, 4.0, SR, HALF))} AS value FROM ({_reverb(3, 0.3, 0.5)})", 0.99) + ")")
def reverb_taps_smooth(s):
    return A.reverb_taps(s, 300.0, sample_rate=SR, half_width=HALF)


def _resampled(source: str, speed: float) -> str:
    return (
        f"SELECT g.track_id, g.j AS idx, a.value + coalesce(b.value - a.value, 0.0) * CASE WHEN m > 1 AND n > 1 THEN (j * (n - 1) - i * (m - 1)) / (m - 1) ELSE 0.0 END AS value FROM ("
        "SELECT *, CASE WHEN m > 1 THEN (j * (n - 1)) // (m - 1) ELSE 0 END AS i FROM (SELECT *, unnest(range(m)) AS j FROM ("
        f"SELECT track_id, count(*) AS n, CAST(floor(count(*) / {speed}::DOUBLE) AS BIGINT) AS m FROM ({source}) GROUP BY track_id))) g "
        f"JOIN ({source}) a ON a.track_id = g.track_id AND a.idx = g.i LEFT JOIN ({source}) b ON b.track_id = g.track_id AND b.idx = g.i + 1"
    )


@register("speed_resample", _OUT + f"({_resampled('SELECT * FROM samples', 1.1)})")
def speed_resample(s):
    return A.speed_resample(s, 1.1)


@register("speed_resample_slow", _OUT + f"({_resampled('SELECT * FROM samples', 0.4)})")
def speed_resample_slow(s):
    return A.speed_resample(s, 0.4)


_FILTERS = {
    "low_pass": ("low_pass", None, 2.0, None),
    "high_pass": ("high_pass", 1.0, None, None),
    "band_pass": ("band_pass", 0.5, 2.0, None),
    "boost_highs": ("boost_highs", 1.0, None, 9.0),
    "boost_lows": ("boost_lows", None, 1.0, 9.0),
}
for _name, (_kind, _low, _high, _gain) in _FILTERS.items():
    _band = _fir(A.fir_kernel(_kind, _low, _high, SR, HALF))
    _sql = f"SELECT track_id, idx, {_band} AS value FROM samples"
    if _gain:
        _sql = _norm(f"SELECT track_id, idx, value + {_band} * (pow(10, {_gain} / 20) - 1) AS value FROM samples", 0.99)
    register(f"fir_filter_{_name}", _OUT + f"({_sql})")(
        lambda s, kind=_kind, low=_low, high=_high, gain=_gain: A.fir_filter(s, kind, low, high, gain, SR, HALF)
    )

P.add(
    "bands",
    f"SELECT track_id, idx, low, high, value - low - high AS mid FROM (SELECT *, {_fir(A.fir_kernel('low_pass', None, 0.5, SR, HALF))} AS low, {_fir(A.fir_kernel('high_pass', 2.0, None, SR, HALF))} AS high FROM samples)",
)


def _band_sql(band: str) -> str:
    below, fallback, ratio = A.BANDS[band]
    peak = f"20 * log10(max(abs({band})) OVER (PARTITION BY track_id) + 1e-10)"
    return f"pow(10.0, CASE WHEN {peak} > -60 THEN {peak} - {below} ELSE {fallback} END / 20.0) AS t_{band}, {_envelope(band, 0)} AS e_{band}"


_sum = " + ".join(f"CASE WHEN e_{b} > t_{b} THEN {b} * ((t_{b} + (e_{b} - t_{b}) / {A.BANDS[b][2]}) / e_{b}) ELSE {b} END" for b in A.BANDS)


@register(
    "multiband_compress",
    _OUT + "(SELECT track_id, idx, CASE WHEN mx > 0.99 THEN value / mx * 0.99 ELSE greatest(-0.99, least(0.99, value * 1.15::DOUBLE)) END AS value FROM (SELECT *, max(abs(value)) OVER (PARTITION BY track_id) AS mx FROM ("
    f"SELECT track_id, idx, {_sum} AS value FROM (SELECT *, {', '.join(_band_sql(b) for b in A.BANDS)} FROM bands))))",
)
def multiband_compress(s):
    return A.multiband_compress(s, SR, 0.5, 2.0, HALF)


def _tiled(source: str, length: int) -> str:
    return f"SELECT t.track_id, j AS idx, t.value FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS m FROM ({source}) WHERE idx < {length}) t, range({length}) r(j) WHERE j % m = t.idx"


P.add("snippet", "SELECT track_id, idx, value * 2 AS value FROM samples WHERE idx < 12")


def _mixed(background: str, sample: str, start: str, volume: float) -> str:
    return _norm(
        f"SELECT b.track_id, b.idx, b.value + coalesce(p.value * pow(10, {volume} / 20), 0.0) AS value FROM (SELECT *, {start} AS st FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM ({background}))) b "
        f"LEFT JOIN ({sample}) p ON p.track_id = b.track_id AND p.idx = b.idx - b.st"
    )


def _at(spare: str, share: float, length: int) -> str:
    return f"greatest(0, least(CAST(trunc(({spare}) * {share}::DOUBLE * {SR}) AS BIGINT), n - {length}))"


@register("embed_sample", _OUT + "(" + _mixed("SELECT * FROM samples", _tiled("SELECT * FROM snippet", 30), _at(f"n / {SR} - 3.0::DOUBLE", 0.5, 30), 3.0) + ")")
def embed_sample(s):
    snippet = s.where("idx < 12").withColumn("value", F.col("value") * 2)
    return A.embed_sample(s, snippet, "middle", 3.0, 3.0, sample_rate=SR)


@register(
    "embed_sample_effect",
    _OUT + "(" + _mixed("SELECT * FROM samples", f"SELECT track_id, idx, CASE WHEN abs(value) > {_t} THEN sign(value) * ({_t} + (abs(value) - {_t}) / 4.0) ELSE value END AS value FROM ({_tiled('SELECT * FROM snippet', 30)})", _at(f"n / {SR} - 3.0::DOUBLE", 1.0, 30), 0.0) + ")",
)
def embed_sample_effect(s):
    snippet = s.where("idx < 12").withColumn("value", F.col("value") * 2)
    return A.embed_sample(s, snippet, "end", 3.0, 0.0, "compression", {"threshold_db": -12.0, "ratio": 4.0}, SR)


P.add("part_a", "SELECT track_id, idx - a AS idx, value FROM (SELECT *, greatest(0, least(20, n - 1)) AS a FROM s) WHERE idx >= a AND idx < a + 25")


@register("song_in_song", _OUT + "(" + _mixed(_tiled("SELECT track_id, idx, -value AS value FROM samples", 80), "SELECT * FROM part_a", _at("8.0 - 2.5", 0.5, 25), -2.0) + ")")
def song_in_song(s):
    return A.song_in_song(s, s.withColumn("value", -F.col("value")), 2.0, 2.5, 8.0, -2.0, "middle", sample_rate=SR)


_gained = "SELECT track_id, idx, value * pow(10, -3.0 / 20) AS value FROM samples"
P.add("chopped", f"SELECT track_id, idx - a AS idx, value FROM (SELECT *, CASE WHEN greatest(least(10, n), n - 10) - least(10, n) < 5 THEN 0 ELSE least(10, n) END AS a, CASE WHEN greatest(least(10, n), n - 10) - least(10, n) < 5 THEN n ELSE greatest(least(10, n), n - 10) END AS e FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM ({_gained}))) WHERE idx >= a AND idx < e")


@register("apply_chain", _OUT + "(" + _limited(_resampled("SELECT * FROM chopped", 1.25), -9.0) + ")")
def apply_chain(s):
    steps = [
        {"type": "gain", "params": {"db": -3.0}},
        {"type": "not_a_transform", "params": {}},
        {"type": "slice_chop", "params": {"remove_start": 1.0, "remove_end": 1.0}},
        {"type": "speed_change", "params": {"speed": 1.25, "preserve_pitch": False}},
        {"type": "apply_limiting", "params": {"ceiling_db": -9.0}},
    ]
    return A.apply_chain(s, steps, SR)


_VARIANTS = [
    {"variant_id": "quiet", "steps": [{"type": "gain", "params": {"db": -6.0}}]},
    {"variant_id": "fast", "steps": [{"type": "speed_change", "params": {"speed": 1.1}}]},
    {"variant_id": "quiet_mixed", "steps": [{"type": "gain", "params": {"db": -6.0}}, {"type": "overlay_vocals", "params": {"overlay_path": "square", "level_db": 0.3}}]},
]
_quiet = "SELECT track_id, idx, value * pow(10, -6.0 / 20) AS value FROM samples"


@register(
    "apply_variants",
    f"SELECT track_id, variant_id, idx, {r6('value')} AS value FROM (SELECT *, 'quiet' AS variant_id FROM ({_quiet}) UNION ALL BY NAME SELECT *, 'fast' AS variant_id FROM ({_resampled('SELECT * FROM samples', 1.1)}) "
    "UNION ALL BY NAME SELECT *, 'quiet_mixed' AS variant_id FROM (" + _norm(f"SELECT a.track_id, a.idx, a.value + b.value * b.value * 6 * pow(10, 0.3 / 20) AS value FROM ({_quiet}) a JOIN samples b ON a.track_id = b.track_id AND a.idx = b.idx") + "))",
)
def apply_variants(s):
    square = s.withColumn("value", F.col("value") * F.col("value") * 6)
    return A.apply_variants(s, _VARIANTS, SR, overlays={"square": square})


_own_cut = _cut("least((track_id % 3) * 5, n)", "greatest(a0, n - 10)")
_mixed_quiet = _norm(f"SELECT a.track_id, a.idx, a.value + b.value * b.value * 6 * pow(10, 0.3 / 20) AS value FROM ({_quiet}) a JOIN samples b ON a.track_id = b.track_id AND a.idx = b.idx")


@register(
    "apply_programs",
    f"SELECT track_id, variant_id, idx, {r6('value')} AS value FROM (SELECT track_id, idx, value * pow(10, (-1 - track_id % 5) / 20.0) AS value, 'own_gain' AS variant_id FROM samples "
    f"UNION ALL BY NAME SELECT *, 'own_cut' AS variant_id FROM ({_own_cut}) UNION ALL BY NAME SELECT *, 'fast' AS variant_id FROM ({_resampled('SELECT * FROM samples', 1.1)}) "
    f"UNION ALL BY NAME SELECT *, 'limited' AS variant_id FROM ({_limited(f'SELECT * FROM ({_quiet})', -9.0)}) UNION ALL BY NAME SELECT *, 'quiet_mixed' AS variant_id FROM ({_mixed_quiet}))",
)
def apply_programs(s):
    def step(kind: str, **params):
        given = F.create_map(*[c for k, v in params.items() for c in (F.lit(k), F.lit(v).cast("string"))])
        return F.struct(F.lit(kind).alias("type"), given.alias("params"))

    quiet = step("gain", db=-6.0)
    made = {
        "own_gain": [step("gain", db=-1 - F.col("track_id") % 5)],
        "own_cut": [step("slice_chop", remove_start=F.col("track_id") % 3 * 0.5, remove_end=1.0)],
        "fast": [step("speed_change", speed=1.1)],
        "limited": [quiet, step("apply_limiting", ceiling_db=-9.0)],
        "quiet_mixed": [quiet, step("overlay_vocals", overlay_path="square", level_db=0.3)],
    }
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("variant_id"), F.array(*steps).alias("steps")) for name, steps in made.items()]))
    variants = s.select("track_id").distinct().select("track_id", rows.alias("v")).select("track_id", "v.*")
    square = s.withColumn("value", F.col("value") * F.col("value") * 6)
    return programs.apply_programs(s, variants, SR, overlays={"square": square})


def _long_fir(kernel: list[float], source: str = "samples") -> str:
    """Convolution with a kernel too long to be written as terms."""
    rows = ", ".join(f"({i - len(kernel) // 2}, {c!r}::DOUBLE)" for i, c in enumerate(kernel))
    return f"SELECT a.track_id, a.idx, sum(b.value * k.c) AS value FROM {source} a JOIN {source} b ON a.track_id = b.track_id JOIN (VALUES {rows}) k(d, c) ON k.d = a.idx - b.idx GROUP BY ALL"


for _name, _kind, _low, _high in (("low_pass", "low_pass", None, 400.0), ("high_pass", "high_pass", 300.0, None), ("band_pass", "band_pass", 300.0, 3000.0)):
    register(f"fir_filter_{_name}_44k", _OUT + f"({_long_fir(A.fir_kernel(_kind, _low, _high, 44100))})")(
        lambda s, kind=_kind, low=_low, high=_high: A.fir_filter(s, kind, low, high)
    )


@register(
    "compress_envelope_44k",
    _OUT + "(" + _norm(f"SELECT track_id, idx, CASE WHEN env > {_t} THEN value * (({_t} + (env - {_t}) / 2.0) / env) ELSE value END AS value FROM (SELECT *, {_envelope('value', 44)} AS env FROM boosted)", 1.0, 0.99) + ")",
)
def compress_envelope_44k(s):
    return A.compress_envelope(s.withColumn("value", F.col("value") * 4), -12.0, 2.0, 1.0)


@register("mono_mixdown", f"SELECT track_id, idx, {r6('(value + value * 0.5::DOUBLE + 0.1::DOUBLE) / 2')} AS value FROM samples")
def mono_mixdown(s):
    left, right = s.withColumn("channel", F.lit(0)), s.withColumn("value", F.col("value") * 0.5 + 0.1).withColumn("channel", F.lit(1))
    return A.mono_mixdown(left.unionByName(right))


SIZE, HOP = 20, 10
P.add("segments", f"SELECT track_id, n, unnest(range((n - {SIZE}) // {HOP} + 1)) AS segment_idx FROM sz WHERE n >= {SIZE}")


@register(
    "segment",
    f"SELECT track_id, segment_idx, track_id || '_seg_' || lpad(CAST(segment_idx AS VARCHAR), 4, '0') AS segment_id, {r6(f'segment_idx * {HOP} / {SR}')} AS start, {r6(f'(segment_idx * {HOP} + {SIZE}) / {SR}')} AS \"end\", "
    f"2.0::DOUBLE AS duration, segment_idx * {HOP} AS start_sample, segment_idx * {HOP} + {SIZE} AS end_sample FROM segments",
)
def segment(s):
    return A.segment(s, 2.0, 0.5, SR)


P.add("seg_samples", f"SELECT g.track_id, g.segment_idx, s.idx, s.idx - g.segment_idx * {HOP} AS pos, s.value FROM segments g JOIN samples s ON s.track_id = g.track_id AND s.idx >= g.segment_idx * {HOP} AND s.idx < g.segment_idx * {HOP} + {SIZE}")


@register("segment_samples", f"SELECT track_id, segment_idx, idx, pos, {r6('value')} AS value FROM seg_samples")
def segment_samples(s):
    return A.segment_samples(s, 2.0, 0.5, SR)


@register(
    "segment_features",
    f"SELECT track_id, segment_idx, d, {r6('v[d] / len')} AS x FROM (SELECT *, sqrt(list_dot_product(v, v)) AS len, unnest(range(1, 9)) AS d FROM (SELECT track_id, segment_idx, "
    "[avg(value), stddev_pop(value), sqrt(avg(value * value)), avg(CASE WHEN sign(value) <> sign(prev) THEN 1.0 ELSE 0.0 END), max(abs(value)), 0.0, 0.0, 0.0]::DOUBLE[] AS v FROM ("
    "SELECT *, lag(value) OVER (PARTITION BY track_id, segment_idx ORDER BY idx) AS prev FROM seg_samples) GROUP BY ALL))",
)
def segment_features(s):
    return A.segment_features(s, 2.0, 0.5, 8, SR).select("track_id", "segment_idx", F.posexplode("vector").alias("d", "x")).withColumn("d", F.col("d") + 1)


# Frames of eight samples, as if there were 44,100 of them in a second; bins by band as `signal.mel_edges` cuts them.
FRAME, WIDE = 8, 44100


def _bins(bands: int, top: float) -> list[list[int]]:
    edges = A.mel_edges(bands, top)
    out = [[] for _ in range(bands)]
    for k in range(FRAME // 2 + 1):
        hz = k * WIDE / FRAME
        b = next((b for b in range(bands) if edges[b] <= hz < edges[b + 1]), bands - 1 if abs(hz - edges[-1]) < 1e-6 else None)
        if b is not None:
            out[b].append(k)
    return out


P.add("framed", f"SELECT a.track_id, a.idx AS start, list(b.value ORDER BY b.idx) AS x FROM samples a JOIN samples b ON a.track_id = b.track_id AND b.idx BETWEEN a.idx AND a.idx + {FRAME - 1} WHERE a.idx % {FRAME // 2} = 0 GROUP BY ALL HAVING count(*) = {FRAME}")
_wave = lambda f: f"list_sum([x[t + 1] * (0.5 - 0.5 * cos(2 * pi() * t / {FRAME})) * {f}(2 * pi() * k * t / {FRAME}) FOR t IN range(0, {FRAME})])"
P.add("spectrum", f"SELECT track_id, start, k, pow({_wave('cos')}, 2) + pow({_wave('sin')}, 2) AS power FROM framed, (SELECT unnest(range(0, {FRAME // 2 + 1})) AS k)")


def _bands(bands: int, top: float) -> str:
    """Energy of each frame in each band; bands without a bin have none."""
    listed = ", ".join(f"({b}, {[k for k in ks]}::BIGINT[])" for b, ks in enumerate(_bins(bands, top)))
    return f"SELECT f.track_id, f.start, b, coalesce(sum(s.power), 0.0) AS e FROM framed f CROSS JOIN (VALUES {listed}) v(b, ks) LEFT JOIN spectrum s ON s.track_id = f.track_id AND s.start = f.start AND list_contains(ks, s.k) GROUP BY ALL"


P.add("band4", _bands(4, WIDE / 2))
P.add("band8", _bands(8, WIDE / 2))
_SIZE, _HOP = 32, 16


@register(
    "spectral_features",
    f"SELECT track_id, segment_idx, unnest(range(0, 8)) AS d, {r6('unnest(v) / sqrt(list_dot_product(v, v))')} AS x FROM (SELECT track_id, segment_idx, list_concat(list(m ORDER BY b), list(sd ORDER BY b))::DOUBLE[] AS v FROM ("
    "SELECT track_id, segment_idx, b, avg(l) AS m, sqrt(greatest(0.0, avg(l * l) - avg(l) * avg(l))) AS sd FROM ("
    f"SELECT g.track_id, g.segment_idx, b, ln(greatest(e, 1e-10)) AS l FROM (SELECT track_id, unnest(range(0, (n - {_SIZE}) // {_HOP} + 1)) AS segment_idx FROM sz WHERE n >= {_SIZE}) g "
    f"JOIN band4 f ON f.track_id = g.track_id AND f.start >= g.segment_idx * {_HOP} AND f.start + {FRAME} <= g.segment_idx * {_HOP} + {_SIZE}) GROUP BY ALL) GROUP BY ALL)",
)
def spectral_features(s):
    """Mean and spread of the energy in four bands, at 44.1 kHz."""
    found = A.spectral_features(s, (_SIZE + 0.5) / WIDE, 0.5, 8, WIDE, frame=FRAME)
    return found.select("track_id", "segment_idx", F.posexplode("vector").alias("d", "x"))


P.add(
    "ratios",
    "SELECT track_id, CASE WHEN t > 0 THEN (l / 4) / (t / 8) ELSE 0.0 END AS low_ratio, CASE WHEN a + v / 3 > 0 THEN a / (a + v / 3) ELSE 0.0 END AS bass_ratio FROM ("
    "SELECT track_id, sum(e) AS t, sum(e) FILTER (WHERE b < 4) AS l, sum(e) FILTER (WHERE b = 0) AS a, sum(e) FILTER (WHERE b BETWEEN 1 AND 3) AS v FROM band8 GROUP BY track_id)",
)


@register("band_ratios", f"SELECT track_id, {r6('low_ratio')} AS low_ratio, {r6('bass_ratio')} AS bass_ratio FROM ratios")
def band_ratios(s):
    return A.band_ratios(s, WIDE, frame=FRAME, top_hz=WIDE / 2)


# One section of a recursive low-pass, and the attack and release of an envelope.
LOW_B, LOW_A = R.butterworth("low_pass", 1.5, SR, 2)[0]
ATTACK_MS, RELEASE_MS = 150.0, 400.0
_b0, _b1, _b2, _a1, _a2 = (repr(x / LOW_A[0]) + "::DOUBLE" for x in (*LOW_B, *LOW_A[1:]))


def _recursive(source: str) -> str:
    """The section over a table of samples, from rest."""
    return (
        f"WITH RECURSIVE r AS (SELECT track_id, idx, value AS x1, 0.0::DOUBLE AS x2, {_b0} * value AS y1, 0.0::DOUBLE AS y2 FROM {source} WHERE idx = 0 UNION ALL "
        f"SELECT s.track_id, s.idx, s.value, r.x1, {_b0} * s.value + {_b1} * r.x1 + {_b2} * r.x2 - {_a1} * r.y1 - {_a2} * r.y2, r.y1 "
        f"FROM r JOIN {source} s ON s.track_id = r.track_id AND s.idx = r.idx + 1) SELECT track_id, idx, y1 AS value FROM r"
    )


P.add("iir", _recursive("samples"))
P.add("iir_turned", "SELECT track_id, n - 1 - idx AS idx, i.value FROM iir i JOIN sz USING (track_id)")
P.add("iir_back", _recursive("iir_turned"))


@register("recursive_filter", f"{_OUT} iir")
def recursive_filter(s):
    return R.recursive_filter(s, LOW_B, LOW_A, block=16, fan=3)


@register("recursive_zero_phase", f"SELECT track_id, n - 1 - idx AS idx, {r6('i.value')} AS value FROM iir_back i JOIN sz USING (track_id)")
def recursive_zero_phase(s):
    """Forwards and backwards."""
    return R.recursive_pass(s, "low_pass", 1.5, SR, 2)


_at, _re = (f"exp(-1000.0::DOUBLE / ({ms} * {SR}))" for ms in (ATTACK_MS, RELEASE_MS))
_limit = "pow(10.0::DOUBLE, -12.0::DOUBLE / 20)"
P.add(
    "envelope",
    f"WITH RECURSIVE e AS (SELECT track_id, idx, value, abs(value) - abs(value) * (CASE WHEN abs(value) > 0 THEN {_at} ELSE {_re} END) AS env FROM samples WHERE idx = 0 UNION ALL "
    f"SELECT s.track_id, s.idx, s.value, abs(s.value) + (e.env - abs(s.value)) * (CASE WHEN abs(s.value) > e.env THEN {_at} ELSE {_re} END) FROM e JOIN samples s ON s.track_id = e.track_id AND s.idx = e.idx + 1) SELECT * FROM e",
)


@register("follow_compress", f"{_OUT} ({_norm(f'SELECT track_id, idx, CASE WHEN env > {_limit} THEN value * (({_limit} + (env - {_limit}) / 4.0::DOUBLE) / env) ELSE value END AS value FROM envelope', 1.0, 0.99)})")
def follow_compress(s):
    """Attack and release instead of the sliding peak."""
    return R.follow_compress(s, -12.0, 4.0, ATTACK_MS, RELEASE_MS, SR)
