"""DuckDB SQL that the queries are checked against, on the driver's tables.

Timing, movement and waits are folds here, one sample or interval after another in recursive
queries, where the library uses windows; so each is a second way to the same rows.
"""

from __future__ import annotations

from ..functions.labels import MODE_ICONS, MODES, UNAVAILABLE_GHOST, UNAVAILABLE_WAITING, UNRANKED


def hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2))"
    return f"(12742000.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt({h}))))"


def milli(x: str) -> str:
    return f"CAST(floor(({x}) * 1000 + 0.5) AS BIGINT)"


D = "111320.0::DOUBLE"
SAMPLES = f"""
  ev AS (SELECT event_id, user_id, ts, event_type, coalesce(CAST(nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '') AS INTEGER), 0) AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL),
  aw AS (SELECT *, user_id % 7 = 3 AND n BETWEEN 12 AND 21 OR user_id % 7 = 5 AND n BETWEEN 12 AND 56 AS away FROM ev),
  st AS (SELECT *, CASE WHEN away OR event_type = 'error' THEN 0.0::DOUBLE WHEN user_id % 13 = 4 AND event_type = 'view' THEN -5.0::DOUBLE ELSE 4.0::DOUBLE + k % 9 END AS step,
    CASE WHEN event_type = 'error' THEN 6000 + 100 * k ELSE 1000 END AS dt, CASE user_id % 11 WHEN 2 THEN 12.0::DOUBLE WHEN 6 THEN 45.0::DOUBLE ELSE 0.0::DOUBLE END AS begin_m FROM aw),
  ru AS (SELECT *, CAST(sum(dt) OVER w AS BIGINT) AS run_ms, greatest(0.0::DOUBLE, sum(step) OVER w - 4 + begin_m) AS along FROM st WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
  sam AS (SELECT CAST(user_id AS VARCHAR) AS attempt_id, CAST(user_id % 5 AS VARCHAR) AS route_id, CAST(event_id AS VARCHAR) AS id, event_id, 1700000000000 + user_id * 10000000 + run_ms AS t,
    32.08::DOUBLE + along / {D} AS lat, CASE WHEN away THEN 34.78::DOUBLE + 0.00127::DOUBLE ELSE 34.78::DOUBLE END AS lon, CASE WHEN k = 99 THEN 60.0::DOUBLE WHEN k <> 98 THEN 3.0::DOUBLE + k % 30 END AS acc,
    CASE WHEN event_type <> 'signup' THEN abs(step) * 1000.0 / dt END AS speed, CASE WHEN k <> 97 THEN k * 3.5::DOUBLE END AS heading FROM ru)"""
SEGMENTS = f"""
  pt AS (SELECT i, 32.08::DOUBLE + i * (20.0::DOUBLE / {D}) AS lat, 34.78::DOUBLE AS lon FROM (SELECT CAST(range AS INTEGER) AS i FROM range(16))),
  sl AS (SELECT a.i AS seg, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon, {hav("a.lat", "a.lon", "b.lat", "b.lon")} AS len FROM pt a JOIN pt b ON b.i = a.i + 1),
  sc AS (SELECT seg, 0.0::DOUBLE AS s0, len AS s1 FROM sl WHERE seg = 0 UNION ALL SELECT sl.seg, sc.s1, sc.s1 + sl.len FROM sc JOIN sl ON sl.seg = sc.seg + 1),
  sg AS (SELECT * FROM sl JOIN sc USING (seg)),
  co AS (SELECT *, greatest(start_p, finish_p - least(30.0::DOUBLE, greatest(0.0::DOUBLE, greatest(0.0::DOUBLE, finish_p - start_p) - 10))) AS trigger_p
    FROM (SELECT CAST(r_regionkey AS VARCHAR) AS route_id, CASE WHEN r_regionkey = 4 THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END AS start_p, (SELECT max(s1) FROM sg) AS finish_p FROM region))"""


def fixed(x: str, digits: int) -> str:
    """A number with so many digits after the point: printf rounds exactly, but exact halves to even digits; these get a little more."""
    half = f"({x}) * {2 ** (digits + 1)} = floor(({x}) * {2 ** (digits + 1)}) AND abs({x}) * 1e{digits} - floor(abs({x}) * 1e{digits}) = 0.5"
    return f"CASE WHEN {half} THEN printf('%.{digits}f', ({x}) + sign({x}) * 2e-{digits + 1}) ELSE printf('%.{digits}f', {x}) END"


def projected(source: str, lat: str, lon: str) -> str:
    """Every row of ``source`` on every segment: share, progress p and distance d."""
    ex, ey = f"((blon - alon) * ({D} * cos(radians(alat))))", f"((blat - alat) * {D})"
    px, py = f"(({lon} - alon) * ({D} * cos(radians(alat))))", f"(({lat} - alat) * {D})"
    share = f"CASE WHEN {ex} * {ex} + {ey} * {ey} > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({px} * {ex} + {py} * {ey}) / ({ex} * {ex} + {ey} * {ey}))) ELSE 0.0::DOUBLE END"
    inner = f"SELECT x.*, sg.*, {share} AS share FROM {source} x CROSS JOIN sg"
    snap_lat, snap_lon = f"alat + {ey} * share / {D}", f"alon + {ex} * share / ({D} * cos(radians(alat)))"
    return f"(SELECT *, s0 + share * len AS p, {hav(f'({snap_lat})', f'({snap_lon})', lat, lon)} AS d FROM ({inner}))"


def place_at(p: str) -> str:
    """Latitude of the point of the course at a progress; its longitude is the same everywhere."""
    return f"(SELECT min(alat + (blat - alat) * least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({p} - s0) / len))) FROM sg WHERE ({p} > s0 OR seg = 0) AND ({p} <= s1 OR seg = 14))"


def matched(name: str, source: str) -> str:
    """A fold over each attempt's samples in order of time and id, as a recursive query."""
    return f"""
  {name}_s AS (SELECT x.*, co.start_p, co.finish_p, co.trigger_p, row_number() OVER (PARTITION BY attempt_id ORDER BY t, id) - 1 AS seq FROM {source} x JOIN co USING (route_id)),
  {name}_c AS (SELECT attempt_id, seq, list(struct_pack(s0 := s0, s1 := s1, p := p, d := d)) AS cand FROM {projected(f"{name}_s", "lat", "lon")} GROUP BY attempt_id, seq),
  {name}_i AS (SELECT s.*, c.cand FROM {name}_s s JOIN {name}_c c USING (attempt_id, seq)),
  {name}_r AS (
    SELECT attempt_id, CAST(-1 AS BIGINT) AS seq, NULL::DOUBLE AS last, NULL::VARCHAR AS quality, NULL::DOUBLE AS p, NULL::DOUBLE AS d, NULL::BOOLEAN AS advancing FROM {name}_i WHERE seq = 0
    UNION ALL
    SELECT attempt_id, seq, CASE WHEN q = 'accepted' THEN b.p ELSE last END, q, CASE WHEN q IN ('accepted', 'off_course') THEN b.p END, CASE WHEN q IN ('accepted', 'off_course') THEN b.d END, q = 'accepted' AND (last IS NULL OR b.p >= last - 25) FROM (
      SELECT *, CASE WHEN acc > 45 THEN 'poor_accuracy' WHEN b IS NULL THEN 'out_of_window' WHEN b.d > 35 THEN 'off_course' ELSE 'accepted' END AS q FROM (
        SELECT i.attempt_id, i.seq, i.acc, r.last, list_sort(list_transform(
            list_filter(i.cand, lambda c: c.s1 >= coalesce(r.last - 25, i.start_p - 50) AND c.s0 <= coalesce(r.last + 90, i.start_p + 70)),
            lambda c: struct_pack(cost := c.d + 0.3::DOUBLE * abs(c.p - coalesce(r.last, i.start_p)) + CASE WHEN c.p < coalesce(r.last, i.start_p) THEN 8 ELSE 0 END, np := -c.p, p := c.p, d := c.d)))[1] AS b
        FROM {name}_r r JOIN {name}_i i ON i.attempt_id = r.attempt_id AND i.seq = r.seq + 1)) z),
  {name} AS (SELECT s.*, r.quality, r.p, r.d, r.advancing FROM {name}_s s JOIN {name}_r r USING (attempt_id, seq))"""


def cross(line: str, p0: str = "pp", t0: str = "pt", p1: str = "p", t1: str = "t") -> str:
    return f"(CASE WHEN {p1} = {p0} THEN CAST({t1} AS DOUBLE) ELSE {t0} + least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({line} - {p0}) / ({p1} - {p0}))) * ({t1} - {t0}) END)"


def _steps(array: str) -> str:
    """Places of a list's elements from the second on."""
    return f"range(2, len({array}) + 1)"


def _crossed(array: str, line: str) -> str:
    """Places of a list of (t, p) at which a line is crossed upwards."""
    return f"list_filter({_steps(array)}, lambda i: {array}[i - 1].p < {line} AND {array}[i].p >= {line})"


def _crossing(array: str, i: str, line: str) -> str:
    return cross(line, f"{array}[{i} - 1].p", f"{array}[{i} - 1].t", f"{array}[{i}].p", f"{array}[{i}].t")


# One sample after another, with what the attempt has come to: its life, its validity, the accepted samples.
_LATE = f"""(CASE WHEN list_max({_crossed("acc1", "start_p")}) > coalesce(list_max(list_filter({_steps("acc1")}, lambda i: acc1[i].p < start_p - 4)), 0)
      THEN {_crossing("acc1", f"list_max({_crossed('acc1', 'start_p')})", "start_p")} END)"""
_BAND = "list_max(list_filter(range(1, len(win) + 1), lambda i: win[i].p <= 5))"
_DEPARTED = f"CASE WHEN {_BAND} < len(win) THEN {cross(f'least(5.0::DOUBLE, win[{_BAND} + 1].p)', f'win[{_BAND}].p', f'win[{_BAND}].t', f'win[{_BAND} + 1].p', f'win[{_BAND} + 1].t')} ELSE CAST(win[1].t AS DOUBLE) END"
TIMING = f"""
  en AS (
    SELECT attempt_id, CAST(-1 AS BIGINT) AS seq, 'armed' AS life, 'pending' AS valid, []::STRUCT(t BIGINT, p DOUBLE)[] AS acc, false AS saw, NULL::DOUBLE AS started, NULL::DOUBLE AS finished, NULL::BIGINT AS since, CAST(0 AS BIGINT) AS lost, NULL::BIGINT AS last_t, NULL::BIGINT AS end_seq FROM m WHERE seq = 0
    UNION ALL
    SELECT attempt_id, seq, CASE WHEN NOT live THEN life WHEN done THEN 'completed' WHEN gone THEN 'abandoned' WHEN departs THEN 'active' ELSE life END,
      CASE WHEN NOT live THEN valid WHEN done THEN CASE WHEN lost1 >= 25000 THEN 'unranked' ELSE 'valid' END WHEN gone OR off AND lost1 >= 25000 THEN 'unranked' ELSE valid END,
      acc1, saw1, started1, CASE WHEN done THEN ended ELSE finished END, since1, lost1, CASE WHEN live THEN t ELSE last_t END, CASE WHEN live AND (done OR gone) THEN seq ELSE end_seq END
    FROM (SELECT *, (life = 'active' OR departs) AND ok AND p >= trigger_p AND ended >= started1 AS done, off AND t - since1 >= 60000 AS gone FROM (
      SELECT *, CASE WHEN departs THEN CASE WHEN start_p > 5 THEN coalesce({_LATE}, {_DEPARTED}) ELSE {_DEPARTED} END ELSE started END AS started1,
        CASE WHEN ok AND p >= trigger_p THEN coalesce({_crossing("acc1", f"list_max({_crossed('acc1', 'finish_p')})", "finish_p")}, {_crossing("acc1", f"list_min({_crossed('acc1', 'trigger_p')})", "trigger_p")}, CAST(t AS DOUBLE)) END AS ended FROM (
        SELECT *, ok AND life = 'armed' AND len(win) >= 4 AND p - win[1].p >= 18 AND p >= start_p AND len(list_filter(win, lambda x: abs(x.p - start_p) <= 30)) > 0 AND (start_p <= 5 OR saw1) AS departs FROM (
          SELECT *, list_filter(acc1, lambda x: x.t >= t - 5000) AS win FROM (
            SELECT *, CASE WHEN ok THEN list_append(acc, struct_pack(t := t, p := p)) ELSE acc END AS acc1, saw OR ok AND start_p > 5 AND p < start_p - 3 AS saw1,
              CASE WHEN ok THEN NULL WHEN off AND since IS NULL THEN t ELSE since END AS since1, lost + CASE WHEN off THEN greatest(0, coalesce(t - last_t, 0)) ELSE 0 END AS lost1 FROM (
              SELECT r.* EXCLUDE (seq), i.seq, i.t, i.p, i.start_p, i.finish_p, i.trigger_p, r.life IN ('armed', 'active') AS live, r.life IN ('armed', 'active') AND i.quality = 'accepted' AS ok, r.life = 'active' AND i.quality IN ('off_course', 'out_of_window') AS off
              FROM en r JOIN m i ON i.attempt_id = r.attempt_id AND i.seq = r.seq + 1)))))) z),
  rn AS (SELECT a.*, start_p, finish_p, trigger_p, e.life AS replayed, e.valid AS validity, e.started, e.finished, e.acc, e.end_seq FROM (SELECT attempt_id, route_id, min(t) - 1000 AS armed FROM sam GROUP BY ALL) a JOIN co USING (route_id) JOIN (SELECT attempt_id, arg_max(en, seq) AS e FROM en GROUP BY attempt_id) USING (attempt_id)),
  sx AS (SELECT *, CASE WHEN replayed <> 'completed' THEN 'replay_incomplete' WHEN validity <> 'valid' THEN 'not_valid' WHEN len(list_filter(acc, lambda x: x.p <= CASE WHEN start_p <= 5 THEN 5 ELSE start_p END)) = 0 THEN 'missing_start_coverage' END AS reason FROM rn),
  el AS (SELECT *, greatest(0.0::DOUBLE, finished - started) AS official FROM sx WHERE reason IS NULL)"""
RANKED = """
  rk AS (SELECT *, row_number() OVER b AS rank, first_value(attempt_id) OVER b AS best_id, first_value(official) OVER b AS best, lag(official) OVER c AS previous,
      min(struct_pack(o := official, s := started, a := armed, i := attempt_id)) OVER (PARTITION BY route_id ORDER BY finished, armed, attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb
    FROM el WINDOW b AS (PARTITION BY route_id ORDER BY official, started, armed, attempt_id), c AS (PARTITION BY route_id ORDER BY finished, armed, attempt_id)),
  rt AS (SELECT *, rank = 1 AS is_pb, CASE WHEN rank = 1 THEN pb.i ELSE best_id END AS target_id, official - CASE WHEN rank = 1 THEN pb.o ELSE best END AS delta_pb FROM rk)"""
# Every attempt as the focus: of those without a rank, by when they were armed.
FOCUS = """
  fo AS (SELECT x.attempt_id, x.route_id, x.reason, coalesce(e.finished, x.armed) AS at, x.armed, e.official, e.started, e.finished, x.start_p, x.finish_p, x.trigger_p, x.acc FROM sx x LEFT JOIN el e USING (attempt_id)),
  fb AS (SELECT f.attempt_id, max(struct_pack(f := e.finished, a := e.armed, i := e.attempt_id, o := e.official)) FILTER (WHERE (e.finished, e.armed, e.attempt_id) < (f.at, f.armed, f.attempt_id)) AS prev,
      min(struct_pack(o := e.official, s := e.started, a := e.armed, i := e.attempt_id)) FILTER (WHERE (e.finished, e.armed, e.attempt_id) < (f.at, f.armed, f.attempt_id)) AS pb,
      min(struct_pack(o := e.official, s := e.started, a := e.armed, i := e.attempt_id)) AS best FROM fo f LEFT JOIN el e ON e.route_id = f.route_id AND e.attempt_id <> f.attempt_id OR e.attempt_id = f.attempt_id GROUP BY f.attempt_id),
  fa AS (SELECT f.*, prev.i AS previous_id, official - prev.o AS delta_previous, fb.pb.o AS pb_before, coalesce(best.i = f.attempt_id, false) AS is_pb, CASE WHEN best.i = f.attempt_id THEN fb.pb.i ELSE best.i END AS target_id,
      official - CASE WHEN best.i = f.attempt_id THEN fb.pb.o ELSE best.o END AS delta_pb FROM fo f JOIN fb USING (attempt_id))"""
CROSSED = f"""
  cp AS (SELECT 'cp' || i AS checkpoint_id, CAST(i AS INTEGER) AS cp_order, 100.0::DOUBLE * i AS mark FROM range(1, 3) x(i)),
  ap AS (SELECT attempt_id, route_id, started, start_p, finish_p, unnest(range(2, len(acc) + 1)) AS i, acc FROM rn WHERE started IS NOT NULL),
  aq AS (SELECT attempt_id, started, start_p, finish_p, i, acc[i - 1].p AS pp, acc[i - 1].t AS pt, acc[i].p AS p, acc[i].t AS t FROM ap),
  cr AS (SELECT attempt_id, checkpoint_id, cp_order, arg_min({cross("mark")}, i) AS crossed FROM aq, cp WHERE mark > start_p AND mark < finish_p AND pp < mark AND p >= mark AND {cross("mark")} >= started GROUP BY ALL)"""
SEGMENT_TIMES = """
  us AS (SELECT cr.attempt_id, checkpoint_id, cp_order, crossed, coalesce(max(crossed) OVER (PARTITION BY cr.attempt_id ORDER BY cp_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), started) AS seen, started FROM cr JOIN el USING (attempt_id) WHERE crossed BETWEEN started AND finished),
  en2 AS (SELECT attempt_id, route_id, 0 AS o, 'start' AS mark, started AS tt FROM el UNION ALL SELECT attempt_id, route_id, 99, 'finish', finished FROM el
    UNION ALL SELECT el.attempt_id, el.route_id, cp.cp_order, cp.checkpoint_id, us.crossed FROM el CROSS JOIN cp LEFT JOIN us ON us.attempt_id = el.attempt_id AND us.checkpoint_id = cp.checkpoint_id AND us.crossed > greatest(us.seen, us.started)),
  sq AS (SELECT attempt_id, route_id, CAST(row_number() OVER w AS INTEGER) AS seg, mark || '->' || lead(mark) OVER w AS segment_id, tt, lead(tt) OVER w AS to_tt, lead(mark) OVER w AS nm FROM en2 WINDOW w AS (PARTITION BY attempt_id ORDER BY o)),
  sd AS (SELECT attempt_id, route_id, seg, segment_id, CASE WHEN to_tt >= tt THEN to_tt - tt END AS duration FROM sq WHERE nm IS NOT NULL)"""

BASE = f"WITH RECURSIVE {SAMPLES}, {SEGMENTS}, {matched('m', 'sam')}, {TIMING}"

# A path that bends, crosses its beginning and goes back along the way it came, and traces along it.
WINDING = f"""
  xy AS (SELECT CAST(range AS INTEGER) AS i, CASE WHEN range <= 10 THEN range WHEN range <= 15 THEN 10 WHEN range <= 25 THEN 25 - range WHEN range <= 32 THEN range - 25 ELSE 39 - range END AS x,
    CASE WHEN range <= 10 THEN 0 WHEN range <= 15 THEN range - 10 WHEN range <= 25 THEN 5 WHEN range <= 32 THEN 30 - range ELSE range - 34 END AS y FROM range(41)),
  way AS (SELECT i, 32.08::DOUBLE + y * (20.0::DOUBLE / {D}) AS lat, 34.78::DOUBLE + x * (20.0::DOUBLE / ({D} * 0.85::DOUBLE)) AS lon FROM xy),
  pt AS (SELECT * FROM way WHERE i <= 39),
  {SEGMENTS[SEGMENTS.index("sl AS"):SEGMENTS.index("co AS")]}
  co AS (SELECT *, greatest(start_p, finish_p - least(30.0::DOUBLE, greatest(0.0::DOUBLE, greatest(0.0::DOUBLE, finish_p - start_p) - 10))) AS trigger_p
    FROM (SELECT CAST(r_regionkey AS VARCHAR) AS route_id, CASE r_regionkey WHEN 3 THEN 40.0::DOUBLE WHEN 4 THEN 5000.0::DOUBLE ELSE 0.0::DOUBLE END AS start_p, (SELECT max(s1) FROM sg) AS finish_p FROM region)),
  ev AS (SELECT event_id, user_id, coalesce(CAST(nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '') AS INTEGER), 0) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL),
  fr AS (SELECT *, least(38.99::DOUBLE, (6.0::DOUBLE * (n - 1) + k % 4) / 20.0::DOUBLE) AS f FROM ev),
  sam AS (SELECT CAST(user_id AS VARCHAR) AS attempt_id, CASE WHEN user_id % 11 = 7 THEN 'nowhere' ELSE CAST(user_id % 5 AS VARCHAR) END AS route_id, CAST(event_id AS VARCHAR) AS id, event_id,
    1700000000000 + user_id * 10000000 + 1000 * (n - CASE WHEN n % 4 = 1 THEN 1 ELSE 0 END) AS t,
    a.lat + (b.lat - a.lat) * (f - a.i) + CASE WHEN user_id % 6 = 5 AND n > 20 THEN 0.002::DOUBLE ELSE 0.0::DOUBLE END + (event_id % 7 - 3) * 0.00001::DOUBLE AS lat,
    a.lon + (b.lon - a.lon) * (f - a.i) + (event_id % 5 - 2) * 0.00002::DOUBLE AS lon, CASE WHEN k = 99 THEN 60.0::DOUBLE WHEN k <> 98 THEN 3.0::DOUBLE + k % 30 END AS acc
    FROM fr JOIN way a ON a.i = CAST(floor(f) AS INTEGER) JOIN way b ON b.i = a.i + 1)"""
_BENT = f"WITH RECURSIVE {WINDING}, {matched('m', 'sam')}"

_FIX = "lat := lat, lon := lon, acc := acc, speed := speed, p := p, ok := quality = 'accepted'"


def _bound(at: str, place: int) -> str:
    """The fix at one end of the official time: one within half a millisecond, or interpolated if its neighbours are no more than two minutes apart."""
    mix = lambda c: f"l.{c} + w * (r.{c} - l.{c})"
    mixed = f"struct_pack(lat := {mix('lat')}, lon := {mix('lon')}, acc := CASE WHEN l.acc IS NULL THEN r.acc WHEN r.acc IS NULL THEN l.acc ELSE greatest(l.acc, r.acc) END, speed := {mix('speed')}, p := {mix('p')}, ok := l.ok AND r.ok AND {mix('p')} IS NOT NULL)"
    return f"""SELECT attempt_id, {place} AS place, tm AS t, CASE WHEN e IS NOT NULL THEN e ELSE {mixed} END AS f
      FROM (SELECT *, (tm - lt) / (rt - lt) AS w FROM (SELECT el.attempt_id, el.{at} AS tm, arg_min(f, t) FILTER (WHERE abs(t - el.{at}) <= 0.5) AS e,
        arg_max(f, t) FILTER (WHERE t < el.{at}) AS l, max(t) FILTER (WHERE t < el.{at}) AS lt, arg_min(f, t) FILTER (WHERE t > el.{at}) AS r, min(t) FILTER (WHERE t > el.{at}) AS rt
        FROM el JOIN fx USING (attempt_id) GROUP BY ALL)) WHERE e IS NOT NULL OR rt - lt <= 120000"""


# Pairs of fixes; a pair that may be judged by the last four seconds joins the window of close ones before it.
MOVEMENT = f"""
  us0 AS (SELECT *, max(t) OVER (PARTITION BY attempt_id ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_t FROM sam),
  us1 AS (SELECT * EXCLUDE (before_t) FROM us0 WHERE (before_t IS NULL OR t > before_t) AND (acc IS NULL OR acc <= 25)),
  {matched("u", "us1")},
  fx AS (SELECT attempt_id, t, struct_pack({_FIX}) AS f FROM u),
  po AS ({_bound("started", 0)} UNION ALL SELECT fx.attempt_id, 1, CAST(t AS DOUBLE), f FROM fx JOIN el USING (attempt_id) WHERE t > started AND t < finished AND official > 0 UNION ALL {_bound("finished", 2)}),
  pa AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY place, t) AS k FROM (SELECT attempt_id, place, t, f, lead(t) OVER w AS t2, lead(f) OVER w AS g FROM po WINDOW w AS (PARTITION BY attempt_id ORDER BY place, t)) WHERE t2 > t),
  pb AS (SELECT *, t2 - t AS ms, {hav("f.lat", "f.lon", "g.lat", "g.lon")} AS moved, coalesce(g.p - f.p, 0) AS signed, f.p IS NOT NULL AND g.p IS NOT NULL AS known FROM pa),
  dw AS (
    SELECT attempt_id, CAST(0 AS BIGINT) AS k, []::STRUCT(ms DOUBLE, moved DOUBLE, signed DOUBLE, known BOOLEAN, t DOUBLE, lat DOUBLE, lon DOUBLE, p DOUBLE)[] AS win FROM pb WHERE k = 1
    UNION ALL
    SELECT attempt_id, k, CASE WHEN len(w) = 0 THEN w ELSE w[list_min(list_filter(range(1, len(w) + 1), lambda i: i = len(w) OR round(list_sum(list_transform(w[i + 1 :], lambda x: x.ms)), 3) < 4000)) :] END FROM (
      SELECT b.attempt_id, b.k, CASE WHEN ms > 8000 OR moved / (ms / 1000) > 25 THEN w0 ELSE list_append(r.win, struct_pack(ms := ms, moved := moved, signed := signed, known := known, t := t, lat := f.lat, lon := f.lon, p := f.p)) END AS w
      FROM (SELECT *, []::STRUCT(ms DOUBLE, moved DOUBLE, signed DOUBLE, known BOOLEAN, t DOUBLE, lat DOUBLE, lon DOUBLE, p DOUBLE)[] AS w0 FROM dw) r JOIN pb b ON b.attempt_id = r.attempt_id AND b.k = r.k + 1) z),
  dx AS (SELECT b.*, len(win) AS n_in, (t2 - win[1].t) / 1000 AS sec, len(list_filter(win, lambda x: NOT x.known)) = 0 AS have, abs(g.p - win[1].p) AS net_p, list_sum(list_transform(win, lambda x: abs(x.signed))) AS sum_p, list_sum(list_transform(win, lambda x: x.moved)) AS sum_m,
    {hav("win[1].lat", "win[1].lon", "g.lat", "g.lon")} AS net_m, len(list_filter(win, lambda x: x.signed > 0.8)) AS forwards, list_avg(list_filter([f.speed, g.speed], lambda s: s >= 0 AND s <= 25)) AS reported FROM pb b JOIN dw USING (attempt_id, k)),
  dy AS (SELECT *, CASE WHEN have THEN CASE WHEN sum_p < 1e-6 THEN 1 ELSE net_p / sum_p END WHEN sum_m < 1e-6 THEN 1 ELSE least(1.0::DOUBLE, net_m / sum_m) END AS steady, CASE WHEN have THEN net_p ELSE net_m END / sec AS geo FROM dx),
  dz AS (SELECT *, CASE WHEN NOT have AND reported IS NOT NULL AND geo > 0.3 AND geo < 0.55 THEN reported ELSE geo END AS v, ms / 1000 AS s1 FROM dy),
  li AS (SELECT attempt_id, t AS start_ms, t2 AS end_ms, f, g, CASE WHEN ms > 120000 OR moved / s1 > 25 THEN 'unknown'
      WHEN ms > 8000 THEN CASE WHEN coalesce(f.acc, 0) <= 25 AND coalesce(g.acc, 0) <= 25 AND moved <= 15 AND known AND abs(signed) <= 15 AND abs(signed) / s1 < 0.55 THEN 'waiting' ELSE 'unknown' END
      WHEN steady < 0.5 OR v <= 0.3 THEN 'waiting'
      WHEN v >= 0.55 AND CASE WHEN n_in = 1 THEN abs(signed) >= 0.8 AND abs(signed) / s1 >= 0.55 OR moved >= 6 AND moved / s1 >= 0.55 ELSE forwards >= 2 OR net_m >= 6 END THEN 'moving' ELSE 'waiting' END AS label FROM dz),
  ed AS (SELECT el.attempt_id, started, finished, min(po.t) AS t0, max(po.t) AS t1, arg_min(po.f, po.t) AS f0, arg_max(po.f, po.t) AS f1 FROM el LEFT JOIN po USING (attempt_id) WHERE official > 0 GROUP BY ALL),
  iv AS (SELECT *, CAST(row_number() OVER (PARTITION BY attempt_id ORDER BY start_ms, end_ms) AS INTEGER) AS n FROM (SELECT attempt_id, start_ms, end_ms, label, CASE WHEN f.ok THEN f.p END AS p0, CASE WHEN g.ok THEN g.p END AS p1 FROM li
    UNION ALL SELECT attempt_id, started, coalesce(t0, finished), 'unknown', NULL, CASE WHEN f0.ok THEN f0.p END FROM ed WHERE t0 IS NULL OR t0 > started UNION ALL SELECT attempt_id, t1, finished, 'unknown', CASE WHEN f1.ok THEN f1.p END, NULL FROM ed WHERE t1 < finished)),
  mb AS (SELECT el.attempt_id, official, coalesce(sum(end_ms - start_ms) FILTER (WHERE label = 'moving'), 0) AS moving, coalesce(sum(end_ms - start_ms) FILTER (WHERE label = 'waiting'), 0) AS waiting, coalesce(sum(end_ms - start_ms) FILTER (WHERE label = 'unknown'), 0) AS unknown FROM el LEFT JOIN iv USING (attempt_id) GROUP BY ALL),
  mv AS (SELECT *, CASE WHEN official > 0 AND (moving + waiting) / official >= 0.75 THEN CASE WHEN unknown <= 1 THEN 'complete' ELSE 'partial' END ELSE 'unavailable' END AS trust FROM mb)"""
WAITS = f"""
  wi AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY n) AS k, list_filter([p0, p1], lambda x: x IS NOT NULL) AS ps FROM iv WHERE label = 'waiting'),
  wf AS (
    SELECT attempt_id, k, CAST(1 AS BIGINT) AS grp, start_ms AS s, end_ms AS e, end_ms - start_ms AS dur, ps FROM wi WHERE k = 1
    UNION ALL
    SELECT w.attempt_id, w.k, CASE WHEN joins THEN grp ELSE grp + 1 END, CASE WHEN joins THEN s ELSE w.start_ms END, w.end_ms, CASE WHEN joins THEN dur ELSE 0 END + (w.end_ms - w.start_ms), CASE WHEN joins THEN list_concat(pre, w.ps) ELSE w.ps END FROM (
      SELECT w, r.grp, r.s, r.dur, r.ps AS pre, w.start_ms - r.e BETWEEN 0 AND 5000 AND CASE WHEN len(r.ps) = 0 OR len(w.ps) = 0 THEN len(r.ps) = len(w.ps) ELSE abs(list_sum(w.ps) / len(w.ps) - list_sum(r.ps) / len(r.ps)) <= 15 END AS joins
      FROM wf r JOIN wi w ON w.attempt_id = r.attempt_id AND w.k = r.k + 1) z),
  we AS (SELECT attempt_id, route_id, greatest(0.0::DOUBLE, x.s - started) AS start_ms, greatest(greatest(0.0::DOUBLE, x.s - started), x.e - started) AS end_ms, x.dur, CASE WHEN len(x.ps) > 0 THEN list_sum(x.ps) / len(x.ps) END AS p
    FROM (SELECT attempt_id, grp, arg_max(wf, k) AS x FROM wf GROUP BY ALL) JOIN el USING (attempt_id) WHERE x.dur >= 3000)"""
MOVED = f"{BASE}, {MOVEMENT}"
WAITED = f"{MOVED}, {WAITS}"

# Complete linkage, a merge a step: the nearest means first, unions of no more than 40 m, ties by the union's ends and members.
_UNION = "struct_pack(gap := abs(g[i].s / g[i].n - g[j].s / g[j].n), lo := least(g[i].lo, g[j].lo), hi := greatest(g[i].hi, g[j].hi), key := list_sort(list_concat(g[i].key, g[j].key)), i := i, j := j)"
CLUSTERS = f"""
  wm AS (SELECT f.attempt_id, f.target_id, w.side, w.start_ms, w.end_ms, w.dur, w.p FROM fa f JOIN (SELECT attempt_id AS who, 0 AS side, start_ms, end_ms, dur, p FROM we UNION ALL SELECT attempt_id, 1, start_ms, end_ms, dur, p FROM we) w
    ON w.who = CASE WHEN w.side = 0 THEN f.attempt_id ELSE f.target_id END WHERE f.reason IS NULL AND f.target_id IS NOT NULL AND w.p IS NOT NULL),
  wc AS (
    SELECT attempt_id, CAST(0 AS BIGINT) AS step, true AS more, list(struct_pack(lo := p, hi := p, s := p, n := 1, cur := CASE side WHEN 0 THEN dur ELSE 0 END, ref := CASE side WHEN 1 THEN dur ELSE 0 END, key := [struct_pack(side := side, t := start_ms, e := end_ms)]) ORDER BY side, start_ms) AS g FROM wm GROUP BY attempt_id
    UNION ALL
    SELECT attempt_id, step + 1, b IS NOT NULL, CASE WHEN b IS NULL THEN g ELSE list_append(list_transform(list_filter(range(1, len(g) + 1), lambda x: x <> b.i AND x <> b.j), lambda x: g[x]),
        struct_pack(lo := b.lo, hi := b.hi, s := g[b.i].s + g[b.j].s, n := g[b.i].n + g[b.j].n, cur := g[b.i].cur + g[b.j].cur, ref := g[b.i].ref + g[b.j].ref, key := b.key)) END
    FROM (SELECT attempt_id, step, g, list_sort(list_filter(flatten(list_transform(range(1, len(g) + 1), lambda i: list_transform(range(i + 1, len(g) + 1), lambda j: {_UNION}))), lambda u: u.hi - u.lo <= 40))[1] AS b FROM wc WHERE more) z),
  wl AS (SELECT attempt_id, unnest(arg_max(g, step)) AS c FROM wc GROUP BY attempt_id),
  wo AS (SELECT attempt_id, c, c.s / c.n AS p, c.cur - c.ref AS delta, CAST(row_number() OVER (PARTITION BY attempt_id ORDER BY c.s / c.n, c.key) - 1 AS INTEGER) AS cluster, row_number() OVER (PARTITION BY attempt_id, abs(c.cur - c.ref) >= 3000 ORDER BY abs(c.cur - c.ref) DESC, c.s / c.n, c.key) AS nth FROM wl),
  wr AS (SELECT *, abs(delta) >= 3000 AND nth <= 5 AS shown FROM wo)"""
COMPARED = f"{WAITED}, {RANKED}, {FOCUS}, {CLUSTERS}"

# The run's knots, with what lies between them, and every knot asked of the other run.
GHOST = f"""
  ac AS (SELECT attempt_id, unnest(acc).t AS t, unnest(acc).p AS p, unnest(range(1, len(acc) + 1)) AS i FROM el),
  sp AS (SELECT el.attempt_id, coalesce(arg_min(p, i) FILTER (WHERE abs(t - started) <= 0.5), arg_max(p, t) FILTER (WHERE t < started) + (any_value(started) - max(t) FILTER (WHERE t < started)) / (min(t) FILTER (WHERE t > started) - max(t) FILTER (WHERE t < started)) * (arg_min(p, t) FILTER (WHERE t > started) - arg_max(p, t) FILTER (WHERE t < started)),
      arg_min(p, t) FILTER (WHERE t > started), arg_max(p, t) FILTER (WHERE t < started), any_value(start_p)) AS p FROM el LEFT JOIN ac USING (attempt_id) GROUP BY el.attempt_id),
  kn AS (SELECT *, CAST(row_number() OVER (PARTITION BY attempt_id ORDER BY o, i) - 1 AS INTEGER) AS n FROM (SELECT el.attempt_id, 0 AS o, 0 AS i, 'start' AS kind, 0.0::DOUBLE AS e, sp.p, started AS t FROM el JOIN sp USING (attempt_id)
    UNION ALL SELECT ac.attempt_id, 1, i, 'sample', t - started, p, CAST(t AS DOUBLE) FROM ac JOIN el USING (attempt_id) WHERE t > started AND t < finished UNION ALL SELECT attempt_id, 2, 0, 'finish-trigger', official, trigger_p, finished FROM el)),
  kl AS (SELECT attempt_id, n, e AS e0, p AS p0, t AS t0, lead(e) OVER w AS e1, lead(p) OVER w AS p1, lead(t) OVER w AS t1 FROM kn WINDOW w AS (PARTITION BY attempt_id ORDER BY n)),
  lo AS (SELECT k.attempt_id, k.n, bool_and(label <> 'unknown') AS clear, bool_and(label = 'waiting') AS waits FROM kl k JOIN iv ON iv.attempt_id = k.attempt_id AND iv.end_ms > t0 AND iv.start_ms < t1 GROUP BY k.attempt_id, k.n),
  lg AS (SELECT k.*, t1 <= t0 OR coalesce(clear, false) AS good, t1 > t0 AND coalesce(waits, false) AS stall FROM kl k LEFT JOIN lo USING (attempt_id, n) WHERE t1 IS NOT NULL),
  sr AS (SELECT attempt_id, run, min(e0) AS e0, max(e1) AS e1, min(least(p0, p1)) AS lo, max(greatest(p0, p1)) AS hi FROM (SELECT *, sum(CASE WHEN stall THEN 0 ELSE 1 END) OVER (PARTITION BY attempt_id ORDER BY n) AS run FROM lg) WHERE stall GROUP BY ALL),
  pf AS (SELECT el.attempt_id, coalesce((SELECT arg_min({cross("el.finish_p", "p0", "t0", "p1", "t1")}, n) FROM lg WHERE lg.attempt_id = el.attempt_id AND good AND NOT stall AND p0 < el.finish_p AND p1 >= el.finish_p) - started,
      (SELECT arg_min(e, n) FROM kn WHERE kn.attempt_id = el.attempt_id AND abs(p - el.finish_p) <= 0.05)) AS painted FROM el),
  pq AS (SELECT f.attempt_id, x.source, k.n, k.p, k.e, CASE x.source WHEN 'current' THEN f.target_id ELSE f.attempt_id END AS owner, k.attempt_id AS who FROM fa f CROSS JOIN (SELECT unnest(['current', 'reference']) AS source) x
    JOIN kn k ON k.attempt_id = CASE x.source WHEN 'current' THEN f.attempt_id ELSE f.target_id END WHERE f.reason IS NULL AND f.target_id IS NOT NULL AND k.kind = 'sample'),
  ps AS (SELECT pq.*, EXISTS (SELECT 1 FROM sr WHERE sr.attempt_id = who AND pq.e BETWEEN sr.e0 AND sr.e1 AND pq.p + 0.05 >= sr.lo AND pq.p - 0.05 <= sr.hi) AS in_stall FROM pq),
  pc AS (SELECT attempt_id, 'hold' AS kind, e0, e1, lo, hi, lo AS p0, hi AS p1, true AS good FROM sr UNION ALL
    SELECT attempt_id, CASE WHEN abs(p1 - p0) <= 0.05 THEN 'hold' WHEN p1 > p0 THEN 'up' ELSE 'down' END, e0, e1, least(p0, p1), greatest(p0, p1), p0, p1, good FROM lg WHERE NOT stall),
  pj AS (SELECT ps.attempt_id, ps.source, ps.n, ps.p, ps.e, ps.in_stall, c.kind, c.good, c.e0, c.e1, c.e0 + least(1.0::DOUBLE, greatest(0.0::DOUBLE, (ps.p - c.p0) / nullif(c.p1 - c.p0, 0))) * (c.e1 - c.e0) AS tm FROM ps JOIN pc c ON c.attempt_id = ps.owner AND ps.p + 0.05 >= c.lo AND ps.p - 0.05 <= c.hi),
  h1 AS (SELECT *, sum(CASE WHEN good = was THEN 0 ELSE 1 END) OVER (PARTITION BY attempt_id, source, n ORDER BY e0, e1, good ROWS UNBOUNDED PRECEDING) AS same FROM (SELECT *, lag(good) OVER (PARTITION BY attempt_id, source, n ORDER BY e0, e1, good) AS was FROM pj WHERE kind = 'hold')),
  h2 AS (SELECT *, sum(CASE WHEN e0 <= far + 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY attempt_id, source, n ORDER BY e0, e1, good ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, max(e1) OVER (PARTITION BY attempt_id, source, n, same ORDER BY e0, e1, good ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM h1)),
  h3 AS (SELECT attempt_id, source, n, any_value(e) AS e, good, min(e0) AS e0, max(e1) AS e1 FROM h2 GROUP BY attempt_id, source, n, same, island, good),
  h4 AS (SELECT attempt_id, source, n, bool_or(e BETWEEN e0 AND e1) AS inside, bool_or(good AND e BETWEEN e0 AND e1) AS inside_good, min(struct_pack(gap := abs(e - greatest(e0, least(e1, e))), s := e0, tm := greatest(e0, least(e1, e)), good := good)) AS clamp, min(struct_pack(gap := abs(e - e0), s := e0, tm := e0, good := good)) AS arrive FROM h3 GROUP BY ALL),
  h5 AS (SELECT attempt_id, source, n, min(struct_pack(gap := abs(e - tm), tm := tm, good := good)) FILTER (WHERE kind = 'up') AS up, min(struct_pack(gap := abs(e - tm), tm := tm, good := good)) FILTER (WHERE kind = 'down') AS down, min(struct_pack(gap := abs(e - tm), tm := tm, good := good)) AS any_ FROM pj WHERE kind <> 'hold' GROUP BY ALL),
  h6 AS (SELECT ps.*, CASE WHEN inside THEN struct_pack(tm := ps.e, good := inside_good) WHEN in_stall THEN CASE WHEN clamp IS NOT NULL THEN struct_pack(tm := clamp.tm, good := clamp.good) WHEN any_ IS NOT NULL THEN struct_pack(tm := any_.tm, good := any_.good) END
      WHEN up IS NOT NULL THEN struct_pack(tm := up.tm, good := up.good) WHEN arrive IS NOT NULL THEN struct_pack(tm := arrive.tm, good := arrive.good) WHEN down IS NOT NULL THEN struct_pack(tm := down.tm, good := down.good) END AS got FROM ps LEFT JOIN h4 USING (attempt_id, source, n) LEFT JOIN h5 USING (attempt_id, source, n)),
  gk AS (SELECT attempt_id, source, p, CASE source WHEN 'current' THEN e ELSE got.tm END AS current_ms, CASE source WHEN 'current' THEN got.tm ELSE e END AS reference_ms, coalesce(got.good, false) AS good FROM h6
    UNION ALL SELECT f.attempt_id, kn.kind, CASE kn.kind WHEN 'start' THEN kn.p ELSE f.trigger_p END, kn.e, o.e, true FROM fa f JOIN kn ON kn.attempt_id = f.attempt_id JOIN kn o ON o.attempt_id = f.target_id AND o.kind = kn.kind WHERE f.reason IS NULL AND kn.kind <> 'sample')"""
GHOSTS = f"{MOVED}, {RANKED}, {FOCUS}, {GHOST}"

_ELAPSED = "CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') ELSE (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END"
_OUTCOMES = "['active', 'finished', 'cancelled', 'interrupted', 'unknown'][c_custkey % 5 + 1]"
SESSIONS = f"""se AS (SELECT CAST(c_custkey AS VARCHAR) AS id, 1700000000000 + c_custkey * 1000 AS started_at_ms, c_custkey % 7 = 0 AS is_active, CASE WHEN c_custkey % 3 = 0 THEN 'attempt' ELSE 'route_creation' END AS purpose, {_OUTCOMES} AS outcome,
  CASE WHEN c_custkey % 11 = 0 THEN 'saved' ELSE 'pending' END AS disposition, CASE WHEN c_custkey % 4 <> 0 THEN 1700000000000 + c_custkey * 1000 + (c_custkey % 50 - 10) * 60000 END AS stopped_at_ms FROM customer)"""
_LIVES = "['armed', 'active', 'completed', 'cancelled', 'abandoned']"
STORED = f"""sto AS (SELECT CAST(o_orderkey AS VARCHAR) AS attempt_id, CAST(o_custkey % 25 AS VARCHAR) AS route_id, CAST(o_custkey AS VARCHAR) AS session_id, {_LIVES}[o_orderkey % 5 + 1] AS lifecycle, CASE WHEN o_orderkey % 5 = 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'unranked' ELSE 'valid' END ELSE 'pending' END AS validity,
    1700000000000 + o_orderkey * 1000 AS armed_at_ms, o_orderkey % 4 = 1 AS acknowledged FROM orders),
  ck AS (SELECT CAST(l_orderkey AS VARCHAR) AS attempt_id, 'cp' || l_linenumber AS checkpoint_id, CAST(l_linenumber * 50.0 AS DOUBLE) AS progress_m, 1700000000000.0::DOUBLE + l_orderkey * 1000 + (l_linenumber % 3) * 100 AS crossed_at FROM lineitem)"""


def _cases(x: str, names: dict[str, str], other: str = "NULL") -> str:
    """CASE over fixed texts."""
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {other} END"


_REASON_WAIT = """CASE WHEN f.reason IS NOT NULL THEN 'current_not_eligible' WHEN f.target_id IS NULL THEN 'missing_comparison_target' WHEN m0.trust = 'unavailable' THEN 'current_movement_not_displayable' WHEN m1.trust = 'unavailable' THEN 'reference_movement_not_displayable' END"""

ORACLES: dict[str, str] = {
    "q_clean_fixes": f"""WITH {SAMPLES}, raw AS (SELECT attempt_id, id, CASE WHEN event_id % 19 = 0 THEN 0 ELSE t END AS t, CASE WHEN event_id % 13 = 0 THEN 91.0::DOUBLE WHEN event_id % 17 = 0 THEN 'nan'::DOUBLE ELSE lat END AS lat,
        CASE WHEN event_id % 7 = 0 THEN -1.0::DOUBLE ELSE acc END AS acc, CASE WHEN event_id % 5 = 0 THEN 361.0::DOUBLE ELSE 90.0::DOUBLE END AS heading, speed FROM sam)
        SELECT attempt_id, id, t AS recorded_at_ms, {milli("CASE WHEN acc >= 0 THEN acc END")} AS accuracy, {milli("speed")} AS speed, {milli("CASE WHEN heading BETWEEN 0 AND 360 THEN heading END")} AS heading FROM raw WHERE t > 0 AND NOT isnan(lat) AND abs(lat) <= 90""",
    "q_session_last_fix": f"WITH {SAMPLES}, {SESSIONS} SELECT id, started_at_ms, (SELECT max(t) FROM sam WHERE sam.attempt_id = se.id) AS last_sample_at_ms FROM se",
    "q_active_topk": f"""WITH {SESSIONS} (SELECT 'active' AS kind, id, started_at_ms FROM se WHERE is_active ORDER BY started_at_ms DESC LIMIT 1) UNION ALL (SELECT 'latest', id, started_at_ms FROM se ORDER BY started_at_ms DESC LIMIT 1)
        UNION ALL (SELECT 'pending', id, started_at_ms FROM se WHERE purpose = 'route_creation' AND outcome IN ('finished', 'interrupted') AND disposition = 'pending' ORDER BY started_at_ms DESC LIMIT 1) UNION ALL SELECT 'of_id', id, started_at_ms FROM se WHERE id = '3'""",
    "q_session_state": f"""WITH {SAMPLES}, {SESSIONS}, la AS (SELECT se.*, (SELECT max(t) FROM sam WHERE sam.attempt_id = se.id) AS last_t, (SELECT count(*) FROM sam WHERE sam.attempt_id = se.id) AS points FROM se)
        SELECT id, CASE WHEN outcome = 'interrupted' THEN 'interrupted' WHEN is_active AND outcome = 'active' THEN 'tracking' ELSE 'idle' END AS status, CASE outcome WHEN 'finished' THEN CASE WHEN stopped_at_ms IS NOT NULL THEN greatest(0, stopped_at_ms - started_at_ms) END WHEN 'interrupted' THEN CASE WHEN last_t IS NOT NULL THEN greatest(0, last_t - started_at_ms) END END AS review_ms, points,
        CASE WHEN last_t IS NULL THEN 'waiting_for_first_fix' WHEN 1700000500000 - last_t >= 120000 THEN 'stale' ELSE 'healthy' END AS health, greatest(0, 1700000500000 - started_at_ms) AS elapsed_ms FROM la""",
    "q_session_samples": f"WITH {SAMPLES} SELECT id, t AS recorded_at_ms, {milli('lat')} AS latitude FROM sam WHERE attempt_id = '3'",
    "q_sample_lines": f"""WITH {SAMPLES} SELECT id, strftime(make_timestamp(t * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(t % 1000 AS VARCHAR), 3, '0') || 'Z  ' || {fixed('lat', 6)} || ', ' || {fixed('lon', 6)} || '  ' || coalesce('±' || {fixed('acc', 1)} || 'm', 'acc n/a') || '  '
        || coalesce({fixed('speed', 1)} || 'm/s', 'spd n/a') || '  ' || coalesce(CAST(CAST(floor(heading + 0.5) AS BIGINT) AS VARCHAR) || '°', 'hdg n/a') AS line FROM sam""",
    "q_path_length": f"WITH RECURSIVE {SEGMENTS} SELECT route_id, {milli('finish_p')} AS length_mm FROM co",
    "q_project_nearest": f"""WITH RECURSIVE {SAMPLES}, {SEGMENTS}, q AS (SELECT attempt_id || ':' || id AS id, lat, lon + (event_id % 7) * 0.0001::DOUBLE AS lon FROM sam), a AS (SELECT * FROM {projected("q", "lat", "lon")}), b AS (SELECT *, min(d) OVER (PARTITION BY id) AS least_d FROM a)
        SELECT id, {milli("min(p)")} AS progress_mm, {milli("arg_min(d, p)")} AS snap_mm FROM b WHERE d <= least_d + 0.5 GROUP BY id""",
    "q_snap_taps": f"""WITH RECURSIVE {SAMPLES}, {SEGMENTS}, q AS (SELECT attempt_id || ':' || id AS id, lat, lon + (event_id % 7) * 0.0001::DOUBLE AS lon FROM sam), a AS (SELECT * FROM {projected("q", "lat", "lon")}), b AS (SELECT *, min(d) OVER (PARTITION BY id) AS least_d FROM a), c AS (SELECT id, min(p) AS p, arg_min(d, p) AS d FROM b WHERE d <= least_d + 0.5 GROUP BY id)
        SELECT id, {milli("p")} AS progress_mm FROM c WHERE d <= 30""",
    "q_points_at": f"""WITH RECURSIVE {SEGMENTS}, k AS (SELECT CAST(range AS INTEGER) AS id FROM range(-20, 341, 15)) SELECT route_id, id, CAST(floor({place_at("id")} * 1e7::DOUBLE + 0.5) AS BIGINT) AS lat_e7 FROM co, k""",
    "q_checkpoint_points": f"""WITH RECURSIVE {SEGMENTS} SELECT route_id, CAST(i AS INTEGER) AS place, 'cp' || i AS checkpoint_id, 'Checkpoint ' || i AS name, CAST(floor({place_at("100.0::DOUBLE * i")} * 1e7::DOUBLE + 0.5) AS BIGINT) AS lat_e7 FROM co, range(1, 3) x(i)""",
    "q_bounds": f"""WITH RECURSIVE {SEGMENTS}, r AS (SELECT 30 / {D} AS n, lat, lon FROM pt WHERE i IN (0, 15)), z AS (SELECT lat + n AS lat, lon FROM r UNION ALL SELECT lat - n, lon FROM r UNION ALL SELECT lat, lon + n / cos(radians(lat)) FROM r UNION ALL SELECT lat, lon - n / cos(radians(lat)) FROM r UNION ALL SELECT lat, lon FROM pt),
        b AS (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM z) SELECT route_id, CAST(floor((s - greatest((n - s) * 0.15, 0.001)) * 1e7::DOUBLE + 0.5) AS BIGINT) AS south, CAST(floor((n + greatest((n - s) * 0.15, 0.001)) * 1e7::DOUBLE + 0.5) AS BIGINT) AS north,
        CAST(floor((w - greatest((e - w) * 0.15, 0.001)) * 1e7::DOUBLE + 0.5) AS BIGINT) AS west, CAST(floor((e + greatest((e - w) * 0.15, 0.001)) * 1e7::DOUBLE + 0.5) AS BIGINT) AS east FROM co, b""",
    "q_preview": f"""WITH RECURSIVE {SEGMENTS}, r AS (SELECT i, 30 / {D} AS n, lat, lon FROM pt WHERE i IN (0, 15)), z AS (SELECT 'path' AS kind, lat, lon FROM pt UNION ALL SELECT CASE i WHEN 0 THEN 'start' ELSE 'finish' END, lat, lon FROM r UNION ALL SELECT CASE i WHEN 0 THEN 'start' ELSE 'finish' END || '-extent', lat + a * n, lon + b * n / cos(radians(lat)) FROM r, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(a, b)
        UNION ALL SELECT 'checkpoint', {place_at("100.0::DOUBLE * k")}, 34.78::DOUBLE FROM range(1, 3) x(k)), b AS (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM z)
        SELECT route_id, kind, {milli("(lon - w) / greatest(e - w, 0.0001) * 100")} AS x_milli, {milli("(1 - (lat - s) / greatest(n - s, 0.0001)) * 100")} AS y_milli, {milli(f"CASE WHEN kind IN ('start', 'finish') THEN greatest(4.0::DOUBLE, least(80.0::DOUBLE, 60 / {D} / greatest(n - s, 0.0001) * 100)) END")} AS diameter_milli FROM co, z, b""",
    "q_winding_project": f"""WITH RECURSIVE {WINDING}, q AS (SELECT attempt_id || ':' || id AS id, sam.lat, sam.lon FROM sam JOIN co USING (route_id)), a AS (SELECT * FROM {projected("q", "lat", "lon")}), b AS (SELECT *, min(d) OVER (PARTITION BY id) AS least_d FROM a),
        c AS (SELECT id, min(struct_pack(p := p, d := d, lat := alat + (blat - alat) * {D} * share / {D}, lon := alon + (blon - alon) * ({D} * cos(radians(alat))) * share / ({D} * cos(radians(alat))))) AS x FROM b WHERE d <= least_d + 0.5 GROUP BY id)
        SELECT id, {milli("x.p")} AS progress_mm, {milli("x.d")} AS snap_mm, CAST(floor(x.lat * 1e7::DOUBLE + 0.5) AS BIGINT) AS lat_e7, CAST(floor(x.lon * 1e7::DOUBLE + 0.5) AS BIGINT) AS lon_e7 FROM c""",
    "q_winding_match": f"{_BENT} SELECT attempt_id, CAST(seq AS INTEGER) AS seq, quality, {milli('p')} AS progress_mm, {milli('d')} AS snap_mm, advancing FROM m",
    "q_winding_status": f"""{_BENT}, {TIMING} SELECT attempt_id, route_id, reason IS NULL AS eligible, reason, {milli('CASE WHEN reason IS NULL THEN started END')} AS started_us, {milli('CASE WHEN reason IS NULL THEN finished END')} AS finished_us FROM sx
        UNION ALL SELECT 'bare' || n_nationkey, CAST(n_nationkey % 5 AS VARCHAR), false, 'missing_telemetry', NULL, NULL FROM nation""",
    "q_match": f"{BASE} SELECT attempt_id, CAST(seq AS INTEGER) AS seq, quality, {milli('p')} AS progress_mm, {milli('d')} AS snap_mm, advancing FROM m",
    "q_attempt_status": f"{BASE} SELECT attempt_id, route_id, replayed, validity, reason IS NULL AS eligible, reason, {milli('CASE WHEN reason IS NULL THEN started END')} AS started_us, {milli('CASE WHEN reason IS NULL THEN finished END')} AS finished_us FROM sx",
    "q_replay": f"{BASE} SELECT attempt_id, replayed AS lifecycle, validity, {milli('started')} AS started_us, {milli('finished')} AS finished_us FROM rn",
    "q_live": f"""{BASE}, {CROSSED} SELECT 'attempt' AS kind, attempt_id, replayed AS a, validity AS b, {milli('started')} AS first_us, {milli('finished')} AS last_us FROM rn
        UNION ALL SELECT 'session', attempt_id, CASE replayed WHEN 'completed' THEN 'finished' WHEN 'abandoned' THEN 'interrupted' ELSE 'active' END, CASE replayed WHEN 'completed' THEN 'saved' WHEN 'abandoned' THEN 'discarded' ELSE 'pending' END,
          CASE WHEN replayed IN ('completed', 'abandoned') THEN 1 END, CASE WHEN replayed IN ('completed', 'abandoned') THEN NULL ELSE 0 END FROM rn
        UNION ALL SELECT 'crossing', attempt_id, checkpoint_id, attempt_id || ':' || checkpoint_id, {milli('crossed')}, NULL FROM cr""",
    "q_start_zone": f"""{BASE}, la AS (SELECT attempt_id, max(seq) AS seq FROM m GROUP BY attempt_id), lb AS (SELECT i.attempt_id, i.acc, i.start_p, i.cand, rn.acc[-1].p AS c FROM la JOIN m_i i USING (attempt_id, seq) JOIN rn USING (attempt_id)),
        lc AS (SELECT *, list_sort(list_transform(list_filter(cand, lambda x: x.s1 >= coalesce(c - 25, start_p - 50) AND x.s0 <= coalesce(c + 90, start_p + 70)), lambda x: struct_pack(cost := x.d + 0.3::DOUBLE * abs(x.p - coalesce(c, start_p)) + CASE WHEN x.p < coalesce(c, start_p) THEN 8 ELSE 0 END, np := -x.p, p := x.p, d := x.d)))[1] AS b FROM lb)
        SELECT attempt_id, CASE WHEN acc > 45 THEN 'locating' WHEN b.d <= 35 AND abs(b.p - start_p) <= 30 THEN 'inside' ELSE 'outside' END AS status FROM lc""",
    "q_crossings": f"{BASE}, {CROSSED} SELECT attempt_id, checkpoint_id, {milli('crossed')} AS crossed_us FROM cr",
    "q_rank_pb": f"{BASE}, {RANKED} SELECT route_id, attempt_id, {milli('official')} AS official_us, CAST(rank AS INTEGER) AS rank, is_pb, target_id, {milli('delta_pb')} AS delta_pb_us, {milli('official - previous')} AS delta_previous_us, pb.i AS pb_before_id FROM rt",
    "q_focus": f"{BASE}, {RANKED}, {FOCUS} SELECT f.attempt_id, f.reason, CAST(rt.rank AS INTEGER) AS rank, f.is_pb, f.previous_id, {milli('f.delta_previous')} AS delta_previous_us, {milli('f.pb_before')} AS pb_before_us, f.target_id, {milli('f.delta_pb')} AS delta_pb_us FROM fa f LEFT JOIN rt USING (attempt_id)",
    "q_focus_named": """WITH k AS (SELECT CAST(o_orderkey AS BIGINT) AS k, o_custkey FROM orders),
        a AS (SELECT ['e', 'E', 'é', 'É', 'z', 'Z', 'a', 'ä'][1 + k % 8] || '-' || CAST(k // 8 AS VARCHAR) AS attempt_id, CAST(o_custkey % 5 AS VARCHAR) AS route_id, k % 3 * 1000 AS armed, k % 6 <> 5 AS eligible, k % 4 * 1000 + 60000 AS official FROM k),
        r AS (SELECT *, CASE WHEN eligible THEN row_number() OVER (PARTITION BY route_id, eligible ORDER BY official, armed, attempt_id COLLATE en, attempt_id) END AS rank,
          row_number() OVER (PARTITION BY route_id ORDER BY CASE WHEN eligible THEN armed + 500 + official ELSE armed END, armed, attempt_id COLLATE en, attempt_id) AS place FROM a),
        w AS (SELECT *, min(rank) OVER before AS pb_rank, max(CASE WHEN eligible THEN place END) OVER before AS previous FROM r
          WINDOW before AS (PARTITION BY route_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT w.route_id, w.attempt_id, CAST(w.rank AS INTEGER) AS rank, coalesce(w.rank = 1, false) AS is_pb, p.attempt_id AS previous_id, b.attempt_id AS pb_before_id,
          CASE WHEN w.rank = 1 THEN b.attempt_id ELSE g.attempt_id END AS target_id
        FROM w LEFT JOIN r p ON p.route_id = w.route_id AND p.place = w.previous LEFT JOIN r b ON b.route_id = w.route_id AND b.rank = w.pb_rank LEFT JOIN r g ON g.route_id = w.route_id AND g.rank = 1""",
    "q_focus_segments": f"""{BASE}, {RANKED}, {FOCUS}, {CROSSED}, {SEGMENT_TIMES}, gd AS (SELECT route_id, seg, min(duration) AS gold FROM sd GROUP BY ALL), sp0 AS (SELECT route_id, CAST(row_number() OVER w AS INTEGER) AS seg, mark || '->' || lead(mark) OVER w AS segment_id, lead(mark) OVER w AS nm FROM (SELECT route_id, 0 AS o, 'start' AS mark FROM co UNION ALL SELECT route_id, cp_order, checkpoint_id FROM co, cp WHERE mark > start_p AND mark < finish_p UNION ALL SELECT route_id, 99, 'finish' FROM co) WINDOW w AS (PARTITION BY route_id ORDER BY o))
        SELECT f.attempt_id, s.seg, s.segment_id, {milli("a.duration")} AS duration_us, {milli("b.duration")} AS target_us, {milli("a.duration - b.duration")} AS delta_us, {milli("gold")} AS gold_us FROM fa f JOIN sp0 s ON s.route_id = f.route_id AND s.nm IS NOT NULL LEFT JOIN sd a ON a.attempt_id = f.attempt_id AND a.seg = s.seg LEFT JOIN sd b ON b.attempt_id = f.target_id AND b.seg = s.seg LEFT JOIN gd ON gd.route_id = f.route_id AND gd.seg = s.seg""",
    "q_route_summary": f"""{BASE}, {CROSSED}, {SEGMENT_TIMES}, go AS (SELECT route_id, seg, min(duration) AS gold FROM sd GROUP BY ALL), sb AS (SELECT route_id, CASE WHEN count(gold) = count(*) THEN list_reduce(list(gold ORDER BY seg), lambda a, x: a + x) END AS best FROM go GROUP BY route_id),
        e2 AS (SELECT route_id, count(*) AS ranked, min(struct_pack(o := official, s := started, a := armed, i := attempt_id)) AS b, max(struct_pack(f := finished, a := armed, i := attempt_id)) AS l FROM el GROUP BY route_id)
        SELECT co.route_id, coalesce(ranked, 0) AS ranked, b.i AS pb_id, {milli("b.o")} AS pb_us, l.i AS last_id, {milli("best")} AS sum_of_best_us FROM co LEFT JOIN e2 USING (route_id) LEFT JOIN sb USING (route_id)""",
    "q_segments": f"{BASE}, {CROSSED}, {SEGMENT_TIMES} SELECT attempt_id, seg, segment_id, {milli('duration')} AS duration_us FROM sd",
    "q_segment_deltas": f"""{BASE}, {RANKED}, {CROSSED}, {SEGMENT_TIMES}, gd AS (SELECT *, min(duration) OVER (PARTITION BY sd.route_id, seg) AS gold, min(duration) OVER (PARTITION BY sd.route_id, seg ORDER BY finished, armed, sd.attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, rt.target_id AS tid FROM sd JOIN rt ON rt.attempt_id = sd.attempt_id)
        SELECT gd.attempt_id, gd.seg, {milli("gd.duration - o.duration")} AS delta_us, coalesce(gd.duration = gold AND (before IS NULL OR gd.duration < before), false) AS is_new_gold FROM gd LEFT JOIN sd o ON o.attempt_id = gd.tid AND o.seg = gd.seg""",
    "q_history": f"""{BASE}, {RANKED} SELECT sx.route_id, sx.attempt_id, CAST(row_number() OVER (PARTITION BY sx.route_id ORDER BY CASE WHEN reason IS NULL THEN sx.finished ELSE sx.armed END DESC, sx.armed DESC, sx.attempt_id DESC) AS INTEGER) AS place, CAST(rank AS INTEGER) AS rank, coalesce(is_pb, false) AS is_pb, reason IS NULL AS eligible, reason,
        CASE WHEN reason IS NOT NULL THEN 'Unavailable' ELSE (SELECT {_ELAPSED} FROM (SELECT CAST(floor((sx.finished - sx.started) / 1000) AS BIGINT) AS s)) || ' · ' || CASE WHEN is_pb THEN 'PB' ELSE rank || CASE WHEN rank % 100 BETWEEN 11 AND 13 THEN 'th' WHEN rank % 10 = 1 THEN 'st' WHEN rank % 10 = 2 THEN 'nd' WHEN rank % 10 = 3 THEN 'rd' ELSE 'th' END END END AS meta
        FROM sx LEFT JOIN (SELECT attempt_id, rank, is_pb FROM rt) r ON r.attempt_id = sx.attempt_id""",
    "q_move_intervals": f"{MOVED} SELECT attempt_id, n, label, {milli('end_ms - start_ms')} AS duration_us FROM iv",
    "q_move_breakdown": f"{MOVED} SELECT attempt_id, {milli('official')} AS official_us, {milli('moving')} AS moving_us, {milli('waiting')} AS waiting_us, {milli('unknown')} AS unknown_us, trust, abs(moving + waiting + unknown - official) <= 1 AS reconciles, trust <> 'unavailable' AS displayable, CAST(floor(waiting / official * 100 + 0.5) AS BIGINT) || '%' AS waiting_share FROM mv",
    "q_wait_events": f"{WAITED} SELECT attempt_id, {milli('start_ms')} AS start_us, {milli('end_ms')} AS end_us, {milli('dur')} AS duration_us, {milli('p')} AS progress_mm, p IS NOT NULL AS located, CAST(floor({place_at('p')} * 1e7::DOUBLE + 0.5) AS BIGINT) AS lat_e7 FROM we",
    "q_nearest_wait": f"""{WAITED}, wp AS (SELECT *, {place_at("p")} AS lat FROM we WHERE p IS NOT NULL), tp AS (SELECT attempt_id, avg(lat) AS lat FROM wp GROUP BY attempt_id), dd AS (SELECT wp.*, {hav("wp.lat", "34.78::DOUBLE", "tp.lat", "34.78::DOUBLE")} AS m FROM wp JOIN tp USING (attempt_id))
        SELECT attempt_id, {milli("(min(struct_pack(m := m, s := start_ms))).s")} AS start_us, {milli("min(m)")} AS mm FROM dd WHERE m <= 40 GROUP BY attempt_id""",
    "q_wait_clusters": f"""{COMPARED} SELECT attempt_id, cluster, {milli("p")} AS progress_mm, {milli("c.cur")} AS current_us, {milli("c.ref")} AS reference_us, {milli("delta")} AS delta_us, {milli("c.hi - c.lo")} AS span_mm, CAST(c.n AS INTEGER) AS members, shown, CASE WHEN c.cur > 0 AND c.ref > 0 THEN 'matched' WHEN c.cur > 0 THEN 'current-only' ELSE 'reference-only' END AS match_state,
        CAST(floor({place_at("p")} * 1e7::DOUBLE + 0.5) AS BIGINT) AS lat_e7 FROM wr""",
    "q_nearest_location": f"""{COMPARED}, wp AS (SELECT attempt_id, cluster, {place_at("p")} AS lat FROM wr), tp AS (SELECT attempt_id, avg(lat) AS lat FROM wp GROUP BY attempt_id), dd AS (SELECT wp.*, {hav("wp.lat", "34.78::DOUBLE", "tp.lat", "34.78::DOUBLE")} AS m FROM wp JOIN tp USING (attempt_id))
        SELECT attempt_id, (min(struct_pack(m := m, c := cluster))).c AS cluster, {milli("min(m)")} AS mm FROM dd WHERE m <= 40 GROUP BY attempt_id""",
    "q_wait_comparison": f"""{COMPARED}, ws AS (SELECT attempt_id, sum(dur) AS events, coalesce(sum(dur) FILTER (WHERE p IS NULL), 0) AS nowhere FROM we GROUP BY attempt_id), wg AS (SELECT attempt_id, sum(c.cur) AS cur, sum(c.ref) AS ref, coalesce(sum(delta) FILTER (WHERE shown), 0) AS shown, coalesce(sum(delta) FILTER (WHERE NOT shown), 0) AS hidden FROM wr GROUP BY attempt_id),
        wv AS (SELECT f.attempt_id, f.target_id, {_REASON_WAIT} AS reason, coalesce(m0.waiting, 0) AS w0, coalesce(m1.waiting, 0) AS w1, coalesce(s0.events, 0) AS e0, coalesce(s1.events, 0) AS e1, coalesce(s0.nowhere, 0) AS n0, coalesce(s1.nowhere, 0) AS n1, g.* EXCLUDE (attempt_id) FROM fa f LEFT JOIN mv m0 ON m0.attempt_id = f.attempt_id LEFT JOIN mv m1 ON m1.attempt_id = f.target_id LEFT JOIN ws s0 ON s0.attempt_id = f.attempt_id LEFT JOIN ws s1 ON s1.attempt_id = f.target_id LEFT JOIN wg g ON g.attempt_id = f.attempt_id)
        SELECT attempt_id, target_id, reason, {_cases("reason", UNAVAILABLE_WAITING)} AS says, {milli("w0")} AS waiting_us, {milli("w1")} AS reference_us, {milli("CASE WHEN reason IS NULL THEN w0 - w1 ELSE 0 END")} AS delta_us, {milli("CASE WHEN reason IS NULL THEN coalesce(cur, 0) ELSE 0 END")} AS placed_us, {milli("CASE WHEN reason IS NULL THEN coalesce(ref, 0) ELSE 0 END")} AS reference_placed_us,
        {milli("CASE WHEN reason IS NULL THEN n0 ELSE 0 END")} AS unlocated_us, {milli("CASE WHEN reason IS NULL THEN n1 ELSE 0 END")} AS reference_unlocated_us, {milli("CASE WHEN reason IS NULL THEN greatest(0, w0 - e0) ELSE 0 END")} AS short_us, {milli("CASE WHEN reason IS NULL THEN greatest(0, w1 - e1) ELSE 0 END")} AS reference_short_us,
        {milli("CASE WHEN reason IS NULL THEN coalesce(shown, 0) ELSE 0 END")} AS shown_delta_us, {milli("CASE WHEN reason IS NULL THEN coalesce(hidden, 0) ELSE 0 END")} AS hidden_delta_us FROM wv""",
    "q_ghost_knots": f"{GHOSTS} SELECT attempt_id, n, kind, {milli('e')} AS elapsed_us, {milli('p')} AS progress_mm FROM kn",
    "q_ghost_legs": f"{GHOSTS} SELECT attempt_id, n, good, stall FROM lg",
    "q_stall_runs": f"{GHOSTS} SELECT attempt_id, {milli('e0')} AS start_us, {milli('e1')} AS end_us, {milli('lo')} AS low_mm, {milli('hi')} AS high_mm FROM sr",
    "q_painted_finish": f"{GHOSTS} SELECT attempt_id, {milli('painted')} AS painted_us FROM pf",
    "q_ghost_delta": f"{GHOSTS} SELECT DISTINCT attempt_id, source, {milli('p')} AS progress_mm, {milli('current_ms')} AS current_us, {milli('reference_ms')} AS reference_us, {milli('CASE WHEN good THEN current_ms - reference_ms END')} AS delta_us, good AND current_ms IS NOT NULL AND reference_ms IS NOT NULL AS good FROM gk",
    "q_ghost_near": f"{GHOSTS} SELECT DISTINCT attempt_id, source, {milli('p')} AS progress_mm, {milli('current_ms')} AS current_us, {milli('reference_ms')} AS reference_us FROM gk WHERE abs(p - 150) <= 5",
    "q_ghost_order": f"""{GHOSTS}, go AS (SELECT attempt_id, source, min(p) AS p, current_ms, reference_ms, ok FROM (SELECT *, good AND current_ms IS NOT NULL AND reference_ms IS NOT NULL AS ok FROM gk) GROUP BY attempt_id, source, round(p, 3), current_ms, reference_ms, ok)
        SELECT attempt_id, CAST(row_number() OVER (PARTITION BY attempt_id ORDER BY coalesce(current_ms, 9007199254740991), p, coalesce(reference_ms, 9007199254740991), source) AS INTEGER) AS place, source, {milli("p")} AS progress_mm, {milli("current_ms")} AS current_us, CAST(floor({place_at("p")} * 1e7::DOUBLE + 0.5) AS BIGINT) AS lat_e7 FROM go""",
    "q_course_geojson": f"""{WAITED}, {RANKED}, ge AS (SELECT route_id, n, kind, type, points, lat FROM co, (VALUES (1, 'path', 'LineString', 16, 0), (2, 'start-zone', 'Polygon', 33, 0), (3, 'start', 'Point', 1, 0), (4, 'finish-zone', 'Polygon', 33, 15), (5, 'finish', 'Point', 1, 15)) v(n, kind, type, points, i) JOIN pt ON pt.i = v.i
          UNION ALL SELECT route_id, 5 + k, 'checkpoint', 'Point', 1, {place_at("100.0::DOUBLE * k")} FROM co, range(1, 3) x(k) UNION ALL SELECT we.route_id, 0, 'wait', 'Point', 1, {place_at("we.p")} FROM we JOIN rt USING (attempt_id) WHERE rt.is_pb AND we.p IS NOT NULL)
        SELECT route_id, CAST(n AS INTEGER) AS n, kind, type, points, CAST(floor(lat * 1e7::DOUBLE + 0.5) AS BIGINT) AS lat_e7 FROM ge""",
    "q_ghost_reasons": f"""{GHOSTS}, gr AS (SELECT f.attempt_id, f.target_id, f.official, CASE WHEN f.reason IS NOT NULL THEN 'current_not_eligible' WHEN f.target_id IS NULL THEN 'missing_comparison_target' END AS why, o.official AS theirs FROM fa f LEFT JOIN el o ON o.attempt_id = f.target_id)
        SELECT g.attempt_id, target_id, why AS reason, {_cases("why", UNAVAILABLE_GHOST)} AS says, {milli("CASE WHEN why IS NULL THEN official - theirs END")} AS trigger_delta_us, {milli("p0.painted")} AS painted_us, {milli("CASE WHEN why IS NULL THEN p1.painted END")} AS reference_painted_us FROM gr g LEFT JOIN pf p0 ON p0.attempt_id = g.attempt_id LEFT JOIN pf p1 ON p1.attempt_id = g.target_id""",
    "q_report": f"""{COMPARED}, {CROSSED}, {SEGMENT_TIMES}, gd AS (SELECT sd.attempt_id, duration = min(duration) OVER (PARTITION BY sd.route_id, seg) AS best, duration < coalesce(min(duration) OVER (PARTITION BY sd.route_id, seg ORDER BY finished, armed, sd.attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e18) AS better FROM sd JOIN el USING (attempt_id)),
        rp AS (SELECT f.attempt_id, CAST(rt.rank AS INTEGER) AS rank, 3 AS segments, CAST((SELECT count(*) FROM gd WHERE gd.attempt_id = f.attempt_id AND best AND better) AS INTEGER) AS golds, CAST((SELECT count(*) FROM we WHERE we.attempt_id = f.attempt_id) AS INTEGER) AS waits, CAST((SELECT count(*) FROM wr WHERE wr.attempt_id = f.attempt_id) AS INTEGER) AS places, {_REASON_WAIT} AS waiting_reason,
        CASE WHEN f.reason IS NOT NULL THEN 'current_not_eligible' WHEN f.target_id IS NULL THEN 'missing_comparison_target' END AS ghost_reason, CASE WHEN f.delta_pb < 0 THEN 'faster' WHEN f.delta_pb > 0 THEN 'slower' ELSE 'neutral' END AS tone FROM fa f LEFT JOIN rt USING (attempt_id) LEFT JOIN mv m0 ON m0.attempt_id = f.attempt_id LEFT JOIN mv m1 ON m1.attempt_id = f.target_id)
        SELECT *, CASE waits WHEN 1 THEN '1 stop' ELSE waits || ' stops' END AS stops FROM rp""",
    "q_session_changes": f"""WITH {SESSIONS}, k AS (SELECT *, CAST(id AS BIGINT) AS n FROM se) SELECT 'refused' AS kind, id, is_active, purpose, outcome AS capture_outcome, disposition AS review_disposition, stopped_at_ms FROM k
        UNION ALL SELECT 'started', id, false, purpose, outcome, disposition, stopped_at_ms FROM k UNION ALL SELECT 'started', '0', true, 'attempt', 'active', 'pending', NULL
        UNION ALL SELECT 'ended', id, is_active AND n % 14 <> 0, purpose, CASE n % 14 WHEN 0 THEN 'finished' ELSE outcome END, CASE n % 14 WHEN 0 THEN 'saved' ELSE disposition END, CASE n % 14 WHEN 0 THEN 5 ELSE stopped_at_ms END FROM k
        UNION ALL SELECT 'decided', id, is_active, purpose, outcome, CASE n % 6 WHEN 1 THEN 'discarded' ELSE disposition END, stopped_at_ms FROM k
        UNION ALL SELECT 'upgraded', id, false, CASE WHEN is_active THEN 'legacy' ELSE purpose END, CASE WHEN is_active THEN 'unknown' ELSE outcome END, CASE WHEN is_active THEN 'discarded' ELSE disposition END, CASE WHEN is_active THEN coalesce(stopped_at_ms, 7) ELSE stopped_at_ms END FROM k""",
    "q_route_geometry": f"""WITH RECURSIVE {SAMPLES}, gs AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY t, id) AS i FROM sam WHERE acc IS NULL OR acc <= 25), gm AS (SELECT *, CASE WHEN speed IS NOT NULL THEN speed >= 0.8 ELSE coalesce({hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} >= 6, false) END AS mov FROM gs WINDOW w AS (PARTITION BY attempt_id ORDER BY i)),
        gb AS (SELECT attempt_id, min(i) AS a, max(i) + 2 AS b FROM (SELECT *, mov AND lead(mov, 1) OVER w AND lead(mov, 2) OVER w AS run FROM gm WINDOW w AS (PARTITION BY attempt_id ORDER BY i)) WHERE run GROUP BY attempt_id),
        gt AS (SELECT gm.*, i - a AS k FROM gm JOIN gb USING (attempt_id) WHERE i BETWEEN a AND b), gf AS (SELECT attempt_id, k, lat, lon, true AS kept, 0.0::DOUBLE AS far, 1 AS pts FROM gt WHERE k = 0 UNION ALL
          SELECT attempt_id, k, CASE WHEN keep THEN lat ELSE blat END, CASE WHEN keep THEN lon ELSE blon END, keep, far + CASE WHEN keep THEN d ELSE 0 END, pts + CASE WHEN keep THEN 1 ELSE 0 END FROM (SELECT *, (speed IS NULL OR speed >= 0.8) AND d >= 6 AS keep FROM (SELECT t.attempt_id, t.k, t.lat, t.lon, t.speed, r.lat AS blat, r.lon AS blon, r.far, r.pts, {hav("r.lat", "r.lon", "t.lat", "t.lon")} AS d FROM gf r JOIN gt t ON t.attempt_id = r.attempt_id AND t.k = r.k + 1)) z),
        ge AS (SELECT attempt_id, arg_max(far, k) AS far, arg_max(pts, k) AS pts FROM gf GROUP BY attempt_id), gx AS (SELECT attempt_id, arg_min(lat, k) AS alat, arg_min(lon, k) AS alon, arg_max(lat, k) AS blat, arg_max(lon, k) AS blon, max(k) AS n FROM gt GROUP BY attempt_id),
        gy AS (SELECT s.attempt_id, CASE WHEN coalesce(q.n_good, 0) < 3 OR gx.n IS NULL OR gx.n = 0 THEN 'too_little_movement' WHEN {hav("alat", "alon", "blat", "blon")} < 10 THEN 'start_and_finish_too_close' WHEN pts < 3 THEN 'too_little_movement' END AS reason, pts, far, alat, blat FROM (SELECT DISTINCT attempt_id FROM sam) s LEFT JOIN (SELECT attempt_id, count(*) AS n_good FROM gs GROUP BY 1) q USING (attempt_id) LEFT JOIN gx USING (attempt_id) LEFT JOIN ge USING (attempt_id))
        SELECT attempt_id AS session_id, reason IS NULL AS saveable, reason, CASE WHEN reason IS NULL THEN CAST(pts AS INTEGER) END AS points, {milli("CASE WHEN reason IS NULL THEN far END")} AS distance_mm, CAST(floor(CASE WHEN reason IS NULL THEN alat END * 1e7::DOUBLE + 0.5) AS BIGINT) AS start_e7, CAST(floor(CASE WHEN reason IS NULL THEN blat END * 1e7::DOUBLE + 0.5) AS BIGINT) AS finish_e7 FROM gy""",
    "q_layouts": f"""WITH x AS (SELECT CAST(c_custkey AS VARCHAR) AS route_id, 5.0::DOUBLE * (c_custkey % 25) + 0.0625 AS start_p, 100.0::DOUBLE + 7 * (c_custkey % 25) + (c_custkey % 1000) / 1e4::DOUBLE AS finish_p, CASE c_custkey % 6 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 'nan'::DOUBLE ELSE 30.0::DOUBLE END AS start_r, CASE c_custkey % 7 WHEN 3 THEN 251.0::DOUBLE ELSE 20.0::DOUBLE END AS finish_r,
          [struct_pack(p := 90.0::DOUBLE, id := 'b', name := CASE c_custkey % 8 WHEN 2 THEN '  ' ELSE 'B' END), struct_pack(p := 60.5::DOUBLE + c_custkey % 25, id := 'a', name := 'A')] AS c FROM customer),
        y AS (SELECT *, list_sort(c) AS o, greatest(start_p, finish_p - least(greatest(0.0::DOUBLE, finish_r), greatest(0.0::DOUBLE, greatest(0.0::DOUBLE, finish_p - start_p) - 10))) AS trigger_p FROM x)
        SELECT route_id, CASE WHEN isnan(start_r) OR NOT start_r BETWEEN 8 AND 250 THEN 'start_radius' WHEN NOT finish_r BETWEEN 8 AND 250 THEN 'finish_radius' WHEN len(list_filter(c, lambda z: trim(z.name) = '')) > 0 THEN 'checkpoint_name' WHEN o[1].p - start_p < 10 OR o[2].p - o[1].p < 10 OR finish_p - o[2].p < 10 THEN 'markers_too_close' END AS problem,
        'start=' || {fixed('start_p', 3)} || '|finish=' || {fixed('finish_p', 3)} || '|startR=' || CASE WHEN isnan(start_r) THEN 'nan' ELSE {fixed('start_r', 3)} END || '|finishR=' || {fixed('finish_r', 3)} || '|finishTrigger=' || {fixed('trigger_p', 3)} || '|cp=[' || o[1].id || ':' || {fixed('o[1].p', 3)} || ',' || o[2].id || ':' || {fixed('o[2].p', 3)} || ']' AS identity FROM y""",
    "q_format": f"""WITH o AS (SELECT o_orderkey AS k FROM orders), a AS (SELECT k, greatest(0, (k * 997 - 5000) // 1000) AS s, (k % 9000 - 4500) AS dl, (k % 5000 - 2500) * 7 AS wd, CAST(greatest(0, floor((k * 1300 - 50000 - (k * 1300 - 50000) % 100) / 1000)) AS BIGINT) AS age, make_timestamp((1700000000000 + k * 98765) * 1000) AS tm, CASE WHEN k % 9 = 0 THEN NULL ELSE k % 200 * 1000 END AS fix FROM o)
        SELECT k, {_ELAPSED} AS elapsed, CASE WHEN dl = 0 THEN '0:00' ELSE CASE WHEN dl < 0 THEN '-' ELSE '+' END || (SELECT {_ELAPSED} FROM (SELECT abs(dl) AS s)) END AS delta,
        k || CASE WHEN k % 100 BETWEEN 11 AND 13 THEN 'th' WHEN k % 10 = 1 THEN 'st' WHEN k % 10 = 2 THEN 'nd' WHEN k % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal, k || CASE WHEN k % 100 BETWEEN 11 AND 13 THEN 'th' WHEN k % 10 = 1 THEN 'st' WHEN k % 10 = 2 THEN 'nd' WHEN k % 10 = 3 THEN 'rd' ELSE 'th' END || ' fastest of ' || (k + 3) AS among,
        CAST(floor(CAST(k % 1500 AS DOUBLE) / 1000 * 100 + 0.5) AS BIGINT) || '%' AS share, (k * 10 // 1000) || 's' AS wait, CASE WHEN floor(abs(wd)::DOUBLE / 1000 + 0.5) = 0 THEN '0s' ELSE CASE WHEN wd < 0 THEN '-' ELSE '+' END || CAST(floor(abs(wd)::DOUBLE / 1000 + 0.5) AS BIGINT) || 's' END AS wait_delta,
        hour(tm) || strftime(tm, ':%M:%S') AS clock, strftime(tm, '%Y-%m-%d ') || hour(tm) || strftime(tm, ':%M:%S') AS stamp, CASE WHEN age < 60 THEN age || 's ago' ELSE (age // 60) || 'm ' || (age % 60) || 's ago' END AS age, CASE WHEN fix IS NULL THEN 'waiting_for_first_fix' WHEN fix >= 120000 THEN 'stale' ELSE 'healthy' END AS health,
        CASE WHEN k % 9000 >= 1000 THEN {fixed("(k % 9000)::DOUBLE / 1000", 1)} || ' km' ELSE (k % 9000) || ' m' END || ' into route' AS into_route,
        {_cases("['scooter', 'bike', 'run', 'walk', 'skate'][k % 5 + 1]", MODES, "'skate'")} AS mode, {_cases("['scooter', 'bike', 'run', 'walk', 'skate'][k % 5 + 1]", MODE_ICONS, "''")} AS icon, {_cases("['missing_start_coverage', 'missing_telemetry', 'replay_incomplete', 'not_valid', 'not_completed', 'none'][k % 6 + 1]", UNRANKED)} AS says,
        CASE k % 3 WHEN 0 THEN 'Start' WHEN 1 THEN 'Finish' ELSE 'Bridge' END AS endpoint, CASE k % 6 WHEN 0 THEN 12.5::DOUBLE WHEN 1 THEN 8.0::DOUBLE WHEN 2 THEN CAST(k AS DOUBLE) WHEN 5 THEN 160.0::DOUBLE END AS radius, k % 5 = 2 AND k % 3 = 0 AND k % 2 = 1 AS warns FROM a""",
    "q_attempt_lookups": f"""WITH {STORED} (SELECT 'open' AS kind, attempt_id, armed_at_ms FROM sto WHERE lifecycle IN ('armed', 'active') ORDER BY armed_at_ms DESC LIMIT 1) UNION ALL (SELECT 'result', attempt_id, armed_at_ms FROM sto WHERE NOT acknowledged AND lifecycle NOT IN ('armed', 'active') ORDER BY armed_at_ms DESC LIMIT 1)
        UNION ALL SELECT 'of_id', attempt_id, armed_at_ms FROM sto WHERE attempt_id = '7' UNION ALL SELECT 'of_session', attempt_id, armed_at_ms FROM sto WHERE session_id = '10' UNION ALL SELECT 'of_route', attempt_id, armed_at_ms FROM sto WHERE route_id = '3'""",
    "q_attempt_crossings": f"WITH {STORED} SELECT sto.attempt_id, coalesce(string_agg(checkpoint_id, ',' ORDER BY crossed_at, progress_m, checkpoint_id), '') AS crossings FROM sto LEFT JOIN ck USING (attempt_id) GROUP BY sto.attempt_id",
    "q_finalize": f"""WITH {STORED}, {SESSIONS}, fin AS (SELECT * FROM sto WHERE CAST(attempt_id AS BIGINT) % 9 = 0), st AS (SELECT session_id, min_by(lifecycle, attempt_id) AS x FROM fin GROUP BY session_id HAVING count(*) = 1)
        SELECT 'session' AS kind, id, CASE WHEN st.x IS NOT NULL THEN false ELSE is_active END AS flag, CASE st.x WHEN 'completed' THEN 'finished' WHEN 'cancelled' THEN 'cancelled' ELSE coalesce(CASE WHEN st.x IS NOT NULL THEN 'interrupted' END, outcome) END AS state, CASE WHEN st.x = 'completed' THEN 'saved' WHEN st.x IS NOT NULL THEN 'discarded' ELSE disposition END AS more FROM se LEFT JOIN st ON st.session_id = se.id
        UNION ALL SELECT 'attempt', attempt_id, acknowledged, lifecycle, CASE WHEN attempt_id IN (SELECT attempt_id FROM fin JOIN st USING (session_id)) THEN 'unranked' ELSE validity END FROM sto
        UNION ALL SELECT 'crossing', attempt_id, true, checkpoint_id, CAST(CAST(crossed_at AS BIGINT) AS VARCHAR) FROM ck WHERE attempt_id NOT IN (SELECT attempt_id FROM fin JOIN st USING (session_id)) UNION ALL SELECT 'crossing', attempt_id, true, 'new', '1' FROM fin JOIN st USING (session_id)""",
    "q_acknowledge": f"WITH {STORED} SELECT attempt_id, acknowledged OR CAST(attempt_id AS BIGINT) % 6 = 0 AS result_acknowledged FROM sto",
    "q_routes": """SELECT CAST(n_nationkey AS VARCHAR) AS route_id, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS points, coalesce((SELECT string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') AS sequence,
        coalesce((SELECT string_agg('p' || p_partkey, ',' ORDER BY p_retailprice, p_partkey) FROM part WHERE p_partkey % 25 = n_nationkey), '') AS checkpoints FROM nation""",
    "q_create_routes": """WITH r AS (SELECT CAST(n_nationkey AS VARCHAR) AS route_id, CASE WHEN n_nationkey % 8 <> 0 THEN CAST(n_nationkey % 10 AS VARCHAR) END AS rec FROM nation WHERE n_nationkey < 12), w AS (SELECT 'w' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS route_id, CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey % 20 AS VARCHAR) END AS rec FROM nation)
        SELECT * FROM r UNION ALL SELECT min(route_id), rec FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rec IS NOT DISTINCT FROM w.rec) GROUP BY rec""",
    "q_replace_layouts": """WITH r AS (SELECT n_nationkey AS k, CAST(n_nationkey AS VARCHAR) AS route_id, CASE WHEN n_nationkey % 3 = 0 THEN 20.0::DOUBLE ELSE 30.0::DOUBLE END AS start_r, CASE WHEN n_nationkey % 3 = 0 THEN 7.0::DOUBLE ELSE 0.0::DOUBLE END AS start_p FROM nation)
        SELECT 'route' AS kind, route_id, CAST(start_r AS VARCHAR) AS a, CAST(start_p AS VARCHAR) AS b FROM r UNION ALL SELECT 'checkpoint', route_id, CASE WHEN k % 3 = 0 THEN 'new' ELSE 'old' END, 'c' FROM r""",
    "q_delete_routes": """SELECT 'route' AS kind, CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_nationkey % 4 <> 1 UNION ALL SELECT 'point', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey % 4 <> 1""",
}

_layouts, _geometry = ORACLES["q_layouts"], ORACLES["q_route_geometry"]
ORACLES |= {
    "q_arming": f"""WITH l AS ({_layouts}), t AS (SELECT unnest(['recording', 'undecided', 'open', 'free']) AS kind)
        SELECT kind, route_id, coalesce(problem, CASE WHEN CAST(route_id AS BIGINT) % 4 < 2 THEN 'bad_course' END,
          CASE kind WHEN 'recording' THEN 'recording' WHEN 'undecided' THEN 'pending_route' WHEN 'open' THEN 'open_attempt' END) AS reason FROM l, t""",
    "q_saved_routes": f"""SELECT CASE WHEN k % 3 = 0 THEN 'oldn' ELSE 'n' END || k AS route_id, CASE WHEN k % 3 = 0 THEN 'Old' ELSE 'Way ' || k END AS name,
        session_id AS source_recording_id, points, distance_mm AS finish_mm, start_e7
        FROM ({_geometry}) g JOIN (SELECT c_custkey AS k FROM customer) c ON CAST(k AS VARCHAR) = session_id WHERE saveable AND k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 0""",
    "q_route_lookup": "SELECT '3' AS route_id, count(*) AS points, CAST(0 AS INTEGER) AS checkpoints FROM supplier WHERE s_nationkey = 3",
    "q_tones": f"""WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 7 - 3) * 500 END AS delta, o_orderkey % 9000 AS s, o_orderkey % 120 + 1 AS n FROM orders),
        b AS (SELECT *, n || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END AS place FROM a)
        SELECT k, CASE WHEN delta < 0 THEN 'faster' WHEN delta > 0 THEN 'slower' ELSE 'neutral' END AS tone, CASE WHEN delta > 0 THEN 'more' WHEN delta < 0 THEN 'less' ELSE 'wait' END AS waits,
        CASE WHEN k % 4 = 1 THEN '1 stop' ELSE (k % 4) || ' stops' END AS stops,
        CASE WHEN k % 5 = 0 OR k % 13 = 0 THEN 'Unavailable' ELSE {_ELAPSED} || CASE WHEN k % 4 = 0 THEN ' · PB' WHEN k % 3 <> 0 THEN ' · ' || place ELSE '' END END AS meta FROM b""",
}
