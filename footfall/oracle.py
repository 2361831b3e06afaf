"""The queries of ``queries`` in SQL for another engine, written from the definitions and not from the plans."""

from __future__ import annotations

ZEROS = "''"


def _pick(expr: str, *values: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({expr} AS INTEGER) + 1)"


#: Canonical events: instants in ms; kind, plan, seats, value and k are null where the maps lack them.
EVENTS = f"""
raw AS (SELECT event_id AS e, user_id AS u, event_type, value, epoch_us(ts) // 1000 AS ms, CAST(json_extract(props, '$.k') AS BIGINT) AS pk, event_type = 'signup' AND event_id % 2 = 0 AS idf FROM events),
one AS (SELECT e, u, idf,
  '00000000-0000-4000-8000-' || lpad(CAST(e AS VARCHAR), 12, '0') AS event_id,
  CASE WHEN u % 10 < 2 THEN 'dev-shared-' || (u - u % 10) ELSE 'dev-' || (u * 2 + e % 2) END AS anonymous_id,
  CASE WHEN e % 3 = 0 OR idf THEN 'user-' || u ELSE '' END AS user_id,
  CASE WHEN idf THEN '$identify' ELSE event_type END AS event_name, ms,
  CASE WHEN idf THEN {_pick("u % 3", "free", "pro", "enterprise")} END AS plan,
  CASE WHEN idf THEN CAST(pk AS DOUBLE) END AS seats,
  CASE WHEN NOT idf AND e % 4 <> 0 THEN 'k' || (pk % 7) END AS kind,
  CASE WHEN NOT idf THEN value END AS value,
  CASE WHEN NOT idf AND e % 4 <> 0 THEN CAST(pk AS DOUBLE) END AS k,
  {_pick("e % 6", "/", "/pricing", "/docs", "/changelog", "/signup", "")} AS path,
  {_pick("u % 4", "https://search.example", "", "https://news.example", "")} AS referrer,
  {_pick("u % 4", "google", "", "newsletter", "twitter")} AS utm_source,
  {_pick("u % 4", "cpc", "", "email", "social")} AS utm_medium,
  {_pick("u % 4", "spring", "", "summer", "")} AS utm_campaign,
  {_pick("u % 3", "desktop", "mobile", "tablet")} AS device_type,
  {_pick("u % 4", "windows", "macos", "ios", "android")} AS os,
  {_pick("e % 3", "chrome", "firefox", "safari")} AS browser,
  {_pick("e % 5", "US", "DE", "FR", "JP", "")} AS country FROM raw),
ev AS (SELECT * REPLACE (ms + later AS ms), ms + later + (e % 5) * 1000 AS received FROM one, (VALUES (0), (7000)) AS t(later) WHERE later = 0 OR e % 97 = 0)"""

BIND = """
bd AS (SELECT anonymous_id, ms AS bound, min(user_id) AS person FROM ev WHERE idf GROUP BY anonymous_id, ms)"""

#: Whole seconds, both ends included.
IDENTITY = f"""{BIND},
tl AS (SELECT anonymous_id, person, f // 1000 AS f, t // 1000 AS t FROM (SELECT anonymous_id, person,
    CASE WHEN lag(bound) OVER w IS NULL THEN 0 ELSE bound END AS f, coalesce(lead(bound) OVER w - 1000, 4294967295000) AS t
  FROM bd WINDOW w AS (PARTITION BY anonymous_id ORDER BY bound)) WHERE t >= f),
al AS (SELECT DISTINCT 'user-' || user_id AS person, 'user-' || (user_id - 1) AS canonical FROM events WHERE user_id % 10 = 9),
su AS (SELECT DISTINCT 'user-' || user_id AS person, 1705276800000 AS until FROM events WHERE user_id % 25 = 3)"""


def resolved(source: str, at: str = "ms") -> str:
    return f"""(SELECT x.* EXCLUDE (first), coalesce(al.canonical, x.first) AS person_id FROM
  (SELECT s.*, CASE WHEN s.user_id <> '' THEN s.user_id ELSE coalesce(tl.person, s.anonymous_id) END AS first FROM {source} s
   LEFT JOIN tl ON s.user_id = '' AND s.anonymous_id = tl.anonymous_id AND s.{at} // 1000 BETWEEN tl.f AND tl.t) x LEFT JOIN al ON x.first = al.person)"""


def dedup(where: str = "true") -> str:
    return f"(SELECT * FROM ev WHERE {where} QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ms, received DESC) = 1)"


def shown(where: str = "true") -> str:
    """A scan, its copies removed, people resolved, what is suppressed hidden."""
    return f"(SELECT r.* FROM {resolved(dedup(where))} r LEFT JOIN su ON r.person_id = su.person WHERE su.until IS NULL OR r.ms > su.until)"


def sql(body: str, *ctes: str) -> str:
    return f"WITH {EVENTS},{IDENTITY}{''.join(',' + c for c in ctes)}\n{body}"


def day(d: int, h: int = 0, m: int = 0, s: int = 0) -> int:
    """Milliseconds of a day of January 2024."""
    return 1_704_067_200_000 + (((d - 1) * 24 + h) * 60 + m) * 60_000 + s * 1000


LATEST = ("country", "region", "city", "device_type", "os", "browser")
CONTEXT = ("country", "region", "city", "device_type", "os", "browser", "referrer", "utm_source", "utm_medium", "utm_campaign")


def _col(c: str) -> str:
    return ZEROS if c in ("region", "city") else c


INDEX = f"""
dx AS (SELECT anonymous_id, user_id, CAST(strftime(make_timestamp(ms * 1000), '%Y%m') AS INTEGER) AS month, min(ms) AS first_seen, max(ms) AS last_seen, count(*) AS event_count,
  {', '.join(f"arg_max({_col(c)}, (ms, event_id)) AS l_{c}" for c in LATEST)}, max((ms, event_id)) AS l_at,
  {', '.join(f"arg_min({_col(c)}, (ms, event_id)) AS f_{c}" for c in CONTEXT)}, min((ms, event_id)) AS f_at FROM ev GROUP BY ALL)"""
BASE = f"""{INDEX},
base AS (SELECT person_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen, {', '.join(f"arg_max(l_{c}, l_at) AS latest_{c}" for c in LATEST)},
  {', '.join(f"arg_min(f_{c}, f_at) AS first_{c}" for c in CONTEXT)} FROM {resolved('dx', 'last_seen')} GROUP BY person_id)"""
TRAITS = f"""
tr AS (SELECT anonymous_id, user_id, tkey, arg_max(val, (ms, event_id)) AS val, arg_max(num, (ms, event_id)) AS num, max((ms, event_id)) AS pos, max(ms) AS ms FROM
  (SELECT anonymous_id, user_id, ms, event_id, 'plan' AS tkey, plan AS val, 0.0 AS num FROM ev WHERE idf UNION ALL SELECT anonymous_id, user_id, ms, event_id, 'seats', '', seats FROM ev WHERE idf) GROUP BY ALL),
tp AS (SELECT person_id, arg_max(val, pos) FILTER (tkey = 'plan') AS plan, arg_max(num, pos) FILTER (tkey = 'seats') AS seats FROM {resolved("(SELECT *, 1706659200000 AS now FROM tr)", 'now')} GROUP BY person_id)"""
RICH = f"""
pp AS (SELECT base.*, tp.plan, tp.seats FROM base LEFT JOIN tp USING (person_id) LEFT JOIN su ON base.person_id = su.person WHERE su.until IS NULL OR last_seen > su.until),
b AS (SELECT person_id, count(*) FILTER (ms BETWEEN {day(5)} AND {day(25)} AND country BETWEEN 'DE' AND 'JP') AS n, coalesce(sum(value) FILTER (event_name = 'purchase'), 0) AS v FROM {shown()} GROUP BY person_id),
seg AS (SELECT pp.* FROM pp LEFT JOIN b USING (person_id) WHERE
  (coalesce(plan, '') = 'pro' AND latest_os <> 'ios' AND last_seen >= {day(20)} AND coalesce(n, 0) > 4)
  OR NOT (seats IS NOT NULL AND seats < 60) OR coalesce(v, 0) BETWEEN 200 AND 400)"""
MAPS = "CASE WHEN plan IS NULL THEN '' ELSE 'plan=' || plan END AS traits, CASE WHEN seats IS NULL THEN '' ELSE 'seats=' || CAST(seats AS VARCHAR) END AS traits_num"


def chain(steps: list[str], window: int, since: int, until: int, names: str, people: str = "true") -> str:
    """lv(person_id, level, entered_at): for every start the earliest next steps, then the best start."""
    ctes = [f"se AS (SELECT * FROM {shown(f'ms >= {since} AND ms < least({until} + {window}, 1706659200000) AND event_name IN ({names})')} x WHERE {people})"]
    ctes.append(f"c1 AS (SELECT person_id, ms AS start, ms, event_id FROM se WHERE {steps[0]} AND ms < {until})")
    for i, cond in enumerate(steps[1:], 2):
        ctes.append(f"c{i} AS (SELECT p.person_id, p.start, p.sid, min(n.ms) AS ms, arg_min(n.event_id, (n.ms, n.event_id)) AS event_id FROM (SELECT person_id, start, ms, event_id, {'event_id' if i == 2 else 'sid'} AS sid FROM c{i - 1}) p JOIN (SELECT * FROM se WHERE {cond}) n ON n.person_id = p.person_id AND (n.ms, n.event_id) > (p.ms, p.event_id) AND n.ms <= p.start + {window} GROUP BY ALL)")
    best = " UNION ALL ".join(f"SELECT person_id, {i} AS level, start FROM c{i}" for i in range(1, len(steps) + 1))
    ctes.append(f"lv AS (SELECT person_id, CAST(max(level) AS BIGINT) AS level, min(start) FILTER (level = 1) AS entered_at FROM ({best}) GROUP BY person_id)")
    return ",\n".join(ctes)


THREE = chain(["event_name = 'view'", "event_name = 'click'", "event_name = 'purchase'"], 259_200_000, day(2), day(28), "'view', 'click', 'purchase'")
LEVELS = f"SELECT person_id, level, entered_at, entered_at > 1706659200000 - 259200000 AS partial FROM lv"  # noqa: F541
AUDIENCE = f"""
au AS (SELECT base.person_id FROM base LEFT JOIN su ON base.person_id = su.person JOIN (SELECT person_id FROM {shown()} WHERE event_name = 'signup' GROUP BY 1) USING (person_id) WHERE su.until IS NULL OR last_seen > su.until),
sg AS (SELECT base.person_id FROM base LEFT JOIN su ON base.person_id = su.person WHERE (su.until IS NULL OR last_seen > su.until) AND first_seen < {day(3)})"""
AUDIENCED = chain(["event_name = 'view' AND coalesce(kind, '') <> 'k1'", "event_name = 'click' AND person_id IN (SELECT person_id FROM au)", "event_name = 'click'"], 172_800_000, day(2), day(28), "'view', 'click'", "person_id IN (SELECT person_id FROM sg)")

#: Exact device windows of a person's group: from included, to excluded.
EXACT = "xt AS (SELECT anonymous_id, person, CASE WHEN lag(bound) OVER w IS NOT NULL THEN bound END AS f, lead(bound) OVER w AS t FROM bd WINDOW w AS (PARTITION BY anonymous_id ORDER BY bound))"


def owned(ids: str) -> str:
    return f"(user_id IN ({ids}) OR (user_id = '' AND EXISTS (SELECT 1 FROM xt WHERE xt.anonymous_id = q.anonymous_id AND xt.person IN ({ids}) AND (xt.f IS NULL OR q.ms >= xt.f) AND (xt.t IS NULL OR q.ms < xt.t))))"


REQUESTS = """
rq AS (SELECT *, CASE WHEN e % 17 = 0 THEN 'rejected' WHEN e % 13 = 0 AND user_id = '' THEN 'rejected' WHEN e % 7 = 0 THEN 'bot' ELSE 'accepted' END AS outcome,
  CASE WHEN e % 13 = 0 AND user_id = '' THEN 'anonymous_id or user_id is required' ELSE 'event' END AS problem FROM ev)"""
KINDS = """
ks AS (SELECT event_name, 'kind' AS property_key, 'string' AS value_kind, max(ms) AS last_seen FROM ev WHERE kind IS NOT NULL GROUP BY 1
  UNION ALL SELECT event_name, 'plan', 'string', max(ms) FROM ev WHERE plan IS NOT NULL GROUP BY 1
  UNION ALL SELECT event_name, 'seats', 'number', max(ms) FROM ev WHERE seats IS NOT NULL GROUP BY 1
  UNION ALL SELECT event_name, 'value', 'number', max(ms) FROM ev WHERE value IS NOT NULL GROUP BY 1
  UNION ALL SELECT event_name, 'k', 'number', max(ms) FROM ev WHERE k IS NOT NULL GROUP BY 1
  UNION ALL SELECT event_name, '', '', max(ms) FROM ev GROUP BY 1)"""
MID = day(16)
GONE = "(user_id = 'user-10' OR (user_id = '' AND anonymous_id IN (SELECT anonymous_id FROM bd WHERE person = 'user-10')))"
N = "CAST(count(*) AS BIGINT)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


ORACLES = {
    "canonical": sql(f"SELECT event_id, anonymous_id, user_id, event_name, CASE WHEN path = '' THEN '' ELSE 'https://example.com' || path END AS url, path, referrer, utm_source, utm_medium, utm_campaign, device_type, os, browser, country, ms AS timestamp, received AS received_at, CASE WHEN plan IS NOT NULL THEN 'plan=' || plan WHEN kind IS NOT NULL THEN 'kind=' || kind ELSE '' END AS properties, {big('(seats IS NOT NULL)::INT + (value IS NOT NULL)::INT + (k IS NOT NULL)::INT')} AS n_numbers FROM ev"),
    "dedup_events": sql(f"SELECT event_name, {N} AS events, {big('sum(ms % 100003)')} AS checksum FROM {dedup('true')} GROUP BY 1"),
    "duplicates": sql("SELECT event_id, count(*) AS copies FROM ev GROUP BY 1 HAVING count(*) > 1"),
    "storage_dedup": sql(f"SELECT event_name, {N} AS events, max(received) + 3600000 AS latest FROM ev GROUP BY 1"),
    "identity_tiles": sql("SELECT anonymous_id, person AS person_id, f * 1000 AS valid_from, t * 1000 AS valid_to FROM tl"),
    "identity_exact_tiles": sql("SELECT anonymous_id, person AS person_id, f AS valid_from, t AS valid_to FROM xt", EXACT),
    "identity_coalesced": sql("""SELECT anonymous_id, person AS person_id, nullif(min(coalesce(f, -1)), -1) AS valid_from, nullif(max(coalesce(t, 9e15::BIGINT)), 9e15::BIGINT) AS valid_to FROM
      (SELECT *, sum(new) OVER (PARTITION BY anonymous_id ORDER BY f NULLS FIRST) AS run FROM (SELECT *, CASE WHEN lag(person) OVER w = person THEN 0 ELSE 1 END AS new FROM xt WINDOW w AS (PARTITION BY anonymous_id ORDER BY f NULLS FIRST))) GROUP BY anonymous_id, person, run""", EXACT),
    "identity_resolve": sql(f"SELECT person_id, {N} AS events, min(ms) AS first_ms, max(ms) AS last_ms FROM {resolved('ev')} GROUP BY 1"),
    "identity_bind": sql("SELECT anonymous_id, min(user_id) AS person_id, ms // 3600000 * 3600000 AS bound_at FROM ev WHERE user_id <> '' GROUP BY anonymous_id, ms // 3600000"),
    "suppression": sql(f"SELECT person_id, {N} AS events, min(ms) AS first_ms FROM {shown()} GROUP BY 1"),
    "suppression_upsert": sql("SELECT person AS person_id, max(until) AS suppressed_at FROM (SELECT * FROM su UNION ALL SELECT DISTINCT user_id, 1705000000000 + u * 86400000 FROM ev WHERE user_id <> '' AND u % 5 = 0) GROUP BY 1"),
    "rollup_device_index": sql(f"SELECT anonymous_id, user_id, month, first_seen, last_seen, {big('event_count')} AS event_count, l_country AS latest_country, l_browser AS latest_browser, f_country AS first_country, f_utm_source AS first_utm_source FROM dx", INDEX),
    "rollup_person_traits": sql("SELECT anonymous_id, user_id, tkey AS trait_key, val AS value_str, num AS value_num, CAST(tkey = 'seats' AS BIGINT) AS has_num, ms AS updated_at FROM tr", TRAITS),
    "rollup_event_schema": sql("SELECT * FROM ks", KINDS),
    "segment_base": sql("SELECT * FROM base", BASE),
    "segment_traits": sql(f"SELECT person_id, {MAPS} FROM tp", TRAITS),
    "behavior_pass": sql(f"""SELECT person_id, CAST(count(*) FILTER (event_name = 'click' AND ms >= {day(21)}) AS DOUBLE) AS b0, round(coalesce(sum(value) FILTER (event_name = 'purchase'), 0), 6) AS b1,
      coalesce(min(coalesce(k, 0)) FILTER (event_name = 'view'), 0) AS b2, coalesce(max(coalesce(k, 0)) FILTER (ms BETWEEN {day(5)} AND {day(20)}), 0) AS b3, CAST(count(DISTINCT coalesce(kind, '')) AS DOUBLE) AS b4,
      CAST(count(*) FILTER (event_name = 'click' AND coalesce(value, 0) < 20 AND path <> '/docs') AS DOUBLE) AS b5 FROM {shown()} GROUP BY 1"""),
    "segment_count": sql(f"""SELECT {N} AS person_count FROM base LEFT JOIN su ON base.person_id = su.person LEFT JOIN
      (SELECT person_id, count(*) FILTER (event_name = 'click' AND ms >= {day(11)}) AS a, count(*) FILTER (event_name = 'error' AND kind = 'k3') AS b FROM {shown()} GROUP BY 1) c ON base.person_id = c.person_id
      WHERE (su.until IS NULL OR last_seen > su.until) AND coalesce(a, 0) >= 3 AND NOT coalesce(b, 0) >= 1""", BASE),
    "segment_count_rich": sql(f"SELECT {N} AS person_count FROM seg", BASE, TRAITS, RICH),
    "segment_persons": sql("SELECT person_id FROM seg", BASE, TRAITS, RICH),
    "segment_members": sql(f"""SELECT person_id, first_seen, last_seen, {', '.join(f'{"latest" if c in LATEST else "first"}_{c} AS {c}' for c in CONTEXT)}, {MAPS}, {big('(plan IS NOT NULL)::INT + (seats IS NOT NULL)::INT')} AS trait_total FROM seg
      WHERE last_seen < {day(29, 12)} OR (last_seen = {day(29, 12)} AND person_id > 'dev-0') ORDER BY last_seen DESC, person_id LIMIT 50""", BASE, TRAITS, RICH),
    "funnel_levels": sql(LEVELS, THREE),
    "funnel_folded": sql(LEVELS, THREE),
    "funnel_histogram": sql(f"SELECT level, {N} AS people, CAST(count(*) FILTER (partial) AS BIGINT) AS partial FROM ({LEVELS}) GROUP BY 1", THREE),
    "funnel_report": sql("""SELECT CAST(s AS BIGINT) AS step, n AS people, round(CASE WHEN coalesce(lag(n) OVER (ORDER BY s), n) = 0 THEN 0 ELSE n / coalesce(lag(n) OVER (ORDER BY s), n) END, 6) AS from_previous,
      round(CASE WHEN first_value(n) OVER (ORDER BY s) = 0 THEN 0 ELSE n / first_value(n) OVER (ORDER BY s) END, 6) AS from_start FROM (SELECT s, count(person_id) AS n FROM range(1, 4) r(s) LEFT JOIN lv ON level >= s GROUP BY s)""", THREE),
    "funnel_audience": sql(LEVELS.replace("259200000", "172800000"), BASE, AUDIENCE, AUDIENCED),
    "funnel_people": sql(f"SELECT person_id, entered_at FROM lv WHERE level >= 2 AND (entered_at < {day(3)} OR (entered_at = {day(3)} AND person_id > '')) ORDER BY entered_at DESC, person_id LIMIT 40", THREE),
    "funnel_dropped": sql(f"SELECT {N} AS person_count FROM lv WHERE level = 2", THREE),
    "funnel_members": sql(f"SELECT person_id, entered_at, last_seen, latest_os AS os, first_utm_source AS utm_source, {MAPS.split(', CASE')[0]} FROM lv LEFT JOIN base USING (person_id) LEFT JOIN tp USING (person_id) WHERE level >= 3 ORDER BY entered_at DESC, person_id LIMIT 100", BASE, TRAITS, THREE),
    "feed_latest": sql(f"SELECT event_id, ms AS timestamp, event_name, anonymous_id, user_id, CASE WHEN plan IS NOT NULL THEN 'plan=' || plan WHEN kind IS NOT NULL THEN 'kind=' || kind ELSE '' END AS properties, country, path FROM {shown(f'ms >= {day(28)}')} ORDER BY ms DESC, event_id DESC LIMIT 100"),
    "feed_cursor": sql(f"""SELECT event_id, ms AS timestamp, anonymous_id, user_id FROM {shown(f"event_name = 'click' AND ms <= {MID} AND (ms > {day(10)} OR (ms = {day(10)} AND event_id > '00000000-0000-4000-8000-000000000500'))")} ORDER BY ms, event_id LIMIT 70"""),
    "feed_person": sql(f"""SELECT event_id, ms AS timestamp, event_name FROM (SELECT r.* FROM {resolved(f"(SELECT * FROM ev q WHERE ms >= {day(1)} AND {owned(repr('user-10'))} QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ms, received DESC) = 1)")} r LEFT JOIN su ON r.person_id = su.person WHERE su.until IS NULL OR r.ms > su.until) ORDER BY ms DESC, event_id DESC LIMIT 200""", EXACT),
    "stats_daily": sql(f"SELECT ms // 86400000 * 86400000 AS bucket, event_name, count(DISTINCT event_id) AS events FROM {shown(f'ms BETWEEN {day(2)} AND {day(25)}')} GROUP BY ALL"),
    "stats_hourly": sql(f"SELECT ms // 3600000 * 3600000 AS bucket, count(DISTINCT event_id) AS events FROM {shown(f'ms BETWEEN {MID} AND {day(20)}')} GROUP BY ALL"),
    "stats_filled": sql(f"""SELECT g.b AS bucket, coalesce(n, 0) AS events FROM range({day(16, 0, 30)}, {day(16, 4)} + 1, 60000) g(b) LEFT JOIN (SELECT ms // 60000 * 60000 AS b, count(*) AS n FROM {shown(f'ms BETWEEN {day(16, 0, 30, 20)} AND {day(16, 4)}')} GROUP BY 1) c ON c.b = g.b"""),
    "stats_peak": sql(f"SELECT max(n) AS peak, {big('sum(n)')} AS total FROM (SELECT count(*) AS n FROM {shown(f'ms BETWEEN {MID} AND {day(20)}')} GROUP BY ms // 3600000)"),
    "event_totals": sql(f"SELECT a.event_name, {big('coalesce(n, 0)')} AS events FROM (SELECT DISTINCT event_name FROM ev) a LEFT JOIN (SELECT event_name, count(*) AS n FROM {shown(f'ms BETWEEN {MID} AND {day(16, 0, 45)}')} GROUP BY 1) b USING (event_name)"),
    "catalog_events": sql("SELECT event_name, max(ms) AS last_seen FROM ev GROUP BY 1"),
    "catalog_properties": sql("SELECT DISTINCT property_key, value_kind FROM ks WHERE property_key LIKE 'k%'", KINDS),
    "catalog_kinds": sql("SELECT property_key, CASE WHEN property_key = 'kind' AND (SELECT count(*) FROM ev WHERE event_name = 'error') > 0 THEN 'mixed' ELSE min(value_kind) END AS kind FROM ks WHERE property_key <> '' GROUP BY 1", KINDS),
    "catalog_traits": sql("SELECT DISTINCT val AS value FROM tr WHERE tkey = 'plan' AND val LIKE 'p%'", TRAITS),
    "person_summary": sql(f"SELECT min(ms) AS first_seen, max(ms) AS last_seen, count(DISTINCT event_id) AS events FROM ev q WHERE {owned(repr('user-10'))}", EXACT),
    "person_export_events": sql(f"""SELECT event_id, min(ms) AS timestamp FROM ev q WHERE {owned("'user-8', 'user-9'")} GROUP BY event_id""", EXACT),
    "person_export_traits": sql("""SELECT tkey AS trait_key, arg_max(val, pos) AS value_str, arg_max(num, pos) AS value_num, CAST(tkey = 'seats' AS BIGINT) AS has_num FROM tr WHERE user_id IN ('user-8', 'user-9') GROUP BY tkey""", TRAITS),
    "ingest_outcomes": sql("SELECT outcome, count(*) AS n FROM rq GROUP BY 1", REQUESTS),
    "ingest_events": sql(f"""SELECT event_name, CASE WHEN e % 7 = 1 THEN 'tablet' ELSE 'desktop' END AS device_type, CASE WHEN e % 7 = 1 THEN 'ios' ELSE 'windows' END AS os, CASE WHEN e % 7 = 1 THEN 'safari' ELSE 'edge' END AS browser,
      count(*) AS n, {big('sum(ms % 100003)')} AS checksum, {big('sum((seats IS NOT NULL)::INT + (value IS NOT NULL)::INT + (k IS NOT NULL)::INT)')} AS numbers FROM rq WHERE outcome = 'accepted' GROUP BY ALL""", REQUESTS),
    "ingest_counters": sql("""SELECT CAST(1 + e % 3 AS BIGINT) AS project_id, strftime(make_timestamp(ms * 1000) + CASE WHEN e % 4 = 0 THEN INTERVAL 31 DAY ELSE INTERVAL 0 DAY END, '%Y-%m') AS month,
      least(count(*) FILTER (outcome = 'accepted'), CASE WHEN e % 3 = 0 THEN 300 ELSE 100 END) AS accepted, count(*) FILTER (outcome = 'rejected') AS rejected, CAST(0 AS BIGINT) AS throttled,
      greatest(count(*) FILTER (outcome = 'accepted') - CASE WHEN e % 3 = 0 THEN 300 ELSE 100 END, 0) AS over_quota, count(*) FILTER (outcome = 'bot') AS bot FROM rq WHERE e % 3 < 2 GROUP BY e % 3, 2""", REQUESTS),
    "ingest_rejections": sql("SELECT ms AS received_at, 'validation_failed' AS reason, problem AS detail FROM rq WHERE outcome = 'rejected' ORDER BY ms DESC LIMIT 40 OFFSET 20", REQUESTS),
    "purge_person": sql(f"""SELECT 'events' AS "table", count(*) AS rows FROM ev q WHERE NOT {owned("'user-10'")}
      UNION ALL SELECT 'device_index', count(*) FROM dx WHERE NOT {GONE} UNION ALL SELECT 'person_traits', count(*) FROM tr WHERE NOT {GONE}
      UNION ALL SELECT 'dead_letter', 1 UNION ALL SELECT 'bindings', count(*) FROM bd WHERE person <> 'user-10' UNION ALL SELECT 'event_schema', count(*) FROM ks
      UNION ALL SELECT 'suppressed', count(*) + 1 + (SELECT count(DISTINCT anonymous_id) FROM bd WHERE person = 'user-10') FROM su WHERE person <> 'user-10'""", EXACT, INDEX, TRAITS, KINDS),
    "retention_dry_run": sql("SELECT 202401 AS month, count(*) AS events FROM ev"),
    "stale_names": sql("SELECT event_name, property_key, value_kind FROM ks WHERE event_name IN ('error', 'signup')", KINDS),
}
