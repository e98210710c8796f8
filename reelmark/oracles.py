"""The registered queries as plain SQL over the driver's tables, for comparison in another engine."""

from __future__ import annotations

from reelmark.adapters import CUTOFF, GAP_MINUTES

ORACLES: dict[str, str] = {}

# ---- shared subqueries --------------------------------------------------------------------

EVENTS = """
raw_events AS (
  SELECT event_id AS row_id, date_trunc('second', ts) AS event_ts,
         strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time,
         CAST(user_id AS VARCHAR) AS user_id, 'User ' || user_id AS user_name,
         CAST(floor(value * 20) AS BIGINT) AS duration,
         'Item ' || k AS item_name,
         CASE WHEN lost THEN 'clip-' || k ELSE CAST(k AS VARCHAR) END AS item_id,
         CASE k % 3 WHEN 0 THEN 'Movie' WHEN 1 THEN 'Episode' ELSE 'Trailer' END AS item_type,
         CASE WHEN event_id % 4 <> 0 THEN '10.0.0.' || k END AS remote_address
  FROM (
    SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS k, k >= 17 AS lost FROM events WHERE event_id % 2 = 0
    UNION ALL SELECT *, event_id // 5 AS k, event_id % 35 = 1 AS lost FROM events WHERE event_id % 2 <> 0))
"""

LIBRARY = """
lib AS (
  SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS item_name,
         CASE p_partkey % 3 WHEN 0 THEN 'Movie' WHEN 1 THEN 'Episode' ELSE 'Trailer' END AS item_type,
         CASE WHEN p_partkey % 4 <> 3 THEN CAST(p_size AS BIGINT) * 600000000 + 5 END AS runtime_ticks,
         CASE WHEN p_partkey % 4 <> 3 THEN (CAST(p_size AS BIGINT) * 600000000 + 5) // 10000000 END
           AS runtime_seconds
  FROM part)
"""


def marked(gap_minutes: int = GAP_MINUTES) -> str:
    return f"""{EVENTS},
looked AS (
  SELECT *, lag(event_ts) OVER (PARTITION BY user_id, item_id ORDER BY event_ts, row_id) AS prev_ts
  FROM raw_events),
flagged AS (
  SELECT *, CASE WHEN prev_ts IS NULL OR date_diff('second', prev_ts, event_ts) > {gap_minutes * 60}
            THEN 1 ELSE 0 END AS is_new
  FROM looked),
marked AS (
  SELECT *, CAST(sum(is_new) OVER (PARTITION BY user_id, item_id ORDER BY event_ts, row_id
                                   ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp
  FROM flagged)
"""


def _ratio(seconds: str, runtime: str, kind: str, other: str) -> str:
    return f"""CASE WHEN {runtime} > 0 THEN least(1e0, {seconds} / CAST({runtime} AS DOUBLE))
       WHEN {kind} = 'Episode' THEN least(1e0, {seconds} / 1500e0)
       WHEN {kind} = 'Movie' THEN least(1e0, {seconds} / 7200e0) ELSE {other} END"""


def sessions(gap_minutes: int = GAP_MINUTES, completed="0.9", partial="0.25", sampled=60, runtime="l.runtime_seconds") -> str:
    return f"""{marked(gap_minutes)}, {LIBRARY},
grouped AS (
  SELECT user_id, item_id, grp, min(event_ts) AS s, max(event_ts) AS e, CAST(sum(duration) AS BIGINT) AS w,
         count(*) AS n, max(item_type) AS kind
  FROM marked GROUP BY user_id, item_id, grp),
sessions AS (
  SELECT md5(g.user_id || chr(31) || g.item_id || chr(31) || strftime(s, '%Y-%m-%d %H:%M:%S')) AS session_id,
         g.user_id, g.item_id, s AS session_start_timestamp, e AS session_end_timestamp,
         date_diff('second', s, e) // 60 AS session_span_minutes, w AS total_seconds_watched,
         n AS session_count,
         {_ratio("w", runtime, "kind", "NULL")} AS completion_ratio,
         CASE WHEN {runtime} > 0 THEN
                CASE WHEN w >= CAST({completed} AS DOUBLE) * {runtime} THEN 'completed'
                     WHEN w >= CAST({partial} AS DOUBLE) * {runtime} THEN 'partial'
                     WHEN w >= {sampled} THEN 'sampled' ELSE 'abandoned' END
              WHEN kind = 'Episode' THEN
                CASE WHEN w >= 1200 THEN 'completed' WHEN w >= 300 THEN 'partial'
                     WHEN w >= 60 THEN 'sampled' ELSE 'abandoned' END
              WHEN kind = 'Movie' THEN
                CASE WHEN w >= 5400 THEN 'completed' WHEN w >= 1800 THEN 'partial'
                     WHEN w >= 300 THEN 'sampled' ELSE 'abandoned' END
              ELSE 'unknown' END AS outcome
  FROM grouped g LEFT JOIN lib l ON g.item_id = l.item_id)
"""


_OUTCOMES = ",\n".join(
    f"CAST(sum(CASE WHEN outcome = '{name}' THEN 1 ELSE 0 END) AS BIGINT) AS {name}_sessions"
    for name in ("completed", "partial", "abandoned", "sampled")
)


def stats(sessions_sql: str) -> str:
    return f"""{sessions_sql},
per_pair AS (
  SELECT s.user_id, s.item_id, any_value(l.runtime_seconds) AS r, any_value(l.item_type) AS kind,
         count(*) AS n, CAST(sum(total_seconds_watched) AS BIGINT) AS total,
         max(total_seconds_watched) AS longest, avg(total_seconds_watched) AS mean,
         min(session_start_timestamp) AS f, max(session_end_timestamp) AS e, {_OUTCOMES}
  FROM sessions s LEFT JOIN lib l ON s.item_id = l.item_id GROUP BY s.user_id, s.item_id),
stats AS (
  SELECT md5(user_id || chr(31) || item_id) AS stat_id, user_id, item_id, n AS total_sessions,
         total AS total_seconds_watched, round(total / 60e0, 9) AS total_minutes_watched,
         round({_ratio("longest", "r", "kind", "0e0")}, 9) AS best_completion_ratio,
         round({_ratio("mean", "r", "kind", "0e0")}, 9) AS average_completion_ratio,
         n - 1 AS rewatch_count, f AS first_watched_timestamp, e AS last_watched_timestamp,
         round(date_diff('second', f, e) / 86400e0, 9) AS days_between_first_last,
         round(CASE
           WHEN r > 0 THEN 6e-1 * least(1e0, longest / CAST(r AS DOUBLE)) + 3e-1 * least(1e0, n / 3e0)
                           + 1e-1 * least(1e0, total / CAST(r AS DOUBLE))
           WHEN kind = 'Episode' THEN 6e-1 * least(1e0, longest / 1500e0) + 3e-1 * least(1e0, n / 3e0)
                           + 1e-1 * least(1e0, total / 3600e0)
           WHEN kind = 'Movie' THEN 7e-1 * least(1e0, longest / 7200e0) + 2e-1 * least(1e0, n / 2e0)
                           + 1e-1 * least(1e0, total / 7200e0)
           ELSE 0e0 END, 9) AS adherence_score,
         completed_sessions, partial_sessions, abandoned_sessions, sampled_sessions
  FROM per_pair)
"""


SESSIONS = sessions()
STATS = stats(SESSIONS)

# The catalogue: every part as an item (copy 0), every fiftieth once more under a new name (copy 1).
ITEMS = """
words AS (
  SELECT p_partkey AS i, CAST(p_partkey AS VARCHAR) AS id, *, split_part(p_name, ' ', 1) AS w1,
         split_part(p_name, ' ', 2) AS w2,
         CASE p_partkey % 3 WHEN 0 THEN 'Movie' WHEN 1 THEN 'Episode' ELSE 'Trailer' END AS kind,
         (p_partkey // 3) % 6 AS gm, (p_partkey // 5) % 4 AS gn, (p_partkey // 2) % 4 AS tm,
         (p_partkey // 7) % 3 AS tn
  FROM part),
items AS (
  SELECT *, 0 AS copy, p_name AS label FROM words
  UNION ALL SELECT *, 1 AS copy, 'new ' || p_name AS label FROM words WHERE i % 50 = 0),
kept AS (SELECT * FROM items WHERE kind IN ('Movie', 'Episode'))
"""

CODEC = "CASE WHEN i % 7 IN (0, 1) THEN '' WHEN i % 7 = 2 THEN NULL ELSE 'h264' END"
_OWN_WIDTH = "CASE i % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1920 END"
_OWN_HEIGHT = "CASE i % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1080 END"
_FALLBACK = "(i % 5 = 0 OR i % 4 = 0) AND i % 7 NOT IN (0, 1)"
WIDTH = f"CASE WHEN {_FALLBACK} THEN CASE WHEN i % 5 IN (0, 1) THEN 1280 ELSE 1920 END ELSE {_OWN_WIDTH} END"
HEIGHT = (
    f"CASE WHEN {_FALLBACK} THEN CASE WHEN i % 4 IN (0, 1) THEN CASE WHEN i % 7 = 3 THEN NULL ELSE 720 END "
    f"ELSE 1080 END ELSE {_OWN_HEIGHT} END"
)
TICKS = "CASE WHEN i % 4 <> 3 THEN CAST(p_size AS BIGINT) * 600000000 + 5 END"
SERIES_ID = "CASE WHEN kind = 'Episode' THEN 'S' || (i % 150) END"

GENRE_ENTRIES = """
objects AS (
  SELECT i, copy, 1 AS pos, CAST(p_size AS BIGINT) AS gid, p_type AS gname FROM items WHERE gm IN (2, 4)
  UNION ALL SELECT i, copy, 1, 7, NULL FROM items WHERE gm = 3
  UNION ALL SELECT i, copy, 2, 500, w1 FROM items WHERE gm = 4
  UNION ALL SELECT i, copy, 1, 9, '' FROM items WHERE gm = 5
  UNION ALL SELECT i, copy, 2, p_size, p_type FROM items WHERE gm = 5
  UNION ALL SELECT i, copy, 3, p_size, p_type FROM items WHERE gm = 5),
listed AS (
  SELECT i, copy, w1 AS gname FROM items WHERE gn = 2 UNION SELECT i, copy, w2 FROM items WHERE gn = 2
  UNION SELECT i, copy, upper(w1) FROM items WHERE gn = 3 UNION SELECT i, copy, p_type FROM items WHERE gn = 3
  UNION SELECT i, copy, p_brand FROM items WHERE gn = 3),
named AS (
  SELECT l.* FROM listed l
  WHERE NOT EXISTS (SELECT 1 FROM objects o WHERE o.i = l.i AND o.copy = l.copy AND o.gname = l.gname)),
entries AS (
  SELECT i, copy, gid, gname, 'object' AS origin FROM objects
  UNION ALL SELECT i, copy, NULL, gname, 'item' FROM named)
"""

# Series: suppliers; a series' unnamed and repeated objects are skipped, then its plain names follow.
SERIES = f"""
series AS (
  SELECT 'S' || s_suppkey AS sid, * FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
series_objects AS (
  SELECT sid, CAST(n_nationkey AS BIGINT) AS gid, n_name AS gname FROM series WHERE s_suppkey % 4 = 1
  UNION ALL SELECT sid, 11, r_name FROM series WHERE s_suppkey % 4 = 3),
series_listed AS (
  SELECT sid, n_name AS gname FROM series WHERE s_suppkey % 3 <> 0
  UNION SELECT sid, 'Small' FROM series WHERE s_suppkey % 3 <> 0
  UNION SELECT sid, 'ring' FROM series WHERE s_suppkey % 3 <> 0
  UNION SELECT sid, r_name FROM series WHERE s_suppkey % 3 <> 0),
series_entries AS (
  SELECT sid, gid, gname, 'object' AS origin FROM series_objects
  UNION ALL SELECT sid, NULL, gname, 'series' FROM series_listed l
  WHERE NOT EXISTS (SELECT 1 FROM series_objects o WHERE o.sid = l.sid AND o.gname = l.gname)),
asking AS (
  SELECT i, copy, {SERIES_ID} AS sid FROM items t WHERE kind = 'Episode' AND NOT EXISTS (
    SELECT 1 FROM entries e WHERE e.i = t.i AND e.copy = t.copy AND e.gname <> '')),
inherited AS (
  SELECT a.i, a.copy, s.gid, s.gname, s.origin FROM asking a JOIN series_entries s ON a.sid = s.sid)
"""

REF = """
movie_ref AS (SELECT split_part(p_name, ' ', 1) AS name, min(p_partkey) AS id FROM part GROUP BY 1),
tv_ref AS (SELECT split_part(p_name, ' ', 2) AS name, min(p_partkey) AS id FROM part GROUP BY 1)
"""


def crc(name: str) -> str:
    """CRC-32 of the lower-cased ASCII name, bit by bit, with the sign bit cleared."""
    return f"""(xor(list_reduce(list_transform(string_split(lower({name}), ''), lambda ch: CAST(ord(ch) AS BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, z: xor(x >> 1, 3988292384 * (x & 1))), CAST(4294967295 AS BIGINT)), 4294967295) & 2147483647)"""


def genre_id(kind: str, name: str, origin: str, gid: str) -> str:
    made = crc(name)
    return f"""CASE {origin}
      WHEN 'object' THEN {gid}
      WHEN 'series' THEN coalesce(nullif(tv_id, 0), nullif(movie_id, 0), {made})
      ELSE CASE WHEN {kind} = 'Episode' THEN coalesce(nullif(tv_id, 0), movie_id, {made})
                ELSE coalesce(nullif(movie_id, 0), tv_id, {made}) END END"""


ITEM_GENRES = f"""{ITEMS}, {GENRE_ENTRIES}, {SERIES}, {REF},
all_entries AS (
  SELECT e.*, k.kind, k.id FROM (SELECT * FROM entries UNION ALL SELECT * FROM inherited) e
  JOIN kept k ON e.i = k.i AND e.copy = k.copy),
item_genres AS (
  SELECT id AS item_id, {genre_id("kind", "gname", "origin", "gid")} AS genre_id, gname AS genre_name
  FROM (SELECT a.*, m.id AS movie_id, t.id AS tv_id FROM all_entries a
        LEFT JOIN movie_ref m ON a.origin <> 'object' AND m.name = lower(a.gname)
        LEFT JOIN tv_ref t ON a.origin <> 'object' AND t.name = lower(a.gname)))
"""


def tags(source: str) -> str:
    return f"""
tag_objects AS (
  SELECT id, copy, 0 AS pos, CAST(NULL AS BIGINT) AS tid, p_brand AS tname FROM {source} WHERE tm = 1
  UNION ALL SELECT id, copy, 1, NULL, p_brand FROM {source} WHERE tm = 1
  UNION ALL SELECT id, copy, 0, p_size, p_brand FROM {source} WHERE tm = 2
  UNION ALL SELECT id, copy, 0, 5, '' FROM {source} WHERE tm = 3
  UNION ALL SELECT id, copy, 1, 5, p_brand FROM {source} WHERE tm = 3),
tag_listed AS (
  SELECT id, copy, 10 AS pos, p_brand AS tname FROM {source} WHERE tn = 1
  UNION ALL SELECT id, copy, 11, w2 FROM {source} WHERE tn IN (1, 2)
  UNION ALL SELECT id, copy, 12, upper(w2) FROM {source} WHERE tn = 1),
tags AS (
  SELECT * FROM tag_objects
  UNION ALL SELECT id, copy, pos, {crc("tname")}, tname FROM tag_listed l
  WHERE NOT EXISTS (SELECT 1 FROM tag_objects o WHERE o.id = l.id AND o.copy = l.copy AND o.tname = l.tname))
"""


OLD_LIBRARY = """
old_library AS (
  SELECT CAST(p_partkey AS VARCHAR) AS item_id, 'old ' || p_name AS item_name,
         CASE p_partkey % 3 WHEN 0 THEN 'Movie' WHEN 1 THEN 'Episode' ELSE 'Trailer' END AS item_type,
         CASE WHEN p_partkey % 4 <> 3 THEN (CAST(p_size AS BIGINT) * 600000000 + 5) // 10000000 END AS runtime_seconds
  FROM part
  UNION ALL SELECT 'gone-' || s_suppkey, s_name, 'Movie', NULL FROM supplier)
"""

TITLES = """
titles AS (
  SELECT CAST(p_partkey AS VARCHAR) AS t_const, CASE WHEN p_partkey % 19 <> 18 THEN p_name END AS primary_name
  FROM part),
genres AS (
  SELECT CAST(p_partkey AS VARCHAR) AS t_const, NULL AS genre FROM part WHERE p_partkey % 17 = 16
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_type FROM part WHERE p_partkey % 17 <> 16
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_brand FROM part WHERE p_partkey % 17 <> 16
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'is ' || split_part(p_name, ' ', 1) FROM part WHERE p_partkey % 17 <> 16
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_type FROM part WHERE p_partkey % 17 <> 16 AND p_partkey % 10 = 9),
tagged AS (SELECT t_const, primary_name, genre FROM titles JOIN genres USING (t_const))
"""

VECTORS = f"""{TITLES},
weights AS (
  SELECT t_const, genre, CAST(count(*) AS DOUBLE) AS weight FROM tagged
  WHERE primary_name IS NOT NULL AND genre IS NOT NULL GROUP BY 1, 2),
units AS (SELECT t_const, genre, weight / sqrt(sum(weight * weight) OVER (PARTITION BY t_const)) AS weight FROM weights),
vectors AS (SELECT t_const FROM titles WHERE primary_name IS NOT NULL)
"""

# The genre vocabulary the driver's part table can produce.
GENRE_COLUMNS = sorted(
    [f"Brand#{n}" for n in range(1, 26)]
    + ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    + ["is blue", "is cold", "is hot", "is large", "is new", "is old", "is red", "is small"]
)

ONEHOT = f"""WITH {TITLES}
SELECT t_const, primary_name,
{", ".join(f'''CAST(sum(CASE WHEN genre = '{g}' THEN 1 ELSE 0 END) AS INTEGER) AS "genre_{g}"''' for g in GENRE_COLUMNS)}
FROM tagged WHERE primary_name IS NOT NULL GROUP BY t_const, primary_name"""


def nearest(k: int, before: str = VECTORS, asked: str = "true") -> str:
    return f"""WITH {before},
shared AS (
  SELECT a.t_const AS title, b.t_const AS neighbour, sum(a.weight * b.weight) AS s
  FROM units a JOIN units b ON a.genre = b.genre AND a.t_const <> b.t_const GROUP BY 1, 2),
scored AS (
  SELECT a.t_const AS title, b.t_const AS neighbour, round(coalesce(s, 0), 9) AS s
  FROM (SELECT * FROM vectors WHERE {asked}) a JOIN vectors b ON a.t_const <> b.t_const
  LEFT JOIN shared ON shared.title = a.t_const AND shared.neighbour = b.t_const),
ranked AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY s DESC, neighbour) AS rank FROM scored)
SELECT title, CAST(rank AS INTEGER) AS rank, neighbour, round(1 - s, 9) AS distance FROM ranked WHERE rank <= {k}"""


TASTE = f"""{SESSIONS}, {VECTORS},
viewed AS (
  SELECT user_id, item_id AS t_const, completion_ratio AS w FROM sessions JOIN vectors ON item_id = t_const
  WHERE completion_ratio IS NOT NULL),
totals AS (SELECT user_id, sum(w) AS total FROM viewed GROUP BY user_id HAVING sum(w) <> 0),
means AS (
  SELECT v.user_id, u.genre, sum(v.w * u.weight) / any_value(total) AS m
  FROM viewed v JOIN totals USING (user_id) JOIN units u USING (t_const) GROUP BY 1, 2),
taste AS (
  SELECT user_id, genre, m / norm AS weight
  FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY user_id)) AS norm FROM means) WHERE norm > 0)
"""

# ---- sources ----------------------------------------------------------------------------------

_PLAYBACK = """SELECT date, time, user_id, item_name, item_id, item_type, CAST(duration AS VARCHAR) AS duration,
  remote_address, user_name, false AS user_has_image FROM raw_events"""
ORACLES["src_playback_log"] = f"WITH {EVENTS} {_PLAYBACK}"
ORACLES["src_playback_log_recent"] = f"WITH {EVENTS} {_PLAYBACK} WHERE CAST(date AS DATE) BETWEEN DATE '2024-01-21' AND DATE '2024-01-31'"
ORACLES["src_catalog_pages"] = f"""WITH {ITEMS}
SELECT id AS "Id", label AS "Name", kind AS "Type", {SERIES_ID} AS "SeriesId", {TICKS} AS "RunTimeTicks",
  {_OWN_WIDTH} AS "Width", {_OWN_HEIGHT} AS "Height", p_retailprice / 100 AS "CommunityRating",
  CAST(CASE WHEN i % 7 IN (0, 1) THEN 0 ELSE 3 END AS BIGINT) AS streams, 'tt' || i AS imdb_id
FROM items"""
ORACLES["src_catalog_totals"] = f"""WITH {ITEMS}
SELECT count(*) AS items_received, count(*) AS items_announced FROM items"""
ORACLES["src_series_metadata"] = f"""WITH {ITEMS}, {GENRE_ENTRIES}, {SERIES}
SELECT sid AS "Id",
  CASE s_suppkey % 4 WHEN 1 THEN '[' || n_nationkey || ', 99, 1]' WHEN 3 THEN '[11]' ELSE '[]' END AS genre_item_ids,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE n_name || '|Small|ring|ring||' || r_name END AS genre_names
FROM series"""
ORACLES["src_users"] = """SELECT c_mktsegment || '-' || c_nationkey AS user_name,
  CAST(max(c_custkey) AS VARCHAR) AS user_id FROM customer GROUP BY 1"""
ORACLES["src_media_folders"] = """SELECT folder_name, CAST(max(s_suppkey) AS VARCHAR) AS folder_id FROM (
  SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN s_name WHEN s_suppkey % 2 = 0 THEN 'type' || s_nationkey
                    ELSE CAST(s_suppkey AS VARCHAR) END AS folder_name FROM supplier) GROUP BY 1"""
ORACLES["src_ref_genres"] = f"""WITH {REF}
SELECT 'movie' AS kind, id, name FROM movie_ref UNION ALL SELECT 'tv', id, name FROM tv_ref"""

CREW = """
crew AS (
  SELECT 'tt' || l_orderkey AS t_const,
    CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'nm' || l_suppkey || ',nm' || l_partkey END AS directors_csv,
    CASE WHEN l_quantity > 40 THEN NULL ELSE 'nm' || l_partkey || ',,nm' || l_linenumber END AS writers_csv
  FROM lineitem)
"""
BASICS_GENRES = """CASE p_partkey % 13 WHEN 0 THEN NULL WHEN 1 THEN ''
  ELSE p_type || ',' || p_brand || ',' || split_part(p_name, ' ', 1) END"""
ORACLES["src_tsv_crew_staging"] = f"WITH {CREW} SELECT * FROM crew"
ORACLES["src_tsv_episodes"] = """SELECT 'tt' || o_orderkey AS t_const, 'tt' || o_custkey AS parent_t_const,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(month(o_orderdate) AS INTEGER) END AS season_num,
  CAST(day(o_orderdate) AS INTEGER) AS episode_num FROM orders"""
ORACLES["src_tsv_titles"] = r"""SELECT 'tt' || p_partkey AS t_const, p_type AS type,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS primary_name,
  '"' || p_name || '\x' AS original_name, CAST(p_partkey % 2 AS INTEGER) AS is_adult,
  CAST(1950 + p_size AS VARCHAR) AS start_year, CAST(NULL AS VARCHAR) AS end_year,
  CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_size END AS runtime_minutes FROM part"""
ORACLES["src_tsv_genres_staging"] = f"SELECT 'tt' || p_partkey AS t_const, {BASICS_GENRES} AS genres FROM part"
ORACLES["src_tsv_persons"] = """SELECT 'nm' || c_custkey AS n_const, c_name AS name,
  CAST(1930 + c_nationkey AS VARCHAR) AS birth_year, CASE WHEN c_acctbal < 0 THEN NULL ELSE '2001' END AS death_year
  FROM customer"""
ORACLES["src_tsv_ratings"] = """SELECT 'tt' || p_partkey AS t_const, p_size / 5 AS avg_rating,
  CAST(p_partkey * 3 AS INTEGER) AS num_votes FROM part"""
ORACLES["src_tsv_roles"] = r"""SELECT 'tt' || l_orderkey AS t_const, 'nm' || l_suppkey AS n_const,
  lower(l_returnflag) AS category, CASE WHEN l_linestatus = 'F' THEN NULL ELSE 'job' END AS job,
  '["' || l_returnflag || '\' AS characters FROM lineitem"""
ORACLES["src_encoded_cache"] = ONEHOT
ORACLES["src_title_genre_query"] = f"WITH {TITLES} SELECT * FROM tagged"
_SESSION_ROWS = "SELECT * REPLACE (round(completion_ratio, 9) AS completion_ratio) FROM sessions"
ORACLES["scan_sessions"] = f"WITH {SESSIONS} {_SESSION_ROWS}"
ORACLES["scan_user_item_stats"] = f"WITH {STATS} SELECT * FROM stats"

# ---- sinks and maintenance ----------------------------------------------------------------------

ORACLES["sink_raw_events"] = f"""WITH {EVENTS}, twice AS (
  SELECT * FROM raw_events WHERE duration % 7 <> 0 UNION ALL SELECT * FROM raw_events)
SELECT date, time, user_id, item_name, item_id, item_type, duration, remote_address, user_name, event_ts FROM twice"""
ORACLES["sink_sessions"] = f"""WITH {SESSIONS}
SELECT session_id, user_id, item_id, session_start_timestamp, outcome, true AS stamped FROM sessions"""
ORACLES["sink_user_item_stats"] = f"""WITH {STATS}
SELECT stat_id, user_id, item_id, total_sessions, total_seconds_watched, adherence_score, true AS stamped FROM stats"""
ORACLES["upsert_library_items"] = f"""WITH {ITEMS}, {OLD_LIBRARY},
new AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY id ORDER BY copy DESC) = 1)
SELECT id AS item_id, label AS item_name, kind AS item_type, {SERIES_ID} AS series_id, {CODEC} AS video_codec,
  {TICKS} // 10000000 AS runtime_seconds FROM new
UNION ALL
SELECT item_id, item_name, item_type, NULL, NULL, runtime_seconds FROM old_library
WHERE item_id NOT IN (SELECT id FROM new)"""
ORACLES["upsert_item_genres"] = f"""WITH {ITEM_GENRES}, {OLD_LIBRARY}
SELECT item_id, CAST(genre_id AS BIGINT) AS genre_id, genre_name FROM item_genres
UNION ALL SELECT item_id, 1, 'old' FROM old_library WHERE item_id NOT IN (SELECT id FROM kept)"""
ORACLES["upsert_item_tags"] = f"""WITH {ITEMS}, {tags("kept")}, {OLD_LIBRARY},
both_tags AS (
  SELECT item_id, CAST(CASE WHEN item_type <> 'Episode' THEN 5 END AS BIGINT) AS tag_id, 'old' AS tag_name,
         -1 AS copy, 0 AS pos FROM old_library
  UNION ALL SELECT id, tid, tname, copy, pos FROM tags)
SELECT item_id, tag_id, tag_name FROM both_tags WHERE tag_id IS NULL
UNION ALL
SELECT item_id, tag_id, tag_name FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, tag_id ORDER BY copy DESC, pos DESC) AS n
  FROM both_tags WHERE tag_id IS NOT NULL) WHERE n = 1"""
_PROVIDERS = """
providers AS (
  SELECT DISTINCT id AS item_id, 'Imdb' AS provider, 'tt' || i AS provider_item_id FROM {source}
  UNION ALL SELECT DISTINCT id, 'Tmdb', CAST(p_size AS VARCHAR) FROM {source} WHERE i % 2 <> 0)
"""
ORACLES["upsert_provider_ids"] = f"""WITH {ITEMS}, {_PROVIDERS.format(source="kept")}, {OLD_LIBRARY}
SELECT * FROM providers
UNION ALL SELECT item_id, 'Tmdb', 'old' FROM old_library
WHERE item_id NOT IN (SELECT item_id FROM providers WHERE provider = 'Tmdb')"""
ORACLES["upsert_ref_genres"] = """WITH both_refs AS (
  SELECT c_custkey AS id, c_name AS name, -1 AS seq FROM customer
  UNION ALL SELECT o_custkey, o_orderpriority || '/' || (o_orderkey % 1000), o_orderkey FROM orders)
SELECT id, name FROM (
  SELECT *, max(seq) OVER (PARTITION BY id) AS by_id, max(seq) OVER (PARTITION BY name) AS by_name FROM both_refs)
WHERE seq = by_id AND seq = by_name"""
ORACLES["prune_missing_items"] = f"""WITH {ITEMS}, {tags("kept")}, {_PROVIDERS.format(source="kept")}, {OLD_LIBRARY},
stay AS (SELECT DISTINCT id FROM kept),
old_stay AS (SELECT * FROM old_library WHERE item_id IN (SELECT id FROM stay)),
tag_rows AS (
  SELECT count(*) AS n FROM tags WHERE tid IS NULL
  UNION ALL SELECT count(*) FROM (
    SELECT DISTINCT id, tid FROM tags WHERE tid IS NOT NULL UNION SELECT item_id, 1 FROM old_stay)),
removed AS (SELECT count(*) AS n FROM old_library WHERE item_id NOT IN (SELECT id FROM stay)),
counts AS (
  SELECT 'library_items' AS table_name, count(*) AS row_count FROM old_stay
  UNION ALL SELECT 'item_genres', count(*) FROM old_stay
  UNION ALL SELECT 'item_tags', CAST(sum(n) AS BIGINT) FROM tag_rows
  UNION ALL SELECT 'item_provider_ids', (SELECT count(*) FROM kept) + (SELECT count(*) FROM kept WHERE i % 2 <> 0))
SELECT table_name, row_count, (SELECT n FROM removed) AS removed FROM counts"""

_CREW_ROWS = """
director_rows AS (SELECT t_const, unnest(string_split(directors_csv, ',')) AS v FROM crew WHERE directors_csv <> ''),
writer_rows AS (SELECT t_const, unnest(string_split(writers_csv, ',')) AS v FROM crew WHERE writers_csv <> '')
"""
_GENRE_ROWS = f"""
basics AS (SELECT 'tt' || p_partkey AS t_const, {BASICS_GENRES} AS genres FROM part),
genre_rows AS (SELECT t_const, unnest(string_split(genres, ',')) AS v FROM basics WHERE genres <> '')
"""
ORACLES["load_imdb_tables"] = f"""WITH {CREW}, {_CREW_ROWS}, {_GENRE_ROWS}
SELECT 'crew_staging' AS table_name, count(*) AS "rows" FROM lineitem
UNION ALL SELECT 'genres_staging', count(*) FROM part
UNION ALL SELECT 'directors', count(*) FROM director_rows
UNION ALL SELECT 'episodes', count(*) FROM orders
UNION ALL SELECT 'genres', count(*) FROM genre_rows
UNION ALL SELECT 'persons', count(*) FROM customer
UNION ALL SELECT 'ratings', count(*) FROM part
UNION ALL SELECT 'titles', count(*) FROM part
UNION ALL SELECT 'writers', count(*) FROM writer_rows
UNION ALL SELECT 'roles', count(*) FROM lineitem"""
ORACLES["load_imdb_contents"] = f"""WITH {CREW}, {_CREW_ROWS}, {_GENRE_ROWS}
SELECT 'directors' AS table_name, t_const, v AS value FROM director_rows
UNION ALL SELECT 'writers', t_const, v FROM writer_rows
UNION ALL SELECT 'genres', t_const, v FROM genre_rows"""
ORACLES["truncate_tables"] = f"""WITH {TITLES}
SELECT 'titles' AS table_name, count(*) AS row_count, CAST(0 AS BIGINT) AS rows_left FROM titles
UNION ALL SELECT 'genres', count(*), 0 FROM genres"""
_METADATA_COLUMNS = {
    "crew_staging": 3, "genres_staging": 2, "directors": 3, "episodes": 4, "genres": 3, "persons": 4, "ratings": 3, "titles": 8,
    "writers": 3, "roles": 6,
}
ORACLES["reset_metadata_tables"] = f"""SELECT table_name, "rows" AS row_count, CAST(0 AS BIGINT) AS rows_left,
  CAST(CASE table_name {' '.join(f"WHEN '{t}' THEN {n}" for t, n in _METADATA_COLUMNS.items())} END AS INTEGER) AS columns
FROM ({ORACLES["load_imdb_tables"]})"""
ORACLES["snapshot_backup"] = f"""WITH {SESSIONS}
SELECT 'raw_events' AS table_name, count(*) AS live_rows, count(*) AS backup_rows FROM events
UNION ALL SELECT 'sessions', count(*), count(*) FROM sessions"""
ORACLES["sink_encoded_cache"] = ONEHOT
ORACLES["table_row_counts"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
    for t in (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
        "pages", "benchmark", "labels", "conversations",
    )
)
ORACLES["count_rows"] = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {source}"
    for name, source in (
        ("crew_staging", "lineitem"), ("episodes", "orders"), ("titles", "part"), ("genres_staging", "part"),
        ("persons", "customer"), ("ratings", "part"), ("roles", "lineitem"),
    )
)
ORACLES["load_metrics"] = f"""WITH {SESSIONS}
SELECT 'raw_events' AS table_name, count(*) AS "rows", true AS timed FROM events
UNION ALL SELECT 'sessions', count(*), true FROM sessions"""
ORACLES["analyze_tables"] = f"""WITH {SESSIONS}
SELECT 'raw_events' AS table_name, count(*) AS row_count FROM events
UNION ALL SELECT 'sessions', count(*) FROM sessions"""
ORACLES["schema_ddl"] = f"""WITH {EVENTS} SELECT row_id, date, time, user_id, item_name, item_id, item_type,
  duration, remote_address, user_name, event_ts FROM raw_events"""

# ---- projections and filters ---------------------------------------------------------------------

_SHIFTED = f"CASE WHEN event_ts < TIMESTAMP '{CUTOFF}' THEN event_ts + INTERVAL 17 HOUR ELSE event_ts END"
ORACLES["normalize_tz"] = f"""WITH {EVENTS}, shifted AS (SELECT row_id, {_SHIFTED} AS event_ts FROM raw_events)
SELECT row_id, strftime(event_ts, '%Y-%m-%d') AS date, strftime(event_ts, '%H:%M:%S') AS time, event_ts FROM shifted"""
ORACLES["project_raw_event"] = f"""WITH {EVENTS}
SELECT date, time, user_id, item_name, item_id, item_type, duration, coalesce(remote_address, '') AS remote_address,
  user_name, event_ts FROM raw_events"""
ORACLES["project_library_item"] = f"""WITH {ITEMS}
SELECT id AS item_id, label AS item_name, kind AS item_type,
  CASE WHEN kind = 'Episode' THEN 'Series ' || (i % 150) END AS series_name, {SERIES_ID} AS series_id,
  p_size % 10 AS season_number, p_size AS episode_number, {TICKS} AS runtime_ticks,
  (1950 + p_size) || '-01-01' AS premiere_date, p_name || ' ' || p_type AS overview,
  round(p_retailprice / 100, 9) AS community_rating, 1950 + p_size AS production_year, '/media/' || i AS file_path,
  CASE WHEN i % 2 = 0 THEN 'mkv' ELSE 'mp4' END AS container, {CODEC} AS video_codec,
  {WIDTH} AS resolution_width, {HEIGHT} AS resolution_height
FROM items"""
ORACLES["generated_columns"] = f"""WITH {ITEMS}
SELECT id AS item_id, label AS item_name, {TICKS} // 10000000 AS runtime_seconds,
  round({TICKS} / 600000000e0, 9) AS runtime_minutes FROM items"""
ORACLES["filter_item_types"] = f"""WITH {ITEMS}
SELECT id AS "Id", label AS "Name", kind AS "Type" FROM kept WHERE i % 5 = 2"""
ORACLES["filter_nonblank"] = f"WITH {CREW} SELECT * FROM crew WHERE directors_csv <> ''"
ORACLES["filter_truthy_pid"] = f"""WITH {ITEMS}
SELECT id AS item_id, 'Imdb' AS provider, 'tt' || i AS provider_item_id FROM items
UNION ALL SELECT id, 'Tmdb', CAST(p_size AS VARCHAR) FROM items WHERE i % 2 <> 0"""
ORACLES["filter_exists_runtime"] = f"""WITH {SESSIONS}
SELECT session_id, user_id, item_id, total_seconds_watched FROM sessions s
WHERE EXISTS (SELECT 1 FROM lib l WHERE l.item_id = s.item_id AND l.runtime_seconds > 0)"""
ORACLES["first_video_stream"] = f"""WITH {ITEMS} SELECT id AS "Id", label AS "Name", {CODEC} AS video_codec FROM items"""
ORACLES["resolution_fallback"] = f"""WITH {ITEMS}
SELECT id AS "Id", label AS "Name", {WIDTH} AS resolution_width, {HEIGHT} AS resolution_height FROM items"""
ORACLES["select_genre_columns"] = f"""WITH {TITLES}
SELECT t_const, CAST((SELECT count(DISTINCT genre) FROM tagged) AS INTEGER) AS genre_columns,
  CAST(count(genre) AS INTEGER) AS tags FROM tagged WHERE primary_name IS NOT NULL GROUP BY t_const"""
ORACLES["column_rename"] = f"""WITH {SESSIONS} SELECT user_id, item_id AS "Item ID", session_count FROM sessions"""

# ---- joins ----------------------------------------------------------------------------------------

ORACLES["sessions_runtime_lookup"] = f"""WITH {SESSIONS}
SELECT s.user_id, s.item_id, session_start_timestamp,
  (SELECT runtime_seconds FROM lib l WHERE l.item_id = s.item_id) AS runtime_seconds FROM sessions s"""
ORACLES["stats_left_join"] = f"""WITH {SESSIONS}
SELECT s.user_id, s.item_id, session_start_timestamp, total_seconds_watched, l.runtime_seconds,
  l.item_type AS library_item_type FROM sessions s LEFT JOIN lib l ON s.item_id = l.item_id"""
_SESSION_GENRES = f"""WITH {SESSIONS}, {ITEM_GENRES}
SELECT s.user_id, s.item_id, l.item_name, g.genre_name FROM sessions s
JOIN lib l ON s.item_id = l.item_id JOIN item_genres g ON l.item_id = g.item_id"""
ORACLES["sessions_items_genres"] = _SESSION_GENRES
ORACLES["titles_genres_join"] = f"WITH {TITLES} SELECT * FROM tagged"
ORACLES["update_completion_ratios"] = f"""WITH {sessions(runtime="CAST(NULL AS BIGINT)")}
SELECT session_id, s.user_id, s.item_id,
  round(CASE WHEN l.runtime_seconds > 0 THEN least(1e0, total_seconds_watched / CAST(l.runtime_seconds AS DOUBLE))
             ELSE completion_ratio END, 9) AS completion_ratio, outcome
FROM sessions s LEFT JOIN lib l ON s.item_id = l.item_id"""
ORACLES["genre_id_lookup"] = f"""WITH {ITEMS}, {REF},
listed AS (
  SELECT id, label, kind, unnest([w1, '', w2, w1]) AS g FROM items WHERE gn = 2
  UNION ALL SELECT id, label, kind, unnest([upper(w1), p_type, p_brand]) FROM items WHERE gn = 3)
SELECT l.id AS item_id, label AS item_name, kind AS item_type, g AS genre_name,
  CASE WHEN g = '' THEN 0 ELSE {genre_id("kind", "g", "'item'", "NULL")} END AS genre_id
FROM (SELECT l.*, m.id AS movie_id, t.id AS tv_id FROM listed l
      LEFT JOIN movie_ref m ON m.name = lower(g) LEFT JOIN tv_ref t ON t.name = lower(g)) l"""
ORACLES["series_genre_fallback"] = f"""WITH {ITEMS}, {GENRE_ENTRIES}, {SERIES}, both_sides AS (
  SELECT i, gname, origin FROM entries UNION ALL SELECT i, gname, origin FROM inherited)
SELECT CAST(i AS VARCHAR) AS item_id, gname AS genre_name, origin FROM both_sides
WHERE origin = 'series' OR gname IS NULL"""
ORACLES["prune_anti_semi"] = f"""WITH {ITEMS}, {OLD_LIBRARY}
SELECT 'old' AS genre_name, count(*) AS rows_kept, count(DISTINCT item_id) AS items_kept FROM old_library
WHERE item_id IN (SELECT id FROM items)"""
ORACLES["lateral_split"] = f"WITH {CREW}, {_CREW_ROWS} SELECT t_const, v AS n_const FROM writer_rows"
ORACLES["stats_with_item_names"] = f"""WITH {STATS}
SELECT user_id, s.item_id, item_name, total_sessions AS num_plays, total_minutes_watched,
  average_completion_ratio AS avg_fraction_completed, first_watched_timestamp AS first_watch_at,
  last_watched_timestamp AS last_watch_at FROM stats s LEFT JOIN lib l ON s.item_id = l.item_id"""

# ---- aggregations -----------------------------------------------------------------------------------

ORACLES["sessions_agg"] = f"WITH {SESSIONS} {_SESSION_ROWS}"
ORACLES["sessions_agg_15_minutes"] = f"WITH {sessions(15, '0.5', '0.1', 30)} {_SESSION_ROWS}"
ORACLES["user_item_stats"] = f"WITH {STATS} SELECT * FROM stats"
ORACLES["conditional_counts"] = f"WITH {SESSIONS} SELECT item_id, {_OUTCOMES} FROM sessions GROUP BY item_id"
ORACLES["session_summary"] = f"""WITH {SESSIONS}
SELECT count(DISTINCT user_id) AS unique_users, count(DISTINCT item_id) AS unique_items, count(*) AS total_sessions,
  round(avg(session_span_minutes), 9) AS avg_session_minutes,
  round(avg(total_seconds_watched / 60e0), 9) AS avg_watch_minutes FROM sessions"""
ORACLES["outcome_distribution"] = f"""WITH {SESSIONS}
SELECT outcome, count(*) AS "count" FROM sessions GROUP BY outcome ORDER BY "count" DESC, outcome"""
ORACLES["onehot_genres"] = ONEHOT
ORACLES["genre_counts"] = f"""WITH {TITLES}
SELECT t_const, primary_name, genre, count(*) AS weight FROM tagged WHERE primary_name IS NOT NULL GROUP BY ALL"""
ORACLES["title_genre_counts"] = ORACLES["genre_counts"]
_NUMBERS = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS "count", CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top,
  CAST(NULL AS BIGINT) AS freq, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std,
  round(CAST(min({c}) AS DOUBLE), 2) AS "min", round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 2) AS p25,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 2) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 2) AS p75,
  round(CAST(max({c}) AS DOUBLE), 2) AS "max" FROM sessions"""
    for c in ("session_span_minutes", "total_seconds_watched", "session_count", "completion_ratio")
)
_TEXTS = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS column_name, CAST(sum(n) OVER () AS BIGINT) AS "count", count(*) OVER () AS "unique",
  v AS top, n AS freq, NULL AS mean, NULL AS std, NULL AS "min", NULL AS p25, NULL AS p50, NULL AS p75, NULL AS "max"
  FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM sessions WHERE {c} IS NOT NULL GROUP BY 1)
  ORDER BY n DESC, v LIMIT 1)"""
    for c in ("user_id", "item_id", "session_start_timestamp", "session_end_timestamp", "outcome")
)
ORACLES["describe_sessions"] = f"WITH {SESSIONS} {_NUMBERS} UNION ALL {_TEXTS}"
_HISTOGRAM = """
SELECT '{c}' AS column_name, b AS bin, round(w * (b - 1), 9) AS bin_start,
  (SELECT count(*) FROM sessions WHERE least(CAST(floor({c} / w) AS BIGINT), 49) + 1 = b) AS sessions
FROM (SELECT CAST(b AS INTEGER) AS b, (SELECT CAST(max({c}) AS DOUBLE) / 50e0 FROM sessions) AS w FROM range(1, 51) t(b))
"""
ORACLES["session_histograms"] = f"WITH {SESSIONS} " + " UNION ALL ".join(
    _HISTOGRAM.format(c=c) for c in ("total_seconds_watched", "session_span_minutes", "session_count")
)

# ---- windows ----------------------------------------------------------------------------------------

ORACLES["win_prev_event"] = f"WITH {marked()} SELECT row_id, event_ts, prev_ts AS prev_event_timestamp FROM marked"
ORACLES["win_session_boundary"] = f"WITH {marked()} SELECT row_id, is_new AS is_new_session FROM marked"
ORACLES["win_session_group"] = f"WITH {marked()} SELECT row_id, user_id, item_id, grp AS session_group_id FROM marked"
ORACLES["gap_sessions"] = f"""WITH {SESSIONS}
SELECT user_id, item_id, grp AS session_group_id, s AS session_start_timestamp, e AS session_end_timestamp,
  w AS total_seconds_watched, n AS session_count FROM grouped"""

# ---- sorts, limits, sets ---------------------------------------------------------------------------

ORACLES["order_sessions"] = f"""WITH {SESSIONS}
SELECT session_id, user_id, item_id, session_start_timestamp FROM sessions
ORDER BY user_id, item_id, session_start_timestamp"""
ORACLES["order_outcomes"] = f"""WITH {SESSIONS}
SELECT outcome FROM (SELECT outcome, count(*) AS n FROM sessions GROUP BY outcome) ORDER BY n DESC, outcome"""
ORACLES["head_items"] = f"{_SESSION_GENRES} ORDER BY 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST, 4 NULLS FIRST LIMIT 10"
ORACLES["topk_neighbours"] = f"SELECT title, neighbour, distance FROM ({nearest(1)})"
ORACLES["set_difference_ids"] = f"""WITH {ITEMS}, {OLD_LIBRARY}
SELECT item_id FROM old_library EXCEPT SELECT id FROM kept"""
ORACLES["genre_source_concat"] = f"""WITH {ITEMS}, {GENRE_ENTRIES}
SELECT CAST(i AS VARCHAR) AS item_id, gid AS genre_id, gname AS genre_name, origin FROM entries"""
ORACLES["tag_source_concat"] = f"""WITH {ITEMS}, {tags("items")}
SELECT id AS item_id, CAST(tid AS BIGINT) AS tag_id, tname AS tag_name FROM tags"""
ORACLES["item_genres"] = f"""WITH {ITEM_GENRES}
SELECT item_id, CAST(genre_id AS BIGINT) AS genre_id, genre_name FROM item_genres"""

# ---- scalar functions ---------------------------------------------------------------------------------

ORACLES["scalar_functions"] = rf"""WITH {EVENTS}
SELECT row_id, event_ts AS parsed, strftime(event_ts + INTERVAL 17 HOUR, '%Y-%m-%d %H:%M:%S') AS later,
  date_diff('second', event_ts, TIMESTAMP '2024-01-31') AS seconds_left,
  date_diff('second', event_ts, TIMESTAMP '2024-01-31') // 60 AS minutes_left,
  round(date_diff('second', event_ts, TIMESTAMP '2024-01-31') / 86400e0, 9) AS days_left,
  round(CASE WHEN duration <> 0 THEN least(1e0, duration / 500e0) END, 9) AS capped,
  CAST(duration AS DOUBLE) AS as_real, duration // 7 AS as_int,
  CASE WHEN duration >= 1200 THEN 'long' WHEN duration >= 300 THEN 'middle' ELSE 'short' END AS graded,
  CASE WHEN duration % 2 <> 0 THEN item_name END AS unmarked, 3 AS csv_parts, '' AS csv_second,
  {crc("item_name")} AS name_id, lower(item_name) AS lowered, round(duration / 7e0, 2) AS two_digits
FROM raw_events"""
ORACLES["fn_map_items"] = f"""WITH {ITEMS}
SELECT id AS "Id", label AS "Name", 'Imdb' AS provider, 'tt' || i AS provider_item_id FROM items
UNION ALL SELECT id, label, 'Tmdb', CASE WHEN i % 2 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END FROM items"""

# ---- vectors and neighbours -------------------------------------------------------------------------

ORACLES["genre_vectors"] = f"WITH {VECTORS} SELECT t_const, genre, weight FROM weights"
ORACLES["l2_normalize"] = f"WITH {VECTORS} SELECT t_const, genre, round(weight, 9) AS weight FROM units"
ORACLES["l2_normalize_dense"] = """WITH cells AS (
  SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS position,
         CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT vec_id, position, round(CASE WHEN norm > 0 THEN x / norm ELSE x END, 9) AS weight
FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS norm FROM cells)"""
ORACLES["knn_similar_titles"] = nearest(5)
ORACLES["knn_similar_titles_encoded"] = nearest(5)
ORACLES["knn_of_watched_titles"] = nearest(
    5, f"{SESSIONS}, {VECTORS}", "t_const IN (SELECT item_id FROM sessions)"
)
ORACLES["knn_dense_vectors"] = """WITH cells AS (
  SELECT vec_id, unnest(range(0, len(embedding))) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
units AS (SELECT vec_id, p, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM cells),
scored AS (
  SELECT a.vec_id AS title, b.vec_id AS neighbour, round(sum(a.x * b.x), 9) AS s
  FROM units a JOIN units b ON a.p = b.p AND a.vec_id <> b.vec_id GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY s DESC, neighbour) AS rank FROM scored)
SELECT title, CAST(rank AS INTEGER) AS rank, neighbour, round(1 - s, 9) AS distance FROM ranked WHERE rank <= 5"""
ORACLES["user_taste_vector"] = f"WITH {TASTE} SELECT user_id, genre, round(weight, 9) AS weight FROM taste"
ORACLES["knn_for_user"] = f"""WITH {TASTE},
shared AS (SELECT user_id, u.t_const, sum(t.weight * u.weight) AS s FROM taste t JOIN units u USING (genre) GROUP BY 1, 2),
scored AS (
  SELECT p.user_id, v.t_const, round(coalesce(s, 0), 9) AS s
  FROM (SELECT DISTINCT user_id FROM taste) p JOIN vectors v ON true
  LEFT JOIN shared ON shared.user_id = p.user_id AND shared.t_const = v.t_const),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, t_const) AS rank FROM scored)
SELECT user_id, CAST(rank AS INTEGER) AS rank, t_const AS title, round(1 - s, 9) AS distance FROM ranked WHERE rank <= 20"""

_FOR_USER = ORACLES["knn_for_user"]
ORACLES["because_you_watched"] = f"""SELECT n.title, t.primary_name AS title_name, n.rank, n.neighbour, u.primary_name AS neighbour_name, n.distance
FROM ({ORACLES["knn_of_watched_titles"]}) n
JOIN (WITH {TITLES} SELECT * FROM titles) t ON t.t_const = n.title JOIN (WITH {TITLES} SELECT * FROM titles) u ON u.t_const = n.neighbour"""
ORACLES["recommend_for_users"] = f"""SELECT n.user_id, n.rank, n.title, t.primary_name AS title_name, n.distance
FROM ({_FOR_USER}) n JOIN (WITH {TITLES} SELECT * FROM titles) t ON t.t_const = n.title"""
ORACLES["recommend_unseen"] = f"""WITH {TASTE},
shared AS (SELECT user_id, u.t_const, sum(t.weight * u.weight) AS s FROM taste t JOIN units u USING (genre) GROUP BY 1, 2),
scored AS (
  SELECT p.user_id, v.t_const, round(coalesce(s, 0), 9) AS s
  FROM (SELECT DISTINCT user_id FROM taste) p JOIN vectors v ON true
  LEFT JOIN shared ON shared.user_id = p.user_id AND shared.t_const = v.t_const
  WHERE NOT EXISTS (SELECT 1 FROM sessions w WHERE w.user_id = p.user_id AND w.item_id = v.t_const)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, t_const) AS rank FROM scored)
SELECT user_id, CAST(rank AS INTEGER) AS rank, t_const AS title, t.primary_name AS title_name, round(1 - s, 9) AS distance
FROM ranked JOIN titles t USING (t_const) WHERE rank <= 5"""
ORACLES["top_genres_of_users"] = f"""WITH {SESSIONS}, {TITLES},
of_item AS (SELECT DISTINCT t_const AS item_id, genre FROM tagged WHERE genre IS NOT NULL),
counted AS (SELECT user_id, genre AS genre_name, count(*) AS sessions FROM sessions JOIN of_item USING (item_id) GROUP BY 1, 2)
SELECT user_id, CAST(rank AS INTEGER) AS rank, genre_name, sessions FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sessions DESC, genre_name) AS rank FROM counted) WHERE rank <= 5"""
ORACLES["top_items_of_users"] = f"""WITH {STATS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total_seconds_watched DESC, item_id) AS rank FROM stats)
SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, item_name, total_seconds_watched
FROM ranked LEFT JOIN lib USING (item_id) WHERE rank <= 5"""

# ---- constraints --------------------------------------------------------------------------------------

ORACLES["dq_unique"] = """SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1"""
ORACLES["dq_not_null"] = f"""WITH {ITEMS}
SELECT 'item_id' AS column_name, count(*) - count(id) AS null_count FROM items
UNION ALL SELECT 'series_id', count(*) - count({SERIES_ID}) FROM items
UNION ALL SELECT 'runtime_ticks', count(*) - count({TICKS}) FROM items
UNION ALL SELECT 'resolution_width', count(*) - count({WIDTH}) FROM items"""
ORACLES["dq_foreign_key"] = f"""WITH {EVENTS}, {LIBRARY}
SELECT item_id, count(*) AS row_count FROM raw_events e
WHERE NOT EXISTS (SELECT 1 FROM lib l WHERE l.item_id = e.item_id) GROUP BY item_id"""
ORACLES["dq_max_length"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, {n} AS max_length, CAST(sum(CASE WHEN length({c}) > {n} THEN 1 ELSE 0 END) AS BIGINT)
  AS too_long, max(length({c})) AS longest FROM documents"""
    for c, n in (("text", 512), ("source", 12), ("lang", 2))
)

# ---- whole jobs ---------------------------------------------------------------------------------------

# The refreshed library holds Movies and Episodes only, and events before the cutoff move by 17 hours.
_REFRESHED = (
    STATS.replace("FROM part)", "FROM part WHERE p_partkey % 3 <> 2)", 1)
    .replace("date_trunc('second', ts) AS event_ts", "CASE WHEN date_trunc('second', ts) < TIMESTAMP "
             f"'{CUTOFF}' THEN date_trunc('second', ts) + INTERVAL 17 HOUR ELSE date_trunc('second', ts) END AS event_ts", 1)
)
ORACLES["refresh_watch_history"] = f"WITH {_REFRESHED} SELECT * FROM stats"
