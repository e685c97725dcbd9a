"""DuckDB statements that state each registered query independently.

They run on the raw driver tables (``events`` is a pre-registered view) and
re-derive every step by brute force: the hop is a cross join with
``range(analytic)``, distincts are plain ``DISTINCT``, the reference frame a
SQL window, the recurrent vector a grid of all slots.  Used by the driver's
correctness gate and by ``tests/test_oracle.py``.
"""

from __future__ import annotations

from hashtrend.config import Windows


def _ctes(win: Windows) -> str:
    b = win.batch_us
    a, h, r = win.analytic, win.half, win.reference
    rw, rs = win.rec_window, win.rec_slide
    return f"""
posts AS (
  SELECT event_id AS post_id, ts, 'u' || user_id AS screen_name,
         '#' || event_type
         || CASE WHEN event_id % 3 = 0 THEN ' #k' || json_extract_string(props, '$.k') ELSE '' END
         || CASE WHEN event_id % 5 = 0 THEN ' #' || event_type ELSE ' word' END AS text,
         CAST(user_id * 37 % 1000 AS INTEGER) AS followers_count,
         CAST(user_id * 17 % 500 AS INTEGER) AS friends_count,
         CASE WHEN event_type = 'view' THEN CAST(floor(value) AS INTEGER) END AS retweet_count
  FROM events),
tagged AS (
  SELECT *, list_filter(string_split(text, ' '), lambda x: starts_with(x, '#')) AS tags,
         epoch_us(ts) // {b} AS slot
  FROM posts),
occ AS (
  SELECT post_id, slot, screen_name, followers_count, friends_count, retweet_count, tags,
         unnest(tags) AS tag
  FROM tagged),
hopped AS (
  SELECT o.*, o.slot + 1 + r.i AS w_idx, r.i AS i FROM occ o CROSS JOIN range({a}) r(i)),
base AS (
  SELECT w_idx, tag, count(*) AS volume,
         CAST(sum(CASE WHEN i < {h} THEN 1 ELSE 0 END) AS BIGINT) AS half_volume,
         count(DISTINCT screen_name) AS unique_users,
         CAST(sum(followers_count) AS BIGINT) AS follower_reach,
         CAST(sum(friends_count) AS BIGINT) AS friend_reach,
         CAST(sum(retweet_count) AS BIGINT) AS retweeted_volume
  FROM hopped GROUP BY w_idx, tag),
post_tags AS (
  SELECT DISTINCT slot, unnest(list_distinct(tags)) AS tag, list_distinct(tags) AS dtags
  FROM tagged WHERE len(tags) > 0),
slot_pairs AS (
  SELECT DISTINCT slot, tag, unnest(dtags) AS neighbour FROM post_tags),
pairs AS (
  SELECT DISTINCT p.slot + 1 + r.i AS w_idx, p.tag, p.neighbour
  FROM slot_pairs p CROSS JOIN range({a}) r(i)),
degree AS (
  SELECT p.w_idx, p.tag, count(*) AS activeness, CAST(sum(b.volume) AS BIGINT) AS first_degree
  FROM pairs p JOIN base b ON b.w_idx = p.w_idx AND b.tag = p.neighbour
  GROUP BY p.w_idx, p.tag),
smoothed AS (
  SELECT d.w_idx + r.j AS w_idx, d.tag, CAST(sum(d.first_degree) AS BIGINT) AS first_degree_smoothed
  FROM degree d CROSS JOIN range({a}) r(j) GROUP BY 1, 2),
totals AS (
  SELECT w_idx, CAST(sum(volume) AS BIGINT) AS total_volume FROM base GROUP BY w_idx),
share AS (
  SELECT b.*, t.total_volume, CAST(b.volume AS DOUBLE) / t.total_volume AS percent_share
  FROM base b JOIN totals t USING (w_idx)),
ref AS (
  SELECT s.*,
         avg(percent_share) OVER w AS reference_share_mean,
         list_reduce(list(percent_share) OVER w, lambda acc, x: (acc + x) / 2) AS reference_share_halving
  FROM share s
  WINDOW w AS (PARTITION BY tag ORDER BY w_idx RANGE BETWEEN {r - 1} PRECEDING AND CURRENT ROW)),
ind AS (
  SELECT f.*, d.activeness, d.first_degree,
         CASE WHEN f.half_volume > 0 THEN 2 * f.half_volume - f.volume END AS velocity,
         f.percent_share - f.reference_share_mean AS delta_share,
         f.percent_share - f.reference_share_halving AS delta_share_halving
  FROM ref f JOIN degree d USING (w_idx, tag)),
fv AS (
  SELECT i.w_idx + r.j AS w_idx, i.tag,
         max(CASE WHEN r.j = 0 THEN i.volume END) AS volume,
         max(CASE WHEN r.j = 0 THEN i.unique_users END) AS unique_users,
         max(CASE WHEN r.j = 0 THEN i.activeness END) AS activeness,
         CAST(sum(i.first_degree) AS BIGINT) AS first_degree_smoothed
  FROM ind i CROSS JOIN range({a}) r(j) GROUP BY 1, 2),
fv_text AS (
  SELECT w_idx, tag, volume,
         coalesce(volume, 0) || ' ' || coalesce(unique_users, 0) || ' ' || coalesce(activeness, 0)
           || ' ' || first_degree_smoothed AS features
  FROM fv),
rec_entries AS (
  SELECT f.w_idx + d.d AS r_idx, f.tag, {rw - 1} - d.d AS pos, f.features
  FROM fv_text f CROSS JOIN range({rw}) d(d)
  WHERE (f.w_idx + d.d) % {rs} = 0),
rec_keys AS (
  SELECT DISTINCT r_idx, tag FROM rec_entries
  WHERE r_idx IN (SELECT w_idx FROM fv)),
rec_grid AS (
  SELECT k.r_idx, k.tag, p.pos, coalesce(e.features, '0 0 0 0') AS features
  FROM rec_keys k CROSS JOIN range({rw}) p(pos)
  LEFT JOIN rec_entries e ON e.r_idx = k.r_idx AND e.tag = k.tag AND e.pos = p.pos),
rec AS (
  SELECT r_idx AS w_idx, tag, string_agg(features, ' ' ORDER BY pos) AS features
  FROM rec_grid GROUP BY 1, 2),
rec_newest AS (
  SELECT w_idx, tag, features,
         CAST(split_part(features, ' ', {(rw - 1) * win.n_features + 1}) AS DOUBLE) AS value FROM rec),
raw AS (
  SELECT CAST(post_id AS VARCHAR) AS key, post_id,
         CASE WHEN post_id % 7 = 0 THEN '{{"delete":{{"status":{{"id":' || post_id || '}}}}}}'
              WHEN post_id % 11 = 0 THEN 'x'
              ELSE '{{"id":' || post_id || ',"timestamp_ms":"' || (epoch_us(ts) // 1000) || '","text":"' || text
                   || '","user":{{"screen_name":"' || screen_name || '","followers_count":' || followers_count
                   || ',"friends_count":' || friends_count || '}}'
                   || CASE WHEN retweet_count IS NOT NULL
                           THEN ',"retweeted_status":{{"retweet_count":' || retweet_count || '}}' ELSE '' END
                   || '}}' END AS value
  FROM posts)"""


def _end(win: Windows, col: str = "w_idx") -> str:
    return f"make_timestamp({col} * {win.batch_us})"


def _top(win: Windows, source: str, value: str, n: int = 10, round_to: int | None = None, order: str | None = None) -> str:
    v = f"(round({value}, {round_to}) + 0.0)" if round_to is not None else value
    order = order or value
    return f"""
SELECT {_end(win)} AS w_end, CAST(rk AS INTEGER) AS rank, tag, {v} AS value, n_total FROM (
  SELECT w_idx, tag, {value},
         row_number() OVER (PARTITION BY w_idx ORDER BY {order} DESC, tag ASC) AS rk,
         count(*) OVER (PARTITION BY w_idx) AS n_total
  FROM {source} WHERE {value} IS NOT NULL) WHERE rk <= {n}"""


# Indicators ranked by the per-metric reports (O1): name -> (source, column, rounding).
TOP_METRICS = {
    "volume": ("ind", "volume", None),
    "velocity": ("ind", "velocity", None),
    "unique_users": ("ind", "unique_users", None),
    "follower_reach": ("ind", "follower_reach", None),
    "friend_reach": ("ind", "friend_reach", None),
    "retweeted_volume": ("ind", "retweeted_volume", None),
    "activeness": ("ind", "activeness", None),
    "first_degree_smoothed": ("smoothed", "first_degree_smoothed", None),
    "percent_share": ("ind", "percent_share", 6),
}


def statements(win: Windows) -> dict[str, str]:
    e = _end(win)
    body = {
        "delete_filter": "SELECT key, value FROM raw WHERE post_id % 7 <> 0",
        "posts_bad": "SELECT key, value FROM raw WHERE post_id % 7 <> 0 AND post_id % 11 = 0",
        "posts_decode": (
            "SELECT post_id, make_timestamp((epoch_us(ts) // 1000) * 1000) AS ts, screen_name, text, "
            "followers_count, friends_count, retweet_count FROM posts "
            "WHERE post_id % 7 <> 0 AND post_id % 11 <> 0"
        ),
        "hashtags": (
            "SELECT post_id, CAST(unnest(range(len(tags))) AS INTEGER) AS pos, unnest(tags) AS tag, "
            "screen_name, followers_count, friends_count, retweet_count, CAST(len(tags) AS INTEGER) AS n_tags "
            "FROM tagged"
        ),
        "co_tags": f"SELECT {e} AS w_end, tag, neighbour FROM pairs",
        "volume": f"SELECT {e} AS w_end, tag, volume FROM base",
        "half_volume": f"SELECT {e} AS w_end, tag, half_volume FROM base",
        "velocity": f"SELECT {e} AS w_end, tag, velocity FROM ind WHERE velocity IS NOT NULL",
        "velocity_with_cooling": f"SELECT {e} AS w_end, tag, 2 * half_volume - volume AS velocity FROM base",
        "unique_users": f"SELECT {e} AS w_end, tag, unique_users FROM base",
        "approx_unique_users": f"SELECT {e} AS w_end, tag, unique_users, true AS within_error FROM base",
        "follower_reach": f"SELECT {e} AS w_end, tag, follower_reach FROM base",
        "friend_reach": f"SELECT {e} AS w_end, tag, friend_reach FROM base",
        "retweeted_volume": (
            f"SELECT {e} AS w_end, tag, retweeted_volume FROM base WHERE retweeted_volume IS NOT NULL"
        ),
        "activeness": f"SELECT {e} AS w_end, tag, activeness FROM degree",
        "approx_activeness": f"SELECT {e} AS w_end, tag, activeness, true AS within_error FROM degree",
        "first_degree": f"SELECT {e} AS w_end, tag, first_degree FROM degree",
        "first_degree_smoothed": f"SELECT {e} AS w_end, tag, first_degree_smoothed FROM smoothed",
        "total_volume": f"SELECT {e} AS w_end, total_volume FROM totals",
        "percent_share": f"SELECT {e} AS w_end, tag, (round(percent_share, 6) + 0.0) AS percent_share FROM share",
        "reference_share": (
            f"SELECT {e} AS w_end, tag, (round(reference_share_mean, 6) + 0.0) AS reference_share_mean, "
            "(round(reference_share_halving, 6) + 0.0) AS reference_share_halving FROM ref"
        ),
        "delta_share": (
            f"SELECT {e} AS w_end, tag, (round(delta_share, 6) + 0.0) AS delta_share, "
            "(round(delta_share_halving, 6) + 0.0) AS delta_share_halving FROM ind"
        ),
        "indicators": (
            f"SELECT {e} AS w_end, tag, volume, half_volume, velocity, unique_users, follower_reach, "
            "friend_reach, retweeted_volume, activeness, first_degree, total_volume, "
            "(round(percent_share, 6) + 0.0) AS percent_share, (round(reference_share_mean, 6) + 0.0) AS reference_share_mean, "
            "(round(reference_share_halving, 6) + 0.0) AS reference_share_halving, (round(delta_share, 6) + 0.0) AS delta_share, "
            "(round(delta_share_halving, 6) + 0.0) AS delta_share_halving FROM ind"
        ),
        "feature_vectors": f"SELECT {e} AS w_end, tag, features FROM fv_text",
        "assembled_vectors": f"SELECT {e} AS w_end, tag, features FROM fv_text",
        "recurrent_vectors": f"SELECT {e} AS w_end, tag, features FROM rec",
        "top_tags": _top(win, "ind", "volume"),
        "top_delta_share": _top(win, "ind", "delta_share", round_to=6, order="round(delta_share, 9)"),
        "top_vectors": f"""
SELECT {e} AS w_end, CAST(rk AS INTEGER) AS rank, tag, value, n_total, features FROM (
  SELECT w_idx, tag, value, features,
         row_number() OVER (PARTITION BY w_idx ORDER BY value DESC, tag ASC) AS rk,
         count(*) OVER (PARTITION BY w_idx) AS n_total
  FROM rec_newest) WHERE rk <= 10""",
    }
    for name, (src, col, rnd) in TOP_METRICS.items():
        if name != "volume":
            body[f"top_{name}"] = _top(win, src, col, round_to=rnd)
    reports = {name: _top(win, src, col) for name, (src, col, _) in TOP_METRICS.items()}
    reports["delta_share"] = _top(win, "ind", "delta_share", order="round(delta_share, 9)")
    body["top_all"] = " UNION ALL ".join(
        f"SELECT w_end, '{name}' AS metric, rank, tag, (round(CAST(value AS DOUBLE), 6) + 0.0) AS value, n_total FROM ({report})"
        for name, report in reports.items()
    )
    ctes = _ctes(win)
    return {k: f"WITH {ctes}\n{v}" for k, v in body.items()}
