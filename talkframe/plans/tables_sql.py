"""SQL twins of the adapters, as common table expressions."""

TOKENS = r"""
pieces AS (
    SELECT conv_id AS session_id, turn, role, unnest(ws) AS piece, generate_subscripts(ws, 1) - 1 AS pos
    FROM (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D.!?]+|[.!?]+') AS ws FROM conversations)),
timed AS (
    SELECT *, CASE WHEN regexp_matches(piece, '^[.!?]') THEN 0 ELSE 20 + 4 * length(piece) END AS lasts,
        CASE WHEN pos = 0 THEN 100 * (turn * 7 % 11) ELSE 0 END AS gap FROM pieces),
tokens AS (
    SELECT session_id, turn, pos, role, CASE WHEN regexp_matches(piece, '^[.!?]') THEN piece ELSE ' ' || piece END AS text,
        row_number() OVER w AS seq, CAST(sum(gap + lasts) OVER w AS BIGINT) AS end_cs, CAST(sum(gap + lasts) OVER w - lasts AS BIGINT) AS start_cs
    FROM timed WINDOW w AS (PARTITION BY session_id ORDER BY turn, pos, piece ROWS UNBOUNDED PRECEDING))"""

TURNS = """
turns AS (SELECT session_id, turn, min(start_cs) AS a, max(end_cs) AS b, min(role) AS role, min(seq) AS seq FROM tokens GROUP BY session_id, turn)"""

SPANS = """
spans AS (
    SELECT session_id, turn AS span_no, greatest(a + (turn % 3 - 1) * 15, 0) AS start_cs, b + (turn % 3 - 1) * 15 AS end_cs,
        CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS speaker
    FROM (SELECT *, max(turn) OVER (PARTITION BY session_id) AS last FROM turns) WHERE session_id % 4 <> 0 OR turn < last)"""

TIMELINE = """
before AS (SELECT *, coalesce(lag(end_cs) OVER (PARTITION BY session_id ORDER BY seq), 0) AS before FROM tokens),
timeline AS (
    SELECT session_id, seq * 2 AS seq2, 'token' AS kind, text, start_cs, end_cs FROM before
    UNION ALL SELECT session_id, seq * 2 - 1, 'silence', NULL, before, start_cs FROM before WHERE start_cs - before > 500)"""

TRANSLATIONS = """
tr AS (
    SELECT session_id, turn // 2 AS tr_no, min(start_cs) AS start_cs,
        CASE WHEN (turn // 2) % 5 = 4 THEN min(start_cs) ELSE max(end_cs) END AS end_cs, 't' || (turn // 2)::VARCHAR AS text
    FROM tokens GROUP BY session_id, turn // 2)"""

VAD = """
vad AS (
    SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_ix,
        512 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_sample, least(value / 100, 1.0) AS prob FROM events)"""

CALLS = "calls AS (SELECT user_id AS session_id, event_id AS call_ix, CAST(round(value * 1000) AS BIGINT) AS dur_us, event_type FROM events)"

PAIRS = """
refs AS (
    SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS ref FROM conversations WHERE text IS NOT NULL),
pairs AS (
    SELECT conv_id || '-' || turn AS id, conv_id AS session_id, turn, ref,
        [CASE WHEN i % (11 + 20 * (turn % 2)) = 0 THEN ref[i] || 'x' ELSE ref[i] END for i in range(1, len(ref) + 1) if i % (7 + 11 * (conv_id % 3)) <> 0] AS hyp FROM refs)"""
