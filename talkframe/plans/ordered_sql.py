"""SQL twins of what goes through rows in order: recursions over a session's rows, and lists."""

from talkframe.plans.speech import FULL
from talkframe.plans.speech import ORACLES as SPEECH
from talkframe.plans.tables_sql import CALLS, PAIRS, TOKENS

#: Is the list of words `w`, of `n` words, a loop?
LOOPS = """n >= 12 AND (
    len([i FOR i IN range(1, n - 6) IF len(list_distinct(w[i : i + 7])) = 1]) > 0
    OR len([k FOR k IN range(2, 9) IF n // 2 >= k AND n >= k * greatest(3, (11 + k) // k)
        AND len([r FOR r IN range(1, greatest(3, (11 + k) // k)) IF w[n - k * (r + 1) + 1 : n - k * r] <> w[n - k + 1 : n]]) = 0]) > 0
    OR len([k FOR k IN range(2, 9) IF n // 2 >= k AND
        list_max(map_values(list_aggregate([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, n - k + 2)], 'histogram'))) >= greatest(4, 12 / k, 0.55 * n / k)]) > 0)"""
SAID = r"'[\pL\pN]+(?:''[\pL\pN]+)*'"
WORDS = r"'[^\x20\x09-\x0D]+'"

HYPOTHESES = rf"""
w AS (SELECT conv_id || '-' || turn AS session_id, regexp_extract_all(text, {WORDS}) AS w FROM conversations WHERE text IS NOT NULL),
r AS (SELECT *, unnest(range(1, (len(w) + 4) // 5 + 2)) AS rev FROM w WHERE len(w) > 0),
hyps AS MATERIALIZED (
    SELECT session_id, rev, [{{'t': CASE WHEN i = least(rev * 5, len(w)) AND rev * 5 <= len(w) THEN w[i] || '~' ELSE w[i] END, 's': i * 50 / 100, 'e': (i * 50 + 40) / 100}} FOR i IN range(1, least(rev * 5, len(w)) + 1)] AS ws FROM r)"""

SRT = "lpad((t // 360000)::VARCHAR, 2, '0') || ':' || lpad(((t // 6000) % 60)::VARCHAR, 2, '0') || ':' || lpad(((t // 100) % 60)::VARCHAR, 2, '0') || ',' || lpad((t % 100 * 10)::VARCHAR, 3, '0')"
_cue = lambda c, mark: SRT.replace("(t ", f"({c} ").replace("','", f"'{mark}'")

#: The checked results, and the words that hypotheses agree on, revision by revision.
CHECKED = """WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, CASE WHEN event_id % 97 = 0 THEN [value] WHEN event_id % 89 = 0 THEN [value, value - 1] ELSE [event_id, event_id + value] END AS s FROM events),
        b AS (SELECT *, lag(s) OVER (PARTITION BY user_id, day ORDER BY event_id) AS p FROM e)
        SELECT user_id, day, count(*)::INT AS n, CASE WHEN bool_or(len(s) <> 2) THEN 'shape' WHEN bool_or(s[1] < 0) THEN 'negative' WHEN bool_or(s[2] < s[1]) THEN 'inverted'
            WHEN bool_or(s[1] < p[1] OR s[2] < p[2]) THEN 'order' END AS error_code FROM b GROUP BY user_id, day"""
AGREED = f"""WITH RECURSIVE {HYPOTHESES},
        g AS (
            SELECT session_id, 0::BIGINT AS rev, 0.0::DOUBLE AS last, []::VARCHAR[] AS tail, ws[1:0] AS opened, ws[1:0] AS said FROM hyps WHERE rev = 1
            UNION ALL SELECT session_id, rev, CASE WHEN n > 0 THEN fresh[n].e ELSE last END, CASE WHEN n > 0 THEN (tail || [x.t FOR x IN fresh[1:n]])[-5:] ELSE tail END, fresh[n + 1 :], fresh[1:n] FROM (
                SELECT *, coalesce(list_position([i <= len(opened) AND opened[i].t = fresh[i].t FOR i IN range(1, len(fresh) + 1)], FALSE) - 1, len(fresh)) AS n FROM (
                    SELECT session_id, rev, last, tail, opened, fresh[1 + coalesce([k FOR k IN range(1, 6) IF k <= len(tail) AND k <= len(fresh) AND abs(fresh[1].s - last) < 1
                        AND tail[-k:] = [x.t FOR x IN fresh[1:k]]][1], 0) :] AS fresh FROM (
                        SELECT h.session_id, h.rev, g.last, g.tail, g.opened, [x FOR x IN h.ws IF x.s > g.last - 0.1] AS fresh FROM g JOIN hyps h ON h.session_id = g.session_id AND h.rev = g.rev + 1))))"""

CUES = f"""WITH RECURSIVE {TOKENS},
        f AS (
            SELECT session_id, 0::BIGINT AS seq, 0 AS cue, 0::BIGINT AS used, 1 AS line, NULL::DOUBLE AS last, '' AS piece, NULL::DOUBLE AS s, NULL::DOUBLE AS e FROM (SELECT DISTINCT session_id FROM tokens)
            UNION ALL SELECT session_id, seq, CASE WHEN fits OR (cue > 0 AND NOT late AND line < 2) THEN cue ELSE cue + 1 END, CASE WHEN fits THEN used + length(text) ELSE length(trim(text)) END,
                CASE WHEN fits THEN line WHEN cue > 0 AND NOT late AND line < 2 THEN line + 1 ELSE 1 END, s, CASE WHEN fits THEN text WHEN cue > 0 AND NOT late AND line < 2 THEN chr(10) || trim(text) ELSE trim(text) END, s, e FROM (
                SELECT t.session_id, t.seq, f.cue, f.used, f.line, t.text, t.start_cs / 100 AS s, t.end_cs / 100 AS e, coalesce(t.start_cs / 100 - f.last > 3, FALSE) AS late,
                    f.cue > 0 AND f.used > 0 AND NOT coalesce(t.start_cs / 100 - f.last > 3, FALSE) AND f.used + length(t.text) <= 42 AS fits FROM f JOIN tokens t ON t.session_id = f.session_id AND t.seq = f.seq + 1))"""

ORACLES = {
    "timestamp_accuracy": f"""WITH RECURSIVE {PAIRS},
        m AS (SELECT id, 0 AS k, 0::BIGINT AS seen, NULL::BIGINT AS delta, ref, hyp FROM pairs
            UNION ALL SELECT id, k + 1, seen + hit, CASE WHEN hit > 0 THEN abs(k * 50 + CASE WHEN k % 3 = 0 THEN 7 ELSE 0 END - (seen + hit - 1) * 50) END, ref, hyp FROM (
                SELECT *, coalesce(list_position(ref[seen + 1 : seen + 3], hyp[k + 1]), 0) AS hit FROM m WHERE k < len(hyp)))
        SELECT id, count(delta)::INT AS n_matched, round(avg(delta), 6) AS mae_cs, max(delta) AS max_cs, median(delta) AS median_cs FROM m WHERE len(ref) + len(hyp) > 0 GROUP BY id""",
    "merged_marks": rf"""WITH {TOKENS},
        m AS (SELECT *, starts_with(text, ' ') AND length(trim(text)) = 1 AND contains('"''“¿([{{-', trim(text)) AS opens, length(text) = 1 AND contains('"''.。,，!！?？:：”)]}}、', text) AS closes FROM tokens),
        n AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS word_no FROM (
            SELECT *, CASE WHEN coalesce(NOT lag(opens) OVER (PARTITION BY session_id ORDER BY seq) AND NOT closes, TRUE) THEN 1 ELSE 0 END AS c FROM m))
        SELECT session_id, word_no, string_agg(text, '' ORDER BY seq) AS text, min(start_cs) AS start_cs, max(end_cs) AS end_cs FROM n GROUP BY session_id, word_no""",
    "subwords_to_words": rf"""WITH {TOKENS}, p AS (SELECT session_id, seq, unnest(ps) AS text, generate_subscripts(ps, 1) AS i FROM (SELECT session_id, seq, regexp_extract_all(text, '(?s).{{1,3}}') AS ps FROM tokens)),
        n AS (SELECT *, sum((starts_with(text, ' ') OR regexp_matches(trim(text), '^[[:punct:]]$'))::INT) OVER (PARTITION BY session_id ORDER BY seq, i ROWS UNBOUNDED PRECEDING)::BIGINT AS word_no FROM p)
        SELECT session_id, word_no, string_agg(text, '' ORDER BY seq, i) AS text, count(*) AS n_pieces FROM n GROUP BY session_id, word_no""",
    "last_words": rf"""WITH {TOKENS}, k AS (SELECT * FROM tokens QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 80),
        g AS (SELECT session_id, regexp_extract_all(lower(string_agg(text, '' ORDER BY seq)), {SAID}) AS w FROM k GROUP BY session_id), s AS (SELECT *, len(w) AS n FROM g)
        SELECT session_id, n::INT AS n_words, array_to_string(w, ' ') AS words, {LOOPS} AS loops FROM s""",
    "repetition_loops": rf"""WITH s AS (SELECT conv_id, turn, regexp_extract_all(lower(text), {SAID}) AS w FROM conversations), c AS (SELECT *, len(w) AS n FROM s)
        SELECT conv_id, turn, coalesce(n, -1)::INT AS n_words, {LOOPS} AS loops FROM c""",
    "normalized_texts": r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\pL\pN_\s\-'']', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM documents""",
    "coalesced_chunks": f"""WITH RECURSIVE {CALLS},
        o AS MATERIALIZED (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY call_ix) AS k, dur_us / 50000 AS seconds, event_type = 'error' AS drains FROM calls),
        f AS (SELECT DISTINCT session_id, 0::BIGINT AS k, 0.0::DOUBLE AS held, 0 AS n, NULL::DOUBLE AS seconds, 0 AS out_n FROM o
            UNION ALL SELECT session_id, k, CASE WHEN emits THEN 0 ELSE h END, CASE WHEN emits THEN 0 ELSE m END, CASE WHEN emits THEN round(h, 6) END, CASE WHEN emits THEN m ELSE 0 END FROM (
                SELECT *, m > 0 AND (drains OR h >= 2) AS emits FROM (
                    SELECT o.session_id, o.k, o.drains, CASE WHEN o.drains THEN f.held ELSE f.held + o.seconds END AS h, CASE WHEN o.drains THEN f.n ELSE f.n + 1 END AS m FROM f JOIN o ON o.session_id = f.session_id AND o.k = f.k + 1)))
        SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY k)::INT AS out_no, seconds, out_n AS n FROM f WHERE out_n > 0""",
    "checked_results": CHECKED,
    "plausible_segments": rf"""WITH {TOKENS},
        k AS (SELECT *, NOT regexp_matches(trim(text), '^\pP+$') AS said FROM tokens),
        a AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn, said ORDER BY seq) AS nth, end_cs / 100 - start_cs / 100 AS d FROM k),
        g AS (SELECT session_id, turn, turn // 4 AS win, count(*)::INT AS n_words, arg_min(start_cs, seq) / 100 AS start_s, arg_max(end_cs, seq) / 100 AS end_s, least(count(*) FILTER (said), 8) AS n,
                coalesce(sum(CASE WHEN length(text) > 14 THEN 1 ELSE 0 END + CASE WHEN d < 0.133 THEN (0.133 - d) * 15 ELSE 0 END + CASE WHEN d > 2 THEN d - 2 ELSE 0 END) FILTER (said AND nth <= 8), 0) AS score FROM a GROUP BY session_id, turn),
        f AS (SELECT *, score >= 3 OR score + 0.01 >= n AS flagged FROM g),
        c AS (SELECT *, flagged AND (start_s - coalesce(lag(end_s) OVER o, 0) > 2 OR start_s < 2) AND (lead(start_s) OVER o IS NULL OR lead(start_s) OVER o - end_s > 2 OR lead(flagged) OVER o) AS out
            FROM f WINDOW o AS (PARTITION BY session_id, win ORDER BY turn)),
        d AS (SELECT *, bool_or(out) OVER (PARTITION BY session_id, win ORDER BY turn ROWS UNBOUNDED PRECEDING) AS gone FROM c)
        SELECT session_id, turn AS seq, n_words, start_s, end_s FROM d WHERE NOT gone""",
    "exported": f"""{FULL}, c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS cue, chr((greatest(speaker - 1, 0) + 65)::INT) AS who, max(end_cs) OVER (PARTITION BY session_id) / 100 AS d
            FROM lines WHERE kind = 'line' AND text <> ''),
        j AS (SELECT session_id, d, count(*) AS n, string_agg(text, ' ' ORDER BY cue) AS said, string_agg(who || ': ' || text, chr(10) ORDER BY cue) AS names,
                string_agg(format('{{{{"id":{{}},"start":{{}},"end":{{}},"text":{{}}}}}}', cue - 1, to_json(start_cs / 100), to_json(end_cs / 100), to_json(text)), ',' ORDER BY cue) AS segs,
                string_agg(format('{{{{"type":"transcript.text.segment","id":"seg_{{:03d}}","start":{{}},"end":{{}},"text":{{}},"speaker":"{{}}"}}}}', cue, to_json(start_cs / 100), to_json(end_cs / 100), to_json(text), who), ',' ORDER BY cue) AS spoken,
                string_agg(cue || chr(10) || {_cue("start_cs", ",")} || ' --> ' || {_cue("end_cs", ",")} || chr(10) || trim(text) || chr(10), chr(10) ORDER BY cue) AS srt,
                string_agg({_cue("start_cs", ".")} || ' --> ' || {_cue("end_cs", ".")} || chr(10) || trim(text) || chr(10), chr(10) ORDER BY cue) AS vtt, string_agg(trim(text), chr(10) ORDER BY cue) AS txt FROM c GROUP BY session_id, d)
        SELECT session_id, 'srt' AS form, srt AS content FROM j UNION ALL SELECT session_id, 'vtt', 'WEBVTT' || chr(10) || chr(10) || vtt FROM j UNION ALL SELECT session_id, 'txt', txt FROM j
        UNION ALL SELECT session_id, 'text', trim(said) FROM j UNION ALL SELECT session_id, 'short_json', format('{{{{"text":{{}},"usage":{{{{"type":"duration","seconds":{{}}}}}}}}}}', to_json(trim(said)), round_even(d, 0)::BIGINT) FROM j
        UNION ALL SELECT session_id, 'json', format('{{{{"task":"transcribe","language":"unknown","duration":{{}},"text":{{}},"segments":[{{}}],"usage":{{{{"type":"duration","seconds":{{}}}}}}}}}}', to_json(d), to_json(trim(said)), segs, round_even(d, 0)::BIGINT) FROM j
        UNION ALL SELECT session_id, 'diarized_json', format('{{{{"task":"transcribe","duration":{{}},"text":{{}},"segments":[{{}}],"usage":{{{{"type":"duration","seconds":{{}}}}}}}}}}', to_json(d), to_json(trim(names)), spoken, round_even(d, 0)::BIGINT) FROM j""",
    "agreed_words": AGREED + """,
        u AS (SELECT session_id, rev, unnest(said) AS x, generate_subscripts(said, 1) AS i FROM g)
        SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY rev, i)::INT AS out_no, x.t AS text, x.s AS start_s, x.e AS end_s FROM u""",
    "steady_words": f"""WITH RECURSIVE {HYPOTHESES},
        g AS (
            SELECT session_id, 0::BIGINT AS rev, 0.0::DOUBLE AS fin, []::VARCHAR[] AS recent, ws[1:0] AS kept, FALSE AS loops, 0.0::DOUBLE AS before FROM hyps WHERE rev = 1
            UNION ALL SELECT session_id, rev, CASE WHEN loops OR len(kept) = 0 THEN fin ELSE kept[-1].e END, CASE WHEN loops THEN [] WHEN len(kept) = 0 THEN recent ELSE w[-80:] END, kept, loops, fin FROM (
                SELECT *, len(kept) > 0 AND {LOOPS} AS loops FROM (
                    SELECT *, len(w) AS n FROM (
                        SELECT *, recent || flatten([regexp_extract_all(lower(x.t), '[\\pL\\pN'']+') FOR x IN kept]) AS w FROM (
                            SELECT h.session_id, h.rev, g.fin, g.recent, [x FOR x IN h.ws IF x.e > g.fin + 0.05] AS kept FROM g JOIN hyps h ON h.session_id = g.session_id AND h.rev = g.rev + 1))))),
        u AS (SELECT session_id, rev, i, 'word' AS kind, x.t AS text, x.s AS start_s, x.e AS end_s FROM (SELECT session_id, rev, unnest(kept) AS x, generate_subscripts(kept, 1) AS i FROM g WHERE NOT loops)
            UNION ALL SELECT session_id, rev, 0, 'reset', 'repetition', before, before FROM g WHERE loops)
        SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY rev, i)::INT AS out_no, kind, text, start_s, end_s FROM u""",
    "subtitle_cues": CUES + """
        SELECT session_id, cue, min(s) AS start_s, arg_max(e, seq) AS end_s, string_agg(piece, '' ORDER BY seq) AS text FROM f WHERE seq > 0 GROUP BY session_id, cue""",
    "highlighted_cues": CUES + """,
        w AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY session_id, cue ORDER BY seq), s) AS before FROM f WHERE seq > 0),
        u AS (SELECT a.session_id, a.cue, a.seq, a.before, a.s, a.e, string_agg(b.piece, '' ORDER BY b.seq) AS whole,
                string_agg(CASE WHEN a.seq = b.seq THEN regexp_replace(b.piece, '^(\\s*)((?s).*)$', '\\1<u>\\2</u>') ELSE b.piece END, '' ORDER BY b.seq) AS marked
            FROM w a JOIN w b ON a.session_id = b.session_id AND a.cue = b.cue GROUP BY a.session_id, a.cue, a.seq, a.before, a.s, a.e),
        v AS (SELECT session_id, seq, 0 AS k, before AS s, s AS e, whole AS text FROM u WHERE round(before * 1000) <> round(s * 1000) UNION ALL SELECT session_id, seq, 1, s, e, marked FROM u)
        SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq, k) AS INTEGER) AS cue, s AS start_s, e AS end_s, text FROM v""",
    "translated_utterances": f"""WITH RECURSIVE segs AS ({SPEECH["segments_at_marks"]}),
        u AS MATERIALIZED (SELECT session_id, seg_no AS utt_no, start_cs, end_cs, w, (len(w) + 2) // 3 AS k FROM (SELECT *, regexp_extract_all(text, {WORDS}) AS w FROM segs WHERE kind = 'token') WHERE len(w) > 0),
        a AS (
            SELECT session_id, utt_no, w, k, 0::BIGINT AS i, '' AS shown, 0 AS refused FROM u
            UNION ALL SELECT session_id, utt_no, w, k, i + 1, CASE WHEN starts_with(t, shown) THEN t ELSE shown END, CASE WHEN starts_with(t, shown) THEN refused ELSE refused + 1 END FROM (
                SELECT *, array_to_string(CASE WHEN (i + 1) % 7 = 3 THEN w[2 : 3 * (i + 1) + 1] ELSE w[1 : 3 * (i + 1)] END, ' ') AS t FROM a WHERE i < k))
        SELECT session_id, utt_no, k + 1 AS n_updates, shown, CASE WHEN utt_no % 5 = 0 THEN shown ELSE '=' || array_to_string(a.w, ' ') END AS text,
            coalesce(lag(end_cs) OVER (PARTITION BY session_id ORDER BY utt_no), start_cs) AS start_cs, end_cs, refused AS n_refused FROM a JOIN u USING (session_id, utt_no, k) WHERE i = k""",
}
