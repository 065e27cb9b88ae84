"""SQL for DuckDB that gives the same rows as the queries."""

from __future__ import annotations

from reelspan.functions.text import ACTION_WORDS, DIALOGUE_WORDS, STOP_WORDS
from reelspan.queries import CHARACTERS
from reelspan.settings import WEIGHTS

_BLANK = r"[\s\p{Z}\x{85}\x0b]"


def _list(words: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _once(name: str, table: str, keys: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ingested_at) AS rn FROM {table}) WHERE rn = 1)"


def strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def content(c: str) -> str:
    return f"list_filter(string_split({norm(c)}, ' '), lambda w: length(w) > 2 AND NOT list_contains({_list(STOP_WORDS)}, w))"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '{_BLANK}+'), lambda w: length(w) > 3)"


def clamp(c: str) -> str:
    return f"greatest(0.0, coalesce(CASE WHEN isnan({c}) THEN 0.0 ELSE {c} END, 0.0))"


def fmt(c: str) -> str:
    return f"printf('%02d:%05.2f', floor({c} / 60)::INT, floor(({c} - 60 * floor({c} / 60)) * 100 + 0.500001) / 100)"


def iou(a: str, b: str, c: str, d: str) -> str:
    return f"greatest(0.0, least({b}, {d}) - greatest({a}, {c})) / greatest(1e-8, greatest({b}, {d}) - least({a}, {c}))"


def unit(c: str) -> str:
    """A list of doubles of length 1; null, zero and broken vectors are null."""
    v = f"{c}::DOUBLE[]"
    return f"CASE WHEN {c} IS NULL OR isnan(list_sum({v})) OR list_inner_product({v}, {v}) = 0 THEN NULL ELSE list_transform({v}, lambda x: x / greatest(sqrt(list_inner_product({v}, {v})), 1e-30)) END"


SCENES, LINES, CANDS = _once("scenes", "segments", "video, scene_id"), _once("raw_lines", "subtitle_lines", "video, line_no"), _once("cands", "candidates", "query_id, video, scene_id")
GOLD = "g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id) AS rn FROM gold) WHERE rn = 1)"
LINE = LINES + ",\nlines AS (SELECT video, line_no, start_ms / 1000.0::DOUBLE AS ls, end_ms / 1000.0::DOUBLE AS le, " + strip("replace(replace(text, '\\N', ' '), chr(10), ' ')") + " AS line FROM raw_lines WHERE length(" + strip("replace(replace(text, '\\N', ' '), chr(10), ' ')") + ") > 0)"
VEC = "vecs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ord) AS rn FROM segment_vectors) WHERE rn = 1)"
UNITS = VEC + f",\nunits AS MATERIALIZED (SELECT ord, video, scene_id, {unit('text_vec')} AS t, {unit('image_vec')} AS i, {unit('audio_vec')} AS a FROM vecs)"
FIRST = UNITS + """,
first AS (SELECT u.* FROM units u JOIN vecs USING (ord) WHERE text_vec IS NOT NULL AND image_vec IS NOT NULL AND audio_vec IS NOT NULL ORDER BY ord LIMIT 1),
scored AS (SELECT u.ord, u.video, u.scene_id, greatest(0.0, coalesce(list_inner_product(u.t, f.t), 0)) AS text_score, greatest(0.0, coalesce(list_inner_product(u.i, f.i), 0)) AS image_score,
           greatest(0.0, coalesce(list_inner_product(u.a, f.a), 0)) AS audio_score FROM units u, first f)"""
CURVE = FIRST + ",\ncurve AS (SELECT video, scene_id, round(text_score, 6) AS score, row_number() OVER (PARTITION BY video ORDER BY scene_id) - 1 AS i FROM scored)"
SMOOTH = CURVE + """,
smoothed AS (SELECT video, i, CASE WHEN count(*) OVER (PARTITION BY video) >= 5 THEN sum(score) OVER (PARTITION BY video ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 ELSE score END AS smoothed FROM curve)"""
CLAMPED = CANDS + f",\nc AS (SELECT query_id, video, scene_id, {clamp('text_score')} AS t, {clamp('image_score')} AS i, {clamp('audio_score')} AS a FROM cands)"
RANGES = CLAMPED + """,
r AS (SELECT query_id, min(t) AS lt, max(t) AS ht, min(i) AS li, max(i) AS hi, min(a) AS la, max(a) AS ha FROM c GROUP BY 1),
n AS (SELECT query_id, video, scene_id, CASE WHEN ht - lt > 1e-8 THEN (t - lt) / (ht - lt) ELSE 0 END AS t, CASE WHEN hi - li > 1e-8 THEN (i - li) / (hi - li) ELSE 0 END AS i,
      CASE WHEN ha - la > 1e-8 THEN (a - la) / (ha - la) ELSE 0 END AS a FROM c JOIN r USING (query_id))"""
_TOKENS = f"list_distinct(regexp_split_to_array(lower(coalesce(query_text, '')), '{_BLANK}+'))"
LABEL = GOLD + f""",
hits AS (SELECT *, len(list_intersect({_TOKENS}, {_list(ACTION_WORDS)})) AS n_action, len(list_intersect({_TOKENS}, {_list(DIALOGUE_WORDS)})) AS n_dialogue FROM g),
labelled AS (SELECT *, CASE WHEN n_action > n_dialogue THEN 'action' WHEN n_dialogue > n_action THEN 'dialogue' ELSE 'mixed' END AS label FROM hits)"""


def _weight(k: int) -> str:
    return "CASE label " + " ".join(f"WHEN '{n}' THEN {w[k]}" for n, w in WEIGHTS.items()) + " END"


ASKED = CANDS + ",\n" + GOLD + ",\nasked AS (SELECT c.query_id, c.video, c.scene_id, c.subtitle, g.query_text FROM cands c JOIN g USING (query_id))"
KW = ASKED + f""",
k AS (SELECT *, {words('query_text')} AS w FROM asked),
kw AS (SELECT *, len(list_filter(w, lambda x: contains(lower(coalesce(subtitle, '')), x))) AS hits, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(lower(coalesce(subtitle, '')), x))) / len(w) ELSE 0 END AS frac FROM k)"""
WINDOWS = SCENES + ",\n" + GOLD + """,
dur AS (SELECT video, max(scene_end) AS duration FROM scenes GROUP BY 1),
win AS (SELECT query_id, query_text, video, gt_start, gt_end, duration, greatest(0.0, gt_start - 15) AS lo, least(duration, gt_end + 15) AS hi FROM g JOIN dur USING (video)),
bins AS (SELECT * FROM (SELECT query_id, video, n AS i, lo + n * 0.5 AS b_s, least(lo + n * 0.5 + 2, hi) AS b_e, hi FROM (SELECT *, unnest(range(0, ceil((hi - lo) / 0.5)::BIGINT + 1)) AS n FROM win WHERE hi > lo)) WHERE b_s < hi)"""
EVAL = CANDS + ",\n" + GOLD + f""",
res AS (SELECT query_id, rank_pos, video, scene_start AS s, scene_end AS e, greatest(0.0, least(1.0, ({clamp('hybrid_score')} - 0.1) / (0.7 - 0.1))) AS confidence FROM cands),
j AS (SELECT g.query_id, g.query_type, g.gt_start, g.gt_end, res.video AS p_video, rank_pos, s, e, confidence, coalesce((res.video = g.video)::INT, 0) AS same,
      CASE WHEN res.video = g.video THEN {iou('s', 'e', 'gt_start', 'gt_end')} ELSE 0.0 END AS iou FROM g LEFT JOIN res USING (query_id)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_pos) AS rn FROM j) WHERE rn = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY iou DESC, rank_pos) AS rn FROM j) WHERE rn = 1),
ev AS (SELECT t.query_id, t.query_type, {fmt('t.gt_start')} || '-' || {fmt('t.gt_end')} AS gt, t.p_video AS top1_video, t.same AS top1_correct, round(t.iou, 4) AS top1_iou, h.hit AS topk_hit, round(b.iou, 4) AS best_iou_k,
       CASE WHEN b.iou > 0 THEN {fmt('b.s')} || '-' || {fmt('b.e')} ELSE 'N/A' END AS best_pred_k, round(t.confidence, 4) AS confidence
       FROM top t JOIN best b USING (query_id) JOIN (SELECT query_id, max(same) AS hit FROM j GROUP BY 1) h USING (query_id))"""
SPANS = GOLD + ",\nspans AS (SELECT query_id, query_text, video, gt_start AS s, gt_end AS e FROM g)"
QVEC = SCENES + ",\n" + GOLD + ",\n" + UNITS + """,
first_at AS (SELECT query_id, min_by(s.scene_id, s.scene_id) AS scene_id, any_value(s.video) AS video FROM g JOIN scenes s ON s.video = g.video AND g.gt_start >= s.scene_start AND g.gt_start < s.scene_end GROUP BY 1),
q AS MATERIALIZED (SELECT g.query_id, g.query_text, u.t, u.i, u.a FROM g LEFT JOIN first_at f USING (query_id) LEFT JOIN units u ON u.video = f.video AND u.scene_id = f.scene_id)"""


_HYBRID = QVEC + f""",
l AS (SELECT *, len(list_intersect({_TOKENS}, {_list(ACTION_WORDS)})) AS x, len(list_intersect({_TOKENS}, {_list(DIALOGUE_WORDS)})) AS y, list_filter({_list(CHARACTERS)}, lambda n: contains(lower(query_text), n)) AS names FROM q),
p AS (SELECT query_id, query_text, CASE WHEN x > y THEN 'action' WHEN y > x THEN 'dialogue' ELSE 'mixed' END AS label, names, u.ord, u.video, u.scene_id, greatest(0.0, coalesce(list_inner_product(u.t, l.t), 0)) AS t, greatest(0.0, coalesce(list_inner_product(u.i, l.i), 0)) AS i, greatest(0.0, coalesce(list_inner_product(u.a, l.a), 0)) AS a FROM l, units u),
pr AS (SELECT query_id, min(t) AS lt, max(t) AS ht, min(i) AS li, max(i) AS hi, min(a) AS la, max(a) AS ha FROM p GROUP BY 1),
f AS (SELECT p.*, s.scene_start, s.scene_end, s.subtitle, ({_weight(0)}) * (CASE WHEN ht - lt > 1e-8 THEN (t - lt) / (ht - lt) ELSE 0 END) + ({_weight(1)}) * (CASE WHEN hi - li > 1e-8 THEN (i - li) / (hi - li) ELSE 0 END) + ({_weight(2)}) * (CASE WHEN ha - la > 1e-8 THEN (a - la) / (ha - la) ELSE 0 END)
      + CASE WHEN len(names) > 0 THEN 0.3 * len(list_filter(names, lambda n: contains(lower(coalesce(s.subtitle, '')), n))) / len(names) ELSE 0 END AS fused FROM p JOIN pr USING (query_id) LEFT JOIN scenes s ON s.video = p.video AND s.scene_id = p.scene_id),
k AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, ord DESC) AS rank_pos FROM f) WHERE rank_pos <= 10)"""


def _scaled(c: str) -> str:
    w = "OVER (PARTITION BY query_id, video, scene_id)"
    return f"CASE WHEN max({c}) {w} - min({c}) {w} > 1e-8 THEN ({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w}) ELSE 0 END"


def _words(c: str) -> str:
    return f"list_distinct(string_split({norm(c)}, ' '))"


_CUT = "CASE WHEN e - s > 35 THEN greatest({lo}, (s + e) / 2 - 17.5) ELSE s END AS s, CASE WHEN e - s > 35 THEN least({hi}, (s + e) / 2 + 17.5) ELSE e END AS e"
REFINED = _HYBRID + ",\n" + LINE + f""",
dur AS (SELECT video, max(scene_end) AS duration FROM scenes GROUP BY 1),
cand AS MATERIALIZED (SELECT query_id, query_text, label, k.video, scene_id, fused, t, i, a, scene_start, scene_end, subtitle, duration, greatest(0.0, scene_start - 15) AS lo, least(duration, scene_end + 15) AS hi FROM k JOIN dur USING (video)),
bins AS MATERIALIZED (SELECT * FROM (SELECT query_id, query_text, label, video, scene_id, n, lo, hi, lo + n * 0.5 AS b_s, least(lo + n * 0.5 + 2, hi) AS b_e FROM (SELECT *, unnest(range(0, ceil((hi - lo) / 0.5)::BIGINT + 1)) AS n FROM cand WHERE hi > lo)) WHERE b_s < hi),
btext AS (SELECT query_id, b.video, scene_id, n, string_agg(line, ' ' ORDER BY line_no) AS txt FROM bins b JOIN lines l ON l.video = b.video AND le >= b_s AND ls <= b_e GROUP BY ALL),
mids AS MATERIALIZED (SELECT s.video, s.scene_id AS at_scene, (scene_start + scene_end) / 2 AS m, u.i AS ui, u.a AS ua FROM scenes s JOIN units u ON u.video = s.video AND u.scene_id = s.scene_id),
seen AS MATERIALIZED (SELECT DISTINCT b.query_id, b.video, at_scene FROM bins b JOIN mids ON mids.video = b.video AND m >= b_s AND m <= b_e),
sims AS MATERIALIZED (SELECT seen.query_id, seen.video, m, greatest(0.0, coalesce(list_inner_product(ui, q.i), 0)) AS si, greatest(0.0, coalesce(list_inner_product(ua, q.a), 0)) AS sa FROM seen JOIN mids USING (video, at_scene) JOIN q USING (query_id)),
pooled AS (SELECT b.query_id, b.video, scene_id, n, CASE WHEN any_value(label) = 'action' THEN max(si) ELSE avg(si) END AS i_raw, max(sa) AS a_raw FROM bins b JOIN sims s ON s.query_id = b.query_id AND s.video = b.video AND m >= b_s AND m <= b_e GROUP BY ALL),
raws AS (SELECT b.*, coalesce(i_raw, 0) AS i_raw, coalesce(a_raw, 0) AS a_raw, CASE WHEN length(coalesce(txt, '')) > 0 THEN 0.75 * len(list_intersect({_words('query_text')}, {_words('txt')})) / sqrt(len({_words('query_text')}) * len({_words('txt')}))
         + 0.25 * CASE WHEN len({content('query_text')}) > 0 THEN len(list_filter({content('query_text')}, lambda w: contains({norm('txt')}, w))) / len({content('query_text')}) ELSE 0 END ELSE 0 END AS s_raw
         FROM bins b LEFT JOIN btext USING (query_id, video, scene_id, n) LEFT JOIN pooled USING (query_id, video, scene_id, n)),
fusedbins AS (SELECT *, ({_weight(0)}) * ({_scaled('s_raw')}) + ({_weight(1)}) * ({_scaled('i_raw')}) + ({_weight(2)}) * ({_scaled('a_raw')}) AS x FROM raws),
sm AS MATERIALIZED (SELECT *, round(CASE WHEN count(*) OVER (PARTITION BY query_id, video, scene_id) >= 5 THEN sum(x) OVER (PARTITION BY query_id, video, scene_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 ELSE x END, 9) AS score FROM fusedbins),
pk AS (SELECT * FROM (SELECT query_id, video, scene_id, n AS top_n, score AS peak, row_number() OVER (PARTITION BY query_id, video, scene_id ORDER BY score DESC, n) AS r FROM sm) WHERE r = 1),
ext AS (SELECT query_id, video, scene_id, any_value(peak) AS peak, coalesce(max(n) FILTER (n < top_n AND score < greatest(0.25, 0.5 * peak)) + 1, min(n)) AS nl, coalesce(min(n) FILTER (n > top_n AND score < greatest(0.25, 0.5 * peak)) - 1, max(n)) AS nr FROM sm JOIN pk USING (query_id, video, scene_id) GROUP BY 1, 2, 3),
s1 AS (SELECT c.query_id, c.video, c.scene_id, c.query_text, duration, peak, c.lo, c.hi, greatest(c.lo, x.b_s - 3) AS s, least(c.hi, y.b_e + 3) AS e FROM ext JOIN cand c ON c.query_id = ext.query_id AND c.video = ext.video AND c.scene_id = ext.scene_id JOIN bins x ON x.query_id = ext.query_id AND x.video = ext.video AND x.scene_id = ext.scene_id AND x.n = nl JOIN bins y ON y.query_id = ext.query_id AND y.video = ext.video AND y.scene_id = ext.scene_id AND y.n = nr),
s2 AS (SELECT * EXCLUDE (s, e), s AS s0, e AS e0, CASE WHEN e - s < 10 THEN greatest(lo, s - (10 - (e - s)) / 2) ELSE s END AS s, CASE WHEN e - s < 10 THEN least(hi, e + (10 - (e - s)) / 2) ELSE e END AS e FROM s1),
s3 AS (SELECT * EXCLUDE (s, e, s0, e0), CASE WHEN e0 - s0 < 10 AND e - s < 10 AND s > lo THEN greatest(lo, e - 10) ELSE s END AS s, CASE WHEN e0 - s0 < 10 AND e - s < 10 AND s <= lo THEN least(hi, s + 10) ELSE e END AS e FROM s2),
s4 AS MATERIALIZED (SELECT * EXCLUDE (s, e), {_CUT.format(lo='lo', hi='hi')} FROM s3),
sn AS (SELECT query_id, video, scene_id, min(ls) FILTER (abs(ls - s) <= 3.0 AND le <= e + 3.0) AS a, max(le) FILTER (abs(le - e) <= 3.0 AND ls >= s - 3.0) AS b FROM s4 JOIN lines USING (video) GROUP BY 1, 2, 3),
s5 AS MATERIALIZED (SELECT s4.* EXCLUDE (s, e), least(s, coalesce(a, s)) AS s, greatest(e, coalesce(b, e)) AS e FROM s4 LEFT JOIN sn USING (query_id, video, scene_id)),
kw AS (SELECT query_id, video, scene_id, min(ls) AS a, max(le) AS b FROM (SELECT *, {content('query_text')} AS w FROM s5) z JOIN lines l USING (video) WHERE le >= s - 8 AND ls <= e + 8 AND len(list_filter(w, lambda x: contains({norm('line')}, x))) > 0 GROUP BY 1, 2, 3),
s6 AS (SELECT s5.* EXCLUDE (s, e), least(greatest(0.0, least(s, coalesce(a, s))), hi) AS s, greatest(e, coalesce(b, e)) AS e FROM s5 LEFT JOIN kw USING (query_id, video, scene_id)),
s7 AS (SELECT * EXCLUDE (e), least(greatest(s, e), hi) AS e FROM s6),
s8 AS (SELECT query_id, video, scene_id, peak, {_CUT.format(lo='0.0', hi='duration')} FROM s7),
refined AS MATERIALIZED (SELECT c.*, coalesce(s8.s, scene_start) AS refined_start, coalesce(s8.e, scene_end) AS refined_end, coalesce(peak, fused) AS grounding_conf FROM cand c LEFT JOIN s8 USING (query_id, video, scene_id))"""
GROUND = REFINED + f""",
kwo AS (SELECT *, {words('query_text')} AS w FROM refined),
bonus AS (SELECT *, len(list_filter(w, lambda x: contains(lower(coalesce(subtitle, '')), x))) AS hits FROM kwo),
rs AS (SELECT *, least(0.05, 0.03 * (CASE WHEN len(w) > 0 THEN hits / len(w) ELSE 0 END) + 0.005 * hits) AS keyword_bonus FROM bonus),
raw AS (SELECT *, 0.5 * fused + 0.4 * grounding_conf + 0.1 * keyword_bonus AS raw_score FROM rs),
conf AS (SELECT *, greatest(0.0, least(1.0, (raw_score - 0.1) / (0.7 - 0.1))) AS confidence FROM raw),
re AS (SELECT *, max(refined_end) OVER (PARTITION BY query_id, video ORDER BY refined_start, scene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM conf),
isl AS (SELECT *, sum((reached IS NULL OR refined_start - reached > 20)::INT) OVER (PARTITION BY query_id, video ORDER BY refined_start, scene_id) AS island FROM re),
mg AS (SELECT *, row_number() OVER (PARTITION BY query_id, video, island ORDER BY raw_score DESC, refined_start, scene_id) AS r, min(refined_start) OVER p AS s, max(refined_end) OVER p AS e, count(*) OVER p AS merged FROM isl WINDOW p AS (PARTITION BY query_id, video, island)),
ground AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, grounding_conf DESC, fused DESC, video, scene_id) AS place FROM mg WHERE r = 1)"""


def _evaluated(results: str) -> str:
    """CTEs up to ``ev`` from ``res`` (query_id, rank_pos, video, s, e, confidence)."""
    return EVAL[EVAL.index("res AS") :].replace(EVAL[EVAL.index("res AS") : EVAL.index("j AS")], results + ",\n")


def _shares(keys: str, having: str = "") -> str:
    return f"""SELECT {keys} AS query_type, count(*) AS n, round(avg(top1_correct), 4) AS top1_accuracy, round(avg(topk_hit), 4) AS topk_recall, round(avg(top1_iou), 4) AS mean_iou, round(avg((top1_iou >= 0.3)::INT), 4) AS r1_03,
        round(avg((top1_iou >= 0.5)::INT), 4) AS r1_05, round(avg(best_iou_k), 4) AS mean_best_iou, round(avg((best_iou_k >= 0.3)::INT), 4) AS rk_03, round(avg((best_iou_k >= 0.5)::INT), 4) AS rk_05 FROM ev {having}"""


def oracle_sql() -> dict[str, str]:
    chars = _list(CHARACTERS)
    plain = lambda c: f"regexp_replace(lower({c}), '[_. -]', '', 'g')"
    return {
        "vector_topk": f"""WITH {FIRST}, pairs AS (SELECT q.ord AS query_ord, u.ord, round(greatest(0.0, coalesce(list_inner_product(u.t, q.t), 0)), 6) AS score
            FROM units q JOIN vecs v ON v.ord = q.ord, units u WHERE q.ord % 50 = 0 AND v.text_vec IS NOT NULL)
            SELECT * FROM (SELECT query_ord, row_number() OVER (PARTITION BY query_ord ORDER BY score DESC, ord DESC) AS place, ord, score FROM pairs) WHERE place <= 10""",
        "vector_clamped_scores": f"WITH {FIRST} SELECT ord, round(text_score, 6) AS text_score, round(image_score, 6) AS image_score, round(audio_score, 6) AS audio_score FROM scored",
        "l2_normalize": f"""WITH {VEC}, v AS MATERIALIZED (SELECT ord, CASE WHEN list_inner_product(image_vec::DOUBLE[], image_vec::DOUBLE[]) = 0 THEN image_vec::DOUBLE[] ELSE {unit('image_vec')} END AS v FROM vecs)
            SELECT ord, round(list_sum(list_transform(v, lambda x, i: x * i)), 5) AS by_place, round(list_inner_product(v, v), 6) AS squared FROM v""",
        "mean_pool_vectors": f"""WITH {VEC}, ok AS (SELECT video, audio_vec::DOUBLE[] AS v FROM vecs WHERE audio_vec IS NOT NULL AND NOT isnan(list_sum(audio_vec::DOUBLE[])) AND list_inner_product(audio_vec, audio_vec) > 0),
            x AS (SELECT video, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM ok), m AS (SELECT video, p, avg(x) AS x, count(*) AS n FROM x GROUP BY 1, 2),
            s AS (SELECT video, sqrt(sum(x * x)) AS len, max(n) AS n FROM m GROUP BY 1 HAVING sqrt(sum(x * x)) > 1e-8)
            SELECT video, s.n, round(sum(x / len * p), 5) AS by_place FROM m JOIN s USING (video) GROUP BY 1, 2""",
        "label_topk": f"""WITH {UNITS}, l AS MATERIALIZED (SELECT label, label_ord, {unit('vec')} AS v FROM label_vectors),
            r AS (SELECT ord, label, row_number() OVER (PARTITION BY ord ORDER BY round(list_inner_product(a, v), 9) DESC, label_ord) AS k FROM units, l WHERE a IS NOT NULL),
            t AS (SELECT ord, string_agg(label, ' ' ORDER BY k) AS s, count(*) AS n FROM r WHERE k <= 5 GROUP BY 1)
            SELECT ord, coalesce(s, '') AS audio_event_text, coalesce(n, 0) AS n_events FROM units LEFT JOIN t USING (ord)""",
        "vector_failures": f"WITH {VEC} " + " UNION ALL ".join(
            f"SELECT '{m}' AS modality, count(*) FILTER ({m}_vec IS NULL) AS n_null, count(*) FILTER (list_inner_product({m}_vec::DOUBLE[], {m}_vec::DOUBLE[]) = 0) AS n_zero, count(*) FILTER (isnan(list_sum({m}_vec::DOUBLE[]))) AS n_nan, count(*) AS n FROM vecs" for m in ("text", "image", "audio")),
        "minmax_global": f"WITH {SCENES}, r AS (SELECT min(scene_end - scene_start) AS lo, max(scene_end - scene_start) AS hi FROM scenes) SELECT video, scene_id, round(CASE WHEN hi - lo > 1e-8 THEN (scene_end - scene_start - lo) / (hi - lo) ELSE 0 END, 6) AS span_norm FROM scenes, r",
        "minmax_by_query": f"WITH {RANGES} SELECT query_id, video, scene_id, round(t, 6) AS text_norm, round(i, 6) AS image_norm, round(a, 6) AS audio_norm FROM n",
        "hybrid_fusion": f"WITH {RANGES}, {LABEL} SELECT query_id, n.video, scene_id, round(({_weight(0)}) * t + ({_weight(1)}) * i + ({_weight(2)}) * a, 6) AS fused FROM n JOIN labelled USING (query_id)",
        "hybrid_fusion_no_audio": f"WITH {RANGES}, {LABEL}, w AS (SELECT query_id, n.video, scene_id, t, i, ({_weight(0)})::DOUBLE AS x, ({_weight(1)})::DOUBLE AS y FROM n JOIN labelled USING (query_id)) SELECT query_id, video, scene_id, round(x / (x + y) * t + y / (x + y) * i, 6) AS fused FROM w",
        "query_classify": f"WITH {LABEL} SELECT query_id, label, n_action, n_dialogue FROM labelled",
        "kw_overlap": f"WITH {KW} SELECT query_id, video, scene_id, hits, round(frac, 6) AS frac FROM kw",
        "kw_ratio": f"WITH {ASKED}, k AS (SELECT *, {content('query_text')} AS w, {norm('subtitle')} AS t FROM asked) SELECT query_id, video, scene_id, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(t, x))) / len(w) ELSE 0 END, 6) AS ratio FROM k",
        "content_words": f"WITH {GOLD} SELECT query_id, array_to_string({content('query_text')}, ' ') AS words FROM g",
        "character_boost": f"WITH {ASKED}, k AS (SELECT *, list_filter({chars}, lambda n: contains(lower(query_text), n)) AS q FROM asked) SELECT query_id, video, scene_id, round(CASE WHEN len(q) > 0 THEN 0.3 * len(list_filter(q, lambda n: contains(lower(coalesce(subtitle, '')), n))) / len(q) ELSE 0 END, 6) AS boost FROM k",
        "keyword_bonus": f"WITH {KW} SELECT query_id, video, scene_id, round(least(0.05, 0.03 * frac + 0.005 * hits), 6) AS bonus FROM kw",
        "calibrate": f"WITH {CANDS} SELECT query_id, video, scene_id, round(greatest(0.0, least(1.0, (0.5 * {clamp('hybrid_score')} + 0.4 * {clamp('text_score')} - 0.1) / (0.7 - 0.1))), 6) AS confidence FROM cands",
        "temporal_iou": f"WITH {CANDS}, {GOLD}, k AS (SELECT query_id, video, scene_id, round({iou('scene_start', 'scene_end', 'gt_start', 'gt_end')}, 6) AS iou FROM cands JOIN g USING (query_id, video)) SELECT *, CASE WHEN iou >= 0.3 THEN 'OK' WHEN iou > 0 THEN '~~' ELSE 'XX' END AS status FROM k",
        "fmt_time": f"WITH {SCENES} SELECT video, scene_id, {fmt('scene_start')} AS begins, {fmt('scene_end')} AS ends FROM scenes",
        "subtitle_overlap_join": f"WITH {SCENES}, {LINE} SELECT s.video, scene_id, line_no FROM scenes s JOIN lines l ON l.video = s.video AND le >= scene_start AND ls <= scene_end",
        "ordered_concat": f"WITH {SCENES}, {LINE} SELECT s.video, scene_id, coalesce(string_agg(line, ' ' ORDER BY line_no), '') AS line_text FROM scenes s LEFT JOIN lines l ON l.video = s.video AND le >= scene_start AND ls <= scene_end GROUP BY 1, 2",
        "silent_scene_fill": f"WITH {SCENES} SELECT video, scene_id, CASE WHEN {strip('subtitle')} <> '' THEN {strip('subtitle')} ELSE 'silent scene no dialogue' END AS embed_text FROM scenes",
        "scene_numbering": f"WITH {SCENES} SELECT video, scene_id, row_number() OVER (PARTITION BY video ORDER BY scene_start, scene_id) - 1 AS number FROM scenes",
        "scene_boundaries": f"""WITH {LINE}, f AS (SELECT *, coalesce(ls - lag(le) OVER w, 0) AS pause FROM lines WINDOW w AS (PARTITION BY video ORDER BY line_no)),
            k AS (SELECT *, sum((pause > 4.0)::INT) OVER (PARTITION BY video ORDER BY line_no) AS scene_id FROM f), s AS (SELECT video, scene_id, min(ls) AS s, max(ls) AS last FROM k GROUP BY 1, 2)
            SELECT video, scene_id, s, coalesce(lead(s) OVER (PARTITION BY video ORDER BY scene_id), last) AS e FROM s""",
        "keyframe_times": f"WITH {SCENES}, f AS (SELECT *, unnest(range(0, 5)) AS i FROM scenes) SELECT video, scene_id, i, round(scene_start + [0.10, 0.30, 0.50, 0.70, 0.90][i + 1]::DOUBLE * (scene_end - scene_start), 6) AS t FROM f",
        "sliding_bins": f"WITH {WINDOWS} SELECT query_id, i, round(b_s, 6) AS b_s, round(b_e, 6) AS b_e FROM bins",
        "bin_subtitle_join": f"WITH {WINDOWS}, {LINE} SELECT query_id, i, coalesce(string_agg(line, ' ' ORDER BY line_no), '') AS line_text FROM bins b LEFT JOIN lines l ON l.video = b.video AND le >= b_s AND ls <= b_e GROUP BY 1, 2",
        "frame_pool_max_mean": f"WITH {CURVE} SELECT video, i // 10 AS bin, max(score) AS pooled_max, round(avg(score), 6) AS pooled_mean FROM curve GROUP BY 1, 2",
        "smooth_scores": f"WITH {SMOOTH} SELECT video, i, round(smoothed, 6) AS smoothed FROM smoothed",
        "peak_expand": f"""WITH {SMOOTH}, v AS (SELECT video, i, round(smoothed, 6) AS v FROM smoothed), p AS (SELECT * FROM (SELECT video, i AS peak_at, v AS peak, row_number() OVER (PARTITION BY video ORDER BY v DESC, i) AS k FROM v) WHERE k = 1),
            x AS (SELECT video, any_value(peak) AS peak, any_value(peak_at) AS peak_at, coalesce(max(i) FILTER (i < peak_at AND v < greatest(0.25, 0.5 * peak)) + 1, min(i)) AS left_at, coalesce(min(i) FILTER (i > peak_at AND v < greatest(0.25, 0.5 * peak)) - 1, max(i)) AS right_at
            FROM v JOIN p USING (video) GROUP BY 1) SELECT video, peak, peak_at, left_at, right_at, left_at * 0.5::DOUBLE AS s, right_at * 0.5::DOUBLE + 2 AS e FROM x""",
        "min_max_span": f"""WITH {WINDOWS}, a AS (SELECT query_id, lo, hi, greatest(lo, gt_start - 3) AS s, least(hi, gt_end + 3) AS e FROM win),
            b AS (SELECT *, e - s < 10 AS short, CASE WHEN e - s < 10 THEN greatest(lo, s - (10 - (e - s)) / 2) ELSE s END AS s1, CASE WHEN e - s < 10 THEN least(hi, e + (10 - (e - s)) / 2) ELSE e END AS e1 FROM a),
            c AS (SELECT query_id, lo, hi, CASE WHEN short AND e1 - s1 < 10 AND s1 > lo THEN greatest(lo, e1 - 10) ELSE s1 END AS s, CASE WHEN short AND e1 - s1 < 10 AND s1 <= lo THEN least(hi, s1 + 10) ELSE e1 END AS e FROM b),
            d AS (SELECT query_id, lo, hi, CASE WHEN e - s > 35 THEN greatest(lo, (s + e) / 2 - 17.5) ELSE s END AS s, CASE WHEN e - s > 35 THEN least(hi, (s + e) / 2 + 17.5) ELSE e END AS e FROM c),
            f AS (SELECT query_id, hi, least(greatest(0.0, s), hi) AS s, e FROM d) SELECT query_id, round(s, 6) AS s, round(least(greatest(s, e), hi), 6) AS e FROM f""",
        "snap_boundaries": f"""WITH {SPANS}, {LINE} SELECT query_id, least(any_value(s), coalesce(min(ls) FILTER (abs(ls - s) <= 3.0 AND le <= e + 3.0), any_value(s))) AS s, greatest(any_value(e), coalesce(max(le) FILTER (abs(le - e) <= 3.0 AND ls >= s - 3.0), any_value(e))) AS e
            FROM spans p LEFT JOIN lines l ON l.video = p.video GROUP BY 1""",
        "expand_keywords": f"""WITH {SPANS}, {LINE}, w AS (SELECT *, {content('query_text')} AS w FROM spans), h AS (SELECT query_id, min(ls) AS lo, max(le) AS hi FROM w JOIN lines l ON l.video = w.video AND le >= s - 8 AND ls <= e + 8 WHERE len(list_filter(w, lambda x: contains({norm('line')}, x))) > 0 GROUP BY 1)
            SELECT query_id, least(s, coalesce(lo, s)) AS s, greatest(e, coalesce(hi, e)) AS e FROM spans LEFT JOIN h USING (query_id)""",
        "merge_spans": f"""WITH {CANDS}, x AS (SELECT query_id, video, scene_id, scene_start, scene_end, round(hybrid_score, 6) AS score FROM cands),
            f AS (SELECT *, max(scene_end) OVER (PARTITION BY query_id, video ORDER BY scene_start, scene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM x),
            k AS (SELECT *, sum((reached IS NULL OR scene_start - reached > 20)::INT) OVER (PARTITION BY query_id, video ORDER BY scene_start, scene_id) AS island FROM f),
            b AS (SELECT *, row_number() OVER (PARTITION BY query_id, video, island ORDER BY CASE WHEN score IS NULL OR isnan(score) THEN '-inf'::DOUBLE ELSE score END DESC, scene_start, scene_id) AS r, min(scene_start) OVER p AS s, max(scene_end) OVER p AS e, count(*) OVER p AS merged FROM k WINDOW p AS (PARTITION BY query_id, video, island))
            SELECT query_id, video, scene_id, s AS scene_start, e AS scene_end, score, merged FROM b WHERE r = 1""",
        "final_rank": f"""WITH {CANDS}, r AS (SELECT query_id, video, scene_id, row_number() OVER (PARTITION BY query_id ORDER BY {', '.join(f"coalesce(CASE WHEN isnan({c}) THEN 0 ELSE {c} END, 0) DESC" for c in ('hybrid_score', 'text_score', 'image_score'))}, video, scene_id) AS place FROM cands)
            SELECT query_id, place, video, scene_id FROM r WHERE place <= 20""",
        "eval_rows": f"WITH {EVAL} SELECT * FROM ev",
        "eval_rollup": f"WITH {EVAL} {_shares('query_type', 'GROUP BY query_type')} UNION ALL {_shares(chr(39) + 'ALL' + chr(39))}",
        "segment_stats": f"WITH {SCENES}, n AS (SELECT coalesce(len(frames), 0) AS n, {strip('subtitle')} AS t FROM scenes) SELECT count(*) AS n_scenes, min(n) AS min_frames, round(avg(n), 6) AS mean_frames, max(n) AS max_frames, sum(n)::BIGINT AS sum_frames, count(*) FILTER (t <> '') AS with_subtitle FROM n",
        "list_columns": f"WITH {SCENES} SELECT video, scene_id, coalesce(len(frames), 0) AS n_frames, coalesce(array_to_string(audio_events, ' '), '') AS event_text FROM scenes",
        "fuzzy_name_match": f"""WITH v AS (SELECT DISTINCT regexp_replace(video, '\\.[^.]+$', '') AS name FROM segments), f AS (SELECT DISTINCT regexp_replace(name, ' S\\d+E\\d+$', '') AS file FROM v UNION SELECT name FROM v),
            m AS (SELECT name, CASE WHEN name = file THEN 0 ELSE 1 END AS rank, 'subs/' || file || '.srt' AS path FROM v, f WHERE contains({plain('name')}, {plain('file')}) OR contains({plain('file')}, {plain('name')})),
            b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank, path) AS k FROM m) SELECT name, path FROM v LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (name)""",
        "hybrid_search": f"WITH {_HYBRID} SELECT query_id, rank_pos, video, scene_id, round(fused, 6) AS hybrid_score, round(t, 6) AS text_score, round(i, 6) AS image_score, round(a, 6) AS audio_score, label AS query_type FROM k",
        "refined_spans": f"WITH {REFINED} SELECT query_id, video, scene_id, round(refined_start, 4) AS refined_start, round(refined_end, 4) AS refined_end, round(grounding_conf, 4) AS grounding_conf FROM refined",
        "ground": f"WITH {GROUND} SELECT query_id, place AS rank_pos, video, scene_id, merged, round(s, 4) AS refined_start, round(e, 4) AS refined_end, round(e - s, 4) AS span_seconds, round(grounding_conf, 4) AS grounding_conf, round(keyword_bonus, 4) AS keyword_bonus, round(raw_score, 4) AS raw_score, round(confidence, 4) AS confidence FROM ground",
        "evaluate": f"WITH {GROUND}, {_evaluated('res AS (SELECT query_id, place AS rank_pos, video, s, e, confidence FROM ground)')} {_shares('query_type', 'GROUP BY query_type')} UNION ALL {_shares(chr(39) + 'ALL' + chr(39))}",
    }
