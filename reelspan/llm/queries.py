"""The pN_ queries, over whole tables, and their SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan.llm import encoding, leximin, markup, mixing, neighbours, packing, pieces, terms
from reelspan.session import once, table

SCORES = ["text_score", "image_score", "audio_score"]


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate's place in its query."""
    r = leximin.leximin_rank(table(spark, d, "candidates").select("query_id", "video", "scene_id", *SCORES), "query_id", ["video", "scene_id"], SCORES)
    return r.select("query_id", "video", "scene_id", "rank_pos", *[f"{s}_pct" for s in SCORES])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    top = leximin.top_of_each(p1_ranking(spark, d), table(spark, d, "gold"), "query_id", "top_k")
    return top.select("query_id", "video", "scene_id")


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar other scenes of every scene, by text and by image."""
    v = table(spark, d, "segment_vectors")
    both = [neighbours.nearest(v, "ord", f"{m}_vec").select(F.lit(m).alias("modality"), "id", "neighbour", "cosine") for m in ("text", "image")]
    return both[0].unionByName(both[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = p2_neighbours(spark, d).where("cosine >= 0.80")
    return pairs.select("modality", F.least("id", "neighbour").cast("int").alias("ord_a"), F.greatest("id", "neighbour").cast("int").alias("ord_b")).distinct()


def _terms(spark: SparkSession, d: str) -> DataFrame:
    seg = once(table(spark, d, "segments").select("video", "scene_id", "subtitle", "audio_events", "ingested_at"), ["video", "scene_id"])
    per = F.explode(F.array(
        F.struct(F.lit("audio_events").alias("f"), terms.labels_of(F.col("audio_events")).alias("t")),
        F.struct(F.lit("subtitle").alias("f"), terms.words_of(F.col("subtitle")).alias("t")),
    )).alias("x")
    return terms.term_totals(seg.select(per).select(F.col("x.f").alias("field_name"), F.col("x.t").alias("terms")))


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and scenes of every label and word, with the band of those too rare or too common."""
    n = table(spark, d, "segments").select("video", "scene_id").distinct().agg(F.count("*").alias("n"))
    return terms.banded(_terms(spark, d), n)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_terms(spark, d).where("band IS NOT NULL").select("field_name", "term", "band")


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "segments").select("video", "scene_id", "subtitle", "ingested_at"), ["video", "scene_id"]).drop("ingested_at")


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    """Scenes with misread lines and their text as it was written, as far as it can be told."""
    return encoding.restored(_scenes(spark, d), "subtitle").where("misread > 0").drop("subtitle")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_restored(spark, d).select("video", "scene_id")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    """The clean text of every scene and the notations it was written in."""
    return markup.without_markup(_scenes(spark, d), "subtitle").drop("subtitle")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    some = _scenes(spark, d).where(markup.may_hold_markup(F.col("subtitle")))
    return markup.without_markup(some, "subtitle").where(F.size("notations") > 0).select("video", "scene_id")


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every piece of those larger than the capacity."""
    return packing.containers(table(spark, d, "documents"), table(spark, d, "containers"))


def p6_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p6_assignment(spark, d), table(spark, d, "containers"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Divided documents: those of the assignment that have a piece starting past their first token."""
    return p6_assignment(spark, d).where("start_token > 0").select("container_kind", "doc_id").distinct()


def p6_balance(spark: SparkSession, d: str) -> DataFrame:
    """Of every kind: tokens and documents assigned, containers over the capacity, pieces of documents that fit whole."""
    a, kinds = p6_assignment(spark, d), table(spark, d, "containers").distinct()
    per = a.groupBy("container_kind", "container_id").agg(F.sum("size_tokens").alias("t")).join(F.broadcast(kinds), "container_kind")
    over = per.groupBy("container_kind").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_over"), F.sum("t").alias("tokens"))
    docs = a.groupBy("container_kind", "doc_id").agg(F.count("*").alias("n"), F.sum("size_tokens").alias("size")).join(F.broadcast(kinds), "container_kind")
    whole = docs.groupBy("container_kind").agg(F.count("*").alias("n_docs"), F.count_if((F.col("n") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("n_divided"))
    return over.join(whole, "container_kind").select("container_kind", "tokens", "n_docs", "n_over", "n_divided")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    source = F.trim(F.lower("source"))
    return table(spark, d, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"),
        F.when(source.isNotNull(), F.array(source)).otherwise(F.array().cast("array<string>")).alias("sources"),
    )


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    """Documents of every mix with how often each is taken."""
    docs = _sized(spark, d)
    return mixing.select_documents(docs, mixing.plan_mixes(docs, table(spark, d, "mix_targets")))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Quota, flow, selected size and share really reached of every target."""
    docs = _sized(spark, d)
    plan = mixing.plan_mixes(docs, table(spark, d, "mix_targets"))
    return mixing.reached(mixing.select_documents(docs, plan), plan)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.plan_mixes(_sized(spark, d), table(spark, d, "mix_targets"))
    return plan.where("pattern IS NULL AND out_of_reach").select("mix_id", "source")


def p7_balance(spark: SparkSession, d: str) -> DataFrame:
    """Quota and flow of every target."""
    plan = mixing.plan_mixes(_sized(spark, d), table(spark, d, "mix_targets")).where("pattern IS NULL")
    return plan.select("mix_id", "source", F.round("quota", 3).alias("quota"), F.round("flow_size", 3).alias("flow"), "out_of_reach")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all documents larger than their source allows."""
    return pieces.split_oversized(table(spark, d, "documents"), table(spark, d, "size_limits"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_pieces(spark, d).where("piece_no = 0").select("doc_id")


def p8_balance(spark: SparkSession, d: str) -> DataFrame:
    """Of every divided document: tokens without overlaps, where the last piece ends, pieces over the limit, gaps between pieces, overlaps too long or needlessly short."""
    lim = table(spark, d, "size_limits").select(F.trim(F.lower("source")).alias("_s"), "max_tokens", "overlap_tokens")
    docs = table(spark, d, "documents").select("doc_id", F.trim(F.lower("source")).alias("_s")).join(F.broadcast(lim), "_s").drop("_s")
    p = p8_pieces(spark, d).drop("piece").join(docs, "doc_id")
    before = Window.partitionBy("doc_id").orderBy("piece_no")  # the pieces of one document
    p = p.withColumn("_end", F.lag("end_char").over(before)).withColumn("_own", F.lag(F.col("size_tokens") - F.col("overlap_size")).over(before))
    # a character has up to four bytes, so an overlap may be three short; a piece shorter than the overlap is repeated whole
    odd = (F.col("overlap_size") > F.col("overlap_tokens")) | (F.col("overlap_size") < F.least(F.col("overlap_tokens") - 3, "_own"))
    return p.groupBy("doc_id").agg(
        F.sum(F.col("size_tokens") - F.col("overlap_size")).alias("own_tokens"), F.max("end_char").alias("end_char"), F.count_if(F.col("size_tokens") > F.col("max_tokens")).alias("n_over"),
        F.count_if(F.col("own_start_char") != F.coalesce("_end", F.lit(0))).alias("n_gaps"), F.count_if((F.col("piece_no") > 0) & odd).alias("n_odd"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [p1_found, p1_ranking, p2_found, p2_neighbours, p3_found, p3_terms, p4_found, p4_restored, p5_found, p5_clean, p6_found, p6_assignment, p6_usage, p6_balance, p7_found, p7_selection, p7_shares, p7_balance, p8_found, p8_pieces, p8_balance]
    return {f.__name__: f for f in names}


_ONCE = """scenes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, scene_id ORDER BY ingested_at) AS rn FROM segments) WHERE rn = 1)"""

_P1 = """
WITH c AS (SELECT query_id, video, scene_id, any_value(text_score) AS text_score, any_value(image_score) AS image_score, any_value(audio_score) AS audio_score
           FROM candidates GROUP BY ALL),
l AS (SELECT query_id, video, scene_id, m, CASE WHEN isnan(s) THEN NULL ELSE s END AS s FROM (
        SELECT query_id, video, scene_id, 1 AS m, text_score AS s FROM c UNION ALL SELECT query_id, video, scene_id, 2, image_score FROM c
        UNION ALL SELECT query_id, video, scene_id, 3, audio_score FROM c)),
v AS (SELECT query_id, m, s, count(*) AS n FROM l WHERE s IS NOT NULL GROUP BY ALL),
flat AS (SELECT query_id, m FROM v GROUP BY ALL HAVING count(*) = 1),
p AS (SELECT query_id, m, s, least(floor((sum(n) OVER (PARTITION BY query_id, m ORDER BY s) - n / 2) / sum(n) OVER (PARTITION BY query_id, m) * 1000000), 999999)::BIGINT AS p FROM v),
x AS (SELECT l.*, CASE WHEN flat.m IS NOT NULL THEN 500000 ELSE p END AS p
      FROM l LEFT JOIN p ON p.query_id = l.query_id AND p.m = l.m AND p.s = l.s LEFT JOIN flat ON flat.query_id = l.query_id AND flat.m = l.m),
w AS (SELECT query_id, video, scene_id, max(p) FILTER (m = 1) AS a, max(p) FILTER (m = 2) AS b, max(p) FILTER (m = 3) AS c FROM x GROUP BY ALL),
f AS (SELECT *, coalesce(floor((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0)), 500000)::BIGINT AS z FROM w),
r AS (SELECT query_id, video, scene_id, a AS text_score_pct, b AS image_score_pct, c AS audio_score_pct,
      row_number() OVER (PARTITION BY query_id ORDER BY list_sort([coalesce(a, z), coalesce(b, z), coalesce(c, z)]) DESC, video, scene_id) AS rank_pos FROM f)
"""
_P3 = f"""
WITH {_ONCE},
t AS (SELECT video, scene_id, 'subtitle' AS field_name, unnest(regexp_extract_all(translate(subtitle, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS term FROM scenes
      UNION ALL SELECT video, scene_id, 'audio_events', trim(regexp_replace(lower(e), '\\s+', ' ', 'g')) FROM (SELECT video, scene_id, unnest(audio_events) AS e FROM scenes)),
k AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT (video, scene_id)) AS records FROM t WHERE term <> '' GROUP BY ALL),
r AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.1 * (SELECT count(*) FROM scenes) THEN 'common' END AS band FROM k)
"""
def _p2_side(name: str, vec: str) -> str:
    return f"""{name} AS (SELECT ord, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM (SELECT ord, any_value({vec})::DOUBLE[] AS v FROM segment_vectors GROUP BY 1)
      WHERE v IS NOT NULL AND NOT isnan(list_sum(v)) AND list_inner_product(v, v) > 0),
{name}_near AS (SELECT a, b FROM (SELECT x.ord AS a, y.ord AS b, list_inner_product(x.u, y.u) AS c, row_number() OVER (PARTITION BY x.ord ORDER BY list_inner_product(x.u, y.u) DESC) AS k
      FROM {name} x, {name} y WHERE x.ord <> y.ord) WHERE k <= 5 AND c >= 0.8)"""


_P2 = f"""WITH {_p2_side('t', 'text_vec')}, {_p2_side('i', 'image_vec')}
SELECT DISTINCT modality, least(a, b)::INT AS ord_a, greatest(a, b)::INT AS ord_b FROM (SELECT 'text' AS modality, * FROM t_near UNION ALL SELECT 'image', * FROM i_near)
"""
_SIZES = """
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS size, trim(lower(source)) AS source FROM documents)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_ranking": _P1 + "SELECT query_id, video, scene_id, rank_pos, text_score_pct, image_score_pct, audio_score_pct FROM r",
        "p1_found": _P1 + "SELECT query_id, video, scene_id FROM r JOIN (SELECT query_id, max(top_k) AS top_k FROM gold GROUP BY 1) g USING (query_id) WHERE rank_pos <= top_k",
        "p3_terms": _P3 + "SELECT field_name, term, occurrences, records, band FROM r",
        "p3_found": _P3 + "SELECT field_name, term, band FROM r WHERE band IS NOT NULL",
        "p6_found": _SIZES + "SELECT container_kind, doc_id FROM d JOIN (SELECT DISTINCT * FROM containers) c ON d.size > c.capacity_tokens",
        "p2_found": _P2,
        "p6_balance": _SIZES + "SELECT container_kind, sum(size)::BIGINT AS tokens, count(*) AS n_docs, 0 AS n_over, 0 AS n_divided FROM d, (SELECT DISTINCT * FROM containers) GROUP BY 1",
        "p7_balance": _SIZES + """, s AS (SELECT source, sum(size) AS size FROM d GROUP BY 1), q AS (SELECT mix_id, m.source, target_share * size_factor * (SELECT sum(size) FROM d) AS quota, max_repeats * coalesce(s.size, 0) AS most
            FROM mix_targets m LEFT JOIN s ON s.source = trim(lower(m.source))) SELECT mix_id, source, round(quota, 3) AS quota, round(least(quota, most), 3) AS flow, quota > most AS out_of_reach FROM q""",
        "p8_balance": """SELECT doc_id, strlen(text) AS own_tokens, length(text) AS end_char, 0 AS n_over, 0 AS n_gaps, 0 AS n_odd
            FROM documents d JOIN size_limits l ON trim(lower(l.source)) = trim(lower(d.source)) WHERE strlen(text) > max_tokens""",
        "p7_found": _SIZES + """SELECT mix_id, m.source FROM mix_targets m LEFT JOIN (SELECT source, sum(size) AS size FROM d GROUP BY 1) s ON s.source = trim(lower(m.source))
            WHERE target_share * size_factor * (SELECT sum(size) FROM d) > max_repeats * coalesce(s.size, 0)""",
        "p8_found": _SIZES + "SELECT doc_id FROM d JOIN size_limits l ON trim(lower(l.source)) = d.source WHERE d.size > max_tokens",
    }
