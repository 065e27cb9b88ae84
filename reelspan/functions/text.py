"""Text functions: normalisation, keyword overlap, query classes, character hits, labels. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that make a query one of action or of dialogue, and the words that carry no content.
ACTION_WORDS = (
    "open opening close walk run sit stand hug kiss eat eating drink grab leave enter look hold pick fridge door couch dancing "
    "cooking reading writing playing watching smoking crying serving fighting sleeping laughing hugging"
).split()
DIALOGUE_WORDS = "say tell ask talk talking conversation discuss joke argue mention explain about says told asks speaks speaking chat discussing admits confesses reveals".split()
STOP_WORDS = "the a an in on at to of and is are was were her his their with from like when then that this for".split()
SILENT = "silent scene no dialogue"
#: Blanks as Unicode has them, for Java's and RE2's expressions.
BLANK = r"(?U)\s"


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def strip(c: Column) -> Column:
    """Without blanks of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_line(c: Column) -> Column:
    """A subtitle line: written line breaks and real ones become blanks, ends are stripped."""
    return strip(F.regexp_replace(F.replace(c, F.lit("\\N"), F.lit(" ")), r"\n", " "))


def embed_text(c: Column) -> Column:
    """What stands for a scene's text when it is encoded; a silent scene has a fixed sentence. Null counts as blank."""
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(s != "", s).otherwise(SILENT)


def norm_text(c: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and blanks made a blank, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^a-z0-9\s]", " "), r"(?U)\s+", " "))


def content_words(c: Column) -> Column:
    """Words of the normalised text longer than two letters that are no stop words; repeated words stay."""
    return F.filter(F.split(norm_text(c), " "), lambda w: (F.length(w) > 2) & ~F.array_contains(_strings(STOP_WORDS), w))


def kw_ratio(words: Column, text: Column) -> Column:
    """Share of the (content) ``words`` that are a substring of the normalised ``text``; no words: 0."""
    t = norm_text(text)
    hits = F.size(F.filter(words, lambda w: F.contains(t, w)))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(F.lit(0.0))


def query_words(c: Column) -> Column:
    """Words by blanks, in lower case, longer than three letters, punctuation kept."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda w: F.length(w) > 3)


def kw_overlap(query: Column, text: Column) -> Column:
    """struct(hits, frac) of the query's words that are a substring of the text in lower case."""
    t = F.lower(F.coalesce(text, F.lit("")))
    words = query_words(query)
    hits = F.size(F.filter(words, lambda w: F.contains(t, w)))
    return F.struct(hits.alias("hits"), F.when(F.size(words) > 0, hits / F.size(words)).otherwise(0.0).alias("frac"))


def class_hits(query: Column) -> Column:
    """struct(action, dialogue): how many distinct words of each class the query has."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(query, F.lit(""))), r"(?U)\s+"))
    return F.struct(F.size(F.array_intersect(words, _strings(ACTION_WORDS))).alias("action"), F.size(F.array_intersect(words, _strings(DIALOGUE_WORDS))).alias("dialogue"))


def classify_query(query: Column) -> Column:
    """``action``, ``dialogue`` or, where neither has more words, ``mixed``."""
    h = class_hits(query)
    return F.when(h["action"] > h["dialogue"], "action").when(h["dialogue"] > h["action"], "dialogue").otherwise("mixed")


def characters_in(text: Column, names: list[str], whole_words: bool = False) -> Column:
    """The ``names`` that occur in the text in lower case: as substrings, or as whole words."""
    t = F.lower(F.coalesce(text, F.lit("")))
    if whole_words:
        padded = F.concat(F.lit(" "), F.regexp_replace(t, r"(?U)[^\w]+", " "), F.lit(" "))
        return F.filter(_strings(names), lambda n: F.contains(padded, F.concat(F.lit(" "), n, F.lit(" "))))
    return F.filter(_strings(names), lambda n: F.contains(t, n))


def character_match(query: Column, subtitle: Column, names: list[str], whole_words: bool = False) -> Column:
    """Share of the query's characters that the subtitle has too; a query without characters: 0."""
    asked = characters_in(query, names, whole_words)
    t = F.lower(F.coalesce(subtitle, F.lit("")))
    hits = F.size(F.filter(asked, lambda n: F.contains(t, n)))
    return F.when(F.size(asked) > 0, hits / F.size(asked)).otherwise(0.0)


def keyword_bonus(ratio: Column, hits: Column, most: float = 0.05) -> Column:
    return F.least(F.lit(most), 0.03 * ratio + 0.005 * hits)


def fmt_time(seconds: Column) -> Column:
    """``MM:SS.ss``; rounded to hundredths first, what is a tie in decimals upwards; minutes are not carried: 59.999 is 00:60.00."""
    m = F.floor(seconds / 60)
    return F.format_string("%02d:%05.2f", m.cast("int"), F.floor((seconds - 60 * m) * 100 + 0.500001) / 100)


def frame_pooling(label: Column, long: bool = True) -> Column:
    """How frames are pooled for a query class: by the greatest for action, else by the mean."""
    return F.when(label == "action", "max-pool (action)" if long else "max-pool").otherwise("mean-pool")


def status(iou: Column) -> Column:
    return F.when(iou >= 0.3, "OK").when(iou > 0, "~~").otherwise("XX")


def cut(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def scene_path(root: Column, kind: str, video: Column, name: Column) -> Column:
    """root/kind/stem of the video/name."""
    return F.concat_ws("/", root, F.lit(kind), F.regexp_replace(video, r"\.[^./]+$", ""), name)
