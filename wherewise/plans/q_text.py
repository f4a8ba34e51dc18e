"""Queries of labels, cues and the parser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..functions.geometry import r9
from ..operators import parsing
from . import oracle as O
from .catalog import query
from .fixtures import Tables, values

_NAMES = values([(c, c) for c in V.categories()] + list(V.synonyms().items()))
_PLURALS = values(list(V.PLURALS.items()))
_CATS = values([(c, p["front"], p["support"], p["container"], p["fixed"], p["small"], p["stable"], p["height"], ",".join(p["cues"])) for c, p in V.categories().items()])
_KEY = "regexp_replace(trim(regexp_replace(regexp_replace(trim(split_part(replace(replace(lower(trim(raw)), '_', ' '), '-', ' '), '/', 1)), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')), '^(the|a|an|this|that|some)\\s+', '')"
#: Ends in n(k, raw, label).
_NORMAL = f"""nm AS (SELECT * FROM {_NAMES} AS v(n, c)), pl AS (SELECT * FROM {_PLURALS} AS v(n, c)), ks AS (SELECT k, raw, {_KEY} AS s FROM fx_raw_labels),
n AS (SELECT k, raw, coalesce((SELECT c FROM nm WHERE n = s), (SELECT c FROM pl WHERE n = s),
  CASE WHEN s LIKE '%ies' AND length(s) > 4 THEN (SELECT c FROM nm WHERE n = concat(left(s, length(s) - 3), 'y')) END, CASE WHEN s LIKE '%es' THEN (SELECT c FROM nm WHERE n = left(s, length(s) - 2)) END,
  CASE WHEN s LIKE '%s' AND s NOT LIKE '%ss' THEN (SELECT c FROM nm WHERE n = left(s, length(s) - 1)) END, CASE WHEN s LIKE '% %' THEN (SELECT c FROM nm WHERE n = regexp_extract(s, '[^ ]+$')) END, s) AS label FROM ks)"""


def labels(x: Tables) -> DataFrame:
    return x.derived("fx_raw_labels").withColumn("key", X.label_key(F.col("raw"))).withColumn("label", X.class_of(F.col("key")))


@query("label_normalize", f"WITH {_NORMAL} SELECT k, raw, label FROM n")
def label_normalize(x: Tables) -> DataFrame:
    return labels(x).select("k", "raw", "label")


_MATCH = "CASE WHEN a.label = '' OR b.label = '' THEN 0.0E0 WHEN a.label = b.label THEN 1.0E0 WHEN regexp_extract(a.label, '[^ ]+$') = regexp_extract(b.label, '[^ ]+$') THEN 0.6E0 WHEN suffix(a.label, b.label) OR suffix(b.label, a.label) THEN 0.7E0 WHEN contains(a.label, b.label) OR contains(b.label, a.label) THEN 0.5E0 ELSE 0.0E0 END"


@query("label_match", f"WITH {_NORMAL}, d AS (SELECT DISTINCT label FROM n) SELECT a.label AS wanted, b.label AS found, {_MATCH} AS score FROM d a JOIN d b ON a.label <= b.label")
def label_match(x: Tables) -> DataFrame:
    """Every pair of distinct classes once: the fuzzy match is made equi by matching distinct labels first."""
    d = labels(x).select("label").distinct()
    a, b = d.withColumnRenamed("label", "wanted"), d.withColumnRenamed("label", "found")
    return a.join(b, F.col("wanted") <= F.col("found")).select("wanted", "found", X.label_match(F.col("wanted"), F.col("found")).alias("score"))


def category_table(x: Tables) -> DataFrame:
    rows = [(c, p["front"], p["support"], p["container"], p["fixed"], p["small"], p["stable"], p["height"], ",".join(p["cues"])) for c, p in V.categories().items()]
    return x.spark.createDataFrame(rows, "label string, has_front boolean, support boolean, container boolean, fixed boolean, small boolean, stable boolean, height double, cues string")


_CAT = f"c AS (SELECT * FROM {_CATS} AS v(label, has_front, support, container, fixed, small, stable, height, cues))"


@query("category_prior", f"WITH {_NORMAL}, {_CAT} SELECT n.k, n.label, coalesce(c.has_front, FALSE) AS has_front, coalesce(c.fixed, FALSE) AS fixed, c.height FROM n LEFT JOIN c ON c.label = n.label")
def category_prior(x: Tables) -> DataFrame:
    known = F.broadcast(category_table(x))  # 120 rows, a constant
    return labels(x).join(known, "label", "left").select("k", "label", F.coalesce("has_front", F.lit(False)).alias("has_front"), F.coalesce("fixed", F.lit(False)).alias("fixed"), "height")


@query("category_flags", f"WITH {_NORMAL}, {_CAT} SELECT n.k, coalesce(c.support, FALSE) AS is_support_surface, coalesce(c.container, FALSE) AS is_container, coalesce(c.fixed, FALSE) AS is_room_fixed, coalesce(c.has_front, FALSE) AS has_intrinsic_front, coalesce(c.cues, '') AS front_cues FROM n LEFT JOIN c ON c.label = n.label")
def category_flags(x: Tables) -> DataFrame:
    cues = X.literal_map({c: ",".join(p["cues"]) for c, p in V.categories().items()})
    f = lambda n: X.flag(F.col("label"), n)
    return labels(x).select("k", f("support").alias("is_support_surface"), f("container").alias("is_container"), f("fixed").alias("is_room_fixed"), f("front").alias("has_intrinsic_front"), F.coalesce(F.element_at(cues, F.col("label")), F.lit("")).alias("front_cues"))


@query("vocab_integrity", f"SELECT CAST(count_if(c.label IS NULL) AS BIGINT) AS dangling, CAST(count_if(s.n IN (SELECT label FROM {_CATS} AS v(label, a1, a2, a3, a4, a5, a6, a7, a8))) AS BIGINT) AS collisions FROM {values(list(V.synonyms().items()))} AS s(n, c0) LEFT JOIN {_CATS} AS c(label, a1, a2, a3, a4, a5, a6, a7, a8) ON c.label = s.c0")
def vocab_integrity(x: Tables) -> DataFrame:
    s = x.spark.createDataFrame(list(V.synonyms().items()), "n string, label string")
    c = category_table(x).select("label")
    dangling = s.join(c, "label", "left_anti").agg(F.count("*").alias("dangling"))
    return dangling.crossJoin(s.join(c, s["n"] == c["label"], "left_semi").agg(F.count("*").alias("collisions")))


@query("scene_find", "SELECT scene_id, id, CASE WHEN label = 'plate' THEN 1.0E0 ELSE 0.6E0 END AS score FROM fx_objects WHERE label = 'plate' OR regexp_extract(label, '[^ ]+$') = 'plate'")
def scene_find(x: Tables) -> DataFrame:
    """Objects that a label finds at 0.6 or more."""
    classes = x.objects.select("label").distinct().select("label", X.class_of(X.label_key(F.col("label"))).alias("class"))
    found = classes.select("label", X.label_match(F.lit("plate"), F.col("class")).alias("score")).where("score >= 0.6")
    return x.objects.join(found, "label").select("scene_id", "id", "score")


@query("scene_labels_counts", "SELECT scene_id, label, count(*) AS n, CAST(count_if(front_x IS NOT NULL) AS BIGINT) AS with_front FROM fx_objects GROUP BY scene_id, label")
def scene_labels_counts(x: Tables) -> DataFrame:
    return x.objects.groupBy("scene_id", "label").agg(F.count("*").alias("n"), F.count("front_x").alias("with_front"))


@query("scene_scale", f"SELECT scene_id, {O.r9('greatest(1.0E0, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) + (ceiling_z - floor_z) * (ceiling_z - floor_z)))')} AS scale FROM fx_rooms")
def scene_scale(x: Tables) -> DataFrame:
    from ..operators import frames

    return x.rooms.select("scene_id", r9(frames.room_scale()).alias("scale"))


_DIST = "SELECT k, label, m, least(1.0E0, (0.1E0 + CAST(k % 5 AS DOUBLE) / 10) / 0.35E0) AS p FROM (SELECT k, label, CASE WHEN label = 'chair' THEN 1.0E0 WHEN regexp_extract(label, '[^ ]+$') = 'chair' THEN 0.6E0 WHEN suffix('chair', label) OR suffix(label, 'chair') THEN 0.7E0 WHEN contains(label, 'chair') OR contains('chair', label) THEN 0.5E0 ELSE 0.0E0 END AS m FROM n) z"


@query("label_distribution_score", f"WITH {_NORMAL} SELECT k, {O.r9('m * p')} AS score FROM ({_DIST}) d WHERE m > 0")
def label_distribution_score(x: Tables) -> DataFrame:
    """Agreement of a stored (label, probability) with the class asked for: match times probability over 0.35."""
    stored = F.array(F.struct(F.col("label"), (0.1 + F.col("k") % 5 / 10).alias("prob")))
    best = F.array_max(F.transform(stored, lambda s: X.label_match(F.lit("chair"), s["label"]) * F.least(F.lit(1.0), s["prob"] / 0.35)))
    return labels(x).select("k", r9(best).alias("score")).where("score > 0")


@query("colour_score", f"SELECT k, {O.r9('greatest(0.05E0, least(1.0E0, greatest(0.0E0, 1.0E0 - sqrt(((r - 0.72E0) * (r - 0.72E0) + (g - 0.15E0) * (g - 0.15E0) + (b - 0.15E0) * (b - 0.15E0))) / sqrt(3.0E0) / 0.55E0)))')} AS red FROM (SELECT p_partkey AS k, CAST(p_partkey % 16 AS DOUBLE) / 16 AS r, CAST(p_partkey % 8 AS DOUBLE) / 8 AS g, CAST(p_partkey % 4 AS DOUBLE) / 4 AS b FROM part) c")
def colour_score(x: Tables) -> DataFrame:
    """How far an object's mean colour is the colour word; never below 0.05."""
    k = F.col("p_partkey")
    rgb = [(k % n).cast("double") / n for n in (16, 8, 4)]
    return x.source("part").select(k.alias("k"), r9(parsing.colour_score(F.array(F.lit("red")), *rgb)).alias("red"))


@query("landmark_lookup", "SELECT scene_id, arg_max(id, hx * hy * hz * 1000000 - id / 1000000.0E0) AS id FROM fx_objects WHERE label = 'gear' GROUP BY scene_id")
def landmark_lookup(x: Tables) -> DataFrame:
    """The largest object of a class, of equals the one with the smallest id."""
    size = F.col("hx") * F.col("hy") * F.col("hz") * 1000000 - F.col("id") / 1000000.0
    return x.objects.where("label = 'gear'").groupBy("scene_id").agg(F.max_by("id", size).alias("id"))


@query("openvocab_similarity", "WITH c AS (SELECT e.vec_id, e.label, t.label AS text_label, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS sim FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) t ON TRUE) SELECT vec_id, CAST(text_label AS BIGINT) AS text_label, " + O.r9("least(1.0E0, greatest(0.0E0, (sim - 0.06E0) / 0.2E0))") + " AS score FROM c")
def openvocab_similarity(x: Tables) -> DataFrame:
    """Cosine of every object's embedding with one vector per label, rescaled; the vectors of texts are one a label, so they are broadcast if small."""
    e = x.source("embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    texts = e.join(first, ["label", "vec_id"]).select(F.col("label").cast("long").alias("text_label"), F.col("embedding").alias("t"))
    sim = F.aggregate(F.zip_with("embedding", "t", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return e.join(texts).select("vec_id", "text_label", r9(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (sim - 0.06) / 0.2))).alias("score"))


_RICH = "SELECT query_id, {} FROM fx_utterances_rich"


@query("txt_clean", "SELECT query_id, lower(text) AS cleaned FROM fx_utterances UNION ALL SELECT -1 - query_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9'' ]+', ' ', 'g'), '\\s+', ' ', 'g'), ' +$', '')) FROM fx_utterances_rich")
def txt_clean(x: Tables) -> DataFrame:
    plain = x.utterances.select("query_id", X.clean(F.concat(F.lit("Please find "), F.initcap("text"), F.lit("?"))).alias("cleaned"))
    return plain.union(x.rich.select((-1 - F.col("query_id")).alias("query_id"), X.clean(F.col("text")).alias("cleaned")))


@query("cue_extract", "SELECT query_id, CASE WHEN frame_hint IS NULL THEN 0 ELSE 1 END AS n_cues, frame_hint AS kind, CASE frame_hint WHEN 'egocentric' THEN 1.0E0 WHEN 'intrinsic' THEN 0.9E0 END AS weight FROM fx_utterances_rich")
def cue_extract(x: Tables) -> DataFrame:
    c = x.rich.select("query_id", X.cues(F.col("text")).alias("c"))
    return c.select("query_id", F.size("c").alias("n_cues"), F.get("c", F.lit(0))["kind"].alias("kind"), F.get("c", F.lit(0))["weight"].alias("weight"))


@query("cue_summary", "SELECT frame_hint AS kind, count(*) AS n, max(CASE frame_hint WHEN 'egocentric' THEN 1.0E0 ELSE 0.9E0 END) AS weight FROM fx_utterances_rich WHERE frame_hint IS NOT NULL GROUP BY frame_hint")
def cue_summary(x: Tables) -> DataFrame:
    """Strongest weight of each kind of cue in the batch."""
    c = x.rich.select(F.explode(X.cues(F.col("text"))).alias("c"))
    return c.groupBy("c.kind").agg(F.count("*").alias("n"), F.max("c.weight").alias("weight"))


_STOP = "|".join(V.STOPS)


@query("cue_np_trim", f"SELECT query_id, array_to_string(list_slice(w, greatest(1, len(w) - 2), len(w)), ' ') AS trimmed FROM (SELECT query_id, [z FOR z IN string_split(regexp_replace(lower(text), '^.*\\b({_STOP})\\b ?', ''), ' ') IF z <> ''] AS w FROM fx_utterances) t")
def cue_np_trim(x: Tables) -> DataFrame:
    """The last three words behind the last preposition or article."""
    return x.utterances.select("query_id", parsing.trim_noun_phrase(F.col("text")).alias("trimmed"))


@query("relation_canonical", "SELECT DISTINCT relation, text AS form FROM (SELECT relation, CASE relation WHEN 'left' THEN 'to the left of' WHEN 'right' THEN 'to the right of' WHEN 'front' THEN 'in front of' WHEN 'behind' THEN 'behind' WHEN 'on' THEN 'on' WHEN 'above' THEN 'above' WHEN 'below' THEN 'under' WHEN 'near' THEN 'near' WHEN 'next_to' THEN 'next to' ELSE 'inside' END AS text FROM fx_utterances) f")
def relation_canonical(x: Tables) -> DataFrame:
    form = F.regexp_extract("text", r"^the \w+ (.*) the \w+$", 1)
    return x.utterances.select(form.alias("form")).distinct().select(parsing.relation_of(F.col("form")).alias("relation"), "form")


@query("relation_type", "SELECT query_id, relation_type FROM fx_utterances")
def relation_type(x: Tables) -> DataFrame:
    return x.utterances.select("query_id", X.relation_type(F.col("relation")).alias("relation_type"))


@query("frame_dependent_type", "SELECT relation_type, relation_type IN ('projective_lateral', 'projective_frontal', 'ordinal') AS dependent, count(*) AS n FROM fx_utterances GROUP BY relation_type")
def frame_dependent_type(x: Tables) -> DataFrame:
    return x.utterances.groupBy("relation_type").agg(F.count("*").alias("n")).withColumn("dependent", F.col("relation_type").isin("projective_lateral", "projective_frontal", "ordinal"))


@query("query_parse", "SELECT query_id, relation, relation_type, target, anchor FROM fx_utterances")
def query_parse(x: Tables) -> DataFrame:
    """Each sentence through the parser, in Arrow batches of distinct texts."""
    q = parsing.parsed(x.utterances.select("query_id", "text"))
    return q.select("query_id", "relation", "relation_type", "target", "anchor")


@query("phrase_parse", "SELECT query_id, target, CASE family WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE anchor END AS anchor, relation, relation_type FROM fx_utterances_rich")
def phrase_parse(x: Tables) -> DataFrame:
    return parsing.parsed(x.rich.select("query_id", "text")).select("query_id", "target", "anchor", "relation", "relation_type")


@query("ordinal_extract", "SELECT query_id, ordinal_index, from_word FROM fx_utterances_rich")
def ordinal_extract(x: Tables) -> DataFrame:
    return parsing.parsed(x.rich.select("query_id", "text")).select("query_id", "ordinal_index", "from_word")


@query("between_split", "SELECT query_id, anchor, anchor2 FROM fx_utterances_rich WHERE family = 4")
def between_split(x: Tables) -> DataFrame:
    return parsing.parsed(x.rich.where("family = 4").select("query_id", "text")).select("query_id", "anchor", "anchor2")


@query("cue_strip", "SELECT query_id, frame_hint, size_word FROM fx_utterances_rich")
def cue_strip(x: Tables) -> DataFrame:
    """What is left of a sentence without its cues still parses; the cue is kept as a hint."""
    return parsing.parsed(x.rich.select("query_id", "text")).select("query_id", "frame_hint", "size_word")


@query("chain_split", "SELECT query_id, CASE WHEN family IN (1, 2) THEN 1 WHEN family = 7 THEN 3 ELSE 2 END AS phrases FROM fx_utterances_rich")
def chain_split(x: Tables) -> DataFrame:
    """Noun phrases of a sentence; relations attach to the one before them."""
    return parsing.parsed(x.rich.select("query_id", "text")).select("query_id", "phrases")


@query("level_extract", "SELECT query_id, 'shelf' AS target, 'middle' AS level_word FROM fx_utterances")
def level_extract(x: Tables) -> DataFrame:
    q = x.utterances.select("query_id", F.lit("the middle shelf").alias("text"))
    return parsing.parsed(q).select("query_id", "target", "level_word")


@query("from_origin_lift", "SELECT query_id, target, 'gear' AS from_landmark, CAST(2 AS BIGINT) AS ordinal_index FROM fx_utterances WHERE target <> 'gear'")
def from_origin_lift(x: Tables) -> DataFrame:
    q = x.utterances.where("target <> 'gear'").select("query_id", F.concat(F.lit("the third "), F.col("target"), F.lit(" from the gear")).alias("text"))
    return parsing.parsed(q).select("query_id", "target", "from_landmark", "ordinal_index")


@query("query_describe", "SELECT query_id, concat(target, ' ', relation, ' ', anchor) AS described FROM fx_utterances")
def query_describe(x: Tables) -> DataFrame:
    return parsing.parsed(x.utterances.select("query_id", "text")).select("query_id", F.concat_ws(" ", "target", "relation", "anchor").alias("described"))


@query("query_json", "SELECT query_id, target AS label, relation FROM fx_utterances")
def query_json(x: Tables) -> DataFrame:
    """A parse through JSON and back."""
    j = parsing.parsed(x.utterances.select("query_id", "text")).select("query_id", F.to_json(F.struct("target", "relation", "anchor")).alias("j"))
    back = F.from_json("j", "target string, relation string, anchor string")
    return j.select("query_id", back.alias("q")).select("query_id", F.col("q.target").alias("label"), "q.relation")


@query("relation_lexicon", None)
def relation_lexicon(x: Tables) -> DataFrame:
    from ..functions.parser import lexicon

    return x.spark.createDataFrame(sorted((f, r, n) for n, t in lexicon().items() for f, r in t.items()), "form string, relation string, words int")


@query("rel_registry", "SELECT * FROM " + values([(r, f, f == "projective", n) for r, (f, n, _) in V.relations().items()]) + " AS v(relation, family, frame_dependent, anchors)")
def rel_registry(x: Tables) -> DataFrame:
    return x.spark.createDataFrame([(r, f, f == "projective", n) for r, (f, n, _) in V.relations().items()], "relation string, family string, frame_dependent boolean, anchors int")


@query("resolve_text", None)
def resolve_text(x: Tables) -> DataFrame:
    """Raw sentences to objects: parse, bind, score, rank and flag."""
    from ..operators import resolver

    parsed = parsing.parsed(x.utterances.select("query_id", "text")).where("relation is not null and anchor is not null").select("query_id", "relation", "relation_type", "target", "anchor")
    q = x.utterances.select("query_id", "scene_id", "eye_x", "eye_y").join(parsed, "query_id")
    return resolver.resolve(q, x.objects, x.rooms)
