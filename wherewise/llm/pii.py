"""Personal data: fixed patterns, then information-theoretic sanitisation of what the corpus ties to them.

Base spans (email, ip, card, phone) come from the contract's patterns: leftmost, non-overlapping by kind; matches that fail
their test are dropped without retries.

Protected entities are the kinds of base spans and their values. How far a term reveals an entity is estimated from co-occurrence
by document, over all texts: P(e | t) = (n_te + PRIOR p(e)) / (n_t + PRIOR), smoothed towards p(e), the entity's share of texts; the
pointwise mutual information log2 P(e | t) / p(e), as a share of the entity's information content -log2 p(e), is what the term
discloses of it. A term discloses an entity if that share reaches GENERALISE and the entity is likelier than not (EVEN) where the
term stands; from REMOVE on it is removed, else it is replaced by its class ([WORD], [NUMBER]). Terms that do are flagged wherever they
occur, in texts without base spans too.

What counts as one: with a kind, texts whose smallest value of that kind differs, so that copies of one text and near ones count
once, however many share its data; with a value, texts, as far as the term stands between different neighbours there (texts times
the share of different neighbours among the texts with entities that have the term). Without any entity, each document counts. One text alone
discloses nothing, as its smoothed odds stay below EVEN; two can.

Only DataFrame operations. Words of all texts are counted by 64-bit hash with map-side sums, of terms that texts with entities have
(where these are few enough to be broadcast, else of all). Only terms that stand with entities at least about as often as without go on to
be paired; values that the same texts hold stand for each other there, as do terms, so a list of addresses in a text isn't multiplied
by its words. Patterns use possessive repeats and start conditions that leave the matches as they are.

Cases: a null text is an empty one (no spans). Positions are code points, ends exclusive. Repeated rows are returned as they
are. Terms that touch a base span are no spans. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of
from .spans import guarded, let, merged, no_spans, ordered, replaced, spans_of

# fixed values of the contract, with linear-time equivalents: the start conditions hold at every leftmost match
_LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Weight, in texts, of an entity's share of all texts when its odds beside a term are estimated; odds from which a term may disclose.
PRIOR, EVEN = 2.0, 0.5
#: Shares of an entity's information content from which a term is generalised or removed.
GENERALISE, REMOVE = 0.75, 0.95
#: Candidate terms, flagged terms and texts with flagged terms that are broadcast at most (8, 12 and some 100 bytes each).
BROADCAST_TERMS, BROADCAST_TEXTS = 500_000, 200_000
#: What counts as a term.
TERM = r"[\p{L}\p{N}]{3,}+"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s["value"], "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """By kind the spans that pass their test. What must be in a match is looked for first."""
    return {
        "email": guarded(F.contains(text, F.lit("@")), text, EMAIL, "email", lambda s: F.lit(True)),
        "ip": guarded(text.rlike(r"[0-9]\.[0-9]"), text, IP, "ip", lambda s: s["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        "card": guarded(text.rlike(r"[0-9][\x20-]?[0-9]"), text, CARD, "card", lambda s: F.char_length(_digits(s)).between(14, 19) & F.call_function("luhn_check", _digits(s))),
        "phone": guarded(F.contains(text, F.lit("+")), text, PHONE, "phone", lambda s: F.char_length(_digits(s)).between(10, 15)),
    }


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_terms: int = BROADCAST_TERMS, broadcast_texts: int = BROADCAST_TEXTS) -> DataFrame:
    """doc_id, base (array of spans), by kind n_*, terms (array of spans of kind term; value is the action), sanitised (the text with base
    spans replaced by their kind and terms generalised or removed; null without spans). One row per input row."""
    start = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    found = start.select("doc_id", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    some = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    # texts go on only where there is something to protect
    held = found.select("doc_id", F.xxhash64("text").alias("text_key"), F.when(some, F.col("text")).alias("text"), ordered(F.concat(*[F.col(k) for k in KINDS]), KINDS).alias("base"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS])
    held = cut(held, "pii-base")
    actions = disclosing(start, held, broadcast_terms)
    flagged = cut(_flagged(start, actions, broadcast_terms, broadcast_texts), "pii-flagged")
    out = held.join(flagged, "text_key", "left")
    free = F.filter(F.coalesce("terms", no_spans()), lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (t["end"] > b["start"])))
    out = out.select("doc_id", "base", *[f"n_{k}" for k in KINDS], free.alias("terms"), F.coalesce("text", "flagged_text").alias("text"))
    return out.select("doc_id", "base", *[f"n_{k}" for k in KINDS], "terms", sanitised(F.col("text"), F.col("base"), F.col("terms")).alias("sanitised"))


def sanitised(text: Column, base: Column, terms: Column) -> Column:
    """The text with base spans replaced by [KIND] and terms (which touch no base span) by their class or nothing; null where nothing
    was found. Of base spans that overlap, the first names the kind of them all."""

    def put(s: Column) -> Column:
        number = F.substring(text, s["start"] + 1, s["end"] - s["start"]).rlike(r"^\p{N}+$")
        as_term = F.when(s["value"] == "remove", F.lit("")).when(number, F.lit("[NUMBER]")).otherwise(F.lit("[WORD]"))
        return F.when(s["kind"] == "term", as_term).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    return F.when(F.size(base) + F.size(terms) > 0, replaced(text, merged(F.concat(base, terms), "kind", "value"), put))


def _words(text: Column) -> Column:
    """The distinct terms of a text, as hashes."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(w)))


def disclosing(start: DataFrame, held: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(term, action): hashes of terms that disclose an entity, and what becomes of them, 'generalise' or 'remove'."""
    once = held.where("text is not null").groupBy("text_key").agg(F.first("text").alias("text"), F.first("base").alias("base"))
    # words in the order of the text, with base spans as words of their own that aren't terms
    shapes = "|".join(f"(?:{x})" for x in (EMAIL, IP, CARD, PHONE, TERM))
    beside = lambda w: F.transform(w, lambda x, i: F.struct(F.when(x.rlike(rf"^{TERM}$"), F.xxhash64(x)).alias("term"), F.xxhash64(F.get(w, i - 1), F.get(w, i + 1)).alias("around")))
    around = let(F.regexp_extract_all(F.lower("text"), F.lit(shapes), F.lit(0)), beside)
    # no array_distinct over structs, which compares all with all: repeats go after the explode
    entity = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), F.xxhash64(b["kind"], b["value"]).alias("entity")))
    seen = cut(once.select("text_key", entity.alias("entities"), F.filter(around, lambda x: x["term"].isNotNull()).alias("terms")), "pii-terms")
    in_texts = seen.select("text_key", F.explode(F.array_distinct(F.transform("terms", lambda t: t["term"]))).alias("term"))
    held_n = cut(in_texts.groupBy("term").agg(F.count("*").alias("n_in")).where("n_in > 1"), "pii-candidates")

    # in how many documents a term is: over every word of every text; those with entities are taken off
    def documents(texts: DataFrame, name: str) -> DataFrame:
        words = texts.select(F.explode(_words(F.col("text"))).alias("term"))
        if held_n.limit(broadcast_terms + 1).count() <= broadcast_terms:
            words = words.join(F.broadcast(held_n.select("term")), "term", "left_semi")
        return words.groupBy("term").agg(F.count("*").alias(name))

    counts = held_n.join(documents(start, "n_all"), "term").join(documents(held.where("text is not null"), "n_rows"), "term").withColumn("n_out", F.col("n_all") - F.col("n_rows"))
    # others can't reach EVEN: they stand more often without any entity than with one
    kept = cut(counts.where("n_in + 2 >= n_out").select("term", "n_in", "n_out"), "pii-kept")
    near = seen.select("text_key", F.explode("terms").alias("t")).select("text_key", "t.term", "t.around")
    near = near.join(F.broadcast(kept.select("term")) if kept.limit(broadcast_terms + 1).count() <= broadcast_terms else kept.select("term"), "term", "left_semi")
    near = cut(near, "pii-near")
    n_around = near.select("term", "around").distinct().groupBy("term").agg(F.count("*").alias("n_around"))
    stats = cut(kept.join(n_around, "term"), "pii-stats")
    texts = cut(near.select("text_key", "term").distinct(), "pii-texts")
    total = F.lit(float(held.select("text_key").distinct().count()))
    entities = seen.select("text_key", F.explode("entities").alias("e")).select("text_key", "e.kind", "e.entity")

    def judged(pairs: DataFrame) -> DataFrame:
        """Of rows (term, n_te, n_t, n_e)."""
        p = F.col("n_e") / total
        odds = (F.col("n_te") + PRIOR * p) / (F.col("n_t") + PRIOR)
        share = F.when(p < 1, F.log2(odds / p) / -F.log2(p))
        action = F.when(share >= REMOVE, "remove").when(share >= GENERALISE, "generalise")
        return pairs.select("term", F.when(odds >= EVEN, action).alias("action")).where("action is not null")

    # kinds: texts are told apart by their smallest value
    kinds = cut(entities.groupBy("text_key", "kind").agg(F.min("entity").alias("value")), "pii-kinds")
    n_kind = F.broadcast(kinds.groupBy("kind").agg(F.count("*").alias("n_e")))
    both = texts.join(kinds, "text_key").groupBy("term", "kind").agg(F.count("*").alias("n_both"), F.count_distinct("value").alias("n_te"))
    by_kind = judged(both.join(stats, "term").join(n_kind, "kind").withColumn("n_t", F.col("n_out") + F.col("n_in") - F.col("n_both") + F.col("n_te")))

    # values: those that the same texts hold are one class, as are terms
    values = _classes(entities.select("text_key", F.col("entity").alias("member")).distinct(), 2)
    terms = _classes(texts.select("text_key", F.col("term").alias("member")), 1)
    pairs = terms[1].select("text_key", F.col("cls").alias("t_cls")).join(values[1].select("text_key", F.col("cls").alias("e_cls"), F.col("size").alias("n_e")), "text_key")
    pairs = pairs.groupBy("t_cls", "e_cls", "n_e").agg(F.count("*").alias("n_both"))
    fresh = F.least(F.lit(1.0), F.col("n_around") / F.col("n_in"))
    members = terms[0].select(F.col("cls").alias("t_cls"), F.col("member").alias("term"))
    by_value = judged(pairs.join(members, "t_cls").join(stats, "term").withColumn("n_te", F.col("n_both") * fresh).withColumn("n_t", F.col("n_out") + F.col("n_in") * fresh))
    return cut(by_kind.unionByName(by_value).groupBy("term").agg(F.max("action").alias("action")), "pii-actions")


def _classes(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Of distinct rows (text_key, member): (member, cls) and (text_key, cls, size), where members of the same texts share a class; only
    members of at least `least` texts."""
    sign = rows.groupBy("member").agg(F.count("*").alias("size"), F.sum(F.xxhash64("text_key").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64("text_key", F.lit(1)).cast("decimal(38,0)")).alias("y"))
    sign = cut(sign.where(F.col("size") >= least).select("member", "size", F.xxhash64("size", "x", "y").alias("cls")), "pii-classes")
    first = sign.groupBy("cls").agg(F.min("member").alias("member"), F.first("size").alias("size"))
    return sign.select("member", "cls"), cut(rows.join(first, "member").select("text_key", "cls", "size"), "pii-sets")


def _flagged(start: DataFrame, actions: DataFrame, broadcast_terms: int, broadcast_texts: int) -> DataFrame:
    """(text_key, flagged_text, terms): the texts that have terms with an action, once each, and the spans of these terms."""
    few = actions.limit(broadcast_terms + 1).count() <= broadcast_terms
    keyed = start.select(F.xxhash64("text").alias("text_key"), "text")
    words = keyed.select("text_key", F.explode(_words(F.col("text"))).alias("term")).join(F.broadcast(actions) if few else actions, "term")
    hits = cut(words.distinct().groupBy("text_key").agg(F.collect_list(F.struct("term", "action")).alias("hits")), "pii-hits")
    if hits.limit(broadcast_texts + 1).count() <= broadcast_texts:
        hits = F.broadcast(hits)
    once = keyed.join(hits, "text_key").dropDuplicates(["text_key"])
    action = lambda s: let(F.xxhash64(F.lower(s["value"])), lambda h: F.get(F.filter("hits", lambda x: x["term"] == h), F.lit(0))["action"])
    spans = F.transform(spans_of(F.col("text"), TERM, "term"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), action(s).alias("value")))
    return once.select("text_key", F.col("text").alias("flagged_text"), F.filter(spans, lambda s: s["value"].isNotNull()).alias("terms"))
