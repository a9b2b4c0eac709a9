"""Entity resolution against a catalog: exact first, then fuzzy with an ambiguity report.

Catalogs are dimensions: their size is counted and checked before they are broadcast. Names
of a catalog of more than a few entries are found through the indexes of ``nearest``, which
prove that no better entry was missed. Only distinct queries are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import boundary_aligned, header_index, line_windows, lines_of, normalize_identity, similarity
from ..storage import stage
from .nearest import GRAM, best_two, containing

#: Catalog entries that may be broadcast, and those that each distinct query meets without an index.
MOST_ENTRIES, FEW_ENTRIES = 200_000, 1_000
THRESHOLD, AMBIGUITY_GAP, SHORTEST = 0.68, 0.05, 4


def small(df: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """df for broadcasting, after its size has been counted."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a catalog of over {most} entries; constrain the pool before matching")
    return F.broadcast(df)


def paired(left: DataFrame, right: DataFrame, on: Column, most: int = MOST_ENTRIES) -> DataFrame:
    """left joined with right on a condition that needn't be an equality.

    Up to ``most`` rows of right are broadcast; more are dealt by hash into blocks of about
    that size, and each row of left is sent to every block.
    """
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), on)
    blocks = -(-right.count() // most)
    dealt = right.withColumn("_block", F.pmod(F.xxhash64(*right.columns), F.lit(blocks)).cast("int"))
    sent = left.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return sent.join(dealt, (F.col("_to") == F.col("_block")) & on).drop("_to", "_block")


def _pick(scored: DataFrame, key: str, threshold: float) -> DataFrame:
    """Best and runner-up of each key by score, boundary, longer name, name (SRT3, WIN1)."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("edge"), F.desc(F.length("norm")), "name")
    ranked = scored.withColumn("_k", F.row_number().over(order)).where("_k <= 2")
    at = lambda n, c: F.max(F.when(F.col("_k") == n, F.col(c)))
    best = ranked.groupBy(key).agg(at(1, "name").alias("first"), at(1, "score").alias("score"), at(2, "name").alias("runner_up"), at(2, "score").alias("runner_up_score"))
    f = lambda x: F.lit(x).cast("float")
    ambiguous = F.coalesce((F.col("first") != F.col("runner_up")) & ((F.col("score") - F.col("runner_up_score")).cast("float") < f(AMBIGUITY_GAP)), F.lit(False))
    return best.select(key, F.when(F.col("score") >= f(threshold), F.col("first")).alias("entry"), "score", ambiguous.alias("ambiguous"), "runner_up", "runner_up_score")


def match(queries: DataFrame, catalog: DataFrame, key: str, text: str, name: str, threshold: float = THRESHOLD, pool: Column | None = None, few: int = FEW_ENTRIES) -> DataFrame:
    """(key, entry, score, ambiguous, runner_up, runner_up_score) for every query (ER3, J4, J7).

    An equal normalised name wins at once; queries of fewer than four characters only get
    their best score; below threshold the entry is null but scores are still reported.
    pool, a condition over columns of queries (``q_``) and catalog (``c_``), limits the
    catalog a query is compared with. A catalog of up to few entries is broadcast and
    compared whole; a larger one is searched by index, with the same rows.
    """
    q = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns)).withColumn("query", normalize_identity(F.coalesce(F.col(f"q_{text}"), F.lit(""))))
    alike = [c for c in q.columns if c not in (f"q_{key}", f"q_{text}")] if pool is not None else ["query"]
    q = q.withColumn("_alike", F.to_json(F.struct(*alike)))
    asked = q.select(F.col(f"q_{key}").alias(key), "_alike")
    q = q.select("_alike", *alike).distinct()  # every other column follows from _alike
    c = catalog.select(*(F.col(x).alias(f"c_{x}") for x in catalog.columns)).withColumn("norm", normalize_identity(F.col(f"c_{name}"))).where("norm <> ''")
    c = c if pool is not None else c.select(F.col(f"c_{name}"), "norm").distinct()
    k = "_alike"
    within = F.lit(True) if pool is None else pool
    exact = q.join(c, (F.col("query") == F.col("norm")) & within).groupBy(k).agg(F.min(f"c_{name}").alias("entry"))
    exact = exact.select(k, "entry", F.lit(1).cast("float").alias("score"), F.lit(False).alias("ambiguous"), F.lit(None).cast("string").alias("runner_up"), F.lit(None).cast("float").alias("runner_up_score"))
    rest = q.join(exact.select(k), k, "left_anti").where("query <> ''")
    if c.limit(few + 1).count() <= few:
        met = rest.join(F.broadcast(c), within)
        scored = met.select(k, "query", F.col(f"c_{name}").alias("name"), "norm", similarity(F.col("query"), F.col("norm")).alias("score"), boundary_aligned(F.col("query"), F.col("norm")).alias("edge"))
    else:
        asked_, entries = stage(rest.withColumn("qid", F.monotonically_increasing_id()), "queries"), stage(c.withColumn("eid", F.monotonically_increasing_id()), "entries")
        need = F.when(F.length("query") < SHORTEST, 1).otherwise(2)
        met = best_two(asked_, entries, None if pool is None else within, need).join(asked_.select("qid", k, "query"), "qid").join(entries.select("eid", F.col(f"c_{name}").alias("name"), "norm"), "eid")
        scored = met.select(k, "query", "name", "norm", "score", "edge")
    short = scored.where(F.length("query") < SHORTEST).groupBy(k).agg(F.max("score").alias("score"))
    short = short.select(k, F.lit(None).cast("string").alias("entry"), "score", F.lit(False).alias("ambiguous"), F.lit(None).cast("string").alias("runner_up"), F.lit(None).cast("float").alias("runner_up_score"))
    fuzzy = _pick(scored.where(F.length("query") >= SHORTEST), k, threshold)
    found = exact.unionByName(short).unionByName(fuzzy)
    blank = F.lit(0).cast("float")
    return asked.join(found, k, "left").drop(k).withColumn("score", F.coalesce("score", blank)).withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def match_constrained(queries: DataFrame, catalog: DataFrame, key: str, text: str, name: str, pool: Column, threshold: float = THRESHOLD) -> DataFrame:
    """match within the pool; a query whose pool is empty is matched against all, with widened set (J7, ER9)."""
    q = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))
    c = catalog.select(*(F.col(x).alias(f"c_{x}") for x in catalog.columns))
    has = q.join(c, pool, "left_semi").select(F.col(f"q_{key}").alias(key))
    narrow = match(queries.join(has, key, "left_semi"), catalog, key, text, name, threshold, pool).withColumn("widened", F.lit(False))
    wide = match(queries.join(has, key, "left_anti"), catalog, key, text, name, threshold).withColumn("widened", F.lit(True))
    return narrow.unionByName(wide)


def cascade(candidates: DataFrame, key: str, stage_col: str, score: str = "score", entry: str = "entry", accept: float = 0.75, stop: float = 0.90) -> DataFrame:
    """The winning candidate of each key over ordered stages (ER7).

    A later stage counts only while no earlier one reached accept; among those that count the
    best score wins, the earliest stage among equals, and once one reaches stop none after it
    counts.
    """
    w = Window.partitionBy(key).orderBy(stage_col)
    before = F.max(score).over(w.rangeBetween(Window.unboundedPreceding, -1))
    f = lambda x: F.lit(x).cast("float")
    usable = candidates.where(F.col(entry).isNotNull()).withColumn("_before", F.coalesce(before, f(0)))
    usable = usable.where(F.col("_before") < F.when(F.col(stage_col) <= 1, f(accept)).otherwise(f(stop)))
    best = Window.partitionBy(key).orderBy(F.desc(score), stage_col, entry)
    return usable.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "_before")


def zone_text(lines: Column) -> Column:
    """Lines of a text zone cleaned for matching: leading symbols and tags, trailing notes, runs of blanks (ER11)."""
    strip = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^[^A-Za-z]*", ""), r"^[A-Z]{1,3}\s+", ""), r"[&@(].*$", ""), r"\s+", " "))
    return F.filter(F.transform(lines, strip), lambda x: F.length(x) >= 4)


def member(values: Column, v: Column) -> Column:
    """Whether an array holds a text, ignoring case (FLT2)."""
    return F.coalesce(F.exists(values, lambda x: F.lower(x) == F.lower(v)), F.lit(False))


def _choice(value: Column, confidence: Column, source: str, settles: Column) -> Column:
    return F.struct(value.alias("value"), confidence.cast("float").alias("confidence"), F.lit(source).alias("source"), settles.alias("settles"))


def arbitrate(icon: Column, icon_confidence: Column, text: Column, text_confidence: Column, legal: Column) -> Column:
    """struct(value, confidence, source, settles) of an icon's and a text's reading, null without an icon (ER12).

    A text that differs from the icon wins if it is legal for the entity; then, if the icon
    isn't, the contradiction between entity and evidence is settled. Without an entity
    (legal is null) everything is legal.
    """
    ok = lambda v: legal.isNull() | member(legal, v)
    other = text.isNotNull() & (F.lower(text) != F.lower(icon))
    return F.when(icon.isNotNull(), F.when(F.coalesce(other & ok(text), F.lit(False)), _choice(text, text_confidence, "text", ~ok(icon))).otherwise(_choice(icon, icon_confidence, "icon", F.lit(False))))


def without_icon(header: Column, line: Column, matched: Column, score: Column, legal: Column) -> Column:
    """struct(value, confidence, source, settles) where there is no icon, or null (ER13).

    header: the heading's place among the lines, 0 without one; line: the cleaned line after
    it; matched and score: the line's best entry at 0.55. The line as it is has 0.30; without
    a heading the entity's first legal value has 0.50.
    """
    has, default = F.length(line) > 0, F.get(legal, F.lit(0))
    no = F.lit(False)
    return (
        F.when((header > 0) & has & matched.isNotNull(), _choice(matched, score, "text", no))
        .when((header > 0) & has, _choice(line, F.lit(0.30), "raw", no))
        .when((header == 0) & default.isNotNull(), _choice(default, F.lit(0.50), "catalog", no))
    )


def after_header(lines: Column, *words: str) -> Column:
    """The line after the heading, from its first @ or bracket on cut off, blanks squeezed (ER13)."""
    at = header_index(F.transform(lines, F.lower), *(w.lower() for w in words))
    line = F.when(at > 0, F.get(lines, at))
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"[@\(].*$", ""), r"\s+", " "))


def zone_set(df: DataFrame, key: str, text: str, sets: DataFrame, name: str, threshold: float = 0.70) -> DataFrame:
    """(key, value, confidence): the best set that a line of a text zone names, the earliest line among equals (ER11)."""
    lines = df.select(key, F.posexplode(zone_text(lines_of(F.coalesce(F.col(text), F.lit(""))))).alias("_pos", "_line"))
    lines = lines.withColumn("_id", F.struct(key, "_pos"))
    found = match(lines.select("_id", "_line"), sets, "_id", "_line", name, threshold).where("entry is not null")
    best = F.max_by(F.struct("entry", "score"), F.struct("score", -F.col("_id._pos")))
    return found.groupBy(F.col(f"_id.{key}").alias(key)).agg(best.alias("b")).select(key, F.col("b.entry").alias("value"), F.col("b.score").alias("confidence"))


def contradicted(score: Column, cost: Column, entry_cost: Column, share: float = 0.8) -> Column:
    """A name's score, cut where the cost that was read isn't its entry's (ER10)."""
    f = lambda c: c.cast("float")
    return F.when(cost != entry_cost, f(f(score) * f(F.lit(share)))).otherwise(f(score))


def candidate_texts(df: DataFrame, key: str, text: str, alternate: str | None = None) -> DataFrame:
    """(key, stage, pos, text): the whole text (0), its two-line windows (1), and of an alternate read the whole (2) and its lines (3) (ER7)."""
    whole = lambda c, s: F.array(F.struct(F.lit(s).alias("stage"), F.lit(0).alias("pos"), c.alias("text")))
    each = lambda c, s: F.transform(c, lambda x, i: F.struct(F.lit(s).alias("stage"), i.alias("pos"), x.alias("text")))
    parts = [whole(F.col(text), 0), each(line_windows(lines_of(F.coalesce(F.col(text), F.lit("")))), 1)]
    if alternate is not None:
        parts += [whole(F.col(alternate), 2), each(lines_of(F.coalesce(F.col(alternate), F.lit(""))), 3)]
    return df.select(key, F.inline(F.concat(*parts)))


def name_cascade(df: DataFrame, catalog: DataFrame, key: str, text: str, name: str, alternate: str | None = None, pool: Column | None = None, accept: float = 0.75, stop: float = 0.90, threshold: float = THRESHOLD) -> DataFrame:
    """(key, entry, score, stage) by the name cascade (ER7, steps a to c).

    The whole text counts first. Below accept its windows are tried while the score is below
    stop; a window that is strictly better counts even if it is below the threshold and so
    has no entry. Below accept still, the alternate read counts, then its lines while the
    score is below stop; these only with an entry. All candidates are matched at once and
    folded in order.
    """
    cand = candidate_texts(df, key, text, alternate).withColumn("_id", F.struct(key, "stage", "pos"))
    others = df.drop(text, *([alternate] if alternate else []))
    asked = cand.select(key, "_id", "text").join(others, key) if pool is not None else cand.select("_id", "text")
    found = match(asked, catalog, "_id", "text", name, threshold, pool)
    f = lambda x: F.lit(x).cast("float")
    row = F.struct(F.col("_id.stage").alias("stage"), F.col("_id.pos").alias("pos"), "entry", "score")
    grouped = found.groupBy(F.col(f"_id.{key}").alias(key)).agg(F.array_sort(F.collect_list(row)).alias("c"))
    start = F.struct(F.lit(None).cast("string").alias("entry"), f(-1.0).alias("score"), F.lit(-1).alias("stage"), F.lit(-1).alias("part"), f(-1.0).alias("gate"))

    def step(acc: Column, c: Column) -> Column:
        part = F.least(c["stage"], F.lit(2))
        gate = F.when(part != acc["part"], acc["score"]).otherwise(acc["gate"])
        open_ = (part == 0) | ((gate < f(accept)) & ((c["stage"] == 2) | (acc["score"] < f(stop))))
        better = open_ & (c["score"] > acc["score"]) & ((c["stage"] <= 1) | c["entry"].isNotNull())
        keep = lambda x: F.when(better, c[x]).otherwise(acc[x]).alias(x)
        return F.struct(keep("entry"), keep("score"), keep("stage"), part.alias("part"), gate.alias("gate"))

    out = grouped.select(key, F.aggregate("c", start, step).alias("r"))
    return df.select(key).join(out, key, "left").select(key, "r.entry", F.coalesce("r.score", f(0.0)).alias("score"), F.when(F.col("r.entry").isNotNull(), F.col("r.stage")).alias("stage"))


def name_in_pool(df: DataFrame, catalog: DataFrame, key: str, text: str, name: str, pool: Column, alternate: str | None = None, reread: str | None = None, accept: float = 0.75, stop: float = 0.90, threshold: float = THRESHOLD) -> DataFrame:
    """(key, entry, score, stage, contradicts): the cascade within the pool, else within the whole catalog, else over a second read (ER7, steps d and e).

    contradicts says that no entry of the pool fits, or the pool is empty; a second read that
    hits within the pool clears it.
    """
    found = stage(name_cascade(df, catalog, key, text, name, alternate, pool, accept, stop, threshold).withColumn("contradicts", F.lit(False)), "names in pool")
    for column, within in ((text, None), *(((reread, pool), (reread, None)) if reread else ())):
        none = found.where("entry is null").select(key)
        if none.isEmpty():
            break
        again = name_cascade(df.join(none, key, "left_semi"), catalog, key, column, name, alternate if column == text else None, within, accept, stop, threshold).where("entry is not null")
        again = stage(again.withColumn("contradicts", F.lit(within is None)), "names found later")
        found = found.join(again.select(key), key, "left_anti").unionByName(again)
    return found.withColumn("contradicts", F.col("contradicts") | F.col("entry").isNull())


def collisions(catalog: DataFrame, name: str, least: int = GRAM) -> DataFrame:
    """(inner, outer): names of which one's normal form contains another's of at least ``least`` (five or more) characters."""
    if least < GRAM:
        raise ValueError(f"names are looked up by {GRAM} characters")
    names = catalog.select(F.col(name).alias("name")).distinct().withColumn("norm", normalize_identity(F.col("name")))
    a, b = names.toDF("inner", "a").where(F.length("a") >= least), names.toDF("outer", "b")
    return containing(a, b, "a", "b").where("a <> b").select("inner", "outer")


def template_scores(samples: DataFrame, templates: DataFrame, key: str, vector: str, name: str, template: str) -> DataFrame:
    """(key, _template, _score): of each template the best L1 score of a key's samples (VS3)."""
    from ..functions.vectors import l1_score

    t = templates.select(F.col(name).alias("_template"), F.col(template).alias("_vector"))
    scored = paired(samples.where(F.size(vector) > 0), t, F.lit(True)).select(key, "_template", l1_score(F.col(vector), F.col("_vector")).alias("_score"))
    return scored.groupBy(key, "_template").agg(F.max("_score").alias("_score"))


def rank_all(samples: DataFrame, templates: DataFrame, key: str, vector: str, name: str, template: str, k: int | None = None) -> DataFrame:
    """(key, rank, name, score): all templates of each key, or the k best, best first (VS5, TOP2)."""
    w = Window.partitionBy(key).orderBy(F.desc("_score"), "_template")
    ranked = template_scores(samples, templates, key, vector, name, template).withColumn("rank", F.row_number().over(w))
    ranked = ranked.where(F.col("rank") <= k) if k is not None else ranked
    return ranked.select(key, "rank", F.col("_template").alias("name"), F.col("_score").alias("score"))


def icon_warnings(samples: DataFrame, templates: DataFrame, key: str, vector: str, name: str, template: str, margin: float = 0.003, top: int = 3) -> DataFrame:
    """(key, best, runner_up, margin, candidates) of keys whose best template leads by less than margin (VS6)."""
    near = rank_templates(samples, templates, key, vector, name, template).where(F.col("best").isNotNull() & (F.col("margin") < margin))
    names = rank_all(samples, templates, key, vector, name, template, top).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("_names"))
    return near.join(names, key).select(key, "best", "runner_up", "margin", F.transform("_names", lambda x: x["name"]).alias("candidates"))


def rank_templates(samples: DataFrame, templates: DataFrame, key: str, vector: str, name: str, template: str, floor: float = 0.48, single: float = 0.42) -> DataFrame:
    """(key, best, score, runner_up, margin, confidence): nearest template by L1 score (VS3-VS6, TOP2).

    margin is 1 without a runner-up; best is null and confidence 0 below floor (single, where
    there is but one template); confidence min(.96, .55 + .4 score).
    """
    floor = single if templates.limit(2).count() == 1 else floor
    scored = template_scores(samples, templates, key, vector, name, template)
    w = Window.partitionBy(key).orderBy(F.desc("_score"), "_template")
    ranked = scored.withColumns({"_k": F.row_number().over(w), "_next": F.lead("_template").over(w), "_next_score": F.lead("_score").over(w)}).where("_k = 1")
    return ranked.select(
        key, F.when(F.col("_score") >= floor, F.col("_template")).alias("best"), F.col("_score").alias("score"), F.col("_next").alias("runner_up"), F.coalesce(F.col("_score") - F.col("_next_score"), F.lit(1.0)).alias("margin"), F.when(F.col("_score") >= floor, F.least(F.lit(0.96), 0.55 + 0.4 * F.col("_score"))).otherwise(0.0).alias("confidence")
    )
