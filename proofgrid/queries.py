"""Queries of the engine's own operators, with their SQL twins.

Noise is derived from keys, so that both engines see the same input. Every query reads
whole tables; text that only one of the engines could format is compared as numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import raster, rules, text, vectors
from .operators import consistency, export, gate, ordering, payload, resolve, review, score, slots
from .streaming import folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

ALIASES = [("click", "click"), ("view", "view"), ("purchase", "purchase|buy"), ("signup", "sign.?up"), ("other", ".")]
LEGAL = {"A": [1.0, 7.0, 13.0, 19.0, 25.0, 31.0, 37.0, 43.0], "N": [2.0, 5.0, 8.0, 11.0, 14.0, 17.0, 20.0], "R": [3.0, 9.0, 15.0, 21.0, 27.0, 33.0, 39.0, 45.0]}
PAIRS = [("1", "7"), ("3", "8"), ("5", "6")]
CENTRES = [50.0, 150.0, 250.0, 350.0, 450.0]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def noisy(c: Column, key: Column) -> Column:
    """One character, chosen by key, replaced by x."""
    at = (key % F.length(c)).cast("int")
    return F.concat(F.substr(c, F.lit(1), at), F.lit("x"), F.substr(c, at + 2, F.lit(1 << 20)))


NORM = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
NOISY = "substr({0}, 1, ({1} % length({0}))::INT) || 'x' || substr({0}, ({1} % length({0}))::INT + 2)"
EDGE = "(starts_with({a}, {b}) OR ends_with({a}, {b}) OR starts_with({b}, {a}) OR ends_with({b}, {a}))"
SIM = (
    "(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0::FLOAT WHEN {a} = {b} THEN 1::FLOAT"
    " WHEN least(length({a}), length({b})) >= 5 AND (contains({a}, {b}) OR contains({b}, {a})) THEN"
    " CASE WHEN " + EDGE + " THEN 0.9::FLOAT ELSE (0.9::FLOAT * (least(length({a}), length({b}))::FLOAT / greatest(length({a}), length({b}))::FLOAT)::FLOAT)::FLOAT END"
    " ELSE (1::FLOAT - (levenshtein({a}, {b})::FLOAT / greatest(length({a}), length({b}))::FLOAT)::FLOAT)::FLOAT END)"
)


def best_sql(queries: str, catalog: str, pool: str = "TRUE") -> str:
    """SQL of resolve.match over queries(k, query, ...) and catalog(name, norm, ...)."""
    return f"""
        WITH q AS ({queries}), c AS ({catalog}),
        s AS (SELECT k, query, name, norm, {SIM.format(a='query', b='norm')} AS score, {EDGE.format(a='query', b='norm')} AS edge FROM q JOIN c ON {pool}),
        r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY (query = norm) DESC, score DESC, edge DESC, length(norm) DESC, name) AS n FROM s),
        b AS (SELECT k, max(query) AS query, max(name) FILTER (n = 1) AS name, max(norm) FILTER (n = 1) AS norm, max(score) FILTER (n = 1) AS score,
                     max(name) FILTER (n = 2) AS name2, max(score) FILTER (n = 2) AS score2 FROM r GROUP BY k)
        SELECT k, CASE WHEN query = norm THEN name WHEN length(query) >= 4 AND score >= 0.68::FLOAT THEN name END AS entry, round(score::DOUBLE, 6) AS score,
               query <> norm AND length(query) >= 4 AND name2 IS NOT NULL AND (score - score2)::FLOAT < 0.05::FLOAT AS ambiguous,
               CASE WHEN query <> norm AND length(query) >= 4 THEN name2 END AS runner_up FROM b
    """


def shown(df: DataFrame, key: str, *more: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), "entry", F.round(F.col("score").cast("double"), 6).alias("score"), "ambiguous", "runner_up", *more)


def part_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()


NAMES = f"SELECT DISTINCT p_name AS name, {NORM.format('p_name')} AS norm FROM part"


# Entity resolution
@query(f"SELECT p_partkey, {NORM.format('p_name')} AS norm FROM part")
def q_normalize_identity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.normalize_identity(F.col("p_name")).alias("norm"))


@query(f"WITH c AS ({NAMES}) SELECT x.name AS a, y.name AS b, round({SIM.format(a='x.norm', b='y.norm')}::DOUBLE, 6) AS score FROM c x, c y")
def q_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = part_names(spark, d).withColumn("norm", text.normalize_identity(F.col("name")))
    b = resolve.small(n.toDF("b", "y"))
    return n.toDF("a", "x").join(b).select("a", "b", F.round(text.similarity(F.col("x"), F.col("y")).cast("double"), 6).alias("score"))


@query(best_sql(f"SELECT p_partkey AS k, {NORM.format(NOISY.format('p_name', 'p_partkey'))} AS query FROM part", NAMES))
def q_fuzzy_best_match(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "part").select("p_partkey", noisy(F.col("p_name"), F.col("p_partkey")).alias("t"))
    return shown(resolve.match(q, part_names(spark, d), "p_partkey", "t", "name"), "p_partkey")


@query(best_sql(f"SELECT p_partkey AS k, {NORM.format('CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE ' + NOISY.format('p_name', 'p_partkey') + ' END')} AS query FROM part", NAMES))
def q_exact_then_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(noisy(F.col("p_name"), F.col("p_partkey")))
    q = table(spark, d, "part").select("p_partkey", t.alias("t"))
    return shown(resolve.match(q, part_names(spark, d), "p_partkey", "t", "name"), "p_partkey")


@query(
    "SELECT *, FALSE AS widened FROM (" + best_sql(f"SELECT p_partkey AS k, p_type, {NORM.format(NOISY.format('p_name', 'p_partkey'))} AS query FROM part WHERE p_partkey % 10 <> 0", f"SELECT p_name AS name, p_type AS t, {NORM.format('p_name')} AS norm FROM part GROUP BY ALL", "p_type = t")
    + ") UNION ALL SELECT *, TRUE FROM (" + best_sql(f"SELECT p_partkey AS k, {NORM.format(NOISY.format('p_name', 'p_partkey'))} AS query FROM part WHERE p_partkey % 10 = 0", NAMES) + ")"
)
def q_fuzzy_constrained_pool(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    q = p.select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, "none").otherwise(F.col("p_type")).alias("kind"), noisy(F.col("p_name"), F.col("p_partkey")).alias("t"))
    c = p.select(F.col("p_name").alias("name"), F.col("p_type").alias("kind")).distinct()
    return shown(resolve.match_constrained(q, c, "p_partkey", "t", "name", F.col("q_kind") == F.col("c_kind")), "p_partkey", "widened")


OPENING = "trim(substr(coalesce(text, ''), 1, 24))"


@query(best_sql(f"SELECT doc_id AS k, {NORM.format(NOISY.format('o', 'doc_id'))} AS query FROM (SELECT doc_id, {OPENING} AS o FROM documents)", f"SELECT DISTINCT o AS name, {NORM.format('o')} AS norm FROM (SELECT {OPENING} AS o FROM documents) WHERE {NORM.format('o')} <> ''"))
def q_fuzzy_by_index(spark: SparkSession, d: str) -> DataFrame:
    """Noisy openings of all documents against all openings, through the segment and 5-gram indexes whatever their number."""
    docs = table(spark, d, "documents").select("doc_id", F.trim(F.substr(F.coalesce("text", F.lit("")), F.lit(1), F.lit(24))).alias("o"))
    q = docs.select("doc_id", noisy(F.col("o"), F.col("doc_id")).alias("t"))
    return shown(resolve.match(q, docs.select(F.col("o").alias("name")), "doc_id", "t", "name", few=0), "doc_id")


@query(f"WITH c AS (SELECT DISTINCT trim(substr(coalesce(text, ''), 1, 24)) AS name, {NORM.format("trim(substr(coalesce(text, ''), 1, 24))")} AS norm FROM documents UNION SELECT DISTINCT trim(substr(coalesce(text, ''), 4, 8)), {NORM.format("trim(substr(coalesce(text, ''), 4, 8))")} FROM documents) SELECT x.name AS \"inner\", y.name AS \"outer\" FROM c x JOIN c y ON x.norm <> y.norm AND length(x.norm) >= 5 AND contains(y.norm, x.norm)")
def q_contained_openings(spark: SparkSession, d: str) -> DataFrame:
    """Openings of documents and parts of them that contain each other, by the rarest 5-gram of the inner one."""
    part = lambda at, n: F.trim(F.substr(F.coalesce("text", F.lit("")), F.lit(at), F.lit(n)))
    docs = table(spark, d, "documents")
    return resolve.collisions(docs.select(part(1, 24).alias("name")).union(docs.select(part(4, 8))), "name")


@query(f'WITH c AS ({NAMES}) SELECT x.name AS "inner", y.name AS "outer" FROM c x JOIN c y ON x.norm <> y.norm AND length(x.norm) >= 5 AND contains(y.norm, x.norm)')
def q_name_collisions(spark: SparkSession, d: str) -> DataFrame:
    return resolve.collisions(table(spark, d, "part"), "p_name")


@query("SELECT DISTINCT p_name || CASE WHEN p_partkey % 9 = 0 THEN ' new' ELSE '' END AS name FROM part WHERE p_partkey % 9 = 0")
def q_missing_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    wanted = p.select(F.concat("p_name", F.when(F.col("p_partkey") % 9 == 0, " new").otherwise("")).alias("name"))
    return review.missing_names(wanted, p.select(F.upper("p_name").alias("name")), "name")


# Text
@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)
    SELECT doc_id, unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS pair FROM l""")
def q_two_line_window(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", text.lines_of(F.col("text")).alias("l"))
    return lines.select("doc_id", F.explode(text.line_windows(F.col("l"))).alias("pair"))


LINE = "event_type || ' ' || floor(value * 10)::BIGINT || CASE WHEN event_id % 2 = 0 THEN '%' ELSE '' END"


@query(f"""WITH l AS (SELECT event_id, event_type, event_id % 2 = 0 AS p, floor(value * 10)::BIGINT::FLOAT AS v FROM events),
    k AS (SELECT *, CASE WHEN event_type ILIKE '%click%' THEN 'click' WHEN event_type ILIKE '%view%' THEN 'view' WHEN regexp_matches(event_type, '(?i)purchase|buy') THEN 'purchase' WHEN regexp_matches(event_type, '(?i)sign.?up') THEN 'signup' ELSE 'other' END AS key FROM l)
    SELECT event_id, CASE WHEN p AND key = 'view' THEN 'viewShare' ELSE key END AS key,
      round((CASE WHEN NOT p OR v <= 50 THEN v WHEN v <= 500 THEN (v / 10)::FLOAT WHEN v <= 5000 THEN ((v / 10)::FLOAT / 10)::FLOAT ELSE (((v / 10)::FLOAT / 10)::FLOAT / 10)::FLOAT END)::DOUBLE, 3) AS value FROM k""")
def q_label_alias_parse(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.col("event_type"), F.lit(" "), F.floor(F.col("value") * 10).cast("string"), F.when(F.col("event_id") % 2 == 0, "%").otherwise(""))
    p = text.parse_line(line, ALIASES, {"view": "viewShare"}, ["viewShare"])
    return table(spark, d, "events").select("event_id", p.alias("p")).select("event_id", "p.key", F.round(F.col("p.value").cast("double"), 3).alias("value"))


@query(r"""SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace('• (' || event_type || ' ' || (event_id % 100) || '0/0 ~', '^[\(\[\{<\|+*~✦\-•\s]+', ''), '[^0-9a-zA-Z%\.\s]+$', ''), '(\d+)\s*(?:0/0|/0|o/o|O/O)', '\1%', 'g')) AS fixed FROM events""")
def q_artifact_repair(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("• ("), F.col("event_type"), F.lit(" "), (F.col("event_id") % 100).cast("string"), F.lit("0/0 ~"))
    return table(spark, d, "events").select("event_id", text.repair_artifacts(raw).alias("fixed"))


@query("SELECT p_partkey, CASE WHEN p_size <= 50 THEN p_size::DOUBLE ELSE p_size / 10.0 END AS a, CASE WHEN p_size * 10 <= 50 THEN p_size * 10.0 WHEN p_size * 10 <= 500 THEN p_size::DOUBLE ELSE p_size / 10.0 END AS b FROM part")
def q_percent_recovery(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(text.recover_percent(c.cast("float")).cast("double"), 3)
    return table(spark, d, "part").select("p_partkey", r(F.col("p_size")).alias("a"), r(F.col("p_size") * 10).alias("b"))


FORMS = ["concat('Lv.', p_size)", "concat(' +', p_size, ' ')", "concat('Level ', p_size)", "concat(p_size, '+1')"]


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 AND p_size <= 25 THEN p_size END AS level, CASE WHEN p_size % 10 IN (1, 3, 4) THEN p_size % 10 END AS cost FROM part")
def q_level_cost_parse(spark: SparkSession, d: str) -> DataFrame:
    form = F.coalesce(*(F.when(F.col("p_partkey") % 4 == i, F.expr(f)) for i, f in enumerate(FORMS)))
    cost = F.concat(F.lit("total COST "), (F.col("p_size") % 10).cast("string"))
    return table(spark, d, "part").select("p_partkey", text.parse_level(form).alias("level"), text.parse_cost(cost).alias("cost"))


@query("""SELECT l_orderkey, l_linenumber, printf('echo_p%02d_r%02d_c%02d_idx%03d.png', (l_partkey % 120 + 1)::INT, (l_linenumber)::INT, (l_suppkey % 5 + 1)::INT, (l_orderkey % 2000)::INT) AS file,
    (l_partkey % 120 + 1)::INT AS page, (l_orderkey % 2000)::INT AS idx FROM lineitem""")
def q_filename_key(spark: SparkSession, d: str) -> DataFrame:
    name = text.capture_name(F.col("l_partkey") % 120, (F.col("l_linenumber") - 1).cast("long"), F.col("l_suppkey") % 5, F.col("l_orderkey") % 2000)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", name.alias("file"))
    return rows.withColumn("n", text.parse_capture_name(F.col("file"))).select("l_orderkey", "l_linenumber", "file", F.col("n.page").alias("page"), F.col("n.index").alias("idx"))


@query("SELECT c_custkey, regexp_replace(c_name, '[^\\p{L}\\p{Nd}]', '', 'g') AS key, lower(substr(c_mktsegment, 1, 1)) || substr(c_mktsegment, 2) AS camel FROM customer")
def q_sanitize_camel(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", text.sanitize_key(F.col("c_name")).alias("key"), text.camel_key(F.col("c_mktsegment")).alias("camel"))


@query("SELECT event_id, coalesce(try_cast(props->>'k' AS INT), -1) AS k, try_cast(event_type AS DOUBLE) IS NULL AS no_number FROM events")
def q_safe_cast(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.to_number(F.get_json_object("props", "$.k"), "int", -1).alias("k"), text.to_number(F.col("event_type"), "double").isNull().alias("no_number"))


@query(r"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 97)::DOUBLE + 0.5 END AS value, event_id % 3 = 1 AS percent FROM events")
def q_value_line(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("+ "), (F.col("event_id") % 97).cast("string"), F.when(F.col("event_id") % 3 == 0, " 5x").when(F.col("event_id") % 3 == 1, ",5 %").otherwise(".5"))
    v = text.value_line(line)
    return table(spark, d, "events").select("event_id", F.round(v["value"].cast("double"), 1).alias("value"), F.coalesce(v["percent"], F.lit(False)).alias("percent"))


@query("SELECT event_id, contains(lower(event_type), 'view') OR contains(lower(event_type), 'click') AS header FROM events")
def q_header_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.is_header(F.upper("event_type"), ["view", "click"]).alias("header"))


# Slots
Y = "(value * 7) % 600"
SLOT = f"list_min([{{'distance': abs(y - 50), 'slot': 0}}, {{'distance': abs(y - 150), 'slot': 1}}, {{'distance': abs(y - 250), 'slot': 2}}, {{'distance': abs(y - 350), 'slot': 3}}, {{'distance': abs(y - 450), 'slot': 4}}])"


@query(f"WITH e AS (SELECT event_id, {Y} AS y FROM events) SELECT event_id, {SLOT}.slot AS slot, round({SLOT}.distance, 6) AS distance FROM e")
def q_slot_nearest(spark: SparkSession, d: str) -> DataFrame:
    near = slots.nearest_slot((F.col("value") * 7) % 600, CENTRES)
    return table(spark, d, "events").select("event_id", near["slot"].alias("slot"), F.round(near["distance"], 6).alias("distance"))


@query(f"""WITH e AS (SELECT event_id, user_id, {Y} AS y FROM events), s AS (SELECT *, CASE WHEN {SLOT}.distance <= 60 THEN {SLOT}.slot END AS slot FROM e)
    SELECT event_id, slot, CASE WHEN slot IS NULL THEN 'orphan' WHEN row_number() OVER (PARTITION BY user_id, slot ORDER BY event_id) = 1 THEN 'first' ELSE 'collision' END AS status FROM s""")
def q_slot_first_wins(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("y", (F.col("value") * 7) % 600)
    return slots.assign(e, "user_id", "event_id", "y", CENTRES).select("event_id", "slot", "status")


@query("""WITH f AS (SELECT *, l_partkey % 7 AS key, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 7 ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem),
    g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM f WHERE a = 1) SELECT l_orderkey, l_linenumber, key FROM g WHERE b <= 3""")
def q_dedup_first_cap(spark: SparkSession, d: str) -> DataFrame:
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 7).alias("key"), place)
    return slots.first_of_key(li, "l_orderkey", "key", "place", cap=3).drop("place")


@query("SELECT l_orderkey, key, count(*) AS n FROM (SELECT l_orderkey, l_partkey % 7 AS key FROM lineitem) GROUP BY ALL HAVING count(*) > 1")
def q_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return review.repeated_keys(table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 7).alias("key")), "l_orderkey", "key")


@query("""WITH a AS (SELECT l_orderkey AS g, l_linenumber AS slot, l_partkey % 50 AS key FROM lineitem WHERE l_linenumber % 2 = 1), b AS (SELECT l_orderkey AS g, l_linenumber AS slot, l_suppkey % 50 AS key FROM lineitem),
    o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.g = b.g AND (a.slot = b.slot OR a.key = b.key))),
    f AS (SELECT *, row_number() OVER (PARTITION BY g, key ORDER BY slot) AS n FROM o) SELECT g, slot, key, 1 AS attempt FROM a UNION ALL SELECT g, slot, key, 2 FROM f WHERE n = 1""")
def q_retry_fill(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("slot"), "l_partkey", "l_suppkey")
    first = li.where("slot % 2 = 1").select("g", "slot", (F.col("l_partkey") % 50).alias("key"))
    return slots.fill_retries(first, li.select("g", "slot", (F.col("l_suppkey") % 50).alias("key")), "g", "slot", "key")


# Rules
@query("SELECT p_partkey, least(p_size // 5, 5)::INT AS n, CASE WHEN p_size % 6 BETWEEN 1 AND 4 THEN (p_size % 6) * 5 ELSE 25 END::INT AS top FROM part")
def q_count_rule(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", rules.expected_count(F.col("p_size")).alias("n"), rules.max_level(F.col("p_size") % 6).alias("top"))


@query(r"""WITH legal(key, v) AS (SELECT 'A', unnest([1, 7, 13, 19, 25, 31, 37, 43]) UNION ALL SELECT 'N', unnest([2, 5, 8, 11, 14, 17, 20]) UNION ALL SELECT 'R', unnest([3, 9, 15, 21, 27, 33, 39, 45])),
    pairs(a, b) AS (VALUES ('1','7'),('7','1'),('3','8'),('8','3'),('5','6'),('6','5')),
    d AS (SELECT DISTINCT l_returnflag AS key, l_quantity::INT AS v FROM lineitem),
    swaps AS (SELECT key, v, (substr(v::VARCHAR, 1, i::INT - 1) || b || substr(v::VARCHAR, i::INT + 1))::INT AS w FROM d, range(1, 3) r(i), pairs WHERE substr(v::VARCHAR, i::INT, 1) = a),
    cand AS (SELECT s.key, s.v, list_sort(list(DISTINCT w)) AS c FROM swaps s JOIN legal l ON l.key = s.key AND l.v = w GROUP BY ALL),
    res AS (SELECT d.key, d.v, l.v AS e, CASE WHEN l.v IS NULL THEN coalesce(c, []) ELSE [] END AS c FROM d LEFT JOIN legal l ON l.key = d.key AND l.v = d.v LEFT JOIN cand ON cand.key = d.key AND cand.v = d.v)
    SELECT l_orderkey, l_linenumber, CASE WHEN e IS NOT NULL THEN 'Exact' WHEN len(c) = 1 THEN 'Corrected' WHEN len(c) > 1 THEN 'Ambiguous' ELSE 'NotARoll' END AS state,
      coalesce(e, CASE WHEN len(c) = 1 THEN c[1] END)::DOUBLE AS value, len(c)::INT AS n FROM lineitem JOIN res ON res.key = l_returnflag AND res.v = l_quantity::INT""")
def q_legal_resolution(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    # resolving is a function of key and value: once for each distinct pair, then joined back
    pairs = li.select("l_returnflag", "l_quantity").distinct()
    res = pairs.withColumn("r", rules.resolve_value(F.col("l_returnflag"), F.col("l_quantity"), LEGAL, PAIRS, F.lit(False)))
    out = li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity").join(res, ["l_returnflag", "l_quantity"])
    return out.select("l_orderkey", "l_linenumber", "r.state", F.col("r.value").cast("double").alias("value"), F.size("r.candidates").alias("n"))


@query("""SELECT p_partkey, floor(((p_size % 7) + ((p_size % 7) * 4 + 0.5) * least(p_size % 26, 25) / 25.0) * 10 + 1e-9) / 10 AS value,
    floor(100 + 2000 * least(p_size % 26, 20) / 20.0 + 1e-9) AS flat FROM part""")
def q_scaled_value(spark: SparkSession, d: str) -> DataFrame:
    s, lv = F.col("p_size") % 7, F.col("p_size") % 26
    return table(spark, d, "part").select("p_partkey", rules.scaled_value(s, s * 5 + 0.5, lv, F.lit(25), F.lit(False)).alias("value"), rules.scaled_value(F.lit(100), F.lit(2100), lv, F.lit(20), F.lit(True)).alias("flat"))


@query("""WITH v AS (SELECT DISTINCT p_size FROM part), e AS (SELECT p_size, lv, floor((4.4 + 17.6 * lv / 25.0) * 10 + 1e-9) / 10 AS x FROM v, range(0, 26) r(lv)),
    f AS (SELECT p_size, CASE WHEN count(*) = 1 THEN max(lv) END AS level FROM e WHERE abs(x - (4 + p_size * 0.4)) <= 0.051 GROUP BY p_size)
    SELECT p_partkey, level::INT AS level FROM part LEFT JOIN f USING (p_size)""")
def q_inverse_level(spark: SparkSession, d: str) -> DataFrame:
    level = rules.consistent_level(4 + F.col("p_size") * 0.4, F.lit(4.4), F.lit(22.0), F.lit(25), F.lit(False))
    return table(spark, d, "part").select("p_partkey", level.alias("level"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS cost, o_custkey % 30 AS level, o_orderkey % 7 AS n FROM orders)
    SELECT o_orderkey, list_filter([CASE WHEN cost NOT IN (1, 3, 4) THEN 'CostInvalid' END, CASE WHEN level > 25 THEN 'LevelInvalid' END, CASE WHEN n < least(level // 5, 5) THEN 'Short' END, CASE WHEN n > least(level // 5, 5) THEN 'Excess' END], lambda x: x IS NOT NULL)::VARCHAR AS flags FROM o""")
def q_consistency_flags(spark: SparkSession, d: str) -> DataFrame:
    cost, level, n = F.col("o_orderkey") % 5, F.col("o_custkey") % 30, F.col("o_orderkey") % 7
    flags = rules.all_flags(CostInvalid=~cost.isin(1, 3, 4), LevelInvalid=level > 25, Short=n < rules.expected_count(level), Excess=n > rules.expected_count(level))
    return table(spark, d, "orders").select("o_orderkey", flags.cast("string").alias("flags"))


# Vectors and rasters
CENTROID = "WITH c AS (SELECT label, pos, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY ALL HAVING count(*) >= 3)"


@query(CENTROID + " SELECT label, pos::INT AS pos, n, round(m, 6) AS m FROM c")
def q_centroid_templates(spark: SparkSession, d: str) -> DataFrame:
    t = vectors.mean_vectors(table(spark, d, "embeddings"), "label", "embedding", 3)
    return t.select("label", "n", F.posexplode("vector").alias("pos", "m")).withColumn("m", F.round("m", 6))


@query(CENTROID + """, s AS (SELECT vec_id, label, 1 - sum(abs(x - m)) / (4 * count(*)) AS s FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) e JOIN c USING (pos) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM s)
    SELECT vec_id, max(label) FILTER (k = 1) AS best, round(max(s) FILTER (k = 1), 6) AS score, max(label) FILTER (k = 2) AS runner_up, round(coalesce(max(s) FILTER (k = 1) - max(s) FILTER (k = 2), 1), 6) AS margin FROM r GROUP BY vec_id""")
def q_vector_margin(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    r = resolve.rank_templates(e.withColumn("v", F.col("embedding").cast("array<double>")), vectors.mean_vectors(e, "label", "embedding", 3), "vec_id", "v", "label", "vector")
    return r.select("vec_id", "best", F.round("score", 6).alias("score"), "runner_up", F.round("margin", 6).alias("margin"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding)))::INT AS pos FROM embeddings), s AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY vec_id)
    SELECT vec_id, pos, round(greatest(-2, least(2, (x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END)), 6) AS z FROM e JOIN s USING (vec_id)""")
def q_zscore_signature(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.standardize(F.col("embedding"))).alias("pos", "z")).withColumn("z", F.round("z", 6))


@query("""WITH a AS (SELECT label, count(*) AS n FROM embeddings WHERE label % 3 <> 0 GROUP BY 1), b AS (SELECT label, count(*) * 10 AS n FROM embeddings WHERE label % 2 = 0 GROUP BY 1)
    SELECT coalesce(b.label, a.label)::VARCHAR AS name, coalesce(b.n, a.n) AS n, b.label IS NOT NULL AS overridden FROM a FULL JOIN b ON a.label = b.label""")
def q_template_overlay(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("name", F.col("label").cast("string"))
    a, b = e.where("label % 3 <> 0").groupBy("name").agg(F.count("*").alias("n")), e.where("label % 2 = 0").groupBy("name").agg((F.count("*") * 10).alias("n"))
    return review.override_merge(a, b, "name", ["n"])


PIXELS = "list_transform(embedding, lambda x: least(255, greatest(0, floor((x::DOUBLE + 0.5) * 255)))::INT)"
PX = "WITH p AS (SELECT vec_id, unnest(" + PIXELS + ") AS v, unnest(range(0, 64))::INT AS i FROM embeddings)"


def pixels(spark: SparkSession, d: str) -> DataFrame:
    px = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 0.5) * 255))).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", px.alias("px"), F.lit(8).alias("w"), F.lit(8).alias("h"))


@query(PX + """, o AS (SELECT vec_id, list_sort(list(v)) AS s FROM p GROUP BY 1), b AS (SELECT vec_id, avg(v) AS m FROM p WHERE i % 8 IN (0, 7) OR i // 8 IN (0, 7) GROUP BY 1)
    SELECT vec_id, s[3] AS low, s[61] AS high, round(m, 6) AS border, m < 128 AS dark FROM o JOIN b USING (vec_id)""")
def q_gray_statistics(spark: SparkSession, d: str) -> DataFrame:
    p, px, w = pixels(spark, d), F.col("px"), F.lit(8)
    b = raster.border_mean(px, w, w)
    return p.select("vec_id", raster.percentile(px, 0.05).alias("low"), raster.percentile(px, 0.95).alias("high"), F.round(b, 6).alias("border"), (b < 128).alias("dark"))


@query(PX + """, t AS (SELECT DISTINCT vec_id, v AS t FROM p), q AS (SELECT t.vec_id, t, count(*) FILTER (v <= t) AS k, sum(v) FILTER (v <= t) AS s, count(*) AS n, sum(v) AS total FROM t JOIN p USING (vec_id) GROUP BY ALL),
    r AS (SELECT *, CASE WHEN k < n THEN k::DOUBLE * (n - k) * pow(s::DOUBLE / k - (total - s)::DOUBLE / (n - k), 2) ELSE -1 END AS b FROM q)
    SELECT vec_id, arg_max(t, {'b': round(b, 3), 't': -t})::INT AS t FROM r GROUP BY 1""")
def q_otsu(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("vec_id", raster.otsu(F.col("px"), places=3).cast("int").alias("t"))


@query(PX + """, f AS (SELECT vec_id, avg(v) AS m FROM p WHERE i % 8 IN (0, 7) OR i // 8 IN (0, 7) GROUP BY 1) SELECT vec_id, sum(CASE WHEN m < 128 THEN 255 - v ELSE v END)::BIGINT AS total FROM p JOIN f USING (vec_id) GROUP BY 1""")
def q_polarity(spark: SparkSession, d: str) -> DataFrame:
    px = raster.dark_on_light(F.col("px"), F.lit(8), F.lit(8))
    return pixels(spark, d).select("vec_id", F.aggregate(px, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query(PX + """, a AS (SELECT x.vec_id, x.i, any_value(x.v) AS v, sum(y.v) // count(*) AS m FROM p x JOIN p y ON x.vec_id = y.vec_id AND abs(x.i % 8 - y.i % 8) <= 6 AND abs(x.i // 8 - y.i // 8) <= 6 GROUP BY 1, 2)
    SELECT vec_id, count(*) FILTER (v > m - 16) AS white FROM a GROUP BY 1""")
def q_adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    out = raster.apply_raster(pixels(spark, d), ("adaptive",))
    return out.select("vec_id", F.size(F.filter("px", lambda v: v > 0)).cast("long").alias("white"))


@query("WITH RECURSIVE " + PX[5:] + """, cum AS (SELECT vec_id, v AS t, count(*) AS n, sum(v) AS s FROM p GROUP BY ALL),
    k AS (SELECT vec_id, t, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(n) OVER (PARTITION BY vec_id) AS nn, sum(s) OVER (PARTITION BY vec_id) AS ss FROM cum WINDOW w AS (PARTITION BY vec_id ORDER BY t)),
    b AS (SELECT vec_id, arg_max(t, {'b': CASE WHEN n > 0 AND n < nn THEN n::DOUBLE * (nn - n) * pow(s::DOUBLE / n - (ss - s)::DOUBLE / (nn - n), 2) ELSE -1.0 END, 't': -t}) AS t FROM k GROUP BY 1),
    ink AS (SELECT vec_id, i FROM p JOIN b USING (vec_id) WHERE v <= t),
    g AS MATERIALIZED (SELECT x.vec_id, x.i AS a, y.i AS b FROM ink x JOIN ink y ON x.vec_id = y.vec_id AND (abs(x.i - y.i) = 8 OR (abs(x.i - y.i) = 1 AND x.i // 8 = y.i // 8))),
    r(vec_id, i, c) AS (SELECT vec_id, i, i FROM ink UNION SELECT g.vec_id, g.b, r.c FROM r JOIN g ON g.vec_id = r.vec_id AND g.a = r.i),
    m AS (SELECT vec_id, i, min(c) AS c FROM r GROUP BY ALL), z AS (SELECT vec_id, c, count(*) AS pixels, min(i % 8) AS min_x, max(i % 8) AS max_x, min(i // 8) AS min_y, max(i // 8) AS max_y FROM m GROUP BY ALL)
    SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY c))::INT AS id, pixels::INT AS pixels, min_x::INT AS min_x, max_x::INT AS max_x, min_y::INT AS min_y, max_y::INT AS max_y FROM z""")
def q_components(spark: SparkSession, d: str) -> DataFrame:
    p = pixels(spark, d).withColumn("px", raster.threshold(F.col("px"), raster.otsu(F.col("px"))))
    return raster.component_table(p, "vec_id")


@query(PX + """, c AS (SELECT vec_id, i // 3 AS k, max(v) FILTER (i % 3 = 0) AS r, max(v) FILTER (i % 3 = 1) AS g, max(v) FILTER (i % 3 = 2) AS b FROM p WHERE i < 63 GROUP BY ALL), h AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM c),
    u AS (SELECT vec_id, CASE WHEN hi = r THEN (g - b)::DOUBLE / (hi - lo) WHEN hi = g THEN (b - r)::DOUBLE / (hi - lo) + 2 ELSE (r - g)::DOUBLE / (hi - lo) + 4 END * 60 AS hue FROM h WHERE hi > lo),
    v AS (SELECT vec_id, floor(((hue % 360 + 360) % 360) / 60)::INT AS sector, count(*) AS n FROM u GROUP BY ALL) SELECT vec_id, arg_max(sector, {'n': n, 's': -sector}) AS sector FROM v GROUP BY 1""")
def q_hue_vote(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k: F.get("px", F.col("i") * 3 + k)
    p = pixels(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20)))).select("vec_id", F.floor(raster.hue(at(0), at(1), at(2)) / 60).cast("int").alias("sector")).where("sector is not null")
    votes = p.groupBy("vec_id", "sector").agg(F.count("*").alias("n"))
    return votes.groupBy("vec_id").agg(F.max_by("sector", F.struct("n", -F.col("sector"))).alias("sector"))


# Gates
@query("""SELECT o_orderkey, (o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_custkey % 3 <> o_orderkey % 3 OR (o_orderkey % 100 / 100.0)::FLOAT < 0.8::FLOAT) AS review,
    CASE WHEN o_orderkey % 11 = 0 THEN 'FAIL' WHEN o_orderkey % 13 = 0 OR o_custkey % 3 <> o_orderkey % 3 OR (o_orderkey % 100 / 100.0)::FLOAT < 0.8::FLOAT THEN 'REVIEW' ELSE 'OK' END AS status FROM orders""")
def q_needs_review(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    empty = F.array().cast("array<string>")
    errors = F.when(k % 11 == 0, F.array(F.lit("failed"))).otherwise(empty)
    r = gate.needs_review(errors, [F.when(k % 13 != 0, F.lit("name"))], empty, F.col("o_custkey") % 3, k % 3, [(k % 100 / 100).cast("float")], F.array().cast("array<float>"))
    return table(spark, d, "orders").select("o_orderkey", r.alias("review"), gate.run_status(errors, r).alias("status"))


@query("""SELECT conv_id, turn, CASE WHEN role IS NULL AND turn % 3 = 0 THEN 'not-recorded' ELSE coalesce(role, '?') || '/?/' || CASE WHEN turn % 3 = 0 THEN '?' ELSE 'raw' END || '/attempt' || CASE WHEN turn % 3 = 0 THEN '?' ELSE (turn % 3)::VARCHAR END END AS origin FROM conversations""")
def q_provenance(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    later = F.col("turn") % 3
    origin = gate.provenance(F.col("role"), none, F.when(later != 0, "raw"), F.when(later != 0, later))
    return table(spark, d, "conversations").select("conv_id", "turn", origin.alias("origin"))


@query("""WITH r AS (SELECT conv_id, max(CASE WHEN turn % 2 = 0 THEN text END) FILTER (turn < 2) AS a, max(CASE WHEN turn % 2 = 1 THEN text END) FILTER (turn < 2) AS b FROM conversations GROUP BY 1)
    SELECT conv_id, CASE WHEN length(a) >= 2 AND contains(a, 'e') THEN a WHEN length(b) >= 2 AND contains(b, 'e') THEN b WHEN length(b) >= 2 THEN b ELSE a END AS text FROM r""")
def q_engine_fallback(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("turn < 2")
    r = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") % 2 == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") % 2 == 1, F.col("text"))).alias("b"))
    return r.select("conv_id", gate.choose_read(F.col("a"), F.col("b"), F.col("a").contains("e"), F.col("b").contains("e")).alias("text"))


@query("SELECT conv_id, coalesce(bool_or(trim(text, ' ') <> '') AND bool_or(regexp_matches(text, '[0-9]')), FALSE) AS usable FROM conversations GROUP BY 1")
def q_line_source_gate(spark: SparkSession, d: str) -> DataFrame:
    return gate.usable_lines(table(spark, d, "conversations"), ["conv_id"], "text")


@query("""SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 'verified' WHEN quality = 0 THEN 'edited' WHEN n_chars < 100 THEN 'error' WHEN quality = 1 THEN 'complete' ELSE 'partial' END AS status FROM documents LEFT JOIN labels USING (doc_id)
    WHERE (contains(lower(text), 'the') OR contains(lower(lang), 'the')) AND coalesce(quality = 1, FALSE)""")
def q_review_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    status = gate.display_status(F.col("toxic") == 1, F.col("quality") == 0, F.col("n_chars") < 100, F.col("quality") == 1)
    return gate.review_filter(rows, "The", ["text", "lang"], "good", {"good": F.coalesce(F.col("quality") == 1, F.lit(False))}).select("doc_id", "lang", status.alias("status"))


@query("""SELECT count(*) AS total, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good, round(count(*) FILTER (quality = 1) / count(quality), 6) AS rate, round(avg(n_chars), 6) AS mean_chars FROM documents LEFT JOIN labels USING (doc_id)""")
def q_session_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    good = F.count_if(F.col("quality") == 1)
    return gate.session_summary(rows, total=F.count("*"), labelled=F.count("quality"), good=good, rate=F.round(F.coalesce(F.try_divide(good, F.count("quality")), F.lit(0.0)), 6), mean_chars=F.round(F.avg("n_chars"), 6))


# Export
ORDER_RULES = """WITH o AS (SELECT *, o_orderkey % 5 AS cost, o_custkey % 27 AS level, CASE WHEN o_orderkey % 17 = 0 THEN 'UNKNOWN' WHEN o_orderkey % 19 = 0 THEN ' ' ELSE 'n' || o_custkey END AS name FROM orders),
    f AS (SELECT *, list_filter([CASE WHEN trim(name, ' ') = '' OR name = 'UNKNOWN' THEN 'name missing' END, CASE WHEN cost NOT IN (1, 3, 4) THEN 'cost invalid' END, CASE WHEN level > 25 THEN 'level invalid' END, CASE WHEN o_orderkey % 23 = 0 THEN 'main value invalid' END], lambda x: x IS NOT NULL) AS fatal,
      CASE WHEN o_orderkey % 4 < least(level // 5, 5) THEN ['count below the level rule'] ELSE [] END AS soft FROM o)"""


def order_rules(spark: SparkSession, d: str) -> tuple[DataFrame, Column, Column]:
    k = F.col("o_orderkey")
    name = F.when(k % 17 == 0, "UNKNOWN").when(k % 19 == 0, " ").otherwise(F.concat(F.lit("n"), F.col("o_custkey").cast("string")))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", name.alias("name"), (k % 5).alias("cost"), (F.col("o_custkey") % 27).alias("level"))
    entry = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.concat(F.lit("k"), i.cast("string")).alias("key"), i.cast("float").alias("value"), i.cast("float").alias("snapped")))
    o = o.withColumn("substats", F.slice(entry, F.lit(1), (k % 4).cast("int")))
    fatal = export.fatal_reasons(F.col("name"), F.col("cost"), F.col("level"), F.lit("set"), F.lit("main"), F.when(k % 23 == 0, 0).otherwise(1))
    return o, fatal, export.degradations(F.col("substats"), F.col("level"))


@query(ORDER_RULES + " SELECT o_orderkey, len(fatal) + len(soft) = 0 AS strict, len(fatal) = 0 AS partial, array_to_string(list_concat(fatal, soft), '; ') AS reasons FROM f")
def q_export_policy(spark: SparkSession, d: str) -> DataFrame:
    o, fatal, soft = order_rules(spark, d)
    s = export.decide(o, fatal, soft).select("*", F.col("exported").alias("strict"), F.array_join("reasons", "; ").alias("why")).drop("reasons", "exported")
    return export.decide(s, fatal, soft, export.PARTIAL).select("o_orderkey", "strict", F.col("exported").alias("partial"), F.col("why").alias("reasons"))


@query(ORDER_RULES + " SELECT o_orderkey, array_to_string(list_concat(fatal, soft), '; ') AS reasons FROM f WHERE len(fatal) + len(soft) > 0")
def q_quarantine(spark: SparkSession, d: str) -> DataFrame:
    o, fatal, soft = order_rules(spark, d)
    bad = export.decide(o, fatal, soft).where("not exported")
    return export.quarantine(bad.unionByName(bad), "o_orderkey").withColumn("reasons", F.array_join("reasons", "; "))


@query(ORDER_RULES + " SELECT count(*) AS total, count(*) FILTER (len(fatal) + len(soft) = 0) AS exported, count(*) FILTER (len(fatal) > 0) AS quarantined, count(*) FILTER (len(fatal) = 0 AND len(soft) > 0) AS skipped, TRUE AS balanced FROM f")
def q_export_accounting(spark: SparkSession, d: str) -> DataFrame:
    o, fatal, soft = order_rules(spark, d)
    return export.accounting(export.decide(o, fatal, soft).withColumn("hard", F.size(fatal) > 0), F.col("exported"), F.col("hard"))


@query(ORDER_RULES + """, r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM f WHERE len(fatal) + len(soft) = 0)
    SELECT o_orderkey, 'item_1700000000000_' || CASE WHEN i < 1000 THEN lpad(i::VARCHAR, 3, '0') ELSE i::VARCHAR END || '_' || name AS export_id, 1700000000000 + i AS created_at FROM r""")
def q_export_ids(spark: SparkSession, d: str) -> DataFrame:
    o, fatal, soft = order_rules(spark, d)
    kept = export.decide(o, fatal, soft).where("exported")
    return export.with_export_ids(kept, None, ["o_orderkey"], F.col("name"), 1_700_000_000_000).select("o_orderkey", "export_id", "created_at")


@query("""SELECT event_id, unnest(list_filter([CASE WHEN event_id % 5 = 0 THEN 'document: not JSON' END, CASE WHEN event_id % 5 <> 0 AND coalesce((props->>'k')::INT > 50, FALSE) THEN 'k: over 50' END, CASE WHEN event_id % 5 <> 0 AND (props->>'k')::INT % 2 = 1 THEN 'k: odd' END], lambda x: x IS NOT NULL)) AS problem FROM events""")
def q_payload_validate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), F.substring("props", 3, 1 << 20))).otherwise(F.col("props")).alias("json"))
    return export.validate(e, "event_id", "json", "k int", {"k: over 50": F.col("doc.k") > 50, "k: odd": F.col("doc.k") % 2 == 1})


@query("""SELECT l_orderkey, '{"schemaVersion":7,"order":' || l_orderkey || ',"count":' || count(*) || ',"rows":[' ||
    string_agg('{"l_partkey":' || l_partkey || ',"l_quantity":' || l_quantity || '}', ',' ORDER BY l_linenumber, l_partkey, l_quantity) || ']}' AS json FROM lineitem GROUP BY l_orderkey""")
def q_envelope_json(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return export.documents(li, "l_orderkey", "l_linenumber", ["l_partkey", "l_quantity"], {"schemaVersion": F.lit(7), "order": F.col("l_orderkey")})


@query("SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS number FROM lineitem")
def q_running_index(spark: SparkSession, d: str) -> DataFrame:
    """WIN2: numbers within three groups that hold all rows."""
    li = table(spark, d, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return ordering.running_index(li, ["l_returnflag"], order, "number").select("l_orderkey", "l_linenumber", "l_returnflag", "number")


LINES = """WITH rows AS (SELECT {g} AS grp, row_number() OVER (PARTITION BY {g} ORDER BY {o}) - 1 AS line, {item} AS item FROM {t})
    SELECT grp, line, CASE WHEN line > 0 THEN ',' ELSE '' END || item AS text FROM rows
    UNION ALL SELECT {g}, -1, {head} FROM {t} GROUP BY {g} UNION ALL SELECT DISTINCT {g}, 9223372036854775807, {tail} FROM {t}"""


@query(LINES.format(t="(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY l_linenumber) AS first FROM lineitem WHERE l_partkey % 3 <> 1) WHERE first = 1)", g="l_returnflag", o="l_orderkey", item="""'{"image":' || l_orderkey || ',"reasons":["line ' || l_linenumber || '"]}'""", head="""'{"count":' || count(*) || ',"entries":['""", tail="']}'"))
def q_quarantine_lines(spark: SparkSession, d: str) -> DataFrame:
    """SNK4: quarantine documents of three groups that hold all rows, an entry for each key."""
    li = table(spark, d, "lineitem").where(F.col("l_partkey") % 3 != 1)
    held = li.select("l_returnflag", "l_orderkey", F.array(F.concat(F.lit("line "), F.col("l_linenumber"))).alias("reasons"))
    return export.quarantine_lines(held, "l_returnflag", "l_orderkey").withColumnRenamed("l_returnflag", "grp")


@query(LINES.format(t="orders", g="o_orderpriority", o="o_orderkey", item="""'{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"verified":' || (o_custkey % 3 = 0) || ',"edited":' || (o_orderstatus = 'F') || '}'""", head="""'{"ExportedAt":"2020","TotalEchoes":' || count(*) || ',"VerifiedCount":' || count(*) FILTER (o_custkey % 3 = 0) || ',"EditedCount":' || count(*) FILTER (o_orderstatus = 'F') || ',"Echoes":['""", tail="']}'"))
def q_edit_lines(spark: SparkSession, d: str) -> DataFrame:
    """SNK6: reviewed rows of five groups with their totals."""
    o = table(spark, d, "orders").withColumns({"verified": F.col("o_custkey") % 3 == 0, "edited": F.col("o_orderstatus") == "F"})
    return export.edit_lines(o, "o_orderpriority", "o_orderkey", ["o_orderkey", "o_custkey"], "2020").withColumnRenamed("o_orderpriority", "grp")


# Scoring
@query("""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_returnflag AS e1, CASE WHEN l_partkey % 6 = 0 THEN lower(l_returnflag) WHEN l_partkey % 6 = 1 THEN NULL ELSE l_returnflag END AS a1, l_linestatus AS e2, CASE WHEN l_suppkey % 5 = 0 THEN lower(l_linestatus) ELSE l_linestatus END AS a2 FROM lineitem)
    SELECT k, 'identity' AS field, e1 AS expected, a1 AS actual, lower(e1) IS NOT DISTINCT FROM lower(a1) AS match FROM x UNION ALL SELECT k, 'status', e2, a2, e2 IS NOT DISTINCT FROM a2 FROM x""")
def q_field_scores(spark: SparkSession, d: str) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    x = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), flag.alias("e1"), F.when(F.col("l_partkey") % 6 == 0, F.lower(flag)).when(F.col("l_partkey") % 6 != 1, flag).alias("a1"), status.alias("e2"), F.when(F.col("l_suppkey") % 5 == 0, F.lower(status)).otherwise(status).alias("a2"))
    return score.field_scores(x, "k", {"identity": ("e1", "a1", True), "status": ("e2", "a2", False)})


@query("""WITH e AS (SELECT l_orderkey, l_partkey % 1000 AS k, l_quantity AS v, l_linenumber FROM lineitem), a AS (SELECT l_orderkey, l_partkey % 1000 AS k, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity + 1 ELSE l_quantity END AS v, l_linenumber FROM lineitem WHERE l_linenumber % 5 <> 4),
    er AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, k, v ORDER BY l_linenumber) AS n FROM e), ar AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, k, v ORDER BY l_linenumber) AS n FROM a),
    j AS (SELECT coalesce(er.l_orderkey, ar.l_orderkey) AS l_orderkey, er.k IS NOT NULL AND ar.k IS NOT NULL AS m, ar.k IS NULL AS miss, er.k IS NULL AS extra FROM er FULL JOIN ar ON er.l_orderkey = ar.l_orderkey AND er.k = ar.k AND er.v = ar.v AND er.n = ar.n)
    SELECT l_orderkey, count(*) FILTER (m)::INT AS matched, count(*) FILTER (miss)::INT AS missed, count(*) FILTER (extra)::INT AS extra FROM j GROUP BY 1""")
def q_multiset_score(spark: SparkSession, d: str) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("float")
    row = lambda v: F.struct(n.alias("n"), (F.col("l_partkey") % 1000).cast("string").alias("key"), v.alias("value"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row(q))).alias("e"), F.array_sort(F.collect_list(F.when(n % 5 != 4, row(F.when(n % 3 == 0, q + 1).otherwise(q).cast("float"))))).alias("a"))
    return g.select("l_orderkey", score.multiset_match(F.col("e"), F.col("a")).alias("s")).select("l_orderkey", "s.*")


@query("""WITH c AS (SELECT (l_discount * 10)::FLOAT::DOUBLE AS c, l_partkey % 3 = 0 AS hit FROM lineitem), r AS (SELECT b::INT AS bucket, b / 10.0::DOUBLE AS lower, (b + 1) / 10.0::DOUBLE AS upper FROM range(0, 10) t(b))
    SELECT bucket, lower, upper, count(c.c) AS count, count(*) FILTER (hit) AS matched, coalesce(round(count(*) FILTER (hit) / nullif(count(c.c), 0), 6), 0) AS rate FROM r LEFT JOIN c ON c.c >= lower AND (c.c < upper OR (bucket = 9 AND c.c <= 1)) GROUP BY ALL""")
def q_calibration(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select((F.col("l_discount") * 10).cast("float").alias("c"), (F.col("l_partkey") % 3 == 0).alias("hit"))
    return score.calibration(c, "c", "hit").withColumn("rate", F.round("rate", 6))


FLAGS = "(SELECT l_returnflag AS e, CASE l_partkey % 8 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' WHEN 3 THEN NULL ELSE l_returnflag END AS a FROM lineitem)"


def flags(spark: SparkSession, d: str) -> DataFrame:
    e, k = F.col("l_returnflag"), F.col("l_partkey") % 8
    return table(spark, d, "lineitem").select(e.alias("e"), F.when(k == 0, "A").when(k == 1, "N").when(k == 2, "R").when(k != 3, e).alias("a"))


@query(f"SELECT e AS expected, a AS actual, count(*) AS n FROM {FLAGS} WHERE a IS NOT NULL AND e <> a GROUP BY ALL ORDER BY n DESC, expected, actual LIMIT 5")
def q_top_confusions(spark: SparkSession, d: str) -> DataFrame:
    return score.top_confusions(flags(spark, d), "e", "a", 5)


@query(f"SELECT count(*) FILTER (e = a) AS matched, count(*) AS expected, count(a) AS actual, round(count(*) FILTER (e = a) / count(*), 6) AS recall, round(count(*) FILTER (e = a) / count(a), 6) AS precision FROM {FLAGS}")
def q_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c: F.when(c, 1).otherwise(0)
    r = score.rates(flags(spark, d), one(F.coalesce(F.col("e") == F.col("a"), F.lit(False))), F.lit(1), one(F.col("a").isNotNull()))
    return r.withColumn("recall", F.round("recall", 6)).withColumn("precision", F.round("precision", 6))


@query(f"SELECT CASE WHEN e = 'A' THEN 'failure' ELSE 'report' END AS kind, count(*) FILTER (e IS DISTINCT FROM a) AS mismatches, count(*) AS fields FROM {FLAGS} GROUP BY 1")
def q_drift_split(spark: SparkSession, d: str) -> DataFrame:
    f = flags(spark, d).select((F.col("e") == "A").alias("verified"), F.col("e").eqNullSafe(F.col("a")).alias("hit"))
    return score.drift(f, "verified", "hit")


# Review
@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
    SELECT c_custkey, coalesce(event_type, c_mktsegment) AS segment, event_id IS NOT NULL AS edited FROM customer LEFT JOIN l ON user_id = c_custkey AND n = 1""")
def q_overlay_edits(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    e = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("segment"), "ts", "event_id")
    return review.overlay(base, e, "c_custkey", ["segment"], ["ts", "event_id"])


@query("""WITH f AS (SELECT DISTINCT url AS p FROM pages WHERE page_id % 3 <> 0), b AS (SELECT string_split(p, '/')[-1] AS n, min(p) AS o FROM f GROUP BY 1)
    SELECT page_id, coalesce(f.p, b.o) AS linked, CASE WHEN f.p IS NOT NULL THEN 'kept' WHEN b.o IS NOT NULL THEN 'relinked' ELSE 'missing' END AS status FROM pages LEFT JOIN f ON f.p = url LEFT JOIN b ON b.n = string_split(url, '/')[-1]""")
def q_relink(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url")
    return review.relink(p, p.where("page_id % 3 <> 0").select(F.col("url").alias("f")), "url", "f").select("page_id", "linked", "status")


@query("SELECT max(url) AS url FROM pages WHERE url LIKE '%.html'")
def q_latest_file(spark: SparkSession, d: str) -> DataFrame:
    from .sources.readers import newest

    return newest(table(spark, d, "pages"), "url", "%.html")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_windowed_events(spark: SparkSession, d: str) -> DataFrame:
    w = folder.windowed(table(spark, d, "events"), "ts", "10 minutes", "1 hour", None, "event_type")
    return w.withColumn("total", F.round("total", 4))


# Consistency of cost, level, main and second value
RANGES = [(1, "A", 5, 3.6, 18.0), (1, "N", 5, 4.5, 22.8), (3, "A", 5, 6.0, 30.0), (3, "R", 5, 6.4, 32.0), (4, "A", 5, 6.6, 33.0), (4, "R", 5, 4.4, 22.0), (4, "R", 2, 2.7, 7.1), (3, "A", 2, 3.7, 9.6)]
SECONDS = [(1, "hp", 5, 456.0, 2280.0), (3, "atk", 5, 20.0, 100.0), (4, "atk", 5, 30.0, 150.0), (3, "atk", 2, 12.0, 31.0), (4, "atk", 2, 18.0, 46.0), (1, "hp", 2, 114.0, 296.0)]
TENTH = "(CASE WHEN {l} IS NOT NULL THEN floor(({s} + ({e} - {s}) * least(greatest({l}, 0), {m}) / {m}::DOUBLE) * 10 + 1e-9) / 10 END)::FLOAT"
WHOLE = "(CASE WHEN {l} IS NOT NULL THEN floor({s} + ({e} - {s}) * least(greatest({l}, 0), {m}) / {m}::DOUBLE + 1e-9) END)::FLOAT"
AT = lambda form, level: form.format(s="start_", e="end_", l=level, m="most")
VALUES = lambda rows: ", ".join(str(tuple(r)) for r in rows)


@query(f"""
    WITH m(rc, rk, rr, start_, end_) AS (VALUES {VALUES(RANGES)}), s(sc, wanted, sr, s_start, s_end) AS (VALUES {VALUES(SECONDS)}),
    i AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE [1, 3, 4][(l_suppkey % 3 + 1)::INT] END AS cost, CASE WHEN l_partkey % 9 = 0 THEN 2 ELSE 5 END AS rarity,
        CASE WHEN l_partkey % 9 = 0 THEN 10 ELSE 25 END AS most, CASE WHEN l_partkey % 61 = 0 THEN NULL ELSE (l_orderkey % 26)::INT END AS level, l_returnflag AS main_key,
        round(l_extendedprice)::BIGINT % 400 / 10.0 AS odd, (l_orderkey + l_partkey % 2 * 3) % 26 AS true_level, CASE WHEN l_suppkey % 5 = 0 THEN 'hp' ELSE 'atk' END AS second_key, l_quantity AS second_value FROM lineitem),
    j AS (SELECT *, CASE WHEN l_partkey % 7 = 0 OR start_ IS NULL THEN odd::FLOAT ELSE {AT(TENTH, 'true_level')} END AS main_value, cost IS NOT NULL AND level IS NOT NULL AS known,
        EXISTS (SELECT 1 FROM m b WHERE b.rc = cost AND b.rk = main_key) AS allowed FROM i LEFT JOIN m ON rc = cost AND rk = main_key AND rr = rarity),
    k AS (SELECT *, coalesce(known AND allowed AND abs(main_value - {AT(TENTH, 'level')})::FLOAT > 0.051::FLOAT, FALSE) AS wrong,
        list_filter(range(0, 26), lambda x: abs({AT(TENTH, 'x')} - main_value)::FLOAT <= 0.051::FLOAT) AS fits FROM j),
    f AS (SELECT *, CASE WHEN wrong AND len(fits) = 1 THEN fits[1] ELSE level END AS new_level, wrong AND len(fits) = 1 AND fits[1] <> level AS fixed FROM k)
    SELECT l_orderkey, l_linenumber, new_level::INT AS level, round({AT(TENTH, 'new_level')}::DOUBLE, 4) AS "primary",
        round(({WHOLE.format(s='s_start', e='s_end', l='new_level', m='most')})::DOUBLE, 4) AS secondary,
        array_to_string(list_filter([CASE WHEN known AND NOT allowed THEN 'MainStatInvalidForCost' END, CASE WHEN fixed THEN 'LevelCorrectedByStats' END, CASE WHEN wrong AND len(fits) <> 1 THEN 'MainValueImpossible' END,
            CASE WHEN known AND second_key IS DISTINCT FROM wanted THEN 'SecondMainStatInvalid' END], lambda x: x IS NOT NULL), ',') AS flags,
        coalesce(known AND second_key = wanted AND abs(second_value - {WHOLE.format(s='s_start', e='s_end', l='new_level', m='most')}) > 0.51, FALSE) AS second_off
    FROM f LEFT JOIN s ON sc = cost AND sr = rarity""")
def q_consistency_solver(spark: SparkSession, d: str) -> DataFrame:
    """CS1, CS4, CS5, CS6, CS7 over lines whose level, value or keys are wrong by key."""
    shape = "cost int, key string, rarity int, start double, end double"
    mains, seconds = spark.createDataFrame(RANGES, shape), spark.createDataFrame(SECONDS, shape)
    li = table(spark, d, "lineitem")
    cost = F.when(F.col("l_partkey") % 50 != 0, F.get(F.array(F.lit(1), F.lit(3), F.lit(4)), (F.col("l_suppkey") % 3).cast("int")))
    li = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", cost.alias("cost"), F.when(F.col("l_partkey") % 9 == 0, 2).otherwise(5).alias("rarity"), F.when(F.col("l_partkey") % 61 != 0, (F.col("l_orderkey") % 26).cast("int")).alias("level"),
        F.col("l_returnflag").alias("main_key"), (F.round("l_extendedprice").cast("long") % 400 / 10.0).alias("odd"), ((F.col("l_orderkey") + F.col("l_partkey") % 2 * 3) % 26).cast("int").alias("true_level"),
        F.when(F.col("l_suppkey") % 5 == 0, "hp").otherwise("atk").alias("second_key"), F.col("l_quantity").cast("double").alias("second_value"),
    )
    true = consistency.primary_value(li, mains, level="true_level")
    value = F.when((F.col("l_partkey") % 7 == 0) | F.col("primary").isNull(), F.col("odd").cast("float")).otherwise(F.col("primary"))
    out = consistency.solve(true.withColumn("main_value", value).drop("primary", "allowed", "range_start", "range_end"), mains, seconds)
    r = lambda c: F.round(F.col(c).cast("double"), 4).alias(c)
    return out.select("l_orderkey", "l_linenumber", "level", r("primary"), r("secondary"), F.array_join("consistency", ",").alias("flags"), "second_off")


# Export documents
STAT_KEYS = ["A", "N", "R"]


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders as items, their lines as entries; some of each kind that a layout can't hold."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), F.when(F.col("l_suppkey") % 6 == 0, "Unknown").otherwise(F.col("l_returnflag")).alias("key"), F.col("l_extendedprice").cast("float").alias("value")).alias("e"))
    subs = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("e")).alias("e")).select("l_orderkey", F.transform("e", lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))).alias("substats"))
    o = table(spark, d, "orders").join(subs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), F.col("o_orderstatus").alias("grp"), F.when(k % 13 == 0, "?!").otherwise(F.concat(F.lit("Item "), k.cast("string"))).alias("name"), F.get(F.array(F.lit(1), F.lit(3), F.lit(4), F.lit(2)), (k % 4).cast("int")).alias("cost"),
        F.lit(5).alias("rarity"), (k % 28).cast("int").alias("level"), F.when(k % 11 == 0, " ").otherwise(F.col("o_orderpriority")).alias("sonata"), F.when(k % 7 == 0, F.lit(None)).otherwise("A").cast("string").alias("main_key"),
        F.col("o_totalprice").cast("float").alias("main_value"), "substats", F.when(k % 3 == 0, F.concat(F.lit(" c"), F.col("o_custkey").cast("string"), F.lit(" "))).alias("equipped_by"),
    )


ITEMS = """
    WITH li AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_suppkey % 6 = 0 THEN 'Unknown' ELSE l_returnflag END AS key, l_extendedprice::FLOAT AS value FROM lineitem),
    it AS (SELECT o_orderkey AS id, o_orderstatus AS grp, CASE WHEN o_orderkey % 13 = 0 THEN '?!' ELSE 'Item ' || o_orderkey END AS name, [1, 3, 4, 2][(o_orderkey % 4 + 1)::INT] AS cost, (o_orderkey % 28)::INT AS level,
        CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderpriority END AS sonata, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'A' END AS main_key, o_totalprice::FLOAT AS main_value,
        CASE WHEN o_orderkey % 3 = 0 THEN ' c' || o_custkey || ' ' END AS who FROM orders),
    ok AS (SELECT *, cost IN (1, 3, 4) AND level BETWEEN 0 AND 25 AND trim(sonata) <> '' AND main_key IS NOT NULL AS fits FROM it)"""


@query(ITEMS + """,
    fst AS (SELECT k, value, row_number() OVER (PARTITION BY k, key ORDER BY n, value) AS r FROM li WHERE key <> 'Unknown'), subs AS (SELECT k, count(*) AS n_subs, round(sum(round_even(value::DOUBLE * 100, 0) / 100), 2) AS sum_subs FROM fst WHERE r = 1 GROUP BY ALL),
    kept AS (SELECT id, row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS idx FROM ok WHERE fits AND name <> '?!')
    SELECT ok.id, idx IS NULL AS skipped, CASE WHEN idx IS NOT NULL THEN 'item_1000_' || CASE WHEN idx < 1000 THEN lpad(idx::VARCHAR, 3, '0') ELSE idx::VARCHAR END || '_' || replace(name, ' ', '') END AS item_id,
        CASE WHEN idx IS NOT NULL THEN coalesce(n_subs, 0) END AS n_subs, CASE WHEN idx IS NOT NULL THEN coalesce(sum_subs, 0) END AS sum_subs, CASE WHEN idx IS NOT NULL THEN trim(who) END AS worn_by, 1000 + idx AS created_at
    FROM ok LEFT JOIN kept USING (id) LEFT JOIN subs ON subs.k = ok.id""")
def q_backup_items(spark: SparkSession, d: str) -> DataFrame:
    """EXP3: ids, entries and skips of the backup layout."""
    it = payload.backup_items(export_rows(spark, d), STAT_KEYS, 1000, ["id"], "grp")
    total = F.aggregate("item.subStats", F.lit(0.0), lambda s, e: s + e["value"])
    return it.select("id", "skipped", F.col("item.id").alias("item_id"), F.when(~F.col("skipped"), F.size("item.subStats")).cast("long").alias("n_subs"), F.round(total, 2).alias("sum_subs"), F.col("item.equippedByName").alias("worn_by"), F.col("item.createdAt").alias("created_at"))


@query(ITEMS + r""",
    subs AS (SELECT k, least(count(*), 9) AS n_subs FROM li WHERE key <> 'Unknown' GROUP BY ALL)
    SELECT id, NOT fits AS skipped, CASE WHEN fits THEN regexp_replace(sonata, '[^\p{L}\p{Nd}]', '', 'g') END AS set_key, CASE WHEN fits THEN CASE cost WHEN 1 THEN 'flower' WHEN 3 THEN 'sands' ELSE 'circlet' END END AS slot,
        CASE WHEN fits THEN least(level, 20) END AS level, CASE WHEN fits THEN level END AS true_level, CASE WHEN fits THEN 'eleMas' END AS main_key, CASE WHEN fits THEN coalesce(n_subs, 0) END AS n_subs, CASE WHEN fits THEN coalesce(who, '') END AS location
    FROM ok LEFT JOIN subs ON k = id""")
def q_artifact_items(spark: SparkSession, d: str) -> DataFrame:
    """EXP4, EXP10: items of the artifact layout."""
    it = payload.artifact_items(export_rows(spark, d))
    i = lambda f: F.col(f"item.{f}")
    return it.select("id", "skipped", i("setKey").alias("set_key"), i("slotKey").alias("slot"), i("level").alias("level"), i("wuwaLevel").alias("true_level"), i("mainStatKey").alias("main_key"), F.when(~F.col("skipped"), F.size("item.substats")).cast("long").alias("n_subs"), i("location").alias("location"))


BROKEN = [
    "{}", '{"schemaVersion":9}', '"x', "[]", '{"echoes":[1]}', '{"settings":{"scanIntervalMs":5,"scoreWeights":{"a":{"zz":1},"b":2}}}',
    '{"echoes":[{"id":"i","name":" ","cost":2,"rarity":5,"level":26,"sonata":null,"mainStat":{"key":"a","value":"1"},"subStats":{},"locked":1,"excluded":true,"createdAt":1,"source":"x","equippedBy":null}]}',
    '{"echoes":[{"id":"i","name":"n","cost":3,"rarity":0,"level":5,"sonata":"s","mainStat":{"key":"a","value":1},"subStats":[{"key":"a","value":1},{"value":2}],"locked":false,"excluded":true,"createdAt":1,"source":"scan"}]}',
]


@query(f"""
    WITH d AS (SELECT o_orderkey AS k, [{", ".join("'" + b + "'" for b in BROKEN)}][(o_orderkey % {len(BROKEN)} + 1)::INT] AS j FROM orders),
    v AS (SELECT k, CASE WHEN json_valid(j) THEN j::JSON END AS j FROM d), o AS (SELECT k, j FROM v WHERE json_type(j) = 'OBJECT'),
    e AS (SELECT k, i - 1 AS i, json_extract(j, '$.echoes[' || (i - 1) || ']') AS e FROM (SELECT k, j, unnest(range(1, json_array_length(j, '$.echoes')::BIGINT + 1)) AS i FROM o WHERE json_type(j, '$.echoes') = 'ARRAY')),
    eo AS (SELECT * FROM e WHERE json_type(e) = 'OBJECT'),
    s AS (SELECT k, i, n - 1 AS n, json_extract(e, '$.subStats[' || (n - 1) || ']') AS s FROM (SELECT k, i, e, unnest(range(1, json_array_length(e, '$.subStats')::BIGINT + 1)) AS n FROM eo WHERE json_type(e, '$.subStats') = 'ARRAY')),
    p AS (
        SELECT k, 'envelope: not valid JSON' AS problem FROM v WHERE j IS NULL
        UNION ALL SELECT k, 'envelope: root is not an object' FROM v WHERE json_type(j) <> 'OBJECT'
        UNION ALL SELECT k, 'envelope: schemaVersion must be 1..7' FROM o WHERE NOT coalesce(json_type(j, '$.schemaVersion') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND (j->>'$.schemaVersion')::DOUBLE BETWEEN 1 AND 7, FALSE)
        UNION ALL SELECT k, 'envelope: ' || f || ' must be a non-empty string' FROM o, unnest(['gameDataVersion', 'exportedAt']) t(f) WHERE NOT coalesce(json_type(j, '$.' || f) = 'VARCHAR' AND trim(j->>('$.' || f)) <> '', FALSE)
        UNION ALL SELECT k, 'envelope: ' || f || ' must be an array' FROM o, unnest(['characters', 'weapons', 'builds', 'teams', 'equippedLoadouts', 'theorycraftBuilds', 'optimizerProfiles', 'optimizerRuns', 'echoes']) t(f) WHERE coalesce(json_type(j, '$.' || f), '') <> 'ARRAY'
        UNION ALL SELECT k, 'envelope: settings must be an object' FROM o WHERE coalesce(json_type(j, '$.settings'), '') <> 'OBJECT'
        UNION ALL SELECT k, 'settings: ' || m FROM o, unnest(['displayName must be a non-empty string', 'privacyMode must be a boolean', 'background must be signal/tacet/plain', 'scanIntervalMs must be a number 250..10000', 'scoreWeights.a.zz must be a known stat key with a numeric weight', 'scoreWeights.b must be an object']) t(m) WHERE json_type(j, '$.settings') = 'OBJECT'
        UNION ALL SELECT k, 'echoes[' || i || ']: not an object' FROM e WHERE json_type(e) <> 'OBJECT'
        UNION ALL SELECT k, 'echoes[' || i || ']: ' || f || ' must be a non-empty string' FROM eo, unnest(['id', 'name', 'sonata']) t(f) WHERE NOT coalesce(json_type(e, '$.' || f) = 'VARCHAR' AND trim(e->>('$.' || f)) <> '', FALSE)
        UNION ALL SELECT k, 'echoes[' || i || ']: cost must be 1, 3 or 4' FROM eo WHERE (e->>'$.cost')::INT NOT IN (1, 3, 4)
        UNION ALL SELECT k, 'echoes[' || i || ']: rarity must be 1..5' FROM eo WHERE (e->>'$.rarity')::INT NOT BETWEEN 1 AND 5
        UNION ALL SELECT k, 'echoes[' || i || ']: level must be 0..25' FROM eo WHERE (e->>'$.level')::INT NOT BETWEEN 0 AND 25
        UNION ALL SELECT k, 'echoes[' || i || ']: value must be a finite number' FROM eo WHERE json_type(e, '$.mainStat.value') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE')
        UNION ALL SELECT k, 'echoes[' || i || ']: subStats must be an array' FROM eo WHERE json_type(e, '$.subStats') <> 'ARRAY'
        UNION ALL SELECT k, 'echoes[' || i || ']: subStats exceed what the level allows' FROM eo WHERE json_type(e, '$.subStats') = 'ARRAY' AND json_array_length(e, '$.subStats') > (e->>'$.level')::INT // 5
        UNION ALL SELECT k, 'echoes[' || i || ']: locked must be a boolean' FROM eo WHERE json_type(e, '$.locked') <> 'BOOLEAN'
        UNION ALL SELECT k, 'echoes[' || i || ']: source must be one of scan/screenshot/manual/import' FROM eo WHERE e->>'$.source' NOT IN ('scan', 'screenshot', 'manual', 'import')
        UNION ALL SELECT k, 'echoes[' || i || ']: equippedBy must be a string when present' FROM eo WHERE json_type(e, '$.equippedBy') <> 'VARCHAR'
        UNION ALL SELECT k, 'echoes[' || i || '].subStats[' || n || ']: key must be a non-empty string' FROM s WHERE json_type(s, '$.key') IS DISTINCT FROM 'VARCHAR'
    ) SELECT k, problem FROM p""")
def q_backup_rules(spark: SparkSession, d: str) -> DataFrame:
    """EXP5, EXP7 over broken documents."""
    j = F.get(F.array(*(F.lit(b) for b in BROKEN)), (F.col("o_orderkey") % len(BROKEN)).cast("int"))
    return payload.backup_problems(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), j.alias("j")), "k", "j", ["a", "n"])


BROKEN_ARTIFACTS = ["{}", '{"format":"GOOD","source":"s","version":2,"artifacts":[]}', '{"format":"GOOD","source":"s","version":3,"artifacts":[{"setKey":"s","slotKey":"","mainStatKey":"m","level":30,"rarity":5,"lock":null,"substats":[{"key":"k","value":1}]}]}']


@query(f"""
    WITH d AS (SELECT o_orderkey AS k, [{", ".join("'" + b + "'" for b in BROKEN_ARTIFACTS)}][(o_orderkey % {len(BROKEN_ARTIFACTS)} + 1)::INT]::JSON AS j FROM orders),
    a AS (SELECT k, json_extract(j, '$.artifacts[0]') AS a FROM d WHERE json_array_length(j, '$.artifacts') > 0)
    SELECT k, 'envelope: ' || f || ' must be a non-empty string' AS problem FROM d, unnest(['format', 'source']) t(f) WHERE json_type(j, '$.' || f) IS DISTINCT FROM 'VARCHAR'
    UNION ALL SELECT k, 'envelope: version must be 3' FROM d WHERE (j->>'$.version') IS DISTINCT FROM '3'
    UNION ALL SELECT k, 'envelope: artifacts must be an array' FROM d WHERE json_type(j, '$.artifacts') IS DISTINCT FROM 'ARRAY'
    UNION ALL SELECT k, 'artifacts[0]: slotKey must be a non-empty string' FROM a WHERE trim(a->>'$.slotKey') = ''
    UNION ALL SELECT k, 'artifacts[0]: level must be 0..25' FROM a WHERE (a->>'$.level')::INT > 25
    UNION ALL SELECT k, 'artifacts[0]: lock must be a boolean' FROM a WHERE json_type(a, '$.lock') <> 'BOOLEAN'""")
def q_artifact_rules(spark: SparkSession, d: str) -> DataFrame:
    """EXP6, EXP7 over broken documents."""
    j = F.get(F.array(*(F.lit(b) for b in BROKEN_ARTIFACTS)), (F.col("o_orderkey") % len(BROKEN_ARTIFACTS)).cast("int"))
    return payload.artifact_problems(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), j.alias("j")), "k", "j")


# Names and sets in text zones
SEGMENTS = "SELECT DISTINCT c_mktsegment AS name FROM customer"
ZONE = "(CASE WHEN c_custkey % 4 = 0 THEN 'Set Effect' || chr(10) ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN '* AB ' ELSE '12 ' END || CASE WHEN c_custkey % 5 = 0 THEN 'zq' || substr(c_mktsegment, 3) WHEN c_custkey % 7 = 0 THEN 'vvvvvvvv' ELSE c_mktsegment END || ' (2/5)')"


def zones(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.expr(ZONE.replace("chr(10)", "char(10)")).alias("zone"))


@query(f"""WITH s AS ({SEGMENTS}), l AS (SELECT c_custkey, pos, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^[^A-Za-z]*', ''), '^[A-Z]{{1,3}}\\s+', ''), '[&@(].*$', ''), '\\s+', ' ', 'g')) AS t
        FROM (SELECT c_custkey, unnest(string_split({ZONE}, chr(10))) AS line, unnest(range(0, 2))::INT AS pos FROM customer) WHERE line IS NOT NULL),
    n AS (SELECT c_custkey, pos, {NORM.format('t')} AS q FROM l WHERE length(t) >= 4), m AS (SELECT c_custkey, pos, name, {SIM.format(a='q', b=NORM.format('name'))} AS score FROM n, s),
    best AS (SELECT c_custkey, pos, max(score) AS score, arg_max(name, {{'s': score, 'n': length({NORM.format('name')})}}) AS name FROM m GROUP BY ALL)
    SELECT c_custkey, arg_max(name, {{'s': score, 'p': -pos}}) AS value, round(max(score)::DOUBLE, 6) AS confidence FROM best WHERE score >= 0.70::FLOAT GROUP BY 1""")
def q_zone_set(spark: SparkSession, d: str) -> DataFrame:
    """ER11: the set that a text zone names."""
    z = zones(spark, d)
    found = resolve.zone_set(z, "c_custkey", "zone", z.select(F.col("c_mktsegment").alias("name")).distinct(), "name")
    return found.select("c_custkey", "value", F.round(F.col("confidence").cast("double"), 6).alias("confidence"))


@query("""WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE ['Aa', 'Bb', 'Cc'][(o_orderkey % 3 + 1)::INT] END AS icon, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE ['aa', 'BB', 'Dd'][(o_custkey % 3 + 1)::INT] END AS txt,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN ['AA', 'dd'] WHEN o_orderkey % 7 = 2 THEN [] ELSE ['bb', 'cc'] END AS legal, (o_orderkey % 3)::INT AS header,
        CASE WHEN o_custkey % 2 = 0 THEN 'some line' ELSE '' END AS line, CASE WHEN o_custkey % 6 = 0 THEN 'Some' END AS hit FROM orders),
    y AS (SELECT *, legal IS NULL OR list_contains(list_transform(legal, lambda v: lower(v)), lower(txt)) AS t_ok, legal IS NULL OR list_contains(list_transform(legal, lambda v: lower(v)), lower(icon)) AS i_ok FROM x)
    SELECT k, CASE WHEN icon IS NOT NULL AND lower(txt) <> lower(icon) AND t_ok THEN txt WHEN icon IS NOT NULL THEN icon WHEN header > 0 AND line <> '' THEN coalesce(hit, line) WHEN header = 0 THEN legal[1] END AS value,
        round((CASE WHEN icon IS NOT NULL AND lower(txt) <> lower(icon) AND t_ok THEN 0.7 WHEN icon IS NOT NULL THEN 0.9 WHEN header > 0 AND line <> '' THEN CASE WHEN hit IS NOT NULL THEN 0.6 ELSE 0.3 END WHEN header = 0 AND legal[1] IS NOT NULL THEN 0.5 END)::DOUBLE, 3) AS confidence,
        coalesce(icon IS NOT NULL AND lower(txt) <> lower(icon) AND t_ok AND NOT i_ok, FALSE) AS settles FROM y""")
def q_set_arbitration(spark: SparkSession, d: str) -> DataFrame:
    """ER12, ER13, FLT2: icon against text, and the ladder without an icon."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda at, *some: F.get(F.array(*(F.lit(s) for s in some)), at.cast("int"))
    icon, txt = F.when(k % 4 != 0, pick(k % 3, "Aa", "Bb", "Cc")), F.when(k % 5 != 0, pick(c % 3, "aa", "BB", "Dd"))
    legal = F.when(k % 7 == 0, F.lit(None).cast("array<string>")).when(k % 7 == 1, F.array(F.lit("AA"), F.lit("dd"))).when(k % 7 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("bb"), F.lit("cc")))
    ladder = resolve.without_icon(k % 3, F.when(c % 2 == 0, "some line").otherwise(""), F.when(c % 6 == 0, "Some"), F.lit(0.6), legal)
    r = F.coalesce(resolve.arbitrate(icon, F.lit(0.9), txt, F.lit(0.7), legal), ladder)
    return table(spark, d, "orders").select(k.alias("k"), r.alias("r")).select("k", "r.value", F.round(F.col("r.confidence").cast("double"), 3).alias("confidence"), F.coalesce("r.settles", F.lit(False)).alias("settles"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_suppkey % 4 <> l_partkey % 4 THEN ((l_linenumber / 10.0)::FLOAT * 0.8::FLOAT)::FLOAT ELSE (l_linenumber / 10.0)::FLOAT END::DOUBLE, 5) AS score FROM lineitem")
def q_cost_contradiction(spark: SparkSession, d: str) -> DataFrame:
    """ER10."""
    s = resolve.contradicted(F.col("l_linenumber") / 10.0, F.col("l_suppkey") % 4, F.col("l_partkey") % 4)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(s.cast("double"), 5).alias("score"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber * 100000 + l_partkey AS o, CASE WHEN l_suppkey % 6 = 0 THEN 'Zz' ELSE l_returnflag END AS key FROM lineitem)
    SELECT l_orderkey, o, CASE WHEN key = 'Zz' THEN 'InvalidSubstatKey' WHEN row_number() OVER (PARTITION BY l_orderkey, key ORDER BY o) > 1 THEN 'SubstatDuplicate' END AS flag FROM x""")
def q_accepted_keys(spark: SparkSession, d: str) -> DataFrame:
    """SL8."""
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("o"), F.when(F.col("l_suppkey") % 6 == 0, "Zz").otherwise(F.col("l_returnflag")).alias("key"))
    return slots.accepted(li, "l_orderkey", "key", "o", STAT_KEYS).select("l_orderkey", "o", "flag")


@query("""WITH t AS (SELECT label, list_transform(range(1, 65), lambda i: avg_[i]) AS v FROM (SELECT label, list(m ORDER BY i) AS avg_ FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, 64)) AS i FROM embeddings) GROUP BY ALL) GROUP BY 1)),
    s AS (SELECT vec_id, t.label, 1 - list_sum(list_transform(range(1, 65), lambda i: abs(embedding[i]::DOUBLE - t.v[i]))) / 256 AS s FROM embeddings, t)
    SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label)::INT AS rank, round(s, 9) AS score FROM s QUALIFY rank <= 3""")
def q_rank_all(spark: SparkSession, d: str) -> DataFrame:
    """VS3, VS5, TOP2: the three best templates of each vector."""
    e = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    ranked = resolve.rank_all(e, vectors.mean_vectors(e, "label", "v", 1), "vec_id", "v", "label", "vector", 3)
    return ranked.select("vec_id", "rank", F.round("score", 9).alias("score"))


RGBA = "SELECT vec_id, i // 4 AS k, max(v) FILTER (i % 4 = 0) AS r, max(v) FILTER (i % 4 = 1) AS g, max(v) FILTER (i % 4 = 2) AS b, max(v) FILTER (i % 4 = 3) AS a FROM p GROUP BY ALL"


def colours(spark: SparkSession, d: str) -> DataFrame:
    """Each raster's 64 values as 16 pixels of four channels."""
    at = lambda i, k: F.get("px", i * 4 + k)
    one = lambda i: F.struct(*(at(i, k).alias(n) for k, n in enumerate("rgba")))
    return pixels(spark, d).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), one).alias("rgba"))


@query(PX + f""", c AS ({RGBA}), s AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM c),
    h AS (SELECT *, (hi + lo) / 510.0 AS l, CASE WHEN hi = lo THEN 0.0 ELSE (hi - lo)::DOUBLE / CASE WHEN hi + lo <= 255 THEN hi + lo ELSE 510 - hi - lo END END AS sat,
        CASE WHEN hi > lo THEN ((CASE WHEN hi = r THEN (g - b)::DOUBLE / (hi - lo) WHEN hi = g THEN (b - r)::DOUBLE / (hi - lo) + 2 ELSE (r - g)::DOUBLE / (hi - lo) + 4 END * 60) % 360 + 360) % 360 END AS hue FROM s),
    v AS (SELECT vec_id, CASE WHEN a > 180 AND l >= 0.58 THEN CASE WHEN sat < 0.20 THEN 1 WHEN hue >= 75 AND hue < 175 THEN 2 WHEN hue >= 175 AND hue < 250 THEN 3 WHEN hue >= 250 AND hue < 335 THEN 4 WHEN hue >= 32 AND hue < 75 THEN 5 END END AS k FROM h),
    n AS (SELECT vec_id, k, count(*) AS n FROM v WHERE k IS NOT NULL GROUP BY ALL)
    SELECT vec_id, coalesce((SELECT arg_max(k, {{'n': n, 'k': -k}}) FROM n WHERE n.vec_id = e.vec_id), 0)::INT AS rarity FROM embeddings e""")
def q_rarity_vote(spark: SparkSession, d: str) -> DataFrame:
    """R16, AGG14."""
    return colours(spark, d).select("vec_id", raster.rarity_vote(F.col("rgba")).alias("rarity"))


@query(PX + f""", c AS ({RGBA}), l AS (SELECT vec_id, k, CASE WHEN a < 40 THEN 0.0 ELSE (r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) / 255.0::DOUBLE END AS y FROM c),
    m AS (SELECT vec_id, avg(y) AS m, CASE WHEN stddev_pop(y) = 0 THEN 1 ELSE stddev_pop(y) END AS sd FROM l GROUP BY 1),
    z AS (SELECT vec_id, sum(abs(least(2, greatest(-2, (y - m) / sd)))) AS spread FROM l JOIN m USING (vec_id) GROUP BY 1), o AS (SELECT vec_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM c WHERE a >= 40 GROUP BY 1)
    SELECT vec_id, round(spread, 6) AS spread, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM z LEFT JOIN o USING (vec_id)""")
def q_luma_signature(spark: SparkSession, d: str) -> DataFrame:
    """VS1, VS9."""
    c = colours(spark, d).select("vec_id", vectors.luma_signature(F.col("rgba")).alias("s"), vectors.mean_colour(F.col("rgba")).alias("m"))
    return c.select("vec_id", F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("spread"), *(F.round(f"m.{n}", 6).alias(n) for n in "rgb"))


DISPLAY = {"MachineTool": "MACHINERY", "Building": "BUILDING", "Car": "AUTOMOBILE"}


@query("""SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'machinery' THEN 'MachineTool' WHEN 'building' THEN 'Building' WHEN 'automobile' THEN 'Car' END AS key, coalesce(CASE WHEN c_mktsegment = 'MACHINERY' THEN 'MACHINERY' END, c_mktsegment) AS shown,
    printf('%.2f', c_acctbal::DOUBLE) AS f2, printf('%03d', c_nationkey) AS d3, printf('%.1f', c_nationkey / 25.0::DOUBLE * 100) || '%' AS share FROM customer""")
def q_display_names(spark: SparkSession, d: str) -> DataFrame:
    """TX18, TX19, J13."""
    c = table(spark, d, "customer")
    key = text.from_display(F.lower("c_mktsegment"), DISPLAY)
    return c.select("c_custkey", key.alias("key"), text.to_display(F.coalesce(key, F.col("c_mktsegment")), DISPLAY).alias("shown"), text.fixed_places(F.col("c_acctbal")).alias("f2"), text.padded_number(F.col("c_nationkey"), 3).alias("d3"), text.as_percent(F.col("c_nationkey") / F.lit(25.0)).alias("share"))


BOXES = "l_linenumber / 10.0 AS x, l_discount::DOUBLE AS y, l_quantity / 60.0 AS w, l_tax::DOUBLE + 0.1 AS h"


@query(f"WITH b AS (SELECT l_orderkey AS k, {BOXES} FROM lineitem) SELECT k, round(greatest(0, min(x)), 6) AS x, round(greatest(0, min(y)), 6) AS y, round(least(1, max(x + w)) - greatest(0, min(x)), 6) AS w, round(least(1, max(y + h)) - greatest(0, min(y)), 6) AS h FROM b GROUP BY 1")
def q_union_rect(spark: SparkSession, d: str) -> DataFrame:
    """SET2, R18."""
    li = table(spark, d, "lineitem")
    box = F.struct((F.col("l_linenumber") / 10.0).alias("x"), F.col("l_discount").cast("double").alias("y"), (F.col("l_quantity") / 60.0).alias("w"), (F.col("l_tax").cast("double") + 0.1).alias("h"))
    u = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(box).alias("b")).select("k", raster.union_rect(F.col("b")).alias("u"))
    return u.select("k", *(F.round(f"u.{c}", 6).alias(c) for c in "xywh"))
