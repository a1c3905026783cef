"""Scalar rules on text, dates, positions and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.functions import calendar as cal
from surveyspark.functions import geo
from surveyspark.functions import recode as rc
from surveyspark.functions import text as tx
from surveyspark.operators import transforms as tf
from surveyspark.plans.registry import Tables, query, r, rounded
from surveyspark.plans.views import oracle_views


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _lines(t: Tables):
    """Every line of every document is a label."""
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "label"))


LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS label, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents)"


def norm_sql(x: str, brackets: bool = True, question: bool = False) -> str:
    if brackets:
        for o, c in (("(", ")"), ("[", "]")):
            x = f"(CASE WHEN contains({x}, '{o}') AND contains({x}, '{c}') THEN split_part({x}, '{o}', 1) || split_part({x}, '{c}', -1) ELSE {x} END)"
    if question:
        x = (
            f"(CASE WHEN contains({x}, ': ') THEN regexp_extract({x}, '(?s)^.*?: (.*)$', 1) "
            f"WHEN contains({x}, ' - ') THEN regexp_extract({x}, '(?s)^.*? - (.*)$', 1) ELSE {x} END)"
        )
    punct = r"""[!"#$%&''()*+\-./:;<=>?@\[\\\]^_`{|}~,]"""
    x = f"regexp_replace({x}, '{punct}', ' ', 'g')"
    x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    x = f"regexp_replace({x}, ' $', '')"
    return f"regexp_replace({x}, '(^| )(don|won|can) t( |$)', '\\1\\2''t\\3', 'g')"


@query(
    "normalised_labels",
    ["SF-1"],
    f"""WITH {LINES_SQL}, a AS (SELECT doc_id, line, (CASE WHEN contains(label, '(') AND contains(label, ')') THEN split_part(label, '(', 1) || split_part(label, ')', -1) ELSE label END) AS label FROM l),
        b AS (SELECT doc_id, line, (CASE WHEN contains(label, '[') AND contains(label, ']') THEN split_part(label, '[', 1) || split_part(label, ']', -1) ELSE label END) AS label FROM a)
        SELECT doc_id, line, {norm_sql('label', brackets=False, question=True)} AS label FROM b""",
)
def normalised_labels(t: Tables):
    return _lines(t).select("doc_id", "line", tx.normalise_label("label", question=True).alias("label"))


@query(
    "labels_without_stop_words",
    ["SF-2"],
    f"""WITH {LINES_SQL}, w AS (SELECT doc_id, line, label, unnest(string_split(label, ' ')) AS word, unnest(range(len(string_split(label, ' ')))) AS i FROM l),
        k AS (SELECT doc_id, line, word, min(i) AS i FROM w WHERE word NOT IN (SELECT unnest({_sql_list(tx.STOP_WORDS)})) GROUP BY ALL),
        j AS (SELECT doc_id, line, string_agg(word, ' ' ORDER BY i) AS kept FROM k GROUP BY ALL)
        SELECT doc_id, line, CASE WHEN contains(label, ' ') THEN coalesce(kept, label) ELSE label END AS label FROM l LEFT JOIN j USING (doc_id, line)""",
)
def labels_without_stop_words(t: Tables):
    return _lines(t).select("doc_id", "line", tx.remove_stop_words("label").alias("label"))


@query(
    "answers_without_keys",
    ["SF-3"],
    f"""WITH a AS (SELECT CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_size || ': ' || p_name END AS answer, count(*) AS n FROM part GROUP BY ALL)
        SELECT CASE WHEN contains(answer, ': ') THEN split_part(answer, ': ', 2) ELSE answer END AS answer, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY 1""",
)
def answers_without_keys(t: Tables):
    raw = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat_ws(": ", F.col("p_size"), F.col("p_name")))
    counts = t.part.groupBy(raw.alias("answer")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(tx.answer_text("answer").alias("answer")).agg(F.sum("n").alias("n"))


_QUANT = [
    "95 or more", "more than 12 hours", "less than 1,000", "2 years and more", "one or more km", "300+", "none",
    "7 or more visits", "don't know", "12", "two and less", "no land", " 5 ",
]


def _quantities(t: Tables):
    texts = F.array(*[F.lit(x) for x in _QUANT])
    k = F.col("o_orderkey")
    question = F.when(k % 2 == 0, "age in months or km of land").otherwise("time in minutes")
    return t.orders.select(
        "o_orderkey", F.get(texts, (k % len(_QUANT)).cast("int")).alias("answer"), question.alias("question")
    )


_QVALUES = {
    "95 or more": (95, 95), "more than 12 hours": (None, None), "less than 1,000": (1000, 1000), "2 years and more": (24, None),
    "one or more km": (1, None), "300+": (300, 300), "none": (0, 0), "7 or more visits": (None, None), "don't know": (None, None),
    "12": (12, 12), "two and less": (2, 2), "no land": (None, None), " 5 ": (5, 5),
}


def _quant_sql() -> str:
    even = " ".join(f"WHEN {i} THEN {_QVALUES[x][0] if _QVALUES[x][0] is not None else 'NULL'}" for i, x in enumerate(_QUANT))
    odd = " ".join(f"WHEN {i} THEN {_QVALUES[x][1] if _QVALUES[x][1] is not None else 'NULL'}" for i, x in enumerate(_QUANT))
    k = f"o_orderkey % {len(_QUANT)}"
    return f"SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN CASE {k} {even} END ELSE CASE {k} {odd} END END AS DOUBLE) AS value FROM orders"


@query("quantity_answers", ["SF-4"], _quant_sql())
def quantity_answers(t: Tables):
    return _quantities(t).select(
        "o_orderkey", tx.numeric_answer("answer", "question", F.lit(True), F.lit(False)).alias("value")
    )


@query(
    "repaired_answers",
    ["SF-5"],
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'don''t know' WHEN 1 THEN 'don''t know' WHEN 2 THEN p_name WHEN 3 THEN p_name END AS answer FROM part""",
)
def repaired_answers(t: Tables):
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    raw = F.when(k == 0, "dk").when(k == 1, "unknow").when(k == 2, F.concat(F.lit("..ue "), n)).when(k == 3, F.concat(n, F.lit("ÿ"))).otherwise(n)
    return t.part.select("p_partkey", tx.repair_known_issue(raw).alias("answer"))


@query(
    "autocorrected_answers",
    ["SF-5", "SF-4"],
    f"""{oracle_views('households')}, a AS (SELECT DISTINCT radio AS answer FROM households WHERE radio IN ('yes', 'no'))
        SELECT 'minutes' AS "column", '1: 300+' AS answer, '1' AS key, '300+' AS text, '300.0' AS corrected FROM a WHERE answer = 'yes'
        UNION ALL SELECT 'minutes', '2: ', '2', '2.0', '2.0' FROM a WHERE answer = 'yes'
        UNION ALL SELECT 'radio', '1: dk', '1', 'dk', 'don''t know' FROM a WHERE answer = 'yes'""",
)
def autocorrected_answers(t: Tables):
    seen = t.households.select("radio", "minutes")
    radio = seen.filter(F.col("radio").isin("yes", "no")).select("radio").distinct().select(
        F.lit("radio").alias("column"), F.when(F.col("radio") == "yes", "1: dk").otherwise("0: no").alias("answer"),
        F.when(F.col("radio") == "yes", 1).otherwise(2).alias("position"), F.lit(False).alias("has_numbers"),
    )
    minutes = seen.filter("minutes IN ('300+', 'on premises')").select("minutes").distinct().select(
        F.lit("minutes").alias("column"), F.when(F.col("minutes") == "300+", "1: 300+").otherwise("2: ").alias("answer"),
        F.when(F.col("minutes") == "300+", 1).otherwise(2).alias("position"), F.lit(True).alias("has_numbers"),
    )
    return tx.autocorrect(radio.unionByName(minutes))


@query(
    "truncated_coordinates",
    ["SF-6"],
    f"""{oracle_views('clusters')}, c AS (SELECT cluster, CAST(LATNUM AS VARCHAR) AS s FROM clusters)
        SELECT cluster, split_part(s, '.', 1) || '.' || rpad(substr(split_part(s, '.', 2), 1, 2), 2, '0') AS lat FROM c""",
)
def truncated_coordinates(t: Tables):
    return t.clusters.select("cluster", tx.truncate_decimal("LATNUM", 2).alias("lat"))


@query(
    "parsed_tile_names",
    ["SF-7", "SF-8", "SF-24"],
    f"""{oracle_views('clusters')}
        SELECT cluster, cc || 'GE' AS survey, cluster AS number, CASE WHEN URBAN_RURA = 'U' THEN 'u_2.0' ELSE 'r_10.0' END AS kind,
               CASE WHEN DHSYEAR < 2016 THEN '20150601-20160701' ELSE DHSYEAR || '0101-' || DHSYEAR || '1231' END AS period FROM clusters""",
)
def parsed_tile_names(t: Tables):
    rows = t.clusters.withColumn("file", F.concat("cc", F.lit("GE"), F.lpad(F.col("cluster").cast("string"), 8, "0"), F.lit(".tif")))
    survey, number = tx.tile_survey_cluster("file")
    name = tx.tile_name(F.col("LATNUM"), F.col("LONGNUM"), cal.imaging_period("DHSYEAR"), F.lit("XYZ"), F.col("URBAN_RURA") == "U")
    parts = F.split(name, "_")
    return rows.select(
        "cluster", survey.alias("survey"), number.alias("number"), F.concat_ws("_", parts[4], parts[5]).alias("kind"), parts[2].alias("period")
    )


@query(
    "country_codes",
    ["SF-9"],
    """SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, n_name AS country FROM events JOIN nation ON n_nationkey = CAST(json_extract(props, '$.k') AS BIGINT) % 25""",
)
def country_codes(t: Tables):
    """Codes parsed from JSON and named through a lookup table."""
    rows = t.events.withColumn("k", F.from_json("props", "k BIGINT")["k"])
    names = t.nation.select(F.col("n_nationkey").cast("bigint").alias("code"), F.col("n_name").alias("country"))
    return rows.join(names, F.col("k") % 25 == F.col("code")).select("event_id", "user_id", "k", "country")


@query(
    "sanitised_names",
    ["SF-10"],
    r"""SELECT page_id, regexp_replace(url, '[^\pL\pN_\-.]', '_', 'g') AS file,
        CASE WHEN contains(url, '/') THEN left(url, length(url) - strpos(reverse(url), '/')) || ': ' || right(url, strpos(reverse(url), '/') - 1) ELSE url END AS replaced FROM pages""",
)
def sanitised_names(t: Tables):
    return t.pages.select("page_id", tx.sanitise_file_name("url").alias("file"), tx.replace_last("url", "/", ": ").alias("replaced"))


@query(
    "negated_answers",
    ["SF-11"],
    f"WITH {LINES_SQL} SELECT doc_id, line, list_has_any(string_split(label, ' '), {_sql_list(tx.NEGATION_WORDS)}) AS negated FROM l",
)
def negated_answers(t: Tables):
    return _lines(t).select("doc_id", "line", tx.is_negated("label").alias("negated"))


@query(
    "close_names",
    ["SF-13"],
    f"""{oracle_views('clusters')} SELECT DISTINCT adm2_name, adm1_name, {r("1 - levenshtein(adm2_name, adm1_name) / greatest(length(adm2_name), length(adm1_name))")} AS closeness,
        1 - levenshtein(adm2_name, adm1_name) / greatest(length(adm2_name), length(adm1_name)) >= 0.6 AS near FROM clusters""",
)
def close_names(t: Tables):
    rows = t.clusters.select("adm2_name", "adm1_name").distinct()
    return rounded(
        rows.select("adm2_name", "adm1_name", tx.closeness("adm2_name", "adm1_name").alias("closeness"), tx.close_match("adm2_name", "adm1_name").alias("near"))
    )


def rules_sql(rules, x: str) -> str:
    whens = []
    for rule in rules:
        every = [f"contains({x}, '{p.replace(chr(39), chr(39) * 2)}')" for p in rule.every]
        some = [f"contains({x}, '{p.replace(chr(39), chr(39) * 2)}')" for p in rule.some]
        some += [f"{x} = '{p}'" for p in rule.exact]
        cond = " AND ".join([*every, *(["(" + " OR ".join(some) + ")"] if some else [])]) or "TRUE"
        whens.append(f"WHEN {cond} THEN " + (x if rule.result is None else f"'{rule.result}'"))
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(whens) + " END"


_SIMPLE_SQL = f"{oracle_views('households')}, s AS (SELECT *, {rules_sql(rc.SIMPLIFY, 'source')} AS simple FROM households)"


@query(
    "water_source_categories",
    ["SF-14"],
    f"{_SIMPLE_SQL} SELECT household, simple, "
    + ", ".join(f'{rules_sql(rules, "simple")} AS "{name}"' for name, rules in rc.CATEGORY_SCHEMES.items())
    + " FROM s",
)
def water_source_categories(t: Tables):
    rows = t.households.select("household", rc.simplify_source("source").alias("simple"))
    return rows.select("*", *[rc.source_category("simple", s).alias(s) for s in rc.CATEGORY_SCHEMES])


_WEIGHT_SQL = "CASE simple " + " ".join(f"WHEN '{k}' THEN {w}" for k, (w, _) in rc.SOURCE_WEIGHTS.items()) + " END"
_CLASS_SQL = "CASE simple " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, (_, c) in rc.SOURCE_WEIGHTS.items()) + " ELSE simple END"


@query(
    "source_weights",
    ["SF-15"],
    f"{_SIMPLE_SQL} SELECT household, {_WEIGHT_SQL} AS weight, {_CLASS_SQL} AS class FROM s",
)
def source_weights(t: Tables):
    rows = t.households.select("household", rc.simplify_source("source").alias("simple"))
    return rows.select("household", rc.source_weight("simple").alias("weight"), rc.source_class("simple").alias("class"))


_TIME_SQL = f"""{_SIMPLE_SQL}, m AS (SELECT *, CASE WHEN trim(minutes) IN ('nan', '') THEN NULL WHEN minutes = '300+' THEN '300' ELSE minutes END AS mins FROM s),
    f AS (SELECT *, CASE WHEN mins IS NULL THEN CASE simple WHEN 'piped into dwelling' THEN 0.0 WHEN 'piped to yard/plot' THEN 1.0 END
             WHEN mins = 'on premises' THEN CASE WHEN simple IN ({", ".join(repr(x) for x in rc.ON_PLOT_SOURCES)}) THEN 1.0 WHEN simple = 'piped into dwelling' THEN 0.0 ELSE 5.0 END
             ELSE TRY_CAST(mins AS DOUBLE) END AS t FROM m),
    g AS (SELECT *, COALESCE(location, CASE WHEN simple = 'piped into dwelling' THEN 'in own dwelling' WHEN simple = 'piped to yard/plot' THEN 'in own yard/plot'
             WHEN simple IN ({", ".join(repr(x) for x in rc.ELSEWHERE_SOURCES)}) THEN 'elsewhere' WHEN t = 0 THEN 'in own yard/plot' WHEN t >= 3 THEN 'elsewhere' END) AS loc FROM f)"""


def _filled(t: Tables):
    rows = t.households.withColumn("simple", rc.simplify_source("source")).withColumn(
        "mins", F.when(F.col("minutes") == "300+", "300").otherwise(tx.null_tokens("minutes"))
    )
    rows = rows.withColumn("t", rc.fetch_time("mins", "simple"))
    return rows.withColumn("loc", rc.source_location("location", "simple", "t"))


@query("filled_time_and_place", ["SF-16"], f"{_TIME_SQL} SELECT household, CAST(t AS DOUBLE) AS t, loc FROM g")
def filled_time_and_place(t: Tables):
    return _filled(t).select("household", "t", "loc")


@query(
    "filled_water_answers",
    ["SF-16"],
    f"""{oracle_views('households')}, h AS (SELECT household, source AS s, location AS l, TRY_CAST(minutes AS DOUBLE) AS t FROM households),
        p AS (SELECT *, CASE WHEN regexp_matches(s, 'neighbor|public|water seller|sachet water|river') THEN 'elsewhere'
               WHEN regexp_matches(s, 'yard|plot|courtyard|compound') THEN 'in own yard/plot' WHEN regexp_matches(s, 'dwelling|residence') THEN 'in own dwelling' END AS bt FROM h),
        n AS (SELECT *, CASE WHEN s IS NULL THEN l ELSE COALESCE(l, bt, CASE WHEN t > 1 THEN 'elsewhere' WHEN t <= 1 THEN 'in own yard/plot' END, 'in own yard/plot') END AS loc FROM p)
        SELECT household, loc AS "location of source for water", CAST(CASE WHEN s IS NULL THEN t WHEN l IS NULL AND bt IS NULL AND t = 0 THEN 1.0
          WHEN t IS NULL THEN CASE loc WHEN 'in own dwelling' THEN 0.0 WHEN 'in own yard/plot' THEN 1.0 END ELSE t END AS DOUBLE) AS "time to get to water source (minutes)" FROM n""",
)
def filled_water_answers(t: Tables):
    rows = t.households.select(
        "household", F.col("source").alias("source of drinking water"), F.col("location").alias("location of source for water"),
        F.col("minutes").try_cast("double").alias("time to get to water source (minutes)"),
    )
    return rc.fill_water_answers(rows).drop("source of drinking water")


@query(
    "skip_patterns",
    ["SF-17"],
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'not applicable' WHEN o_orderkey % 3 = 0 THEN 'no' END AS "share toilet with other households",
       CASE WHEN o_orderkey % 4 = 0 THEN '10.0' WHEN o_orderkey % 3 = 0 THEN '0.0' END AS "number of households sharing toilet",
       CASE WHEN o_orderkey % 4 = 0 THEN 'not applicable' ELSE 'applicable' END AS "number of households sharing toilet: applicable",
       CASE WHEN o_orderkey % 5 = 0 THEN 'yes' WHEN o_orderkey % 2 = 0 THEN '0.0' END AS "owns goats" FROM orders""",
)
def skip_patterns(t: Tables):
    k = F.col("o_orderkey")
    rows = t.orders.select(
        "o_orderkey",
        F.when(k % 4 == 0, rc.NO_TOILET).otherwise("flush").alias("type of toilet facility"),
        F.when(k % 3 == 0, "no").alias("share toilet with other households"),
        F.lit(None).cast("string").alias("number of households sharing toilet"),
        F.when(k % 2 == 0, "no").otherwise("yes").alias("owns livestock, herds or farm animals"),
        F.when(k % 5 == 0, "yes").alias("owns goats"),
    )
    return rc.apply_fills(rows).drop("type of toilet facility", "owns livestock, herds or farm animals")


@query(
    "penalised_time",
    ["SF-18"],
    f"""{_TIME_SQL}, p AS (SELECT household, t + CASE loc WHEN 'in own dwelling' THEN 0 WHEN 'in own yard/plot' THEN 5 WHEN 'elsewhere' THEN 10 END AS p,
        CASE loc WHEN 'in own dwelling' THEN 5 WHEN 'in own yard/plot' THEN 3 WHEN 'elsewhere' THEN 1 END AS weight FROM g)
        SELECT household, CAST(p AS DOUBLE) AS penalised, CAST(CASE WHEN p IS NOT NULL THEN least(p, 310) END AS DOUBLE) AS capped, weight FROM p""",
)
def penalised_time(t: Tables):
    rows = _filled(t)
    total, capped = rc.with_penalty("t", "loc")
    return rows.select("household", total.alias("penalised"), capped.alias("capped"), rc.lookup("loc", rc.LOCATION_WEIGHT).alias("weight"))


def buckets_sql(x: str, limits) -> tuple[str, str]:
    label = " ".join(f"WHEN {x} BETWEEN {a + 1} AND {b} THEN '{a + 1} - {b} mins'" for a, b in zip(limits[:-1], limits[1:]))
    rank = " ".join(f"WHEN {x} BETWEEN {a + 1} AND {b} THEN {-i}" for i, (a, b) in enumerate(zip(limits[:-1], limits[1:])))
    return f"CASE {label} END", f"CASE {rank} END"


_B1, _B2 = buckets_sql("m", rc.DISTANCE_LIMITS)


@query(
    "distance_buckets",
    ["SF-19"],
    f"""{_TIME_SQL}, c AS (SELECT cluster, avg(t) AS m FROM g GROUP BY cluster) SELECT cluster, {_B1} AS label, {_B2} AS rank FROM c""",
)
def distance_buckets(t: Tables):
    means = _filled(t).groupBy("cluster").agg(F.avg("t").alias("m"))
    label, rank = rc.inclusive_buckets("m", rc.DISTANCE_LIMITS)
    return means.select("cluster", label.alias("label"), rank.alias("rank"))


@query(
    "survey_dates",
    ["SF-20", "SF-21"],
    "SELECT o_orderkey, CAST(make_date(year(o_orderdate), month(o_orderdate), least(day(o_orderdate), 28)) AS VARCHAR) AS date, month(o_orderdate) AS month, 1990 + CAST(3 + o_orderkey % 7 AS INT) AS year FROM orders",
)
def survey_dates(t: Tables):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        cal.survey_date(F.year(d), F.month(d), F.dayofmonth(d)).cast("string").alias("date"),
        cal.month_number(F.date_format(d, "MMMM")).alias("month"),
        cal.full_year((93 + F.col("o_orderkey") % 7).cast("string")).alias("year"),
    )


@query(
    "minutes_from_text",
    ["SF-21"],
    f"""{oracle_views('households')} SELECT household, CASE minutes WHEN '300+' THEN 300.0 WHEN 'on premises' THEN 0.0 ELSE CAST(TRY_CAST(nullif(minutes, 'nan') AS DOUBLE) AS DOUBLE) END AS minutes FROM households""",
)
def minutes_from_text(t: Tables):
    return t.households.select("household", cal.minutes(tx.null_tokens("minutes")).alias("minutes"))


@query(
    "ethiopian_dates",
    ["SF-22"],
    """WITH e AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, least(day(o_orderdate), 30) AS d FROM orders)
        SELECT o_orderkey, CAST(DATE '1970-01-01' + CAST(1723856 + 365 * y + y // 4 + 30 * m + d - 31 - 2440588 AS INTEGER) AS VARCHAR) AS date FROM e""",
)
def ethiopian_dates(t: Tables):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", cal.ethiopian_to_gregorian(F.year(d), F.month(d), F.least(F.dayofmonth(d), F.lit(30))).cast("string").alias("date")
    )


@query(
    "cluster_gregorian_year",
    ["SF-22"],
    """WITH e AS (SELECT o_custkey, year(DATE '1970-01-01' + CAST(1723856 + 365 * year(o_orderdate) + year(o_orderdate) // 4 + 30 * month(o_orderdate) + least(day(o_orderdate), 30) - 31 - 2440588 AS INTEGER)) AS y FROM orders),
        n AS (SELECT o_custkey, y, count(*) AS n FROM e GROUP BY ALL) SELECT o_custkey, arg_max(y, (n, -y)) AS gregorian_year FROM n GROUP BY o_custkey""",
)
def cluster_gregorian_year(t: Tables):
    d = F.col("o_orderdate")
    rows = t.orders.select("o_custkey", F.year(d).alias("y"), F.month(d).alias("m"), F.least(F.dayofmonth(d), F.lit(30)).alias("d"))
    return cal.cluster_gregorian_year(rows, ["o_custkey"], "y", "m", "d")


@query(
    "calendar_offsets",
    ["SF-23"],
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 5 MONTH AS DATE)::VARCHAR AS later, CAST(CAST(o_orderdate AS DATE) - INTERVAL 2 YEAR AS DATE)::VARCHAR AS earlier FROM orders",
)
def calendar_offsets(t: Tables):
    d = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey", cal.add_span(d, 5, "m").cast("string").alias("later"), cal.add_span(d, -2, "y").cast("string").alias("earlier")
    )


@query(
    "imaging_windows",
    ["SF-24"],
    f"""{oracle_views('clusters')} SELECT cluster, CASE WHEN DHSYEAR < 2016 THEN '2015-06-01' ELSE DHSYEAR || '-01-01' END AS first,
        CASE WHEN DHSYEAR < 2016 THEN '2016-07-01' ELSE DHSYEAR || '-12-31' END AS last, greatest(2013, least(2022, DHSYEAR)) AS lights FROM clusters""",
)
def imaging_windows(t: Tables):
    first, last = cal.imaging_window("DHSYEAR")
    return t.clusters.select("cluster", first.cast("string").alias("first"), last.cast("string").alias("last"), cal.night_light_year("DHSYEAR").alias("lights"))


@query(
    "month_end_dates",
    ["SF-25"],
    """WITH b AS (SELECT o_orderstatus AS s, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS z FROM orders GROUP BY ALL),
        m AS (SELECT s, a, z, CAST(last_day(unnest(generate_series(date_trunc('month', a), date_trunc('month', z), INTERVAL 1 MONTH))) AS DATE) AS d FROM b)
        SELECT s AS o_orderstatus, CAST(d AS VARCHAR) AS month_end FROM m WHERE d BETWEEN a AND z""",
)
def month_end_dates(t: Tables):
    bounds = t.orders.groupBy("o_orderstatus").agg(
        F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("z")
    )
    ends = F.transform(cal.month_ends(F.col("a"), F.col("z")), lambda d: d.cast("string"))
    return bounds.select("o_orderstatus", F.explode(ends).alias("month_end"))


_HAV = "2 * 6371.0 * asin(least(sqrt(power(sin(radians(b.LATNUM - a.LATNUM) / 2), 2) + cos(radians(a.LATNUM)) * cos(radians(b.LATNUM)) * power(sin(radians(b.LONGNUM - a.LONGNUM) / 2), 2)), 1.0))"


@query(
    "haversine_to_area_centre",
    ["SF-26"],
    f"""{oracle_views('clusters')}, b AS (SELECT adm2_name, avg(LATNUM) AS LATNUM, avg(LONGNUM) AS LONGNUM FROM clusters GROUP BY adm2_name)
        SELECT a.cluster, {r(_HAV, 4)} AS km FROM clusters a JOIN b USING (adm2_name)""",
)
def haversine_to_area_centre(t: Tables):
    centre = t.clusters.groupBy("adm2_name").agg(F.avg("LATNUM").alias("la"), F.avg("LONGNUM").alias("lo"))
    rows = t.clusters.join(centre, "adm2_name")
    return rounded(rows.select("cluster", geo.haversine_km(F.col("LATNUM"), F.col("LONGNUM"), F.col("la"), F.col("lo")).alias("km")), 4)


@query(
    "bounding_boxes",
    ["SF-27"],
    f"""{oracle_views('clusters')}, d AS (SELECT *, CASE WHEN URBAN_RURA = 'U' THEN 2000.0 ELSE 10000.0 END / 111320.0 AS d FROM clusters)
        SELECT cluster, {r('LATNUM - d')} AS lat_min, {r('LATNUM + d')} AS lat_max, {r('LONGNUM - d / cos(radians(LATNUM))')} AS lon_min, {r('LONGNUM + d / cos(radians(LATNUM))')} AS lon_max FROM d""",
)
def bounding_boxes(t: Tables):
    box = geo.bounding_box(F.col("LATNUM"), F.col("LONGNUM"), F.col("URBAN_RURA") == "U")
    return rounded(t.clusters.select("cluster", *[c.alias(n) for n, c in box.items()]))


def _rings(t: Tables):
    la, lo = F.col("LATNUM"), F.col("LONGNUM")
    pts = [(lo, la), (lo + 0.5, la), (lo + 0.5, la + 0.25), (lo, la + 0.25)]
    return t.clusters.withColumn("ring", F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in pts]))


def _albers_sql(lat: str, lon: str) -> tuple[str, str]:
    e, n, c, rho0 = geo._albers_constants()
    s = f"sin(radians({lat}))"
    qq = f"({1 - e * e!r} * ({s} / (1 - {e * e!r} * {s} * {s}) - ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / {2 * e!r}))"
    rho = f"({geo.WGS84_A!r} * sqrt({c!r} - {n!r} * {qq}) / {n!r})"
    th = f"({n!r} * radians({lon} - 25.0))"
    return f"({rho} * sin({th}))", f"({rho0!r} - {rho} * cos({th}))"


_P = [("LONGNUM", "LATNUM"), ("(LONGNUM + 0.5)", "LATNUM"), ("(LONGNUM + 0.5)", "(LATNUM + 0.25)"), ("LONGNUM", "(LATNUM + 0.25)")]
_XY = [_albers_sql(la, lo) for lo, la in _P]


@query(
    "equal_area_polygons",
    ["SF-28"],
    f"""{oracle_views('clusters')}, p AS (SELECT cluster, """
    + ", ".join(f"{x} AS x{i}, {y} AS y{i}" for i, (x, y) in enumerate(_XY))
    + f""" FROM clusters) SELECT cluster, {r("abs(" + " + ".join(f"(x{i} * y{(i + 1) % 4} - x{(i + 1) % 4} * y{i})" for i in range(4)) + ") / 2 / 1e6", 2)} AS km2 FROM p""",
)
def equal_area_polygons(t: Tables):
    return rounded(_rings(t).select("cluster", (geo.ring_area(geo.project_ring(F.col("ring"))) / 1e6).alias("km2")), 2)


@query(
    "scaled_columns",
    ["SF-29"],
    f"""WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders)
        SELECT o_orderkey, {r('(o_totalprice - lo) / (hi - lo)', 9)} AS unit, {r('(o_totalprice - m) / sd', 9)} AS z, -o_totalprice AS flipped FROM orders, s""",
)
def scaled_columns(t: Tables):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    rows = tf.z_score(tf.min_max(rows, "o_totalprice", "unit"), "o_totalprice", "z")
    return rounded(rows.select("o_orderkey", F.round("unit", 9).alias("unit"), F.round("z", 9).alias("z"), (-F.col("o_totalprice")).alias("flipped")), 9)


@query("box_cox_round_trip", ["SF-29"], f"SELECT c_custkey, {r('c_acctbal', 3)} AS back FROM customer")
def box_cox_round_trip(t: Tables):
    """Box-Cox with fitted power and Z scaling, and back again."""
    s = tf.fit_scaling(t.customer, "c_acctbal", "boxcox", "Z")
    return rounded(t.customer.select("c_custkey", s.invert(s.apply(F.col("c_acctbal"))).alias("back")), 3)


@query(
    "numbers_as_keys",
    ["SF-30"],
    """WITH d AS (SELECT DISTINCT p_brand, p_size % 9 AS x FROM part), k AS (SELECT p_brand, x, x IN (1, 2, 3, 4, 5) AS hit FROM d),
        s AS (SELECT p_brand, count(*) FILTER (hit) AS f, count(*) FILTER (NOT hit) AS m FROM k GROUP BY p_brand)
        SELECT p_brand, f AS found, m AS missing, CASE WHEN m = 0 AND f > 0 THEN 'True' WHEN m = 0 THEN 'False' WHEN m <= 2 AND f > 0 THEN 'Maybe' ELSE 'False' END AS decision FROM s""",
)
def numbers_as_keys(t: Tables):
    from surveyspark.operators.dictionary import numbers_as_keys as decide

    rows = t.part.select(F.col("p_brand").alias("column"), (F.col("p_size") % 9).cast("string").alias("value"))
    brands = t.part.select(F.col("p_brand").alias("column")).distinct()
    keys = brands.select("column", F.explode(F.array(*[F.lit(float(i)) for i in range(1, 6)])).alias("key")).withColumn("label", F.lit("x"))
    return decide(rows, keys).select(F.col("column").alias("p_brand"), "found", "missing", "decision")


@query(
    "yes_no_direction",
    ["SF-31"],
    f"""{oracle_views('households')}, s AS (SELECT adm1_name AS c, count(*) FILTER (radio IN ('0', '1')) AS n, count(*) FILTER (radio IN ('yes', 'no')) AS x,
        bool_or(radio = '0') AND bool_or(radio = '1') AS both_numbers, bool_or(radio = 'yes') AS yes, bool_or(radio = 'no') AS no, count(*) AS a FROM households GROUP BY ALL),
        d AS (SELECT *, n * 1.0 / a > x * 1.0 / a AS to_number FROM s WHERE both_numbers AND yes)
        SELECT c AS "column", 'yes' AS "from", '1' AS "to" FROM d WHERE to_number UNION ALL SELECT c, 'no', '0' FROM d WHERE to_number AND no
        UNION ALL SELECT c, '1', 'yes' FROM d WHERE NOT to_number UNION ALL SELECT c, '0', 'no' FROM d WHERE NOT to_number""",
)
def yes_no_direction(t: Tables):
    from surveyspark.operators.dictionary import yes_no_mapping

    return yes_no_mapping(t.households.select(F.col("adm1_name").alias("column"), F.col("radio").alias("value")))


@query(
    "mapped_answers",
    ["SF-32"],
    f"""{oracle_views('households')}, m AS (SELECT household, CASE source WHEN 'sachet water' THEN 'bottled water' WHEN 'bottled water' THEN 'bottled water'
          WHEN 'spring' THEN 'unprotected spring' WHEN 'other' THEN 'don''t know' ELSE source END AS source FROM households)
        SELECT household, CASE WHEN source = 'don''t know' AND (SELECT avg(CASE WHEN source = 'don''t know' THEN 100.0 ELSE 0 END) FROM m) < 5 THEN NULL ELSE source END AS source FROM m""",
)
def mapped_answers(t: Tables):
    steps = t.spark.createDataFrame(
        [("source", 1, "sachet water", "bag water"), ("source", 2, "bag water", "bottled water"), ("source", 1, "spring", "unprotected spring"),
         ("source", 2, "other", "don't know")],
        "column string, step int, from string, to string",
    )
    rows = rc.apply_mapping(t.households.select("household", "source"), steps, ["source"], 2)
    return rc.drop_rare_answer(rows, ["source"], below_percent=5.0)


@query(
    "label_codes",
    ["SF-33"],
    f"""{oracle_views('households')}, n AS (SELECT source AS category, count(*) AS n FROM households WHERE source IS NOT NULL GROUP BY ALL),
        k AS (SELECT *, n * 1.0 / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, category) - 1 AS rank FROM n)
        SELECT category, n, {r('share')} AS share, CASE WHEN share > 0.04 THEN rank END AS code, CASE WHEN share > 0.04 THEN category ELSE 'other' END AS target FROM k""",
)
def label_codes(t: Tables):
    from surveyspark.operators.models import label_codes as codes

    return rounded(codes(t.households, "source", 0.04, to_other=True))


@query(
    "household_ratios",
    ["SF-34"],
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round((o_orderkey % 7) / (o_orderkey % 5), 6) END AS rooms,
       CASE o_orderstatus WHEN 'O' THEN 0 ELSE 1 END AS urban, CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 3 ELSE o_orderkey % 2 END AS phone FROM orders""",
)
def household_ratios(t: Tables):
    k = F.col("o_orderkey")
    rows = t.orders.select(
        "o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") != "P", k % 2).alias("PHONE"), (k % 3).alias("CELLPHONE")
    )
    out = rc.phone_or_cellphone(rows, ["o_orderstatus"])
    return rounded(
        out.select(
            "o_orderkey", rc.rooms_per_person(k % 7, k % 5).alias("rooms"),
            rc.urban_flag(F.when(F.col("o_orderstatus") == "O", "U").otherwise("R")).alias("urban"), F.col("PHONE").alias("phone"),
        )
    )


@query("answer_word_similarity", ["SF-12"])
def answer_word_similarity(t: Tables):
    """Part names of a brand compared with the brand's most common name, word by word."""
    from surveyspark.functions.similarity import answer_similarity
    from surveyspark.operators.aggregates import majority

    vecs = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).select(F.map_from_entries(F.collect_list(F.struct("label", "v"))).alias("m"))
    top = majority(t.part, ["p_brand"], "p_name").select("p_brand", F.col("p_name_max").alias("top"))
    rows = t.part.select("p_brand", "p_name").distinct().join(top, "p_brand").withColumn("m", vecs.scalar())

    def words(c):
        return F.split(c, " ")

    def vectors(c):
        return F.transform(words(c), lambda w: F.try_element_at(F.col("m"), F.pmod(F.length(w), F.lit(10))))

    s = answer_similarity(
        words(F.col("p_name")), words(F.col("top")), vectors(F.col("p_name")), vectors(F.col("top")),
        F.try_element_at("m", F.lit(0)), F.try_element_at("m", F.lit(0)),
    )
    return rounded(rows.withColumn("s", s).select("p_brand", "p_name", "top", F.col("s.score").alias("score"), F.col("s.matched").alias("matched")))
