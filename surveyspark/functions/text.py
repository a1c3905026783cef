"""Text rules on labels and answers, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------
NULL_TOKENS = ["nan", ""]
PUNCTUATION = r"""[!"#$%&'()*+\-./:;<=>?@\[\\\]^_`{|}~,]"""
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "if", "is", "it", "of", "as", "s",
    "own", "owns", "has", "by", "for", "goods", "do", "does", "did",
    "have", "had", "can", "could", "will", "would", "shall", "should", "may", "might",
    "that", "those", "these", "this",
    "at", "on", "from", "between", "be", "been", "being",
    "household", "hh", "hhousehold", "househ",
    "na", "de", "usable", "how", "many", "members", "member", "cs",
]
NEGATION_WORDS = [
    "no", "non", "not", "any", "don't", "doesn't", "didn't", "won't", "wouldn't", "couldn't",
    "shouldn't", "can't", "cannot", "public", "outside", "yard", "plot", "elsewhere", "elswhere",
    "other", "compound",
]
QUANTITY_PHRASES = ["+", "more than ", "less than ", " and more", " or more", " and less", " or less"]
KILOMETRE_WORDS = ["km", "kilometer", "kilometre", "kms", "kilometers", "kilometres"]
MINUTE_WORDS = ["minute", "minutes", "min"]
ZERO_WORDS = ["no", "non", "not", "none", "noe"]
# ----------------------------------------------------------------------------------------

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def null_tokens(col: Column | str) -> Column:
    """Blank text and the text ``nan`` count as missing."""
    c = _c(col)
    return F.when(~F.trim(c).isin(NULL_TOKENS), c)


def as_number(col: Column | str) -> Column:
    """Number written in the text, else null."""
    c = _c(col).cast("string")
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def as_text_remainder(col: Column | str) -> Column:
    """The text where it is not a number, else null."""
    c = _c(col).cast("string")
    return F.when(~c.rlike(NUMBER), c)


def drop_brackets(col: Column | str) -> Column:
    """Cut from the first opening to the last closing bracket, round then square."""
    text = c = _c(col)
    for o, e in ((r"\(", r"\)"), (r"\[", r"\]")):
        # only closed before it is opened: what stands between belongs to the head and to the tail
        c = F.regexp_replace(c, rf"(?s)^(?=[^{o}]*+{o}[^{e}]*+$)([^{o}]*{e})([^{o}{e}]*+)({o}[^{e}]*+)$", "$1$2$2$3")
        c = F.regexp_replace(c, rf"(?s)^([^{o}]*+){o}.*{e}([^{e}]*+)$", "$1$2")
    return F.when(F.contains(text, F.lit("(")) | F.contains(text, F.lit("[")), c).otherwise(text)


def after_separator(col: Column | str) -> Column:
    """Text after the first ``': '``, or else after the first ``' - '``."""
    return F.regexp_replace(_c(col), r"(?s)^(?:.*?: |.*? - )", "")


def normalise_label(col: Column | str, brackets: bool = True, question: bool = False) -> Column:
    """Comparable form of a label: no brackets, no punctuation, single blanks, contractions rejoined."""
    c = _c(col)
    if brackets:
        c = drop_brackets(c)
    if question:
        c = after_separator(c)
    c = F.regexp_replace(c, PUNCTUATION, " ")
    c = F.regexp_replace(c, r"\s+", " ")
    c = F.regexp_replace(c, r" $", "")
    return F.regexp_replace(c, r"(^| )(don|won|can) t($|(?= ))", "$1$2't")


def remove_stop_words(col: Column | str, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Drop stop words and repeated words, keeping order; text of stop words only stays as it is."""
    c = _c(col)
    words = F.array_distinct(F.array_except(F.split(c, " "), F.array(*[F.lit(w) for w in stop_words])))
    some = F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), lambda w: F.array_join(w, " "))
    return F.when(F.contains(c, F.lit(" ")), F.coalesce(F.get(some, 0), c)).otherwise(c)


def answer_text(col: Column | str) -> Column:
    """Answer of ``key: answer``; text without a key is the answer itself."""
    c = _c(col)
    return F.when(F.contains(c, F.lit(": ")), F.regexp_extract(c, r"(?s)^.*?: (.*)$", 1)).otherwise(c)


def answer_key(col: Column | str) -> Column:
    """Key of ``key: answer``; text without a key is its own key."""
    return F.substring_index(_c(col), ": ", 1)


def is_negated(col: Column | str, words: Sequence[str] = NEGATION_WORDS) -> Column:
    return F.arrays_overlap(F.split(_c(col), " "), F.array(*[F.lit(w) for w in words]))


def _mentions(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def quantity_answer(answer: Column | str, question: Column | str) -> Column:
    """Number meant by answers such as ``95 or more`` or ``more than 2 years``.

    The words left beside the number must agree with the unit in the question; years are
    turned into months when the question asks for months. Null where no rule applies.
    """
    a, q = _c(answer), _c(question)
    found = _mentions(a, QUANTITY_PHRASES)
    for phrase in QUANTITY_PHRASES:
        a = F.replace(a, F.lit(phrase), F.lit(""))
    tokens = F.filter(F.split(F.regexp_replace(a, "[+,]", ""), " "), lambda t: t != "")

    def token_number(t: Column) -> Column:
        return F.when(t == "one", F.lit(1.0)).when(t == "two", F.lit(2.0)).otherwise(as_number(t))

    numbers = F.filter(F.transform(tokens, token_number), lambda x: x.isNotNull())
    number = F.when(F.size(numbers) > 0, F.try_element_at(numbers, F.lit(-1)))
    rest = F.array_join(F.filter(tokens, lambda t: token_number(t).isNull()), " ")
    foreign = (rest != "") & ~F.contains(q, rest)
    kept = (
        F.when(
            foreign,
            F.when(
                (_mentions(rest, KILOMETRE_WORDS) & _mentions(q, KILOMETRE_WORDS))
                | (_mentions(rest, MINUTE_WORDS) & _mentions(q, MINUTE_WORDS)),
                number,
            ).when(F.contains(rest, F.lit("year")) & F.contains(q, F.lit("month")), number * 12),
        )
        .when(F.contains(rest, F.lit("visits")), F.lit(None).cast("double"))
        .otherwise(number)
    )
    return F.when(found, kept)


def numeric_answer(
    answer: Column | str, question: Column | str, column_has_numbers: Column, column_has_yes: Column
) -> Column:
    """Number for a text answer of a column that also holds numbers, else null."""
    a = F.regexp_replace(_c(answer), "^ | $", "")
    none_like = F.contains(a, F.lit("none")) | F.contains(a, F.lit("noe")) | a.isin(ZERO_WORDS)
    value = (
        F.when(as_number(a).isNotNull(), as_number(a))
        .when(none_like & ~column_has_yes, F.lit(0.0))
        .otherwise(quantity_answer(a, question))
    )
    return F.when(column_has_numbers & (a != ""), value)


def repair_known_issue(answer: Column | str) -> Column:
    """Repaired text for known spellings of "don't know" and stray characters, else null."""
    a = _c(answer)
    chain = F.when(a.isin("dk", "unknow", "unknown"), F.lit("don't know"))
    # Character rests of encoding errors, tried in this order.
    for rest in ("..ue ", "..le ", "..", "ÿû ", "ÿ"):
        chain = chain.when(F.contains(a, F.lit(rest)), F.replace(a, F.lit(rest), F.lit("")))
    return chain


def autocorrect(answers: DataFrame) -> DataFrame:
    """Corrections for the answers of every column.

    ``answers``: column, answer (``key: answer`` text), position (order inside the
    column), has_numbers. Result: column, answer, key, text, corrected (only rows that change).
    An empty answer takes the first answer of the same key, or else the key itself.
    """
    split = answers.withColumns(
        {
            "key": answer_key("answer"),
            "text": F.when(F.contains(F.col("answer"), F.lit(": ")), answer_text("answer")),
        }
    ).withColumn("key_norm", F.coalesce(as_number("key").cast("string"), F.col("key")))
    per_key = split.groupBy("column", "key_norm").agg(
        F.min_by(F.coalesce("text", F.lit("")), "position").alias("first_text")
    )
    per_column = split.groupBy("column").agg(F.max(F.contains(F.col("answer"), F.lit("yes"))).alias("has_yes"))
    joined = split.join(per_key, ["column", "key_norm"]).join(per_column, "column")
    blank = F.coalesce(F.col("text"), F.lit("")) == ""
    text = F.when(blank, F.col("key_norm")).otherwise(F.col("text"))
    filled = F.when(blank & (F.col("first_text") != ""), F.col("first_text"))
    number = numeric_answer(text, F.col("column"), F.col("has_numbers"), F.col("has_yes"))
    key_number = F.when(blank, as_number("key"))
    corrected = F.coalesce(
        filled, key_number.cast("string"), number.cast("string"), repair_known_issue(text)
    )
    return joined.select("column", "answer", "key", text.alias("text"), corrected.alias("corrected")).filter(
        F.col("corrected").isNotNull()
    )


def truncate_decimal(col: Column | str, digits: int) -> Column:
    """Text of a number cut after ``digits`` decimals without rounding.

    Numbers so small that their shortest text has an exponent are rounded instead.
    """
    c = _c(col).cast("double")
    plain = c.cast("string").try_cast("decimal(38,18)").cast("string")
    cut = F.regexp_extract(plain, r"^(-?[0-9]+\.[0-9]{%d})" % digits, 1)
    tiny = (F.abs(c) < 1e-4) & (c != 0)
    return F.when(tiny, F.format_string(f"%.{digits}f", c)).otherwise(cut)


def sanitise_file_name(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), r"[^\p{L}\p{N}_\-.]", "_")


def replace_last(col: Column | str, old: str, new: str) -> Column:
    """Replace the last occurrence of ``old``."""
    c = _c(col)
    head = F.substring_index(c, old, -1)
    cut = F.substring(c, F.lit(1), F.length(c) - F.length(head) - F.lit(len(old)))
    return F.when(F.contains(c, F.lit(old)), F.concat(cut, F.lit(new), head)).otherwise(c)


def tile_coordinates(name: Column | str) -> tuple[Column, Column]:
    """Latitude and longitude texts of ``lat_lon_…`` tile names."""
    c = _c(name)
    return F.split_part(c, F.lit("_"), F.lit(1)), F.split_part(c, F.lit("_"), F.lit(2))


def tile_survey_cluster(name: Column | str) -> tuple[Column, Column]:
    """Survey prefix and cluster number of names such as ``BFGE71FL00000203.tif``."""
    stem = F.regexp_replace(_c(name), r"\.[^.]*$", "")
    survey = F.regexp_extract(stem, r"^(.*[A-Za-z])[^A-Za-z]*$", 1)
    digits = F.regexp_extract(stem, r"([0-9]*)$", 1)
    return survey, F.coalesce(digits.try_cast("bigint"), F.lit(0))


def tile_name(lat: Column, lon: Column, period: Column, iso3: Column, urban: Column) -> Column:
    """``lat_lon_begin-end_ISO_u/r_side`` with coordinates cut to four decimals."""
    kind = F.when(urban, F.lit("u")).otherwise(F.lit("r"))
    side = F.when(urban, F.lit("2.0")).otherwise(F.lit("10.0"))
    return F.concat_ws("_", truncate_decimal(lat, 4), truncate_decimal(lon, 4), period, iso3, kind, side)


def closeness(a: Column | str, b: Column | str) -> Column:
    """Edit similarity in [0, 1]: one minus edit distance over the longer length."""
    x, y = _c(a), _c(b)
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longer)


def close_match(a: Column | str, b: Column | str, at_least: float = 0.6) -> Column:
    return closeness(a, b) >= at_least


# --- Fixed values: country names that differ from the code table, codes in reports ---------
ISO3_SPECIAL = {
    "Democratic Republic of Congo": "COD", "Cote d'Ivoire": "CIV", "Burkina Faso": "BFA", "Sierra Leone": "SLE", "Tanzania": "TZA",
}
REPORT_ISO3 = {
    "CD": "COD", "ET": "ETH", "KE": "KEN", "MW": "MWI", "MZ": "MOZ", "RW": "RWA", "TZ": "TZA", "UG": "UGA", "ZM": "ZMB", "ZW": "ZWE",
}
REPORT_PERIODS = {
    "kombiniert_2012_2014": "2012–2014", "kombiniert_2015_2015": "2015", "kombiniert_2016_2020": "2016–2020",
}
# ----------------------------------------------------------------------------------------


def with_iso3(df: DataFrame, country: str, codes: DataFrame, out: str = "iso3") -> DataFrame:
    """Three-letter code of a country name: special names first, else the table (name, code)."""
    special = F.create_map(*[F.lit(x) for kv in ISO3_SPECIAL.items() for x in kv])
    name = F.replace(F.col(country), F.lit("_"), F.lit(" "))
    table = codes.select(F.col("name").alias("__name"), F.col("code").alias("__code"))
    joined = df.withColumn("__n", name).join(table, F.col("__n") == F.col("__name"), "left")
    return joined.withColumn(out, F.coalesce(F.try_element_at(special, F.col("__n")), "__code")).drop("__n", "__name", "__code")


def country_names(responses: DataFrame, text: str) -> DataFrame:
    """Country codes and names from the JSON listing of the survey service: code, country."""
    schema = "Data ARRAY<STRUCT<DHS_CountryCode: STRING, CountryName: STRING>>"
    items = responses.select(F.explode(F.from_json(F.col(text), schema)["Data"]).alias("c"))
    return items.select(F.col("c.DHS_CountryCode").alias("code"), F.replace("c.CountryName", F.lit(" "), F.lit("_")).alias("country"))


def report_label(country_year: Column | str) -> Column:
    """``KE_2014`` to ``KEN 2014``; combined periods to their printed form."""
    c = _c(country_year)
    periods = F.create_map(*[F.lit(x) for kv in REPORT_PERIODS.items() for x in kv])
    codes = F.create_map(*[F.lit(x) for kv in REPORT_ISO3.items() for x in kv])
    iso = F.coalesce(F.try_element_at(codes, F.substring(c, 1, 2)), F.substring(c, 1, 2))
    rest = F.replace(F.substring(c, F.lit(3), F.length(c)), F.lit("_"), F.lit(" "))
    combined = F.concat(F.lit("Kombiniert "), F.replace(F.replace(c, F.lit("kombiniert_"), F.lit("")), F.lit("_"), F.lit("-")))
    return F.coalesce(F.try_element_at(periods, c), F.when(c.startswith("kombiniert"), combined).otherwise(F.concat(iso, rest)))
