"""Recoding rules held as data and turned into column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


@dataclass(frozen=True)
class Rule:
    """First rule that holds gives ``result``; ``result`` None keeps the text.

    ``every``: all of these parts occur; ``some``: at least one occurs; ``exact``: the
    whole text is one of these.
    """

    result: str | None
    every: Sequence[str] = ()
    some: Sequence[str] = ()
    exact: Sequence[str] = ()

    def holds(self, c: Column) -> Column:
        cond = F.lit(True)
        for part in self.every:
            cond = cond & F.contains(c, F.lit(part))
        either = F.lit(False)
        for part in self.some:
            either = either | F.contains(c, F.lit(part))
        if self.exact:
            either = either | c.isin(list(self.exact))
        return cond & either if (self.some or self.exact) else cond


# --- Fixed values: rules for sources of drinking water, tried from top to bottom ----------
SIMPLIFY = [
    Rule("unprotected well", every=["unprotected", "well"]),
    Rule("unprotected spring", every=["unprotected", "spring"]),
    Rule("protected well", every=["protected", "well"]),
    Rule("protected spring", every=["protected", "spring"]),
    Rule("unprotected well", every=["open", "well"]),
    Rule("sachet", some=["sachet", "bag water", "water in plastic bag"]),
    Rule("bottled", some=["bottled"]),
    Rule("tube well or borehole", some=["borehole"]),
    Rule("street vendor", some=["truck", "cart", "vendor", "tanker", "bicycle", "motorcycle"]),
    Rule("surface water", some=["river", "gravity flow scheme", "dam", "pond"]),
    Rule(
        "piped to neighbor",
        some=[
            "neighbor's tap", "piped to neighbour's house", "piped from the neighbor",
            "neighbour's tap", "private tap/neighbor", "neighbor's house",
        ],
    ),
    Rule("other", some=["neighborhood"]),
    Rule("unprotected spring", exact=["spring"]),
    Rule("other", some=["public fountain"]),
    Rule(None),
]
_WELLS = ["unprotected well", "protected well"]
_TAP = ["public tap/standpipe"]
_TAIL = [
    Rule("surface water", some=["surface water"]),
    Rule("bottled", some=["bottled", "sachet"]),
    Rule("street vendor", some=["street vendor"]),
    Rule("other"),
]
_GROUND = [
    Rule("groundwater", some=["tube well or borehole"]),
    Rule("groundwater", exact=_WELLS),
    Rule("groundwater", some=["spring"]),
]
CATEGORY_SCHEMES: dict[str, list[Rule]] = {
    "type": [
        Rule("tube well or borehole", some=["tube well or borehole"]),
        Rule("well", exact=_WELLS),
        Rule("spring", some=["spring"]),
        Rule("piped", some=["piped"], exact=_TAP),
        *_TAIL,
    ],
    "urban": [*_GROUND, Rule("piped", some=["piped"], exact=_TAP), *_TAIL],
    "piped1": [
        *_GROUND,
        Rule("piped into dwelling", exact=["piped into dwelling"]),
        Rule("other piped", some=["piped"], exact=_TAP),
        *_TAIL,
    ],
    "piped2": [*_GROUND, Rule(None, some=["pipe"]), *_TAIL],
    "piped3": [
        *_GROUND,
        Rule(None, exact=["piped into dwelling", "piped to yard/plot"]),
        Rule("piped (public/neighbor)", some=["pipe"]),
        *_TAIL,
    ],
}
SOURCE_WEIGHTS: dict[str, tuple[int, str]] = {
    "tube well or borehole": (2, "elementary"),
    "public tap/standpipe": (3, "basic"),
    "unprotected well": (2, "elementary"),
    "protected well": (3, "basic"),
    "piped to yard/plot": (4, "improved"),
    "unprotected spring": (2, "elementary"),
    "protected spring": (3, "basic"),
    "piped into dwelling": (5, "improved"),
    "piped to neighbor": (3, "improved"),
    "sachet": (5, "improved"),
    "street vendor": (2, "basic"),
    "rainwater": (1, "elementary"),
    "bottled": (5, "improved"),
    "other": (1, "elementary"),
    "surface water": (1, "elementary"),
}
ON_PLOT_SOURCES = [
    "piped to yard/plot", "protected well", "unprotected well", "tube well or borehole", "piped to neighbor",
]
ELSEWHERE_SOURCES = [
    "public tap/standpipe", "stream", "sachet", "street vendor", "bottled", "piped to neighbor",
    "rainwater", "surface water", "protected spring", "unprotected spring",
]
LOCATION_PENALTY = {"in own dwelling": 0, "in own yard/plot": 5, "elsewhere": 10}
LOCATION_WEIGHT = {"in own dwelling": 5, "in own yard/plot": 3, "elsewhere": 1}
TIME_CAP = 310.0
DISTANCE_LIMITS = [-1, 0, 5, 15, 30, 60, 120, 999]
DISTANCE_LIMITS_SHORT = [-1, 5, 15, 30, 60, 120, 999]
NO_TOILET = "no facility/bush/field"
NOT_OBSERVED = ["not observed: not in dwelling", "not observed other"]
LIVESTOCK_COLUMNS = [
    "owns goats", "owns horses/ donkeys/ mules", "owns cows/ bulls", "owns chickens/poultry", "owns sheep",
]
HAND_WASHING_COLUMNS = [
    "presence of water at hand washing place", "items present: soap or detergent",
    "items present: ash, mud, sand", "items present: none",
]
COARSE_SOURCES: dict[str, list[str]] = {
    "piped": [
        "Piped into dwelling", "Piped to yard/plot", "Piped to neighbour's house", "Piped to neighbor",
        "Public fountain", "Public tap/standpipe", "Piped from the neighbor", "Public to neighborhood",
        "Neighbour's tap", "Neighbor's house",
    ],
    "groundwater": [
        "Tube well or borehole", "Hand pump / Tube well or borehole", "Borehole in yard/plot",
        "Public borehole", "Borehole with pump", "Protected well", "Unprotected well",
        "Protected spring", "Unprotected spring",
    ],
    "surface water": [
        "Lake/pond/river/channel/irrigation channel",
        "River/dam/lake/ponds/stream/canal/irrigation channel", "Gravity flow scheme",
    ],
    "rain": ["Rainwater"],
    "external source": [
        "Tanker truck", "Cart with small tank", "Vendor", "Motorcycle with three wheels",
        "Bicycle with jerrycans",
    ],
    "bottled water": [
        "Bottled water", "Bottled water or sachets", "Water sachets", "Bag water",
        "Sachet water (in a bag)", "Sachet", "Water in plastic bag", "Water in sachet",
        "Sachet water", "Mineral water in sachet",
    ],
}
# ----------------------------------------------------------------------------------------


def cascade(col: Column | str, rules: Sequence[Rule]) -> Column:
    """Result of the first rule that holds; null text stays null."""
    c = _c(col)
    chain = None
    for r in rules:
        out = c if r.result is None else F.lit(r.result)
        chain = F.when(r.holds(c), out) if chain is None else chain.when(r.holds(c), out)
    return F.when(c.isNotNull(), chain)


def simplify_source(col: Column | str) -> Column:
    return cascade(col, SIMPLIFY)


def source_category(col: Column | str, scheme: str) -> Column:
    return cascade(col, CATEGORY_SCHEMES[scheme])


def lookup(col: Column | str, mapping: Mapping, default: Column | None = None) -> Column:
    """Value of a small fixed mapping; without a hit the default."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    hit = F.try_element_at(pairs, _c(col))
    return hit if default is None else F.coalesce(hit, default)


def source_weight(col: Column | str) -> Column:
    return lookup(col, {k: v[0] for k, v in SOURCE_WEIGHTS.items()})


def source_class(col: Column | str) -> Column:
    return lookup(col, {k: v[1] for k, v in SOURCE_WEIGHTS.items()}, _c(col))


def fetch_time(time: Column | str, source: Column | str) -> Column:
    """Minutes to the source; ``on premises`` and missing values by kind of source."""
    t, s = _c(time), _c(source)
    return (
        F.when(t.isNull(), F.when(s == "piped into dwelling", 0.0).when(s == "piped to yard/plot", 1.0))
        .when(
            t == "on premises",
            F.when(s.isin(ON_PLOT_SOURCES), 1.0).when(s == "piped into dwelling", 0.0).otherwise(5.0),
        )
        .otherwise(t.try_cast("double"))
    )


def source_location(location: Column | str, source: Column | str, time: Column | str) -> Column:
    """Place of the source; missing places by kind of source, then by filled time."""
    loc, s, t = _c(location), _c(source), _c(time)
    return F.coalesce(
        loc,
        F.when(s == "piped into dwelling", "in own dwelling")
        .when(s == "piped to yard/plot", "in own yard/plot")
        .when(s.isin(ELSEWHERE_SOURCES), "elsewhere")
        .when(t == 0, "in own yard/plot")
        .when(t >= 3, "elsewhere"),
    )


def fill_water_answers(
    df: DataFrame,
    source: str = "source of drinking water",
    location: str = "location of source for water",
    time: str = "time to get to water source (minutes)",
) -> DataFrame:
    """Fill a missing place from the source text and time, then a missing time from the place."""
    s, loc, t = F.col(f"`{source}`"), F.col(f"`{location}`"), F.col(f"`{time}`").cast("double")

    def mentions(words: Sequence[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(s, F.lit(w))
        return out

    by_text = (
        F.when(mentions(["neighbor", "public", "water seller", "sachet water", "river"]), "elsewhere")
        .when(mentions(["yard", "plot", "courtyard", "compound"]), "in own yard/plot")
        .when(mentions(["dwelling", "residence"]), "in own dwelling")
    )
    by_time = F.when(t > 1, "elsewhere").when(t <= 1, "in own yard/plot")
    touched = s.isNotNull() & (loc.isNull() | t.isNull())
    new_loc = F.when(touched, F.coalesce(loc, by_text, by_time, F.lit("in own yard/plot"))).otherwise(loc)
    by_time_only = loc.isNull() & by_text.isNull() & (t == 0)
    new_time = F.when(touched & by_time_only, F.lit(1.0)).when(
        touched & t.isNull(), F.when(new_loc == "in own dwelling", 0.0).when(new_loc == "in own yard/plot", 1.0)
    ).otherwise(t)
    return df.withColumns({location: new_loc, time: new_time})


@dataclass(frozen=True)
class Fill:
    """Set ``target`` to ``value`` where ``column`` is one of ``values``; optionally only where missing."""

    target: str
    value: object
    column: str
    values: Sequence[object]
    only_missing: bool = False
    otherwise: object | None = None


def _skip_patterns() -> list[Fill]:
    toilet = "type of toilet facility"
    rules = [
        Fill("share toilet with other households", "not applicable", toilet, [NO_TOILET]),
        Fill("number of households sharing toilet", "0.0", "share toilet with other households", ["no"]),
        Fill("number of households sharing toilet", "10.0", toilet, [NO_TOILET]),
        Fill(
            "number of households sharing toilet: applicable", "not applicable", toilet, [NO_TOILET],
            otherwise="applicable",
        ),
        Fill("location of toilet facility", "elsewhere", toilet, [NO_TOILET], only_missing=True),
        Fill(
            "household has separate room used as kitchen", "not applicable",
            "food cooked in the house/ separate building/ outdoors", ["in a seperate building", "outdoors"],
        ),
    ]
    rules += [
        Fill(c, "0.0", "owns livestock, herds or farm animals", ["no"], only_missing=True)
        for c in LIVESTOCK_COLUMNS
    ]
    rules.append(
        Fill(
            "hectares of agricultural land (1 decimal)", "0.0", "owns land usable for agriculture", ["no"],
            only_missing=True,
        )
    )
    rules += [
        Fill(c, "not applicable", "place where household members wash their hands", NOT_OBSERVED, only_missing=True)
        for c in HAND_WASHING_COLUMNS
    ]
    return rules


SKIP_PATTERNS = _skip_patterns()


def apply_fills(df: DataFrame, rules: Sequence[Fill] = SKIP_PATTERNS) -> DataFrame:
    """Apply fill rules in order; rules on columns the table lacks are left out."""
    have = set(df.columns)
    for r in rules:
        if r.column not in have or (r.target not in have and r.otherwise is None):
            continue
        hit = F.col(f"`{r.column}`").isin(list(r.values))
        old = F.col(f"`{r.target}`") if r.target in have else F.lit(r.otherwise)
        if r.otherwise is not None:
            old = F.lit(r.otherwise)
        if r.only_missing:
            hit = hit & old.isNull()
        df = df.withColumn(r.target, F.when(hit, F.lit(r.value)).otherwise(old))
        have.add(r.target)
    return df


def with_penalty(time: Column | str, location: Column | str) -> tuple[Column, Column]:
    """Time plus penalty of the place, plain and capped."""
    total = _c(time) + lookup(location, LOCATION_PENALTY)
    return total, F.when(total < TIME_CAP, total).when(total.isNotNull(), F.lit(TIME_CAP))


def inclusive_buckets(
    col: Column | str, limits: Sequence[int], half_open: bool = False
) -> tuple[Column, Column]:
    """Label ``from - to mins`` and negative rank of the bucket holding the value.

    Buckets run from one above a limit to the next limit, both ends included, so values
    between whole numbers fall into no bucket; ``half_open`` closes these gaps.
    """
    c = _c(col)
    label = rank = None
    for nr, (lo, hi) in enumerate(zip(limits[:-1], limits[1:])):
        inside = ((c > lo) & (c <= hi)) if half_open else c.between(lo + 1, hi)
        text, value = F.lit(f"{lo + 1} - {hi} mins"), F.lit(-nr)
        label = F.when(inside, text) if label is None else label.when(inside, text)
        rank = F.when(inside, value) if rank is None else rank.when(inside, value)
    return label, rank


def rooms_per_person(bedrooms: Column | str, members: Column | str) -> Column:
    return F.try_divide(_c(bedrooms), _c(members))


def urban_flag(code: Column | str) -> Column:
    """0 for urban (1 or U), 1 for rural (2 or R)."""
    c = _c(code).cast("string")
    return F.when(c.isin("1", "U"), 0).when(c.isin("2", "R"), 1).otherwise(c.try_cast("int"))


def phone_or_cellphone(df: DataFrame, keys: Sequence[str], phone: str = "PHONE", cell: str = "CELLPHONE") -> DataFrame:
    """Surveys without any answer on phones take the answer on cell phones."""
    known = df.groupBy(*keys).agg(F.count(phone).alias("__known"))
    return (
        df.join(known, list(keys))
        .withColumn(phone, F.when(F.col("__known") == 0, F.col(cell)).otherwise(F.col(phone)))
        .drop("__known")
    )


def apply_mapping(df: DataFrame, mapping: DataFrame, cols: Sequence[str], steps: int) -> DataFrame:
    """Apply a long mapping table (column, step, from, to) to answer columns, step after step.

    The steps run on the distinct answers of a column; the data itself is joined once per
    column, with the resolved answer. Answers without a mapping stay as they are.
    """
    for c in cols:
        ref = F.col(f"`{c}`").cast("string")
        known = df.select(ref.alias("__from")).distinct().withColumn("__to", F.col("__from"))
        for step in range(1, steps + 1):
            part = mapping.filter((F.col("column") == c) & (F.col("step") == step)).select(
                F.col("from").alias("__old"), F.col("to").alias("__new")
            )
            known = known.join(part, F.col("__to") == F.col("__old"), "left").select(
                "__from", F.when(F.col("__old").isNotNull(), F.col("__new")).otherwise(F.col("__to")).alias("__to")
            )
        df = (
            df.join(known, ref.eqNullSafe(F.col("__from")), "left")
            .withColumn(c, F.col("__to"))
            .drop("__from", "__to")
        )
    return df


def drop_rare_answer(df: DataFrame, cols: Sequence[str], answer: str = "don't know", below_percent: float = 1.0) -> DataFrame:
    """Null out an answer where it makes up less than a share of all rows of its column."""
    shares = df.agg(
        F.array(
            *[F.sum(F.when(F.col(f"`{c}`") == answer, 1).otherwise(0)) / F.count(F.lit(1)) * 100 for c in cols]
        ).alias("shares")
    ).scalar()
    out = {}
    for i, c in enumerate(cols):
        rare = shares[i] < below_percent
        out[c] = F.when((F.col(f"`{c}`") == answer) & rare, F.lit(None)).otherwise(F.col(f"`{c}`"))
    return df.withColumns(out)
