"""Quantities recorded in different units: every value comes out in the common unit of its quantity.

A unit is a family (money, ratio, count) and a power of ten. It is told by, in this order:
  field      the unit column, together with scale (null scale = 1)
  predicted  a calibrated tree ensemble, where the unit column is null or names no unit known
  review     neither: the row is kept, unconverted, for a person to decide

The ensemble (random forest) predicts a missing unit from magnitude, source, category (metric), neighbouring fields and
the words around the number in raw_value, never from normalized_value, which is what is to be checked. It is trained on
a bounded sample of labelled rows, of each label and origin as many where it can be, and on the spellings of the unit
words themselves (lexicon rows: each unit with and without its word, over all magnitudes), so that a unit too rare for
the sample is known too and a bare number leaves it undecided. A quarter of all that is held out: on one half of it an
isotonic regression, weighted to the frequencies of the data, turns the forest's vote into the chance of being right,
on the other half the accuracy is measured, so no row that is fitted on is measured on. Predictions of at least the
chance `sure` are converted; an exact check follows: where the words name a unit, a prediction that differs from it goes
to review (`agrees` is false). The words alone convert nothing.

Defined results: a null, empty or numberless raw_value has no value; parentheses around a number mean minus; commas
between digits group thousands; full-width digits and signs count as plain ones; a non-null unit that isn't known goes
the way of a missing one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.session import bounded, cut

# Words for powers of ten, longest first within a language.
POWERS = {
    "万亿": 12, "千亿": 11, "百亿": 10, "十亿": 9, "亿": 8, "千万": 7, "百万": 6, "十万": 5, "万": 4, "千": 3, "百": 2, "十": 1,
    "trillion": 12, "billion": 9, "million": 6, "thousand": 3, "hundred": 2, "tn": 12, "bn": 9, "mn": 6, "k": 3, "m": 6, "b": 9,
}
# Ratio words and the power that turns them into percent.
RATIOS = {
    "个基点": -2, "基点": -2, "basis points": -2, "bps": -2, "bp": -2, "千分之": -1, "permille": -1, "per mille": -1, "‰": -1,
    "百分之": 0, "百分比": 0, "百分点": 0, "percent": 0, "per cent": 0, "pct": 0, "%": 0, "小数": 2, "fraction": 2, "ratio": 2,
}
#: Words for things counted, and for the currency.
COUNTS = ["items", "item", "件", "户", "笔", "张", "人次", "人", "家", "个", "units", "unit"]
MONEY = ["人民币", "cny", "rmb", "yuan", "元", "¥", "￥"]
#: Powers of ten that lead from one unit of a family to its common unit.
COMMON = {"money": -8, "ratio": 0, "count": 0}

_WIDE = "０１２３４５６７８９（）．，－％：　＊−–"
_PLAIN = "0123456789().,-%: *--"
_NUMBER = r"[(]?\s*[-+]?\s*[0-9][0-9,]*(?:[.][0-9]+)?(?:[eE][-+]?[0-9]+)?\s*[)]?"


def folded(text: Column) -> Column:
    """Text with plain digits and signs, for reading numbers and units."""
    return F.translate(text, _WIDE, _PLAIN)


def number(plain: Column) -> Column:
    """The first number of a folded text as double, or null. A number in parentheses is negative."""
    raw = F.regexp_extract(plain, f"({_NUMBER})", 1)
    value = F.regexp_replace(raw, r"[(),+\s]", "").try_cast("double")
    return F.when(F.substring(raw, 1, 1) == "(", F.when(F.endswith(raw, F.lit(")")), -F.abs(value)).otherwise(value)).otherwise(value)


def _any(words) -> str:
    """A pattern for the longest of some words at a place."""
    return "|".join(sorted(words, key=len, reverse=True))


def _map(words: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in words.items() for x in kv))


def read_units(df: DataFrame, words: str, to: str, scale: str | None = None) -> DataFrame:
    """df with the column `to`: struct(family, power) of the unit that the column `words` names, times the column
    `scale`; null if it names none. Units are words (万元, RMB mn, percent, 千件) or codes such as CNY_10K.

    A bare power word (万, 亿, million) is money, the family in which bare powers are written. The steps are columns
    of their own, so that each pattern runs once per row.
    """
    kept = df.columns
    x = df.withColumn("_w", F.lower(F.trim(folded(F.col(words)))))
    x = x.withColumns({
        "_code": F.regexp_extract("_w", r"^(cny|rmb|items?)_([0-9]+)([kmb]?)$", 1),
        "_digits": F.length(F.regexp_extract("_w", r"_([0-9]+)[kmb]?$", 1)),
        "_letter": F.regexp_extract("_w", r"_[0-9]+([kmb])$", 1),
        "_ratio": F.regexp_extract("_w", f"({_any(RATIOS)})", 1),
        "_money": F.regexp_extract("_w", f"({_any(MONEY)})", 1),
        "_count": F.regexp_extract(F.regexp_replace("_w", _any(MONEY), " "), f"({_any(COUNTS)})", 1),
        "_power": F.regexp_extract(F.regexp_replace("_w", _any([*MONEY, "items?", "units?"]), " "), f"({_any(POWERS)})", 1),
        "_rest": F.regexp_replace("_w", _any([*MONEY, *COUNTS, *POWERS]), ""),
    })
    x = x.withColumns({
        "_family": F.when(F.col("_code") != "", F.when(F.col("_code").startswith("item"), "count").otherwise("money"))
        .when(F.col("_ratio") != "", "ratio")
        .when(F.regexp_like("_rest", F.lit(r"[\p{L}\p{N}]")), None)
        .when(F.col("_money") != "", "money")
        .when(F.col("_count") != "", "count")
        .when(F.col("_power") != "", "money"),
        "_base": F.when(F.col("_code") != "", F.col("_digits") - 1 + F.when(F.col("_letter") == "k", 3).when(F.col("_letter") == "m", 6).when(F.col("_letter") == "b", 9).otherwise(0))
        .when(F.col("_ratio") != "", F.element_at(_map(RATIOS), F.col("_ratio")))
        .when(F.col("_power") != "", F.element_at(_map(POWERS), F.col("_power")))
        .otherwise(0),
    })
    if scale:
        x = x.withColumn("_s", F.lower(F.trim(folded(F.col(scale)))))
        x = x.withColumns({"_n": F.regexp_replace("_s", ",", "").try_cast("double"), "_sw": F.regexp_extract("_s", f"({_any(POWERS)})", 1)})
        # A scale is a number (10000, 1e6), a power word or null, which counts as 1; another scale leaves no unit.
        exact = F.log10("_n")
        x = x.withColumn("_sp", F.when(F.col(scale).isNull(), 0).when(F.col("_n") > 0, F.when(F.abs(exact - F.round(exact)) < 1e-9, F.round(exact).cast("int"))).when(F.col("_sw") != "", F.element_at(_map(POWERS), F.col("_sw"))))
    else:
        x = x.withColumn("_sp", F.lit(0))
    power = (F.col("_base") + F.col("_sp")).cast("int")
    out = F.when(F.col("_family").isNotNull() & power.isNotNull(), F.struct(F.col("_family").alias("family"), power.alias("power")))
    return x.select(*kept, out.alias(to))


def in_common(value: Column, family: Column, power: Column) -> Column:
    """A value in the common unit of its family."""
    shift = F.when(family == "money", COMMON["money"]).when(family.isNotNull(), 0)
    return value * F.pow(F.lit(10.0), (power + shift).cast("double"))


@dataclass(frozen=True)
class Bounds:
    """sample: about the most labelled rows that the ensemble is fitted and calibrated on; classes: the most units that
    it tells apart, the most frequent ones (rows of others go to review); the rest is its shape."""

    sample: int = 20_000
    classes: int = 100
    alike: float = 0.75
    bare: float = 0.02
    trees: int = 12
    depth: int = 14
    bins: int = 128
    features: int = 64
    sure: float = 0.9
    seed: int = 7


_TEXTS = ["source_id", "table_id", "metric_code", "metric_name", "entity_code", "period_basis", "value_type", "statistical_scope", "accounting_basis", "sheet_name"]
_FAMILIES = ["money", "ratio", "count"]
_UNIT = "struct<family:string,power:int>"


def _key(*columns: str) -> Column:
    """One text for some nullable text columns, equal only where all of them are."""
    return F.concat_ws("\x01", *(F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in columns))


def _local(df: DataFrame, most: int) -> DataFrame:
    rows = bounded(df, most)
    return df if rows is None else df.sparkSession.createDataFrame(rows, df.schema)


def parsed(facts: DataFrame, most: int = 5_000) -> DataFrame:
    """facts with its number, the unit of its fields and the unit of its words (columns _value, _field, _text)."""
    return _parsed(facts, most)[0]


def _parsed(facts: DataFrame, most: int = 5_000) -> tuple[DataFrame, DataFrame]:
    """(parsed facts, (_field, _text, n): how many rows with a value have each pair of units).

    Units are read once per distinct spelling and come back by join. Up to `most` spellings are fetched and go back as
    a local relation, small enough for Spark to broadcast by its own size check; with more, the join shuffles.
    """
    x = facts.withColumn("_plain", folded(F.col("raw_value")))
    # What is left without the number, marks and blanks.
    bare = F.regexp_replace(F.regexp_replace("_plain", _NUMBER, " "), r"[*#()\s]+", " ")
    x = x.withColumns({"_value": number(F.col("_plain")), "_words": F.trim(bare), "_fk": _key("unit", "scale")}).drop("_plain")
    seen = cut(x.groupBy("_fk", "unit", "scale", "_words").agg(F.count("_value").alias("n")))
    by_field = read_units(seen.select("_fk", "unit", "scale").distinct(), "unit", "_field", "scale").select("_fk", "_field")
    by_words = read_units(seen.select("_words").filter("_words <> ''").distinct(), "_words", "_text").select("_words", "_text")
    by_field, by_words = (_local(y, most) for y in (by_field, by_words))
    both = lambda df: df.join(by_field, "_fk", "left").join(by_words, "_words", "left")
    return both(x).select(*facts.columns, "_value", "_field", "_text"), both(seen).groupBy("_field", "_text").agg(F.sum("n").alias("n"))


class UnitModel:
    """The calibrated ensemble: fit on rows with a known unit, then predict(rows) adds _unit and _chance."""

    def __init__(self, bounds: Bounds = Bounds()):
        self.b = bounds
        self.labels: list[str] = []
        self.forest = self.iso = None
        self.accuracy = self.sure_accuracy = self.sure_share = None

    def _features(self, df: DataFrame) -> DataFrame:
        magnitude = F.when(F.col("_value").isNull() | (F.col("_value") == 0), 0.0).otherwise(F.log10(F.abs(F.col("_value"))))
        plain = {
            "x_magnitude": magnitude,
            "x_negative": (F.coalesce(F.col("_value"), F.lit(0.0)) < 0).cast("double"),
            "x_zero": (F.coalesce(F.col("_value"), F.lit(0.0)) == 0).cast("double"),
            # The words of raw_value; families lie 40 powers apart, so that one number tells family and power.
            **{f"x_{f}": F.coalesce((F.col("_text.family") == f).cast("double"), F.lit(0.0)) for f in _FAMILIES},
            "x_word": F.coalesce(F.col("_text.power") + 40.0 * F.array_position(F.array(*map(F.lit, _FAMILIES)), F.col("_text.family")), F.lit(0.0)),
        }
        x = df.withColumns({**plain, **{f"x_{c}": F.coalesce(F.col(c).cast("string"), F.lit("-")) if c in df.columns else F.lit("-") for c in _TEXTS}})
        hashed = FeatureHasher(inputCols=[f"x_{c}" for c in _TEXTS], outputCol="x_hashed", numFeatures=self.b.features)
        return VectorAssembler(inputCols=[*plain, "x_hashed"], outputCol="x").transform(hashed.transform(x))

    @staticmethod
    def _label() -> Column:
        u = F.coalesce("_field", "_text")
        return F.concat(u["family"], F.lit(":"), u["power"])

    def _lexicon(self, like: DataFrame) -> DataFrame:
        """Rows that spell every unit of the lexicon, with its word and without, over all magnitudes."""
        powers = sorted({0, *POWERS.values()})
        units_ = [("money", p) for p in powers] + [("count", p) for p in powers] + [("ratio", p) for p in sorted(set(RATIOS.values()))]
        rows = [(f"{f}:{p}", (f, p) if told else None, float(10**m), m, told) for f, p in units_ for m in range(-2, 10) for told in (True, False)]
        x = like.sparkSession.createDataFrame(rows, f"_name string, _text {_UNIT}, _value double, m int, told boolean")
        part = F.pmod(F.xxhash64(F.lit(self.b.seed), "_name", "m", "told"), F.lit(8)).cast("int")
        texts = {c: F.lit(None).cast("string") for c in _TEXTS if c in like.columns}
        return x.withColumns({"part": part, "w": F.lit(1.0), "lexicon": F.lit(True), **texts}).drop("m", "told")

    def fit(self, rows: DataFrame, key: str, seen: DataFrame | None = None) -> UnitModel:
        """seen: how many rows have each pair of units (_parsed); counted here if it isn't given."""
        b = self.b
        if seen is None:
            seen = rows.groupBy("_field", "_text").agg(F.count("_value").alias("n"))
        stratum = F.concat(self._label(), F.when(F.col("_field").isNull(), "?").otherwise(""))
        strata = seen.filter("coalesce(_field, _text) is not null and n > 0").groupBy(self._label().alias("_name"), stratum.alias("stratum")).agg(F.sum("n").alias("n"))
        counts = strata.orderBy(F.desc("n"), "stratum").limit(2 * b.classes).collect()
        # Of each stratum the rows with the smallest hashes, as many as its quota lets expect; the same ones in every run.
        # Rows that lack the unit field, like those to be predicted, get `alike` of the sample.
        alike = sum(r["stratum"].endswith("?") for r in counts)
        quota = {True: b.sample * b.alike / max(1, alike), False: b.sample * (1 - b.alike) / max(1, len(counts) - alike)}
        share = {r["stratum"]: min(1.0, quota[r["stratum"].endswith("?")] / r["n"]) for r in counts}
        lexicon = self._lexicon(rows)
        wanted = ["_name", "_text", "_value", "part", "w", "lexicon", *(c for c in _TEXTS if c in rows.columns)]
        local = lexicon.select(wanted)
        if share:
            of = F.element_at(F.create_map(*(F.lit(v) for kv in share.items() for v in kv)), F.col("_stratum"))
            known = rows.filter("coalesce(_field, _text) is not null and _value is not null").withColumns({"_h": F.xxhash64(F.lit(b.seed), key), "_stratum": stratum})
            kept = known.withColumn("_share", of).filter((F.pmod(F.shiftright("_h", 3), F.lit(1_000_000)) < F.col("_share") * 1_000_000))
            local = local.unionByName(kept.withColumns({"_name": self._label(), "part": F.pmod("_h", F.lit(8)).cast("int"), "w": 1 / F.col("_share"), "lexicon": F.lit(False)}).select(wanted))
        n = min(8, rows.sparkSession.sparkContext.defaultParallelism)
        local = cut(local.repartition(n, "_name", "_value"))
        self.labels = sorted({r["_name"] for r in local.select("_name").distinct().collect()})
        index = F.array_position(F.array(*map(F.lit, self.labels)), F.col("_name")) - 1
        # Rows with words are what the trees divide first; bare numbers share what room is left.
        lean = F.when(F.col("_text").isNotNull(), 1.0).otherwise(b.bare)
        x = self._features(local).withColumns({"y": index.cast("double"), "lean": lean}).select("x", "y", "part", "w", "lexicon", "lean").cache()
        self.forest = RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="lean", numTrees=b.trees, maxDepth=b.depth, seed=b.seed, featureSubsetStrategy="all", maxBins=b.bins).fit(x.filter("part not in (0, 4)"))
        held = self._vote(x.filter("part in (0, 4)")).withColumn("right", (F.col("vote") == F.col("y")).cast("double"))
        self.iso = IsotonicRegression(featuresCol="score", labelCol="right", weightCol="w").fit(held.filter("part = 0").select("score", "right", "w"))
        # Measured on rows of the data; the lexicon's have no say in it.
        told = self.iso.transform(held.filter("part = 4 and not lexicon")).withColumn("s", (F.col("prediction") >= b.sure).cast("double"))
        total, right, sure, both = told.agg(F.sum("w"), F.sum(F.col("w") * F.col("right")), F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("s") * F.col("right"))).first()
        if total:
            self.accuracy, self.sure_share, self.sure_accuracy = right / total, sure / total, both / sure if sure else None
        x.unpersist()
        return self

    def _vote(self, x: DataFrame) -> DataFrame:
        p = vector_to_array("probability")
        voted = self.forest.transform(x)
        return voted.withColumn("score", F.array_max(p)).withColumn("vote", F.col("prediction")).drop("prediction", "rawPrediction", "probability")

    def predict(self, rows: DataFrame) -> DataFrame:
        out = self.iso.transform(self._vote(self._features(rows))).withColumnRenamed("prediction", "_chance")
        names = F.array(*(F.struct(F.lit(n.split(":")[0]).alias("family"), F.lit(int(n.split(":")[1])).alias("power")) for n in self.labels))
        return out.withColumn("_unit", F.get(names, F.col("vote").cast("int"))).select(*rows.columns, "_unit", "_chance")


_RESULTS = {"value_number", "unit_family", "unit_power", "unit_source", "unit_chance", "agrees", "common_value", "needs_review"}


def convert(facts: DataFrame, key: str = "fact_id", bounds: Bounds = Bounds(), model: UnitModel | None = None) -> DataFrame:
    """facts with value_number, unit_family, unit_power, unit_source, unit_chance, agrees, common_value, needs_review.

    Rows whose unit field is null or unknown pass through the ensemble; unit_source tells which evidence decided, and
    agrees whether the words of raw_value, where they name a unit, name the one predicted. Columns of facts that have
    names of the results, or that start with _ or x_, are left out.
    """
    facts = facts.select(*(c for c in facts.columns if c not in _RESULTS and not c.startswith(("_", "x_"))))
    rows, seen = _parsed(facts)
    model = model or UnitModel(bounds).fit(rows, key, seen)
    plain = rows.filter("_field is not null").withColumns({"_unit": F.lit(None).cast(_UNIT), "_chance": F.lit(None).cast("double")})
    # Written once: what reads a prediction more than once would run the trees as often.
    guessed = cut(model.predict(rows.filter("_field is null")))
    both = plain.unionByName(guessed)
    agrees = F.col("_unit") == F.col("_text")
    sure = (F.col("_chance") >= F.lit(bounds.sure)) & F.coalesce(agrees, F.lit(True)) & F.col("_value").isNotNull()
    part = lambda p: F.coalesce(F.col(f"_field.{p}"), F.when(sure, F.col(f"_unit.{p}")))
    source = F.when(F.col("_field").isNotNull(), "field").when(sure, "predicted").otherwise("review")
    return both.select(
        *facts.columns,
        F.col("_value").alias("value_number"),
        part("family").alias("unit_family"),
        part("power").alias("unit_power"),
        source.alias("unit_source"),
        F.col("_chance").alias("unit_chance"),
        agrees.alias("agrees"),
        in_common(F.col("_value"), part("family"), part("power")).alias("common_value"),
        (F.col("_value").isNotNull() & (source == "review")).alias("needs_review"),
    )


def review_queue(converted: DataFrame, key: str = "fact_id") -> DataFrame:
    """(key, raw_value, unit, scale, unit_chance, agrees): the values that no unit was told for with enough certainty,
    once each."""
    return converted.filter("needs_review").select(key, "raw_value", "unit", "scale", F.round("unit_chance", 6).alias("unit_chance"), "agrees").distinct()


def misscaled(converted: DataFrame, key: str = "fact_id", tolerance: float = 0.001) -> DataFrame:
    """Distinct keys whose non-null normalized_value is off common_value by more than the tolerance (relative).

    A normalized_value that is no number differs from any number.
    """
    norm = number(folded(F.col("normalized_value")))
    off = F.when(norm.isNull(), F.lit(True)).otherwise(F.abs(norm - F.col("common_value")) > tolerance * F.abs(F.col("common_value")))
    return converted.filter(F.col("common_value").isNotNull() & F.col("normalized_value").isNotNull() & off).select(key).distinct()
