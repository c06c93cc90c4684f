"""The rule chain: class and reasons of an enriched detection, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import config as C
from emberline.functions.values import fixed

_OPTIONAL = {
    "nearest_facility_name": "string", "nearest_facility_type": "string", "distance_m": "double", "within_facility": "boolean", "vision_industrial_prob": "double", "vision_fire_prob": "double",
    "vision_flare_prob": "double", "vision_model_version": "string", "landcover_class": "string", "detections_7d": "long", "days_active_30d": "long", "persistence_score": "double",
    "current_frp_vs_historical_mean": "double", "nighttime_detection_fraction": "double",
}


def build_features(df: DataFrame) -> DataFrame:
    """Adds the columns the rules need where they are missing; counts and scores become 0, not null."""
    for name, kind in _OPTIONAL.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    zero = {c: F.coalesce(F.col(c).try_cast(_OPTIONAL[c]), F.lit(0).cast(_OPTIONAL[c])) for c in ("detections_7d", "days_active_30d", "persistence_score")}
    blank = {c: F.nullif(F.col(c), F.lit("")) for c in ("vision_model_version", "landcover_class", "nearest_facility_type")}
    return df.withColumns({**zero, **blank, "within_facility": F.coalesce("within_facility", F.lit(False))})


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


class Chain:
    """The conditions of the four rules over feature columns."""

    def __init__(self, rules: C.Rules = C.Rules()):
        r, col = rules, F.col
        self.r = r
        dist, inside = col("distance_m"), col("within_facility")
        self.near_by_distance = _yes(dist <= r.near_m)
        self.at = inside | _yes(dist <= r.at_m)
        self.near = inside | self.near_by_distance
        self.surge = _yes(col("current_frp_vs_historical_mean") >= r.surge)
        self.bright = _yes(col("frp") >= r.bright_frp)
        self.persisting = col("persistence_score") >= r.persistence
        self.recurrent = (col("detections_7d") >= r.gas_detections_7d) | (col("days_active_30d") >= r.active_days)
        self.night = _yes(col("nighttime_detection_fraction") >= r.night)
        self.flare_seen = _yes(col("vision_flare_prob") >= r.vision_flare)
        self.industry_seen = _yes(col("vision_industrial_prob") >= r.vision_industrial)
        self.fire_seen = _yes(col("vision_fire_prob") >= r.vision_fire)
        site = self.at & _yes(col("nearest_facility_type").isin(*C.GAS_TYPES))
        self.gas = (site | self.flare_seen) & (self.bright | self.persisting | self.recurrent | self.night | self.surge | self.flare_seen)
        repeating = (col("detections_7d") >= r.repeat_7d) | (col("days_active_30d") >= r.active_days) | self.persisting
        self.persistent = self.near_by_distance & repeating & ~self.surge
        self.fire = (self.near | self.industry_seen | self.fire_seen) & (~self.persisting | self.surge)
        known_near = col("nearest_facility_type").isNotNull() & (dist.isNull() | self.near_by_distance)
        self.unknown = ~inside & ~known_near & col("vision_industrial_prob").isNull()

    def label(self) -> Column:
        return F.when(self.gas, C.GAS_FLARE).when(self.persistent, C.PERSISTENT).when(self.fire, C.FIRE).otherwise(C.UNKNOWN)

    def reasons(self) -> Column:
        r, col, text = self.r, F.col, F.concat
        lit = F.lit
        name = F.trim(F.coalesce(col("nearest_facility_name"), lit("")))
        kind = F.coalesce(col("nearest_facility_type"), lit("unknown facility"))
        place = F.when(name != "", text(lit('"'), name, lit('" ('), kind, lit(")"))).otherwise(kind)
        metres = F.format_number(col("distance_m"), 0)
        ratio, frp = fixed(col("current_frp_vs_historical_mean"), 1), fixed(col("frp"), 1)
        d7, active = col("detections_7d").cast("string"), col("days_active_30d").cast("string")
        two = lambda c: fixed(col(c), 2)
        counts = text(d7, lit(" detections in 7 d, "), active, lit(" active days in 30 d"))
        bright = F.when(self.bright, text(lit("FRP "), frp, lit(f" >= {r.bright_frp:g} (bright)")))
        gas = [
            text(lit("gas-flare candidate site "), place), bright, F.when(self.recurrent, text(counts, lit(" (recurrent)"))),
            F.when(self.night, text(lit("nighttime fraction "), two("nighttime_detection_fraction"), lit(f" >= {r.night:g} (night recurrence)"))),
            F.when(self.persisting, text(lit("persistence "), two("persistence_score"), lit(" ("), d7, lit(" detections in 7 d)"))),
            F.when(self.surge, text(lit("FRP "), frp, lit(" is "), ratio, lit("x the 30-d mean (burst)"))),
        ]
        steady = F.when(col("current_frp_vs_historical_mean").isNotNull(), text(lit(" (ratio "), ratio, lit(")"))).otherwise("")
        persistent = [text(lit("within "), metres, lit(" m of "), place), counts, text(lit("FRP is steady relative to the historical mean"), steady)]
        where = F.when(col("within_facility"), text(lit("hotspot lies inside "), place, lit(" polygon"))).when(self.near_by_distance, text(lit("within "), metres, lit(" m of "), place))
        sudden = F.when(self.surge, text(lit("FRP "), frp, lit(" is "), ratio, lit("x the 30-d mean (sudden event)"))).when(col("detections_7d") <= 1, text(lit("new detection ("), d7, lit(" prior detections in 7 d)")))
        bare = where.isNull() & sudden.isNull()
        fire = [
            where, sudden, F.when(bare & self.fire_seen, text(lit("vision fire probability "), two("vision_fire_prob"), lit(f" >= {r.vision_fire:g}"))),
            F.when(bare & self.industry_seen, text(lit("vision industrial probability "), two("vision_industrial_prob"), lit(f" >= {r.vision_industrial:g}"))), bright,
        ]
        far = F.when(col("distance_m").isNotNull(), text(lit("nearest known industrial facility is "), metres, lit(" m away"))).otherwise("no known industrial facility within screening range of this hotspot")
        seen = [F.when(col(c).isNotNull(), text(lit(label), two(c))) for c, label in (("vision_industrial_prob", "vision industrial probability "), ("vision_fire_prob", "vision fire probability "), ("vision_flare_prob", "vision flare probability "))]
        any_seen = F.coalesce("vision_industrial_prob", "vision_fire_prob", "vision_flare_prob").isNotNull()
        seen.append(F.when(any_seen & col("vision_model_version").isNotNull(), text(lit("vision model version "), col("vision_model_version"))))
        cover = F.when(col("landcover_class").isNotNull(), text(lit("land cover: "), col("landcover_class"), lit(" (informational)")))
        decided = F.when(self.gas, F.array(*gas)).when(self.persistent, F.array(*persistent)).when(self.fire, F.array(*fire)).when(self.unknown, F.array(far))
        full = F.concat(decided, F.array(*seen, cover))
        return F.when(decided.isNull(), F.array(lit("no rule produced a decision"))).otherwise(F.filter(full, lambda x: x.isNotNull()))


def classify(df: DataFrame, rules: C.Rules = C.Rules(), reasons: bool = True) -> DataFrame:
    """df with class (and reasons)."""
    chain = Chain(rules)
    out = build_features(df).withColumn("class", chain.label())
    return out.withColumn("reasons", chain.reasons()) if reasons else out


def reference_label(df: DataFrame, near_m: float = 2500.0, far_m: float = 5000.0) -> Column:
    """positive, negative or uncertain from the map alone."""
    dist, kind = F.col("distance_m"), F.col("nearest_facility_type")
    return F.when(F.col("within_facility"), "positive").when(dist.isNull(), "uncertain").when((dist <= near_m) & kind.isin(*C.CONFIDENT_TYPES), "positive").when(dist >= far_m, "negative").otherwise("uncertain")


def confusion(df: DataFrame) -> DataFrame:
    """(reference, predicted, n) over classified rows; predicted is industrial or unknown."""
    predicted = F.when(F.col("class").isin(*C.KEEP_CLASSES), "industrial").otherwise("unknown")
    return df.filter(F.col("class").isNotNull()).groupBy(reference_label(df).alias("reference"), predicted.alias("predicted")).agg(F.count("*").alias("n"))


def agreement(df: DataFrame) -> DataFrame:
    """One row: compared, agreeing, accuracy (4 places) over positive and negative rows."""
    ref = reference_label(df)
    good = ((ref == "positive") & F.col("class").isin(*C.KEEP_CLASSES)) | ((ref == "negative") & ~F.col("class").isin(*C.KEEP_CLASSES))
    rows = df.filter(F.col("class").isNotNull() & (ref != "uncertain"))
    return rows.agg(F.count("*").alias("compared"), F.count_if(good).alias("agreeing"), F.round((F.count_if(good) / F.nullif(F.count("*"), F.lit(0))).cast("decimal(18,6)"), 4).cast("double").alias("accuracy"))


def report(df: DataFrame, n: int = 10) -> DataFrame:
    """One row, fit for a JSON file: counts by reference, agreement, the confusion by class, and n samples of either error.

    A row without a class counts as unknown. The counts reduce to a dozen rows before they meet.
    """
    rows = df.withColumn("class", F.coalesce("class", F.lit(C.UNKNOWN)))
    table = lambda key: F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n"))))
    pairs = rows.groupBy(reference_label(rows).alias("reference"), "class").agg(F.count("*").alias("n"))
    industrial = F.col("class").isin(*C.KEEP_CLASSES)
    good = ((F.col("reference") == "positive") & industrial) | ((F.col("reference") == "negative") & ~industrial)
    total = lambda rule: F.coalesce(F.sum(F.when(rule, F.col("n"))), F.lit(0))
    decided = total(F.col("reference") != "uncertain")
    sums = pairs.agg(
        total(F.lit(True)).alias("total_evaluated"), *[total(F.col("reference") == x).alias(f"ref_{x}") for x in ("positive", "negative", "uncertain")],
        total(good).alias("agreement"), F.round((total(good) / F.nullif(decided, F.lit(0))).cast("decimal(18,6)"), 4).cast("double").alias("accuracy_decided"),
    )
    by_reference = pairs.groupBy("reference").agg(table("class").alias("row"))
    confused = by_reference.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reference", F.map_entries("row").alias("row"))))).alias("rows"))
    confused = confused.select(F.transform_values("rows", lambda _, r: F.map_from_entries(r)).alias("confusion"))
    by_class = pairs.groupBy("class").agg(F.sum("n").alias("n")).agg(table("class").alias("predicted_class_counts"))
    out = sums.join(F.broadcast(confused)).join(F.broadcast(by_class))
    for kind, name in (("fp", "false_positives_samples"), ("fn", "false_negatives_samples")):
        found = disagreements(rows, kind, n)
        out = out.join(F.broadcast(found.agg(F.sort_array(F.collect_list(F.struct(*found.columns))).alias(name))))
    return out


def write_report(found: DataFrame, path: str) -> None:
    """The report's one row as a JSON file in a folder."""
    found.coalesce(1).write.mode("overwrite").json(path)


def disagreements(df: DataFrame, kind: str, n: int = 10) -> DataFrame:
    """The first n false positives ("fp") or false negatives ("fn") by id."""
    ref, industrial = reference_label(df), F.col("class").isin(*C.KEEP_CLASSES)
    wrong = (ref == "negative") & industrial if kind == "fp" else (ref == "positive") & ~industrial
    return df.filter(wrong).select("id", "class", "distance_m", "nearest_facility_type").orderBy("id").limit(n)
