"""What a recording's columns are: vendors' labels resolved to channels, for many recordings at once.

``heads`` has a row for each column of each recording: (path, number, label, unit).  Labels
meet the dimension of known names in one join; ranks and keys are windows over a
recording's columns, which are few.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BY = "path"

# Channels with the quantity that each carries and its usual unit, the labels that name them, the
# columns they are in where no label says so, and tags that say which maker's file it is.
CHANNELS = {
    "airway_pressure": ("airway_pressure", "cmH2O"),
    "flow": ("airflow", "L/min"),
    "volume": ("volume", "L"),
    "esophageal_pressure": ("esophageal_pressure", "cmH2O"),
    "transpulmonary_pressure": ("transpulmonary_pressure", "cmH2O"),
    "gastric_pressure": ("gastric_pressure", "cmH2O"),
    "tidal_volume": ("tidal_volume", "mL"),
}
LABELS = {
    "airway pressure": "airway_pressure",
    "airway pressure (pod)": "airway_pressure",
    "paw": "airway_pressure",
    "pressure": "airway_pressure",
    "pvent": "airway_pressure",
    "flow": "flow",
    "airway flow": "flow",
    "volume": "volume",
    "esophageal pressure (pod)": "esophageal_pressure",
    "esophageal pressure": "esophageal_pressure",
    "pes": "esophageal_pressure",
    "transpulmonary pressure (pod)": "transpulmonary_pressure",
    "transpulmonary pressure": "transpulmonary_pressure",
    "pl": "transpulmonary_pressure",
    "gastric pressure/auxiliary pressure (pod)": "gastric_pressure",
    "gastric pressure": "gastric_pressure",
    "auxiliary pressure": "gastric_pressure",
    "pga": "gastric_pressure",
    "tidal volume": "tidal_volume",
    "vt": "tidal_volume",
}
POSITIONS = {"airway_pressure": 0, "flow": 1, "volume": 2}
MAKERS = ("raw", "timpel", "draeger", "dräger", "sentec")

USUAL = ("airway_pressure", "flow", "volume")


@dataclass
class ChannelNames:
    """The dimension of known names; a site adds its own labels and channels to a copy."""

    channels: dict[str, tuple[str, str | None]] = field(default_factory=lambda: dict(CHANNELS))
    labels: dict[str, str] = field(default_factory=lambda: dict(LABELS))

    def register(self, label: str, channel: str, category: str | None = None, unit: str | None = None) -> None:
        """A label for a channel, known or new; "pressure" is what airway pressure was once called."""
        channel = "airway_pressure" if channel == "pressure" else channel
        known = self.channels.get(channel, (channel, None))
        self.channels[channel] = (category or known[0], unit or known[1])
        self.labels[" ".join(label.replace("_", " ").lower().split())] = channel

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(label, c, *self.channels[c]) for label, c in self.labels.items()]
        return spark.createDataFrame(rows, "_label string, channel string, category string, usual_unit string")


def plain_label(label: Column) -> Column:
    """A label in lower case with single spaces, underscores as spaces, and without makers' tags at its end; tags of sensors such as (pod) stay."""
    spaced = F.trim(F.regexp_replace(F.lower(F.regexp_replace(label, "_", " ")), r"\s+", " "))
    return F.coalesce(F.trim(F.regexp_replace(spaced, rf"(\s*\(\s*({'|'.join(MAKERS)})\s*\))+$", "")), F.lit(""))


def qualifier(label: Column) -> Column:
    """The tag in brackets at a plain label's end, spaces as underscores; null without one."""
    tag = F.regexp_replace(F.trim(F.regexp_extract(plain_label(label), r"\(([^()]*)\)$", 1)), r"\s+", "_")
    return F.nullif(tag, F.lit(""))


def resolve_channels(heads: DataFrame, requested: Sequence[str] = USUAL, origin: str | Column | None = None, positions: Mapping[str, int] | None = None, fallback: bool = True, qualify: bool = False, names: ChannelNames | None = None) -> DataFrame:
    """(path, key, channel, category, origin, label, unit, number, is_primary), a row for each column that is one of ``requested``.

    A channel is the column at its given position, else every column whose label names it, else, if
    no label of the recording names any known channel, the column at its usual position.  The first column of a
    channel has its name as key; later ones add their tag, the origin or their number, and a count where that is
    taken.  A unit that is recorded stays as it is.  The first channel of a quantity is its primary one.
    """
    names = names or ChannelNames()
    unknown = [c for c in requested if c not in names.channels]
    if unknown:
        raise ValueError(f"unknown channels {unknown}; known: {sorted(names.channels)}")
    positions = dict(positions or {})
    spare = sorted(set(positions) - set(requested))
    if spare:
        raise ValueError(f"positions are given for {spare}, which aren't requested")
    spark = heads.sparkSession
    source = F.lit(None).cast("string") if origin is None else F.lit(origin) if isinstance(origin, str) else origin
    rows = heads.select(BY, F.col("number").cast("int").alias("number"), "label", F.nullif(F.trim("unit"), F.lit("")).alias("_unit"), source.alias("_source"))
    dimension = names.table(spark).select("_label", F.col("channel").alias("_named"))
    named = rows.withColumn("_label", plain_label(F.col("label"))).join(F.broadcast(dimension), "_label", "left").drop("_label")
    # what each recording asks for: few rows, one for each requested channel
    order = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(c).alias("channel"), F.lit(names.channels[c][0]).alias("category"), F.lit(names.channels[c][1]).alias("usual_unit"), F.lit(positions.get(c)).cast("int").alias("given"), F.lit(POSITIONS.get(c) if fallback else None).cast("int").alias("usual")) for k, c in enumerate(requested)])
    # a recording's columns are few and travel with it: one shuffle, and no join of the table with itself
    columns = F.collect_list(F.struct("number", "label", "_unit", "_named")).alias("_columns")
    files = named.groupBy(BY).agg(F.max("_source").alias("_source"), F.bool_or(F.col("_named").isNotNull()).alias("_any"), F.collect_set("_named").alias("_names"), columns)
    asked = files.withColumn("_ask", F.explode(order)).select(BY, "_source", "_any", "_names", "_columns", "_ask.*")
    place = F.when(F.col("given").isNotNull(), F.col("given")).when(~F.array_contains("_names", F.col("channel")) & ~F.col("_any"), F.col("usual"))
    asked = asked.withColumn("_place", place)
    fits = F.filter("_columns", lambda c: F.when(F.col("_place").isNotNull(), c["number"] == F.col("_place")).otherwise(c["_named"] == F.col("channel")))
    nothing = F.array(F.lit(None).cast(named.select(F.struct("number", "label", "_unit", "_named").alias("c")).schema["c"].dataType))
    # a channel at a place has a row even where the recording has no such column
    found = asked.withColumn("_fits", fits).withColumn("_column", F.explode(F.when(F.col("_place").isNotNull() & (F.size("_fits") == 0), nothing).otherwise(F.col("_fits"))))
    found = found.select(BY, "_source", "rank", "channel", "category", "usual_unit", F.coalesce("_place", "_column.number").alias("number"), "_column.label", "_column._unit")
    nth = F.row_number().over(Window.partitionBy(BY, "rank").orderBy("number"))
    tag = qualifier(F.col("label"))
    first = F.when(F.lit(qualify) & F.col("_source").isNotNull(), F.concat("channel", F.lit("__"), "_source")).otherwise(F.col("channel"))
    later = F.concat("channel", F.lit("__"), F.coalesce(tag, F.col("_source"), F.concat(F.lit("col"), F.col("number").cast("string"))))
    keyed = found.withColumn("_nth", nth).withColumn("_key", F.when(F.col("_nth") == 1, first).otherwise(later))
    taken = F.row_number().over(Window.partitionBy(BY, "_key").orderBy("rank", "_nth"))
    leads = F.row_number().over(Window.partitionBy(BY, "category").orderBy("rank", "_nth")) == 1
    key = F.when(F.col("_taken") == 1, F.col("_key")).otherwise(F.concat("_key", F.col("_taken").cast("string")))
    return keyed.withColumns({"_taken": taken, "is_primary": leads}).select(BY, key.alias("key"), "channel", "category", F.coalesce(tag, F.col("_source")).alias("origin"), "label", F.coalesce("_unit", "usual_unit").alias("unit"), "number", "is_primary")


def unresolved(heads: DataFrame, specs: DataFrame, requested: Sequence[str] = USUAL) -> DataFrame:
    """(path, channel) of requested channels that a recording doesn't have."""
    asked = heads.select(BY).distinct().withColumn("channel", F.explode(F.array(*[F.lit(c) for c in requested])))
    return asked.join(specs.select(BY, "channel").distinct(), [BY, "channel"], "left_anti")


def split_channels(samples: DataFrame, specs: DataFrame) -> DataFrame:
    """Samples of the resolved columns, with key, quantity and unit; ``samples`` name their column by ``channel``, the label it has in the file.

    One join with a row for each column of each recording.
    """
    own = specs.select(F.col(BY).alias("_path"), F.col("label").alias("_label"), "key", "category", F.col("unit").alias("_unit"), "is_primary")
    joined = samples.join(own, (F.col(BY) == F.col("_path")) & (F.col("channel") == F.col("_label")))
    return joined.withColumn("unit", F.col("_unit")).drop("_path", "_label", "_unit")


def primary_channel(specs: DataFrame, quantity: str) -> DataFrame:
    """(path, key): the main column of a quantity, or of a channel's quantity, in each recording."""
    category = CHANNELS.get(quantity, (quantity, None))[0]
    return specs.where(F.col("is_primary") & (F.col("category") == category)).select(BY, "key")
