"""A partitioned store of rounds and trajectories, as Parquet tables.

frames is partitioned by cv_round, round and traj; rounds and trajectories
hold metadata and flags. Reads are lazy: columns and partitions that a query
doesn't ask for aren't read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.transforms import Transform, from_json

_SCALARS = ["t", "e_pot", "e_bias", "temperature", "pressure", "err", "w", "w_t", "rho", "rho_t", "sigma", "A", "w_dyn"]
_ROWS = ["positions", "positions_t", "cell", "cell_t"]
_VECTORS = ["charges", "cv", "cv_t", "cv_orig"]
KEYS = ["cv_round", "round", "traj"]

FRAMES = T.StructType(
    [T.StructField(k, T.IntegerType()) for k in KEYS]
    + [T.StructField("row_id", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in _SCALARS]
    + [T.StructField(c, T.ArrayType(T.ArrayType(T.DoubleType()))) for c in _ROWS]
    + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in _VECTORS]
)
TRAJECTORIES = "cv_round int, round int, traj int, size long, finished boolean, invalid boolean"
ROUNDS = "cv_round int, round int, timestep double, save_step int, write_step int, r_cut double, r_skin double, temperature double, pressure double, equilibration double, max_grad double, bias_scale double, invalid boolean, atomic_numbers array<int>, cv string, bias string"


@dataclass(frozen=True)
class Store:
    """Tables under one folder."""

    spark: SparkSession
    root: str

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def append(self, frames: DataFrame, finished: bool | None = None) -> None:
        """Adds frames; columns of FRAMES that they lack are null, others are dropped.

        Each trajectory's size grows by its new rows; its flags stay as they
        were unless `finished` is given (a new one is finished and valid).
        """
        whole = frames.select(*[(F.col(f.name) if f.name in frames.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in FRAMES])
        batch = f"append={uuid.uuid4().hex}"
        whole.write.mode("append").partitionBy(*KEYS).parquet(f"{self._path('frames')}/{batch}")
        new = self.spark.read.schema(FRAMES).parquet(f"{self._path('frames')}/{batch}").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("more"))  # sizes of what was written, without working frames out again
        if self._there("trajectories"):
            new = new.join(self.trajectories().withColumnsRenamed({c: f"old_{c}" for c in ("size", "finished", "invalid")}), KEYS, "left")
        else:
            new = new.withColumns({"old_size": F.lit(0), "old_finished": F.lit(None).cast("boolean"), "old_invalid": F.lit(None).cast("boolean")})
        flag = F.lit(finished) if finished is not None else F.coalesce("old_finished", F.lit(True))
        self.mark(new.select(*KEYS, (F.col("more") + F.coalesce("old_size", F.lit(0))).cast("long").alias("size"), flag.alias("finished"), F.coalesce("old_invalid", F.lit(False)).alias("invalid")))

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def add_cv(self, name: str, values: dict, cv_round: int | None = None) -> int:
        """Registers a feature pipeline's parameters under the next cv_round (or a given one)."""
        known = self.cvs().agg(F.max("cv_round")).first()[0] if self._there("cvs") else None
        number = cv_round if cv_round is not None else 0 if known is None else known + 1
        self._put("cvs", "cv_round int, name string, parameters string", (number, name, json.dumps(values, sort_keys=True)))
        return number

    def cvs(self) -> DataFrame:
        return latest(self.spark.read.parquet(self._path("cvs")), ["cv_round"])

    def cv_parameters(self, cv_round: int) -> dict:
        return json.loads(self.cvs().where(F.col("cv_round") == cv_round).first()["parameters"])

    def keep_features(self, cv_round: int, features: Transform) -> None:
        """Writes down the transform that gave a cv_round's features, so that it can be applied again after a restart."""
        self._put("features", "cv_round int, transform string", (cv_round, features.to_json()))

    def features(self, cv_round: int) -> Transform:
        """The newest transform kept for a cv_round. KeyError if there is none."""
        found = latest(self.spark.read.parquet(self._path("features")), ["cv_round"]).where(F.col("cv_round") == cv_round).first() if self._there("features") else None
        if found is None:
            raise KeyError(f"no features are kept for cv_round {cv_round}")
        return from_json(found["transform"])

    def add_permanent_bias(self, values: dict) -> None:
        """Parameters of a wall that holds in all rounds."""
        self._put("walls", "wall int, parameters string", (0, json.dumps(values, sort_keys=True)))

    def permanent_bias(self) -> dict | None:
        return json.loads(latest(self.spark.read.parquet(self._path("walls")), ["wall"]).first()["parameters"]) if self._there("walls") else None

    def _put(self, name: str, schema: str, row: tuple) -> None:
        self._add_version(self.spark.createDataFrame([row], schema), name)

    def _add_version(self, rows: DataFrame, name: str) -> None:
        """Appends rows as a version after all that are there: by the clock, or a microsecond after the newest where that is ahead of it."""
        if self._there(name):
            after = self.spark.read.parquet(self._path(name)).agg((F.max("version") + F.expr("interval 1 microsecond")).alias("after"))
            rows = rows.crossJoin(F.broadcast(after)).withColumn("version", F.greatest(F.current_timestamp(), "after")).drop("after")  # one row
        else:
            rows = rows.withColumn("version", F.current_timestamp())
        rows.write.mode("append").parquet(self._path(name))

    def set_round(self, cv_round: int, round_: int, invalid: bool) -> None:
        """Sets or clears a round's invalid flag."""
        old = self.rounds().where((F.col("cv_round") == cv_round) & (F.col("round") == round_))
        self._add_version(old.withColumn("invalid", F.lit(invalid)), "rounds")

    def counts(self) -> DataFrame:
        """cv_round, round, trajectories, rows: what each round holds."""
        return self.trajectories().groupBy("cv_round", "round").agg(F.count(F.lit(1)).alias("trajectories"), F.sum("size").alias("rows"))

    def ids(self, cv_round: int, round_: int) -> list[int]:
        """Trajectories of a round, rising."""
        found = self.trajectories().where((F.col("cv_round") == cv_round) & (F.col("round") == round_)).select("traj").orderBy("traj")
        return [r["traj"] for r in found.collect()]  # a row a trajectory of one round

    def last_row(self, cv_round: int, round_: int, traj: int) -> DataFrame:
        """The newest frame of a trajectory: where to go on from."""
        own = self.frames().where((F.col("cv_round") == cv_round) & (F.col("round") == round_) & (F.col("traj") == traj))
        return own.orderBy(F.desc("row_id")).limit(1)

    def copy_round(self, cv_round: int, cv: Column, more: dict[str, Column] | None = None) -> None:
        """Round 0 of a new cv_round: the scanned frames with new features; the old ones stay as cv_orig."""
        frames = self.scan(num=1 << 20, only_finished=False)
        kept = frames.withColumns({"cv_orig": F.col("cv"), "cv": cv} | (more or {}))
        # Numbered anew in the order of rounds and trajectories: a row a trajectory, of the newest cv_round's metadata.
        known = self.trajectories().select(*KEYS).distinct()
        numbers = known.withColumn("new_traj", F.row_number().over(Window.partitionBy("cv_round").orderBy("round", "traj")) - 1)
        renumbered = kept.join(numbers, KEYS).withColumn("traj", F.col("new_traj")).drop("new_traj")
        self.append(renumbered.withColumns({"cv_round": F.lit(cv_round), "round": F.lit(0)}), finished=True)

    def mark(self, flags: DataFrame) -> None:
        """Adds versions of trajectories' metadata; the latest version of each counts, so flags are set without rewriting."""
        self._add_version(flags, "trajectories")

    def add_round(self, values: dict) -> None:
        row = self.spark.createDataFrame([tuple(values.get(f.name) for f in T._parse_datatype_string(ROUNDS))], ROUNDS)
        self._add_version(row, "rounds")

    def frames(self) -> DataFrame:
        return self.spark.read.schema(FRAMES).parquet(self._path("frames")).select(*FRAMES.names)

    def trajectories(self) -> DataFrame:
        return latest(self.spark.read.parquet(self._path("trajectories")), KEYS)

    def rounds(self) -> DataFrame:
        """bias_scale counts as 1 where it is missing."""
        return latest(self.spark.read.parquet(self._path("rounds")), KEYS[:2]).withColumn("bias_scale", F.coalesce("bias_scale", F.lit(1.0)))

    def set_flag(self, flag: str, value: bool, where: Column) -> None:
        """Sets finished or invalid of the trajectories that `where` picks."""
        self.mark(self.trajectories().where(where).withColumn(flag, F.lit(value)).select(*KEYS, "size", "finished", "invalid"))

    def scan(self, num: int = 1, start: int = 0, stop: int | None = None, only_finished: bool = True, ignore_invalid: bool = False) -> DataFrame:
        """Frames of the last `num` rounds up to `stop` of the newest cv_round: valid, finished and not empty."""
        flags, rounds = self.trajectories(), self.rounds()
        cv = rounds.agg(F.max("cv_round")).first()[0]
        last = stop if stop is not None else rounds.where(F.col("cv_round") == cv).agg(F.max("round")).first()[0]
        low = max(last - (num - 1), start)
        good = flags.where((F.col("cv_round") == cv) & F.col("round").between(low, last) & (F.col("size") > 0))
        if only_finished:
            good = good.where(F.coalesce("finished", F.lit(False)))
        if not ignore_invalid:
            good = good.where(~F.coalesce("invalid", F.lit(False))).join(rounds.where(~F.coalesce("invalid", F.lit(False))).select(*KEYS[:2]), KEYS[:2], "left_semi")
        frames = self.frames().where((F.col("cv_round") == cv) & F.col("round").between(low, last))  # prunes partitions
        return frames.join(good.select(*KEYS), KEYS, "left_semi")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("version"))
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "version")


def fraction_finished(trajectories: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fraction: finished among valid trajectories; 0 without valid ones."""
    valid = ~F.coalesce(F.col("invalid"), F.lit(False))
    return trajectories.groupBy(*keys).agg(F.coalesce(F.avg(F.when(valid, F.coalesce(F.col("finished"), F.lit(False)).cast("int"))), F.lit(0.0)).alias("fraction"))


def numbers_after(text: Column, word: str) -> Column:
    """The numbers that follow a word, as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"{word}\s+([0-9]+(\.[0-9]+)?)"), F.lit(1)), lambda x: x.cast("double"))


def timescales_in_logs(spark: SparkSession, path: str) -> DataFrame:
    """The lists of numbers in lines like `timescales: [1.0 2.5] ns`."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"timescales:\s*\[[^\]]*\]\s*ns"))
    inner = F.regexp_extract("value", r"timescales:\s*\[([^\]]*)\]\s*ns", 1)
    return lines.select(F.transform(F.regexp_extract_all(inner, F.lit(r"[-+0-9.eE]+"), F.lit(0)), lambda x: x.cast("double")).alias("timescales"))


def write_xyz(frames: DataFrame, path: str, symbols: list[str]) -> None:
    """A text file a partition: for each frame the number of atoms, a comment, and a line an atom."""
    atoms = F.zip_with(F.array(*map(F.lit, symbols)), "positions", lambda s, p: F.concat_ws(" ", s, F.array_join(F.transform(p, lambda v: F.format_string("%.8f", v)), " ")))
    frames.select(F.concat_ws("\n", F.lit(str(len(symbols))), F.concat(F.lit("row "), F.col("row_id").cast("string")), F.array_join(atoms, "\n")).alias("value")).write.mode("overwrite").text(path)


def in_angstrom(frames: DataFrame, unit: float) -> DataFrame:
    """Positions and cells in angstrom, for a store whose unit is that many angstroms."""
    scaled = lambda c: F.transform(c, lambda row: F.transform(row, lambda x: x * unit))
    return frames.withColumns({c: scaled(F.col(c)) for c in ("positions", "cell")})


def save_parameters(spark: SparkSession, path: str, values: dict) -> None:
    """Parameters of a named pipeline or bias, as JSON in any file system that Spark reaches; never code."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_parameters(spark: SparkSession, path: str, **overrides) -> dict:
    return json.loads(spark.read.text(path).first()["value"]) | overrides
