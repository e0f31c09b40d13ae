"""Recognition from waves to scores: features by family, a network for each, fitted on clean files, and their agreement with the truth by noise level, alone and fused.

Waves are rows (file, cls, samples), files told apart by name. What's fitted sees the files of one part only; scales are those of that part. Waves too short for a frame, null
waves, files or classes are left out; silent ones take part. Empty tables give empty reports.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.sources.tables import written

from . import network, report, signal
from .patches import patch_summaries
from .ranks import shuffled
from .split import standard_scaled, train_val


@dataclass
class Setting:
    """Frames and patches: samples of a frame and between frames, frames of a patch and between patches, the rate."""

    size: int
    hop: int
    patch: int
    step: int
    fs: float


def family_summaries(waves: DataFrame, family: str, setting: Setting) -> DataFrame:
    """(file, patch, v): means and variances over patches of the values of one of ``signal.FRAMES``, not scaled by file: levels count."""
    frames = signal.frames_of_waves(waves, setting.size, setting.hop)
    values = signal.by_frame(frames, [(family, "samples")], setting.fs)
    return patch_summaries(values.withColumnRenamed("frame", "i"), setting.patch, setting.step, scaled=False)


@dataclass
class Recogniser:
    """A family's network and the mean and deviation of each of its inputs over the patches it was fitted on."""

    family: str
    scale: list[tuple[float, float]]
    net: network.Network

    def scores(self, summaries: DataFrame) -> DataFrame:
        """(file, patch, p) of (file, patch, v): the classes' probabilities."""
        scale = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in self.scale))
        scaled = F.zip_with("v", scale, lambda x, k: F.coalesce(F.try_divide(x - k["m"], k["s"]), F.lit(0.0)))
        rows = summaries.select(F.struct("file", "patch").alias("key"), F.lit(self.net.classes[0]).alias("y"), scaled.alias("x"))
        return network.predicted(rows, self.net, "key", "y", "x").select("key.file", "key.patch", F.col("shares").alias("p"))


def recogniser(waves: DataFrame, family: str, setting: Setting, hidden: list[int], **fit) -> Recogniser | None:
    """Fitted on all of waves (file, cls, samples), a patch at a time; None where there's nothing to fit on."""
    rows = family_summaries(waves, family, setting).join(waves.select("file", "cls"), "file")
    rows = written(rows.withColumn("key", F.struct("file", "patch")), "summaries")
    long = rows.select(F.posexplode("v").alias("d", "x"))
    stats = {r.d: (r.m, r.s) for r in long.groupBy("d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()}  # a row for each input
    nets = network.fitted(standard_scaled(rows, ["key", "cls"], [], "v"), "key", "cls", "z", [hidden], **fit) if stats else []
    return Recogniser(family, [stats[d] for d in sorted(stats)], nets[0]) if nets else None


def file_verdicts(scores: DataFrame, classes: list) -> DataFrame:
    """(file, p): the class of the largest mean of a file's scores (file, p array), the first of equals."""
    long = scores.select("file", F.posexplode("p").alias("c", "s"))
    means = long.groupBy("file", "c").agg(F.avg("s").alias("s"))
    best = means.groupBy("file").agg(F.max_by("c", F.struct("s", -F.col("c"))).alias("c"))
    return best.select("file", F.get(F.array(*map(F.lit, classes)), F.col("c")).alias("p"))


def noise_report(waves: DataFrame, noises: DataFrame, levels: list[float], families: list[str], setting: Setting, hidden: list[int], part: float = 0.7, seed: int = 1, pick: Column | None = None, **fit) -> DataFrame:
    """(snr_db, feat, label, tp, n, said, precision, recall, f1): how well each family, and all 'fused', know the held-out files under noise; a null level is the clean one.

    Of each class's files in an order that seed draws the first ``part`` train a network a family on clean waves; the others are mixed with noises (noise, samples) at each level (``report.noisy``) and judged
    by the mean score of their patches, over families where fused. n counts a label's files, said those that were called so.
    """
    known = waves.where("file is not null and cls is not null").where(F.size("samples") >= setting.size).select(F.col("file").cast("string").alias("file"), "cls", "samples")
    roles = written(train_val(known.select("cls", "file"), shuffled(seed, "file"), part), "roles")
    train = known.join(roles.where("role = 'train'").select("file"), "file", "left_semi")
    test = known.join(roles.where("role = 'val'").select("file"), "file", "left_semi")
    loud = report.noisy(test.select("file", "samples"), noises, levels, pick).select("file", F.col("snr_db").cast("double").alias("snr_db"), "samples")
    clean = test.select("file", F.lit(None).cast("double").alias("snr_db"), "samples")
    both = written(clean.union(loud).select(F.struct("file", "snr_db").alias("file"), "samples"), "waves")
    schema = "snr_db double, feat string, label {0}, tp long, n long, said long, precision double, recall double, f1 double".format(waves.schema["cls"].dataType.simpleString())
    verdicts = every = None
    classes: list = []
    for family in families:
        found = recogniser(train, family, setting, hidden, seed=seed, **fit)
        if found is None:
            return waves.sparkSession.createDataFrame([], schema)
        classes = found.net.classes
        own = found.scores(family_summaries(both, family, setting)).select("file", "p")
        every = own if every is None else every.union(own)
        said = file_verdicts(own, classes).withColumn("feat", F.lit(family))
        verdicts = said if verdicts is None else verdicts.union(said)
    verdicts = verdicts.union(file_verdicts(every, classes).withColumn("feat", F.lit("fused")))
    rows = verdicts.select("file.file", "file.snr_db", "feat", "p").join(known.select("file", "cls"), "file")
    sides = rows.select("snr_db", "feat", F.explode(F.array(F.struct(F.col("cls").alias("label"), F.lit(1).alias("y"), F.lit(0).alias("said"), (F.col("cls") == F.col("p")).cast("int").alias("tp")), F.struct(F.col("p").alias("label"), F.lit(0).alias("y"), F.lit(1).alias("said"), F.lit(0).alias("tp")))).alias("k"))
    sums = sides.groupBy("snr_db", "feat", "k.label").agg(F.sum("k.tp").alias("tp"), F.sum("k.y").alias("n"), F.sum("k.said").alias("said"))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return sums.withColumns({"precision": ratio("tp", "said"), "recall": ratio("tp", "n"), "f1": F.try_divide(2.0 * F.col("tp"), F.col("n") + F.col("said"))})
