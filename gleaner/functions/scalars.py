"""Scalar rules of the curation policy.

Numbers are rounded by Spark's round (half up on the decimal value) throughout.  The limits, weights and landmark
numbers in these rules are fixed values of the policy.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of labels.
TRUE_WORDS = ("1", "true", "yes", "y", "positive", "same", "accept")
FALSE_WORDS = ("0", "false", "no", "n", "negative", "different", "reject")


def _clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def coarse_pose(yaw: Column) -> Column:
    """Five coarse directions of a horizontal angle."""
    return (
        F.when(yaw <= -35, "left_profile").when(yaw <= -12, "left_turn").when(yaw >= 35, "right_profile").when(yaw >= 12, "right_turn").otherwise("frontal"))


def pose_cell(yaw: Column, pitch: Column) -> Column:
    """A cell of the 13 x 9 grid of 15-degree steps, as two zero-padded numbers."""
    cell = lambda x, most: F.lpad(F.floor((_clamp(x, -most, most) + most) / 15).cast("string"), 2, "0")
    return F.concat(F.lit("pose_"), cell(yaw.cast("double"), 90.0), F.lit("_"), cell(pitch.cast("double"), 60.0))


def signature(v: Column) -> Column:
    """Two hex digits of six bits: is the mean of every sixth element, from b on, at least the overall mean?  Empty: unknown."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, e: s + e) / F.size(x)
    bit = lambda b: F.when(F.size(v) > b, F.when(mean(F.filter(v, lambda x, i: i % 6 == b)) >= mean(v), 1 << b).otherwise(0)).otherwise(0)
    total = bit(0)
    for b in range(1, 6):
        total = total + bit(b)
    return F.when(F.coalesce(F.size(v), F.lit(0)) > 0, F.lower(F.lpad(F.hex(total), 2, "0"))).otherwise("unknown")


def session_key(path: Column, scene: Column, appearance: Column) -> Column:
    """Parent folder (lower case, 24 characters at most, root if none), scene and appearance."""
    parts = F.split(path, "/")
    folder = F.when(F.size(parts) > 1, F.lower(F.substring(F.element_at(parts, -2), 1, 24))).otherwise("")
    return F.concat_ws("|", F.when(folder == "", "root").otherwise(folder), scene, appearance)


def first_filled(*vectors: Column) -> Column:
    """The first vector that is not null or empty."""
    out = F.array().cast("array<double>")
    for v in reversed(vectors):
        out = F.when(F.coalesce(F.size(v), F.lit(0)) > 0, v).otherwise(out)
    return out


def visual_vector(scene: Column, appearance: Column) -> Column:
    return F.concat(scene, appearance)


def digest_vector(fingerprint: Column) -> Column:
    """Sixteen numbers in [0, 1] from the first sixteen bytes of a hex digest."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(fingerprint, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)


def exposure(mean_midtone: Column, p5: Column, p95: Column, clipped: Column) -> Column:
    """Midtone share, tonal range and unclipped share in one score."""
    return _clamp(0.55 * mean_midtone + 0.30 * _clamp((p95 - p5) / 170) + 0.15 * (1 - clipped))


def sharpness(edge_variance: Column) -> Column:
    return F.least(edge_variance / 1800, F.lit(1.0))


def occlusion(visible_area: Column, visible_points: Column, detection: Column) -> Column:
    """Hidden share; no points counts as none visible."""
    return 1 - _clamp(0.45 * visible_area + 0.30 * F.coalesce(visible_points, F.lit(0.0)) + 0.25 * detection)


def subject_quality(sharp: Column, exposed: Column, area_share: Column, detection: Column, hidden: Column, artifact: Column) -> Column:
    size = F.least(F.lit(1.0), 3 * F.sqrt(area_share))
    return 0.27 * sharp + 0.18 * exposed + 0.16 * size + 0.12 * detection + 0.14 * (1 - hidden) + 0.13 * (1 - artifact)


def baseline_quality(sharp: Column, exposed: Column, width: Column, height: Column) -> Column:
    return 0.45 * sharp + 0.30 * exposed + 0.25 * F.least(F.lit(1.0), F.sqrt(width * height) / 1600)


def diagnostic_flags(sharp: Column, exposed: Column, hidden: Column, artifact: Column) -> Column:
    named = [(sharp < 0.25, "soft"), (exposed < 0.35, "badly_exposed"), (hidden > 0.35, "hidden"), (artifact > 0.35, "blocky")]
    return F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in named]), lambda x: x.isNotNull())


def _distance(points: Column, a: int, b: int) -> Column:
    p, q = F.element_at(points, a + 1), F.element_at(points, b + 1)
    return F.sqrt(F.pow(p[0] - q[0], 2) + F.pow(p[1] - q[1], 2))


def expression(points: Column, box: Column) -> Column:
    """A struct (label, confidence) from 68 landmarks and a box (left, top, right, bottom); missing ones are neutral, 0.25."""
    width, height = box[2] - box[0], box[3] - box[1]
    y = lambda i: F.element_at(points, i + 1)[1]
    mouth = _distance(points, 48, 54) / width
    opening = _distance(points, 62, 66) / F.greatest(F.lit(1.0), _distance(points, 60, 64))
    lift = ((y(51) + y(57)) / 2 - (y(48) + y(54)) / 2) / height

    def eye(i: int) -> Column:
        return (_distance(points, i + 1, i + 5) + _distance(points, i + 2, i + 4)) / F.greatest(F.lit(1.0), 2 * _distance(points, i, i + 3))

    eyes = (eye(36) + eye(42)) / 2
    one = lambda label, score: F.struct(F.lit(label).alias("label"), F.round(F.least(F.lit(1.0), score), 3).alias("confidence"))
    usable = (F.coalesce(F.size(points), F.lit(0)) >= 68) & (F.coalesce(F.size(box), F.lit(0)) >= 4) & F.coalesce((F.try_element_at(box, F.lit(3)) > F.try_element_at(box, F.lit(1))) & (F.try_element_at(box, F.lit(4)) > F.try_element_at(box, F.lit(2))), F.lit(False))
    return (
        F.when(~usable, one("neutral", F.lit(0.25)))
        .when(eyes < 0.14, one("eyes_closed", 0.55 + 4 * (0.14 - eyes)))
        .when((opening > 0.22) & (eyes > 0.22), one("surprised", 0.55 + 1.8 * (opening - 0.22)))
        .when((mouth > 0.34) & (lift > 0.005), one("smiling", 0.55 + 2.5 * (mouth - 0.34) + 5 * lift))
        .when(opening > 0.12, one("mouth_open", 0.5 + 2 * (opening - 0.12)))
        .otherwise(one("neutral", 0.55 + 2 * F.greatest(F.lit(0.0), 0.12 - opening))))


def parse_label(text: Column) -> Column:
    """True or false from its spellings; anything else is an error."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(F.raise_error(F.concat(F.lit("no label: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def batch_size(mebibytes: Column) -> Column:
    """Inference batch by accelerator memory; 4 where it is unknown."""
    gib = mebibytes / 1024
    return F.when(mebibytes.isNull(), 4).when(gib < 8, 2).when(gib < 12, 4).when(gib < 20, 8).otherwise(12)


def worker_count(cpus: int) -> int:
    """CPU workers for a machine: all but one, from 2 to 8."""
    return max(2, min(8, cpus - 1))


def duration_text(seconds: Column) -> Column:
    """1h 02m, 2m 05s or 42s."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    return F.when(s >= 3600, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m"))).when(s >= 60, F.concat(m.cast("string"), F.lit("m "), two(s % 60), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def accelerator_metrics(line: Column) -> Column:
    """Four numbers of a comma-separated line, cut to integers, as a struct; null unless there are exactly four."""
    parts = F.transform(F.split(line, ","), lambda x: F.trim(x).try_cast("double").cast("int"))
    good = (F.size(parts) == 4) & ~F.exists(parts, lambda x: x.isNull())
    return F.when(good, F.struct(*[parts[i].alias(n) for i, n in enumerate(("load", "memory_used", "memory_total", "temperature"))]))


def metrics_text(cpu: Column, used: Column, total: Column, accelerator: Column) -> Column:
    """Load and memory (bytes; MiB on the accelerator) of a machine in one line."""
    gib = lambda x, unit: F.format_number(x / unit, 1)
    host = F.concat(F.lit("CPU "), F.format_number(cpu, 0), F.lit("%, memory "), gib(used, 1 << 30), F.lit("/"), gib(total, 1 << 30), F.lit(" GiB"))
    device = F.concat(F.lit(", accelerator "), accelerator["load"].cast("string"), F.lit("%, memory "), gib(accelerator["memory_used"], 1 << 10), F.lit("/"), gib(accelerator["memory_total"], 1 << 10), F.lit(" GiB, "), accelerator["temperature"].cast("string"), F.lit(" C"))
    return F.concat(host, F.coalesce(device, F.lit(", no accelerator")))


def analyzer_key(model: Column, revision: Column, provider: Column, runtime: Column, reference_digests: Column) -> Column:
    """A version key; the references count by twelve hex digits of the hash of their digests."""
    return F.concat_ws("-", model, revision, provider, runtime, F.substring(F.sha2(F.array_join(reference_digests, ""), 256), 1, 12))


# Words of failure messages by what they are about; the first class that fits counts.
FAILURE_WORDS = {
    "download": ("download", "connectionreset", "connection reset"),
    "accelerator": ("cuda", "cudnn", "executionprovider"),
    "reference": ("reference",),
    "space": ("free space", "not enough"),
}


def failure_class(message: Column) -> Column:
    """What a failure message is about: the first class one of whose words it holds."""
    text = F.lower(message)
    out = F.lit("other")
    for name, words in reversed(FAILURE_WORDS.items()):
        test = F.lit(False)
        for w in words:
            test = test | text.contains(w)
        out = F.when(test, name).otherwise(out)
    return out


def contains_all(query: Column, text: Column) -> Column:
    """Every word of the query is in the text, whatever the case; an empty query matches."""
    words = F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: w != "")
    return F.forall(words, lambda w: F.instr(F.lower(text), w) > 0)
