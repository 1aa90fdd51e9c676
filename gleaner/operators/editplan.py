"""Declarative edit plans as maps, a model's changes to them, and chats cut to a context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig

# Settings of each recipe by strength, of each switch, and the
# limits of what a model may change.
SHARPEN_KEYS = ("Sharpness", "SharpenRadius", "SharpenDetail", "SharpenEdgeMasking")
SHARPEN = {"small": (25.0, 1.0, 25.0, 70.0), "medium": (40.0, 1.0, 35.0, 80.0), "high": (55.0, 1.2, 40.0, 85.0)}
VIGNETTE_KEYS = ("PostCropVignetteAmount", "PostCropVignetteMidpoint", "PostCropVignetteRoundness", "PostCropVignetteFeather")
VIGNETTE = {"small": (-10.0, 50.0, 0.0, 50.0), "medium": (-20.0, 45.0, 0.0, 60.0), "high": (-35.0, 40.0, 0.0, 70.0)}
VIGNETTE_STYLE = {"PostCropVignetteStyle": 1.0}
COLOR_TONE = {"Contrast2012": 8.0, "Vibrance": 8.0}
EXPOSURE = {"Exposure2012": 0.0, "Highlights2012": -10.0, "Shadows2012": 10.0}
NOISE = {"LuminanceSmoothing": 20.0, "ColorNoiseReduction": 25.0}
LIMITS = {"Exposure2012": ("exposureDelta", -1.0, 1.0), "Contrast2012": ("contrastDelta", -20.0, 20.0), "Vibrance": ("vibranceDelta", -20.0, 20.0)}
STRENGTHS = ("small", "medium", "high")

CROP_WARNING = "Optimal crop requested; nothing here analyses composition, so the source crop is preserved."
ADJUSTMENTS = "struct<eyeSharpenStrength:string,vignetteStrength:string,subjectBlurStrength:string,exposureDelta:double,contrastDelta:double,vibranceDelta:double>"


def recipes(spark: SparkSession) -> DataFrame:
    """(strength, sharpen_amount, sharpen_radius, sharpen_detail, sharpen_masking,
    vignette_amount, vignette_midpoint, vignette_roundness, vignette_feather); three rows."""
    names = [f"sharpen_{n}" for n in ("amount", "radius", "detail", "masking")] + [f"vignette_{n}" for n in ("amount", "midpoint", "roundness", "feather")]
    return spark.createDataFrame([(s, *SHARPEN[s], *VIGNETTE[s]) for s in STRENGTHS], "strength string, " + ", ".join(f"{n} double" for n in names))


def with_recipe(requests: DataFrame) -> DataFrame:
    """requests (strength, ...) with the recipe's settings; other strengths get nulls."""
    return requests.join(F.broadcast(recipes(requests.sparkSession)), "strength", "left")


def _entries(on: Column, values: dict[str, Column | float]) -> list[Column]:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return [F.when(on & lit(v).isNotNull(), F.struct(F.lit(k).alias("k"), lit(v).alias("v"))) for k, v in values.items()]


def _recipe(strength: Column, keys: tuple[str, ...], table: dict[str, tuple[float, ...]]) -> dict[str, Column]:
    out = {}
    for i, key in enumerate(keys):
        value = F.lit(None).cast("double")
        for name in reversed(STRENGTHS):
            value = F.when(strength == name, F.lit(table[name][i])).otherwise(value)
        out[key] = value
    return out


def _map(entries: list[Column]) -> Column:
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def plan(**switches: Column | bool | str) -> Column:
    """struct<settings map<string,double>, texts map<string,string>,
    subject_blur_strength string, warnings array<string>> of the switches of
    ``EngineConfig`` that are on, given as columns or values; those not given
    are as ``EngineConfig()`` has them, and a null switch is off."""
    default = EngineConfig()

    def of(name: str) -> Column:
        value = switches.get(name, getattr(default, name))
        return value if isinstance(value, Column) else F.lit(getattr(value, "value", value))

    on = lambda name: F.coalesce(of(name).cast("boolean"), F.lit(False))
    settings = (
        _entries(on("eye_sharpen"), _recipe(of("eye_sharpen_strength"), SHARPEN_KEYS, SHARPEN))
        + _entries(on("vignette"), _recipe(of("vignette_strength"), VIGNETTE_KEYS, VIGNETTE) | VIGNETTE_STYLE)
        + _entries(on("color_tone"), COLOR_TONE)
        + _entries(on("exposure_normalize"), EXPOSURE)
        + _entries(on("noise_reduction"), NOISE)
    )
    texts = [F.when(on("white_balance"), F.struct(F.lit("WhiteBalance").alias("k"), F.lit("Auto").alias("v")))]
    warnings = F.filter(F.array(F.when(on("optimal_crop"), F.lit(CROP_WARNING))), lambda w: w.isNotNull())
    return F.struct(_map(settings).alias("settings"), _map(texts).alias("texts"), F.when(on("subject_blur"), of("subject_blur_strength")).alias("subject_blur_strength"), warnings.alias("warnings"))


def of_config(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """(plan) of one row."""
    names = ("eye_sharpen", "eye_sharpen_strength", "vignette", "vignette_strength", "subject_blur", "subject_blur_strength", "optimal_crop", "white_balance", "color_tone", "exposure_normalize", "noise_reduction")
    return spark.range(1).select(plan(**{n: getattr(cfg, n) for n in names}).alias("plan"))


def build(files: DataFrame, cfg: EngineConfig, answer: str | None = None) -> DataFrame:
    """files with the one ``plan`` of a run, changed by a model's answer if given.

    Refused (ValueError) where there is no file, where a model is to be used
    but is not allowed, or where its answer is not the JSON that was asked for."""
    if cfg.ai_refusal():
        raise ValueError(cfg.ai_refusal())
    if files.isEmpty():
        raise ValueError("EDITPLAN-EMPTY: no supported images found")
    one = of_config(files.sparkSession, cfg)
    if cfg.use_ai_for_edit and answer is not None:
        parsed = one.select("plan", adjustments(F.lit(answer)).alias("a"))
        if parsed.first()["a"] is None:
            raise ValueError("EDITPLAN-SCHEMA: model returned invalid edit JSON")
        one = parsed.select(adjusted(F.col("plan"), F.col("a")).alias("plan"))
    row = one.select(F.to_json("plan").alias("p"), F.col("plan")).first()
    return files.withColumn("plan", F.from_json(F.lit(row["p"]), one.schema["plan"].dataType))


def add_clamped(base: Column, delta: Column, low: float, high: float) -> Column:
    """base + delta within limits; a missing base is 0 and a missing delta changes nothing."""
    return F.when(delta.isNull(), base).otherwise(F.greatest(F.least(F.coalesce(base, F.lit(0.0)) + delta, F.lit(high)), F.lit(low)))


def adjusted(plan: Column, changes: Column) -> Column:
    """A plan with a model's changes (of ``adjustments``): recipes of other
    strengths replace the plan's, deltas are added within limits, and an
    absent change leaves its part as it is."""
    settings = plan["settings"]
    new = _recipe(changes["eyeSharpenStrength"], SHARPEN_KEYS, SHARPEN) | _recipe(changes["vignetteStrength"], VIGNETTE_KEYS, VIGNETTE)
    for key, (delta, low, high) in LIMITS.items():
        new[key] = F.when(changes[delta].isNotNull(), add_clamped(F.try_element_at(settings, F.lit(key)), changes[delta], low, high))
    entries = F.filter(F.array(*_entries(F.lit(True), new)), lambda e: e.isNotNull())
    replaced = F.transform(entries, lambda e: e["k"])
    kept = F.transform(F.filter(F.map_entries(settings), lambda e: ~F.array_contains(replaced, e["key"])), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    return plan.withField("settings", F.map_from_entries(F.concat(kept, entries))).withField("subject_blur_strength", F.coalesce(changes["subjectBlurStrength"], plan["subject_blur_strength"]))


def adjustments(answer: Column) -> Column:
    """A model's JSON as a struct of six optional fields; null where it is no
    such object or names a strength that is none."""
    parsed = F.from_json(answer, ADJUSTMENTS[:-1] + ",_bad:string>", {"columnNameOfCorruptRecord": "_bad"})
    known = lambda s: s.isNull() | s.isin(*STRENGTHS)
    fine = parsed["_bad"].isNull() & F.startswith(F.ltrim(answer), F.lit("{")) & known(parsed["eyeSharpenStrength"]) & known(parsed["vignetteStrength"]) & known(parsed["subjectBlurStrength"])
    return F.when(fine, parsed.dropFields("_bad"))


def generated(response: Column) -> Column:
    """The text of a completion's response, trimmed; null if it has none."""
    return F.trim(F.get_json_object(response, "$.response"))


def chat_reply(response: Column) -> Column:
    """The text of a chat's response, trimmed; null if it has none."""
    return F.trim(F.get_json_object(response, "$.message.content"))


def answer_index(answer: Column, candidates: Column) -> Column:
    """1-based index of the candidate an answer names: a leading number, or the
    first candidate whose name occurs in it; null if none."""
    number = F.regexp_extract(F.trim(answer), "^([0-9]+)", 1).try_cast("int")
    named = F.array_position(F.transform(candidates, lambda c: F.contains(answer, c)), True).cast("int")
    return F.when(number.between(1, F.size(candidates)), number).when(named > 0, named)


def score_answer_index(answer: Column, candidates: Column) -> Column:
    """1-based index of the first candidate whose name occurs in the trimmed
    answer or holds it, so an empty answer names the first; null if none."""
    short = F.trim(answer)
    named = F.array_position(F.transform(candidates, lambda c: F.contains(short, c) | F.contains(c, short)), True).cast("int")
    return F.when(named > 0, named)


def candidate_line(name: Column, **metrics: Column) -> Column:
    """A member as a line of a prompt: its name and metrics to three places."""
    parts = [F.concat(F.lit(f"{k}="), F.format_string("%.3f", v.cast("double"))) for k, v in metrics.items()]
    return F.concat(F.lit("- "), name, F.lit(": "), F.concat_ws(", ", *parts))


def as_base64(content: Column) -> Column:
    """Bytes of an image as a prompt carries them."""
    return F.regexp_replace(F.base64(content), r"\s", "")


def trim_chat(messages: DataFrame, most: int = 20, most_bytes: int = 32_000) -> DataFrame:
    """The newest messages of each conversation: at most ``most``, up to the
    first that would exceed ``most_bytes``, the newest one always."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    total = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    rows = messages.withColumn("_n", F.row_number().over(newest)).withColumn("_bytes", total)
    return rows.where((F.col("_n") == 1) | ((F.col("_n") <= most) & (F.col("_bytes") <= most_bytes))).drop("_n", "_bytes")


def latest_user_message(messages: DataFrame) -> DataFrame:
    return messages.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


# Parts of the names of models that see images.
VISION_FAMILIES = ("vl", "vision", "llava", "moondream", "minicpm-v", "bakllava", "gemma3", "pixtral", "internvl", "cogvlm")


def sees_images(name: Column, capabilities: Column | None = None) -> Column:
    """Whether the capabilities a model states (a JSON array) or its name say so."""
    by_name = F.exists(F.array(*[F.lit(f) for f in VISION_FAMILIES]), lambda f: F.contains(F.lower(name), f))
    if capabilities is None:
        return by_name
    return F.coalesce(F.array_contains(F.from_json(capabilities, "array<string>"), "vision"), F.lit(False)) | by_name
