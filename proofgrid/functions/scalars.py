"""Small column functions: normalisation, guarded arithmetic, scores and texts. All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(c: Column, true: tuple[str, ...] = ("1", "true", "yes"), false: tuple[str, ...] | None = None) -> Column:
    """A text as boolean. With false given, anything in neither list is an error; without it, it is false."""
    text = F.lower(F.trim(c.cast("string")))
    if false is None:
        return F.coalesce(text.isin(*true), F.lit(False))
    return F.when(text.isin(*true), True).when(text.isin(*false), False).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def number(c: Column) -> Column:
    """A text as double; empty or malformed text is null."""
    return F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("double")


def flag_or_number(c: Column) -> Column:
    """A text as double: true is 1, false is 0, anything else as number() has it."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(number(c))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is not above 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def sigmoid(c: Column, bound: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-clip(c, -bound, bound)))


def softmax(values: Column, temperature: float = 1.0) -> Column:
    """Weights of an array of scores; they add up to 1."""
    top = F.array_max(values)
    raised = F.transform(values, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)


def branch_score(confidence: Column, agreement: Column, margin: Column, fraction: Column) -> Column:
    """Fixed weights of a decoding branch's evidence: 0.30, 0.30, 0.30 and 0.10."""
    return 0.30 * confidence + 0.30 * agreement + 0.30 * F.tanh(margin / 2) + 0.10 * F.least(F.lit(1.0), fraction / 0.75)


def psnr(mse: Column, peak: float = 255.0) -> Column:
    """Decibels; equal images have infinity."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(peak * peak) / mse))


def finite_text(c: Column) -> Column:
    """A number as text for formats without infinities; null stays null."""
    return F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == -float("inf"), "-inf").otherwise(c.cast("string"))


def two_digits(c: Column, signed: bool = False) -> Column:
    """Half-up text with two digits."""
    text = F.format_number(c.cast("decimal(38,12)").cast("decimal(38,2)"), 2)
    text = F.replace(text, F.lit(","), F.lit(""))
    return F.when(c > 0, F.concat(F.lit("+"), text)).otherwise(text) if signed else text


def percent_text(c: Column) -> Column:
    """A share as percent with two digits."""
    return F.concat(two_digits(100 * c), F.lit("%"))


def interval_text(low: Column, high: Column) -> Column:
    """Two signed numbers of two digits in brackets."""
    return F.concat(F.lit("["), two_digits(low, signed=True), F.lit(", "), two_digits(high, signed=True), F.lit("]"))


def record_id(prefix: str, time: Column, key: Column) -> Column:
    """PREFIX-yymmdd-HEX10 from a time and a key; the same record has the same id."""
    return F.concat(F.lit(f"{prefix}-"), F.date_format(time, "yyMMdd"), F.lit("-"), F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 10)))


def export_guard(c: Column) -> Column:
    """A text that a spreadsheet would run as a formula gets a leading apostrophe."""
    return F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), c)).otherwise(c)


def safe_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Z0-9-]{8,64}$"), F.lit(False))


def inside(path: Column) -> Column:
    """True for a relative path that stays below its root."""
    return F.coalesce(~path.rlike(r"(^[/\\])|(^[A-Za-z]:)|((^|[/\\])\.\.([/\\]|$))"), F.lit(False))


def mask_box(width: Column, height: Column, share: float, x: float = 0.5, y: float = 0.5, aspect: float = 1.0) -> Column:
    """left, top, right, bottom of a rectangle that covers a share of an image, kept inside it; rounding is half to even."""
    area = width * height * share
    w = F.least(F.greatest(F.bround(F.sqrt(area * aspect), 0), F.lit(1.0)), width).cast("int")
    h = F.least(F.greatest(F.bround(F.sqrt(area / aspect), 0), F.lit(1.0)), height).cast("int")
    left = F.least(F.greatest(F.bround(width * x - w / 2, 0), F.lit(0.0)), width - w).cast("int")
    top = F.least(F.greatest(F.bround(height * y - h / 2, 0), F.lit(0.0)), height - h).cast("int")
    return F.struct(left.alias("left"), top.alias("top"), (left + w).alias("right"), (top + h).alias("bottom"))
