"""Quality predicates: one reason for each rejected document, the first that holds."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx


@dataclass(frozen=True)
class FilterConfig:
    """Thresholds and switches; lengths are always checked."""

    min_chars: int = 32
    max_chars: int | None = None
    max_repeat_ratio: float = 0.40
    min_alpha_hangul_ratio: float = 0.30
    max_whitespace_ratio: float = 0.50
    max_punct_ratio: float = 0.45
    enable_repetition: bool = True
    enable_alpha_hangul: bool = True
    enable_whitespace: bool = True
    enable_punct: bool = True

    @classmethod
    def of(cls, given: dict | None) -> FilterConfig:
        """From a mapping; keys that are no thresholds are left aside."""
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (given or {}).items() if k in names})


def reason(text: Column, language: Column, config: FilterConfig = FilterConfig()) -> Column:
    """Why a normalized text is rejected, else null. Branches that are switched off aren't planned."""
    checks = [("empty", text == ""), ("too_short", F.length(text) < config.min_chars)]
    if config.max_chars is not None:
        checks.append(("too_long", F.length(text) > config.max_chars))
    if config.enable_repetition:
        checks.append(("repetition", tx.run_ratio(text) > config.max_repeat_ratio))
    if config.enable_whitespace:
        checks.append(("excessive_whitespace", tx.ratio(text, tx.SPACE) > config.max_whitespace_ratio))
    if config.enable_punct:
        checks.append(("excessive_punctuation", tx.ratio(text, tx.PUNCTUATION) > config.max_punct_ratio))
    if config.enable_alpha_hangul:
        english = tx.is_english(language)
        checks.append(("low_alpha", english & (tx.ratio(text, tx.LATIN) < config.min_alpha_hangul_ratio)))
        checks.append(("low_alpha_hangul", ~english & (tx.ratio(text, tx.HANGUL_LATIN) < config.min_alpha_hangul_ratio)))
    out = F.when(checks[0][1], checks[0][0])
    for name, holds in checks[1:]:
        out = out.when(holds, name)
    return out


def classify(docs: DataFrame, config: FilterConfig = FilterConfig(), text: str = "text", language: str = "language") -> DataFrame:
    """Replaces the text by its normal form and adds the column reason; either is computed once."""
    normal = docs.withColumn(text, tx.once(tx.normalize(F.col(text))))
    return normal.withColumn("reason", tx.once(reason(F.col(text), F.col(language), config)))


def kept(classified: DataFrame) -> DataFrame:
    return classified.filter("reason IS NULL").drop("reason")


def reason_counts(classified: DataFrame) -> DataFrame:
    return classified.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def previews(classified: DataFrame, order: list[str], most: int = 3, text: str = "text") -> DataFrame:
    """The first non-empty previews of each reason."""
    shown = classified.filter("reason IS NOT NULL").select("reason", *order, tx.preview(F.col(text)).alias("preview")).filter("preview <> ''")
    return first_previews(shown, order, most)


def first_previews(shown: DataFrame, order: list[str], most: int = 3) -> DataFrame:
    """The first rows (reason, preview) of each reason."""
    nth = F.row_number().over(Window.partitionBy("reason").orderBy(*order))  # a limit that is pruned before the shuffle
    return shown.withColumn("nth", nth).filter(F.col("nth") <= most)
