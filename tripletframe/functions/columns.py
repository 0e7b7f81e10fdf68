"""Projections, filters and scalar functions (P1-P15) as built-in column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metrics whose raw range is [-1, 1] and that are mapped to [0, 1].
RESCALED_METRICS = ("embsim", "bleurt", "simcse", "learned")
# Stop answer of the answer-list corpus and subword markers.
STOP_ANSWER = "I have no comment"
SUBWORD_MARKERS = ("##", "Ġ", "▁")
SPECIAL_TOKENS = ("[CLS]", "[SEP]", "[PAD]", "[UNK]", "[MASK]", "<s>", "</s>", "<pad>", "<unk>", "<|endoftext|>")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rename_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns by dictionary; names absent from df are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def label_map(col, mapping: Mapping) -> Column:
    """Value map as a literal map; unmapped values give null."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*items), _c(col))


def map_label(df: DataFrame, col: str, mapping: Mapping, out: str, drop_unmapped: bool = True) -> DataFrame:
    """Add ``out`` = mapping[col]; rows with an unmapped value are dropped (or keep it unchanged)."""
    mapped = label_map(col, mapping)
    if drop_unmapped:
        return df.withColumn(out, mapped).where(F.col(out).isNotNull())
    return df.withColumn(out, F.coalesce(mapped, F.col(col).cast(df.select(mapped.alias(out)).schema[out].dataType)))


def drop_null(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any listed column."""
    return df.dropna(how="any", subset=list(subset))


def filter_label(df: DataFrame, col: str, keep: Iterable | None = None, drop: Iterable | None = None) -> DataFrame:
    """Keep rows whose label is in ``keep`` and/or not in ``drop``."""
    if keep is not None:
        df = df.where(F.col(col).isin(list(keep)))
    if drop is not None:
        df = df.where(~F.col(col).isin(list(drop)))
    return df


def min_length(df: DataFrame, cols: Sequence[str], n: int = 3) -> DataFrame:
    """P5: keep rows whose texts are all longer than ``n`` characters."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.length(c) > n)
    return df.where(cond)


def clean_answer_list(arr, stop: str = STOP_ANSWER, min_len: int = 2) -> Column:
    """Drop elements equal to the stop answer or of length <= min_len."""
    return F.filter(_c(arr), lambda x: (x != F.lit(stop)) & (F.length(x) > min_len))


def first_last(arr) -> tuple[Column, Column]:
    """(last element, first element) of an array."""
    a = _c(arr)
    return F.element_at(a, -1), F.element_at(a, 1)


def head_sentence(text) -> Column:
    """Text before the first '.', whole text when there is none."""
    return F.substring_index(_c(text), ".", 1)


def join_all_but_last(arr, sep: str = " ") -> Column:
    """All but the last element joined by ``sep``; null when the array has < 2 elements."""
    a = _c(arr)
    return F.when(F.size(a) > 1, F.array_join(F.slice(a, 1, F.size(a) - 1), sep))


def norm_score(x, top: float = 5.0) -> Column:
    """P10: 0..top score to 0..1."""
    return _c(x).cast("double") / F.lit(float(top))


def rescale_signed(score, metric=None, metrics: Sequence[str] = RESCALED_METRICS) -> Column:
    """(x + 1) / 2 for signed metrics; other metrics unchanged.

    With ``metric`` (a column of metric names, long form) the choice is per row;
    without, the column is rescaled unconditionally.
    """
    s = _c(score)
    if metric is None:
        return (s + 1) / 2
    return F.when(_c(metric).isin(list(metrics)), (s + 1) / 2).otherwise(s)


def rescale_wide(df: DataFrame, metrics: Sequence[str] = RESCALED_METRICS) -> DataFrame:
    """P11 on wide frames: correct_m / incorrect_m / m columns present are rescaled."""
    cols = {}
    for m in metrics:
        for name in (f"correct_{m}", f"incorrect_{m}", m):
            if name in df.columns:
                cols[name] = (F.col(name) + 1) / 2
    return df.withColumns(cols) if cols else df


def clip01(x) -> Column:
    """Clamp to [0, 1]."""
    return F.greatest(F.least(_c(x), F.lit(1.0)), F.lit(0.0))


def fmt_pair(c, i, scale: float = 1.0) -> Column:
    """P13: '(c.cc, i.ii)' display string of two numbers (times ``scale``)."""
    return F.format_string("(%.2f, %.2f)", F.round(_c(c) * scale, 2), F.round(_c(i) * scale, 2))


def encode_pad(ids, length: int, pad_id: int) -> Column:
    """Id array truncated to ``length`` and right-padded with ``pad_id``."""
    a = _c(ids)
    return F.concat(F.slice(a, 1, length), F.array_repeat(F.lit(pad_id), F.greatest(F.lit(length) - F.size(a), F.lit(0))))


def clean_token(token) -> Column:
    """A token without its subword markers, wherever they stand (null when it is special or blank)."""
    t = _c(token)
    stripped = F.regexp_replace(t, "##|Ġ|▁", "")
    return F.when(t.isin(list(SPECIAL_TOKENS)) | (F.trim(stripped) == ""), F.lit(None)).otherwise(stripped)


def clean_tokens(df: DataFrame, token_col: str = "token") -> DataFrame:
    """P15 in long form: (row, pos, token[, weight]) stay together; specials and blanks removed."""
    return df.withColumn(token_col, clean_token(token_col)).where(F.col(token_col).isNotNull())
